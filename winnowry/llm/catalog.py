"""The registered queries of this subpackage."""

from .common import table
from .decision_lists import op3_decision_lists
from .hard_negatives import SQL as NEGATIVES_SQL, op12_hard_negatives
from .jaccard_join import op5_jaccard_join
from .language_crf import op9_language_crf
from .mixing import SQL as MIXING_SQL, op8_mixing
from .pii_votes import op2_pii_votes
from .positional_index import op7_positional_index
from .secret_ledger import op1_secret_ledger
from .token_files import op10_token_files
from .url_models import op6_url_models
from .vector_packing import op4_vector_packing
from .warc_records import SQL as WARC_SQL, op13_warc_records
from .whitening import op11_whitening

QUERIES = {
    "op1_secret_ledger": lambda spark, d: op1_secret_ledger(table(spark, d, "documents")),
    "op2_pii_votes": lambda spark, d: op2_pii_votes(table(spark, d, "documents")),
    "op3_decision_lists": lambda spark, d: op3_decision_lists(table(spark, d, "documents"), table(spark, d, "labels")),
    "op4_vector_packing": lambda spark, d: op4_vector_packing(table(spark, d, "documents")),
    "op5_jaccard_join": lambda spark, d: op5_jaccard_join(table(spark, d, "documents")),
    "op6_url_models": lambda spark, d: op6_url_models(table(spark, d, "pages")),
    "op7_positional_index": lambda spark, d: op7_positional_index(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op8_mixing": lambda spark, d: op8_mixing(table(spark, d, "documents")),
    "op9_language_crf": lambda spark, d: op9_language_crf(table(spark, d, "documents")),
    "op10_token_files": lambda spark, d: op10_token_files(table(spark, d, "documents")),
    "op11_whitening": lambda spark, d: op11_whitening(table(spark, d, "embeddings")),
    "op12_hard_negatives": lambda spark, d: op12_hard_negatives(table(spark, d, "embeddings")),
    "op13_warc_records": lambda spark, d: op13_warc_records(table(spark, d, "pages")),
}
SQL = {"op8_mixing": MIXING_SQL, "op12_hard_negatives": NEGATIVES_SQL, "op13_warc_records": WARC_SQL}
