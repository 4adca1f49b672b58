"""From raw documents to coded token files, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next one's docs. All but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, functions as F

from winnowry.llm import jaccard_join, language_crf, mixing, positional_index, token_files
from winnowry.llm.common import table
from winnowry.session import materialize, scratch_path

# The mixed corpus has this share of the tokens that are left, each document at most once.
TOKEN_SHARE = 0.9


def known_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model knows."""
    return language_crf.keep_known(docs)


def one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.keep_one(docs)


def not_in_benchmark(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage in the sense of the contamination rule."""
    return positional_index.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def to_weights(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A seeded choice of documents whose tokens follow the target weights."""
    placed = docs.withColumn("_domain", mixing.domain_of(F.col("source")))
    renamed = placed.withColumnRenamed("_domain", "domain") if "domain" not in docs.columns else placed
    levels = mixing.LEVELS if "domain" not in docs.columns else ("_domain", *mixing.LEVELS[1:])
    weights = {("_domain" if k == "domain" and levels[0] == "_domain" else k): w for k, w in mixing.WEIGHTS.items()}
    return mixing.mix(renamed, total_share=TOKEN_SHARE, max_epochs=1, levels=levels, weights=weights).select(*docs.columns)


def to_tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Coded token files; a row for each document, from the files."""
    path = scratch_path(spark, "pipeline-tokens")
    token_files.write_blocks(docs, path, "doc_id")
    return token_files.summary(spark, path).withColumnRenamed("key", "doc_id")


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_each),
    ("benchmark_decontamination", not_in_benchmark),
    ("mixing_to_weights", to_weights),
    ("token_id_output", to_tokens),
]
# Language labels and tokenizer ids can't be expressed in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
