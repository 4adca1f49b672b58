"""Reader and writer queries: tables go out to the shared folder and come back."""

from pyspark.sql import Observation, functions as F

from .. import fixed_values as fv, schemas
from ..functions import annotations as an
from ..functions.embedding import embed_text
from ..operators import knn, training as tr
from ..operators.cleaning import clean_answers
from ..session import scratch_path
from ..sources import checked, jsonl
from ..sources.tables import gold_annotations, table, wide_table
from .cleaning import raw_answers
from .registry import CLEAN, GOLD, SQL, query
from .training import SPLIT, labels_only

LOW, AI = fv.LOW_QUALITY, fv.AI_GENERATED


@query("write_jsonl", f"""WITH {CLEAN} SELECT q AS question, a AS answer_full_clean, cut AS preview_was_truncated, CAST(NULL AS BOOLEAN) AS low_label,
  'unlabeled' AS low_status FROM c1 WHERE length(a) >= 20""")
def write_jsonl(spark, sf):
    """Cleaned samples written and read strictly."""
    path = scratch_path(spark, "cleaned")
    jsonl.write_jsonl(clean_answers(raw_answers(spark, sf)), path)
    back = jsonl.read_jsonl(spark, path, schemas.CLEANED_SAMPLES)
    low = an.task_entry(F.col("task_annotations"), LOW)
    return back.select(
        "question", "answer_full_clean", "extra.preview_was_truncated", low["label"].alias("low_label"), low["status"].alias("low_status")
    )


@query("append_jsonl", "SELECT text FROM documents UNION ALL SELECT text FROM benchmark")
def append_jsonl(spark, sf):
    path = scratch_path(spark, "appended")
    for name in ("documents", "benchmark"):
        jsonl.append_jsonl(table(spark, sf, name).select("text"), path)
    return jsonl.read_jsonl(spark, path, "text string")


def broken_lines(spark, sf):
    """Every document as a JSON line; those of one language lose their closing brace."""
    line = F.to_json(F.struct("doc_id", "lang"))
    path = scratch_path(spark, "lines")
    table(spark, sf, "documents").select(
        F.when(F.col("lang") == "es", F.expr("substring(to_json(struct(doc_id, lang)), 1, 8)")).otherwise(line).alias("value")
    ).write.text(path)
    return path


@query("read_jsonl_tolerant", "SELECT doc_id, lang FROM documents WHERE lang <> 'es'")
def read_jsonl_tolerant(spark, sf):
    return jsonl.read_jsonl(spark, broken_lines(spark, sf), "doc_id bigint, lang string", "DROPMALFORMED")


@query("read_jsonl_with_rejects", "SELECT CASE WHEN lang = 'es' THEN 'rejected' ELSE 'read' END AS outcome, count(*) AS lines FROM documents GROUP BY 1")
def read_jsonl_with_rejects(spark, sf):
    good, bad = jsonl.read_jsonl_with_rejects(spark, broken_lines(spark, sf), "doc_id bigint, lang string")
    count = lambda df, name: df.agg(F.lit(name).alias("outcome"), F.count(F.lit(1)).alias("lines"))
    return count(good, "read").unionByName(count(bad, "rejected"))


def labeled_examples(spark, sf):
    """Labeled documents as examples: some with annotations, the others with a legacy label."""
    rows = gold_annotations(table(spark, sf, "labels")).join(table(spark, sf, "documents"), "doc_id")
    short = F.transform_values("task_annotations", lambda t, a: F.struct(a["label"].alias("label"), a["reason"].alias("reason")))
    legacy = F.col("doc_id") % 2 == 0
    return rows.select(
        "doc_id", "text", F.col("source").alias("category"),
        F.when(legacy, F.when(an.task_label(F.col("task_annotations"), LOW), "low_quality").otherwise("genuine")).alias("label"),
        F.when(~legacy, short).alias("task_annotations"),
    )


EXAMPLE_ROWS = f"""{GOLD}, e AS (SELECT doc_id, text, source AS category, low AS low_label, CASE WHEN doc_id % 2 = 0 THEN false ELSE ai END AS ai_label,
  CASE WHEN doc_id % 2 = 0 THEN source ELSE low_reason END AS low_reason FROM gold JOIN documents USING (doc_id))"""


@query("read_examples", f"WITH {EXAMPLE_ROWS} SELECT text, category, low_label, ai_label, low_reason FROM e")
def read_examples(spark, sf):
    """Examples written as JSON arrays, one bounded array per file, read and completed."""
    path = scratch_path(spark, "examples")
    examples = labeled_examples(spark, sf)
    per_file = 500
    files = max(1, examples.count() // per_file)
    # A group is one file of about 500 examples.
    (
        examples.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(files)).alias("file"))
        .agg(F.to_json(F.collect_list(F.struct("text", "category", "label", "task_annotations"))).alias("value"))
        .write.partitionBy("file").text(path)
    )
    back = knn.normalize_example_annotations(jsonl.read_examples(spark, path))
    low, ai = (an.task_entry(F.col("task_annotations"), t) for t in fv.TASK_IDS)
    return back.select("text", "category", low["label"].alias("low_label"), ai["label"].alias("ai_label"), low["reason"].alias("low_reason"))


@query("normalize_example_annotations", f"WITH {EXAMPLE_ROWS} SELECT doc_id, low_label, ai_label, low_reason FROM e")
def normalize_example_annotations(spark, sf):
    rows = knn.normalize_example_annotations(labeled_examples(spark, sf))
    low, ai = (an.task_entry(F.col("task_annotations"), t) for t in fv.TASK_IDS)
    return rows.select("doc_id", low["label"].alias("low_label"), ai["label"].alias("ai_label"), low["reason"].alias("low_reason"))


@query("build_example_base", f"""WITH {EXAMPLE_ROWS} SELECT 'example_' || doc_id AS id, category, CAST(low_label AS INTEGER) AS is_low_quality,
  CAST(ai_label AS INTEGER) AS is_ai_generated, 64 AS dimensions FROM e""")
def build_example_base(spark, sf):
    """The base is written once; a second call finds it and leaves it."""
    path = scratch_path(spark, "base")
    examples = labeled_examples(spark, sf)
    jsonl.build_example_base(spark, path, examples, "doc_id")
    base = jsonl.build_example_base(spark, path, examples, "doc_id")
    return base.select("id", "category", LOW, AI, F.size("embedding").cast("bigint").alias("dimensions"))


@query("example_base_count", f"WITH {EXAMPLE_ROWS} SELECT count(*) AS examples_count, '{LOW},{AI}' AS task_ids FROM e")
def example_base_count(spark, sf):
    return knn.example_base_count(knn.example_rows(labeled_examples(spark, sf), "doc_id"))


@query("embed_text", """WITH u AS (SELECT doc_id, list_transform(string_split(text, ''), lambda c: unicode(c)) AS u FROM documents),
c AS (SELECT doc_id, h, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, len(u)), lambda i: (u[i] * 31 + u[i + 1]) % 64)) AS h FROM u) GROUP BY 1, 2)
SELECT doc_id, h AS bucket, CAST(CAST(n::DOUBLE / sqrt(CAST(sum(n * n) OVER (PARTITION BY doc_id) AS DOUBLE)) AS FLOAT) AS DOUBLE) AS weight FROM c""")
def embed(spark, sf):
    vectors = wide_table(spark, sf, "documents").select("doc_id", embed_text(F.col("text")).alias("v"))
    return vectors.select("doc_id", F.posexplode("v").alias("bucket", "w")).filter("w > 0").select(
        "doc_id", "bucket", F.col("w").cast("double").alias("weight")
    )


@query("write_splits", f"WITH {SPLIT} SELECT doc_id, '{LOW}' AS task_id, split FROM split")
def write_splits(spark, sf):
    path = scratch_path(spark, "splits")
    split = tr.stratified_split(labels_only(spark, sf), "doc_id").select("doc_id", "task_label", "split")
    jsonl.write_splits(split.withColumn("task_id", F.lit(LOW)), path)
    schema = "doc_id bigint, task_label boolean, task_id string, split string"
    return spark.read.schema(schema).json(path).select("doc_id", "task_id", "split")




@query("write_split_files", f"WITH {SPLIT} SELECT '{LOW}_' || split || '.jsonl' AS file, doc_id FROM split")
def write_split_files(spark, sf):
    """One file for each task and split, named by them."""
    path = scratch_path(spark, "split-files")
    split = tr.stratified_split(labels_only(spark, sf), "doc_id").select("doc_id", "split", F.lit(LOW).alias("task_id"))
    checked.write_split_files(split, path)
    back = spark.read.schema("doc_id bigint").option("pathGlobFilter", "*.jsonl").json(path)
    return back.select(F.col("_metadata.file_name").alias("file"), "doc_id")


@query("write_task_dataset", "SELECT count(*) AS rows, count(*) FILTER (WHERE quality = 0) AS positive, count(*) FILTER (WHERE quality <> 0) AS negative, count(*) AS stored FROM labels")
def write_task_dataset(spark, sf):
    """The counts that were gathered and checked while the rows were written."""
    path = scratch_path(spark, "task-rows")
    rows = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 0).alias("task_label"))
    seen = checked.write_task_dataset(rows, path)
    return spark.read.parquet(path).agg(*[F.lit(seen[c]).alias(c) for c in ("rows", "positive", "negative")], F.count(F.lit(1)).alias("stored"))


@query("cleaning_stats_on_write", SQL["cleaning_stats"])
def cleaning_stats_on_write(spark, sf):
    """The counters of cleaning, gathered while the cleaned samples are written."""
    seen = Observation()
    clean_answers(raw_answers(spark, sf), observation=seen).write.parquet(scratch_path(spark, "cleaned"))
    return spark.range(1).select(*[F.lit(v).alias(c) for c, v in seen.get.items()])
