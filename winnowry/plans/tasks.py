"""A third task, given as a row of the task table: prompted, validated, reviewed."""

from pyspark.sql import functions as F

from .. import fixed_values as fv, schemas
from ..functions import annotations as an, prompts as pr
from ..operators import review as rv, tasks as ts
from ..sources.tables import table
from .annotations import model_annotations
from .models import text
from .registry import query, values
from .review import STANDING, review_log

TOPIC = {
    "task_id": "is_off_topic", "ordinal": 3, "name": "off topic", "description": "whether the answer leaves the question",
    "positive_label": "yes", "negative_label": "no", "reason_options": ["another subject", "no answer at all"],
}
THREE = [*fv.TASKS, TOPIC]


def three_tasks(spark):
    return spark.createDataFrame([tuple(t[c.split(" ")[0]] for c in schemas.TASKS.split(", ")) for t in THREE], schemas.TASKS)


@query("third_task_prompt", f"SELECT doc_id, {text(pr.label_prompt_head(THREE))} || substring(text, 1, 1200) || chr(10) AS prompt FROM documents")
def third_task_prompt(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return ts.with_label_prompt(docs, three_tasks(spark), "text").drop("text")


@query("third_task_violations", f"""WITH s AS (SELECT doc_id, n_chars % 4 AS k, n_chars % 3 = 0 AS label FROM documents),
a AS (SELECT doc_id, t.task_id, label, CASE k WHEN 0 THEN '' WHEN 1 THEN {values(TOPIC['reason_options'])}[1] ELSE 'else' END AS reason
  FROM s, (VALUES ('is_off_topic'), ('is_unheard_of')) t(task_id)),
v AS (SELECT doc_id, task_id, concat_ws(',', CASE WHEN task_id = 'is_unheard_of' THEN 'unknown_task' END, CASE WHEN label AND reason = '' THEN 'positive_without_reason' END,
  CASE WHEN reason <> '' AND (task_id = 'is_unheard_of' OR reason = 'else') THEN 'unknown_reason' END) AS violations FROM a)
SELECT * FROM v WHERE violations <> ''""")
def third_task_violations(spark, sf):
    k, label = F.col("n_chars") % 4, F.col("n_chars") % 3 == 0
    reason = F.when(k == 0, "").when(k == 1, TOPIC["reason_options"][0]).otherwise("else")
    entry = an.annotation(label, reason, F.lit("m"), F.lit("auto"), F.lit(0.5))
    docs = table(spark, sf, "documents").select("doc_id", F.create_map(F.lit("is_off_topic"), entry, F.lit("is_unheard_of"), entry).alias("task_annotations"))
    found = ts.validate(docs, three_tasks(spark), key="doc_id")
    return found.select("doc_id", "task_id", F.array_join("violations", ",").alias("violations"))


@query("third_task_review", f"""WITH {STANDING} SELECT reviewer, session, seq, sample_id, 'is_off_topic' AS task_id,
  CASE choice WHEN 'y' THEN true WHEN 'n' THEN false END AS label,
  CASE WHEN choice = 'y' AND reason_no BETWEEN 1 AND 2 THEN {values(TOPIC['reason_options'])}[reason_no] ELSE '' END AS reason FROM standing WHERE choice <> 'a'""")
def third_task_review(spark, sf):
    """Decisions on the third task; no model has judged it, so none can be accepted."""
    log = review_log(spark, sf).withColumn("task_id", F.when(F.col("choice") != "undo", "is_off_topic"))
    decided = rv.decide_annotations(rv.undo_last(log), model_annotations(spark, sf), "doc_id", THREE).filter("valid")
    return decided.select("reviewer", "session", "seq", "sample_id", "task_id", "annotation.label", "annotation.reason")


@query("third_task_flags", f"""SELECT doc_id, CAST(n_chars % 2 = 0 AS INT) AS low, 0 AS ai, CAST(n_chars % 3 = 0 AS INT) AS topic, 1 AS missing FROM documents""")
def third_task_flags(spark, sf):
    """0/1 values of the examples for all tasks of the table, and how many tasks they lack."""
    entry = lambda c: an.annotation(c, F.lit(""), F.lit("m"), F.lit("auto"), F.lit(0.5))
    docs = table(spark, sf, "documents").select(
        "doc_id", F.create_map(F.lit(fv.LOW_QUALITY), entry(F.col("n_chars") % 2 == 0), F.lit("is_off_topic"), entry(F.col("n_chars") % 3 == 0)).alias("task_annotations")
    )
    flagged, lacking = ts.example_flags(docs, three_tasks(spark)), ts.missing_tasks(docs, three_tasks(spark), key="doc_id")
    value = lambda t: F.element_at("flags", F.lit(t))
    return flagged.join(lacking, "doc_id").select(
        "doc_id", value(fv.LOW_QUALITY).alias("low"), value(fv.AI_GENERATED).alias("ai"), value("is_off_topic").alias("topic"), F.size("missing").alias("missing")
    )
