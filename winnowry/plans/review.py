"""Review queries: the event log read as a decision log."""

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import annotations as an
from ..operators import dedup as dd, review as rv
from ..sources.tables import table
from .annotations import MODEL, model_annotations
from .cleaning import SAMPLE_ID, raw_answers
from .registry import AI_REASON, CLEAN, LOW_REASON, query, values

LOW, AI = fv.LOW_QUALITY, fv.AI_GENERATED
CHOICE = "CASE event_type WHEN 'view' THEN 'y' WHEN 'click' THEN 'n' WHEN 'signup' THEN 's' WHEN 'purchase' THEN 'a' ELSE 'undo' END"
SAMPLE = "CASE WHEN event_type <> 'error' THEN CAST(event_id % 1000 AS STRING) END"


def review_log(spark, sf):
    """Every event is a reviewed sample or an undo."""
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("reviewer"),
        (F.col("user_id") % 3).cast("string").alias("session"),
        F.col("event_id").alias("seq"),
        F.expr(SAMPLE).alias("sample_id"),
        F.expr(CHOICE).alias("choice"),
        (F.col("event_id") % 9).cast("int").alias("reason_no"),
        F.col("ts").alias("decided_at"),
    )


def decision_log(spark, sf):
    """The same with one row per task of a reviewed sample."""
    tasks = F.array(*[F.lit(t) for t in fv.TASK_IDS])
    none = F.array(F.lit(None).cast("string"))
    return review_log(spark, sf).withColumn(
        "task_id", F.explode(F.when(F.col("choice") == "undo", none).otherwise(tasks))
    )


LOG = f"""log AS (SELECT CAST(user_id AS VARCHAR) AS reviewer, CAST(user_id % 3 AS VARCHAR) AS session, event_id AS seq, {SAMPLE} AS sample_id,
  {CHOICE} AS choice, event_id % 9 AS reason_no FROM events)"""
STANDING = f"""{LOG}, raw AS (SELECT *, sum(CASE WHEN choice = 'undo' THEN -1 ELSE 1 END) OVER (PARTITION BY reviewer, session ORDER BY seq) AS r FROM log),
bal AS (SELECT *, r - least(0, min(r) OVER (PARTITION BY reviewer, session ORDER BY seq)) AS b FROM raw),
fut AS (SELECT *, min(b) OVER (PARTITION BY reviewer, session ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM bal),
standing AS (SELECT reviewer, session, seq, sample_id, choice, reason_no FROM fut WHERE choice <> 'undo' AND m >= b)"""


@query("undo_last", f"WITH {STANDING} SELECT reviewer, session, seq, sample_id, choice FROM standing")
def undo_last(spark, sf):
    return rv.undo_last(review_log(spark, sf), chunk=5000).select("reviewer", "session", "seq", "sample_id", "choice")


def _decided(task, label, conf):
    reasons = next(t["reason_options"] for t in fv.TASKS if t["task_id"] == task)
    own = LOW_REASON if task == LOW else AI_REASON
    return f"""SELECT reviewer, session, seq, sample_id, '{task}' AS task_id, choice,
  CASE choice WHEN 'a' THEN {label} WHEN 'y' THEN true WHEN 'n' THEN false END AS label,
  CASE WHEN choice = 'a' AND {label} THEN '{own}' WHEN choice = 'y' AND reason_no BETWEEN 1 AND {len(reasons)} THEN {values(reasons)}[reason_no] ELSE '' END AS reason,
  CASE WHEN choice = 'a' THEN 'human_reviewed_auto' ELSE 'human' END AS source,
  CASE WHEN choice = 's' THEN NULL ELSE 1.0::DOUBLE END AS confidence, choice <> 'a' OR {label} IS NOT NULL AS valid
FROM standing LEFT JOIN model USING (sample_id)"""


DECIDED = f"{STANDING}, {MODEL}, decided AS ({_decided(LOW, 'low', 'low_conf')} UNION ALL {_decided(AI, 'ai', 'ai_conf')})"


@query("review_decisions", f"WITH {DECIDED} SELECT * FROM decided")
def review_decisions(spark, sf):
    log = rv.undo_last(decision_log(spark, sf))
    decided = rv.decide_annotations(log, model_annotations(spark, sf), "doc_id")
    return decided.select(
        "reviewer", "session", "seq", "sample_id", "task_id", "choice", "annotation.label", "annotation.reason",
        "annotation.source", "annotation.confidence", "valid",
    )


@query("apply_review_decisions", f"""WITH {DECIDED}
SELECT d.reviewer, d.session, d.seq, d.sample_id, text AS model_input, bool_or(label) FILTER (WHERE task_id = '{LOW}') AS low_label,
  bool_or(label) FILTER (WHERE task_id = '{AI}') AS ai_label, any_value(m.low) AS predicted_low, count(*) AS tasks
FROM decided d JOIN model m USING (sample_id) JOIN documents USING (doc_id) WHERE valid GROUP BY ALL""")
def apply_review_decisions(spark, sf):
    samples = table(spark, sf, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("sample_id"), F.col("text").alias("content"), F.col("source").alias("url")
    )
    log = rv.undo_last(decision_log(spark, sf))
    done = rv.apply_review_decisions(samples, model_annotations(spark, sf), log, "doc_id", "doc_id")
    label = lambda c, t, n: an.task_label(F.col(c), t).alias(n)
    return done.select(
        "reviewer", "session", "seq", "sample_id", "model_input", label("task_annotations", LOW, "low_label"),
        label("task_annotations", AI, "ai_label"), label("predicted_task_annotations", LOW, "predicted_low"),
        F.size("task_annotations").cast("bigint").alias("tasks"),
    )


@query("attach_predictions", f"""WITH {MODEL} SELECT l.doc_id, low AS predicted_low, ai AS predicted_ai FROM labels l LEFT JOIN model m ON l.doc_id = m.doc_id AND m.doc_id % 2 = 0""")
def attach_predictions(spark, sf):
    samples = table(spark, sf, "labels").select("doc_id", F.col("doc_id").cast("string").alias("sample_id"))
    predictions = model_annotations(spark, sf).withColumn(
        "sample_id", F.when(F.col("doc_id") % 2 == 0, F.col("sample_id")).otherwise("")
    )
    joined = rv.attach_predictions(samples, predictions, "doc_id")
    label = lambda t, n: an.task_label(F.col("predicted_task_annotations"), t).alias(n)
    return joined.select("doc_id", label(LOW, "predicted_low"), label(AI, "predicted_ai"))


@query("reviewed_record", f"""WITH {CLEAN}
SELECT {SAMPLE_ID} AS sample_id, q AS question, p AS answer_preview, a AS full_context, platform, url FROM c1 WHERE length(a) >= 20""")
def reviewed_record(spark, sf):
    from ..operators.cleaning import clean_answers

    return rv.reviewed_record(clean_answers(raw_answers(spark, sf))).select(
        "sample_id", "question", "answer_preview", "full_context", "platform", "url"
    )


def samples_and_labels(spark, sf):
    as_id = F.col("doc_id").cast("string").alias("sample_id")
    return table(spark, sf, "documents").select("doc_id", as_id), table(spark, sf, "labels").select(as_id)


@query("pending_samples", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_samples(spark, sf):
    return dd.pending_samples(*samples_and_labels(spark, sf)).select("doc_id")


@query("review_progress", """SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM labels) AS labeled,
  (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS remaining,
  (SELECT count(*) FROM labels)::DOUBLE / (SELECT count(*) FROM documents)::DOUBLE * 100.0::DOUBLE AS percent""")
def review_progress(spark, sf):
    return rv.review_progress(*samples_and_labels(spark, sf))
