"""Annotation, validation and label-run queries."""

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import annotations as an
from ..operators import evaluation as ev, labeling as lb, review as rv, training as tr, validation as va
from ..sources.tables import gold_annotations, table
from .registry import AI_REASON, GOLD, LOW_REASON, query, round2

LOW, AI = fv.LOW_QUALITY, fv.AI_GENERATED


def gold(spark, sf):
    return gold_annotations(table(spark, sf, "labels"))


def flat(column, task, *fields):
    short = "low" if task == LOW else "ai"
    return [an.task_entry(F.col(column), task)[f].alias(f"{short}_{f}") for f in fields]


@query("empty_annotations", f"""SELECT doc_id, CAST(NULL AS BOOLEAN) AS low_label, 'unlabeled' AS low_status,
  'pending' AS low_source, '' AS ai_reason, '' AS ai_annotator, CAST(NULL AS DOUBLE) AS ai_confidence FROM documents""")
def empty_annotations(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", an.empty_annotations().alias("a"))
    return docs.select(
        "doc_id", *flat("a", LOW, "label", "status", "source"), *flat("a", AI, "reason", "annotator", "confidence")
    )


@query("annotation", f"""WITH {GOLD}
SELECT doc_id, low AS low_label, CASE WHEN low THEN 'labeled_positive' ELSE 'labeled_negative' END AS low_status,
  low_reason, 'labels' AS ai_annotator, 'human' AS ai_source, 1.0::DOUBLE AS ai_confidence FROM gold""")
def annotation(spark, sf):
    return gold(spark, sf).select(
        "doc_id", *flat("task_annotations", LOW, "label", "status", "reason"),
        *flat("task_annotations", AI, "annotator", "source", "confidence"),
    )


@query("primary_label", f"""WITH {GOLD}
SELECT doc_id, CASE WHEN ai THEN 'ai_generated' WHEN low THEN 'low_quality' ELSE 'genuine' END AS primary_label FROM gold""")
def primary_label(spark, sf):
    return gold(spark, sf).select("doc_id", an.primary_label(F.col("task_annotations")).alias("primary_label"))


@query("primary_reason", f"""WITH {GOLD}
SELECT doc_id, CASE WHEN low AND ai THEN '{LOW}: ' || low_reason || ' | {AI}: ' || ai_reason
  WHEN low THEN '{LOW}: ' || low_reason WHEN ai THEN '{AI}: ' || ai_reason ELSE '{fv.NORMAL_REASON}' END AS reason FROM gold""")
def primary_reason(spark, sf):
    return gold(spark, sf).select("doc_id", an.primary_reason(F.col("task_annotations")).alias("reason"))


@query("primary_confidence", f"""SELECT event_id, {round2('greatest(value / 500.0::DOUBLE, 1.0::DOUBLE - value / 500.0::DOUBLE)')} AS confidence FROM events""")
def primary_confidence(spark, sf):
    share = F.col("value") / F.lit(500.0)
    yes, text = F.lit(True), F.lit("")
    results = F.create_map(
        F.lit(LOW), an.result(yes, share, text), F.lit(AI), an.result(yes, F.lit(1.0) - share, text)
    )
    return table(spark, sf, "events").select("event_id", an.primary_confidence(results).alias("confidence"))


@query("task_label", f"WITH {GOLD} SELECT doc_id, low AS low_label, ai AS ai_label, CAST(NULL AS BOOLEAN) AS other_label FROM gold")
def task_label(spark, sf):
    label = lambda t, n: an.task_label(F.col("task_annotations"), t).alias(n)
    return gold(spark, sf).select("doc_id", label(LOW, "low_label"), label(AI, "ai_label"), label("other", "other_label"))


# Model annotations of documents made from their length: some unsure, some without a label.
MODEL = f"""model AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS sample_id, CASE n_chars % 5 WHEN 0 THEN NULL ELSE n_chars % 3 = 0 END AS low,
    CASE n_chars % 7 WHEN 0 THEN NULL ELSE n_chars % 4 = 0 END AS ai,
    (n_chars % 101) / 100.0::DOUBLE AS low_conf, (n_chars % 97) / 96.0::DOUBLE AS ai_conf FROM documents)"""


def model_annotations(spark, sf):
    return annotate(table(spark, sf, "documents"))


def annotate(documents):
    n, text = F.col("n_chars"), lambda s: F.lit(s)
    low = F.when(n % 5 != 0, n % 3 == 0)
    ai = F.when(n % 7 != 0, n % 4 == 0)
    one = lambda t, label, conf: an.annotation(
        label, F.when(label, text(LOW_REASON if t == LOW else AI_REASON)).otherwise(""), text("m"), text("auto"), conf
    )
    return documents.select(
        "doc_id", F.col("doc_id").cast("string").alias("sample_id"),
        F.create_map(
            text(LOW), one(LOW, low, (n % 101) / F.lit(100.0)), text(AI), one(AI, ai, (n % 97) / F.lit(96.0))
        ).alias("predicted_task_annotations"),
    )


@query("should_review", f"""WITH {MODEL}
SELECT doc_id, (low IS NULL OR low_conf < 0.8::DOUBLE OR ai IS NULL OR ai_conf < 0.8::DOUBLE) AS need_review FROM model""")
def should_review(spark, sf):
    return model_annotations(spark, sf).select(
        "doc_id", an.should_review(F.col("predicted_task_annotations")).alias("need_review")
    )


@query("can_accept_prediction", f"WITH {MODEL} SELECT doc_id, low IS NOT NULL AS low_ok, ai IS NOT NULL AS ai_ok FROM model")
def can_accept_prediction(spark, sf):
    ok = lambda t, n: an.can_accept_prediction(an.task_entry(F.col("predicted_task_annotations"), t)).alias(n)
    return model_annotations(spark, sf).select("doc_id", ok(LOW, "low_ok"), ok(AI, "ai_ok"))


@query("format_prediction", f"""WITH {MODEL}
SELECT doc_id, '预标建议: ' || CASE WHEN low IS NULL THEN '不确定' WHEN low THEN '是' ELSE '否' END || ' | confidence=' ||
  printf('%.2f', low_conf) || ' | reason=' || CASE WHEN low THEN '{LOW_REASON}' ELSE '-' END AS line FROM model""")
def format_prediction(spark, sf):
    entry = an.task_entry(F.col("predicted_task_annotations"), LOW)
    return model_annotations(spark, sf).select("doc_id", an.format_prediction(entry).alias("line"))


@query("attach_auto_labels", f"""WITH {MODEL}
SELECT doc_id, low AS low_label, ai AS ai_label, low AS predicted_low_label,
  (low IS NULL OR low_conf < 0.8::DOUBLE OR ai IS NULL OR ai_conf < 0.8::DOUBLE) AS need_review,
  'local' AS provider, 'hybrid' AS output_format, 0.8::DOUBLE AS review_threshold FROM model""")
def attach_auto_labels(spark, sf):
    labeled = lb.attach_auto_labels(
        model_annotations(spark, sf), "predicted_task_annotations", "hybrid", "local", "m", "2024-01-01T00:00:00"
    )
    return labeled.select(
        "doc_id", *flat("task_annotations", LOW, "label"), *flat("task_annotations", AI, "label"),
        an.task_label(F.col("predicted_task_annotations"), LOW).alias("predicted_low_label"), "need_review",
        "auto_label_meta.provider", "auto_label_meta.output_format", "auto_label_meta.review_threshold",
    )


@query("failed_annotations", """SELECT event_id, '预标失败: ' || substring(props || event_type || ' no answer from the model', 1, 30) AS low_reason,
  'system' AS low_annotator, 0.0::DOUBLE AS low_confidence FROM events""")
def failed_annotations(spark, sf):
    error = F.concat(F.col("props"), F.col("event_type"), F.lit(" no answer from the model"))
    failed = table(spark, sf, "events").select("event_id", an.failed_annotations(error).alias("a"))
    return failed.select("event_id", *flat("a", LOW, "reason", "annotator", "confidence"))


@query("label_stats", f"""WITH {MODEL}, l AS (
  SELECT '{LOW}' AS task_id, low AS label FROM model UNION ALL SELECT '{AI}', ai FROM model)
SELECT task_id, count(*) FILTER (WHERE label) AS positive, count(*) FILTER (WHERE NOT label) AS negative,
  count(*) FILTER (WHERE label IS NULL) AS unknown FROM l GROUP BY 1""")
def label_stats(spark, sf):
    return lb.label_stats(model_annotations(spark, sf), "predicted_task_annotations")


EVAL = f"""{MODEL}, {GOLD}, pairs AS (
  SELECT '{LOW}' AS task_id, g.low AS gold, m.low AS pred, m.low_conf AS seconds, doc_id FROM gold g JOIN model m USING (doc_id)
  UNION ALL SELECT '{AI}', g.ai, m.ai, m.ai_conf, doc_id FROM gold g JOIN model m USING (doc_id)),
counts AS (SELECT task_id, count(*) AS rows, count(*) FILTER (WHERE pred AND gold) AS tp,
  count(*) FILTER (WHERE NOT pred AND NOT gold) AS tn, count(*) FILTER (WHERE pred AND NOT gold) AS fp,
  count(*) FILTER (WHERE NOT pred AND gold) AS fn, count(*) FILTER (WHERE pred IS NULL) AS unknown,
  count(*) FILTER (WHERE gold) AS gold_positive, count(*) FILTER (WHERE NOT gold) AS gold_negative,
  count(*) FILTER (WHERE pred) AS pred_positive, count(*) FILTER (WHERE NOT pred) AS pred_negative
  FROM pairs GROUP BY 1)"""


def evaluation_pairs(spark, sf):
    both = gold(spark, sf).join(model_annotations(spark, sf).drop("sample_id"), "doc_id")
    # Two entries per row, one for each task.
    pair = lambda t: F.struct(
        F.lit(t).alias("task_id"),
        an.task_label(F.col("task_annotations"), t).alias("gold"),
        an.task_label(F.col("predicted_task_annotations"), t).alias("pred"),
        an.task_entry(F.col("predicted_task_annotations"), t)["confidence"].alias("confidence"),
        an.task_entry(F.col("predicted_task_annotations"), t)["reason"].alias("reason"),
    )
    return both.select("doc_id", "sample_id", F.inline(F.array(pair(LOW), pair(AI))))


@query("confusion", f"WITH {EVAL} SELECT * FROM counts")
def confusion(spark, sf):
    return ev.confusion(evaluation_pairs(spark, sf), "task_id")


def _ratio(a, b):
    return f"CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b})::DOUBLE END"


@query("confusion_metrics", f"""WITH {EVAL}, m AS (SELECT task_id, rows, {_ratio('tp + tn', 'tp + tn + fp + fn')} AS accuracy,
  {_ratio('tp', 'tp + fp')} AS precision, {_ratio('tp', 'tp + fn')} AS recall,
  {_ratio('tp + tn + fp + fn', 'rows')} AS coverage FROM counts)
SELECT *, {_ratio('precision * 2.0::DOUBLE * recall', 'precision + recall')} AS f1 FROM m""")
def confusion_metrics(spark, sf):
    metrics = ev.eval_metrics(ev.confusion(evaluation_pairs(spark, sf), "task_id"))
    return metrics.select("task_id", "rows", "accuracy", "precision", "recall", "coverage", "f1")


@query("mean_latency", f"""WITH {MODEL} SELECT CAST(sum(n) AS BIGINT)::DOUBLE / count(*)::DOUBLE AS avg_time_per_item
FROM (SELECT CAST(round(low_conf * 100) AS BIGINT) AS n FROM model)""")
def mean_latency(spark, sf):
    timed = model_annotations(spark, sf).select(
        F.round(an.task_entry(F.col("predicted_task_annotations"), LOW)["confidence"] * 100).alias("process_time")
    )
    return ev.mean_latency(timed)


@query("show_samples", f"""WITH {EVAL} SELECT CAST(p.doc_id AS VARCHAR) AS sample_id, gold, pred, seconds AS confidence,
  CASE WHEN pred THEN '{LOW_REASON}' ELSE '' END AS reason, substring(text, 1, 180) AS text
FROM pairs p JOIN documents d USING (doc_id) WHERE task_id = '{LOW}' ORDER BY p.doc_id LIMIT 5""")
def show_samples(spark, sf):
    pairs = evaluation_pairs(spark, sf).filter(F.col("task_id") == LOW)
    return ev.show_samples(pairs.join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id"), "doc_id")


@query("class_counts", f"WITH {GOLD} SELECT low AS task_label, count(*) AS rows FROM gold GROUP BY 1")
def class_counts(spark, sf):
    return tr.class_counts(tr.task_dataset(gold(spark, sf).withColumn("text", F.col("sample_id")), LOW))


@query("labeled_for_task", f"WITH {MODEL} SELECT doc_id FROM model WHERE ai IS NOT NULL")
def labeled_for_task(spark, sf):
    return tr.labeled_for_task(model_annotations(spark, sf), AI, "predicted_task_annotations").select("doc_id")


@query("annotation_violations", f"""WITH s AS (
  SELECT doc_id, n_chars % 6 AS k, n_chars % 3 = 0 AS label FROM documents),
a AS (SELECT doc_id, label, CASE WHEN k = 1 THEN 'labeled_positive' WHEN label THEN 'labeled_positive' ELSE 'labeled_negative' END AS status,
  CASE WHEN k = 2 THEN 'robot' ELSE 'auto' END AS source, CASE WHEN k = 3 THEN '' WHEN k = 4 THEN 'none of these' WHEN label THEN '{LOW_REASON}' ELSE '' END AS reason,
  CASE WHEN k = 5 THEN 1.5 ELSE 0.5 END AS confidence FROM s),
v AS (SELECT doc_id, concat_ws(',', CASE WHEN status <> CASE WHEN label THEN 'labeled_positive' ELSE 'labeled_negative' END THEN 'status_mismatch' END,
  CASE WHEN source = 'robot' THEN 'unknown_source' END, CASE WHEN confidence > 1 THEN 'confidence_range' END,
  CASE WHEN label AND reason = '' THEN 'positive_without_reason' END, CASE WHEN reason = 'none of these' THEN 'unknown_reason' END) AS violations FROM a)
SELECT doc_id, '{LOW}' AS task_id, violations FROM v WHERE violations <> ''""")
def annotation_violations(spark, sf):
    k, label = F.col("n_chars") % 6, F.col("n_chars") % 3 == 0
    plain = an.annotation(
        label,
        F.when(k == 3, "").when(k == 4, "none of these").when(label, LOW_REASON).otherwise(""),
        F.lit("m"), F.when(k == 2, "robot").otherwise("auto"), F.when(k == 5, 1.5).otherwise(0.5),
    )
    entry = F.when(k == 1, plain.withField("status", F.lit("labeled_positive"))).otherwise(plain)
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("sample_id"), F.create_map(F.lit(LOW), entry).alias("task_annotations")
    )
    return va.validate_annotations(docs).select(
        F.col("sample_id").alias("doc_id"), "task_id", F.array_join("violations", ",").alias("violations")
    )


@query("compare_runs", f"""WITH {MODEL}, {GOLD}, b AS (
  SELECT '{LOW}' AS task_id, m.low AS f, g.low AS s, g.doc_id AS has FROM model m FULL JOIN gold g USING (doc_id)
  UNION ALL SELECT '{AI}', m.ai, g.ai, g.doc_id FROM model m FULL JOIN gold g USING (doc_id))
SELECT task_id, CASE WHEN f IS NULL THEN 'unknown' WHEN f THEN 'positive' ELSE 'negative' END AS first_label,
  CASE WHEN has IS NULL THEN 'absent' WHEN s THEN 'positive' ELSE 'negative' END AS second_label, count(*) AS samples
FROM b GROUP BY 1, 2, 3""")
def compare_runs(spark, sf):
    second = gold(spark, sf).withColumnRenamed("task_annotations", "predicted_task_annotations")
    return rv.compare_label_runs(model_annotations(spark, sf), second, "predicted_task_annotations", "doc_id")
