"""Task annotations and task results as structs and maps."""

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv, schemas
from .numeric import round2


def annotation(label: Column, reason=None, annotator=None, source=None, confidence=None) -> Column:
    status = (
        F.when(label.isNull(), F.lit("unlabeled"))
        .when(label, F.lit("labeled_positive"))
        .otherwise(F.lit("labeled_negative"))
    )
    return F.struct(
        label.cast("boolean").alias("label"),
        status.alias("status"),
        (F.lit("") if reason is None else reason).alias("reason"),
        (F.lit("") if annotator is None else annotator).alias("annotator"),
        (F.lit("human") if source is None else source).alias("source"),
        (F.lit(None) if confidence is None else confidence).cast("double").alias("confidence"),
    ).cast(schemas.ANNOTATION)


def task_map(value_of, task_ids=None) -> Column:
    """Map of every task id to ``value_of(task_id)``."""
    task_ids = fv.TASK_IDS if task_ids is None else task_ids
    return F.create_map(*[x for t in task_ids for x in (F.lit(t), value_of(t))])


def empty_annotations(task_ids=None) -> Column:
    null = F.lit(None).cast("boolean")
    return task_map(lambda _: annotation(null, source=F.lit("pending")), task_ids)


def empty_results(task_ids=None) -> Column:
    return task_map(lambda _: result(F.lit(None), F.lit(0.0), F.lit("")), task_ids)


def result(label: Column, confidence: Column, reason: Column) -> Column:
    return F.struct(
        label.cast("boolean").alias("label"),
        F.coalesce(confidence.cast("double"), F.lit(0.0)).alias("confidence"),
        F.coalesce(reason, F.lit("")).alias("reason"),
    ).cast(schemas.PREDICTION)


def failed_annotations(error: Column, task_ids=None) -> Column:
    null = F.lit(None).cast("boolean")
    reason = F.concat(F.lit(fv.FAILED_PREFIX), F.substring(F.coalesce(error, F.lit("")), 1, 30))
    return task_map(
        lambda _: annotation(null, reason, F.lit("system"), F.lit("auto"), F.lit(0.0)), task_ids
    )


def task_entry(annotations: Column, task_id: str) -> Column:
    return F.try_element_at(annotations, F.lit(task_id))


def task_label(annotations: Column, task_id: str) -> Column:
    return task_entry(annotations, task_id)["label"]


def primary_label(annotations: Column) -> Column:
    positive = lambda t: task_label(annotations, t).eqNullSafe(F.lit(True))
    return (
        F.when(positive(fv.AI_GENERATED), F.lit("ai_generated"))
        .when(positive(fv.LOW_QUALITY), F.lit("low_quality"))
        .otherwise(F.lit("genuine"))
    )


def primary_reason(results: Column, task_ids=None) -> Column:
    parts = []
    for t in fv.TASK_IDS if task_ids is None else task_ids:
        entry = task_entry(results, t)
        parts.append(F.when(entry["label"] & (entry["reason"] != ""), F.concat(F.lit(f"{t}: "), entry["reason"])))
    joined = F.array_join(F.array_compact(F.array(*parts)), " | ")
    return F.when(joined == "", F.lit(fv.NORMAL_REASON)).otherwise(joined)


def primary_confidence(results: Column, task_ids=None) -> Column:
    ids = fv.TASK_IDS if task_ids is None else task_ids
    return round2(F.greatest(*[F.coalesce(task_entry(results, t)["confidence"], F.lit(0.0)) for t in ids], F.lit(0.0)))


def should_review(annotations: Column, threshold: float = fv.REVIEW_THRESHOLD) -> Column:
    return F.exists(
        F.map_values(annotations),
        lambda a: a["label"].isNull() | (F.coalesce(a["confidence"], F.lit(0.0)) < threshold),
    )


def can_accept_prediction(entry: Column) -> Column:
    return entry["label"].isNotNull()


def format_prediction(entry: Column) -> Column:
    label = F.when(entry["label"].isNull(), "不确定").when(entry["label"], "是").otherwise("否")
    confidence = F.when(
        entry["confidence"].isNotNull(), F.format_string("%.2f", round2(entry["confidence"]))
    ).otherwise("-")
    reason = F.coalesce(F.nullif(entry["reason"], F.lit("")), F.lit("-"))
    line = F.concat(
        F.lit("预标建议: "), label, F.lit(" | confidence="), confidence, F.lit(" | reason="), reason
    )
    return F.when(entry.isNotNull(), line)
