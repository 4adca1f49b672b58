"""Human review: decision log to annotations, undo, progress."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as fv
from ..functions.annotations import annotation, can_accept_prediction
from ..session import materialize
from .dedup import latest_by_key

CHUNK = 65536


def attach_predictions(samples: DataFrame, predictions: DataFrame, order: str) -> DataFrame:
    """Latest prediction of every sample, where there is one."""
    latest = latest_by_key(predictions, "sample_id", order).select("sample_id", "predicted_task_annotations")
    return samples.join(latest, "sample_id", "left")


def _reason_of(task_id: Column, number: Column, tasks) -> Column:
    """Reason option by its number, counted from 1. Number 0 and unknown numbers give no reason."""
    found = F.lit("")
    for task in tasks:
        options = F.array(*[F.lit(r) for r in task["reason_options"]])
        named = F.when(number.between(1, len(task["reason_options"])), F.try_element_at(options, number))
        found = F.when(task_id == task["task_id"], F.coalesce(named, F.lit(""))).otherwise(found)
    return found


def decide_annotations(decisions: DataFrame, predictions: DataFrame, order: str, tasks=fv.TASKS) -> DataFrame:
    """Every decision with its annotation and whether it is valid.

    a: accept the prediction (only if it has a label); y, n: own label; s: no label.
    """
    d = attach_predictions(decisions, predictions, order)
    d = d.withColumn("_predicted", F.try_element_at("predicted_task_annotations", F.col("task_id")))
    choice, entry = F.col("choice"), F.col("_predicted")
    accept = choice == "a"
    # A refused acceptance has no label either way, so the label needs no second test.
    label = F.when(accept, entry["label"]).when(choice == "y", True).when(choice == "n", False)
    reason = (
        F.when(accept, F.coalesce(entry["reason"], F.lit("")))
        .when(choice == "y", _reason_of(F.col("task_id"), F.col("reason_no"), tasks))
        .otherwise(F.lit(""))
    )
    source = F.when(accept, F.lit("human_reviewed_auto")).otherwise(F.lit("human"))
    confidence = F.when(choice.isin("a", "y", "n"), F.lit(1.0))
    valid = choice.isin("y", "n", "s") | (accept & can_accept_prediction(entry))
    return d.withColumns(
        {
            "valid": F.coalesce(valid, F.lit(False)),
            "annotation": annotation(label, reason, F.col("reviewer"), source, confidence),
        }
    ).drop("_predicted")


def apply_review_decisions(
    samples: DataFrame, predictions: DataFrame, decisions: DataFrame, sample_order: str, prediction_order: str,
    tasks=fv.TASKS,
) -> DataFrame:
    """Reviewed samples: one record per reviewed sample, its tasks' valid decisions as a map, of any task id.
    Of several decisions of one task in a ``seq`` the last counts; ``tasks`` names the reason options.

    Sample ids may repeat; the last sample of an id counts, so that no review is joined to many samples.
    """
    decided = decide_annotations(decisions, predictions, prediction_order, tasks).filter("valid")
    # One value per task, so a decision that was logged twice does no harm and a list has a row per task.
    at = F.col("decided_at") if "decided_at" in decisions.columns else F.lit(None).cast("timestamp")
    last = F.max_by("annotation", F.struct(at.isNotNull(), at, F.xxhash64("choice", "reason_no")))
    group = ["reviewer", "session", "seq", "sample_id"]
    # The prediction of a sample is the same in all its rows, and comes along from the join that judged them.
    predicted = F.first("predicted_task_annotations").alias("predicted_task_annotations")
    per_sample = (
        decided.filter("task_id is not null").groupBy(*group, "task_id").agg(last.alias("annotation"), predicted)
        .groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("task_id", "annotation"))).alias("task_annotations"), predicted)
    )
    unlabeled = latest_by_key(samples, "sample_id", sample_order).drop("task_annotations", "predicted_task_annotations")
    return reviewed_record(per_sample.join(unlabeled, "sample_id"), keep=["reviewer", "session", "seq"])


def reviewed_record(df: DataFrame, keep=()) -> DataFrame:
    """The stored record of a reviewed sample; absent fields are empty."""
    field = lambda *names: F.coalesce(
        *[F.col(n) for n in names if n in df.columns], F.lit("")
    )
    text = field("model_input", "content")
    predicted = [F.col("predicted_task_annotations")] if "predicted_task_annotations" in df.columns else []
    return df.select(
        *keep,
        "sample_id",
        text.alias("text"),
        text.alias("model_input"),
        field("question").alias("question"),
        field("answer_preview").alias("answer_preview"),
        field("answer_full_clean").alias("full_context"),
        field("platform").alias("platform"),
        field("url").alias("url"),
        "task_annotations",
        *predicted,
    )


def undo_last(log: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Decisions that survive the undo rows of their session.

    Every undo row cancels the last sample still standing; on an empty history it does nothing. All rows of
    one ``seq`` are one sample.

    A session may be long, so it is cut into chunks of ``seq``. With +1 for a sample and -1 for an undo, a
    chunk alone tells which of its samples outlive its own undo rows and at which height they lie, how far it
    digs into earlier chunks, and how many it leaves. One row per chunk then carries that across the session:
    a sample stands if no later chunk digs down to its height. Rows move once, by chunk, and are stored with their heights,
    as the chunks are summed up and then joined to them.
    """
    session = ["reviewer", "session"]
    piece = [*session, "_chunk"]
    undo = F.col("choice") == "undo"
    order = [c for c in ("seq", "task_id") if c in log.columns]
    inside = Window.partitionBy(*piece).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    # A frame that ends at the last row is evaluated anew for every row; in reverse order it only grows.
    backwards = Window.partitionBy(*piece).orderBy(*[F.desc(c) for c in order])
    from_here = backwards.rowsBetween(Window.unboundedPreceding, 0)
    repeated = F.lag("seq").over(inside).eqNullSafe(F.col("seq"))

    rows = (
        log.withColumn("_chunk", F.floor(F.col("seq") / chunk))
        .withColumn("_step", F.when(repeated, 0).when(undo, -1).otherwise(1))
        .withColumn("_sum", F.sum("_step").over(so_far))
        .withColumn("_low", F.least(F.lit(0), F.min("_sum").over(so_far)))
        .withColumn("_height", F.col("_sum") - F.col("_low"))
        .withColumn("_least", F.min("_height").over(from_here))
    )
    rows = materialize(rows, "undo-rows")
    across = Window.partitionBy(*session).orderBy("_chunk")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*session).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    floor = F.coalesce(F.min(F.col("_start") + F.col("_dig")).over(earlier), F.lit(0))
    chunks = (
        rows.groupBy(*piece)
        .agg(F.sum("_step").alias("_total"), F.min("_low").alias("_dig"))
        .withColumn("_start", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
        .withColumn("_floor", F.least(F.lit(0), floor))
        # The height at which the chunk's own samples begin is also the lowest it digs to.
        .withColumn("_bottom", F.greatest(F.lit(0), F.col("_start") + F.col("_dig") - F.col("_floor")))
        .withColumn("_dug", F.min("_bottom").over(later))
        .select(*[F.col(c).alias(f"_of_{c}") for c in piece], "_bottom", "_dug")
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in piece])
    standing = F.col("_dug").isNull() | (F.col("_bottom") + F.col("_height") <= F.col("_dug"))
    return (
        rows.filter(~undo & (F.col("_least") >= F.col("_height")))
        .join(chunks, same)
        .filter(standing)
        .select(*log.columns)
    )


def review_progress(samples: DataFrame, labeled: DataFrame) -> DataFrame:
    """Total, labeled records (repeats included), remaining samples and percent; 100 for no samples."""
    from .dedup import pending_samples

    counts = [
        samples.agg(F.count(F.lit(1)).alias("total")),
        labeled.agg(F.count(F.lit(1)).alias("labeled")),
        pending_samples(samples, labeled).agg(F.count(F.lit(1)).alias("remaining")),
    ]
    one_row = reduce(lambda a, b: a.join(b, "_one"), [c.withColumn("_one", F.lit(1)) for c in counts])
    share = F.col("labeled").cast("double") / F.greatest("total", F.lit(1)).cast("double") * 100.0
    return one_row.drop("_one").withColumn("percent", F.when(F.col("total") > 0, share).otherwise(F.lit(100.0)))


def long_labels(df: DataFrame, field: str, order: str) -> DataFrame:
    """One row per (sample, task), the last record of each."""
    # A record's list has one entry per task.
    one = df.select("sample_id", order, F.explode(field).alias("task_id", "annotation")).select(
        "sample_id", "task_id", F.struct(order, F.col("annotation.label").alias("label")).alias("v")
    )
    return one.groupBy("sample_id", "task_id").agg(F.max("v").alias("v")).select(
        "sample_id", "task_id", F.col("v.label").alias("label")
    )


def compare_label_runs(first: DataFrame, second: DataFrame, field: str, order: str) -> DataFrame:
    """How often each label turned into which, per task, over samples of either run."""
    word = lambda c: (
        F.when(c.isNull(), "unknown").when(c, "positive").otherwise("negative")
    )
    side = lambda df, name: (
        long_labels(df, field, order).select("sample_id", "task_id", word(F.col("label")).alias(name))
    )
    both = side(first, "first_label").join(side(second, "second_label"), ["sample_id", "task_id"], "full")
    return both.groupBy(
        "task_id",
        F.coalesce("first_label", F.lit("absent")).alias("first_label"),
        F.coalesce("second_label", F.lit("absent")).alias("second_label"),
    ).agg(F.count(F.lit(1)).alias("samples"))
