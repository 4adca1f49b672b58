"""Confusion counts, metrics and samples of evaluation rows (gold, pred)."""

from pyspark.sql import DataFrame, functions as F


def confusion(df: DataFrame, *keys: str, gold: str = "gold", pred: str = "pred") -> DataFrame:
    g, p = F.col(gold), F.col(pred)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(p & g).alias("tp"),
        F.count_if(~p & ~g).alias("tn"),
        F.count_if(p & ~g).alias("fp"),
        F.count_if(~p & g).alias("fn"),
        F.count_if(p.isNull()).alias("unknown"),
        F.count_if(g).alias("gold_positive"),
        F.count_if(~g).alias("gold_negative"),
        F.count_if(p).alias("pred_positive"),
        F.count_if(~p).alias("pred_negative"),
    )


def eval_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy over decided rows, precision, recall, F1 and coverage; 0 where there is nothing to divide by."""
    n = lambda c: F.col(c).cast("double")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    decided = n("tp") + n("tn") + n("fp") + n("fn")
    return (
        counts.withColumns(
            {
                "accuracy": ratio(n("tp") + n("tn"), decided),
                "precision": ratio(n("tp"), n("tp") + n("fp")),
                "recall": ratio(n("tp"), n("tp") + n("fn")),
                "coverage": ratio(decided, n("rows")),
            }
        )
        .withColumn("f1", ratio(F.col("precision") * 2.0 * F.col("recall"), F.col("precision") + F.col("recall")))
    )


def mean_latency(df: DataFrame, *keys: str, seconds: str = "process_time") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(seconds).alias("avg_time_per_item"))


def show_samples(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    return (
        df.orderBy(order).limit(n)
        .select(
            F.coalesce("sample_id", F.lit("")).alias("sample_id"), "gold", "pred", "confidence", "reason",
            F.substring("text", 1, 180).alias("text"),
        )
    )
