"""Keys, first and last records, anti joins and unions."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .ordering import first_per_key, last_per_key

# Characters of the answer that enter a key.
KEY_CHARS = 100


def answer_text(df: DataFrame) -> Column:
    """The answer, or the legacy column of the same meaning."""
    full = F.nullif(F.col("answer_full"), F.lit("")) if "answer_full" in df.columns else F.lit(None).cast("string")
    legacy = F.col("answer") if "answer" in df.columns else F.lit(None).cast("string")
    return F.coalesce(full, legacy, F.lit(""))


def dedup_key(df: DataFrame, prefix_chars: int | None = KEY_CHARS) -> Column:
    """The address and the first ``prefix_chars`` characters of the answer. With None it is a digest of the whole answer,
    so different answers with one opening have different keys."""
    answer = answer_text(df)
    part = F.sha2(answer, 256) if prefix_chars is None else F.substring(answer, 1, prefix_chars)
    return F.concat(F.coalesce(F.col("url"), F.lit("")), F.lit("|"), part)


def dedup_new(df: DataFrame, order: str, prefix_chars: int | None = KEY_CHARS) -> DataFrame:
    """The first record of every key within a batch."""
    return first_per_key(df.withColumn("_key", dedup_key(df, prefix_chars)), ["_key"], order).drop("_key")


def anti_existing(new: DataFrame, existing: DataFrame, prefix_chars: int | None = KEY_CHARS) -> DataFrame:
    """New records whose key is not stored yet. The stored side is reduced to its distinct keys, so a hot
    key is one row there, and Spark may split the other side of it."""
    stored = existing.select(dedup_key(existing, prefix_chars).alias("_key")).distinct()
    return new.withColumn("_key", dedup_key(new, prefix_chars)).join(stored, "_key", "left_anti").drop("_key")


def pending_samples(samples: DataFrame, labeled: DataFrame, key: str = "sample_id") -> DataFrame:
    """Samples without a label. A missing or empty id never counts as labeled."""
    done = labeled.select(key).filter(F.col(key) != "").distinct()
    return samples.join(done, key, "left_anti")


def latest_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of every key; records without a key are left out."""
    return last_per_key(df.filter(F.col(key).cast("string") != ""), [key], order)


def union_distinct(*frames: DataFrame) -> DataFrame:
    return union_all(*frames).dropDuplicates()


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
