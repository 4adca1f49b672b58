"""Incremental ingest, scoring and counting."""

from pyspark.sql import DataFrame, functions as F

from ..operators.dedup import KEY_CHARS, dedup_key, dedup_new
from ..operators.labeling import label_stats
from ..session import materialize, path_exists
from .key_index import KeyIndex


def dedup_within(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """Records whose key was not seen within ``delay``: bounded state, keys older than that are forgotten."""
    timed = stream.withColumn("_time", F.col(time).cast("timestamp")).withColumn("_key", dedup_key(stream))
    return timed.withWatermark("_time", delay).dropDuplicatesWithinWatermark(["_key"]).drop("_time", "_key")


def stored_records(spark, store: str, schema) -> DataFrame:
    """What the store holds; nothing if it does not exist yet."""
    return spark.read.schema(schema).parquet(store) if path_exists(spark, store) else spark.createDataFrame([], schema)


def query_name(spark) -> str:
    """A name of the running streaming query that it keeps when it starts again from its checkpoint."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId").replace("-", "")


def ingest_exact(stream: DataFrame, store: str, checkpoint: str, order: str, prefix_chars: int | None = KEY_CHARS):
    """Append records whose key is in no earlier record: each batch is reduced to its first record per key
    and anti-joined with the stored keys.

    The store keeps an index of the digests of all keys, of which a batch opens only the buckets that may hold one of its
    own. A batch writes a folder and a part of the index that are named by its query and number: if it
    runs again, it replaces what it wrote before, and nothing of another stream or batch.
    """
    digest = "dedup_digest"

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = query_name(spark)
        index = KeyIndex(spark, store)
        first = dedup_new(batch, order, prefix_chars)
        first = materialize(first.withColumn(digest, F.sha1(dedup_key(first, prefix_chars))), "ingest-first")
        earlier = index.known(first.select(F.col(digest).alias("digest")), f"{own}-{batch_id}").withColumnRenamed("digest", digest)
        path = f"{store}/stream=s{own}/batch={batch_id}"
        first.join(earlier, digest, "left_anti").write.mode("overwrite").parquet(path)
        index.add(spark.read.schema(f"{digest} string").parquet(path).select(F.col(digest).alias("digest")), f"{own}-{batch_id}")
        index.merge()

    return (
        stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def ingest_append(stream: DataFrame, store: str, checkpoint: str, fmt: str = "parquet"):
    """Append-only sink for a stream that is already free of repeats."""
    return (
        stream.writeStream.outputMode("append").format(fmt).option("path", store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_score(
    posts: DataFrame, score, key: str = "post_id", time: str | None = None, delay: str | None = None, keep_all_keys: bool = False
) -> DataFrame:
    """Score each unseen post once: repeats out, then any stateless ``score(DataFrame) -> DataFrame``.

    With an event time the state is bounded by ``delay``: later records are dropped. Without one every key is kept
    for ever, which must be asked for.
    """
    if (time is None) != (delay is None):
        raise ValueError("an event time and its delay come together")
    if time is None and not keep_all_keys:
        raise ValueError("give an event time and a delay, or keep_all_keys")
    if time is None:
        fresh = posts.dropDuplicates([key])
    else:
        timed = posts.withColumn("_time", F.col(time).cast("timestamp"))
        fresh = timed.withWatermark("_time", delay).dropDuplicatesWithinWatermark([key]).drop("_time")
    return score(fresh)


def stream_label_stats(stream: DataFrame, field: str) -> DataFrame:
    """Running positive, negative and unknown counts per task, for update mode."""
    return label_stats(stream, field)
