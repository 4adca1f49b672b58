"""Adapters from stored tables to the record schemas."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed_values as fv
from ..functions.annotations import annotation
from ..functions.text import truncate_legacy
from ..session import SPREAD


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def wide_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table for work that is heavy per row.

    A file of one row group is one task, whatever the split size. A session on one machine may name in SPREAD into how many
    tasks such a table is dealt, so that all cores work; without the setting, as on a cluster, it is read as it lies.
    """
    df, tasks = table(spark, folder, name), spark.conf.get(SPREAD, None)
    return df.repartition(int(tasks)) if tasks else df


def answers_from_documents(documents: DataFrame) -> DataFrame:
    """Documents as raw answers: the first line is the question, the source the author."""
    return documents.select(
        "doc_id",
        F.substring_index("text", "\n", 1).alias("question"),
        F.lit("").alias("question_detail"),
        F.col("text").alias("answer_full"),
        F.lit(None).cast("string").alias("answer"),
        truncate_legacy(F.col("text")).alias("answer_truncated"),
        F.col("source").alias("author"),
        F.col("n_chars").alias("votes"),
        F.lit(0).cast("bigint").alias("comment_count"),
        F.lit(fv.DEFAULT_PLATFORM).alias("platform"),
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"),
        F.lit("").alias("collected_at"),
    )


def questions_and_answers(conversations: DataFrame) -> DataFrame:
    """A user turn and the next turn of its conversation, if an assistant gave it.

    The next turn is found by joining on (conversation, turn + 1), so a long conversation is no single task.
    """
    asked = conversations.filter("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question")
    )
    answered = conversations.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer_full"))
    return asked.join(answered, ["conv_id", "turn"]).select(
        "conv_id", (F.col("turn") - 1).alias("turn"), "question", "answer_full"
    )


def gold_annotations(labels: DataFrame) -> DataFrame:
    """Labels as task annotations: quality 0 is low quality, toxic 1 is the second task."""
    low, ai = F.col("quality") == 0, F.col("toxic") == 1
    reason = lambda t, c: F.when(c, F.lit(next(x["reason_options"][0] for x in fv.TASKS if x["task_id"] == t))).otherwise("")
    one = lambda t, c: annotation(c, reason(t, c), F.lit("labels"), F.lit("human"), F.lit(1.0))
    return labels.select(
        "doc_id",
        F.col("doc_id").cast("string").alias("sample_id"),
        F.create_map(
            F.lit(fv.LOW_QUALITY), one(fv.LOW_QUALITY, low), F.lit(fv.AI_GENERATED), one(fv.AI_GENERATED, ai)
        ).alias("task_annotations"),
    )
