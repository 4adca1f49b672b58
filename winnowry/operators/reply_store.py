"""Replies of a model, stored by the digest of the prompt, so that no prompt is asked twice.

A store is a folder of Parquet tables, one for each model. What a table of prompts lacks is asked for, each distinct
prompt once, and added to the store before anything else uses it; two actions on the result, a run again and
another table with the same prompts read the store. If a run breaks off, the prompts of it are asked again, as the store
gets the replies of a run all together. A failed prompt keeps its error, unless ``retry_failed`` asks for it again.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import path_exists
from .labeling import REPLY, model_replies

STORED = "digest string, reply string, error string"


def folder_of(store: str, model: str) -> str:
    # Model names hold characters that paths don't; the digest tells names apart that look alike then.
    import hashlib
    import re

    return f"{store.rstrip('/')}/{re.sub('[^A-Za-z0-9._-]+', '-', model)}-{hashlib.sha1(model.encode()).hexdigest()[:12]}"


def stored_replies(spark: SparkSession, store: str, model: str) -> DataFrame:
    """(digest, reply, error) of every prompt the model was asked; a reply goes before an error."""
    folder = folder_of(store, model)
    if not path_exists(spark, folder):
        return spark.createDataFrame([], STORED)
    rows = spark.read.schema(STORED).parquet(folder)
    best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "reply", "error"))
    return rows.groupBy("digest").agg(best.alias("b")).select("digest", "b.reply", "b.error")


def with_stored_replies(
    df: DataFrame, prompt: Column, predict_fn, model: str, store: str, name: str = "reply", retry_failed: bool = False
) -> DataFrame:
    """Adds a column (reply, error) for the prompt; what the store lacks is asked for now. A null prompt has neither."""
    spark = df.sparkSession
    asked = df.withColumn("_asked", prompt).withColumn("_digest", F.sha2("_asked", 256))
    known = stored_replies(spark, store, model)
    done = known.filter("error is null") if retry_failed else known
    distinct = asked.filter("_digest is not null").groupBy("_digest").agg(F.first("_asked").alias("_asked"))
    new = distinct.join(done.select(F.col("digest").alias("_digest")), "_digest", "left_anti")
    answered = new.select(F.col("_digest").alias("digest"), model_replies(F.col("_asked"), predict_fn).alias("r"))
    answered.select("digest", "r.reply", "r.error").write.mode("append").parquet(folder_of(store, model))
    replies = stored_replies(spark, store, model).select(F.col("digest").alias("_digest"), F.struct("reply", "error").cast(REPLY).alias(name))
    return asked.join(replies, "_digest", "left").drop("_asked", "_digest")
