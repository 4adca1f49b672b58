"""Session defaults and the shared scratch folder."""

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


# A setting of this library: into how many tasks a table for heavy work is dealt, on one machine.
SPREAD = "spark.winnowry.spread"
# Rows of a batch between Spark and Python, where a step is run here.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 512


def local_session(cores="*", shuffle_partitions=8, memory="12g"):
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("winnowry")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config(SPREAD, str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder the cluster names in spark.checkpoint.dir.

    Only where that setting is absent on a single machine, as in tests, is a temporary folder used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="winnowry-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def rename_path(spark: SparkSession, old: str, new: str) -> None:
    at, to = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (old, new))
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if to.getParent() is not None:
        files.mkdirs(to.getParent())
    if not files.rename(at, to):
        raise OSError(f"{old} could not become {new}")


def send_if_small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """A settings-like table, sent to all tasks if it has at most ``rows`` rows; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Have what runs inside exchange at most BATCH_ROWS rows at a time with Python.

    A batch of Spark's 10,000 texts is held several times: by the JVM beside its heap, and by each worker on both ways.
    """
    own = spark.conf.get(BATCH)
    if 0 < int(own) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(BATCH, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH, own)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
