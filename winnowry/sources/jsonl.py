"""JSON-lines readers and writers."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StructType

from .. import schemas
from ..operators.knn import default_examples, example_rows
from ..functions.embedding import embed_text


def read_jsonl(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST") -> DataFrame:
    """FAILFAST: a bad line is an error. DROPMALFORMED: bad lines are skipped."""
    return spark.read.schema(schema).option("mode", mode).json(path)


def read_jsonl_with_rejects(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good records and the text of bad lines, for a quarantine table."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(
        "value",
        F.from_json("value", schema + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"),
    )
    bad = F.col("r._corrupt_record").isNotNull() | F.col("r").isNull()
    return (
        parsed.filter(~bad).select("r.*").drop("_corrupt_record"),
        parsed.filter(bad).select(F.col("value").alias("line")),
    )


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Labeled examples from JSON arrays. A path that does not exist or a broken file gives no examples."""
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.EXAMPLES)
    # A file is one array; a broken one is null and gives no rows.
    found = F.from_json("value", ArrayType(StructType.fromDDL(schemas.EXAMPLES)))
    return files.select(F.inline(found))


def write_jsonl(df: DataFrame, path: str) -> None:
    """Replace a data set. Null fields are written, text stays readable."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per task and split."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("task_id", "split").json(path)


def path_part(c: Column) -> Column:
    """Characters outside A-Z a-z 0-9 . _ - become single dashes; an empty rest is "unknown"."""
    dashed = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-"), "-{2,}", "-")
    bare = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("unknown"))


def annotator_suffix(provider: Column, model: Column) -> Column:
    return F.concat(path_part(F.trim(provider)), F.lit("-"), path_part(F.trim(model)))


def build_example_base(spark: SparkSession, path: str, examples: DataFrame | None = None, order: str = "ordinal",
                       embed=embed_text) -> DataFrame:
    """Write the example base unless one is stored already, and read it."""
    examples = default_examples(spark) if examples is None else examples
    rows = example_rows(examples, order, embed)
    rows.write.mode("ignore").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
