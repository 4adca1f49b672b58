"""Helpers shared by the operators of this subpackage."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BLOCK = 256
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# White space in the sense of the contracts: \x20 and \x09-\x0D.
WORD_SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def packed(df: DataFrame, **own: Column) -> DataFrame:
    """The frame as one column ``_row`` beside columns of our own, so that none of its names can clash with them.

    ``select("_row.*")`` gives it back.
    """
    return df.select(F.struct(*df.columns).alias("_row"), *[c.alias(n) for n, c in own.items()])


def few_tasks(df: DataFrame, rows: int, a_task: int = 50_000) -> DataFrame:
    """A table of about ``rows`` rows in no more tasks than they need, at least one for each core.

    For tables that may be far smaller than the number of shuffle partitions; a large one keeps that number.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // a_task)))


def forget(*frames: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` stored and nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path
        scratch = path(spark.conf.get("spark.checkpoint.dir", "/nowhere")).toUri().getPath()
        for folder in map(path, {f.rpartition("/")[0] for f in df.inputFiles()}):
            if not folder.toUri().getPath().startswith(f"{scratch.rstrip('/')}/"):
                raise ValueError("only stored steps may be deleted")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def whole(text: Column) -> Column:
    """A text; null counts as empty."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def split_words(text: Column) -> Column:
    """The words between white space: an empty array if there are none."""
    # \\z is the very end; $ also stands before a final line end, of which Unicode has more.
    trimmed = F.regexp_replace(text, f"^{WORD_SPACE}|{WORD_SPACE}\\z", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_SPACE))


def cumulative(lengths: Column) -> Column:
    """Running totals of an array of numbers.

    Works in blocks, so an array of n numbers costs n times a constant rather than n squared.
    """
    n = F.size(lengths)
    blocks = F.transform(
        F.sequence(F.lit(0), F.ceil((n - 1) / BLOCK).cast("int")),
        lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)),
    )

    def running(values, start):
        zero = F.struct(start.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda a, x: F.struct(
            (a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"] + x)).alias("out")
        )
        return F.aggregate(values, zero, step, lambda a: a["out"])

    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a + x))
    before = F.concat(F.array(F.lit(0).cast("bigint")), running(totals, F.lit(0)))
    joined = F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), running))
    return F.when(n > 0, joined).otherwise(F.array().cast("array<bigint>"))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches as (start, end, found, part): code points, end exclusive.

    ``part`` is the given group. The pattern must not match the empty string. Texts without a match
    cost one search.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    ends = cumulative(F.zip_with(between, found, lambda b, m: (F.length(b) + F.length(m)).cast("bigint")))
    one = F.zip_with(
        F.arrays_zip(ends.alias("e"), found.alias("m")), parts,
        lambda x, p: F.struct(
            (x["e"] - F.length(x["m"])).alias("start"), x["e"].alias("end"), x["m"].alias("found"), p.alias("part")
        ),
    )
    kind = "array<struct<start:bigint,end:bigint,found:string,part:string>>"
    return F.when(text.rlike(pattern), one.cast(kind)).otherwise(F.array().cast(kind))


def span_text(spans: Column) -> Column:
    """Spans of (start, rank, kind, end), sorted, as kind:start:end joined by commas."""
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def rows_of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
