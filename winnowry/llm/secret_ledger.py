"""Secret scans over a history of files, as an incremental ledger of blobs.

Every version of a file is named by the digest of its content. A blob is scanned once for each version of
each rule, whatever the number of paths and versions that hold it; the ledger remembers which pairs of blob
and rule version were scanned and what was found; findings are joined back to all paths.

Built-in functions only. A null text is an empty blob. Repeated rows and equal texts share one blob; null
paths are ordinary paths. An empty history gives no rows. Other columns of the history are kept by
``findings_by_path``.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize, scratch_path
from .common import matches, rows_of_kind, span_text, whole

SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint>"
LEDGER = f"blob string, scanned array<string>, spans array<{SPAN}>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least``: characters that the group must have."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# A run that is long enough is found by its own pattern where a shorter run can't hide a longer one.
BASE_RULES = (
    Rule("assign", 1, "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, "[0-9a-f]{24,}", 0, 24),
)
RULES = (*BASE_RULES, Rule("pem", 1, "-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"))


def blobs(history: DataFrame, text: str = "text") -> DataFrame:
    """The history with the digest of each text in place of the text."""
    return history.withColumn("blob", F.sha2(whole(F.col(text)), 256)).drop(text)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger; an empty one if nothing was stored yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def unseen(named: DataFrame, ledger: DataFrame, path: str, rules=RULES) -> DataFrame:
    """(blob, path, todo): blobs with rule versions that the ledger lacks, and one path that holds each.

    Narrow: neither side carries texts. Both sides are reduced to a row for each blob before they meet.
    """
    keys = F.array(*[F.lit(r.key) for r in rules])
    seen = ledger.select("blob", F.explode("scanned").alias("key")).groupBy("blob").agg(F.collect_set("key").alias("_seen"))
    held = named.groupBy("blob").agg(F.min(path).alias(path))
    none = F.array().cast("array<string>")
    return (
        held.join(seen, "blob", "left")
        .withColumn("todo", F.array_except(keys, F.coalesce("_seen", none)))
        .filter(F.size("todo") > 0)
        .select("blob", path, "todo")
    )


def scan(history: DataFrame, wanted: DataFrame, path: str, text: str = "text", rules=RULES) -> DataFrame:
    """New ledger rows: the wanted blobs, scanned by the rules that each lacks.

    A text travels once, and only if its row stands for an unseen blob; the join key is unique, so copies
    make no hot partition.
    """
    held = history.select(F.col(path).alias("_path"), whole(F.col(text)).alias("_text"))
    held = held.withColumn("_blob", F.sha2("_text", 256))
    due = wanted.select(F.col("blob"), F.col(path).alias("_at"), "todo")
    rows = held.join(due, (F.col("_blob") == F.col("blob")) & F.col("_path").eqNullSafe(F.col("_at")))

    def spans(rank: int, rule: Rule):
        found = F.filter(matches(F.col("_text"), rule.pattern, rule.group), lambda m: F.length(m["part"]) >= rule.least)
        made = F.transform(
            found,
            lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), m["end"].alias("end")),
        )
        return F.when(F.array_contains("todo", rule.key), made).otherwise(F.array().cast(f"array<{SPAN}>"))

    found = F.concat(*[spans(i, r) for i, r in enumerate(rules)])
    # One path may hold a blob in several rows.
    return (
        rows.select("blob", F.col("todo").alias("scanned"), found.alias("spans"))
        .groupBy("blob").agg(F.first("scanned").alias("scanned"), F.first("spans").alias("spans"))
    )


def update(history: DataFrame, ledger_path: str, path: str, text: str = "text", rules=RULES) -> DataFrame:
    """Scan what is new and append it to the ledger; returns the history's blobs, stored, for later joins."""
    spark = history.sparkSession
    named = materialize(blobs(history.select(path, text), text), "blobs")
    new = scan(history, unseen(named, read_ledger(spark, ledger_path), path, rules), path, text, rules)
    new.write.mode("append").parquet(ledger_path)
    return named


def findings_by_path(named: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """Every row of the history with all spans that the current rule versions found in its blob."""
    current = F.array(*[F.lit(r.key) for r in rules])
    per_rule = {r.kind: i for i, r in enumerate(rules)}
    rows = ledger.filter(F.arrays_overlap("scanned", current))
    # A row of an older rule version holds spans that no longer count.
    live = lambda s: F.array_contains(
        F.array_intersect(F.col("scanned"), current),
        F.element_at(F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.key))]), s["kind"]),
    ) & s["kind"].isin(list(per_rule))
    found = (
        rows.select("blob", F.filter("spans", live).alias("spans"))
        .groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    )
    return named.join(found, "blob", "left").withColumn(
        "spans", F.array_sort(F.coalesce("spans", F.array().cast(f"array<{SPAN}>")))
    )


def digest(found: DataFrame, path: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    return found.select(
        path,
        *[rows_of_kind(F.col("spans"), r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def op1_secret_ledger(documents: DataFrame) -> DataFrame:
    """All documents as a history of one version each, with a ledger that starts empty."""
    spark = documents.sparkSession
    store = scratch_path(spark, "ledger")
    named = update(documents, store, "doc_id")
    return digest(findings_by_path(named, read_ledger(spark, store)), "doc_id")
