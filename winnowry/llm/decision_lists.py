"""Quality rules learned as an ordered decision list.

Sequential covering: conditions on text statistics are grown one threshold at a time by information gain on
one part of the labelled rows, pruned from the end on the other part, and the rows that a rule covers leave
before the next one is grown. The list is applied as one ordered conditional expression.

Built-in functions only. Statistics cover all rows and whole texts. Training sees the labelled rows as
counts by statistic and bin, so the driver gets at most ``BINS`` counts per statistic and class for each
step. A null or empty text has no words; unlabelled rows train nothing; with no usable labels the list is
empty and keeps all rows. Rows labelled twice count twice. Ties between thresholds go to the first
statistic in order of name, then the lowest bin. Other columns are kept.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import WORD_SPACE, split_words, whole

STATS = ("dup_line_share", "mean_word", "repeat_share", "symbol_share", "upper_share", "bar_share")
BINS, RULES, CONDITIONS, LEAST_ROWS, LEAST_PROOF, LEAST_PRECISION = 32, 8, 3, 3, 2, 0.9
WINDOW = 3
BASE_WORDS, BASE_REPEAT = 50, 50


@dataclass(frozen=True)
class Condition:
    stat: str
    at_least: bool
    threshold: float

    def holds(self) -> Column:
        return F.col(self.stat) >= self.threshold if self.at_least else F.col(self.stat) < self.threshold


def _repeat_words(words: Column) -> Column:
    """Words inside windows that occur twice or more.

    Windows are sorted by a hash, then by their words, then by position, so equal ones are neighbors whatever
    the hash does. The covered words are counted from the sorted positions.
    """
    n = F.size(words)
    keys = F.transform(
        F.slice(words, 1, n - (WINDOW - 1)),
        lambda w, i: F.struct(F.xxhash64(w, words[i + 1], words[i + 2]).alias("h"), w.alias("a"), words[i + 1].alias("b"), words[i + 2].alias("c"), i.alias("at")),
    )
    same = lambda x, y: (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def repeated(ordered):
        last = F.size(ordered) - 1
        near = lambda k, i: (
            F.when(i > 0, same(k, ordered[i - 1])).otherwise(False) | F.when(i < last, same(k, ordered[i + 1])).otherwise(False)
        )
        return F.array_sort(F.transform(F.filter(ordered, near), lambda k: k["at"]))

    def covered(places):
        zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(places, zero, step, lambda a: a["n"])

    # A one-element array binds a value once; the column name would spell it out at each use.
    let = lambda value, body: F.transform(F.array(value), body)[0]
    counted = let(F.sort_array(keys), lambda ordered: let(repeated(ordered), covered))
    return F.when(n >= WINDOW, counted).otherwise(F.lit(0).cast("bigint"))


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """The frame with counts and shares for each text, which leaves it.

    A text has its words split once: the words are a column of their own, below the statistics.
    """
    t = F.col("_text")
    split = df.withColumn("_text", whole(F.col(text))).withColumn("_words", split_words(F.col("_text")))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    let = lambda value, body: F.transform(F.array(value), body)[0]
    taken = lambda chars: F.length(t) - F.length(F.regexp_replace(t, chars, ""))
    counted = split.select(
        *[c for c in df.columns if c != text],
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace(t, WORD_SPACE, "")).cast("bigint").alias("word_chars"),
        taken("[#*$%&|<>]+").cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        F.size(lines).cast("bigint").alias("n_lines"),
        _repeat_words(F.col("_words")).alias("n_repeat_words"),
        taken("[A-Z]+").alias("_upper"),
        taken("[|]+").alias("_bars"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return counted.withColumns(
        {
            "dup_line_share": share("n_dup_lines", "n_lines"), "mean_word": share("word_chars", "n_words"),
            "repeat_share": share("n_repeat_words", "n_words"), "symbol_share": share("n_symbols", "word_chars"),
            "upper_share": share("_upper", "word_chars"), "bar_share": share("_bars", "n_words"),
        }
    ).drop("_upper", "_bars", "n_lines")


def bin_edges(labelled: DataFrame, stats=STATS) -> dict:
    """Thresholds for each statistic: its quantiles among the rows of either class."""
    levels = [i / BINS for i in range(1, BINS)]
    asked = [F.percentile_approx(s, levels, 10_000).alias(s) for s in stats]
    rows = labelled.groupBy("good").agg(*asked).collect()
    return {s: sorted({v for r in rows for v in (r[s] or [])}) for s in stats}


def _histograms(rows: DataFrame, edges: dict) -> dict:
    """Counts by statistic and bin: {stat: [[bad, good], ...]}, bin i below edge i."""

    def bin_of(s):
        return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges[s]]), lambda e: e <= F.col(s)))

    place = [F.struct(F.lit(s).alias("s"), bin_of(s).alias("b")) for s in edges if edges[s]]
    out = {s: [[0, 0] for _ in range(len(edges[s]) + 1)] for s in edges}
    if place:
        counted = rows.select("good", "n", F.explode(F.array(*place)).alias("x"))
        for r in counted.groupBy("x.s", "x.b", "good").agg(F.sum("n").alias("n")).collect():
            out[r["s"]][r["b"]][int(r["good"])] += r["n"]
    return out


def _gain(bad, good, bad_before, good_before) -> float:
    if bad == 0:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before)))


def grow(rows: DataFrame, edges: dict) -> list[Condition]:
    """Add the threshold of highest gain until only bad rows are left or nothing helps."""
    rule = []
    for _ in range(CONDITIONS):
        counts = _histograms(rows, edges)
        some = next((h for s, h in sorted(counts.items()) if edges[s]), [])
        bad, good = sum(h[0] for h in some), sum(h[1] for h in some)
        if bad < LEAST_ROWS or good == 0:
            break
        best = (0.0, None)
        for s in sorted(edges):
            below = [0, 0]
            for i, edge in enumerate(edges[s]):
                below = [below[0] + counts[s][i][0], below[1] + counts[s][i][1]]
                for at_least, (b, g) in ((False, below), (True, (bad - below[0], good - below[1]))):
                    if b >= LEAST_ROWS and (gain := _gain(b, g, bad, good)) > best[0] + 1e-9:
                        best = (gain, Condition(s, at_least, float(edge)))
        if best[1] is None:
            break
        rule.append(best[1])
        rows = rows.filter(best[1].holds())
    return rule


def prune(rows: DataFrame, rule: list[Condition]) -> tuple[list[Condition], float, int]:
    """The rule without the final conditions that add no precision on rows not used for growing; its precision and bad rows there."""
    held, depth = F.lit(True), []
    for c in rule:
        held = held & c.holds()
        depth.append(held)
    sums = [
        F.sum(F.when(d & (F.col("good") == g), F.col("n")).otherwise(0)).alias(f"{kind}{i}")
        for i, d in enumerate(depth) for kind, g in (("b", 0), ("g", 1))
    ]
    counts = rows.agg(*sums).first()
    best = ([], 0.0, 0)
    for i in range(len(rule)):
        bad, good = counts[f"b{i}"] or 0, counts[f"g{i}"] or 0
        if bad and bad / (bad + good) > best[1]:
            best = (rule[: i + 1], bad / (bad + good), bad)
    return best


def learn(labelled: DataFrame, stats=STATS) -> list[list[Condition]]:
    """Ordered rules for bad rows, from rows of statistics with ``good`` (0 or 1) and ``part`` (0 grows, 1 prunes).

    A rule enters the list only if enough of the rows it was not grown on are bad.
    """
    one = labelled.select("good", "part", *stats).groupBy("good", "part", *stats).agg(F.count("*").alias("n"))
    rows = materialize(one, "rule-rows")
    edges = bin_edges(labelled, stats)
    found = []
    for _ in range(RULES):
        rule = grow(rows.filter("part = 0"), edges)
        if not rule:
            break
        rule, worth, bad = prune(rows.filter("part = 1"), rule)
        if worth < LEAST_PRECISION or bad < LEAST_PROOF:
            break
        found.append(rule)
        rows = rows.filter(~_all(rule))
    return found


def _all(rule: list[Condition]) -> Column:
    held = rule[0].holds()
    for c in rule[1:]:
        held = held & c.holds()
    return held


def decision(rules: list[list[Condition]]) -> Column:
    """Number of the first rule that holds, from 1; 0 if none does."""
    out = F.lit(0)
    for i in reversed(range(len(rules))):
        out = F.when(_all(rules[i]), i + 1).otherwise(out)
    return out


def label_rows(stats: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Statistics of labelled rows; a third of the keys prune."""
    known = labels.filter(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias("good"))
    part = (F.pmod(F.xxhash64(F.col(key)), F.lit(3)) == 0).cast("int").alias("part")
    return stats.join(known, key).select("*", part)


def judge(documents: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """All documents with their statistics, base verdict, the rule that rejects them (0: none) and ``kept``."""
    stats = materialize(text_statistics(documents), "text-statistics")
    words, repeats = F.col("n_words"), F.col("n_repeat_words")
    base = (words < BASE_WORDS) | (100 * repeats > BASE_REPEAT * words)
    based = stats.withColumn("base_failed", base)
    rules = learn(label_rows(based.filter(~F.col("base_failed")), labels, key, label))
    return based.withColumn("rule", decision(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op3_decision_lists(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(documents.select("doc_id", "text"), labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )
