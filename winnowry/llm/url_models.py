"""URL filters: host and path rules, then a character language-model ratio.

Two variable-order Markov models, one of accepted and one of rejected addresses, give each character a
probability that mixes all context lengths (Witten-Bell: a context counts for more the more often and the
less variedly it was continued). An address without a rule is judged by the difference of both
log-likelihoods per character against a threshold calibrated on held-out addresses.

Built-in functions only. Every address that a rule decides trains or calibrates. Addresses are reduced to
distinct (host, path) first; counts are partially aggregated, so common contexts stay cheap. A null address
or one without ``://`` has an empty host and path and is judged by the calibrated threshold at score 0; with
no rules that fit, or one class only, all other addresses are allowed. Repeated rows are judged alike. Other
columns are kept.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import ascii_lower

ORDER = 4
ALPHABET = 96
HELD_OUT, FOLDS = 0, 5
SCORE_BINS = 400
BROADCAST_ROWS = 400_000
START = "\x02"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.split("/", 1)[1]


RULES = (
    UrlRule("allow", "org/"), UrlRule("block", "example.org/es/"), UrlRule("block", "example.org/en/1"),
    UrlRule("allow", "com/fr/"), UrlRule("block", "com/de/"),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.rule).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _steps(text: Column) -> Column:
    """(context, char) of every character and the end: the context has ORDER characters, fewer at the start."""
    padded = F.concat(F.lit(START), text, F.lit("\x03"))
    return F.transform(
        F.sequence(F.lit(2), F.length(padded)),
        lambda i: F.struct(
            F.substr(padded, F.greatest(F.lit(1), i - ORDER), F.least(F.lit(ORDER), i - 1)).alias("context"),
            F.substr(padded, i, F.lit(1)).alias("char"),
        ),
    )


def count_steps(addresses: DataFrame) -> DataFrame:
    """(context, char, allow, block): how often each class continued each full context so."""
    rows = addresses.select("verdict", F.explode(_steps(F.col("address"))).alias("s"))
    of = lambda v: F.sum((F.col("verdict") == v).cast("bigint")).alias(v)
    return rows.groupBy("s.context", "s.char").agg(of("allow"), of("block"))


def model(counts: DataFrame) -> DataFrame:
    """(context, char, gain): log probability of allowed minus that of blocked addresses, with a row of
    null char for each context that holds what an unseen character costs.

    Shorter contexts are suffixes of the full ones and get the sums of their counts; the probability for
    each length is mixed into the next longer one, level by level.
    """
    suffix = lambda c, n: F.when(F.length(c) > n, F.substr(c, F.length(c) - n + 1)).otherwise(c)
    level = None
    for n in range(ORDER + 1):
        at = suffix(F.col("context"), n) if n else F.lit("")
        own = counts.filter(F.length("context") >= n) if n else counts
        own = own.groupBy(at.alias("context"), "char").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        sums = own.groupBy("context").agg(
            *[F.sum(v).alias(f"{v}_n") for v in ("allow", "block")],
            *[F.sum((F.col(v) > 0).cast("bigint")).alias(f"{v}_kinds") for v in ("allow", "block")],
        )
        # The unseen character of each context is a row of its own.
        rows = own.unionByName(sums.select("context", F.lit(None).cast("string").alias("char"), F.lit(0).cast("bigint").alias("allow"), F.lit(0).cast("bigint").alias("block")))
        rows = rows.join(sums, "context")
        if level is None:
            rows = rows.withColumns({f"{v}_below": F.lit(1.0 / ALPHABET) for v in ("allow", "block")})
        else:
            shorter = level.select(F.col("context").alias("_c"), F.col("char").alias("_x"), *[F.col(f"{v}_p").alias(f"{v}_below") for v in ("allow", "block")])
            shorter_of = F.substr(F.col("context"), F.lit(2)) if n > 1 else F.lit("")
            rows = rows.withColumn("_s", shorter_of).join(shorter, (F.col("_s") == F.col("_c")) & F.col("char").eqNullSafe(F.col("_x"))).drop("_s", "_c", "_x")
        mixed = lambda v: F.when(
            F.col(f"{v}_n") > 0,
            (F.col(v) + F.col(f"{v}_kinds") * F.col(f"{v}_below")) / (F.col(f"{v}_n") + F.col(f"{v}_kinds")),
        ).otherwise(F.col(f"{v}_below"))
        level = rows.select("context", "char", *[mixed(v).alias(f"{v}_p") for v in ("allow", "block")])
        level = materialize(level, f"url-level-{n}")
        kept = level.withColumn("gain", F.log("allow_p") - F.log("block_p")).select("context", "char", "gain")
        every = kept if n == 0 else every.unionByName(kept)
    return every


def score(addresses: DataFrame, gains: DataFrame) -> DataFrame:
    """(address, score): mean gain per character.

    A character takes the gain of the longest context that was seen: the whole one, or a suffix of it. The
    model is sent to all tasks if it has at most BROADCAST_ROWS rows; a larger one is joined by shuffle.
    """
    small = gains.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)
    steps = addresses.select("address", F.explode(_steps(F.col("address"))).alias("s")).select("address", "s.context", "s.char")
    # The same step occurs in many addresses: it is looked up once.
    wanted = steps.groupBy("context", "char").count().drop("count")
    looked = wanted.select(
        "context", "char",
        F.explode(F.transform(F.sequence(F.lit(0), F.length("context")), lambda n: F.struct(n.alias("n"), F.substr(F.col("context"), F.length("context") - n + 1, n).alias("part")))).alias("k"),
    )
    known = gains.select(F.col("context").alias("_c"), F.col("char").alias("_x"), "gain")
    asked = looked.select("context", "char", "k.n", "k.part", F.explode(F.array(F.col("char"), F.lit(None).cast("string"))).alias("ask"))
    hits = asked.join(hint(known), (F.col("part") == F.col("_c")) & F.col("ask").eqNullSafe(F.col("_x")))
    best = hits.groupBy("context", "char").agg(F.max_by("gain", F.struct("n", F.col("ask").isNotNull())).alias("gain"))
    best = materialize(best, "url-gains")
    best = hint(best) if small and best.count() <= BROADCAST_ROWS else best
    return (
        steps.join(best, ["context", "char"], "left")
        .groupBy("address").agg(F.avg(F.coalesce("gain", F.lit(0.0))).alias("score"))
    )


def calibrate(scored: DataFrame) -> float:
    """The score at and above which an address is allowed: highest mean of both classes' shares judged right,
    in the middle of the scores that do equally well."""
    edges = scored.agg(F.min("score").alias("a"), F.max("score").alias("b")).first()
    if edges["a"] is None or edges["a"] == edges["b"]:
        return 0.0 if edges["a"] is None else edges["a"]
    width = (edges["b"] - edges["a"]) / SCORE_BINS
    place = F.least(F.lit(SCORE_BINS - 1), F.floor((F.col("score") - edges["a"]) / width).cast("int")).alias("bin")
    counts = [[0, 0] for _ in range(SCORE_BINS)]
    for r in scored.groupBy(place, "verdict").count().collect():
        counts[r["bin"]][r["verdict"] == "allow"] += r["count"]
    blocks, allows = sum(c[0] for c in counts), sum(c[1] for c in counts)
    if not blocks or not allows:
        return edges["a"]
    rights, below = [], [0, 0]
    for c in counts:
        rights.append(below[0] / blocks + (allows - below[1]) / allows)
        below = [below[0] + c[0], below[1] + c[1]]
    first = last = rights.index(max(rights))
    while last + 1 < SCORE_BINS and rights[last + 1] == rights[first]:
        last += 1
    return edges["a"] + (first + last) / 2 * width


def judge(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """The rows with host, path, rule, verdict and score (null where a rule decides)."""
    host, path = parts(F.col(url))
    keys = pages.select(host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    known = materialize(
        keys.groupBy("host", "path").count().select(
            "host", "path", name.alias("rule"), verdict.alias("verdict"), F.concat("host", "path").alias("address")
        ),
        "url-addresses",
    )
    labelled = known.filter("verdict is not null")
    held = F.pmod(F.xxhash64("address"), F.lit(FOLDS)) == HELD_OUT
    both = labelled.select("verdict").distinct().count() == 2
    if both:
        gains = materialize(model(count_steps(labelled.filter(~held))), "url-model")
        scores = materialize(score(known.filter(F.col("verdict").isNull() | held).select("address").distinct(), gains), "url-scores")
        limit = calibrate(labelled.filter(held).join(scores, "address"))
        open_ = known.filter("verdict is null").join(scores, "address").select(
            "host", "path", "rule", F.when(F.col("score") >= limit, "allow").otherwise("block").alias("verdict"), "score"
        )
    else:
        open_ = known.filter("verdict is null").select("host", "path", "rule", F.lit("allow").alias("verdict"), F.lit(None).cast("double").alias("score"))
    judged = labelled.select("host", "path", "rule", "verdict", F.lit(None).cast("double").alias("score")).unionByName(open_)
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    return pages.select(*rest, host.alias("host"), path.alias("path")).join(judged, ["host", "path"])


def op6_url_models(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
