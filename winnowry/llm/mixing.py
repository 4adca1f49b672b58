"""Mixing sources to target weights by budgets in a domain - language - source tree.

A total token budget goes down the tree: each node shares its budget among its children by their weights.
A child that holds less than its share (its tokens times the allowed epochs) takes what it has, and what is
left goes to its siblings; only if all siblings are full does it go on to the siblings of their parent. Each
leaf then takes a token prefix of its documents, in a seeded order for each epoch.

Built-in functions only. Arithmetic is in whole numbers. A leaf of any size is cut without sorting it: token
sums over 4,096 ranges of the order give the range that the cut falls into, and only that range is sorted.
Null names are nodes of their own, null or empty texts have no tokens and are never taken, repeated rows
with equal ids follow each other in the order of their text digests, an empty table gives no rows. Other
columns are kept by ``mix``.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.ordering import hash_key
from ..session import materialize
from .common import packed, split_words, whole

LEVELS = ("domain", "lang", "source")
RANGE_BITS, KEY_BITS = 12, 60
SEED = 17
# Shares of the synthetic corpus: languages evened out, one domain favoured. Unlisted nodes weigh 1.
WEIGHTS = {
    "domain": {"d0": 4, "d1": 2, "d2": 2, "d3": 2},
    "lang": {"en": 4, "de": 2, "fr": 2, "es": 2},
    "source": {"src0": 2},
}
MAX_EPOCHS = 4


def domain_of(source: Column) -> Column:
    """A stand-in for a table of domains: four groups of sources."""
    return F.concat(F.lit("d"), F.pmod(F.crc32(whole(source)), F.lit(4)).cast("string"))


def count_tokens(text: Column) -> Column:
    return F.size(split_words(whole(text))).cast("bigint")


def leaf_key(levels=LEVELS) -> Column:
    """The path of a leaf as one string that keeps nulls apart from empty names."""
    return F.to_json(F.array(*[F.col(c).cast("string") for c in levels]))


def _weight(level: str, weights: dict) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("bigint")


def share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``share`` for rows (parent columns, name, w, cap, budget of the parent), at most ``cap``.

    Children are put in the order in which they fill up. All arithmetic is exact.
    """
    order = W.partitionBy(*parent).orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))), name)
    group = W.partitionBy(*parent)
    big = lambda c: F.col(c).cast("decimal(19,0)")
    rows = children.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0)).withColumns(
        {
            "_rest": F.col("budget") - F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            "_weights": F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)),
        }
    )
    rows = rows.withColumn("_full", (F.col("w") == 0) | (big("cap") * big("_weights") <= big("w") * big("_rest")))
    left = lambda c: F.max(F.when(~F.col("_full"), F.col(c))).over(group)
    rows = rows.withColumns({"_pool": left("_rest"), "_over": left("_weights")})
    part = F.expr("CAST(w AS DECIMAL(19,0)) * CAST(_pool AS DECIMAL(19,0)) div CAST(_over AS DECIMAL(19,0))")
    return rows.withColumn("share", F.when(F.col("_full"), F.col("cap")).otherwise(part).cast("bigint")).drop(
        "_rest", "_weights", "_full", "_pool", "_over"
    )


def leaf_budgets(leaves: DataFrame, total: Column, weights: dict, max_epochs: int, levels=LEVELS) -> DataFrame:
    """(levels, tokens, budget) for leaves (levels, tokens): the total shared out down the tree."""
    held = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    budget = held.agg(F.least(total, F.sum("cap")).cast("bigint").alias("budget"))
    for depth, level in enumerate(levels):
        above, own = list(levels[:depth]), list(levels[: depth + 1])
        nodes = held.groupBy(*own).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, weights))
        if depth == 0:
            rows = nodes.join(budget, F.lit(True))  # one row
        else:
            up = budget.select(*[F.col(c).alias(f"_{c}") for c in above], F.col("share").alias("budget"))
            same = F.lit(True)
            for c in above:
                same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
            rows = nodes.join(up, same).drop(*[f"_{c}" for c in above])
        budget = share(rows, above, level)
    same = F.lit(True)
    for c in levels:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    ends = budget.select(*[F.col(c).alias(f"_{c}") for c in levels], F.col("share").alias("budget"))
    return leaves.join(ends, same).select(*levels, "tokens", "budget")


def select_prefixes(rows: DataFrame, budgets: DataFrame, seed: int = SEED, levels=LEVELS) -> DataFrame:
    """(_id, _digest, _leaf, tokens, epoch, taken) of what the leaves take from rows (_id, _digest, _leaf, tokens).

    Whole epochs take every document. In the epoch in which the budget ends, the documents before the cut
    are taken, the one at the cut in part.
    """
    plan = budgets.select(
        leaf_key(levels).alias("_leaf"), F.col("tokens").alias("_all"),
        F.expr("budget div tokens").alias("_whole"), F.expr("budget % tokens").alias("_rest"),
    )
    plan = materialize(plan, "mix-plan")
    key = hash_key(seed, F.col("_whole"), F.col("_id"), F.col("_digest"))
    # Small next to the documents; Spark sends it to all tasks only if it is small.
    placed = rows.join(plan, "_leaf").withColumn("_key", key).withColumn("_range", F.shiftright("_key", KEY_BITS - RANGE_BITS))
    sums = placed.filter("_rest > 0").groupBy("_leaf", "_range", "_rest").agg(F.sum("tokens").alias("_sum"))
    upto = F.sum("_sum").over(W.partitionBy("_leaf").orderBy("_range"))
    cuts = (
        sums.withColumn("_before", upto - F.col("_sum"))
        .filter("_before < _rest AND _rest <= _before + _sum")
        .select(F.col("_leaf").alias("_l"), F.col("_range").alias("_cut"), "_before")
    )
    cuts = materialize(cuts, "mix-cuts")
    met = placed.join(cuts, F.col("_leaf") == F.col("_l"), "left")
    narrow = ["_id", "_digest", "_leaf", "tokens"]
    full = placed.filter("_whole > 0").select(*narrow, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_whole") - 1)).alias("epoch"), F.col("tokens").alias("taken"))
    early = met.filter("_range < _cut").select(*narrow, F.col("_whole").alias("epoch"), F.col("tokens").alias("taken"))
    order = W.partitionBy("_leaf").orderBy("_key", "_id", "_digest")
    edge = met.filter("_range = _cut").withColumn(
        "_at", F.col("_before") + F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("tokens")
    )
    edge = edge.filter("_at < _rest").select(*narrow, F.col("_whole").alias("epoch"), F.least(F.col("tokens"), F.col("_rest") - F.col("_at")).alias("taken"))
    return full.unionByName(early).unionByName(edge)


def choose(
    documents: DataFrame, key: str, text: str, total_share: float = 1.0, weights: dict = WEIGHTS,
    max_epochs: int = MAX_EPOCHS, seed: int = SEED, levels=LEVELS,
) -> DataFrame:
    """(key, _digest, levels, tokens, epoch, taken): what is taken of rows that have the level columns.

    ``total_share``: the budget as a share of all tokens.
    """
    rows = materialize(
        documents.select(
            F.col(key).alias("_id"), F.md5(whole(F.col(text))).alias("_digest"), *levels, count_tokens(F.col(text)).alias("tokens"),
        ).filter("tokens > 0").withColumn("_leaf", leaf_key(levels)),
        "mix-rows",
    )
    leaves = rows.groupBy(*levels).agg(F.sum("tokens").alias("tokens"))
    everything = leaves.agg(F.sum("tokens")).first()[0] or 0
    total = F.lit(int(everything * total_share)).cast("bigint")
    budgets = leaf_budgets(leaves, total, weights, max_epochs, levels)
    taken = select_prefixes(rows.drop(*levels), budgets, seed, levels)
    names = F.from_json("_leaf", "array<string>")
    return taken.select(F.col("_id").alias(key), "_digest", *[names[i].alias(c) for i, c in enumerate(levels)], "tokens", "epoch", "taken")


def mix(documents: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The taken documents, once for each epoch, with all columns; one at a cut is kept whole."""
    plan = choose(documents, key, text, **options).filter("taken > 0")
    once = plan.select(F.col(key).alias("_k"), "_digest", "epoch").dropDuplicates()
    held = packed(documents, _id=F.col(key), _d=F.md5(whole(F.col(text))))
    return held.join(once, F.col("_id").eqNullSafe(F.col("_k")) & (F.col("_d") == F.col("_digest"))).select("_row.*")


def op8_mixing(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", "text", "lang", "source").withColumn("domain", domain_of(F.col("source")))
    return choose(rows, "doc_id", "text").drop("_digest")


def _sql_weight(level: str) -> str:
    cases = " ".join(f"WHEN {level} = '{k}' THEN {w}" for k, w in WEIGHTS[level].items())
    return f"CASE {cases} ELSE 1 END"


def _sql_level(depth: int, max_epochs: int) -> str:
    own, above = ", ".join(LEVELS[: depth + 1]), LEVELS[:depth]
    level, by = LEVELS[depth], f"PARTITION BY {', '.join(above)} " if above else ""
    up = f"b{depth - 1}" if depth else "total"
    on = " AND ".join(f"n.{c} IS NOT DISTINCT FROM u.{c}" for c in above) or "true"
    return f"""
n{depth} AS (SELECT {own}, sum(tokens)::BIGINT * {max_epochs} AS cap, {_sql_weight(level)} AS w FROM leaves GROUP BY {own}),
r{depth} AS (SELECT n.*, u.budget AS budget FROM n{depth} n JOIN {up} u ON {on}),
o{depth} AS (SELECT *, budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
             FROM r{depth} WINDOW o AS ({by}ORDER BY cap / w, {level})),
f{depth} AS (SELECT *, cap::HUGEINT * ws <= w::HUGEINT * rest AS filled FROM o{depth}),
p{depth} AS (SELECT *, max(CASE WHEN NOT filled THEN rest END) OVER ({by}) AS pool,
                    max(CASE WHEN NOT filled THEN ws END) OVER ({by}) AS over_w FROM f{depth}),
b{depth} AS (SELECT {own}, CASE WHEN filled THEN cap ELSE (w::HUGEINT * pool) // over_w END::BIGINT AS budget FROM p{depth})"""


def sql(source: str = "documents", max_epochs: int = MAX_EPOCHS, share_sql: str = "1.0", seed: int = SEED) -> str:
    """The same selection in DuckDB."""
    words = "len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))"
    # crc32 is not a function there; the domains of the given sources are worked out from their names.
    return f"""
WITH docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_sql_domain()} AS domain FROM {source}),
rows0 AS (SELECT doc_id, md5(text) AS digest, domain, lang, source, {words}::BIGINT AS tokens FROM docs),
rows1 AS (SELECT * FROM rows0 WHERE tokens > 0),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM rows1 GROUP BY ALL),
total AS (SELECT least(floor(sum(tokens) * {share_sql})::BIGINT, sum(tokens)::BIGINT * {max_epochs}) AS budget FROM leaves),
{",".join(_sql_level(d, max_epochs) for d in range(len(LEVELS)))},
plan AS (SELECT l.*, b.budget // l.tokens AS whole, b.budget % l.tokens AS rest FROM leaves l JOIN b2 b
         ON l.domain IS NOT DISTINCT FROM b.domain AND l.lang IS NOT DISTINCT FROM b.lang AND l.source IS NOT DISTINCT FROM b.source),
placed AS (SELECT r.*, p.whole, p.rest, ('0x' || md5('{seed}|' || p.whole || '|' || r.doc_id || '|' || r.digest)[1:15])::BIGINT AS k
           FROM rows1 r JOIN plan p ON r.domain IS NOT DISTINCT FROM p.domain AND r.lang IS NOT DISTINCT FROM p.lang AND r.source IS NOT DISTINCT FROM p.source),
cum AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, doc_id, digest ROWS UNBOUNDED PRECEDING) - tokens AS pos FROM placed),
taken AS (SELECT doc_id, digest, domain, lang, source, tokens, unnest(range(whole)) AS epoch, tokens AS taken FROM placed
          UNION ALL
          SELECT doc_id, digest, domain, lang, source, tokens, whole, least(tokens, rest - pos) FROM cum WHERE pos < rest)"""


def _sql_domain() -> str:
    import zlib

    names = {f"src{i}": f"d{zlib.crc32(f'src{i}'.encode()) % 4}" for i in range(100)}
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())
    return f"CASE source {cases} END"


SQL = sql() + "\nSELECT doc_id, domain, lang, source, tokens, epoch::BIGINT AS epoch, taken::BIGINT AS taken FROM taken"
