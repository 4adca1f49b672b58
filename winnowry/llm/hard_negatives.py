"""Hard-negative mining by Fagin's threshold algorithm.

All rows are dealt into blocks of bounded size; a block is stored as one row with its integer vectors and, for each
dimension, the list of its rows sorted by that component. Anchors come in blocks too, and each meets every block
of rows. For an anchor, the lists are read from the end its sign prefers (sorted access, some ranks at a time);
every row that is new gets its whole integer score (random access). The sum of the anchor's components times the
components last read bounds the score of all rows not read yet. Reading ends when that threshold is strictly below
the kth score of each window of scores that is asked for, or below the window itself. The results of all blocks
are merged: the first k of all are among the first k of each block.

Scores are integer inner products of floor(scale * x); higher first, ties by smaller id (null ids last), then in
the order of a number given to each row. Positives of an anchor are its first rows with the same label, itself
left out; the negatives of each positive are the first rows with another label whose score lies in the window set
by the positive's score. Rows without label, or with a null vector or a null, NaN or infinite component, take no
part. Vectors must have one length. Rows of equal ids are rows of their own; a null id is never an anchor. An
empty table, or one without anchors or positives, gives no rows. Other columns are left alone.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize

SCALE = 256
ANCHOR_STEP = 100
POSITIVES, NEGATIVES = 5, 10
LOW_PERCENT, HIGH_PERCENT = 30, 90
BLOCK_ROWS, ANCHOR_ROWS = 4096, 256
FIRST_RANKS = 64
_NO_ID = np.iinfo(np.int64).max


def usable(rows: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """(r, id, label, x) of the rows that take part, numbered, stored."""
    v = F.col(vector).cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    kept = rows.filter(label.isNotNull() & F.col(vector).isNotNull()).filter(~F.exists(v, bad))
    x = F.transform(v, lambda c: F.floor(c * SCALE).cast("bigint"))
    return materialize(kept.select(F.monotonically_increasing_id().alias("r"), F.col(key).cast("bigint").alias("id"), label.cast("bigint").alias("label"), x.alias("x")), "negatives-rows")


def _arrays(table):
    """Rows in the order of their numbers: r, id (null as the largest), known, label, x."""
    table = table.sort_by("r")
    ids = table.column("id")
    x = table.column("x").combine_chunks()
    x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
    return (
        table.column("r").to_numpy(), ids.fill_null(_NO_ID).to_numpy(), ids.is_valid().to_numpy(), table.column("label").to_numpy(),
        x.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1),
    )


def _pack(a: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


_PACKED = "block bigint, n int, r binary, id binary, known binary, label binary, x binary, lists binary"


def blocks(rows: DataFrame, number: Column, sorted_lists: bool) -> DataFrame:
    """Rows of one block number as one row of packed arrays, with the sorted list of each dimension, stored."""

    def pack(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        r, ids, known, label, x = _arrays(table)
        lists = np.argsort(x, axis=0, kind="stable").T if sorted_lists else np.empty(0)
        kinds = (("r", r, "<i8"), ("id", ids, "<i8"), ("known", known, "?"), ("label", label, "<i8"), ("x", x, "<i8"), ("lists", lists, "<i4"))
        columns = {"block": pa.array([block], pa.int64()), "n": pa.array([len(r)], pa.int32())}
        return pa.table(columns | {name: pa.array([_pack(a, kind)], pa.binary()) for name, a, kind in kinds})

    numbered = rows.withColumn("block", number)
    return materialize(numbered.groupBy("block").applyInArrow(pack, _PACKED), "negatives-blocks")


class _Block:
    """A stored block: vectors, labels and sorted lists."""

    def __init__(self, row: dict):
        n = row["n"]
        take = lambda name, kind: np.frombuffer(row[name], kind)
        self.r, self.id, self.known, self.label = take("r", "<i8"), take("id", "<i8"), take("known", "?"), take("label", "<i8")
        self.x = take("x", "<i8").reshape(n, -1)
        self.lists = take("lists", "<i4").reshape(-1, n) if len(row["lists"]) else None
        self.most = int(np.abs(self.x).max(initial=0))
        self.real = self.x.astype(np.float64) if self.lists is not None and self.most < 1 << 53 else None

    def scores(self, some: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Integer scores of some rows."""
        if self.real is not None and self.x.shape[1] * self.most * int(np.abs(anchor).max(initial=0)) < 1 << 53:
            # Doubles hold such sums exactly; for many rows the whole block is faster than picking them.
            real = anchor.astype(np.float64)
            return ((self.real @ real)[some] if 4 * len(some) > len(self.real) else self.real[some] @ real).astype(np.int64)
        return self.x[some] @ anchor

    def first(self, some: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places in ``some`` of the first k: score falling, then id, then number."""
        if len(some) > k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            near = np.flatnonzero(scores >= kth)
        else:
            near = np.arange(len(some))
        order = np.lexsort((self.r[some[near]], self.id[some[near]], -scores[near]))
        return near[order[:k]]


def search(block: _Block, anchor: np.ndarray, fits, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (low, high) the first k rows of the block that ``fits`` accepts with a score inside: rows, scores."""
    n, d = block.x.shape
    if d * block.most * int(np.abs(anchor).max(initial=0)) >= 1 << 63:
        raise OverflowError("a score is too large for a long")
    used = np.flatnonzero(anchor)
    # From the end of each list that the anchor's sign prefers.
    up = anchor[used] > 0
    rising, falling = used[up], used[~up]
    held = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in windows]
    seen = np.zeros(n, bool)
    at, step = 0, FIRST_RANKS
    while at < n and windows:
        to = min(n, at + step)
        before = seen.copy()
        if len(used):
            seen[block.lists[rising, n - to : n - at]] = True
            seen[block.lists[falling, at:to]] = True
            last = np.append(block.lists[rising, n - to], block.lists[falling, to - 1])
            dims = np.append(rising, falling)
            threshold = int(anchor[dims] @ block.x[last, dims])
        else:
            # A zero anchor scores 0 everywhere and has no list to read.
            seen[:], to, threshold = True, n, 0
        new = np.flatnonzero(seen & ~before)
        new = new[fits(new)]
        scores = block.scores(new, anchor)
        at, step = to, 2 * step
        done = True
        for w, (low, high) in enumerate(windows):
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            if len(inside):
                rows, values = np.append(held[w][0], new[inside]), np.append(held[w][1], scores[inside])
                first = block.first(rows, values, k)
                held[w] = rows[first], values[first]
            done &= threshold < low or (len(held[w][1]) == k and threshold < held[w][1][-1])
        # Nothing left to read behind the threshold, or nothing at all.
        if done or seen.all():
            break
    return held


def _met(rows: DataFrame, anchors: DataFrame, n_anchor_blocks: int) -> DataFrame:
    """Every stored block of rows beside every stored block of anchors."""
    some = anchors.select(F.col("block").alias("anchor_block"), F.struct(*[c for c in anchors.columns if c != "block"]).alias("anchors"))
    return rows.withColumn("anchor_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_anchor_blocks - 1).cast("bigint")))).join(some, "anchor_block")


def _each_pair(met: DataFrame, find, names: list[str], kinds: list[str]) -> DataFrame:
    """The rows that ``find`` makes of a block of rows, a block of anchors and their row, one pair of blocks at a time."""
    types = {"bigint": pa.int64(), "int": pa.int32()}

    def each(table: pa.Table) -> pa.Table:
        out = [x for row in table.to_pylist() for x in find(_Block(row), _Block(row["anchors"]), row)]
        return pa.table({name: pa.array([x[c] for x in out], types[kinds[c]]) for c, name in enumerate(names)})

    return met.groupBy("block", "anchor_block").applyInArrow(each, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def positives(met: DataFrame, k: int = POSITIVES) -> DataFrame:
    """(anchor, anchor_block, place, anchor_id, rank, positive_id, score): the first k rows of each anchor's label."""

    def find(block, some, row):
        for i in range(len(some.r)):
            fits = lambda rows, i=i: (block.label[rows] == some.label[i]) & (block.r[rows] != some.r[i])
            (rows, scores), = search(block, some.x[i], fits, [(-(1 << 63), (1 << 63) - 1)], k)
            for j, s in zip(rows, scores, strict=True):
                yield some.r[i], row["anchor_block"], i, some.id[i], block.r[j], block.id[j] if block.known[j] else None, s

    names = ["anchor", "anchor_block", "place", "anchor_id", "r", "positive_id", "score"]
    found = _each_pair(met, find, names, ["bigint", "bigint", "int"] + ["bigint"] * 4)
    order = W.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("positive_id"), "r")
    return materialize(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "negatives-positives")


def negatives(met: DataFrame, found: DataFrame, k: int = NEGATIVES, low: int = LOW_PERCENT, high: int = HIGH_PERCENT) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    asked = found.groupBy("anchor_block").agg(F.collect_list(F.struct("place", "rank", "score", "positive_id")).alias("asked"))

    def find(block, some, row):
        by_place = {}
        for p in row["asked"]:
            by_place.setdefault(p["place"], []).append(p)
        for i, ps in sorted(by_place.items()):
            fits = lambda rows, i=i: block.label[rows] != some.label[i]
            # low * p <= 100 * s <= high * p in whole numbers.
            windows = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in ps]
            open_ = [(w, p) for w, p in zip(windows, ps, strict=True) if w[0] <= w[1]]
            for (rows, scores), (_, p) in zip(search(block, some.x[i], fits, [w for w, _ in open_], k), open_, strict=True):
                for j, s in zip(rows, scores, strict=True):
                    yield some.r[i], some.id[i], p["rank"], p["positive_id"], p["score"], block.r[j], block.id[j] if block.known[j] else None, s

    names = ["anchor", "anchor_id", "place", "positive_id", "positive_score", "r", "negative_id", "negative_score"]
    rows = _each_pair(met.join(asked, "anchor_block"), find, names, ["bigint", "bigint", "int"] + ["bigint"] * 5)
    order = W.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "r")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(rows: DataFrame, anchors: DataFrame, block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """Hard negatives of ``anchors``, which are some of ``rows`` (both as ``usable`` gives them)."""
    shape = rows.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    if shape["n"] and shape["low"] != shape["high"]:
        raise ValueError(f"vectors of {shape['low']} to {shape['high']} components can't be compared")
    deal = lambda n: F.pmod(F.xxhash64("r"), F.lit(max(1, n)))
    anchor_blocks = max(1, -(-anchors.count() // anchor_rows))
    met = _met(
        blocks(rows, deal(-(-shape["n"] // block_rows)), True), blocks(anchors, deal(anchor_blocks), False), anchor_blocks
    )
    return negatives(met, positives(met))


def op12_hard_negatives(embeddings: DataFrame) -> DataFrame:
    moved = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable(embeddings.select("vec_id", "embedding", "label"), "vec_id", "embedding", moved)
    return mine(rows, rows.filter(F.col("id") % ANCHOR_STEP == 0))


SQL = f"""WITH r AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda c: CAST(floor(c::DOUBLE * {SCALE}) AS BIGINT)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM r a, r b WHERE a.vec_id % {ANCHOR_STEP} = 0 AND a.k <> b.k),
p AS (SELECT * FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score FROM p JOIN s USING (anchor_id)
  WHERE s.label <> s.own AND {LOW_PERCENT} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH_PERCENT} * p.score)
SELECT *, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INTEGER) AS rank FROM n QUALIFY rank <= {NEGATIVES}"""
