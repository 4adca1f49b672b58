"""Nearest examples from a large base: inverted lists, product-quantised codes, exact re-ranking.

A coarse codebook divides the base into lists; what a vector differs by from its list's center is cut into parts, each
of which is replaced by the nearest of at most 256 words. A query looks into the lists of its nearest centers, reads the
codes there by their distances from its own rest, and keeps the ``rerank`` rows that seem nearest; these are measured
exactly, with distances and ties as in the exact search, which stays beside this one. What may be missed is a neighbor
in a list that was not visited or behind more than ``rerank`` seemingly nearer rows; ``recall_of`` measures it.

The codebooks are fitted on at most ``SAMPLE_ROWS`` rows, the first by a hash of their ids; every row is indexed. They are
bounded in size and travel with the job; lists are cut into blocks of bounded size on both sides. Rows without a
vector are left out. Ids of the base must be unique.
"""

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .. import fixed_values as fv
from ..session import materialize
from .knn import (
    BLOCK_ROWS, CHUNK_ROWS, Asked, Axes, Best, _squares, chunks_of, id_dtype, knn_join_cells, leaves_of, likely_pairs, pack, pair_distances, search_blocks,
    slots_of, vector_dtype, with_squares,
)
from .ordering import hash_key

SAMPLE_ROWS, ROUNDS = 20_000, 12
MOST_LISTS, MOST_PARTS, WORDS = 1024, 16, 256
PROBE_SHARE, RERANK = 0.25, 20
# So many offers of a query may lie beside those that are kept.
WAITING = 24
# A chunk of queries keeps at most so many rows between its blocks.
CHUNK_CELLS = 1 << 20


@dataclass(frozen=True)
class Codebooks:
    centers: np.ndarray
    # For each part its words, as long as the part.
    words: list

    @property
    def bounds(self) -> np.ndarray:
        return np.cumsum([0] + [w.shape[1] for w in self.words])

    def rest(self, codes: np.ndarray) -> np.ndarray:
        """What rows of these codes differ by from the centers of their lists."""
        return np.concatenate([w[codes[:, i]] for i, w in enumerate(self.words)], 1)


def _means(rows: np.ndarray, n: int, rng) -> np.ndarray:
    """Centers of n groups; a group that runs empty keeps its center."""
    centers = rows[rng.permutation(len(rows))[: min(n, len(rows))]].copy()
    for _ in range(ROUNDS):
        own = _squares(rows, centers).argmin(1)
        sizes = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, own, rows)
        some = sizes > 0
        centers[some] = sums[some] / sizes[some, None]
    return centers


def fit(base: DataFrame, n_lists: int | None = None, seed: int = 7) -> Codebooks | None:
    """Codebooks from a bounded sample of base (id, embedding); None if it is empty."""
    known = base.filter(F.col("embedding").isNotNull())
    total = known.count()
    if not total:
        return None
    some = known.select("embedding", hash_key("sample", F.col("id")).alias("h"), "id").orderBy("h", "id").limit(SAMPLE_ROWS)
    rows = np.array([np.asarray(r["embedding"], float) for r in some.collect()])
    rng = np.random.default_rng(seed)
    centers = _means(rows, n_lists or min(MOST_LISTS, max(1, math.isqrt(total))), rng)
    rest = rows - centers[_squares(rows, centers).argmin(1)]
    parts = np.array_split(np.arange(rows.shape[1]), min(MOST_PARTS, rows.shape[1]))
    return Codebooks(centers, [_means(rest[:, p], WORDS, rng) for p in parts])


def build_index(base: DataFrame, books: Codebooks) -> DataFrame:
    """(id, embedding, list, code) of every base row with a vector, stored."""

    @F.pandas_udf("struct<list:int,code:binary>")
    def code(v: pd.Series) -> pd.DataFrame:
        rows = np.stack(v.to_numpy()).astype(float)
        own = _squares(rows, books.centers).argmin(1)
        rest, at = rows - books.centers[own], books.bounds
        codes = np.stack([_squares(rest[:, at[i] : at[i + 1]], w).argmin(1) for i, w in enumerate(books.words)], 1).astype(np.uint8)
        return pd.DataFrame({"list": own.astype(np.int32), "code": [c.tobytes() for c in codes]})

    known = base.filter(F.col("embedding").isNotNull())
    return materialize(known.select("id", "embedding", code("embedding").alias("c")).select("id", "embedding", "c.list", "c.code"), "ann-index")


def search(
    queries: DataFrame, index: DataFrame, books: Codebooks, k: int = fv.NEIGHBORS, probes: int | None = None,
    rerank: int | None = None, block: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, neighbor_rank, id, distance) from queries (query_id, embedding) and an index."""
    probes = min(len(books.centers), probes or max(8, math.ceil(PROBE_SHARE * len(books.centers))))
    rerank = max(k, rerank or RERANK * k)
    queries = queries.filter(F.col("embedding").isNotNull())

    known = queries.select("query_id", "embedding")
    # One row for each list reaches the driver.
    sizes = {r["list"]: r["count"] for r in index.groupBy("list").count().collect()}
    rerank = max(1, min(rerank, sum(sizes.values())))
    query_type, id_type = known.schema["query_id"].dataType.simpleString(), index.schema["id"].dataType.simpleString()
    if not sizes:
        return index.sparkSession.createDataFrame([], f"query_id {query_type}, neighbor_rank int, id {id_type}, distance double")
    dtype, axes = vector_dtype(known, index), Axes(books.centers)

    def seen(t: pa.Table, _) -> np.ndarray:
        """A row lies where its code says."""
        codes = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
        return axes.seen(books.centers[t["list"][0].as_py()] + books.rest(codes))

    class Chunk:
        names = ["seems", "distance"]

        def __init__(self, q, n, ids):
            self.q = np.frombuffer(q, dtype).reshape(n, -1).copy()
            self.visits = np.zeros((len(books.centers), n), dtype=bool)
            for start in range(0, n, 1024):
                far = _squares(self.q[start : start + 1024].astype(float), books.centers)
                near = np.argsort(far, axis=1, kind="stable")[:, :probes]
                np.put_along_axis(self.visits[:, start : start + 1024], near.T, True, axis=0)
            self.asked = Asked(axes.seen(self.q.astype(float)).astype(dtype))
            self.id_type, self.best = ids.type, Best(n, rerank, id_dtype(ids), WAITING)

        def look(self, row):
            own, ids = row["list"].as_py(), row["ids"].values
            meet = np.flatnonzero(self.visits[own])
            if not len(meet):
                return
            codes = np.frombuffer(row["code"].as_py(), np.uint8).reshape(len(ids), -1)
            vectors = np.frombuffer(row["vectors"].as_py(), dtype).reshape(len(ids), -1)
            coded, center = books.rest(codes).astype(np.float32), books.centers[own].astype(dtype)
            left = None
            for some, asked in leaves_of(row, len(ids), self.asked, meet, self.best.limit):
                if left is None:
                    left = with_squares((self.q[meet] - center).astype(np.float32, copy=False))
                at = np.searchsorted(meet, asked)
                some_left = [x.take(at, axis=0) for x in left]
                for rows, places, seems in likely_pairs(None, coded[some], self.best.limit()[asked], rerank, exact=False, left=some_left):
                    # What seems near is measured at once, while its vector is at hand.
                    d = pair_distances(self.q, vectors[some], asked[rows], places)
                    self.best.offer(asked[rows], seems, ids.take(pa.array(places + some.start)).to_numpy(zero_copy_only=False), d)

        def rows(self):
            row, seems, ids, d = self.best.rows()
            return row, ids, seems, d

    slot, n_blocks = slots_of("list", sizes, "id", block)
    blocks = pack(index, slot, "id", "embedding", dtype, {"list": "int", "code": "binary"}, rerank, seen)
    chunks, n_chunks = chunks_of(known, dtype, max(256, min(CHUNK_ROWS, CHUNK_CELLS // rerank)))
    seen = search_blocks(chunks, n_chunks, blocks, n_blocks, Chunk, f"query_id {query_type}, id {id_type}, seems double, distance double")
    first = Window.partitionBy("query_id").orderBy("seems", "id")
    some = seen.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= rerank)
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return some.withColumn("neighbor_rank", F.row_number().over(best)).filter(F.col("neighbor_rank") <= k).select("query_id", "neighbor_rank", "id", "distance")


def knn_join_lists(queries: DataFrame, base: DataFrame, k: int = fv.NEIGHBORS, **options) -> DataFrame:
    """Nearest neighbors by lists and codes, over a base (id, embedding) that is indexed for this one search."""
    books = fit(base)
    if books is None:
        return knn_join_cells(queries, base, k)
    return search(queries, build_index(base, books), books, k, **options)


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: ``queries`` with exact neighbors, ``pairs`` of them, those ``met``, and ``recall`` (1 without pairs)."""
    hits = exact.select("query_id", "id").join(found.select("query_id", "id").withColumn("_met", F.lit(1)), ["query_id", "id"], "left")
    counted = hits.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("pairs"), F.count("_met").alias("met"))
    return counted.withColumn("recall", F.when(F.col("pairs") > 0, F.col("met") / F.col("pairs")).otherwise(1.0))
