"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Documents of equal text form a group. Groups are dealt into cells of bounded size; in each cell every group,
largest first, goes to the shard where the dot product of its size vector with the shard's residual capacity
is highest; a last step swaps groups of like size, as bytes are the law. Groups above 1 / LARGE of a shard, of which
there is a bounded number, are placed first in the same way; the cells then fill what is left of each shard, so
their sum is even. A group stays whole; only one larger than a shard is cut, by a hash of the id, into as many pieces
as shards it would fill. Then slots number the rows of each shard without a gap.

The law is ``bytes``: sizes near equal. A null or empty text has no bytes and counts its fixed cost.
Repeated rows are rows of their own; rows with a null id go where their text goes. An empty table gives no
rows, other columns are left alone, ties go to the lower shard.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import materialize
from .common import whole

SHARDS = 24
LARGE = 32
SIZES = ("bytes", "tokens", "rows")
CELL_GROUPS = 16_384
SLOT_ROWS = 100_000
ROW_COST = 8
WEIGHTS = np.array([8.0, 1.0, 1.0])


def pack(sizes: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """Shard of each row of ``sizes`` (bytes, tokens, rows); ``capacity`` is what each shard has left [size, shard]."""
    mean = np.maximum(capacity.mean(1), 1e-9)
    part = sizes / mean * WEIGHTS
    order = np.lexsort((np.arange(len(sizes)), -part.sum(1)))
    left = capacity / mean[:, None]
    step = sizes / mean
    out = np.empty(len(sizes), np.int32)
    for i in order:
        s = int((part[i] @ left).argmax())
        out[i] = s
        left[:, s] -= step[i]
    return level(sizes[:, 0], out, capacity[0])


def level(sizes: np.ndarray, shard: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Bytes come first in the law: swap groups of like size between the shard most above its target and the one
    most below it, while that brings them closer."""
    shards = len(target)
    load = np.bincount(shard, sizes, shards) - target
    for _ in range(8 * shards):
        high, low = int(load.argmax()), int(load.argmin())
        gap = load[high] - load[low]
        a, b = np.flatnonzero(shard == high), np.flatnonzero(shard == low)
        if gap <= 1 or not len(a):
            break
        b_sizes, order = np.append(sizes[b], 0.0), None  # index len(b): move without taking one back
        order = np.argsort(b_sizes, kind="stable")
        want = sizes[a] - gap / 2
        near = np.clip(np.searchsorted(b_sizes[order], want), 0, len(order) - 1)
        best = None
        for k in (near, np.maximum(near - 1, 0)):
            off = np.abs(sizes[a] - b_sizes[order[k]] - gap / 2)
            i = int(off.argmin())
            if best is None or off[i] < best[0]:
                best = (off[i], a[i], order[k[i]])
        if best[0] >= gap / 2:
            break
        x, y = best[1], best[2]
        moved = sizes[x] - b_sizes[y]
        shard[x] = low
        if y < len(b):
            shard[b[y]] = high
        load[high], load[low] = load[high] - moved, load[low] + moved
    return shard


def measured(documents: DataFrame, key: str, text: str) -> DataFrame:
    t = whole(F.col(text))
    return materialize(
        documents.select(
            F.col(key).alias("_key"), F.md5(t).alias("_group"), (F.octet_length(t) + ROW_COST).cast("bigint").alias("size"),
            F.size(F.split(t, " ")).cast("bigint").alias("tokens"), F.crc32(t).alias("text_crc32"),
        ),
        "shard-rows",
    )


def assign(documents: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """(key, size, text_crc32, shard, slot) for all rows."""
    rows = measured(documents, key, text)
    three = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*three).first()
    room = np.array([total[c] or 0 for c in SIZES], float)[:, None] / shards * np.ones(shards)
    # No more than shards * LARGE groups are that large: they are placed first, whole where a shard has room for them.
    limit = max(1, (total["bytes"] or 0) // (shards * LARGE))
    full = max(1.0, room[0, 0])
    groups = rows.groupBy("_group").agg(*three)
    some = groups.filter((F.col("bytes") > limit) & (F.col("rows") > 1)).orderBy("_group").collect()
    pieces = [(g, k, max(1, min(g["rows"], math.ceil(g["bytes"] / full)))) for g in some for k in range(max(1, min(g["rows"], math.ceil(g["bytes"] / full))))]
    sizes = np.array([[g[c] / n for c in SIZES] for g, _, n in pieces], float).reshape(-1, 3)
    first = pack(sizes, room) if pieces else np.empty(0, int)
    for s, size in zip(first, sizes, strict=True):
        room[:, s] = np.maximum(room[:, s] - size, 0)
    share = room / np.maximum(room.sum(1, keepdims=True), 1e-9)
    kinds = "_g string, _pieces int, _p int, _shard int"
    large = documents.sparkSession.createDataFrame([(g["_group"], n, k, int(s)) for (g, k, n), s in zip(pieces, first, strict=True)], kinds)
    own = F.broadcast(large.select("_g", "_pieces").distinct())
    cut = rows.join(own, F.col("_group") == F.col("_g"), "left").withColumn(
        "_piece", F.when(F.col("_g").isNotNull(), F.pmod(F.xxhash64("_key", "text_crc32"), F.col("_pieces"))).otherwise(0).cast("int")
    ).withColumn("_large", F.col("_g").isNotNull()).drop("_g", "_pieces")
    cut = materialize(cut, "shard-pieces")
    small = cut.filter(~F.col("_large")).groupBy("_group", "_piece").agg(*three)
    cells = max(1, (total["rows"] or 0) // CELL_GROUPS)
    celled = small.withColumn("_cell", F.pmod(F.xxhash64("_group", "_piece"), F.lit(cells)).cast("int"))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        # In a fixed order, so that a task that runs again decides alike.
        frame = frame.sort_values(["_group", "_piece"])
        own = frame[list(SIZES)].to_numpy(np.float64)
        # Cells take the shards in different orders, so what is left over does not pile up.
        turn = (np.arange(shards) + int(frame["_cell"].iloc[0])) % shards
        shard = turn[pack(own, own.sum(0)[:, None] * share[:, turn])]
        return pd.DataFrame({"_group": frame["_group"], "_piece": frame["_piece"], "shard": shard.astype(np.int32)})

    placed = materialize(celled.groupBy("_cell").applyInPandas(packed, "_group string, _piece int, shard int"), "shard-plan")
    placed = placed.unionByName(large.select(F.col("_g").alias("_group"), F.col("_p").alias("_piece"), F.col("_shard").alias("shard")))
    buckets = max(1, (total["rows"] or 0) // SLOT_ROWS)
    dealt = cut.join(placed, ["_group", "_piece"]).withColumn("_bucket", F.pmod(F.xxhash64("_key", "_group"), F.lit(buckets)).cast("int"))
    dealt = materialize(dealt.drop("_piece", "tokens", "_large"), "shard-dealt")
    counts = dealt.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("shard").orderBy("_bucket")) - F.col("_n")
    starts = counts.select("shard", "_bucket", before.alias("_start"))
    order = W.partitionBy("shard", "_bucket").orderBy("_key", "_group")
    numbered = dealt.withColumn("_at", F.row_number().over(order)).join(starts, ["shard", "_bucket"])
    return numbered.select(F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_start") + F.col("_at") - 1).cast("bigint").alias("slot"))


def write_shards(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Write the documents as Parquet folders shard=N with their slots; returns rows and bytes of each shard."""
    plan = assign(documents, key, text, shards).dropDuplicates([key, "text_crc32", "shard"]).select(
        F.col(key).alias("_k"), F.col("text_crc32").alias("_c"), "shard", "slot", "size"
    )
    held = documents.join(plan, F.col(key).eqNullSafe(F.col("_k")) & (F.crc32(whole(F.col(text))) == F.col("_c"))).drop("_k", "_c")
    held.drop("size").repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return plan.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def op4_vector_packing(documents: DataFrame) -> DataFrame:
    return assign(documents.select("doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
