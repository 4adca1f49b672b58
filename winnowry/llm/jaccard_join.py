"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are the distinct shingle sets, columns are shingles. A link needs 80 % of the union, so two
linked rows share a column in the *head* of each: all but the last 80 % of its columns, in one order of columns for
all rows, rare ones first. The order comes from counts over all rows in a table of bounded size; it decides the work
only, never the result.

The matrix has two blocks of columns. Columns that the counts show to be in at most ``FEW`` rows are multiplied out:
each shared column adds 1 to the cell of every two of its rows, the cells are summed, and a cell is discarded when its
count plus all that can follow its last shared column stays below the bound that the two sizes set. Common columns
are not multiplied out. Their rows are dealt into blocks of at most ``BLOCK``, and blocks are compared two at a time:
only rows of different components, and only where sizes, positions and parity bits leave a link possible. Each row
has 256 parity bits of its whole set; two rows differ in at least as many shingles as bits.

What is left gets its full overlap count. A row first tries its most promising cells only; rows that are linked
become one component and cells inside it need no test; then all others are tested. So all links between components
are found, and a group of n near copies costs about n tests. The blocks of common columns first meet only themselves,
which joins the near copies, and all others then.

Words are runs between white space, in lower case for A-Z. A null or empty text has an empty set, no links and itself
as component; a text of fewer than five words is one shingle. Rows of equal sets are one row of the matrix; rows with
a null id link like others and never name a component; repeated ids with different texts stay apart. An empty table
gives no rows. Other columns are left alone. Shingles and sets are told apart by 64-bit hashes, so n_shingles and
links are exact but for collisions: about (shingles of a text)^2 / 2^65 a text, (sets)^2 / 2^65 overall.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..session import materialize, small_batches
from .common import few_tasks, forget, packed, whole
from .components import components
from .positional_index import bounded
from .shingles import distinct_shingles

PERCENT = 80
FEW = 64
BLOCK = 4096
# Tests of a row at a time; what is left after these goes through all tests at once.
TESTS = (1, 8)
# Bytes of text for each counter of columns, and the most counters (broadcast as one byte each).
TEXT_A_COUNTER, LEAST_COUNTERS, MOST_COUNTERS = 128, 1 << 16, 1 << 25
SLICE = 1 << 16
# Texts of a batch that are held as bytes at a time, and pairs of rows that are compared at a time.
TEXTS, PAIRS = 512, 1 << 18
TASKS_A_CORE = 2
# Rows with a list of shingles that one task gets, where a table is small.
LISTS_A_TASK = 5_000
_BITS = [f"b{i}" for i in range(4)]


def needed(a, b):
    """Least overlap of linked sets of the given sizes: 100 * overlap >= PERCENT * union."""
    return (PERCENT * (a + b) + 99 + PERCENT) // (100 + PERCENT)


def needed_sql(a: str, b: str) -> str:
    return f"(({PERCENT} * ({a} + {b}) + {99 + PERCENT}) div {100 + PERCENT})"


def head_size(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


def parity(items: np.ndarray) -> np.ndarray:
    """256 bits as four longs, each bit turned by every item of its share."""
    odd = np.bincount((items >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(batch: pa.RecordBatch, column: str):
    texts = batch.column(column).cast(pa.binary())
    return distinct_shingles(v or b"" for i in range(0, len(texts), TEXTS) for v in texts.slice(i, TEXTS).to_pylist())


def column_levels(texts: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """How common each group of columns is, and the first level whose columns may be in more than FEW rows.

    Level 0 is up to about the mean count of a group, then one for each factor of 2.
    """
    size = texts.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    buckets = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << (size // TEXT_A_COUNTER).bit_length()))

    def count(batches):
        total = np.zeros(buckets, np.uint32)
        for batch in batches:
            for s in _sets(batch, text):
                np.add.at(total, (s & np.uint64(buckets - 1)).astype(np.int64), 1)
        for i in range(0, buckets, SLICE):
            part = total[i : i + SLICE]
            kind = np.min_scalar_type(part.max())
            yield pa.RecordBatch.from_arrays(
                [pa.array([i // SLICE], pa.int32()), pa.array([kind.str]), pa.array([part.astype(kind).tobytes()], pa.binary())], ["slice", "kind", "counts"]
            )

    def add(batches):
        at, total = None, None
        for batch in batches:
            for number, kind, counts in zip(*(batch.column(c) for c in ("slice", "kind", "counts")), strict=True):
                if number.as_py() != at:
                    if at is not None:
                        yield done(at, total)
                    at, total = number.as_py(), np.zeros(min(SLICE, buckets), np.uint64)
                total += np.frombuffer(counts.as_buffer(), kind.as_py())
        if at is not None:
            yield done(at, total)

    def done(at, total):
        kind = np.min_scalar_type(total.max())
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([kind.str]), pa.array([total.astype(kind).tobytes()], pa.binary())], ["slice", "kind", "counts"])

    # As many tables as tasks that run at once, whatever the rows.
    few = texts.select(text).coalesce(TASKS_A_CORE * texts.sparkSession.sparkContext.defaultParallelism)
    parts = few.mapInArrow(count, "slice int, kind string, counts binary")
    # At most MOST_COUNTERS numbers, whatever the input.
    with small_batches(texts.sparkSession):
        slices = parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(add, "slice int, kind string, counts binary").collect()
    # Read as they came, one slice at a time: as doubles they would take several times that.
    counts = {r["slice"]: np.frombuffer(r["counts"], r["kind"]) for r in slices}
    mean = max(1.0, sum(int(c.sum(dtype=np.uint64)) for c in counts.values()) / buckets)
    usual = mean + 3 * mean**0.5
    levels = np.zeros(buckets, np.uint8)
    for at, c in counts.items():
        levels[at * SLICE : at * SLICE + len(c)] = np.clip(np.ceil(np.log2(np.maximum(c, 1) / usual)), 0, 60)
    # A column of a level is in at most usual * 2 ** level rows.
    return levels, max(0, int(np.floor(np.log2(FEW / usual))) + 1) if usual <= FEW else 0


def heads(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(_key, _hash, c, n, bits, low, head) for every document, stored.

    ``c`` names the set (null: empty). The first document of a set in each task has its head, whose first ``low`` columns are
    the ones to multiply out; for copies it is null.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(key).alias("_key"), F.xxhash64(whole(F.col(text))).alias("_hash"), F.col(text).alias("_text"))
    levels, common = column_levels(rows, "_text")
    shared = spark.sparkContext.broadcast(levels)
    schema = T.StructType(
        [T.StructField("_key", documents.schema[key].dataType), T.StructField("_hash", T.LongType()), T.StructField("c", T.LongType()), T.StructField("n", T.LongType()),
         *[T.StructField(b, T.LongType()) for b in _BITS], T.StructField("low", T.IntegerType()), T.StructField("head", T.ArrayType(T.LongType()))]
    )

    def make(batches):
        level, met = shared.value, set()
        mask = np.uint64(len(level) - 1)
        for batch in batches:
            names, sizes, bits, lows, parts, ends, known = [], [], [], [], [], [0], []
            for s in _sets(batch, "_text"):
                sizes.append(len(s))
                names.append(hash_of(s) if len(s) else None)
                new = len(s) > 0 and names[-1] not in met
                known.append(not new)
                if not new:
                    bits.append(parity(s) if len(s) else np.zeros(4, np.int64))
                    lows.append(0)
                    ends.append(ends[-1])
                    continue
                met.add(names[-1])
                bits.append(parity(s))
                rank = level[(s & mask).astype(np.int64)]
                size = head_size(len(s))
                order = np.argsort(rank, kind="stable")[:size] if rank.any() else slice(size)
                lows.append(int(np.count_nonzero(rank[order] < common)))
                parts.append(s[order].view(np.int64))
                ends.append(ends[-1] + size)
            flat = pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), flat, mask=pa.array(known, pa.bool_()))
            four = np.array(bits, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), batch.column("_hash"), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()),
                 *[pa.array(np.ascontiguousarray(four[:, i])) for i in range(4)], pa.array(lows, pa.int32()), lists],
                names=schema.names,
            )

    return materialize(rows.mapInArrow(make, schema), "jaccard-rows")


def hash_of(items: np.ndarray) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(items.tobytes(), digest_size=8).digest(), "little", signed=True)


def classes_of(rows: DataFrame) -> DataFrame:
    """(c, n, bits, one, least): the distinct sets, each with one document that has it, stored."""
    found = rows.filter("n > 0").groupBy("c").agg(
        F.first("n").alias("n"), *[F.first(b).alias(b) for b in _BITS], F.min(F.struct("_key", "_hash")).alias("one"), F.min("_key").alias("least")
    )
    return materialize(found, "jaccard-classes")


def _columns_of(batches, names):
    """Arrays of whole runs of ``col``, batch after batch."""
    held = None
    for batch in batches:
        new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        now = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in names}
        col = now["col"]
        if not len(col):
            continue
        last = int(np.searchsorted(col, col[-1]))
        if last:
            yield {c: v[:last] for c, v in now.items()}
        held = {c: v[last:] for c, v in now.items()}
    if held is not None and len(held["col"]):
        yield held


def product(rows: DataFrame) -> DataFrame:
    """(a, b, na, nb, found): the cells of the product over rare columns that sizes leave open, a < b.

    ``found`` columns are counted; what is behind the last of them in both rows could be shared too.
    """
    entries = rows.filter("low > 0").select("c", "n", F.posexplode(F.slice("head", 1, F.col("low"))).alias("pos", "col"))
    dealt = entries.repartition("col").sortWithinPartitions("col", "c").select("col", "c", "n", "pos")

    def cells(batches):
        for e in _columns_of(batches, ("col", "c", "n", "pos")):
            col, c = e["col"], e["c"]
            # Copies in several tasks are one entry.
            first = np.append(True, (col[1:] != col[:-1]) | (c[1:] != c[:-1]))
            col, c, n, pos = (e[k][first] for k in ("col", "c", "n", "pos"))
            starts = np.flatnonzero(np.append(True, col[1:] != col[:-1]))
            rank = np.arange(len(col)) - np.repeat(starts, np.diff(np.append(starts, len(col))))
            late, k = np.flatnonzero(rank), 1
            while len(late):
                b, a = late, late - k
                na, nb, pa_, pb = n[a], n[b], pos[a].astype(np.int64), pos[b].astype(np.int64)
                good = np.minimum(pa_, pb) + np.minimum(na - pa_, nb - pb) >= needed(na, nb)
                if good.any():
                    a, b = a[good], b[good]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c[a], c[b], n[a], n[b], pos[a], pos[b])], ["a", "b", "na", "nb", "pa", "pb"])
                k += 1
                late = late[rank[late] >= k]

    made = dealt.mapInArrow(cells, "a bigint, b bigint, na bigint, nb bigint, pa int, pb int")
    summed = made.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.count("*").alias("found"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    most = F.col("found") + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1)
    return summed.filter(most >= F.expr(needed_sql("na", "nb"))).select("a", "b", "na", "nb", "found")


def within_parity(cells: DataFrame, classes: DataFrame) -> DataFrame:
    """The cells whose rows do not differ in more parity bits than linked rows of their sizes may differ in shingles."""
    side = lambda x: classes.select(F.col("c").alias(x), *[F.col(b).alias(f"{x}{b}") for b in _BITS])
    off = sum((F.bit_count(F.col(f"a{b}").bitwiseXOR(F.col(f"b{b}"))) for b in _BITS), F.lit(0))
    both = cells.join(side("a"), "a").join(side("b"), "b")
    return both.filter(off <= F.col("na") + F.col("nb") - 2 * F.expr(needed_sql("na", "nb"))).select(*cells.columns)


def links_among(documents: DataFrame, classes: DataFrame, cells: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """The cells (a, b), ``n`` of them, that are links: full overlap counts, from the text of one document of each row."""
    few = lambda df: few_tasks(df, 2 * n)
    sides = few(cells.select(F.col("a").alias("c"), "a", "b").unionByName(cells.select(F.col("b").alias("c"), "a", "b")))
    wanted = few(few(sides.select("c").distinct()).join(classes.select("c", "one"), "c"))
    some = materialize(wanted.select("c", F.col("one._key").alias("_k"), F.col("one._hash").alias("_h")), "jaccard-wanted")
    rows = documents.select(F.col(key).alias("_key"), F.xxhash64(whole(F.col(text))).alias("_hash"), F.col(text).alias("_text"))
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h"))
    met = rows.join(bounded(some), same).select("c", "_text")

    def make(batches):
        for batch in batches:
            sets = [s.view(np.int64) for s in _sets(batch, "_text")]
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["c", "items"])

    def count(batches):
        last, set_ = None, None
        for batch in batches:
            out = []
            for a, b, c, items in zip(*(batch.column(x).to_pylist() for x in ("a", "b", "c")), batch.column("items"), strict=True):
                x = items.values.to_numpy()
                if last is not None and last[:2] == (a, b) and last[2] != c:
                    both = len(np.intersect1d(set_, x, assume_unique=True))
                    if 100 * both >= PERCENT * (len(set_) + len(x) - both):
                        out.append((a, b))
                last, set_ = (a, b, c), x
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    sets = met.mapInArrow(make, "c bigint, items array<bigint>").join(bounded(materialize(sides, "jaccard-sides")), "c").select("a", "b", "c", "items")
    tasks = max(documents.sparkSession.sparkContext.defaultParallelism, -(-2 * n // LISTS_A_TASK))
    # Several documents may share key and hash: then a row comes twice, one after the other.
    dealt = sets.repartition(tasks, "a", "b").sortWithinPartitions("a", "b", "c")
    return dealt.mapInArrow(count, "a bigint, b bigint").distinct()


class Labels:
    """Components so far: (c, label) of the rows that have been joined to others; all else stand alone."""

    def __init__(self, spark):
        self.held, self.n = spark.createDataFrame([], "c bigint, label bigint"), 0

    def on(self, rows: DataFrame, column: str, name: str, n: int) -> DataFrame:
        """Rows, about ``n``, with the label of a column's row."""
        own = self.held.select(F.col("c").alias("_c"), F.col("label").alias("_l"))
        met = few_tasks(rows.join(own, F.col(column) == F.col("_c"), "left"), n + self.n)
        return met.withColumn(name, F.coalesce("_l", column)).drop("_c", "_l")

    def join(self, links: DataFrame) -> None:
        """Make one component of the two of each link."""
        links = materialize(links, "jaccard-links")
        n = links.count()
        if not n:
            return
        edges = self.on(self.on(links, "a", "la", n), "b", "lb", n).select(F.col("la").alias("a"), F.col("lb").alias("b"))
        merged = materialize(components(edges, n), "jaccard-merged").select(F.col("node").alias("_n"), F.col("label").alias("_m"))
        moved = self.held.join(merged, F.col("label") == F.col("_n"), "left").select("c", F.coalesce("_m", "label").alias("label"))
        fresh = merged.select(F.col("_n").alias("c"), F.col("_m").alias("label")).join(self.held, "c", "left_anti")
        before, self.n = self.held, self.n + 2 * n
        self.held = materialize(few_tasks(moved.unionByName(fresh), self.n), "jaccard-labels")
        forget(links, before)


def join_cells(documents: DataFrame, classes: DataFrame, cells: DataFrame, labels: Labels, key: str, text: str) -> None:
    """Test the cells of the product: the best one of each row first, then all that could still join components."""
    for tests in (TESTS[0], None):
        n = cells.count()
        if not n:
            break
        few = lambda df, n=n: few_tasks(df, n)
        order = W.partitionBy("a").orderBy(F.desc("found"), "b")
        ranked = materialize(few(cells.withColumn("place", F.row_number().over(order))), "jaccard-cells")
        forget(cells)
        now = ranked if tests is None else ranked.filter(F.col("place") <= tests)
        labels.join(links_among(documents, classes, now.select("a", "b"), now.count(), key, text))
        if tests is not None:
            left = labels.on(labels.on(few(ranked.filter(F.col("place") > tests)), "a", "la", n), "b", "lb", n)
            cells = materialize(left.filter("la <> lb").select("a", "b", "na", "nb", "found"), "jaccard-cells")
        forget(ranked)


def common_entries(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(col, c, n, pos, prev, bits, blocks): the entries of common columns that two rows or more share, stored.

    Of columns that the same rows share one stays, as a link shows in each column that its rows share. ``prev`` is the column
    before in the row, where all rows have their columns in one order, those of many rows first (null: none).
    """
    high = rows.filter("low < size(head)").select("c", "n", "low", F.posexplode(F.slice("head", F.col("low") + 1, F.size("head"))).alias("at", "col"))
    one = high.groupBy("col", "c").agg(F.first("n").alias("n"), F.first(F.col("at") + F.col("low")).alias("pos"))
    one = materialize(one, "jaccard-common")
    held_by = [F.bit_xor(F.xxhash64(F.lit(i), "c")).alias(f"h{i}") for i in range(2)]
    shared = one.groupBy("col").agg(F.count("*").alias("m"), *held_by).filter("m > 1")
    shared = shared.groupBy("m", "h0", "h1").agg(F.min("col").alias("col")).select("col", "m", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    n = one.count()
    held = few_tasks(one.join(shared, "col"), n)
    before = F.lag("col").over(W.partitionBy("c").orderBy(F.desc("m"), "col"))
    placed = few_tasks(held.join(classes.select("c", *_BITS), "c"), n).withColumn("prev", before).drop("m")
    out = materialize(few_tasks(placed, n), "jaccard-common")
    forget(one)
    return out


def compare_blocks(entries: DataFrame, alone: bool, tests: int, n: int) -> DataFrame:
    """(a, b, rest): for each row and column the ``tests`` most promising rows of other components, from blocks of rows.

    ``alone``: blocks meet only themselves. ``rest`` says that a row had more; it may come without rows.

    Two rows that also share the column before, in both of them, have met there. So a pair comes once for each run of
    columns that it shares, not for each column.
    """
    placed = entries.withColumn("_i", F.pmod(F.xxhash64("c", "col"), F.col("blocks")).cast("int"))
    other = F.array("_i") if alone else F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = few_tasks(placed.withColumn("_j", F.explode(other)), n).select(
        "col", F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"), F.col("_i").alias("own"), "c", "n", "pos", "prev", "label", *_BITS
    )

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        table = table.sort_by("c")
        c, n, pos, label, own = (table.column(x).to_numpy() for x in ("c", "n", "pos", "label", "own"))
        pos = pos.astype(np.int64)
        bits = np.stack([table.column(b).to_numpy() for b in _BITS], 1).view(np.uint64)
        first_one = table.column("prev").is_null().to_numpy()
        prev = table.column("prev").fill_null(0).to_numpy()
        out, more = [], False
        step = max(1, PAIRS // len(c))
        for first in range(0, len(c), step):
            a = np.arange(first, min(len(c), first + step))[:, None]
            b = np.arange(len(c))[None, :]
            fit = (a < b) & (label[a] != label[b])
            if i != j:
                fit &= own[a] != own[b]
            x, y = np.nonzero(fit)
            x += first
            least = needed(n[x], n[y])
            most = np.minimum(pos[x], pos[y]) + np.minimum(n[x] - pos[x], n[y] - pos[y])
            keep = most >= least
            x, y, least = x[keep], y[keep], least[keep]
            off = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
            keep = off <= n[x] + n[y] - 2 * least
            x, y, off = x[keep], y[keep], off[keep]
            if len(x):
                order = np.lexsort((y, off, x))
                x, y = x[order], y[order]
                starts = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
                place = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
                # A column is in both or in neither, so two rows without one before have not met.
                new = first_one[x] | first_one[y] | (prev[x] != prev[y])
                keep = new & (place < tests)
                more = more or bool((new & ~keep).any())
                out.append((c[x[keep]], c[y[keep]]))
        made = [pa.array(np.concatenate(v)) for v in zip(*out)] if out else [pa.array([], pa.int64())] * 2
        # That there is more is said by one row of the block, which names no pair.
        made = [pa.concat_arrays([v, pa.nulls(int(more), pa.int64())]) for v in made]
        return pa.table({"a": made[0], "b": made[1], "rest": made[0].is_null()})

    found = dealt.groupBy("col", "i", "j").applyInArrow(compare, "a bigint, b bigint, rest boolean")
    return found.groupBy("a", "b").agg(F.max("rest").alias("rest"))


def join_common(documents: DataFrame, classes: DataFrame, entries: DataFrame, labels: Labels, key: str, text: str) -> None:
    """Test what blocks of common columns leave possible: at last, every row has tried all."""
    n = entries.count()
    # Two blocks have at most 2 * BLOCK rows; hashing makes some larger, so the last round has no limit at all.
    for alone, tests in ((True, TESTS[0]), (False, TESTS[1]), (False, 1 << 30)) if n else ():
        few = lambda df, n=n: few_tasks(df, n)
        marked = materialize(labels.on(entries, "c", "label", n), "jaccard-marked")
        mixed = few(marked.groupBy("col").agg(F.min("label").alias("x"), F.max("label").alias("y"))).filter("x <> y").select("col")
        open_ = few(marked.join(mixed, "col", "left_semi"))
        cells = materialize(few(compare_blocks(open_, alone, tests, n)), "jaccard-cells")
        forget(marked)
        shape = cells.agg(F.count("a").alias("n"), F.max("rest").alias("rest")).first()
        if shape["n"]:
            labels.join(links_among(documents, classes, cells.filter("a is not null").select("a", "b"), shape["n"], key, text))
        forget(cells)
        if not alone and not shape["rest"]:
            break


def join_components(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, _hash, n, least) for every document: the size of its set and the smallest id in its component."""
    rows = heads(documents, key, text)
    classes = classes_of(rows)
    labels = Labels(documents.sparkSession)
    raw = materialize(product(rows), "jaccard-cells")
    entries = common_entries(rows, classes)
    # The heads have been read; what documents belong to which set stays.
    members = materialize(rows.select("_key", "_hash", "c", "n"), "jaccard-members")
    forget(rows)
    cells = materialize(few_tasks(within_parity(raw, classes), raw.count()), "jaccard-cells")
    forget(raw)
    join_cells(documents, classes, cells, labels, key, text)
    join_common(documents, classes, entries, labels, key, text)
    forget(entries)
    n = classes.count()
    marked = labels.on(classes.select("c", "least"), "c", "label", n)
    names = marked.groupBy("label").agg(F.min("least").alias("least"))
    by_set = marked.select("c", "label").join(names, "label").select("c", "least")
    return members.join(by_set, "c", "left").select(
        "_key", "_hash", "n", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("_key")).alias("least")
    )


def keep_one(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: the one with the smallest id; texts without words all stay."""
    found = join_components(documents, key, text)
    kept = found.filter((F.col("n") == 0) | F.col("_key").eqNullSafe(F.col("least")) | F.col("least").isNull())
    kept = kept.groupBy(F.col("_key").alias("_k"), F.col("_hash").alias("_h")).agg(F.first("n").alias("_n"))
    held = packed(documents, _id=F.col(key), _own=F.xxhash64(whole(F.col(text))))
    same = F.col("_id").eqNullSafe(F.col("_k")) & (F.col("_own") == F.col("_h"))
    return held.join(kept, same, "left_semi").dropDuplicates(["_id", "_own"]).select("_row.*")


def op5_jaccard_join(documents: DataFrame) -> DataFrame:
    return join_components(documents.select("doc_id", "text")).select(
        F.col("_key").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("least").alias("component_id")
    )
