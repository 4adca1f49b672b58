"""Order-based operators. "First" and "last" always name an order column: a distributed read has none."""

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import materialize, send_if_small

LEVEL_BITS = 12
KEY_BITS = 60
# Of a row's digest, behind its order: together they fit 38 decimal digits.
PLACE_BITS = 61
COLLECT_ROWS = 4096


def first_n(df: DataFrame, n: int, order) -> DataFrame:
    """The first n rows by an order column; -1 means all."""
    return df if n == -1 else df.orderBy(order).limit(n)


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return _extreme_per_key(df, keys, order, F.min_by)


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return _extreme_per_key(df, keys, order, F.max_by)


def _as_number(c: Column, kind) -> Column | None:
    """A whole or time column as a long in the same order; None for other types."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return c.cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    return None


def _extreme_per_key(df, keys, order, pick):
    """One row per key. Rows without an order come last, for the last row first; among equal orders the row's digest
    decides, so the choice does not depend on partitions.

    With a whole or time order, a row's place is one number: its order, then its digest. A hash aggregate
    over (digest of the key, place) finds the first place of each key, and a semi join brings its row back; no text is
    sorted to find it, and a hot key is one row for each map task in the aggregate. Equal rows are one. With
    another order the row itself goes through the aggregate.
    """
    first = pick is F.min_by
    rest = [c for c in df.columns if c not in keys]
    content = [F.to_json(c) if "map<" in df.schema[c].dataType.simpleString() else F.col(c) for c in rest]
    number = _as_number(F.col(order), df.schema[order].dataType)
    if number is None:
        known = F.col(order).isNull() if first else F.col(order).isNotNull()
        place = F.struct(known, F.col(order), F.xxhash64(*content))
        best = df.groupBy(*keys).agg(pick(F.struct(*rest), place).alias("_row"))
        return best.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])
    digest = F.shiftrightunsigned(F.xxhash64(*content), 64 - PLACE_BITS)
    step = F.lit(Decimal(1 << PLACE_BITS))
    shifted = (number.cast("decimal(20,0)") + F.lit(Decimal(1 << 63))) * step
    unknown = F.lit(Decimal(1 << 64) if first else Decimal(-1)) * step
    place = (F.coalesce(shifted.cast("decimal(38,0)"), unknown.cast("decimal(38,0)")) + digest).cast("decimal(38,0)")
    key = F.md5(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    placed = df.withColumns({"_key_digest": key, "_place": place})
    best = placed.groupBy("_key_digest").agg((F.min if first else F.max)("_place").alias("_place"))
    met = placed.join(best, ["_key_digest", "_place"], "left_semi")
    same = Window.partitionBy("_key_digest", "_place").orderBy("_key_digest", "_place")
    return met.withColumn("_copy", F.row_number().over(same)).filter("_copy = 1").select(*df.columns)


def hash_key(seed, *parts: Column) -> Column:
    """A seeded 60-bit key: the first 15 hex digits of an MD5 digest."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def shuffle_rows(df: DataFrame, seed, id_col: str, copy_col: str | None = None) -> DataFrame:
    """Seeded order of all rows. Rows with one id are spread by position, so no range grows with an id."""
    parts = [F.col(id_col)] + ([F.col(copy_col)] if copy_col else [])
    return df.orderBy(hash_key(seed, *parts), *parts, F.monotonically_increasing_id())


def content_key(df: DataFrame) -> Column:
    """A 60-bit hash of the whole row; rows that share it are interchangeable."""
    return F.shiftrightunsigned(F.xxhash64(F.to_json(F.struct(*df.columns))), 4)


def _prefix(key: Column, bits: int) -> Column:
    return F.shiftright(key, KEY_BITS - bits)


def class_histogram(df: DataFrame, cls: Column, key: Column) -> dict:
    """Rows per class and leading key bits: at most 4096 counts per class reach the driver."""
    rows = df.groupBy(cls.alias("c"), _prefix(key, LEVEL_BITS).alias("p")).count().collect()
    histogram = {}
    for r in rows:
        histogram.setdefault(r["c"], {})[r["p"]] = r["count"]
    return histogram


def _locate(cells: dict, rank: int):
    """The cell in which the rank-th row (from 0) lies, and the rank inside it."""
    for cell in sorted(cells):
        if rank < cells[cell]:
            return cell, rank, cells[cell]
        rank -= cells[cell]
    raise ValueError("rank outside the class")


def find_cuts(df: DataFrame, cls: Column, key: Column, histogram: dict, ranks: dict) -> dict:
    """Key values that cut each class at exact ranks, found by narrowing key ranges.

    ``ranks`` maps (class, name) to a row rank. The result maps it to (key, rows below the rank that
    hold this key, all rows that hold it). Nothing is sorted and no row moves: each step is one
    partially aggregated count over the one key range that still matters.
    """
    at, cuts = {}, {}
    for (c, name), rank in ranks.items():
        at[c, name] = _locate(histogram[c], rank)
    bits = LEVEL_BITS
    while at:
        if bits == KEY_BITS:
            cuts.update({k: (cell, inside, size) for k, (cell, inside, size) in at.items()})
            break
        step = KEY_BITS if max(size for _, _, size in at.values()) <= COLLECT_ROWS else bits + LEVEL_BITS
        wanted = None
        for (c, _), (cell, _, _) in at.items():
            one = cls.eqNullSafe(F.lit(c)) & (_prefix(key, bits) == cell)
            wanted = one if wanted is None else wanted | one
        rows = (
            df.filter(wanted)
            .groupBy(cls.alias("c"), _prefix(key, bits).alias("p"), _prefix(key, step).alias("n"))
            .count()
            .collect()
        )
        finer = {}
        for r in rows:
            finer.setdefault((r["c"], r["p"]), {})[r["n"]] = r["count"]
        at = {k: _locate(finer[k[0], cell], inside) for k, (cell, inside, _) in at.items()}
        bits = step
    return cuts


def split_at_ranks(df: DataFrame, cls: str, key: Column, ranks: dict, histogram: dict, names: list[str]) -> DataFrame:
    """Assign rows to ``names`` in key order, cutting every class at exact ranks.

    ``ranks[class]`` holds the cumulative row counts at which one name ends and the next begins.
    Rows stay where they are: the result is a comparison with a few literals. Only if a cut falls
    between rows of equal key is the row content used as well, and only if it falls between fully
    equal rows are those few kinds of row rebuilt from a count.
    """
    keyed = df.withColumn("_key", key)
    c, k = F.col(cls), F.col("_key")
    wanted = {
        (value, i): rank
        for value, cumulative in ranks.items()
        for i, rank in enumerate(cumulative)
        if 0 < rank < sum(histogram[value].values())
    }
    cuts = find_cuts(keyed, c, k, histogram, wanted)
    inside = {cut: found for cut, found in cuts.items() if found[1]}
    content, ties = None, {}
    if inside:
        content = content_key(df)
        for (value, i), (cell, below, _) in inside.items():
            tied = keyed.filter(c.eqNullSafe(F.lit(value)) & (k == cell))
            start = class_histogram(tied, c, content)
            ties[value, i] = find_cuts(tied, c, content, start, {(value, i): below})[value, i]

    def before(value, i):
        total = sum(histogram[value].values())
        rank = ranks[value][i]
        if rank <= 0 or rank >= total:
            return F.lit(rank >= total)
        cell, _, _ = cuts[value, i]
        test = k < cell
        if (value, i) in ties:
            test = test | ((k == cell) & (content < ties[value, i][0]))
        return test

    assigned = F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        per_class = F.lit(False)
        for value in ranks:
            per_class = F.when(c.eqNullSafe(F.lit(value)), before(value, i)).otherwise(per_class)
        assigned = F.when(per_class, F.lit(names[i])).otherwise(assigned)

    whole = keyed.withColumn("split", assigned)
    equal = {}
    for (value, i), (tie, below, size) in ties.items():
        if below:
            equal.setdefault((value, cuts[value, i][0], tie, size), []).append((i, below))
    for (value, cell, tie, size), places in equal.items():
        same = c.eqNullSafe(F.lit(value)) & (k == cell) & (content == tie)
        whole = whole.filter(~same).unionByName(_copies(keyed, same, size, sorted(places), names))
    return whole.drop("_key")


def _copies(keyed, same, size, places, names):
    """``size`` equal rows, numbered by a distributed range and divided at the given places."""
    row = keyed.filter(same).limit(1).withColumn("_one", F.lit(1))
    numbered = keyed.sparkSession.range(size).select(F.col("id").alias("_n"), F.lit(1).alias("_one"))
    split = F.lit(names[places[-1][0] + 1])
    for i, below in reversed(places):
        split = F.when(F.col("_n") < below, F.lit(names[i])).otherwise(split)
    numbered = numbered.withColumn("split", split)
    return numbered.join(F.broadcast(row), "_one").select(*keyed.columns, "split")


def with_row_index(df: DataFrame, keys: list[Column], name: str = "row_index") -> DataFrame:
    """Dense index from 0 in key order, as a range sort plus one offset per partition.

    The sorted rows are written to the shared folder first: both the offsets and the rows are read
    from there, so a lost executor cannot change one without the other.
    """
    keyed = df.select("*", *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    order = [F.col(f"_k{i}") for i in range(len(keys))] + [F.col("_at")]
    ordered = (
        materialize(keyed.withColumn("_at", F.monotonically_increasing_id()), "index-input")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
        .drop(*[f"_k{i}" for i in range(len(keys))], "_at")
    )
    stored = materialize(ordered, "index-sorted")
    counts = sorted((r["_part"], r["count"]) for r in stored.groupBy("_part").count().collect())
    offsets, start = [], 0
    for part, count in counts:
        offsets.append((part, start))
        start += count
    starts = df.sparkSession.createDataFrame(offsets, "_part int, _start bigint")
    return (
        stored.join(send_if_small(starts, 1_000_000), "_part")
        .withColumn(name, F.col("_start") + F.col("_pos"))
        .drop("_part", "_pos", "_start")
    )
