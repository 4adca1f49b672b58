"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance V of the rows are found without forming V: a block Q of vectors is
put through a polynomial in V, by its three-term recurrence, one distributed pass over the centred rows for each
degree (every task adds up Xc' Xc Q over its own rows). The polynomial is small on the unwanted spectrum, from 0
to the smallest Ritz value of the block, and grows fast above it. Then come QR and Rayleigh-Ritz. This ends when
the residual of every wanted pair is at the level of rounding; otherwise an error says how far it came.

A component ``c`` counts as the integer floor(scale * c) + shift, so sums over rows and deviations are exact.
Rows whose vector is null or has a null, NaN or infinite entry are left out. The rest must have one length, else
there is an error. Eigenvalues that are zero up to rounding (equal rows, fewer rows than components) have no
whitened values, so such components are left out; so no rows come from an empty table or from equal vectors.
Rows with a null or repeated id are rows of their own. Other columns are left alone. Equal eigenvalues have no
own direction: any basis of their space may be returned. A deviation above the range of a long is an error.

The driver holds matrices of dimensions x block; a pass has a bounded number of tasks, whatever the rows.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import materialize

COMPONENTS, GUARD, DEGREE, ROUNDS = 8, 16, 8, 60
SCALE, SHIFT = 1024, 100_000
# Residual, in parts of the largest eigenvalue, that rounding allows; and what is accepted when it falls no further.
TIGHT, ENOUGH = 2e-15, 1e-11
TASKS_A_CORE = 2


@dataclass(frozen=True)
class Whitening:
    """What a fit has found; ``directions`` has one column for each component."""

    n: int
    sums: tuple
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    residual: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def usable(vectors: DataFrame, key: str, vector: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(_key, x) of the rows that take part, stored."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    v = F.col(vector).cast("array<double>")
    whole = F.transform(v, lambda c: F.floor(c * scale).cast("bigint") + shift)
    kept = vectors.filter(F.col(vector).isNotNull()).filter(~F.exists(v, bad))
    return materialize(kept.select(F.col(key).alias("_key"), whole.alias("x")), "whitening-rows")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _add_up(rows: DataFrame, of_batch, kind: str) -> list:
    """Sums over all rows of the arrays that ``of_batch`` makes of a batch, one partial sum for each task."""

    def part(batches):
        total = None
        for batch in batches:
            if len(batch):
                made = of_batch(batch)
                total = made if total is None else total + made
        if total is not None:
            flat = pa.array(total.ravel())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)], ["part"])

    # So many tasks at most, and so many partial sums on the driver, however large the table is.
    few = rows.coalesce(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism)
    return [r["part"] for r in few.mapInArrow(part, f"part array<{kind}>").collect()]


def _sums(rows: DataFrame, d: int) -> list[int]:
    """Exact sums for each dimension."""
    # Halves keep a task's partial sums inside a long for any number of rows it can have.
    halves = lambda batch: np.stack([(x := _matrix(batch)) >> 32, x & 0xFFFFFFFF]).sum(1)
    parts = _add_up(rows.select("x"), halves, "bigint")
    return [sum((p[i] << 32) + p[d + i] for p in parts) for i in range(d)]


def fit(rows: DataFrame, components: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE, rounds: int = ROUNDS) -> Whitening | None:
    """The leading eigenpairs of the covariance of rows (x); None if there are no rows."""
    shape = rows.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    n, d = shape["n"], shape["high"]
    if not n or not d:
        return None
    if shape["low"] != d:
        raise ValueError(f"vectors of {shape['low']} to {d} components have no common covariance")
    sums = _sums(rows, d)
    mean = np.array([s / n for s in sums])
    x_only = rows.select("x")
    passes = 0

    def times(q: np.ndarray) -> np.ndarray:
        """V q by one pass over the centred rows."""
        nonlocal passes
        passes += 1

        def product(batch):
            centred = _matrix(batch) - mean
            return centred.T @ (centred @ q)

        return np.array(_add_up(x_only, product, "double")).sum(0).reshape(q.shape) / n

    trace = float(np.array(_add_up(x_only, lambda b: np.array([np.square(_matrix(b) - mean).sum()]), "double")).sum() / n)
    if trace == 0:
        return Whitening(n, tuple(sums), np.empty((d, 0)), np.empty(0), 0.0, 0.0, passes)
    width = min(d, components + guard)
    wanted = min(d, components)
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((d, width)))[0]
    image = times(q)
    last = np.inf
    for _ in range(rounds):
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        off = np.linalg.norm(image - q * values, axis=0)[:wanted]
        worst = float((off / values[0]).max())
        # At the level of rounding, or no longer falling.
        if worst <= TIGHT or (worst <= ENOUGH and worst > last / 4):
            break
        last = worst
        if width == d:
            # The block spans everything: another step of the plain iteration only cleans up.
            q = np.linalg.qr(q)[0]
        else:
            q = np.linalg.qr(_filtered(times, q, image, max(float(values[-1]), values[0] * 1e-12), float(values[0]), degree))[0]
        image = times(q)
    else:
        raise ArithmeticError(f"residual {last:.3g} of the largest eigenvalue after {rounds} rounds")
    real = values[:wanted] > values[0] * d * np.finfo(float).eps
    keep = np.flatnonzero(real)
    return Whitening(n, tuple(sums), q[:, keep], values[keep], trace, worst, passes)


def _filtered(times, q: np.ndarray, image: np.ndarray, edge: float, top: float, degree: int) -> np.ndarray:
    """The scaled Chebyshev polynomial in V that stays small on [0, edge], applied to q; ``image`` is V q."""
    half = edge / 2
    sigma = first = half / max(top - half, half)
    before, now = q, (image - half * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, 2 * (after / half) * (times(now) - half * now) - (sigma * after) * before
        sigma = after
    return now


def apply(rows: DataFrame, found: Whitening) -> DataFrame:
    """(_key, component, deviation, whitened) for every row and component."""
    spark = rows.sparkSession
    kind = rows.schema["_key"]
    schema = T.StructType(
        [T.StructField("_key", kind.dataType), T.StructField("component", T.IntegerType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType())]
    )
    n, sums, mean = found.n, found.sums, found.mean
    axes = found.directions / np.sqrt(found.eigenvalues)
    k = axes.shape[1]
    if k == 0:
        return spark.createDataFrame([], schema)

    def transform(batches):
        exact = np.array(sums, object)
        for batch in batches:
            x = _matrix(batch)
            low, high = (np.abs(x.min(initial=0)), np.abs(x.max(initial=0)))
            most = n * int(max(low, high)) + max(abs(s) for s in sums)
            # In longs where nothing can overflow, else in Python's integers.
            if most * most * x.shape[1] < 1 << 63:
                deviation = np.square(n * x - np.array(sums, np.int64)).sum(1)
            else:
                deviation = [int(v) for v in np.square(n * x.astype(object) - exact).sum(1)]
                if any(v >= 1 << 63 for v in deviation):
                    raise OverflowError("a deviation is too large for a long")
            white = (x - mean) @ axes
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key").take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.repeat(np.array(deviation, np.int64), k)), pa.array(white.ravel()),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(transform, schema)


def identity_error(rows: DataFrame, found: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    mean, axes = found.mean, found.directions / np.sqrt(found.eigenvalues)
    k = axes.shape[1]
    if k == 0:
        return 0.0
    # Whitened values are centred on their own mean before they are multiplied.
    middle = np.array(_add_up(rows.select("x"), lambda b: ((_matrix(b) - mean) @ axes).sum(0), "double")).sum(0) / found.n

    def product(batch):
        w = (_matrix(batch) - mean) @ axes - middle
        return w.T @ w

    total = np.array(_add_up(rows.select("x"), product, "double")).sum(0).reshape(k, k)
    return float(np.abs(total / found.n - np.eye(k)).max())


def op11_whitening(embeddings: DataFrame) -> DataFrame:
    rows = usable(embeddings.select("vec_id", "embedding"), "vec_id", "embedding")
    found = fit(rows)
    if found is None:
        found = Whitening(1, (), np.empty((0, 0)), np.empty(0), 1.0, 0.0, 0)
    error = identity_error(rows, found)
    # One list for all rows; a literal, as there are at most COMPONENTS values.
    shares = F.array(*[F.lit(float(e / found.trace)) for e in found.eigenvalues]) if len(found.eigenvalues) else F.array(F.lit(0.0))
    return apply(rows, found).select(
        F.col("_key").alias("vec_id"), "component", F.lit(found.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("component")).alias("explained"), F.lit(error).alias("identity_error"),
    )
