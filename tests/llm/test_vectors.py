"""Whitening against a full eigensolver, hard negatives against brute force."""

import math

import numpy as np
import pytest

from winnowry.llm import hard_negatives, whitening

SMALL = "/root/testdata/sf0.001"
BAD = [(900, None, 1), (901, [1.0, None, 2.0, 0.5], 2), (902, [float("nan"), 1.0, 2.0, 3.0], 1), (903, [1.0, float("inf"), 0.0, 0.0], 1)]
KIND = "vec_id bigint, embedding array<double>, label int, n int, x string, _key string, r int"


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], KIND)


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SMALL}/embeddings.parquet")


def usable(rows):
    return [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]


def check_whitening(df, rows, most=8):
    """Rows of the query against numpy's eigensolver on the same integers."""
    ids = [r[0] for r in usable(rows)]
    x = np.array([[math.floor(1024 * float(np.float64(c))) + 100000 for c in r[1]] for r in usable(rows)], np.int64)
    n, sums = len(x), x.sum(0)
    deviation = np.square(n * x.astype(object) - sums.astype(object)).sum(1)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    real = values > 1e-12 * values[0]
    white = centred @ axes[:, real] / np.sqrt(values[real])
    got = df.collect()
    k = int(real.sum())
    assert len(got) == n * k and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-8
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append((r["vec_id"], r["deviation"], r["whitened"]))
        assert abs(r["explained"] / (values[r["component"] - 1] / np.trace(centred.T @ centred / n)) - 1) < 1e-9
    for c in range(1, k + 1):
        want = sorted(((i is not None, i or 0, int(d)), w) for i, d, w in zip(ids, deviation, white[:, c - 1], strict=True))
        have = sorted(((i is not None, i or 0, d), w) for i, d, w in by[c])
        assert [w[0] for w in want] == [h[0] for h in have]
        a, b = np.array([w[1] for w in want]), np.array([h[1] for h in have])
        sign = np.sign(a @ b)
        # Equal ids with equal deviations stand in any order.
        assert np.abs(np.sort(a) - np.sort(sign * b)).max() < 1e-7
        if len(set(ids)) == n:
            assert np.abs(a - sign * b).max() < 1e-7


def test_whitening_of_the_table(vectors):
    check_whitening(whitening.op11_whitening(vectors), [(r["vec_id"], r["embedding"]) for r in vectors.collect()])


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=4) * (1, 3, 2, 0.5)], i % 3) for i in range(40)]
    rows += [rows[0], rows[1], (None, [5.0, 1.0, -2.0, 0.25], None), *BAD]
    check_whitening(whitening.op11_whitening(made(spark, rows)), rows)
    # No spread, no rows, no spectrum: nothing to whiten with.
    assert whitening.op11_whitening(made(spark, [(1, [1.0, 2.0], 0)] * 3)).count() == 0
    assert whitening.op11_whitening(made(spark, rows).limit(0)).count() == 0
    assert whitening.op11_whitening(made(spark, BAD)).count() == 0
    # Three rows span two directions.
    assert {r["component"] for r in whitening.op11_whitening(made(spark, rows[:3])).collect()} == {1, 2}
    with pytest.raises(ValueError):
        whitening.op11_whitening(made(spark, [(1, [1.0], 0), (2, [1.0, 2.0], 0)]))


def test_whitening_with_close_eigenvalues(spark):
    rng = np.random.default_rng(5)
    spread = np.append(np.linspace(1.02, 1.0, 12), np.full(28, 0.97))
    rows = [(i, [float(v) for v in rng.normal(size=40) * spread], 0) for i in range(600)]
    df = made(spark, rows)
    found = whitening.fit(whitening.usable(df, "vec_id", "embedding"))
    assert found.residual <= whitening.ENOUGH and found.passes < 300
    check_whitening(whitening.op11_whitening(df), rows)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(i * 10**7), 0.0, 1.0], 0) for i in range(5)]
    with pytest.raises(Exception, match="too large for a long"):
        whitening.op11_whitening(made(spark, rows)).collect()


def brute(rows):
    rows = [(i, (l + 1) % 10 if i is not None and i % 7 == 0 else l, np.array([math.floor(256 * float(c)) for c in v], np.int64)) for i, v, l in usable(rows) if l is not None]
    late = lambda i: (i is None, i or 0)
    out = []
    for a, (i, label, x) in enumerate(rows):
        if i is None or i % 100:
            continue
        scored = sorted(((-int(x @ y), late(j), j, m) for b, (j, m, y) in enumerate(rows) if b != a))
        for p in [s for s in scored if s[3] == label][:5]:
            window = [s for s in scored if s[3] != label and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0]]
            out += [(i, p[2], r + 1, s[2], -p[0], -s[0]) for r, s in enumerate(window[:10])]
    return sorted(out, key=repr)


def shown(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_hard_negatives_of_the_table(vectors):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in vectors.collect()]
    got = shown(hard_negatives.op12_hard_negatives(vectors))
    assert got == brute(rows) and len(got) > 100


def test_hard_negatives_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.integers(-3, 4, 4) / 2], int(i % 3)) for i in range(0, 420, 3)]
    # A crowd of equal vectors, repeated and null ids, a zero anchor, rows without label.
    rows += [(1000 + i, [1.0, 0.5, 0.0, -0.5], i % 2) for i in range(60)] + [(300, [1.0, 1.0, 0.0, 0.0], 0), (500, [0.0] * 4, 1), (501, [1.0] * 4, None)]
    rows += [(None, [1.0, 1.0, 0.5, 0.5], 1), (None, [0.5, 1.0, 0.5, 0.5], 0), (800, [-1.0, 2.0, 1.0, 0.5], 7), *BAD]
    df = made(spark, rows)
    want = brute(rows)
    assert shown(hard_negatives.op12_hard_negatives(df)) == want and len(want) > 50
    # The same through many small blocks.
    held = hard_negatives.usable(df, "vec_id", "embedding", hard_negatives.F.when(hard_negatives.F.col("vec_id") % 7 == 0, (hard_negatives.F.col("label") + 1) % 10).otherwise(hard_negatives.F.col("label")))
    assert shown(hard_negatives.mine(held, held.filter("id % 100 = 0"), 20, 2)) == want
    assert hard_negatives.op12_hard_negatives(df.limit(0)).count() == 0
    assert hard_negatives.op12_hard_negatives(made(spark, BAD)).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.op12_hard_negatives(made(spark, [(100, [1.0], 0), (2, [1.0, 2.0], 0)]))


def test_reading_stops_early():
    rng = np.random.default_rng(6)
    x = rng.integers(-20, 21, (4000, 3))
    x[7] = (500, -400, 300)
    row = {"n": 4000, "r": np.arange(4000).tobytes(), "id": np.arange(4000).tobytes(), "known": np.ones(4000, bool).tobytes(), "label": np.zeros(4000, "<i8").tobytes(),
           "x": x.astype("<i8").tobytes(), "lists": np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype("<i4")).tobytes()}
    read = []
    fits = lambda rows: read.append(len(rows)) or np.ones(len(rows), bool)
    (rows, scores), = hard_negatives.search(hard_negatives._Block(row), np.array([2, -1, 1]), fits, [(0, 10**6)], 1)
    assert list(rows) == [7] and list(scores) == [1700] and sum(read) < 400
