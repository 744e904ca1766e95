import math
from fractions import Fraction

import numpy as np
import pytest

from scriptorium.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long, component string, x int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "c", 2) for i, v in rows], SCHEMA)


def definition(rows, components=16):
    """{vec_id: (n, deviation, |whitened|, explained)} with exact sums."""
    kept = [(i, [math.floor(float(np.float32(c)) * 64) + 1_000_000 for c in v]) for i, v in rows]
    once = sorted({tuple(x) for _, x in kept})
    n, sums = len(once), [sum(c) for c in zip(*once)]
    y = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in once])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > len(e) * 2.3e-16 * e.sum()).sum()))
    out = []
    for i, x in kept:
        far = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        w = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)]) @ u[:, :k] / np.sqrt(e[:k])
        out += [(i, c + 1, n, far, w[c], e[c] / e.sum()) for c in range(k)]
    return out


def compare(got, want):
    """Each component may have either sign, the same for all rows; and stays the same for equal rows."""
    key = lambda r: (r[0], r[1], abs(round(r[4], 6)))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for c in {r[1] for r in want}:
        a, b = np.array([r[4] for r in got if r[1] == c]), np.array([r[4] for r in want if r[1] == c])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9)


COLUMNS = ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact")


def rows_of(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


@pytest.mark.parametrize("kind", ["flat", "steep"])
def test_equals_the_definition(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 40))
    if kind == "steep":
        x = x * np.where(np.arange(40) < 18, 30 * 0.8 ** np.arange(40), 1e-3) @ np.linalg.qr(rng.normal(size=(40, 40)))[0]
    x[::7] = x[3]
    rows = list(enumerate(x))
    got = rows_of(whitening.whiten(frame(spark, rows)))
    compare(got, definition(rows))
    assert {r[6] for r in got} == {got[0][6]} and got[0][6] < 1e-9 and all(r[7] == r[3] for r in got)


def test_the_block_grows_only_where_residuals_fail(spark):
    rng = np.random.default_rng(5)
    flat = rng.normal(size=(2000, 40)) * 100
    steep = flat * np.where(np.arange(40) < 6, 0.5 ** np.arange(40), 1e-6)
    for x, full in ((flat, True), (np.round(steep * 64) * 1000, False)):
        distinct = spark.createDataFrame([(np.floor(v).astype(int).tolist(),) for v in x], "x array<long>")
        got = whitening.fit(distinct, components=4)
        assert got.full is full
        c = np.floor(x) - np.floor(x).mean(0)
        e, u = np.linalg.eigh(c.T @ c / len(c))
        assert got.values == pytest.approx(e[::-1][:4], rel=1e-10)
        assert np.abs(np.abs((u[:, ::-1][:, :4] * got.components).sum(0)) - 1).max() < 1e-12


def test_odd_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 4))
    good = [*enumerate(x), (None, x[2]), (3, x[4]), (99, [0.0] * 4)]
    bad = [(50, None), (51, []), (52, [1.0, None, 1.0, 1.0]), (53, [float("nan")] * 4), (54, [float("inf"), 1.0, 1.0, 1.0]), (55, [1.0] * 3), (56, [1e20, 0.0, 0.0, 0.0])]
    got = rows_of(whitening.whiten(frame(spark, good + bad)))
    compare([(-1 if r[0] is None else r[0], *r[1:]) for r in got], [(-1 if r[0] is None else r[0], *r[1:]) for r in definition(good)])
    assert len(got) == 33 * 4
    for none in ([], bad, [(1, x[0])], [(1, x[0]), (2, x[0])]):
        assert whitening.whiten(frame(spark, none)).count() == 0
    line = [(k, [float(k), 2.0 * k, 5.0]) for k in range(9)]
    assert {r[1] for r in rows_of(whitening.whiten(frame(spark, line)))} == {1}


def test_wide_numbers_stay_exact():
    out = whitening.Fit(10**9, [3 * 10**15, -7], 0)
    x = np.array([[5_000_000, 2], [0, 0]])
    assert whitening.deviation(out, x) == [(10**9 * 5_000_000 - 3 * 10**15) ** 2 + (2 * 10**9 + 7) ** 2, 9 * 10**30 + 49]
    assert out.centred(x)[0, 0] == 2_000_000.0
