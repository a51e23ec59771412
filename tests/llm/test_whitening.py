"""Whitening against the eigenvectors of the whole covariance."""

import numpy as np
import pytest

from oodspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x int, component string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], SCHEMA).repartition(5)


def plain(rows, wanted=4):
    """(id, component) -> n, deviation, whitened, explained of rows of one length; components are those of the covariance."""
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in v] for _, v in rows], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:wanted], u[:, ::-1][:, :wanted]
    u = u * np.sign(u[np.abs(u).argmax(axis=0), range(u.shape[1])])
    white = (x - sums / n) @ u / np.sqrt(e)
    far = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return [(i, c + 1, n, far[r], white[r, c], e[c] / np.trace(centred.T @ centred / n)) for r, (i, _) in enumerate(rows) for c in range(len(e))]


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], round(r[4], 5))
    got = sorted((tuple(r) for r in got), key=key)
    want = sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4:6] for r in got], [r[4:] for r in want], rtol=1e-8, atol=1e-10)
    assert max(r[6] for r in got) < 1e-10 and len({r[6] for r in got}) == 1


@pytest.mark.parametrize("kind", ["close", "clusters", "narrow"])
def test_whitening(spark, kind):
    """Close eigenvalues, far ones, and fewer dimensions than the block; bad, repeated and null-id rows."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 9 if kind == "narrow" else 40)) * 0.1
    if kind == "clusters":
        v += rng.normal(size=(5, 40))[rng.integers(0, 5, 400)] * 3 + 7
    rows = [(i, [float(c) for c in row]) for i, row in enumerate(v)]
    rows += [rows[0], rows[1], (None, rows[2][1]), (7, rows[30][1])]
    d = v.shape[1]
    bad = [(900, None), (901, [*rows[0][1][1:], None]), (902, [*rows[0][1][1:], float("nan")]), (903, [*rows[0][1][1:], float("inf")]), (904, [])]
    same(whitening.whitened(frame(spark, rows + bad)).collect(), plain(rows))
    if kind == "clusters":
        other = [(1000 + i, [float(c) for c in row]) for i, row in enumerate(rng.normal(size=(30, 3)))]
        got = whitening.whitened(frame(spark, rows + other)).collect()
        same([r for r in got if r["vec_id"] is None or r["vec_id"] < 1000], plain(rows))
        same([r for r in got if r["vec_id"] is not None and r["vec_id"] >= 1000], plain(other))
    assert d in (9, 40)


def test_little(spark):
    assert whitening.whitened(frame(spark, [])).count() == 0
    one = whitening.whitened(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in one) == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    line = whitening.whitened(frame(spark, [(i, [float(i), 2.0 * i, 3.0]) for i in range(5)])).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True), (3, True)}
    assert all(abs(r["explained"] - (r["component"] == 1)) < 1e-12 for r in line)


def test_large_numbers(spark):
    """Sums and deviations beyond 64 bits are exact; beyond 38 digits the deviation is null."""
    rows = [(i, [2.0**40 * (i + 1), -(2.0**45)]) for i in range(6)] + [(9, [2.0**42 + 2.0**30, 2.0**44])]
    got = whitening.whitened(frame(spark, rows)).collect()
    want = {(r[0], r[1]): r[3] for r in plain(rows)}
    assert {(r["vec_id"], r["component"]): int(r["deviation"]) for r in got} == want and max(want.values()) > 2**63
    huge = whitening.whitened(frame(spark, [(1, [3e30, 1.0]), (2, [-3e30, 2.0])])).collect()
    assert all(r["deviation"] is None or r["deviation"] >= 2**63 for r in huge) and len(huge) == 4


def test_components():
    """The filter finds the top of spectra with and without gaps, and of equal values a basis of their space."""
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(80, 80)))
    for spectrum in (np.linspace(1, 2, 80), 0.5 ** np.arange(80), np.r_[np.zeros(70), np.arange(1, 11)], np.r_[np.ones(77), 3, 3, 5]):
        v = q * spectrum @ q.T
        jobs = []
        e, u = whitening.components(lambda y, v=v: jobs.append(1) or v @ y, 80, 3)
        assert np.allclose(e, np.sort(spectrum)[::-1][:3], rtol=1e-12) and len(jobs) < 120
        assert np.allclose(v @ u, u * e, atol=1e-11 * e[0]) and np.allclose(u.T @ u, np.eye(3), atol=1e-13)
