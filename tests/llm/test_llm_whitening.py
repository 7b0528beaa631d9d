"""Whitening against a full eigendecomposition, exact sums and odd vectors."""

import numpy as np
import pytest

from sparkevidence.llm import whitening
from sparkevidence.llm.catalog import QUERIES


def plain(rows, scale):
    """{(vec_id, place): (n, deviation, [|whitened|])} and the explained shares, by numpy's eigh."""
    lengths = {}
    usable = []
    for i, v in rows:
        if v and all(c is not None and np.isfinite(c) and abs(c * scale) < 2**53 for c in v):
            usable.append((i, [int(np.floor(np.float64(c) * scale)) for c in v]))
            lengths[len(v)] = lengths.get(len(v), 0) + 1
    length = min(lengths, key=lambda n: (-lengths[n], n)) if lengths else 0
    usable = [(i, x) for i, x in usable if len(x) == length]
    fit = sorted({tuple(x) for _, x in usable})
    n = len(fit)
    sums = [sum(col) for col in zip(*fit)]
    c = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit], dtype=float).reshape(n, -1)
    cov = c.T @ c / max(n, 1)
    values, axes = np.linalg.eigh(cov) if n else (np.empty(0), np.empty((0, 0)))
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    keep = values > 1e-12 * max(values, default=0)
    values, axes = values[keep], axes[:, keep]
    out = []
    for i, x in usable:
        diff = [n * a - s for a, s in zip(x, sums)]
        white = (np.array(diff) / n) @ axes / np.sqrt(values)
        out += [(i, k + 1, n, sum(a * a for a in diff), w, e) for k, (w, e) in enumerate(zip(white, values / np.trace(cov)))]
    return out


def check(got, rows, scale):
    want = plain(rows, scale)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3] or 0, abs(r[4]))
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == [r[3] if r[3] < 2**63 else None for r in want]
    for number in {r[1] for r in want}:
        a = np.array([r[4] for r in got if r[1] == number])
        b = np.array([r[4] for r in want if r[1] == number])
        flip = np.sign(a @ b)
        assert np.allclose(a * flip, b, rtol=1e-7, atol=1e-7)
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert all(r[6] < 1e-9 for r in got)


def run(spark, rows, scale=256, parts=3):
    extra = "n int, x string, data long"
    frame = spark.createDataFrame([(*r, 1, "a", 2) for r in rows], f"vec_id long, embedding array<double>, {extra}")
    vectors = whitening.integer_vectors(frame.repartition(parts), scale)
    return whitening.whiten(vectors, whitening.fit_whitening(vectors)).collect()


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(QUERIES["op12_whitening"](spark, sf_dir).collect(), rows, 256)


def test_odd_vectors(spark):
    rnd = np.random.default_rng(7)
    stretch = np.array([5, 4, 3, 2, 1, 0.5])
    rows = [(i, (rnd.standard_normal(6) * stretch + 100).tolist()) for i in range(200)]
    rows += [(3, rows[5][1])] * 400 + [(None, rows[6][1]), (500, None), (501, []), (502, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    rows += [(503, [float("nan"), *[0.0] * 5]), (504, [float("inf")] * 6), (505, [1.0, 2.0]), (506, [1e300] * 6)]
    rows += [(507, [-0.0] * 6), (508, [0.0] * 6)]
    check(run(spark, rows), rows, 256)


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [float(2**44 + i * i), float(-(2**43) * (i % 3))]) for i in range(9)]
    got = run(spark, rows)
    exact = {(r[0], r[1]): r[3] for r in plain(rows, 256)}
    assert [r.deviation for r in got] == [d if (d := exact[r.vec_id, r.component]) < 2**63 else None for r in got]
    assert None in {r.deviation for r in got} and len({r.deviation for r in got}) > 1
    assert all(np.isfinite(r.whitened) and r.identity_error < 1e-6 for r in got)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_nothing_to_whiten(spark, rows):
    assert run(spark, rows) == []


def test_few_dimensions_and_low_rank(spark):
    rnd = np.random.default_rng(8)
    line = [(i, [float(t), float(2 * t), 0.0]) for i, t in enumerate(rnd.integers(-50, 50, 40))]
    got = run(spark, line, scale=1)
    assert {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12
    one = [(i, [float(i)]) for i in range(5)]
    check(run(spark, one), one, 256)


@pytest.mark.parametrize("kind", ["close", "tied", "tied beyond the block", "falling"])
def test_filter_finds_the_leading_pairs(kind):
    rnd = np.random.default_rng(9)
    d = 90
    values = {
        "close": np.linspace(1.5, 0.5, d),
        "tied": np.r_[np.full(3, 2.0), np.linspace(1.9, 0.1, d - 3)],
        "tied beyond the block": np.r_[np.full(40, 2.0), np.linspace(1.8, 0.0, d - 40)],
        "falling": 0.5 ** np.arange(d),
    }[kind]
    q = np.linalg.qr(rnd.standard_normal((d, d)))[0]
    v = (q * values) @ q.T
    found, axes = whitening.leading_pairs(lambda x: v @ x, d, 4)
    assert np.allclose(found, values[:4], rtol=1e-12)
    assert np.abs(v @ axes - axes * found).max() < 1e-11
    assert np.allclose(axes.T @ axes, np.eye(4), atol=1e-12)
