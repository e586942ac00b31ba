"""Whitening against numpy's eigenvectors of the whole covariance."""
import numpy as np
import pytest

from recordlake.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, n int, component string, v double"


def frame(rows, vectors, ids=None):
    return rows([(i, v, 1, "x", 0.5) for i, v in zip(ids or range(len(vectors)), vectors)], SCHEMA)


def check(df, vectors, most=8, places=1e-9):
    """The rows are those of numpy; the components agree up to sign where deviations are apart."""
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)) + 100000
    n = len(x)
    centred = x - x.sum(axis=0) / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    k = min(most, int((values > 1e-17 * values[0]).sum()), int(np.linalg.matrix_rank(centred)))
    rows = df.collect()
    assert len(rows) == n * k
    got = {(r["vec_id"], r["component"]): r for r in rows}
    whitened = np.array([[got[i, c + 1]["whitened"] for c in range(k)] for i in range(n)])
    for c in range(k):
        assert all(got[i, c + 1]["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-8) for i in range(n))
        gap = min(abs(values[c] - v) for j, v in enumerate(values) if j != c) if len(values) > 1 else values[0]
        if gap > 1e-3 * values[0]:
            want = centred @ vecs[:, c] / np.sqrt(values[c])
            want = want if want @ whitened[:, c] > 0 else -want
            assert np.abs(want - whitened[:, c]).max() < places * max(1, np.abs(want).max())
    assert np.abs(whitened.T @ whitened / n - np.eye(k)).max() < 1e-7
    s = [int(v) for v in x.sum(axis=0)]
    for i in range(n):
        assert int(got[i, 1]["deviation"]) == sum((n * int(v) - t) ** 2 for v, t in zip(x[i], s))
        assert got[i, 1]["n"] == n and got[i, 1]["identity_error"] < 1e-7


def test_spread_spectrum(rows):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 12)) * np.array([30, 20, 15, 11, 8, 5, 3, 2, 1, .5, .2, .1]) + 7).astype(np.float32).tolist()
    check(whitening.whiten(frame(rows, vectors)), vectors)


def test_equal_deviations(rows):
    """Each dimension alone, with the same deviation: every component is a copy of the same value."""
    vectors = [[float(s * (j == i)) for j in range(10)] for i in range(10) for s in (1, -1)] * 3
    check(whitening.whiten(frame(rows, vectors)), vectors)


def test_few_directions(rows):
    rng = np.random.default_rng(2)
    vectors = (np.round(rng.normal(size=(200, 3)) * 8) @ np.round(rng.normal(size=(3, 20)) * 4)).tolist()
    check(whitening.whiten(frame(rows, vectors)), vectors)
    one = [[float(i), 2.0 * i, -float(i)] for i in range(9)]
    check(whitening.whiten(frame(rows, one)), one)
    check(whitening.whiten(frame(rows, [[v[0]] for v in one])), [[v[0]] for v in one])


def test_stops_before_the_full_length(rows):
    """Long vectors with a few strong directions, two of them equal, take fewer passes than dimensions."""
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.normal(size=(600, 90)))[0]
    turn = np.linalg.qr(rng.normal(size=(90, 90)))[0]
    strength = np.array([4000., 4000, 3000, 2500, 2000, 1500, 1200, 1000, 800] + [10.] * 81)
    vectors = ((basis - basis.mean(axis=0)) * strength @ turn).astype(np.float32).tolist()
    df = frame(rows, vectors)
    check(whitening.whiten(df), vectors, places=1e-8)
    assert whitening.fit(df).passes < 80


def test_odd_rows(rows):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(40, 5)).astype(np.float32).tolist()
    vectors += vectors[:3] * 5
    good = frame(rows, vectors)
    odd = frame(rows, [None, [None] * 5, [float("nan")] + [0.0] * 4, [0.0] * 4 + [float("inf")], [], [1.0] * 4], list(range(900, 906)))
    check(whitening.whiten(good.unionByName(odd)), vectors)
    nameless = frame(rows, vectors[:1], [None])
    assert whitening.whiten(good.unionByName(nameless)).where("vec_id is null").count() == 5
    assert whitening.whiten(good.limit(0)).count() == 0
    assert whitening.whiten(frame(rows, [[1.0, 2.0]] * 7)).count() == 0
    assert whitening.whiten(odd.where("vec_id < 905")).count() == 0
    huge = whitening.whiten(frame(rows, [[3e38, 1.0], [-3e38, 2.0], [0.0, 3.0]])).collect()
    assert {r["vec_id"] for r in huge} == {0, 1, 2}


def test_exact_sums_beyond_64_bits():
    x = np.array([[2 ** 33 + 1, -5], [7, 2 ** 34]])
    got = [int(v) for v in whitening._squares(x, 10 ** 6, [3, 9]).to_pylist()]
    assert got == [sum((10 ** 6 * int(v) - s) ** 2 for v, s in zip(row, (3, 9))) for row in x]
    assert whitening._squares(np.array([[2 ** 61]]), 10 ** 9, [0]).to_pylist() == [None]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").where("embedding is not null").collect()
    kept = [(r["vec_id"], r["embedding"]) for r in table if all(v is not None and np.isfinite(v) for v in r["embedding"])]
    out = queries.op12(spark, folder)
    assert dict(out.dtypes)["deviation"] == "bigint" and out.count() == 8 * len(kept)
    place = {i: n for n, (i, _) in enumerate(kept)}
    renamed = out.sparkSession.createDataFrame([(place[r["vec_id"]], *r[1:]) for r in out.collect()], out.schema)
    check(renamed, [v for _, v in kept], places=1e-8)
