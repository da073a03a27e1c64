"""Whitening and hard negatives against plain numpy and SQL, on given and on awkward vectors."""

import duckdb
import numpy as np
import pytest

from barwright.llm import negatives, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, whitened string, component string, cell string, _row string"


def awkward(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, v, y, 1, "x", "x", "x", "x") for i, v, y in rows], SCHEMA)
    df.coalesce(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, non-finite and missing entries, another length, repeated rows, ties, null ids and labels, a vector that a third of the rows share."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.4, 6)], int(rng.integers(0, 3))) for i in range(400)]
    hot = rows[7][1]
    rows += [(1000 + i, hot, i % 3) for i in range(250)]
    rows += [rows[100], rows[100], rows[205], (None, hot, 1), (None, rows[3][1], 2), (500, rows[100][1], None)]
    rows += [(501, None, 1), (502, [], 1), (503, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (504, [float("nan")] * 6, 1), (505, [float("inf")] * 6, 1), (506, [0.1] * 4, 1)]
    return awkward(spark, tmp_path_factory.mktemp("vec"), rows)


def usable(spark, sf, width):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    return [(i, np.array(v, float), y) for i, v, y in rows if v and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]


def check_whitening(spark, sf, width):
    out = whitening.query(spark, sf).toPandas()
    rows = usable(spark, sf, width)
    x = np.floor(64 * np.stack([v for _, v, _ in rows])).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, sums, k = len(u), u.sum(axis=0), min(16, width)
    c = (n * u - sums) / n
    cov = c.T @ c / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    assert len(out) == k * len(rows) and set(out.n) == {n} and (out.identity_error <= 1e-9).all()
    key = lambda i: -1 if i is None or i != i else int(i)
    want = sorted((key(i), int(((n * r - sums) ** 2).sum()), *np.round(np.abs((r - sums / n) @ vectors / np.sqrt(values)), 7)) for (i, _, _), r in zip(rows, x))
    wide = out.assign(at=np.arange(len(out)) // k).pivot(index="at", columns="component", values="whitened")
    first = out[out.component == 1]
    got = sorted((key(i), d, *np.round(np.abs(w), 7)) for i, d, w in zip(first.vec_id, first.deviation, wide.to_numpy()))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    np.testing.assert_allclose(np.array(got)[:, 2:], np.array(want)[:, 2:], atol=1e-6)
    # one sign for all rows: products of two components agree up to one sign
    plain = {(key(i), *r): (r - sums / n) @ vectors / np.sqrt(values) for (i, _, _), r in zip(rows, x)}
    by_id = {key(i): w for i, w in zip(first.vec_id, wide.to_numpy())}
    once = [i for i in by_id if sum(key(j) == i for j, _, _ in rows) == 1]
    z = np.stack([next(v for q, v in plain.items() if q[0] == i) for i in once])
    w = np.stack([by_id[i] for i in once])
    np.testing.assert_allclose(w * np.sign((w * z).sum(axis=0)), z, atol=1e-6)
    np.testing.assert_allclose(out[out.component <= k].groupby("component").explained.first(), values / np.trace(cov), rtol=1e-8)


def test_whitening(spark, sf, odd):
    check_whitening(spark, sf, 64)
    check_whitening(spark, odd, 6)


def test_whitening_of_little(spark, tmp_path):
    """No rows; one vector many times; dimensions without variance; deviations beyond a long."""
    rows = {"none": [], "one": [(i, [0.5, 0.25], 0) for i in range(5)], "flat": [(i, [0.1 * i, 3.0, 3.0], 0) for i in range(20)], "far": [(i, [1e30 * (-1) ** i, 0.1 * i], 0) for i in range(9)]}
    got = {k: whitening.query(spark, awkward(spark, tmp_path / k, v)).collect() for k, v in rows.items()}
    assert got["none"] == []
    assert len(got["one"]) == 10 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None for r in got["one"])
    assert all((r.whitened is None) == (r.component > 1) for r in got["flat"]) and abs(sum(r.whitened for r in got["flat"] if r.component == 1)) < 1e-9
    assert len(got["far"]) == 18 and all(r.deviation is None for r in got["far"])


def test_jacobi_davidson_on_spread_and_equal_values():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(200, 200)))[0]
    values = np.concatenate([[9.0, 4.0, 4.0, 4.0, 1.0], np.linspace(0.9, 0.001, 195)])
    m = (q * values) @ q.T
    calls = []
    got, vectors = whitening.jacobi_davidson(lambda z: calls.append(z.shape[1]) or m @ z, 200, 10)
    np.testing.assert_allclose(got, values[:10], rtol=1e-12)
    assert np.abs(m @ vectors - vectors * got).max() < 1e-13 * 9 * 64 and np.abs(vectors.T @ vectors - np.eye(10)).max() < 1e-12


def test_sums_over_many_tasks(spark):
    """Partial sums meet in a tree once there are more than FAN of them."""
    df = spark.range(0, 3000, 1, 200).selectExpr("array(id, id * id) AS x")
    blocks = whitening.pack(df, 2)
    assert list(whitening.add_up(blocks, 200, 2, lambda x: x.sum(axis=0), np.int64)) == [sum(range(3000)), sum(i * i for i in range(3000))]


def plain_negatives(rows):
    """By the definition, over rows as they come: repeated rows are rows of their own."""
    data = [(i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, np.floor(256 * v).astype(np.int64)) for i, v, y in rows if y is not None]
    order = lambda s, i: (-s, i is None, i or 0)
    out = []
    for a, (i, y, v) in enumerate(data):
        if i is None or i % 100:
            continue
        scores = [(int(v @ w), j, z, b) for b, (j, z, w) in enumerate(data) if b != a]
        for p, pid, _, _ in sorted((s for s in scores if s[2] == y), key=lambda s: order(s[0], s[1]))[:5]:
            hard = sorted((s for s in scores if s[2] != y and 80 * p <= 100 * s[0] <= 100 * p), key=lambda s: order(s[0], s[1]))[:5]
            out += [(i, pid, r, s[1], p, s[0]) for r, s in enumerate(hard, 1)]
    return sorted(out, key=repr)


def test_negatives(spark, sf, odd, tmp_path, monkeypatch):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(tuple(r) for r in negatives.query(spark, sf).collect()) == sorted(con.execute(negatives.SQL).fetchall())
    assert negatives.query(spark, awkward(spark, tmp_path / "none", [])).count() == 0
    assert negatives.query(spark, awkward(spark, tmp_path / "one", [(i, [0.1, 0.2], 3) for i in (1, 2, 100)])).count() == 0
    # many small blocks, small chunks and small quotas: several rounds
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "QUOTA", 20)
    monkeypatch.setattr(negatives, "CHUNK", 2)
    got = sorted((tuple(r) for r in negatives.query(spark, odd).collect()), key=repr)
    assert got == plain_negatives([(i, v, y) for i, v, y in usable(spark, odd, 6)])


def test_cells_are_visited_by_falling_bounds_that_hold():
    rng = np.random.default_rng(2)
    m = rng.normal(0, 50, (600, 8)).round()
    cells = negatives.Cells(m, len(m))
    cell, r1, r2 = cells.of(m)
    cells.lay_out([(int(c), int((cell == c).sum()), r1[cell == c].max(), r2[cell == c].max()) for c in np.unique(cell)])
    u1, u2 = cells.bounds(m[:5])
    for i in range(5):
        seen = list(cells.visit(u1[i], u2[i], (np.inf, 0, 0), lambda b: True))
        bounds = [mark[0] for _, mark in seen]
        assert bounds == sorted(bounds, reverse=True) and set(np.unique(cell)) <= {c for c, _ in seen} and len(seen) == len({c for c, _ in seen})
        for c, mark in seen:
            assert not (cell == c).any() or (m[cell == c] @ m[i]).max() <= mark[0]
        # going on from a mark repeats nothing
        assert list(cells.visit(u1[i], u2[i], seen[9][1], lambda b: True)) == seen[10:]
