"""Steps of alarms are rated exactly, and blocks of neighbour search stay few and small."""

import numpy as np
from pyspark.sql import functions as F

from threatflow.operators import neighbours, rate

SECOND = 1_000_000


def test_step_figures_are_exact(spark):
    rows = [(s * 60 * SECOND + i, float(i * i % 97), f"{i % 11}" if i % 3 else None) for s in (0, 2) for i in range(40)]
    rows.append((None, 1.0, "x"))
    df = spark.createDataFrame(rows, "ts_us long, value double, ip string")
    want = np.quantile([i * i % 97 for i in range(40)], 0.95)
    for r in rate.step_quantile(df, 60, "value", 0.95, "p", chunk_rows=10).collect():
        assert r["step"] in (0, 2) and abs(r["p"] - want) < 1e-9
    many = rate.step_distinct(spark.range(30_000).select(F.lit(0).alias("ts_us"), "id"), 60, F.col("id"), "n").collect()
    assert [tuple(r) for r in many] == [(0, 30_000)]
    assert sorted(tuple(r) for r in rate.step_distinct(df, 60, F.col("ip"), "n").collect()) == [(0, 11), (2, 11)]


def test_nearest_in_pieces(monkeypatch):
    v, ids = np.random.default_rng(3).normal(size=(60, 4)), np.arange(60)
    whole = neighbours._nearest(v, ids, v, ids, 3)
    monkeypatch.setattr(neighbours, "HELD", 120)
    for a, b in zip(whole, neighbours._nearest(v, ids, v, ids, 3)):
        assert np.allclose(a, b)


def test_blocks_of_a_large_class_grow_with_it(spark):
    v = np.random.default_rng(5).normal(size=(400, 6))
    df = spark.createDataFrame([("a", i, [float(x) for x in r]) for i, r in enumerate(v)], "g string, id long, v array<double>")
    got = {}
    found = neighbours.class_neighbours(df, "g", "id", "v", k=3, pivots=2, block_rows=1)
    # with blocks of one row each row would be sent to 400 blocks and settled by itself
    assert found.select("id").distinct().count() == 400
    for r in found.collect():
        got.setdefault(r["id"], set()).add(r["other"])
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert all(got[i] == set(np.argsort(d[i])[:3].tolist()) for i in range(400))


def test_copies_are_ranked_by_id():
    v = np.repeat(np.random.default_rng(7).normal(size=(5, 64)) * 30, 40, axis=0)
    ids = np.random.default_rng(8).permutation(200)
    a, b, d = neighbours._nearest(v, ids, v, ids, 3)
    home = {int(i): at // 40 for at, i in enumerate(ids)}
    for i in home:
        same = sorted(j for j in home if j != i and home[j] == home[i])[:3]
        assert b[a == i].tolist() == same and (d[a == i] == 0).all()
