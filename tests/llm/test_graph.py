"""Graph search against brute force."""

import numpy as np
import pytest

from threatflow.llm import graph

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def clustered(n, seed=3, spread=0.08, width=32):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    pick = np.where(rng.random(n) < 0.33, 0, rng.integers(0, 12, n))
    return (centres[pick] + rng.normal(size=(n, width)) * np.where(pick == 0, spread, 4 * spread)[:, None]).astype(np.float32)


def brute(ids, vectors, queries, k):
    v = vectors.astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    at = {int(i): p for p, i in enumerate(ids)}
    out = {}
    for q in queries:
        score = v @ v[at[q]]
        order = np.lexsort((ids, -score.round(12)))
        out[q] = [(int(ids[o]), score[o]) for o in order if ids[o] != q][:k]
    return out


@pytest.mark.parametrize("shards", [1, 4])
def test_recall_with_a_third_of_near_copies(spark, shards):
    x = clustered(3000)
    ids = np.arange(3000)
    rows = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], SCHEMA)
    asked = rows.where("vec_id % 50 = 0")
    got = graph.nearest(graph.index(rows, shards=shards), asked, 5).collect()
    want = brute(ids, x, range(0, 3000, 50), 5)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == set(want)
    hits = 0
    for q, rows_of in by.items():
        rows_of.sort()
        assert [r[0] for r in rows_of] == [1, 2, 3, 4, 5]
        assert all(a[2] >= b[2] for a, b in zip(rows_of, rows_of[1:]))
        hits += len({r[1] for r in rows_of} & {i for i, _ in want[q]})
    assert hits / (5 * len(want)) >= 0.95


def test_every_node_is_reached_and_edges_are_few():
    points = graph.units(clustered(1500).astype(float))
    built = graph.build(points)
    assert built.reached().all()
    assert (built.edges >= 0).sum(axis=1).max() <= built.edges.shape[1]
    assert not (built.edges == np.arange(1500)[:, None]).any()


def test_unusable_ties_copies_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0], 0) for i in range(0, 400)]  # one direction many times
    rows += [(1000 + i, [float(i), 1.0], None) for i in range(1, 9)]
    rows += [(2000, None, 0), (2050, [0.0, 0.0], 0), (2100, [nan, 1.0], 0), (2150, [inf, 1.0], 0), (2200, [None, 1.0], 0), (2250, [], 0)]
    rows += [(None, [1.0, 1.0], 0), (3000, [1e30, -1e30], 1), (3050, [1e-30, 1e-30], 1), (4000, [1.0, 2.0, 3.0], 1), (4001, [1.0, 2.0, 3.5], 1)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS shard", "1 AS node", "2 AS id", "3 AS query_id")
    got = graph.nearest(graph.index(df, shards=3), df.where("vec_id % 50 = 0"), 5).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert not {2000, 2050, 2100, 2150, 2200, 2250} & (set(by) | {r[1] for v in by.values() for r in v})
    # equal scores: the least keys, whatever shard they are in
    assert [r[1] for r in sorted(by[0])] == [1, 2, 3, 4, 5] and by[0][0][2] == 1.0
    assert [r[1] for r in sorted(by[50])] == [0, 1, 2, 3, 4]
    assert [r[1] for r in sorted(by[4000])] == [4001]
    assert sorted(by[3050])[0][1] == 1001 and sorted(by[3050])[0][2] == pytest.approx(1.0)
    assert [r[1] for r in sorted(by[3000])] == [0, 1, 2, 3, 4] and sorted(by[3000])[0][2] == pytest.approx(0.5**0.5)


def test_few_and_none(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert graph.nearest(graph.index(none), none).count() == 0
    one = spark.createDataFrame([(50, [1.0, 2.0], 1)], SCHEMA)
    assert graph.nearest(graph.index(one), one).count() == 0
    three = spark.createDataFrame([(50, [1.0, 2.0], 1), (1, [2.0, 1.0], 1), (2, [-1.0, 0.0], None)], SCHEMA)
    got = graph.nearest(graph.index(three), three.where("vec_id = 50")).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in got] == [(1, 1), (2, 2)]


def test_queries_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "QUERIES", 7)
    x = clustered(300)
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got = graph.nearest(graph.index(rows, shards=3), rows.where("vec_id % 10 = 0"), 3).collect()
    want = brute(np.arange(300), x, range(0, 300, 10), 3)
    assert {(r.query_id, r["rank"]): r.vec_id for r in got} == {(q, i + 1): v for q, l in want.items() for i, (v, _) in enumerate(l)}
