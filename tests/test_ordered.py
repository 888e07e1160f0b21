"""The split scans against plain loops, with chunk sizes that force every path."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from threatflow.plans import ordered

CHUNKS = [3, 1_000_000]


def sample(seed=1, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.7 else rnd.choice("abc")
        rows.append((key, rnd.randrange(0, 600), i, rnd.choice([None, 1, 2, 5])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, t long, id long, v long").repartition(3)


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("chunk", CHUNKS)
def test_carry(spark, chunk):
    rows = sample()
    df = ordered.split_hot(frame(spark, rows), ["k"], "t", chunk)
    got = {
        r.id: (r.lag, r.last, r.prior, r.sum, r.max)
        for r in ordered.carry(
            df, ["k"], ["t", "id"], lag=("lag", "v"), last=("last", "v"),
            prior=("prior", "v"), sum=("sum", "v"), max=("max", "v"),
        ).collect()
    }
    for part in grouped(rows).values():
        seen = []
        for r in part:
            known = [v for v in seen if v is not None]
            upto = known + ([r[3]] if r[3] is not None else [])
            assert got[r[2]] == (
                seen[-1] if seen else None,
                upto[-1] if upto else None,
                known[-1] if known else None,
                sum(upto) if upto else None,
                max(upto) if upto else None,
            )
            seen.append(r[3])


@pytest.mark.parametrize("chunk", CHUNKS)
def test_number_rows(spark, chunk):
    rows = sample(2)
    got = {r.id: r.rn for r in ordered.number_rows(frame(spark, rows), ["k"], ["t", "id"], chunk_rows=chunk).collect()}
    for part in grouped(rows).values():
        assert [got[r[2]] for r in part] == list(range(1, len(part) + 1))


@pytest.mark.parametrize("chunk", CHUNKS)
@pytest.mark.parametrize("closed", [True, False])
def test_rolling_range(spark, closed, chunk):
    rows = sample(3)
    # a flood: many rows of the hot key at one instant
    rows += [("hot", 300, 1000 + i, i % 4 or None) for i in range(120)]
    res = ordered.rolling_range(
        frame(spark, rows), ["k"], "t", 20, "id", closed=closed, chunk_rows=chunk,
        n=("count", None), s=("sum", "v"), lo=("min", "v"), hi=("max", "v"), vs=("set", "v"),
    ).collect()
    assert len(res) == len(rows)
    got = {r.id: r for r in res}
    for part in grouped(rows).values():
        for i, r in enumerate(part):
            win = [x for x in part[: i + 1] if r[1] - x[1] < 20 + closed]
            vs = [x[3] for x in win if x[3] is not None]
            g = got[r[2]]
            assert (g.n, g.s, g.lo, g.hi) == (len(win), sum(vs), min(vs, default=None), max(vs, default=None))
            assert g.vs == sorted(set(vs))


def test_no_task_of_a_rolling_window_holds_a_flood(spark):
    """99 of 100 rows of one key in one instant: no task of the windows gets more than twice the chunk."""
    rows = [("hot", 500 if i % 100 else i // 100, i, 1) for i in range(4000)]
    chunk, seen = 250, []
    split = ordered.split_hot

    def watched(df, keys, order, chunk_rows):
        out = split(df, keys, order, chunk_rows)
        seen.append(out)
        return out

    ordered.split_hot = watched
    try:
        res = ordered.rolling_range(frame(spark, rows), ["k"], "t", 100, "id", chunk_rows=chunk, n=("count", None))
    finally:
        ordered.split_hot = split
    sizes = [r["count"] for r in seen[0].groupBy("k", "_block", "_chunk").count().collect()]
    assert sum(sizes) == 8000 and max(sizes) <= 2 * chunk
    got = {r.id: r.n for r in res.collect()}
    line = sorted(rows, key=lambda r: (r[1], r[2]))
    assert all(got[r[2]] == sum(1 for x in line[: i + 1] if r[1] - x[1] <= 100) for i, r in enumerate(line[::37]) for i in [line.index(r)])


@pytest.mark.parametrize("chunk", [30, 1_000_000])
def test_newest_and_union(spark, chunk):
    rows = sample(7)
    df = frame(spark, rows).withColumn("vs", F.array(F.coalesce("v", F.lit(9)), F.col("id") % 3))
    df = ordered.split_hot(df, ["k"], ["t", "id"], chunk)
    assert ("_chunk" in df.columns) == (chunk < 100)
    res = ordered.carry(df, ["k"], ["t", "id"], last=("newest", "id"), types=("union", "vs")).collect()
    got = {r.id: (r["last"], r.types) for r in res}
    assert len(got) == len(rows)
    for part in grouped(rows).values():
        for i, r in enumerate(part):
            want = sorted({x for q in part[: i + 1] for x in (9 if q[3] is None else q[3], q[2] % 3)})
            assert got[r[2]] == ([q[2] for q in part[max(0, i - 19) : i + 1]], want)


def greedy(part, gap):
    kept, last = [], None
    for r in part:
        if last is None or r[1] >= last + gap:
            kept.append(r[2])
            last = r[1]
    return kept


@pytest.mark.parametrize("chunk", CHUNKS + [25])
@pytest.mark.parametrize("gap", [1, 7, 40])
def test_keep_spaced(spark, chunk, gap):
    rows = sample(4 + gap)
    got = {r.id for r in ordered.keep_spaced(frame(spark, rows), ["k"], "t", "id", gap, chunk).collect()}
    want = {i for part in grouped(rows).values() for i in greedy(part, gap)}
    assert got == want


def test_keep_spaced_boundaries(spark):
    times = [0, 29_900_000, 30_000_000, 45_000_000, 60_000_000]
    df = frame(spark, [("a", t, i, 1) for i, t in enumerate(times)])
    got = sorted(r.t for r in ordered.keep_spaced(df, ["k"], "t", "id", 30_000_000).collect())
    assert got == [0, 30_000_000, 60_000_000]


@pytest.mark.parametrize("chunk", CHUNKS)
def test_quantiles(spark, chunk):
    rows = sample(5)
    res = ordered.quantiles(frame(spark, rows), ["k"], "t", [0.01, 0.25, 0.5, 0.99], chunk).collect()
    for r in res:
        want = np.quantile([x[1] for x in rows if x[0] == r.k], [0.01, 0.25, 0.5, 0.99])
        assert np.allclose([r.q0, r.q1, r.q2, r.q3], want)


def test_a_burst_in_one_instant_is_split_by_rows(spark):
    """Nearly all rows of a key at one time: no chunk holds over twice the target."""
    rows = spark.range(20_000).selectExpr("'hot' AS k", "IF(id = 0, -86400000000L, 5L) AS t", "id")
    split = ordered.split_hot(rows, ["k"], ["t", "id"], 1000)
    sizes = [r["count"] for r in split.groupBy("_chunk").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 2000 and len(sizes) >= 15
    numbered = ordered.number_rows(rows, ["k"], ["t", "id"], "rn", 1000)
    assert numbered.where("rn <> id + 1").count() == 0


def test_shared_folder_is_never_machine_local_on_a_cluster():
    from threatflow.plans.session import _local_base

    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            _local_base(master)
    assert _local_base("local[4]").startswith("/")


def test_shared_folders_go_with_the_application(tmp_path):
    """A driver of its own writes to the named folder, and leaves nothing there when it ends."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import os, sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from threatflow.plans.session import build_session, shared_dir, written
spark = build_session("t", cores="1", **{{"spark.checkpoint.dir": {str(tmp_path)!r}}})
kept = written(spark.range(5))
spark.range(3).write.parquet(shared_dir(spark, "mine"))
assert kept.count() == 5 and len(os.listdir({str(tmp_path)!r} + "/threatflow/" + spark.sparkContext.applicationId)) == 2
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, capture_output=True)
    left = [p for p in tmp_path.rglob("*") if p.is_file()]
    assert left == []


@pytest.mark.parametrize("bits,chunk", [(1, 3), (1, 1_000_000), (12, 50)])
def test_mark_first(spark, monkeypatch, bits, chunk):
    """The first rows of each key by hash and id, as numbering all rows gives them; equal rows are taken one by one."""
    monkeypatch.setattr(ordered, "RANGE_BITS", bits)
    rows = [(k, i % 150, i) for i, (k, *_) in enumerate(sample())] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "k string, id long, n long").repartition(3).withColumn("h", F.xxhash64("id"))
    sizes = {r["k"]: r["count"] for r in df.groupBy("k").count().collect()}
    takes = {"hot": sizes["hot"] // 3, "a": 0, "b": sizes["b"], "c": 1}
    takes_df = spark.createDataFrame(list(takes.items()), "k string, _take long")
    got = ordered.mark_first(df, ["k"], "h", "id", takes_df, "is_first", chunk).collect()
    assert sorted(r["n"] for r in got) == sorted(n for k, _, n in rows if k in takes)
    for key, take in takes.items():
        mine = [r for r in got if r["k"] == key]
        want = sorted((r["h"], r["id"]) for r in mine)[:take]
        assert sorted((r["h"], r["id"]) for r in mine if r["is_first"]) == want


def test_split_orders_few_rows(spark, monkeypatch):
    """Only rows near the border of a class are put in order, not the class."""
    from threatflow.operators import prep

    seen, carry = [], ordered.carry
    monkeypatch.setattr(ordered, "carry", lambda df, *a, **k: seen.append(df.count()) or carry(df, *a, **k))
    df = spark.range(40_000).select("id", (F.col("id") % 2).alias("y"))
    counts = {(r["y"], r["is_test"]): r["count"] for r in prep.split_random(df, "y", "id").groupBy("y", "is_test").count().collect()}
    assert counts == {(y, t): 4_000 if t else 16_000 for y in (0, 1) for t in (True, False)}
    made = prep.balance(df.where("y = 0 OR id < 10000"), "y", "id", "oversample").groupBy("y").count()
    assert {r["y"]: r["count"] for r in made.collect()} == {0: 20_000, 1: 20_000}
    assert sum(seen) < 400
