"""Models are fitted on all rows: more than the million and the 150,000 that once were the most."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatflow.operators import boosting, evaluate, models, prep

N = 1_050_000


def test_evaluated_classifier_weighs_all_rows(spark):
    """Weighed by the ratio of all normal rows to all attacks, both classes have the same weight: the trees start at 0."""
    df = spark.range(N).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 50_000 == 0).cast("int").alias("y"))
    model = models.train_classifier(df, ["a"], raise_rare=True, n_estimators=1, max_depth=1)
    assert model.base == pytest.approx([0.0], abs=1e-9)


def test_blocks_hold_all_rows_once(spark):
    """Equal rows are one row with a count; rows that differ in bins, label, weight or mark are not."""
    rows = [(1.0, 0, 1.0, False), (1.0, 0, 1.0, False), (1.0, 1, 1.0, False), (1.0, 0, 2.0, False), (1.0, 0, 1.0, True), (3.0, 0, 1.0, False), (None, 0, 1.0, False), (1.0, None, 1.0, False)]
    df = spark.createDataFrame(rows, "a double, y int, w double, watch boolean")
    path, parts, model = boosting.prepare(df, ["a"], "y", "w", watched="watch")
    (block,) = boosting.blocks_rdd(spark, path).collect()
    assert parts == 1 and sorted(block.count.tolist()) == [1, 1, 1, 1, 1, 2] and block.watched.tolist() == [False] * 5 + [True]
    assert model.base == pytest.approx([math.log(1 / 6)])


@pytest.mark.parametrize("width", [3, 8, 11])
def test_bins_are_packed_and_found_again(spark, width):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(200, width)).round(1)
    x[rng.random(x.shape) < 0.1] = np.nan
    x = np.concatenate([x, x[:50]])
    cuts = [np.unique(rng.normal(size=n)) for n in rng.integers(0, 256, width)]
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")
    names = [f"f{i}" for i in range(width)]
    got = boosting.cells(df, cuts).select(*boosting.bin_columns(names), "n").collect()
    want = {}
    for key in map(tuple, boosting.binned(x, cuts).T.tolist()):
        want[key] = want.get(key, 0) + 1
    assert {tuple(r)[:-1]: r["n"] for r in got} == want and len(got) == len(want)


def test_a_sample_takes_each_copy_with_the_same_chance():
    count = np.repeat([1, 2, 40, 1000], 20_000)
    some = boosting.drawn(np.random.default_rng(1), count, 0.8)
    assert ((some >= 0) & (some <= count)).all() and boosting.drawn(None, count, 1.0) is count
    for n in (1, 2, 40, 1000):
        got = some[count == n]
        assert got.mean() == pytest.approx(0.8 * n, rel=0.01) and got.var() == pytest.approx(0.16 * n, rel=0.05)


def test_feedback_model_weighs_all_rows(spark):
    """Base rows of weight 1 and one analyst's attack of weight 5: no row of either is missing from the share of attacks."""
    base = spark.range(1_300_000).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 50_000 == 0).cast("int").alias("y"))
    told = spark.createDataFrame([(1, "DoS", 5.0)], "alert_id long, label string, weight double")
    alerts = spark.createDataFrame([(1, 10, {"a": 3.0})], "alert_id long, ts_us long, features map<string, double>")
    model, figures = models.retrain(base, told, alerts, ["a"], row_id="id", n_estimators=1, max_depth=1)
    ones = 26 - round(26 * 0.2) + 5
    assert model.base == pytest.approx([math.log(ones / (1_040_000 - 21))], rel=1e-12)
    assert figures.select(F.expr("tp + tn + fp + fn")).first()[0] == 260_000


def test_generalisation_model_knows_all_rows(spark):
    """The share of attacks is that of all rows, to the last one; no value is left out of the cuts."""
    df = spark.range(N).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 50_000 == 0).cast("int").alias("y"))
    model = models.train_classifier(df, ["a"], n_estimators=1, max_depth=1)
    assert model.base == pytest.approx([math.log(21 / (N - 21))], rel=1e-12)
    later = spark.createDataFrame([("x", 1.0, 0), ("y", 2.0, 1)], "dataset string, a double, y int")
    assert models.generalisation(model, later, ["a"]).count() == 3


def test_classes_are_learnt_from_all_rows(spark):
    """A tree that can't split has one value, which follows from the numbers of rows by class."""
    df = spark.range(N).select(F.lit(1.0).alias("a"), F.when(F.col("id") % 50_000 == 0, "rare").when(F.col("id") % 3 == 0, "some").otherwise("usual").alias("kind"))
    model = models.train_classifier(df, ["a"], "kind", multiclass=True, n_estimators=1, max_depth=1, subsample=1)
    counts = dict(df.groupBy("kind").count().collect())
    assert model.classes == ["rare", "some", "usual"] and sum(counts.values()) == N
    # slope n / 3 - own rows, curve 4 n / 9, each row starting at a third
    want = [-0.1 * (N / 3 - counts[k]) / (N * 4 / 9 + 1) for k in model.classes]
    assert [t[3][0] for t in model.rounds[0]] == pytest.approx(want, rel=1e-9)


def test_trials_learn_from_all_rows(spark):
    """A trial over 160,000 rows rates like a classifier of the same setting that saw each of them."""
    df = spark.range(200_000).select(
        "id", (F.xxhash64("id") % 40).cast("double").alias("a"), (F.xxhash64("id", F.lit(1)) % 50).cast("double").alias("b"), (F.col("id") % 5 == 0).alias("is_test")
    ).withColumn("y", (F.col("a") + F.col("b") + F.xxhash64("id", F.lit(2)) % 30 > 0).cast("int")).withColumn("watch", F.col("id") % 10 == 1)
    train, test = df.where("not is_test"), df.where("is_test")
    space = {"n_estimators": [6], "max_depth": [3], "subsample": [1.0], "learning_rate": [0.3]}
    (row,) = models.random_search(train, test, ["a", "b"], trials=1, space=space, early_stop="watch").collect()
    alone = models.train_classifier(train, ["a", "b"], early_stop="watch", seed=42, **models.sample_params(1, 42, space)[0])
    scored = models.score(alone, test, ["a", "b"])
    marks = evaluate.at_threshold(scored, "y", "p", 0.5).first()
    assert row["score"] == pytest.approx(evaluate.ranking(scored, "y", "p").first()["roc_auc"], rel=1e-12)
    assert (row["f1"], row["accuracy"]) == pytest.approx((marks["f1"], marks["accuracy"]), rel=1e-12)


def test_counted_rows_rate_like_their_copies(spark):
    rng = np.random.default_rng(5)
    rows = [(int(y), float(p), int(k), int(n)) for y, p, k, n in zip(rng.integers(0, 2, 300), rng.integers(0, 9, 300) / 9, rng.integers(0, 2, 300), rng.integers(1, 5, 300))]
    once = spark.createDataFrame([*rows, (None, 0.5, 0, 3)], "y int, p double, k int, n long").withColumn("hit", (F.col("p") > 0.4).cast("int"))
    copies = once.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    for found in (lambda df, t: evaluate.ranking(df, "y", "p", by=["k"], times=t), lambda df, t: evaluate.confusion(df, "y", "hit", ["k"], times=t)):
        got, want = [[tuple(r) for r in found(*a).orderBy("k").collect()] for a in ((once, "n"), (copies, None))]
        assert len(got) == len(want) > 1 and [r for r in got] == [pytest.approx(r) for r in want]


def some_block(n=6_000, number=7):
    rng = np.random.default_rng(number)
    bins = np.stack([rng.integers(0, s, n) for s in (40, 9, 7)]).astype(np.uint8)
    target = (bins[0] + 3 * bins[1] + rng.integers(0, 20, n) > 45).astype(np.int32)
    watched = np.arange(n) >= n * 0.8
    return boosting.Block(number, bins, target, np.ones(n), rng.integers(1, 4, n), watched, np.zeros((1, n)))


@pytest.mark.parametrize("gamma", [0.0, 20.0])
def test_trees_over_few_features_see_combinations_of_bins(monkeypatch, gamma):
    """A tree that may ask some features grows over the combinations of their bins: the same trees as over all rows."""
    settings = boosting.of({"n_estimators": 15, "max_depth": 5, "colsample_bytree": 0.7, "gamma": gamma})
    block, plain = some_block(), some_block()
    assert block.grid([0, 1])[1].shape[1] == 360 and block.grid([0, 1, 2])[1].shape[1] == 2_520
    monkeypatch.setattr(plain, "grid", lambda features: None)
    (got, losses), (want, plain_losses) = [boosting.grow(boosting.InTask([b], None), settings, 3, 1, True) for b in (block, plain)]
    assert losses == pytest.approx(plain_losses) and len(got) == len(want) > 5
    for (a,), (b,) in zip(got, want):
        assert all((x == y).all() for x, y in zip(a[:3], b[:3])) and np.allclose(a[3], b[3])
    if len(got) == 15:
        # none was dropped, so the rows stand where these trees take them
        assert np.allclose(block.margin[0], sum(t[0][3][boosting.leaves(t[0], block.bins)] for t in got))


def test_a_task_trains_on_several_blocks_in_files(tmp_path):
    """The blocks of a trial lie in files beyond the first; their trees are those of one block with all rows."""
    settings = boosting.of({"n_estimators": 8, "max_depth": 4, "subsample": 1.0, "colsample_bytree": 0.7})
    blocks = [some_block(2_000, n) for n in range(3)]
    parts = [np.concatenate([getattr(b, n)[..., s] for s in (slice(1_600), slice(1_600, None)) for b in blocks], axis=-1)
             for n in ("bins", "target", "weight", "count", "watched", "margin")]
    want, _ = boosting.grow(boosting.InTask([boosting.Block(7, *parts)], None), settings, 3, 1, True)
    held = boosting.InTask(iter(blocks), str(tmp_path))
    got, _ = boosting.grow(held, settings, 3, 1, True)
    assert all(isinstance(b.bins, np.memmap) and isinstance(b.margin, np.memmap) for b in held.blocks)
    assert len(got) == len(want) == 8
    for (a,), (b,) in zip(got, want):
        assert all((x == y).all() for x, y in zip(a[:3], b[:3])) and np.allclose(a[3], b[3])


def test_search_runs_over_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 2))
    rows = [(i, *map(float, v), int(v[0] + v[1] > 0)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int").withColumn("watch", F.col("id") % 5 == 1)
    train, test = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    space = {"n_estimators": [5, 7], "max_depth": [2, 3], "subsample": [1.0], "learning_rate": [0.3]}
    boards = []
    for cells in (4_000_000, 300):
        monkeypatch.setattr(boosting, "BLOCK_CELLS", cells)
        boards.append(models.random_search(train, test, ["a", "b"], trials=4, space=space, early_stop="watch").collect())
    one, many = boards
    assert [r["trial"] for r in one] == [r["trial"] for r in many] and len(one) == 4
    assert [r["score"] for r in one] == pytest.approx([r["score"] for r in many]) and one[0]["score"] > 0.9
