"""Boosted trees: splits against a search by hand, blocks against one block, and the cases training has to stand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatflow.operators import boosting

NAMES = ["a", "b", "c"]


def table(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(3)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=n) * 0.2 > 0).astype(int)
    rows = [(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int").repartition(3), x, y


def chances(model, df, out="p"):
    return df.withColumn(out, F.get(model.probability_column(), F.lit(0)))


@pytest.mark.parametrize("alpha,lam,least", [(0.0, 1.0, 1.0), (3.0, 2.0, 20.0)])
def test_first_split_is_the_best_of_all(spark, alpha, lam, least):
    df, x, y = table(spark)
    model = boosting.train(
        df, NAMES, "y", n_estimators=1, max_depth=1, subsample=1, colsample_bytree=1, reg_alpha=alpha, reg_lambda=lam, min_child_weight=least, learning_rate=0.3
    )
    share = y.mean()
    g, h = share - y, np.full(len(y), share * (1 - share))

    def score(s):
        t = np.sign(g[s].sum()) * max(abs(g[s].sum()) - alpha, 0)
        return t * t / (h[s].sum() + lam), -0.3 * t / (h[s].sum() + lam)

    whole = np.ones(len(y), bool)
    best = None
    for f in range(3):
        for cut in model.cuts[f]:
            right = x[:, f] >= cut
            if min(h[right].sum(), h[~right].sum()) < least:
                continue
            gain = score(right)[0] + score(~right)[0] - score(whole)[0]
            if best is None or gain > best[0] + 1e-9:
                best = (gain, f, cut, score(~right)[1], score(right)[1])
    feature, cut, left, value = model.rounds[0][0]
    assert (feature[0], model.cuts[feature[0]][cut[0]]) == best[1:3]
    assert value[left[0] : left[0] + 2] == pytest.approx(best[3:])
    base = np.log(share / (1 - share))
    want = 1 / (1 + np.exp(-(base + np.where(x[:, best[1]] >= best[2], best[4], best[3]))))
    got = {r["id"]: r["p"] for r in chances(model, df).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(want)


def test_blocks_add_up_to_the_same_trees(spark, monkeypatch):
    df, x, _ = table(spark, 900)
    settings = {"n_estimators": 12, "max_depth": 4, "subsample": 1, "seed": 3}
    one = boosting.train(df, NAMES, "y", **settings)
    monkeypatch.setattr(boosting, "BLOCK_CELLS", 750)
    monkeypatch.setattr(boosting, "KEPT_ROUNDS", 5)
    some = boosting.train(df, NAMES, "y", **settings)
    monkeypatch.setattr(boosting, "DIRECT", 2)
    tree = boosting.train(df, NAMES, "y", **settings)
    assert [len(r[0][0]) for r in one.rounds] == [len(r[0][0]) for r in some.rounds] and len(one.rounds) == 12
    for other in (some, tree):
        assert np.allclose(one.probabilities(x), other.probabilities(x))


def test_it_learns_and_regularises(spark):
    df, x, y = table(spark, 1500)
    held = np.arange(1500) % 5 == 0
    model = boosting.train(df.where("id % 5 != 0"), NAMES, "y", n_estimators=80, max_depth=4)
    assert ((model.probabilities(x)[held, 0] > 0.5) == y[held]).mean() > 0.88
    few = boosting.train(df, NAMES, "y", n_estimators=5, max_depth=4, gamma=1e9)
    assert all(len(set(boosting.leaves(t[0], few.binned(x)))) == 1 for t in few.rounds)
    plain = boosting.train(df, NAMES, "y", n_estimators=5, max_depth=3)
    heavy = boosting.train(df, NAMES, "y", n_estimators=5, max_depth=3, reg_lambda=1e6)
    assert np.ptp(heavy.probabilities(x)) < 0.01 < np.ptp(plain.probabilities(x))


def test_watched_rows_end_training(spark):
    df, x, y = table(spark, 800)
    noise = df.withColumn("y", (F.xxhash64("id") % 2 == 0).cast("int")).withColumn("watch", F.col("id") % 4 == 0)
    model = boosting.train(noise, NAMES, "y", watched="watch", n_estimators=300, early_stopping_rounds=10)
    assert len(model.losses) < 100
    assert len(model.rounds) == int(np.argmin(model.losses)) + 1
    full = boosting.train(df.withColumn("watch", F.col("id") % 4 == 0), NAMES, "y", watched="watch", n_estimators=6)
    assert len(full.losses) == 6 and full.losses[-1] < full.losses[0] < np.log(2)


def test_classes_share_their_rounds(spark, monkeypatch):
    df, x, _ = table(spark, 900)
    kind = F.when(F.col("a") > 0.5, "high").when(F.col("b") > 0, "mid").otherwise("low")
    named = df.withColumn("kind", F.when(F.col("id") < 890, kind))
    classes = ["high", "low", "mid"]
    one = boosting.train(named, NAMES, "kind", classes=classes, n_estimators=20, max_depth=3, subsample=1)
    p = one.probabilities(x)
    want = np.where(x[:, 0] > 0.5, 0, np.where(x[:, 1] > 0, 2, 1))
    assert p.shape == (900, 3) and np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == want).mean() > 0.97
    monkeypatch.setattr(boosting, "BLOCK_CELLS", 900)
    some = boosting.train(named, NAMES, "kind", classes=classes, n_estimators=20, max_depth=3, subsample=1)
    assert np.allclose(p, some.probabilities(x))


def test_saved_models_score_alike(spark, tmp_path):
    df, x, _ = table(spark)
    model = boosting.train(df, NAMES, "y", scaler={"a": (0.5, 2.0), "b": (0.0, 1.0), "c": (1.0, 0.1)}, n_estimators=7)
    model.save(spark, str(tmp_path / "model"))
    again = boosting.BoostedTrees.load(spark, str(tmp_path / "model"))
    mine = {r["id"]: (r["p"], r["q"]) for r in chances(again, chances(model, df), "q").collect()}
    assert all(p == q for p, q in mine.values()) and len({p for p, _ in mine.values()}) > 20


def test_missing_values_weights_and_odd_tables(spark):
    df, x, y = table(spark)
    gaps = df.withColumn("a", F.when(F.col("id") % 3 != 0, F.col("a"))).withColumn("b", F.lit(1.0)).withColumn("c", F.lit(None).cast("double"))
    model = boosting.train(gaps, NAMES, "y", n_estimators=10)
    assert chances(model, gaps).where("p is null or isnan(p)").count() == 0
    one = boosting.train(df.withColumn("y", F.lit(1)), NAMES, "y", n_estimators=3)
    assert chances(one, df).agg(F.min("p")).first()[0] > 0.99
    none = boosting.train(df.where("1 = 0"), NAMES, "y", n_estimators=3)
    assert none.rounds == [] and chances(none, df).agg(F.max("p")).first()[0] == 0.5
    assert chances(none, df.where("1 = 0")).count() == 0
    # a row of weight 5 counts as five rows
    few = df.where("id < 200")
    heavy = boosting.train(few.withColumn("w", F.when(F.col("id") < 20, 5.0).otherwise(1.0)), NAMES, "y", weight="w", n_estimators=5, subsample=1, max_bin=250)
    copies = few.unionByName(few.where("id < 20").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(4)))).drop("n"))
    many = boosting.train(copies, NAMES, "y", n_estimators=5, subsample=1, max_bin=250)
    assert heavy.base == pytest.approx(many.base)
    bounded = boosting.train(df, NAMES, "y", n_estimators=3, max_rows=100)
    assert len(bounded.rounds) == 3
    with pytest.raises(TypeError):
        boosting.train(df, NAMES, "y", maxIter=3)


@pytest.mark.parametrize("depth,bins", [(0, 64), (3, 5), (6, 64), (10, 256)])
def test_lookups_find_the_leaves_that_steps_lead_to(depth, bins):
    """Deep trees have leaves in several words; some features are never asked, some splits leave a side empty."""
    rng = np.random.default_rng(depth)
    sizes = [bins, bins, 3, 2, bins, 1]
    x = np.stack([rng.integers(0, s, 25_000) for s in sizes]).astype(np.uint8)
    tree = boosting.Tree()
    tree.value[0] = -1.5
    level = [0]
    for _ in range(depth):
        level = [
            c for node in level if rng.random() < 0.9
            for c in tree.split(node, int(rng.choice([0, 1, 2, 4])), int(rng.integers(0, bins - 1)), float(rng.random()), rng.normal(size=2).tolist())
        ]
    tree.prune(0.2)
    packed = tree.packed()
    for rows in (x, x[:, :1], x[:, :0]):
        got, groups = np.full(rows.shape[1], 0.25), boosting.grouped(sizes)
        opened = boosting.open_leaves(packed, sizes)
        boosting.add_values(got, opened, boosting.combined(rows, sizes, groups), sizes, groups)
        assert (got == 0.25 + packed[3][boosting.leaves(packed, rows)]).all()


def test_models_are_scored_together_batch_by_batch(spark, monkeypatch):
    """Several models in one pass over the rows, over batches put together, give each model's own probabilities."""
    df, x, _ = table(spark, 900)
    some = [boosting.train(df, NAMES, "y", n_estimators=6, max_depth=d) for d in (2, 5)]
    monkeypatch.setattr(boosting, "SCORED", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = {r["id"]: r["p"] for r in df.withColumn("p", boosting.probability_columns(some)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = np.concatenate([m.probabilities(x) for m in some], axis=1)
    assert all(got[i] == want[i].tolist() for i in range(len(x)))
