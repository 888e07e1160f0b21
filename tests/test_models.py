"""Properties of what SQL cannot say: forest, trees, synthetic rows, policy, decisions."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from threatflow.operators import boosting, evaluate, forest, models, neighbours, policy, prep

SF = "/root/testdata/sf0.001"


def test_forest_finds_planted_outliers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (600, 3))
    x[:6] += 12
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    nodes = forest.fit_forest(df, ["a", "b", "c"], "id", trees=40, sample=128).cache()
    assert nodes.select("tree").distinct().count() == 40
    low = forest.score_rows(df, ["a", "b", "c"], nodes, 128).orderBy("raw_score").limit(6)
    assert {r["id"] for r in low.collect()} == set(range(6))
    offset = forest.forest_threshold(df, ["a", "b", "c"], nodes, 0.01, 128)
    out = forest.anomalies(df, ["a", "b", "c"], nodes, offset, sample=128)
    assert out.where("is_anomaly").count() == 6
    assert out.where("is_anomaly AND NOT confidence BETWEEN 0.5 AND 0.99").count() == 0


def test_forest_with_full_pool(spark):
    df = spark.range(500).select("id", (F.col("id") % 37).cast("double").alias("a"))
    nodes = forest.fit_forest(df, ["a"], "id", trees=5, sample=64)
    assert nodes.select("tree").distinct().count() == 5
    assert nodes.where("depth > 12").count() == 0


def test_trees_sample_from_all_rows(spark, monkeypatch):
    """With leaves that hold the rows drawn: each tree has its own, from the whole input, however it is split."""

    def drawn(x, tree, seed):
        import pandas as pd

        return pd.DataFrame({"tree": tree, "node": range(len(x)), "feature": -1, "cut": x[:, 0], "left": -1, "right": -1, "depth": 0.0})

    monkeypatch.setattr(forest, "grow_tree", drawn)
    df = spark.range(20_000).select("id", F.col("id").cast("double").alias("a"))
    got = sorted((r["tree"], r["cut"]) for r in forest.fit_forest(df, ["a"], "id", sample=16).collect())
    assert [t for t, _ in got] == [t for t in range(200) for _ in range(16)]
    # 3200 draws of 20,000 rows
    assert len({a for _, a in got}) > 2800 and min(got)[1] >= 0
    again = forest.fit_forest(df.repartition(7), ["a"], "id", sample=16).collect()
    assert got == sorted((r["tree"], r["cut"]) for r in again)


def separable(spark, n=400):
    return spark.range(n).select(
        "id", (F.col("id") % 20).cast("double").alias("a"), F.rand(1).alias("b"), (F.col("id") % 20 >= 15).cast("int").alias("y"),
        F.when(F.col("id") % 20 >= 15, "Bot").when(F.col("id") % 20 < 5, "DoS").otherwise("Normal").alias("label"),
    )


def test_trees_separate(spark):
    df = separable(spark)
    parts = prep.split_random(df, "y", "id")
    train, test = parts.where("NOT is_test"), parts.where("is_test")
    model = models.train_classifier(train, ["a", "b"], raise_rare=True, scaler=prep.fit_scaler(train, ["a", "b"]), n_estimators=30, max_depth=3)
    assert evaluate.ranking(models.score(model, test, ["a", "b"]), "y", "p").first()["roc_auc"] > 0.9
    alerts = models.classifier_alerts(models.score(model, test.withColumn("packet_id", F.col("id")), ["a", "b"]), 0.5)
    assert alerts.count() == test.where("y = 1").count()
    # a row with a bad value is dropped and counted
    days = test.withColumn("_day", F.lit("d")).withColumn("b", F.when(F.col("id") % 2 == 0, F.col("b")))
    total = models.evaluate_days(model, days, ["a", "b"]).where("_day IS NULL").first()
    assert total["dropped_rows"] == days.where("b IS NULL").count() and total["f1"] == 1.0


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize(
    "name", ["classifier_evaluation", "classifier_alerts", "multiclass_evaluation", "generalisation_suite", "feedback_retraining"]
)
def test_queries_train_at_the_reference_setting(spark, monkeypatch, name):
    asked, of = [], boosting.of
    monkeypatch.setattr(boosting, "of", lambda params: asked.append(of(params)) or asked[-1])
    entry.queries()[name](spark, SF).collect()
    assert [(s.n_estimators, s.max_depth, s.learning_rate, s.subsample) for s in asked] == [(400, 6, 0.1, 0.8)]


def test_search_rates_every_point(spark):
    df = separable(spark)
    parts = prep.split_random(df, "y", "id").withColumn("watch", F.col("id") % 4 == 0)
    space = {"n_estimators": [5, 9], "max_depth": [2, 3], "learning_rate": [0.3], "gamma": [0.0, 0.1], "reg_alpha": [0.0], "reg_lambda": [1.0]}
    board = models.random_search(
        parts.where("not is_test"), parts.where("is_test"), ["a", "b"], trials=6, space=space, early_stop="watch"
    ).collect()
    assert [r["score"] for r in board] == sorted((r["score"] for r in board), reverse=True)
    assert sorted(r["trial"] for r in board) == [1, 2, 3, 4, 5, 6]
    points = models.sample_params(6, 42, space)
    assert all(json.loads(r["params"]) == points[r["trial"] - 1] for r in board)
    assert all(r["trees"] <= json.loads(r["params"])["n_estimators"] and r["score"] > 0.95 for r in board)
    alone = models.train_classifier(parts.where("not is_test"), ["a", "b"], early_stop="watch", seed=42, **points[0])
    first = next(r for r in board if r["trial"] == 1)
    rated = evaluate.ranking(models.score(alone, parts.where("is_test"), ["a", "b"]), "y", "p").first()
    assert first["score"] == pytest.approx(rated["roc_auc"])


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_leaderboard_searches_the_whole_space(spark, monkeypatch):
    asked, sample = [], models.sample_params
    monkeypatch.setattr(models, "sample_params", lambda *args: asked.extend(sample(*args)) or [])
    entry.queries()["tuning_leaderboard"](spark, SF)
    assert len(asked) == 50 and all(len(p) == 9 for p in asked)
    assert {p["n_estimators"] for p in asked} == {300, 500, 800, 1200} and {p["max_depth"] for p in asked} == {4, 6, 8, 10}


def test_multiclass(spark):
    df = separable(spark)
    model = models.train_classifier(df, ["a", "b"], "label", multiclass=True, n_estimators=10, max_depth=3)
    report = evaluate.classification_report(models.predict_classes(model, df, ["a", "b"]), "label", "predicted")
    assert report.where("name = 'accuracy'").first()["f1"] > 0.95


def test_early_stop(spark):
    df = separable(spark).withColumn("watch", (F.col("id") % 5 == 0).cast("int"))
    model = models.train_classifier(df, ["a", "b"], early_stop="watch", n_estimators=20, max_depth=2)
    assert len(model.rounds) <= 20


@pytest.mark.parametrize("block_rows", [10, 4096])
def test_neighbours_are_exact(spark, block_rows):
    rng = np.random.default_rng(3)
    x, g = rng.normal(0, 1, (120, 4)), rng.integers(0, 2, 120)
    g[:100] = 0
    df = spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (c, r) in enumerate(zip(g, x))], "id long, g int, v array<double>")
    got = {}
    for r in neighbours.class_neighbours(df, "g", "id", "v", 3, pivots=6, block_rows=block_rows).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["other"]))
    for i in range(120):
        d = [(np.linalg.norm(x[i] - x[j]), j) for j in range(120) if j != i and g[i] == g[j]]
        assert [o for _, o in sorted(got[i])] == [j for _, j in sorted(d)[:3]]


def test_smote_points_lie_between(spark):
    rng = np.random.default_rng(5)
    x, g = rng.normal(0, 1, (90, 3)), np.array([0] * 60 + [1] * 30)
    df = spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (c, r) in enumerate(zip(g, x))], "id long, g int, v array<double>")
    made = neighbours.smote(df, "g", "id", "v", pivots=4, block_rows=16).collect()
    assert len(made) == 30 and {r["g"] for r in made} == {1}
    for r in made:
        a, b = x[r["base_id"]], x[r["other_id"]]
        assert g[r["base_id"]] == g[r["other_id"]] == 1
        assert np.allclose(r["v"], a + r["share"] * (b - a))


def test_policy_by_hand(spark):
    # 3 blocks of 2 votes: rates 1, 3/4, 4/6
    votes = spark.createDataFrame([(i, i, "k", v) for i, v in enumerate([True, True, True, False, True, False, True])], "id long, ts_us long, k string, is_tp boolean")
    blocks = policy.policy_blocks(votes, "k", ["ts_us", "id"], interval=2)
    out = policy.policy_run(blocks, "k").orderBy("block").collect()
    assert [round(r["attack_rate"], 4) for r in out] == [1.0, 0.75, 0.6667]
    assert [(r["attack_bin"], r["fp_bin"]) for r in out] == [(4, 0), (3, 1), (3, 1)]
    # first visits take the first action; it paid off in state 3:1, so it is taken again
    assert [r["action"] for r in out] == ["decrease_sensitivity"] * 3
    q2 = 0.3 * (0.75 - 0.0625)
    assert out[2]["q_value"] == pytest.approx(q2 + 0.3 * ((4 / 6 - (2 / 6) ** 2) + 0.85 * q2 - q2))
    assert [round(r["new_threshold"], 2) for r in out] == [0.52, 0.54, 0.56]


@pytest.mark.parametrize("run", [1, 3, 7, 10_000])
def test_thresholds_in_runs(spark, monkeypatch, run):
    """Runs of blocks made at once give the thresholds that blocks made one after another give."""
    import random

    monkeypatch.setattr(policy, "RUN_BLOCKS", run)
    rnd, rows = random.Random(3), []
    for key in "ab":
        for i in range(60):
            good = rnd.random()
            rows.append((key, i + 1, good, 1 - good, int(good * 4.99), int((1 - good) * 4.99), rnd.uniform(-1, 1)))
    kinds = "k string, block long, attack_rate double, fp_rate double, attack_bin int, fp_bin int, reward double"
    got = policy.policy_run(spark.createDataFrame(rows, kinds), "k", step=0.2).orderBy("k", "block").collect()
    q, at, seen = {}, {}, set()
    for row, r in zip(sorted(rows), got):
        state = (row[0], row[4], row[5])
        q[state], a = policy.learn_step(q.get(state), row[6])
        action = policy.V.POLICY_ACTIONS[a]
        at[row[0]] = policy.move_threshold(at.get(row[0], 0.5), action, 0.2)
        seen.add(round(at[row[0]], 6))
        assert (r["k"], r["block"], r["action"]) == (*row[:2], action) and r["new_threshold"] == pytest.approx(at[row[0]])
    assert {0.3, 0.99} <= seen


def test_policy_moves_on_after_a_bad_reward():
    q, a = policy.learn_step(None, -1.0)
    assert (a, q[0]) == (0, -0.3)
    assert policy.learn_step(q, 1.0)[1] == 1
    assert policy.move_threshold(0.985, "decrease_sensitivity") == 0.99
    assert policy.move_threshold(0.31, "increase_sensitivity") == 0.3


def test_decisions(spark):
    metric = "f1 double, roc_auc double"
    old = spark.createDataFrame([(0.8, 0.9)], metric)

    def decide(f1, auc):
        return models.promotion(spark.createDataFrame([(f1, auc)], metric), old).first()["decision"]

    assert [decide(0.8, 0.1), decide(0.77, 0.95), decide(0.75, 0.95), decide(0.79, 0.89)] == ["swap", "swap", "keep", "keep"]
    assert models.runtime_threshold(6.667e-05) == 0.5 and models.runtime_threshold(0.7) == 0.7
    alerts = spark.createDataFrame([(10, ["Drift"]), (99, ["DDoS"])], "ts_us long, attack_types array<string>")
    day = 86_400_000_000
    assert models.should_retrain(alerts, day + 10) and not models.should_retrain(alerts, day + 11)
    assert models.should_retrain(alerts, day * 9, force=True)
    drift = spark.createDataFrame([(i, "m", i * 1_000_000) for i in (0, 1, 2, 3601)], "alert_id long, model string, ts_us long")
    health = {r["alert_id"]: (r["health"], r["retrain"]) for r in models.model_health(drift, "model").collect()}
    assert health == {0: ("yellow", False), 1: ("yellow", False), 2: ("red", True), 3601: ("yellow", False)}


def test_tuner_settings_repeat():
    assert models.sample_params(3, 1) == models.sample_params(3, 1) != models.sample_params(3, 2)


@pytest.mark.parametrize("block_rows", [20, 4096])
def test_hashed_neighbours_find_most(spark, block_rows):
    """Recall against the exact search where vectors cluster; all are of the class, none is the row itself."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(600):
        g = "ab"[i % 2]
        rows.append((g, i, [float(x) for x in rng.normal(size=8) * 0.2 + 4 * np.random.default_rng(i % 30).normal(size=8)]))
    df = spark.createDataFrame(rows, "g string, id bigint, v array<double>")
    exact, found = {}, {}
    for r in neighbours.class_neighbours(df, "g", "id", "v", 5).collect():
        exact.setdefault(r.id, set()).add(r.other)
    for r in neighbours.hashed_neighbours(df, "g", "id", "v", 5, block_rows=block_rows).collect():
        assert r.id != r.other and r.id % 2 == r.other % 2
        found.setdefault(r.id, set()).add(r.other)
    recall = sum(len(exact[i] & found.get(i, set())) for i in exact) / sum(map(len, exact.values()))
    assert recall >= 0.9
    small = df.where("g = 'a' OR id < 200")
    assert neighbours.smote(small, "g", "id", "v", search=neighbours.hashed_neighbours).count() == 200


@pytest.mark.parametrize("most", [7, 16_384])
def test_true_neighbours_in_blocks(spark, most):
    """Blocks that meet give what all distances of a class do; rows of one place go by id, no row is its own neighbour."""
    rng = np.random.default_rng(5)
    at = rng.integers(0, 4, (90, 3)).astype(float)
    df = spark.createDataFrame([(i, i % 2, at[i].tolist()) for i in range(90)] + [(200, 7, [0.0, 0.0, 0.0])], "id long, g int, v array<double>")
    out = neighbours.true_neighbours(df.where("id % 5 = 0"), df, "g", "id", "v", 4, most)
    got = {}
    for r in out.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["other"])
    for i in range(0, 90, 5):
        mine = sorted((j for j in range(90) if j != i and j % 2 == i % 2), key=lambda j: (float(np.sqrt(((at[i] - at[j]) ** 2).sum())), j))
        assert got[i] == mine[:4]
    assert 200 not in got
