"""Model training, scoring, evaluation runs and the decisions around them."""

import json
import random

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from threatflow.functions import values as V
from threatflow.operators import boosting, evaluate, prep
from threatflow.operators.prep import align_features, finite_rows
from threatflow.plans import ordered

SECOND = 1_000_000


def model_health(drift: DataFrame, key, window_s=3600, red_at=3, tie="alert_id", chunk_rows=ordered.CHUNK_ROWS):
    """Per drift alert the alerts in the trailing window, a colour and the retrain trigger."""
    rows = ordered.rolling_range(
        drift, [key], "ts_us", window_s * SECOND, tie, closed=False, chunk_rows=chunk_rows, recent=("count", None)
    )
    yellow = max(1, red_at // 2)
    health = F.when(F.col("recent") >= red_at, "red").when(F.col("recent") >= yellow, "yellow").otherwise("green")
    return rows.withColumn("health", health).withColumn("retrain", F.col("recent") >= red_at)


def shadow_comparison(active: DataFrame, shadow: DataFrame, row_id, first_n=100, at="ts_us"):
    """Accuracy of both models on the first rows both have scored; ties go to the new one."""
    both = active.join(shadow.withColumnRenamed("correct", "shadow_correct"), row_id)
    rows = both.orderBy(at, row_id).limit(first_n)
    out = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("correct").cast("int")).alias("active_accuracy"),
        F.avg(F.col("shadow_correct").cast("int")).alias("shadow_accuracy"),
    )
    done = F.col("n") >= first_n
    better = F.col("shadow_accuracy") >= F.col("active_accuracy")
    return out.withColumn("decision", F.when(done, F.when(better, "swap").otherwise("keep")))


def promotion(new: DataFrame, old: DataFrame):
    """Swap if F1 is no worse, or AUC is no worse and F1 lost at most five percent.

    ``old`` is the one row of the model in use, read before it was replaced.
    """
    f1, auc = old.select("f1").scalar(), old.select("roc_auc").scalar()
    rows = new.withColumn("_f1", f1).withColumn("_auc", auc)
    good = (F.col("f1") >= F.col("_f1")) | (
        (F.col("roc_auc") >= F.col("_auc")) & (F.col("f1") >= F.col("_f1") * 0.95)
    )
    return rows.withColumn("decision", F.when(good, "swap").otherwise("keep")).drop("_f1", "_auc")


# ----------------------------------------------------------------- training

def train_classifier(
    train: DataFrame, features, label="y", weight=None, scaler=None, multiclass=False, raise_rare=False,
    early_stop=None, **params,
):
    """Boosted trees for a label of 0 and 1, or with ``multiclass`` for its values in alphabetical order, from all rows.

    ``raise_rare`` weighs attacks by the ratio of normal rows to attacks. With ``early_stop`` (a column) marked
    rows are watched instead of trained on, and training ends when they stop improving. ``scaler`` (see
    ``prep.fit_scaler``) is stored with the model. ``params`` are those of ``boosting.Settings``.
    """
    classes = rare = None
    if multiclass:
        classes = [r[0] for r in train.where(F.col(label).isNotNull()).select(label).distinct().orderBy(label).collect()]
    elif raise_rare:
        use = train if early_stop is None else train.where(~F.coalesce(F.col(early_stop).cast("boolean"), F.lit(False)))
        n = use.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")).first()
        rare = n["neg"] / max(n["pos"], 1)
    widths = None if scaler is None else {r["feature"]: (r["centre"], r["width"]) for r in scaler.collect()}
    return boosting.train(
        train, features, label, weight, widths, early_stop, classes, positive_weight=rare, **params
    )


def score(model, df: DataFrame, features, out="p"):
    """Attack probability per row; absent or bad feature values count as 0."""
    rows = align_features(df, features, keep=[c for c in df.columns if c not in features])
    return rows.withColumn(out, F.get(model.probability_column(), F.lit(0)))


def predict_classes(model, df: DataFrame, features, out="predicted"):
    """Class name per row, the likeliest one; of equally likely ones the first."""
    rows = align_features(df, features, keep=[c for c in df.columns if c not in features])
    if not model.classes:
        return rows.withColumn(out, F.lit(None).cast("string"))
    names = F.array(*[F.lit(n) for n in model.classes])
    scored = rows.withColumn("_p", model.probability_column())
    best = F.array_position("_p", F.array_max("_p")).cast("int") - 1
    return scored.withColumn(out, F.get(names, best)).drop("_p")


def runtime_threshold(tuned, least=0.5):
    """A tuned threshold, but never below the floor for live use."""
    return None if tuned is None else max(float(tuned), least)


def classifier_alerts(scored: DataFrame, threshold, p="p"):
    """Alerts from scored packets at the policy threshold."""
    return scored.where(F.col(p) >= threshold).select(
        "packet_id",
        F.array(F.lit("XGBoost Detection")).alias("attack_types"),
        F.col(p).alias("confidence"),
        F.lit("flagged").alias("action"),
        F.lit("xgboost").alias("detector"),
    )


# --------------------------------------------------------------- evaluation


def evaluate_days(model, days: DataFrame, features, label="y", by="_day", threshold=0.5):
    """Confusion counts, metrics, ROC-AUC and average precision per day and overall.

    Incomplete rows are dropped and counted.
    """
    aligned = align_features(days, features, keep=[label, by], fill=None)
    marked = finite_rows(aligned, features)
    scored = score(model, marked, features)
    pred = F.when(F.col("valid"), (F.col("p") >= threshold).cast("int"))
    counts = evaluate.confusion(scored.withColumn("_pred", pred), label, "_pred", [by])
    rated = scored.where("valid")
    whole = evaluate.ranking(rated, label, "p").withColumn(by, F.lit(None).cast(scored.schema[by].dataType))
    ranks = evaluate.ranking(rated, label, "p", by=[by]).unionByName(whole).select(F.col(by).alias("_by"), "roc_auc", "pr_auc")
    return counts.join(ranks, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def generalisation(model, rows: DataFrame, features, label="y", threshold=0.5, by="dataset"):
    """One evaluation over all datasets named in column ``by``, a row per dataset and one overall."""
    return evaluate_days(model, rows, features, label, by, threshold)


#: Nodes of trees that are rated together.
RATED_NODES = 2_000_000


def sample_params(trials, seed=42, space=None):
    """Random points of the search space, the same for the same seed."""
    rng = random.Random(seed)
    return [{k: rng.choice(v) for k, v in (space or V.TUNER_SPACE).items()} for _ in range(trials)]


def random_search(
    train: DataFrame, holdout: DataFrame, features, label="y", trials=50, metric="roc_auc", seed=42, space=None, early_stop=None,
):
    """Train each sampled setting on all rows, rate it on all holdout rows, best first.

    ``space`` maps parameters to the values tried, the full search space by default. Trials are independent: each is a
    task that trains on all rows of ``train``, and ends early on the rows that ``early_stop`` marks. Holdout rows with
    the same bins get the same score from every model, so they are counted and scored once, by some models at a time,
    up to RATED_NODES.
    """
    spark = train.sparkSession
    points = sample_params(trials, seed, space)
    if not points:
        return spark.createDataFrame([], _BOARD)
    path, _, model = boosting.prepare(train, features, label, watched=early_stop)
    done = boosting.trials(spark, path, len(features), 1, early_stop is not None, [boosting.of({"seed": seed, **p}) for p in points])
    done = done.persist(StorageLevel.MEMORY_AND_DISK)
    sizes = dict(done.mapValues(lambda r: sum(t[0].size for trees in r[0] for t in trees)).collect())
    rows = boosting.cells(holdout.select(boosting.values(features), F.col(label).cast("int").alias("y")), model.cuts)
    rows = rows.select(*boosting.bin_columns(features), "y", "n").repartition(spark.sparkContext.defaultParallelism)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    # bins are whole numbers, so as values they are cut between these
    steps = [np.arange(1.0, len(cut) + 1) for cut in model.cuts]
    board, held = [], {}

    def rate():
        """Figures of the held models, from one job that scores all holdout rows with each."""
        found = [boosting.BoostedTrees(model.features, steps, None, model.base, r) for r in held.values()]
        rated = rows.select(
            "y", "n", F.posexplode(boosting.probability_columns(found)).alias("k", "p")
        ).persist(StorageLevel.MEMORY_AND_DISK)
        ranks = {r["k"]: r for r in evaluate.ranking(rated, "y", "p", by=["k"], times="n").collect()}
        marks = evaluate.confusion(rated.withColumn("hit", (F.col("p") >= 0.5).cast("int")), "y", "hit", ["k"], times="n")
        marks = {r["k"]: r for r in marks.where("k is not null").collect()}
        rated.unpersist()
        for k, (i, rounds) in enumerate(held.items()):
            figures = {**marks[k].asDict(), **ranks[k].asDict()}
            board.append((
                i + 1, metric, float(figures[metric] or 0.0), float(figures["f1"]), float(figures["accuracy"]),
                len(rounds), json.dumps(points[i], sort_keys=True),
            ))
        held.clear()

    for i, (rounds, _) in done.toLocalIterator():
        if held and sum(sizes[j] for j in held) + sizes[i] > RATED_NODES:
            rate()
        held[i] = rounds
    if held and not rows.isEmpty():
        rate()
    rows.unpersist()
    done.unpersist()
    return spark.createDataFrame(board, _BOARD).orderBy(F.desc("score"), "trial")


_BOARD = "trial int, score_metric string, score double, f1 double, accuracy double, trees int, params string"


def should_retrain(alerts: DataFrame, now_us, lookback_h=24, force=False):
    """True if a drift alert lies within the lookback, or if forced."""
    if force:
        return True
    since = now_us - lookback_h * 3600 * SECOND
    return not alerts.where((F.col("ts_us") >= since) & F.array_contains("attack_types", "Drift")).isEmpty()


def retrain(base: DataFrame, feedback: DataFrame, snapshots: DataFrame, features, label="y", row_id="row_id", test_size=0.2, **params):
    """Training with analyst feedback: split, scale, train with weights, rate on the test rows."""
    parts = prep.split_random(base, label, row_id, test_size)
    train, test = parts.where(~F.col("is_test")), parts.where("is_test")
    samples = prep.feedback_samples(feedback, snapshots)
    rows = prep.weighted_training(train, samples, features, label)
    scaler = prep.fit_scaler(train, features, "standard")
    model = train_classifier(rows, features, "y", weight="weight", scaler=scaler, **params)
    return model, evaluate.at_threshold(score(model, test, features), label, "p", 0.5)
