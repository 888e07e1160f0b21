"""Model evaluation: confusion counts, reports, ranking figures, thresholds."""

from pyspark.sql import DataFrame, functions as F

from threatflow.plans import ordered


def _ratio(top, bottom):
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def with_metrics(counts: DataFrame):
    """Add accuracy, precision, recall and F1 to columns tp, tn, fp, fn."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    out = (
        counts.withColumn("accuracy", _ratio(tp + tn, tp + tn + fp + fn))
        .withColumn("precision", _ratio(tp, tp + fp))
        .withColumn("recall", _ratio(tp, tp + fn))
    )
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", _ratio(2 * p * r, p + r))


def _counted(test, times):
    """Rows that pass; with ``times`` each counts as often as that column says."""
    return F.count_if(test) if times is None else F.coalesce(F.sum(F.when(test, F.col(times))), F.lit(0))


def confusion_aggs(y, pred, times=None):
    y, pred = F.col(y), F.col(pred)
    return [
        _counted((y == 1) & (pred == 1), times).alias("tp"),
        _counted((y == 0) & (pred == 0), times).alias("tn"),
        _counted((y == 0) & (pred == 1), times).alias("fp"),
        _counted((y == 1) & (pred == 0), times).alias("fn"),
    ]


def confusion(df: DataFrame, y, pred, by=(), times=None):
    """Counts and metrics per group and overall; rows without prediction count as dropped.

    With ``times`` (a column) a row stands for that many.
    """
    grouped = df.rollup(*by) if by else df.groupBy()
    counts = grouped.agg(*confusion_aggs(y, pred, times), _counted(F.col(pred).isNull(), times).alias("dropped_rows"))
    return with_metrics(counts)


def at_threshold(df: DataFrame, y, p, threshold):
    return confusion(df.withColumn("_pred", (F.col(p) >= threshold).cast("int")), y, "_pred").drop("dropped_rows")


def classification_report(df: DataFrame, label, pred):
    """Precision, recall, F1 and support per class, their macro and weighted means, accuracy."""
    pairs = df.groupBy(F.col(label).alias("l"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    # one row per pair of classes is left; each pair adds to two classes
    marks = pairs.select(
        F.explode(F.array(
            F.struct(F.col("l").alias("name"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                     F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
            F.struct(F.col("p").alias("name"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                     F.lit(0).cast("long").alias("hits")),
        )).alias("m")
    ).select("m.*")
    per = marks.groupBy("name").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    per = per.withColumn("precision", _ratio(F.col("hits"), F.col("predicted"))).withColumn(
        "recall", _ratio(F.col("hits"), F.col("support"))
    )
    p, r = F.col("precision"), F.col("recall")
    per = per.withColumn("f1", _ratio(2 * p * r, p + r))
    cols = ["precision", "recall", "f1"]
    means = per.agg(
        F.sum("support").alias("support"), F.sum("hits").alias("hits"),
        *[F.avg(c).alias(f"macro_{c}") for c in cols],
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}") for c in cols],
    )

    def line(name, values):
        return F.struct(F.lit(name).alias("name"), *[v.alias(c) for c, v in zip(cols, values)], F.col("support"))

    acc = F.col("hits") / F.col("support")
    totals = means.select(F.explode(F.array(
        line("macro avg", [F.col(f"macro_{c}") for c in cols]),
        line("weighted avg", [F.col(f"weighted_{c}") for c in cols]),
        line("accuracy", [acc, acc, acc]),
    )).alias("t")).select("t.*")
    return per.select(F.col("name").cast("string"), *cols, "support").unionByName(totals)


def score_steps(df: DataFrame, y, p, chunk_rows=ordered.CHUNK_ROWS, by=(), times=None):
    """One row per distinct score (of each group), best first, with positives and negatives up to it.

    Equal scores are merged by the first aggregation, so the ordered pass sees each
    score once, and it runs in chunks where there are many. With ``times`` (a column) a row stands for that many.
    """
    n = F.lit(1) if times is None else F.col(times)
    rows = df.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("score")).agg(
        F.sum(F.col(y).cast("long") * n).alias("pos"), F.sum((1 - F.col(y)).cast("long") * n).alias("neg")
    )
    rows = rows.withColumn("_k", F.lit(0)).withColumn("_down", -F.col("score"))
    keys = [*by, "_k"]
    rows = ordered.split_hot(rows, keys, "_down", chunk_rows)
    rows = ordered.carry(rows, keys, ["_down"], tp=("sum", "pos"), fp=("sum", "neg"))
    return rows.drop("_k", "_down", "_chunk")


def _totals(steps):
    one = steps.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return one.select("p").scalar(), one.select("n").scalar()


def ranking(df: DataFrame, y, p, chunk_rows=ordered.CHUNK_ROWS, by=(), times=None):
    """ROC-AUC and average precision (per group), NULL if only one class occurs; ``times`` as in ``score_steps``."""
    steps = score_steps(df, y, p, chunk_rows, by, times)
    agg = steps.groupBy(*by).agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("_ap"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("_auc"),
    )
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return agg.select(
        *by, "positives", "negatives",
        F.when(both, F.col("_auc") / F.col("positives") / F.col("negatives")).alias("roc_auc"),
        F.when(both, F.col("_ap") / F.col("positives")).alias("pr_auc"),
    )


def tune_threshold(df: DataFrame, y, p, target_fpr, chunk_rows=ordered.CHUNK_ROWS):
    """Threshold of the best F1, and the one of the best recall within a false-alarm rate.

    Ties go to the lowest threshold for F1 and to the highest for the recall.
    """
    steps = score_steps(df, y, p, chunk_rows)
    pos, neg = _totals(steps)
    # NULL instead of 0, so that a missing class gives NULL and no division by zero
    rows = steps.withColumn("_p", F.nullif(pos, F.lit(0))).withColumn("_n", F.nullif(neg, F.lit(0)))
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.col("_p")
    rows = rows.withColumn("f1", 2 * precision * recall / (precision + recall + 1e-12)).withColumn("tpr", recall)
    within = F.col("fp") / F.col("_n") <= target_fpr
    first = F.struct(F.col("tpr"), F.col("score"))
    out = rows.agg(
        F.max("_p").alias("_p"), F.max("_n").alias("_n"),
        F.max("f1").alias("best_f1"),
        F.max_by("score", F.struct(F.col("f1"), -F.col("score"))).alias("best_f1_threshold"),
        F.max(F.when(within, F.col("tpr"))).alias("_tpr"),
        F.max_by("score", F.when(within & (F.col("tpr") > 0), first)).alias("_thr"),
    )
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    return out.select(
        F.when(both, F.col("best_f1")).alias("best_f1"),
        F.when(both, F.col("best_f1_threshold")).alias("best_f1_threshold"),
        F.when(both, F.coalesce("_tpr", F.lit(0.0))).alias("recall_at_fpr_target"),
        F.when(both, F.coalesce("_thr", F.lit(float("inf")))).alias("threshold_at_fpr_target"),
    )


def score_threshold(df: DataFrame, score, contamination=0.01, chunk_rows=ordered.CHUNK_ROWS):
    """Score below which the given share of rows lies."""
    return ordered.quantiles(df, [], score, [contamination], chunk_rows).select(
        "n", F.col("q0").alias("threshold")
    )
