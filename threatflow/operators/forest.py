"""Isolation forest: trees grown on small samples, rows scored where they are."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from threatflow.plans import ordered

NODES = "tree int, node int, feature int, cut double, left int, right int, depth double"


def average_path(n):
    """Mean path length of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def grow_tree(x, tree, seed):
    """Random splits down to single rows or the depth limit, as one row per node."""
    rng = np.random.default_rng([seed, tree])
    limit = math.ceil(math.log2(max(len(x), 2)))
    rows, todo = [], [(np.arange(len(x)), 0, 0)]
    free = 1
    while todo:
        idx, node, depth = todo.pop()
        lo, hi = x[idx].min(axis=0), x[idx].max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if len(idx) <= 1 or depth >= limit or len(usable) == 0:
            rows.append((tree, node, -1, 0.0, -1, -1, depth + average_path(len(idx))))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(lo[f], hi[f]))
        below = x[idx, f] <= cut
        rows.append((tree, node, f, cut, free, free + 1, float(depth)))
        todo += [(idx[below], free, depth + 1), (idx[~below], free + 1, depth + 1)]
        free += 2
    return pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])


#: Rows that a tree's threshold lets through for each row it samples, on average.
SPARE = 4


def _binomial(n, p):
    """Chances of at most 0, 1, 2 and so on of ``n`` events of chance ``p``, up to where only a billionth is left."""
    out, term = [], (1 - p) ** n
    total = term
    for k in range(n):
        out.append(total)
        if 1 - total < 1e-9:
            break
        term *= (n - k) / (k + 1) * p / (1 - p)
        total += term
    return out


def fit_forest(df: DataFrame, features, row_id, trees=200, sample=256, seed=42):
    """Node table of the forest.

    Every tree samples ``sample`` rows of the whole input, all equally likely, in the same way at every size. Each row
    is drawn first for as many trees as its hash says, so that a tree gets about ``SPARE * sample`` rows; most rows of a
    large input are drawn for none and go no further. Of a tree's rows those of least hash count.
    ``row_id`` tells rows apart.
    """
    drawn = df.select(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(features)],
                      F.col(row_id).alias("_id"))
    n = df.count()
    if n > SPARE * sample:
        # how many trees draw a row: a binomial count, read off its distribution at the row's hash
        shares = _binomial(trees, SPARE * sample / n)
        place = F.shiftrightunsigned(F.xxhash64("_id", F.lit(seed)), 11) / F.lit(float(2**53))
        times = F.size(F.filter(F.array(*[F.lit(c) for c in shares]), lambda c: c <= place))
        drawn = drawn.withColumn("_times", times).where(F.col("_times") > 0)
        pick = F.transform(F.sequence(F.lit(1), F.col("_times")), lambda i: F.pmod(F.xxhash64("_id", i, F.lit(seed)), F.lit(trees)).cast("int"))
        drawn = drawn.withColumn("tree", F.explode(F.array_distinct(pick))).drop("_times")
    else:
        drawn = drawn.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    drawn = drawn.withColumn("_h", F.xxhash64("_id", "tree", F.lit(seed)))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("_h", "_id"))
    drawn = drawn.withColumn("_r", rank).where(F.col("_r") <= sample)
    cols = [f"x{i}" for i in range(len(features))]

    def grow(pdf):
        # rows come in any order; the hash order makes the tree repeatable
        pdf = pdf.sort_values(["_h", "_id"])
        return grow_tree(pdf[cols].to_numpy(float), int(pdf["tree"].iloc[0]), seed)

    return drawn.groupBy("tree").applyInPandas(grow, NODES)


def _packed(nodes):
    """Node table, at most trees x 2 x sample rows, as arrays per tree."""
    table = nodes.toPandas().sort_values(["tree", "node"])
    return [
        (t["feature"].to_numpy(), t["cut"].to_numpy(), t["left"].to_numpy(), t["right"].to_numpy(), t["depth"].to_numpy())
        for _, t in table.groupby("tree")
    ]


def path_scores(forest, x, sample):
    """Minus 2^(-mean path / expected path): lower means easier to isolate."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, cut, left, right, depth in forest:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            go = np.where(x[rows, np.maximum(f, 0)] <= cut[at], left[at], right[at])
            at = np.where(inner, go, at)
        total += depth[at]
    return -np.power(2.0, -total / len(forest) / max(average_path(sample), 1e-12))


def score_rows(df: DataFrame, features, nodes: DataFrame, sample=256, out="raw_score"):
    """Score every row; the forest travels to the tasks once as a broadcast variable."""
    forest = df.sparkSession.sparkContext.broadcast(_packed(nodes))

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.fillna(0.0).to_numpy(float) for c in cols])
        return pd.Series(path_scores(forest.value, x, sample))

    return df.withColumn(out, score(*[F.col(f"`{f}`").cast("double") for f in features]))


def forest_threshold(train: DataFrame, features, nodes, contamination=0.01, sample=256):
    """Offset that puts the given share of the training rows below zero."""
    scored = score_rows(train, features, nodes, sample)
    return ordered.quantiles(scored, [], "raw_score", [contamination]).first()["q0"]


def anomalies(df: DataFrame, features, nodes, offset, threshold=0.0, sample=256):
    """Score against the offset, verdict and confidence per row."""
    rows = score_rows(df, features, nodes, sample).withColumn("score", F.col("raw_score") - F.lit(float(offset)))
    gap = F.greatest(F.lit(0.0), F.lit(threshold) - F.col("score")) / max(abs(threshold), 1e-6)
    odd = F.col("score") < threshold
    conf = F.when(odd, F.least(F.lit(0.99), F.greatest(F.lit(0.5), gap))).otherwise(0.8)
    return rows.withColumn("is_anomaly", odd).withColumn("threshold", F.lit(threshold)).withColumn("confidence", conf)
