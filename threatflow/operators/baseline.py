"""Rolling statistics against a baseline: adaptive threshold, moving mean, drift."""

import math

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from threatflow.plans import ordered


def numbered(df: DataFrame, key, order, chunk_rows=ordered.CHUNK_ROWS):
    return ordered.number_rows(df, [key], order, "rn", chunk_rows)


def adaptive_threshold(
    scores: DataFrame, key, order, score="score", window=500, quantile=0.01, least=200, chunk_rows=ordered.CHUNK_ROWS
):
    """Per score the low quantile of the last ``window`` scores of its key, and a verdict.

    Rows are cut into blocks by their number, and a block also gets the last
    ``window`` - 1 rows before it, so a key spreads over any number of tasks.
    """
    rows = ordered.halo_blocks(numbered(scores, key, order, chunk_rows), "rn", window - 1, window * 20)
    schema = T.StructType([*rows.schema.fields, T.StructField("threshold", T.DoubleType())])

    def roll(table):
        # a percentile over a Spark window sorts each frame anew; this keeps one sorted
        table = table.take(pc.sort_indices(table, [("rn", "ascending")]))
        values = pd.Series(table.column(score).to_numpy())
        low = values.rolling(window, min_periods=1).quantile(quantile)
        low = low.where(table.column("rn").to_numpy() >= least)
        return table.append_column("threshold", pa.array(low, pa.float64(), from_pandas=True)).filter(table.column("_own"))

    return (
        rows.groupBy(key, "_in")
        .applyInArrow(roll, schema)
        .withColumn("is_anomaly", F.coalesce(F.col(score) < F.col("threshold"), F.lit(False)))
        .drop("_in", "_own")
    )


def moving_baseline(df: DataFrame, key, order, features, alpha=0.05, chunk_rows=ordered.CHUNK_ROWS):
    """Exponentially weighted mean and variance per key after all its rows.

    mean' = (1-a) mean + a x and var' = (1-a)(var + a (x - mean)^2).  Both are linear
    in the state, so rows are cut into blocks short enough that (1-a)^-block stays
    small, each block gives its own share, and the shares are chained.  A share older
    than ``back`` blocks has weight 0 in double precision, so the chain is a short
    fold over a bounded frame.
    """
    keep = 1.0 - alpha
    size = max(1, int(10.0 / -math.log(keep)))
    back = int(math.ceil(745.0 / (size * -math.log(keep)))) + 1
    rows = numbered(df, key, order, chunk_rows)
    # the first row sets the mean as it is; all later ones count with alpha
    rows = rows.withColumn("_block", F.floor((F.col("rn") - 1) / size)).withColumn(
        "_pos", (F.col("rn") - 1) % size + 1
    )
    gain = F.when(F.col("rn") == 1, 1.0).otherwise(alpha)

    def fade(n):
        return F.pow(F.lit(keep), n)

    def block_shares(rows, values):
        """Per block: its length and what each value adds to the state at its end."""
        end = F.col("_n") - F.col("_pos")
        sized = rows.withColumn("_n", F.max("_pos").over(Window.partitionBy(key, "_block")))
        return sized.groupBy(key, "_block", "_n").agg(
            *[F.sum(v * fade(end)).alias(name) for name, v in values.items()]
        )

    def entries(shares, names):
        """Add per block the state on entry: the shares before it, faded and summed."""
        past = Window.partitionBy(key, "_in").orderBy("_block").rowsBetween(-back, -1)
        cols = []
        for name in names:
            seen = F.collect_list(F.struct(F.col("_n").alias("n"), F.col(name).alias("v"))).over(past)
            cols.append(
                F.aggregate(seen, F.lit(0.0), lambda acc, x: acc * fade(x["n"]) + x["v"]).alias(f"_in_{name}")
            )
        halo = ordered.halo_blocks(shares, "_block", back, back * 20)
        return halo.select("*", *cols).where("_own").drop("_in", "_own")

    means = {f"m_{f}": gain * F.col(f) for f in features}
    shares = entries(block_shares(rows, means), means)
    before = Window.partitionBy(key, "_block").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*", *[F.sum(gain * F.col(f) * fade(-F.col("_pos"))).over(before).alias(f"_s_{f}") for f in features]
    ).join(shares.select(key, "_block", *[f"_in_{m}" for m in means]), [key, "_block"])
    # squared distance of each row from the mean before it
    dev = {}
    for f in features:
        since = fade(F.col("_pos") - 1)
        mean = (F.col(f"_in_m_{f}") + F.coalesce(F.col(f"_s_{f}"), F.lit(0.0))) * since
        gap = F.when(F.col("rn") > 1, F.col(f) - mean).otherwise(0.0)
        dev[f"v_{f}"] = keep * alpha * gap * gap
    spread = entries(block_shares(rows, dev), dev)
    state = shares.join(spread, [key, "_block", "_n"])
    out = {}
    for f in features:
        out[f"mean_{f}"] = F.col(f"_in_m_{f}") * fade(F.col("_n")) + F.col(f"m_{f}")
        out[f"var_{f}"] = F.col(f"_in_v_{f}") * fade(F.col("_n")) + F.col(f"v_{f}")
    return state.groupBy(key).agg(
        F.sum("_n").alias("n"), *[F.max_by(c, "_block").alias(name) for name, c in out.items()]
    )


def baseline_stats(df: DataFrame, features):
    """Mean, population deviation (0 becomes 1), minimum and maximum per feature."""
    aggs = []
    for f in features:
        x = F.coalesce(F.col(f).cast("double"), F.lit(0.0))
        aggs.append(
            F.struct(
                F.lit(f).alias("feature"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
                F.min(x).alias("min"), F.max(x).alias("max"),
            ).alias(f"_{f}")
        )
    one = df.agg(*aggs).select(F.explode(F.array(*[F.col(f"_{f}") for f in features])).alias("s")).select("s.*")
    return one.withColumn("std", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))


def drifted(
    df: DataFrame, key, order, features, baseline: DataFrame, window=500, z_at=3.0, min_features=4, keep=(), chunk_rows=ordered.CHUNK_ROWS,
):
    """All rows on which the rolling means have left the baseline, with the names of the first ten features."""
    rows, hot = ordered.numbered(df, [key], order, "rn", chunk_rows)
    tie = order[-1]
    rows = ordered.rolling_range(
        rows, [key], "rn", window - 1, tie, chunk_rows=chunk_rows, hot=hot, **{f"_sum_{f}": ("sum", f) for f in features},
        _n=("count", None),
    )
    table = baseline.agg(
        F.map_from_entries(
            F.collect_list(F.struct("feature", F.struct(F.col("mean"), F.col("std"))))
        ).alias("m")
    ).scalar()
    rows = rows.withColumn("_base", table)

    def z(f):
        base = F.col("_base")[f]
        std = F.when(base["std"] == 0, 1.0).otherwise(base["std"])
        return F.abs(F.col(f"_sum_{f}") / F.col("_n") - base["mean"]) / std

    rows = rows.where(F.col("_n") >= max(50, min_features * 5))
    rows = rows.select(key, *order, *keep, *[(z(f) >= z_at).alias(f"_z_{f}") for f in features])
    n_features = sum((F.col(f"_z_{f}").cast("int") for f in features), F.lit(0))
    rows = rows.withColumn("n_features", n_features).where(F.col("n_features") >= min_features)
    named = F.filter(F.array(*[F.when(F.col(f"_z_{f}"), F.lit(f)) for f in features]), lambda n: n.isNotNull())
    return rows.select(
        key, *order, *keep, "n_features", F.slice(named, 1, 10).alias("features"), F.lit(0.6).alias("confidence")
    )


def drift_alerts(
    df: DataFrame, key, order, features, baseline: DataFrame,
    window=500, z_at=3.0, min_features=4, cooldown_us=300_000_000, chunk_rows=ordered.CHUNK_ROWS,
):
    """Rows on which the rolling means left the baseline, at most one per cooldown.

    ``baseline`` has one row per feature; its means and deviations enter the plan as
    one scalar map, so nothing is joined.  ``order`` starts with a microsecond column.
    """
    rows = drifted(df, key, order, features, baseline, window, z_at, min_features, (), chunk_rows)
    return ordered.keep_spaced(rows, [key], order[0], order[-1], cooldown_us, chunk_rows)
