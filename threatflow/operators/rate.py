"""Rate detection, top talkers, fixed-window limits and sustained conditions."""

from pyspark.sql import DataFrame, functions as F

from threatflow.plans import ordered

SECOND = 1_000_000


def rate_alerts(packets: DataFrame, threshold=100, window_s=10.0, key="src_ip", chunk_rows=ordered.CHUNK_ROWS):
    """Packets whose source sent at least ``threshold`` in the window up to them."""
    rows = packets.where(F.coalesce(F.col(key), F.lit("")) != "").select(key, "ts_us", "packet_id")
    rows, hot = ordered.numbered(rows, [key], ["ts_us", "packet_id"], "packets_analyzed", chunk_rows)
    rows = ordered.rolling_range(
        rows, [key], "ts_us", int(window_s * SECOND), "packet_id", chunk_rows=chunk_rows, hot=hot, in_window=("count", None)
    )
    over = F.col("in_window") - threshold
    return rows.where(over >= 0).withColumn("confidence", F.least(F.lit(0.95), 0.60 + over * 0.05))


def top_sources(rows: DataFrame, n=5, key="src_ip"):
    counts = rows.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.count(F.lit(1)).alias("hits"))
    return counts.orderBy(F.desc("hits"), key).limit(n)


def rate_limit(requests: DataFrame, key, limit=100, window_s=60, tie="packet_id", chunk_rows=ordered.CHUNK_ROWS):
    """Per request: allowed or not, what remains, and when the window ends.

    Requests count per key and window; a window of too many requests is numbered in chunks.
    """
    width = window_s * SECOND
    rows = requests.withColumn("bucket", F.floor(F.col("ts_us") / width))
    rows = ordered.number_rows(rows, [key, "bucket"], ["ts_us", tie], "nth", chunk_rows)
    return (
        rows.withColumn("nth", F.col("nth").cast("int"))
        .withColumn("allowed", F.col("nth") <= limit)
        .withColumn("remaining", F.greatest(F.lit(limit) - F.col("nth"), F.lit(0)))
        .withColumn("reset_s", F.floor(F.col("ts_us") / SECOND) + window_s)
    )


def per_step(rows: DataFrame, step_s, *aggs):
    """One row per step of time that has rows."""
    return rows.groupBy(step_of(step_s)).agg(*aggs)


def step_of(step_s):
    return F.floor(F.col("ts_us") / (step_s * SECOND)).alias("step")


def step_quantile(rows: DataFrame, step_s, value, q, out, chunk_rows=ordered.CHUNK_ROWS):
    """The exact, linearly interpolated quantile of each step that has values; no task holds all values of a step."""
    timed = rows.where(F.col("ts_us").isNotNull()).select(step_of(step_s), value)
    return ordered.quantiles(timed, ["step"], value, [q], chunk_rows).select("step", F.col("q0").alias(out))


def step_distinct(rows: DataFrame, step_s, value, out):
    """How many different values each step has, exactly: values are told apart before they are counted."""
    pairs = rows.select(step_of(step_s), value.alias("_v")).where(F.col("step").isNotNull() & F.col("_v").isNotNull())
    return pairs.distinct().groupBy("step").agg(F.count(F.lit(1)).alias(out))


def sustained(steps: DataFrame, alarms, hold_steps, chunk_rows=ordered.CHUNK_ROWS):
    """Runs of consecutive steps on which an alarm's metric stayed above its level.

    ``steps`` has a whole-number column ``step`` and one column per metric; ``alarms``
    are (name, metric, level, severity).  A step without a row breaks a run, and runs
    shorter than ``hold_steps`` do not count.
    """
    over = F.array(*[
        F.when(F.col(metric) > level, F.struct(F.lit(name).alias("alarm"), F.lit(sev).alias("severity")))
        for name, metric, level, sev in alarms
    ])
    on = steps.select("step", F.explode(F.filter(over, lambda a: a.isNotNull())).alias("a")).select("step", "a.*")
    on = ordered.number_rows(on, ["alarm"], ["step"], "_rn", chunk_rows)
    runs = on.groupBy("alarm", "severity", (F.col("step") - F.col("_rn")).alias("_run")).agg(
        F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.count(F.lit(1)).alias("steps")
    )
    return runs.where(F.col("steps") >= hold_steps).drop("_run")


def trailing_rate(rows: DataFrame, by, now_us, span_s=3600, n=10):
    """Top-k of a label by its rate per second over the last ``span_s``."""
    recent = rows.where((F.col("ts_us") > now_us - span_s * SECOND) & (F.col("ts_us") <= now_us))
    counts = recent.groupBy(by).agg((F.count(F.lit(1)) / F.lit(float(span_s))).alias("rate"))
    return counts.orderBy(F.desc("rate"), by).limit(n)


def bucket_counts(value, borders):
    """Aggregates of a histogram of fixed buckets: how many values are up to each border (``b0`` and on), and how many at all (``n_values``).

    Histograms merge by adding; they take constant space, in batches, over steps and in streams.
    """
    return [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(borders)] + [F.count(value).alias("n_values")]


def bucket_quantile(borders, q):
    """Quantile read off such a histogram's columns, linear inside the bucket it falls into; null without values.

    Beyond the last border it is that border.
    """
    rank = F.col("n_values") * q
    result = F.lit(float(borders[-1]))
    for i in reversed(range(len(borders))):
        below = F.col(f"b{i - 1}") if i else F.lit(0)
        lower = float(borders[i - 1]) if i else 0.0
        inside = F.col(f"b{i}") - below
        at = F.lit(lower) + (borders[i] - lower) * F.when(inside > 0, (rank - below) / inside).otherwise(0.0)
        result = F.when(F.col(f"b{i}") >= rank, at).otherwise(result)
    return F.when(F.col("n_values") > 0, result)


def merged_counts(histograms: DataFrame, borders, by=()):
    """Histograms added up per ``by``."""
    return histograms.groupBy(*by).agg(*[F.sum(c).alias(c) for c in [*[f"b{i}" for i in range(len(borders))], "n_values"]])


def distinct_about(value):
    """How many different values there are, from a sketch of fixed size that merges (exact for some hundred)."""
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(value, F.lit(14))), F.lit(0))


def latency_histogram(df: DataFrame, value, buckets, by=()):
    """Cumulative bucket counts: one row per bound, +Inf as NULL, zero counts included."""
    counts = df.groupBy(*by).agg(*bucket_counts(value, buckets))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)]
    pairs.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("n_values").alias("n")))
    return counts.select(*by, F.explode(F.array(*pairs)).alias("p")).select(*by, "p.le", "p.n")


def histogram_quantile(df: DataFrame, value, buckets, q):
    """Quantile read off the histogram of all rows."""
    return df.agg(*bucket_counts(value, buckets)).select(F.col("n_values").alias("n"), bucket_quantile(buckets, q).alias("quantile"))
