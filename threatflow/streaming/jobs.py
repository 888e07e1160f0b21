"""Streaming twins of the batch operators, and the sinks they end in."""

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from threatflow.operators import rate
from threatflow.operators.flow_features import with_flow_key
from threatflow.plans.session import shared_dir

SECOND = 1_000_000


def read_table(spark: SparkSession, path, files_per_batch=None):
    """A folder or file of parquet as a stream.

    Spark takes a plain path for a folder; as a pattern the path may also be a file.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def use_state_store(spark: SparkSession):
    """State in RocksDB: a micro-batch writes what changed instead of all, and a join keeps one store a task instead of four."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    spark.conf.set("spark.sql.streaming.join.stateFormatVersion", "3")


def run_to_end(stream: DataFrame, name, base=None):
    """Process what there is, write it as parquet, and give the written table back."""
    spark = stream.sparkSession
    use_state_store(spark)
    base = base or shared_dir(spark, f"stream-{name}")
    query = (
        stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", f"{base}/checkpoint").start(f"{base}/out")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_closed(source: DataFrame, build, name, stages=1):
    """Process what there is and close all windows: ``build`` makes the query from the source.

    A first run reads the source. Then a row of the year 2100, all else NULL, comes in through a folder of
    its own, and a second run from the same checkpoint moves the watermark past every real window. The
    window of that row stays open, so it never shows. A query of several ``stages`` with state needs as many
    such rows, since each stage learns of the watermark one micro-batch after the one before it.
    """
    spark = source.sparkSession
    base = shared_dir(spark, f"stream-{name}")
    beats = f"{base}/beats"

    def beat(year):
        late = [F.lit(f"{year}-01-01 00:00:00" if f.name == "ts" else None).cast(f.dataType).alias(f.name) for f in source.schema]
        return spark.range(1).select(*late)

    beat(2100).limit(0).write.parquet(beats)
    stream = source.unionByName(spark.readStream.schema(source.schema).parquet(beats))
    out = run_to_end(build(stream), name, base)
    for stage in range(stages):
        beat(2100 + stage).write.mode("append").parquet(beats)
        out = run_to_end(build(stream), name, base)
    return out


def late_rows(query):
    """Rows dropped as too late, from the progress of a query."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


# ------------------------------------------------------------------- queries


def with_event_time(rows: DataFrame, delay="10 minutes"):
    """Add ``event_time`` from ``ts_us`` and let rows be late by ``delay``."""
    return rows.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", delay)


def tumbling_counts(rows: DataFrame, by, width="1 hour", delay="10 minutes"):
    """Rows per window and label, each window once it is closed."""
    win = F.window("event_time", width)
    return with_event_time(rows, delay).groupBy(win, *by).agg(F.count(F.lit(1)).alias("n")).select(
        F.unix_micros("window.start").alias("start_us"), *by, "n"
    )


def sliding_counts(rows: DataFrame, key, width="10 seconds", step="1 second", delay="10 minutes"):
    """Bucketed rate per source: cheap, mergeable, and split before the shuffle."""
    win = F.window("event_time", width, step)
    return with_event_time(rows, delay).groupBy(win, key).agg(F.count(F.lit(1)).alias("n")).select(
        F.unix_micros("window.start").alias("start_us"), key, "n"
    )


def session_totals(packets: DataFrame, timeout="120 seconds", delay="10 minutes"):
    """Mergeable flow totals with Spark's own session window, once the session is closed."""
    rows = with_event_time(with_flow_key(packets), delay)
    return rows.groupBy(F.session_window("event_time", timeout), "flow").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"), F.min("ts_us").alias("session_us"),
        (F.max("ts_us") - F.min("ts_us")).alias("flow_duration"),
    ).drop("session_window")


def request_limits(requests: DataFrame, key, limit=100, width="60 seconds", delay="10 minutes"):
    """Requests and how many were refused per key and window: the counting half of the request limit."""
    return tumbling_counts(requests, [key], width, delay).select(
        "start_us", key, F.col("n").alias("requests"), F.greatest(F.col("n") - limit, F.lit(0)).alias("refused")
    )


def rate_metrics(rows: DataFrame, value, borders, width="5 minutes", delay="10 minutes"):
    """Per window the rows, and how many values lie in each bucket of a histogram (see ``rate.bucket_counts``)."""
    win = F.window("event_time", width)
    return with_event_time(rows, delay).groupBy(win).agg(
        F.count(F.lit(1)).alias("n"), *rate.bucket_counts(value, borders)
    ).withColumn("start_us", F.unix_micros("window.start")).drop("window")


def joined_partners(alerts: DataFrame, window_s=300.0, delay="10 minutes"):
    """Correlation partners by a join of the alerts with themselves within an interval, both sides united.

    The alerts of an address are gathered in cells as long as the window, so earlier partners lie in the own cell or the
    one before it. Each cell joins these two while the watermarks of both sides allow it, and each alert's partners
    in them are told from its place among their sorted times: a pair of cells is a row, not a pair of alerts. Then partners are
    added and their types united per alert.
    """
    span = int(window_s * SECOND)
    sides = F.array(
        F.struct(F.lit("source").alias("side"), F.col("source_ip").alias("ip")),
        F.struct(F.lit("target").alias("side"), F.col("dest_ip").alias("ip")),
    )
    base = alerts.select("alert_id", "ts_us", "attack_type", F.explode(sides).alias("s"))
    # alerts without an address stay, for the watermark, under a key of their own
    alone = F.concat(F.lit("#"), F.coalesce(F.col("alert_id").cast("string"), F.lit("")))
    base = base.select("alert_id", "ts_us", "attack_type", "s.side", F.coalesce(F.nullif("s.ip", F.lit("")), alone).alias("ip"))

    def half(p):
        cell = F.window("at", f"{span} microseconds")
        timed = base.withColumn("at", F.timestamp_micros("ts_us")).withWatermark("at", delay).groupBy(cell, "side", "ip")
        rows = timed.agg(F.array_sort(F.collect_list(F.struct("ts_us", "alert_id", "attack_type"))).alias("rows"))
        named = rows.select(F.window_time("window").alias("at"), (F.unix_micros("window.start") / span).cast("bigint").alias("cell"), "side", "ip", "rows")
        return named.select(*[F.col(c).alias(f"{p}_{c}") for c in named.columns])

    # each cell also counts for the next one
    earlier = half("b").withColumn("b_next", F.explode(F.array("b_cell", F.col("b_cell") + 1)))
    near = F.expr(f"b_at <= a_at AND b_at >= a_at - INTERVAL {span} MICROSECONDS")
    same = (F.col("a_side") == F.col("b_side")) & (F.col("a_ip") == F.col("b_ip")) & (F.col("a_cell") == F.col("b_next"))
    pairs = half("a").join(earlier, same & near)
    parts = F.when(F.col("a_cell") == F.col("b_cell"), _within("a_rows")).otherwise(_since("a_rows", "b_rows", span))
    found = pairs.select("a_at", F.explode(parts).alias("p")).select("a_at", "p.*").where("n > 0")
    return found.groupBy("a_at", "ts_us", "alert_id", "attack_type").agg(
        F.sum("n").alias("partners"), F.flatten(F.collect_set("types")).alias("types")
    ).select(
        "alert_id", "partners", F.array_join(F.array_sort(F.array_distinct(F.concat(F.array("attack_type"), "types"))), ",").alias("attacks")
    )


def _bound(value, use):
    """``use`` of a value that is worked out once, however often a lambda in it asks for it."""
    return F.transform(F.array(value), use)[0]


def _ends(rows, place):
    """The different types of some rows, each with the first or last place it has among them."""
    types = F.array_distinct(F.filter(F.transform(rows, lambda r: r["attack_type"]), lambda t: t.isNotNull()))
    return F.transform(types, lambda t: F.struct(t.alias("type"), place(t).alias("at")))


def _parts(rows, ends, n, reached):
    """Each row with ``n`` partners and the types whose ends are ``reached``; ``rows`` have ``r`` and what these ask for."""
    return _bound(ends, lambda known: F.transform(rows, lambda e: F.struct(
        e["r"]["ts_us"].alias("ts_us"), e["r"]["alert_id"].alias("alert_id"), e["r"]["attack_type"].alias("attack_type"),
        n(e).cast("bigint").alias("n"), F.transform(F.filter(known, lambda k: reached(e, k)), lambda k: k["type"]).alias("types"),
    )))


def _within(name):
    """For each of the sorted rows how many come before it in time and id, and of which types."""
    rows = F.col(name)
    differs = lambda r, i: (i == 0) | ~F.struct(r["ts_us"], r["alert_id"]).eqNullSafe(
        F.struct(F.get(rows, i - 1)["ts_us"], F.get(rows, i - 1)["alert_id"])
    )
    # rows of one time and id are one run and don't count for each other
    marked = F.transform(rows, lambda r, i: F.struct(i.alias("i"), differs(r, i).alias("new")))
    starts = F.transform(F.filter(marked, lambda m: m["new"]), lambda m: m["i"])

    def runs(first):
        def run(s, j):
            end = F.coalesce(F.get(first, j + 1), F.size(rows))
            return F.transform(F.slice(rows, s + 1, end - s), lambda r: F.struct(r.alias("r"), s.alias("before")))

        return F.flatten(F.transform(first, run))

    names = F.transform(rows, lambda r: r["attack_type"])
    firsts = _bound(names, lambda every: _ends(rows, lambda t: F.array_position(every, t) - 1))
    return _parts(_bound(starts, runs), firsts, lambda e: e["before"], lambda e, k: k["at"] < e["before"])


def _since(name, before, span):
    """For each of the sorted rows how many of those of the cell before came less than ``span`` before it, and of which types."""
    rows, old = F.col(name), F.col(before)
    # both in one order of time; at one instant, those of the cell before come first and are too old
    own = F.transform(rows, lambda r: F.struct((r["ts_us"] - span).alias("at"), F.lit(1).alias("own"), r.alias("r")))
    others = F.transform(old, lambda r: F.struct(r["ts_us"].alias("at"), F.lit(0).alias("own"), F.when(F.lit(False), r).alias("r")))
    placed = F.transform(F.array_sort(F.concat(own, others)), lambda e, i: F.struct(e.alias("e"), i.alias("i")))
    mine = F.filter(placed, lambda p: p["e"]["own"] == 1)
    left = F.transform(mine, lambda p, j: F.struct(p["e"]["r"].alias("r"), p["e"]["at"].alias("since"), (F.size(old) - (p["i"] - j)).alias("left")))
    lasts = _ends(old, lambda t: F.array_max(F.transform(F.filter(old, lambda r: r["attack_type"] == t), lambda r: r["ts_us"])))
    return _parts(left, lasts, lambda e: e["left"], lambda e, k: k["at"] > e["since"])


# --------------------------------------------------------------------- sinks


def store_batches(stream: DataFrame, path, checkpoint):
    """Append each micro-batch under its number; a repeated batch replaces itself."""

    def write(batch, number):
        batch.write.mode("overwrite").parquet(os.path.join(path, f"batch={number}"))

    return stream.writeStream.foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()


def stored_alerts(spark: SparkSession, path):
    """The alert table: one row per alert id, even if a source sent it twice."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in ("alert_id", "batch")]
    return rows.groupBy("alert_id").agg(F.min_by(F.struct(*rest), "batch").alias("r")).select("alert_id", "r.*")
