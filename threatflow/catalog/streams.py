"""Streaming queries: the events file as a stream, run to its end.

Each has the SQL of its batch twin. Queries that need the order of time read the events from three files whose
times overlap by up to five days, and within a file rows come in any order. All windows are closed at the end of the input.
"""

import math

from pyspark.sql import functions as F

from threatflow.catalog import analytics, detect, learn, respond  # noqa: F401
from threatflow.catalog.registry import SQL, query, rounded
from threatflow.operators import baseline
from threatflow.plans import views
from threatflow.plans.session import shared_dir
from threatflow.streaming import inorder, jobs, scoring, steps, upsert

DAY = 86_400
HOUR_US = 3_600_000_000


def events(spark, sf):
    return jobs.read_table(spark, f"{sf}/events.parquet")


def alerts(spark, sf):
    return views.as_alerts(events(spark, sf))


#: Files that the events come in, and the most that a row comes late by.
FILES, DELAY = 3, "6 days"
#: Rows of a file of arriving events; a micro-batch of more rows comes in several files.
FILE_ROWS = 500_000


def arriving(spark, sf, place=None, file_rows=FILE_ROWS):
    """The events as a stream of three parts, one a micro-batch, out of order within and between them.

    A part is one file, or as many as keep a file at about ``file_rows`` rows, the same number for every part.
    """
    base = shared_dir(spark, "arriving")
    rows = views.table(spark, sf, "events")
    part = F.least(F.lit(FILES - 1), F.floor((F.dayofmonth("ts") - 1 + F.col("event_id") % 5) / 12)) if place is None else place
    rows = rows.withColumn("_part", part)
    sizes = dict(rows.groupBy("_part").count().collect())
    n = max(1, math.ceil(max(sizes.get(i, 0) for i in range(FILES)) / file_rows))
    for i in range(FILES):
        dealt = rows.where(F.col("_part") == i).drop("_part").repartition(n)
        dealt.sortWithinPartitions(F.xxhash64("event_id")).write.mode("append").parquet(base)
        # rows may be too few for all files of a part
        for _ in range(n * (i + 1) - len(spark.read.parquet(base).inputFiles())):
            dealt.limit(0).coalesce(1).write.mode("append").parquet(base)
    return jobs.read_table(spark, base, files_per_batch=n)


def in_order(spark, sf, build, step, name, row_id="alert_id", delay=DELAY):
    """What a step gives for the arriving events; none of them is late."""
    return inorder.run_in_order(arriving(spark, sf), build, step, name, row_id=row_id, delay=delay).results()


@query(
    "stream_hourly_counts",
    f"SELECT ts_us // {HOUR_US} * {HOUR_US} AS start_us, attack_type, count(*) AS n FROM alerts GROUP BY 1, 2",
    over=["alerts"],
)
def stream_hourly_counts(spark, sf):
    return jobs.run_closed(events(spark, sf), lambda e: jobs.tumbling_counts(views.as_alerts(e), ["attack_type"]), "hourly")


@query(
    "stream_sliding_counts",
    f"WITH s AS (SELECT *, unnest(range(0, 4)) AS k FROM packets) SELECT (ts_us // {6 * HOUR_US} - k) * {6 * HOUR_US} AS start_us, src_ip, count(*) AS n FROM s GROUP BY 1, 2",
    over=["packets"],
)
def stream_sliding_counts(spark, sf):
    return jobs.run_closed(
        events(spark, sf), lambda e: jobs.sliding_counts(views.as_packets(e), "src_ip", "24 hours", "6 hours"), "sliding"
    )


@query("stream_rate_alerts")
def stream_rate_alerts(spark, sf):
    step = steps.rate_step(4, float(DAY), keep_s=365.0 * DAY)
    out = in_order(spark, sf, views.as_packets, step, "rate", "packet_id")
    return rounded(out.select("packet_id", "src_ip", "in_window", "packets_analyzed", "confidence"))


SQL["stream_rate_alerts"] = SQL["rate_alerts"]


@query("stream_request_limit")
def stream_request_limit(spark, sf):
    out = in_order(spark, sf, views.as_packets, steps.limit_step("src_ip", 2, 43_200), "limit", "packet_id")
    return out.select("packet_id", "bucket", "allowed", "remaining", "reset_s")


SQL["stream_request_limit"] = SQL["fixed_window_limit"]


@query(
    "stream_rate_metrics",
    f"SELECT ts_us // {6 * HOUR_US} * {6 * HOUR_US} AS start_us, count(*) AS n, {analytics.p95_sql('value', analytics.VALUE_BORDERS)} AS p95 FROM packets GROUP BY 1",
    over=["packets"],
)
def stream_rate_metrics(spark, sf):
    """Rows and the 95th percentile per window, from histograms that merge."""
    borders = analytics.VALUE_BORDERS
    out = jobs.run_closed(
        events(spark, sf), lambda e: jobs.rate_metrics(views.as_packets(e), "value", borders, "6 hours"), "metrics"
    )
    return out.select("start_us", "n", analytics.rate.bucket_quantile(borders, 0.95).alias("p95"))


@query(
    "stream_late_rows",
    f"""WITH t AS (SELECT ts_us, packet_id % 3 AS part FROM packets), w AS (SELECT part, max(max(ts_us)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM t GROUP BY part)
    SELECT part, count(*) FILTER (late) AS late_rows, count(*) FILTER (NOT late) AS rows_in_time FROM (
      SELECT t.part, coalesce(ts_us <= (seen // 1000 - {20 * DAY * 1000}) * 1000, false) AS late FROM t JOIN w USING (part)) GROUP BY part""",
    over=["packets"],
)
def stream_late_rows(spark, sf):
    """Files that are spread over the whole time, with 20 days of patience: how many rows come too late in each."""
    run = inorder.run_in_order(
        arriving(spark, sf, F.col("event_id") % FILES), views.as_packets, lambda rows, carried, upto: (rows.select("packet_id"), {}), "late", delay="20 days"
    )
    late = run.late().select((F.col("id").cast("bigint") % FILES).alias("part"), F.lit(1).alias("late"))
    kept = run.results().select((F.col("packet_id") % FILES).alias("part"), F.lit(0).alias("late"))
    return late.unionByName(kept).groupBy("part").agg(
        F.count_if(F.col("late") == 1).alias("late_rows"), F.count_if(F.col("late") == 0).alias("rows_in_time")
    )


@query("stream_flow_features")
def stream_flow_features(spark, sf):
    """The 78 features of each flow session, once its timeout has passed."""
    step = steps.session_step(detect.TIMEOUT, detect.IDLE)
    # the clock of these packets runs 20,000 times faster
    return rounded(in_order(spark, sf, views.as_flow_packets, step, "features", "packet_id", "45 seconds"))


SQL["stream_flow_features"] = SQL["flow_features"]


@query(
    "stream_flow_sessions",
    f"WITH {detect.FLOW_CTES} SELECT flow, min(session_us) AS session_us, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes, greatest(max(ts_us) - min(ts_us), 1) AS flow_duration FROM j GROUP BY flow, sid",
    over=["flow_packets"],
)
def stream_flow_sessions(spark, sf):
    """All sessions: packets, bytes and duration."""
    step = steps.session_step(detect.TIMEOUT, detect.IDLE)
    out = in_order(spark, sf, views.as_flow_packets, step, "flows", "packet_id", "45 seconds")
    return out.select(
        "flow", "session_us", (F.col("tot_fwd_pkts") + F.col("tot_bwd_pkts")).cast("bigint").alias("packets"),
        (F.col("totlen_fwd_pkts") + F.col("totlen_bwd_pkts")).cast("bigint").alias("bytes"), "flow_duration",
    )


@query(
    "stream_session_totals",
    f"WITH {detect.FLOW_CTES}, t AS (SELECT flow, sid, min(session_us) AS session_us, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes, max(ts_us) - min(ts_us) AS flow_duration FROM j GROUP BY flow, sid) "
    "SELECT flow, session_us, packets, bytes, flow_duration FROM t",
    over=["flow_packets"],
)
def stream_session_totals(spark, sf):
    out = jobs.run_closed(
        events(spark, sf),
        lambda e: jobs.session_totals(views.as_flow_packets(e), f"{int(detect.TIMEOUT)} seconds", "1 second"),
        "session-totals",
    )
    return out.select("flow", "session_us", "packets", "bytes", "flow_duration")


@query(
    "stream_alert_dedup",
    f"WITH RECURSIVE {respond.greedy_ctes('alerts', 'concat(attack_type, source_ip)', 2 * respond.DAY_US)} SELECT alert_id, k AS key FROM kept",
    over=["alerts"],
)
def stream_alert_dedup(spark, sf):
    def build(e):
        return views.as_alerts(e).select("alert_id", "ts_us", F.concat("attack_type", "source_ip").alias("key"))

    return in_order(spark, sf, build, steps.suppress_step(["key"], 2 * DAY), "dedup").select("alert_id", "key")


@query("stream_adaptive_threshold")
def stream_adaptive_threshold(spark, sf):
    out = in_order(spark, sf, views.as_alerts, steps.threshold_step("location", "value"), "adaptive")
    return rounded(out.select("alert_id", "threshold", "is_anomaly"))


SQL["stream_adaptive_threshold"] = SQL["adaptive_threshold"]


@query("stream_ewma_baseline")
def stream_ewma_baseline(spark, sf):
    out = in_order(spark, sf, views.as_packets, steps.baseline_step("location", ["size", "payload_len"]), "ewma", "packet_id")
    rest = [c for c in out.columns if c != "location"]
    return rounded(out.groupBy("location").agg(F.max_by(F.struct(*rest), "n").alias("s")).select("location", "s.*"))


SQL["stream_ewma_baseline"] = SQL["ewma_baseline"]


@query("stream_drift_alerts")
def stream_drift_alerts(spark, sf):
    stats = baseline.baseline_stats(views.packets(spark, sf), detect.DRIFT_FEATURES)
    step = steps.drift_step("location", detect.DRIFT_FEATURES, stats, 200, 0.08, 2, 7200.0)
    out = in_order(spark, sf, views.as_packets, step, "drift", "packet_id")
    return out.select("location", "packet_id", "n_features", "confidence")


SQL["stream_drift_alerts"] = SQL["drift_alerts"]


@query(
    "stream_kill_chains",
    f"WITH {respond.CHAIN} SELECT alert_id AS trigger_id, source_ip, CAST(n_stages AS INT) AS n_stages, pos AS total_alerts FROM hit",
    over=["alerts"],
)
def stream_kill_chains(spark, sf):
    out = in_order(spark, sf, views.as_alerts, steps.chain_step(respond.GAP), "chains")
    return out.select("trigger_id", "source_ip", "n_stages", "total_alerts")


@query("stream_derived_alerts")
def stream_derived_alerts(spark, sf):
    """Correlations of both sides and kill-chain alerts, the chain's first."""
    out = in_order(spark, sf, views.as_alerts, steps.correlation_step(respond.WINDOW), "derived")
    return rounded(out.select("event_id", "kind", "confidence"))


SQL["stream_derived_alerts"] = SQL["derived_alerts"]


@query(
    "stream_partner_counts",
    f"WITH {respond.CORR} SELECT 'source' AS side, s.alert_id, s.n AS partners, array_to_string(list_sort(list_distinct(list_concat([a.attack_type], s.ts))), ',') AS attacks FROM s JOIN alerts a USING (alert_id) "
    "UNION ALL SELECT 'target', t.alert_id, t.n, array_to_string(list_sort(list_distinct(list_concat([a.attack_type], t.ts))), ',') FROM t JOIN alerts a USING (alert_id)",
    over=["alerts"],
)
def stream_partner_counts(spark, sf):
    return in_order(spark, sf, views.as_alerts, steps.partner_step(respond.WINDOW), "partners")


@query(
    "stream_joined_partners",
    f"WITH {respond.CORR} SELECT alert_id, partners, attacks FROM corr",
    over=["alerts"],
)
def stream_joined_partners(spark, sf):
    """Partners of both sides by a join of two watermarked streams."""
    return jobs.run_closed(
        events(spark, sf), lambda e: jobs.joined_partners(views.as_alerts(e), respond.WINDOW), "joined"
    ).select("alert_id", "partners", "attacks")


@query("stream_policy_decisions")
def stream_policy_decisions(spark, sf):
    vote = ~F.col("attack_type").isin("Anomaly", "Port Scanning") | (F.col("alert_id") % 4 == 0)
    out = in_order(
        spark, sf, lambda e: views.as_alerts(e).select("alert_id", "ts_us", "location", vote.alias("is_tp")), steps.policy_step("location"), "policy"
    )
    return rounded(out.select("location", "block", "action", "new_threshold"))


SQL["stream_policy_decisions"] = SQL["policy_run"]


@query("stream_alert_store", "SELECT alert_id, source_ip, attack_type FROM alerts", over=["alerts"])
def stream_alert_store(spark, sf):
    base = shared_dir(spark, "stream-store")
    rows = alerts(spark, sf).select("alert_id", "ts_us", "source_ip", "attack_type")
    jobs.store_batches(rows, f"{base}/alerts", f"{base}/checkpoint").awaitTermination()
    return jobs.stored_alerts(spark, f"{base}/alerts").drop("ts_us")


@query("stream_blocklist")
def stream_blocklist(spark, sf):
    """Live entries of a table of keys that three micro-batches of changes went into."""
    base = shared_dir(spark, "stream-blocks")
    table = upsert.KeyTable(spark, f"{base}/blocked", buckets=4, every=2)
    rows = views.as_alerts(arriving(spark, sf)).where("event_type = 'error'").select(
        F.col("source_ip").alias("key"), "ts_us", (F.col("ts_us") + 2 * respond.DAY_US).alias("expires_us"),
        (F.col("alert_id") % 4 == 0).alias("deleted"),
    )
    table.run(rows, f"{base}/checkpoint").awaitTermination()
    return table.current().select("key", "ts_us", "expires_us")


SQL["stream_blocklist"] = SQL["blocklist_latest"]


@query(
    "stream_classifier_alerts",
    f"WITH {learn.ROWS} SELECT count(*) AS n_rows, count(*) FILTER (y = 1) AS attacks, true AS about_as_many, true AS as_in_batch FROM l",
    over=["flows"],
)
def stream_classifier_alerts(spark, sf):
    """Flows scored as a stream by a saved model, against the alerts of the same model in a batch."""
    from threatflow.operators import models, prep

    base = shared_dir(spark, "stream-scores")
    rows = learn.labelled(spark, sf).withColumnRenamed("row_id", "packet_id")
    model = models.train_classifier(rows, learn.FEATURES, scaler=prep.fit_scaler(rows, learn.FEATURES))
    model.save(spark, f"{base}/model")
    scoring.set_threshold(spark, f"{base}/thresholds", "attacks", 0.2)
    flows = learn.as_labelled(views.as_flows(jobs.read_table(spark, f"{sf}/lineitem.parquet"))).withColumnRenamed("row_id", "packet_id")
    scoring.score_batches(
        flows, learn.FEATURES, f"{base}/model", f"{base}/thresholds", "attacks", f"{base}/alerts", f"{base}/checkpoint"
    ).awaitTermination()
    told = spark.read.parquet(f"{base}/alerts").select("packet_id", "confidence")
    whole = models.classifier_alerts(models.score(model, rows, learn.FEATURES), 0.5).select("packet_id", "confidence")
    other = told.exceptAll(whole).count() + whole.exceptAll(told).count()
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("y") == 1).alias("attacks")).select(
        "n_rows", "attacks",
        (F.abs(F.col("attacks") - told.count()) <= F.col("n_rows") * 0.02).alias("about_as_many"),
        F.lit(other == 0).alias("as_in_batch"),
    )


@query(
    "stream_ingest",
    "SELECT event_id // 600 * 600 AS start_s, event_id % 6 IN (1, 2) AS alert, count(*) AS n FROM events WHERE event_id % 6 < 4 GROUP BY 1, 2",
)
def stream_ingest(spark, sf):
    """Messages read and counted per ten minutes of their time, all windows closed."""
    from threatflow.catalog.tables import MESSAGE
    from threatflow.sources import messages

    def build(e):
        # the closing row has no event, so its message is written here
        end = F.lit('{"timestamp": 4102444800, "src_ip": "0.0.0.0"}')
        raw = e.select(F.when(F.col("event_id").isNull(), end).otherwise(F.expr(MESSAGE)).alias("value"))
        parsed = messages.normalize(messages.parse_messages(raw))
        timed = parsed.withColumn("event_time", F.timestamp_seconds("timestamp")).withWatermark("event_time", "10 minutes")
        out = timed.groupBy(F.window("event_time", "10 minutes"), F.col("attack_types").isNotNull().alias("alert")).agg(F.count(F.lit(1)).alias("n"))
        return out.select(F.unix_seconds("window.start").alias("start_s"), "alert", "n")

    return jobs.run_closed(events(spark, sf), build, "ingest")
