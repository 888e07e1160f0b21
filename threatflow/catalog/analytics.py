"""Queries for alert roll-ups, latency figures, limits and sustained conditions."""

from pyspark.sql import functions as F

from threatflow.catalog.fields import STAGE_ROWS, _fuzzy_sql, _rows_sql, listed
from threatflow.catalog.registry import query, rounded
from threatflow.functions import values as V
from threatflow.operators import analytics, lookup, rate
from threatflow.plans import views

DAY_US = 86_400_000_000
SEV = (
    f"CASE WHEN {{T}} IN ({listed(V.SERVER_CRITICAL)}) THEN 'critical' WHEN {{T}} IN ({listed(V.SERVER_HIGH)}) THEN 'high' "
    "WHEN {T} IN ('Drift', 'Anomaly') THEN 'low' ELSE 'medium' END"
)
HOUR = "strftime(make_timestamp(ts_us), '%Y-%m-%d %H:00')"


@query("attack_type_counts", "SELECT mixed_types[1] AS attack_type, count(*) AS alerts FROM alerts GROUP BY 1", over=["alerts"])
def attack_type_counts(spark, sf):
    a = views.alerts(spark, sf).drop("attack_types").withColumnRenamed("mixed_types", "attack_types")
    return analytics.type_distribution(a).withColumnRenamed("primary", "attack_type")


@query("hourly_alerts", f"SELECT {HOUR} AS hour, count(*) AS alerts FROM alerts GROUP BY 1 ORDER BY 1 DESC LIMIT 48", over=["alerts"])
def hourly_alerts(spark, sf):
    return analytics.hourly(views.alerts(spark, sf))


@query(
    "severity_counts",
    f"SELECT s.severity, count(a.alert_id) AS alerts FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) s(severity) LEFT JOIN alerts a ON {SEV.replace('{T}', 'a.attack_type')} = s.severity GROUP BY 1",
    over=["alerts"],
)
def severity_counts(spark, sf):
    return analytics.severity_distribution(views.alerts(spark, sf))


TECH_ROWS = [(n, v[0], v[2]) for n, v in V.TECHNIQUES.items()]
TECH_HITS = (
    f"d(name, technique_id, tactic_id) AS (VALUES {_rows_sql(TECH_ROWS)}), t AS (SELECT alert_id, unnest(mixed_types) AS typ FROM alerts), "
    f"x AS (SELECT DISTINCT alert_id, technique_id, tactic_id FROM (SELECT alert_id, {_fuzzy_sql(V.TECHNIQUES, 'typ')} AS name FROM t) JOIN d USING (name))"
)


def _mixed(spark, sf):
    """Alerts with several types, some spelled as in the technique table, some only like it."""
    a = views.alerts(spark, sf)
    return lookup.map_techniques(a.withColumn("attack_types", F.col("mixed_types")))


@query(
    "technique_hits",
    f"WITH {TECH_HITS} SELECT technique_id, count(*) AS hits FROM (SELECT DISTINCT alert_id, technique_id FROM x) GROUP BY 1",
    over=["alerts"],
)
def technique_hits(spark, sf):
    return analytics.technique_hits(_mixed(spark, sf))


TACTIC_ROWS = [(i, t, n) for i, (t, n) in enumerate(V.TACTICS.items())]


@query(
    "tactic_heatmap",
    f"WITH {TECH_HITS}, t2(ord, tactic_id, tactic) AS (VALUES {_rows_sql(TACTIC_ROWS)}) "
    "SELECT t2.tactic_id, t2.tactic, count(x.alert_id) AS hits FROM t2 LEFT JOIN x USING (tactic_id) GROUP BY 1, 2",
    over=["alerts"],
)
def tactic_heatmap(spark, sf):
    return analytics.tactic_hits(_mixed(spark, sf)).drop("ord")


@query(
    "analytics_bundle",
    f"WITH a AS (SELECT attack_type AS t, {HOUR} AS h, {SEV.replace('{T}', 'attack_type')} AS s, source_ip AS i FROM alerts) "
    "SELECT 'type' AS kind, t AS name, count(*) AS alerts FROM a GROUP BY t UNION ALL SELECT 'hour', h, count(*) FROM a GROUP BY h UNION ALL "
    "SELECT 'severity', s, count(*) FROM a GROUP BY s UNION ALL SELECT 'source', i, count(*) FROM a GROUP BY i UNION ALL SELECT 'total', NULL, count(*) FROM a",
    over=["alerts"],
)
def analytics_bundle(spark, sf):
    return analytics.all_analytics(views.alerts(spark, sf))


@query("active_hosts", "SELECT count(*) AS hosts FROM (SELECT source_ip FROM alerts UNION SELECT dest_ip FROM alerts)", over=["alerts"])
def active_hosts(spark, sf):
    return analytics.active_hosts(views.alerts(spark, sf))


@query(
    "top_source_shares",
    "WITH t AS (SELECT source_ip, count(*) AS hits FROM alerts GROUP BY 1 ORDER BY hits DESC, source_ip LIMIT 20) "
    "SELECT source_ip, hits, place, CAST(round(hits / total * 100, 1) AS DOUBLE) AS pct FROM (SELECT *, sum(hits) OVER () AS total, row_number() OVER (ORDER BY hits DESC, source_ip) AS place FROM t) WHERE place <= 10",
    over=["alerts"],
)
def top_source_shares(spark, sf):
    return analytics.top_shares(views.alerts(spark, sf), "source_ip")


@query("recent_alerts", "SELECT alert_id, ts_us, attack_type FROM alerts ORDER BY ts_us DESC, alert_id DESC LIMIT 100", over=["alerts"])
def recent_alerts(spark, sf):
    return analytics.newest(views.alerts(spark, sf).select("alert_id", "ts_us", "attack_type"), 100)


@query(
    "alert_page",
    "SELECT alert_id, ts_us, attack_type, (SELECT count(*) FROM alerts) AS total FROM alerts ORDER BY ts_us DESC, alert_id LIMIT 50 OFFSET 150",
    over=["alerts"],
)
def alert_page(spark, sf):
    a = views.alerts(spark, sf)
    total = a.agg(F.count(F.lit(1))).scalar()
    return analytics.page(a.select("alert_id", "ts_us", "attack_type"), 50, 150).withColumn("total", total)


@query(
    "kill_chain_summary",
    f"WITH d(name, ord, stage) AS (VALUES {_rows_sql(STAGE_ROWS)}), s AS (SELECT a.source_ip, d.stage FROM alerts a JOIN d ON d.name = a.attack_type) "
    "SELECT source_ip, round(count(DISTINCT stage) / 7, 2) AS completeness, count(*) AS total_alerts, count(*) FILTER (stage = 'reconnaissance') AS recon, "
    "count(*) FILTER (stage = 'exfiltration') AS exfil FROM s GROUP BY 1",
    over=["alerts"],
)
def kill_chain_summary(spark, sf):
    from threatflow.operators import correlate

    out = correlate.chain_summary(views.alerts(spark, sf))

    def n(stage):
        return F.coalesce(F.try_element_at("stages", F.lit(stage))["n"], F.lit(0))

    return out.select("source_ip", "completeness", "total_alerts", n("reconnaissance").alias("recon"), n("exfiltration").alias("exfil"))


@query(
    "stage_matrix",
    f"WITH d(name, ord, stage) AS (VALUES {_rows_sql(STAGE_ROWS)}), s AS (SELECT a.source_ip, d.stage FROM alerts a JOIN d ON d.name = a.attack_type) SELECT source_ip, "
    + ", ".join(f"count(*) FILTER (stage = '{s}') AS {s}" for s in V.STAGES) + " FROM s GROUP BY 1",
    over=["alerts"],
)
def stage_matrix(spark, sf):
    from threatflow.operators import correlate

    return correlate.stage_matrix(views.alerts(spark, sf))


@query(
    "detector_counters",
    "SELECT location, event_type AS detector, CASE WHEN value > 50 THEN 'malicious' ELSE 'benign' END AS verdict, count(*) AS n FROM alerts GROUP BY ALL",
    over=["alerts"],
)
def detector_counters(spark, sf):
    a = views.alerts(spark, sf).select(
        "location", F.col("event_type").alias("detector"), F.when(F.col("value") > 50, "malicious").otherwise("benign").alias("verdict")
    )
    return analytics.counters(a, "location", "detector", "verdict")


LATENCY = "value / 60.0"


@query(
    "latency_buckets",
    "WITH b(le) AS (VALUES (0.001), (0.01), (0.1), (0.5), (1.0), (5.0), (NULL)) "
    f"SELECT location, CAST(le AS DOUBLE) AS le, count(*) FILTER (le IS NULL OR {LATENCY} <= le) AS n FROM alerts, b GROUP BY 1, 2",
    over=["alerts"],
)
def latency_buckets(spark, sf):
    a = views.alerts(spark, sf).withColumn("latency", F.expr("value / 60.0D"))
    return rate.latency_histogram(a, "latency", V.LATENCY_BUCKETS, ["location"])


@query(
    "latency_p95",
    f"""WITH l AS (SELECT {LATENCY} AS v FROM alerts), b(i, lo, hi) AS (VALUES (1, 0, 0.001), (2, 0.001, 0.01), (3, 0.01, 0.1), (4, 0.1, 0.5), (5, 0.5, 1.0), (6, 1.0, 5.0)),
    c AS (SELECT i, lo, hi, (SELECT count(*) FROM l WHERE v <= hi) AS upto, (SELECT count(*) FROM l WHERE v <= lo AND i > 1) AS below, (SELECT count(*) FROM l) AS n FROM b),
    p AS (SELECT quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.95) AS p95 FROM l)
    SELECT n, round(lo + (hi - lo) * (n * 0.95 - below) / (upto - below), 6) AS quantile, round(p50, 6) AS exact_p50, round(p95, 6) AS exact_p95 FROM c, p WHERE upto >= n * 0.95 ORDER BY i LIMIT 1""",
    over=["alerts"],
)
def latency_p95(spark, sf):
    from threatflow.plans import ordered

    a = views.alerts(spark, sf).withColumn("latency", F.expr("value / 60.0D"))
    q = rate.histogram_quantile(a, "latency", V.LATENCY_BUCKETS, 0.95)
    exact = ordered.quantiles(a, [], "latency", [0.5, 0.95])
    return rounded(q.join(exact.withColumnRenamed("n", "n_exact"), F.col("n") == F.col("n_exact")).select(
        "n", "quantile", F.col("q0").alias("exact_p50"), F.col("q1").alias("exact_p95")
    ))


@query(
    "fixed_window_limit",
    "SELECT packet_id, bucket, nth <= 2 AS allowed, greatest(2 - nth, 0) AS remaining, CAST(floor(ts_us / 1e6) AS BIGINT) + 43200 AS reset_s FROM ("
    "SELECT *, row_number() OVER (PARTITION BY src_ip, bucket ORDER BY ts_us, packet_id) AS nth FROM (SELECT *, ts_us // 43200000000 AS bucket FROM packets))",
    over=["packets"],
)
def fixed_window_limit(spark, sf):
    out = rate.rate_limit(views.packets(spark, sf).select("packet_id", "ts_us", "src_ip"), "src_ip", limit=2, window_s=43_200)
    return out.select("packet_id", "bucket", "allowed", "remaining", "reset_s")


# The five alarms at levels that steps of six hours of the test table reach.
LEVELS = {"packet_rate": 80.0, "alert_rate": 20.0, "latency_p95": 100.0, "blocked_ips": 3.0, "connections": 40.0}
ALARMS = [(name, metric, LEVELS[metric], severity) for name, metric, _, severity in V.ALARMS]


#: Borders of the buckets that the alarms' latency is read from.
VALUE_BORDERS = [20, 40, 60, 80, 90, 100, 110, 120, 150, 200, 500]


def p95_sql(value, borders, q=0.95):
    """The quantile by interpolation within a group, as in ``rate.bucket_quantile``."""
    def upto(i):
        return f"count(*) FILTER ({value} <= {borders[i]})" if i >= 0 else "0"

    parts = []
    for i, hi in enumerate(borders):
        lo = borders[i - 1] if i else 0
        inside = f"({upto(i)} - {upto(i - 1)})"
        parts.append(
            f"WHEN {upto(i)} >= count({value}) * {q} THEN {lo} + {hi - lo} * coalesce((count({value}) * {q} - {upto(i - 1)}) / nullif({inside}, 0), 0)"
        )
    return f"CASE WHEN count({value}) = 0 THEN NULL {' '.join(parts)} ELSE {borders[-1]} END"


@query(
    "sustained_alarms",
    f"""WITH s AS (SELECT ts_us // 21600000000 AS step, count(*) AS packet_rate, count(*) FILTER (event_type = 'click') AS alert_rate, quantile_cont(value, 0.95) AS latency_p95,
      count(DISTINCT src_ip) FILTER (event_type = 'error') AS blocked_ips, count(DISTINCT src_port) AS connections FROM packets GROUP BY 1),
    o AS ({" UNION ALL ".join(f"SELECT '{n}' AS alarm, '{sev}' AS severity, step FROM s WHERE {m} > {level}" for n, m, level, sev in ALARMS)}),
    r AS (SELECT *, step - row_number() OVER (PARTITION BY alarm ORDER BY step) AS run FROM o)
    SELECT alarm, severity, min(step) AS first_step, max(step) AS last_step, count(*) AS steps FROM r GROUP BY alarm, severity, run HAVING count(*) >= 3""",
    over=["packets"],
)
def sustained_alarms(spark, sf):
    """Runs of steps on which an alarm's metric stayed above its level: exact quantiles and counts of different values."""
    packets = views.packets(spark, sf)
    steps = rate.per_step(
        packets, 21_600,
        F.count(F.lit(1)).alias("packet_rate"),
        F.count_if(F.col("event_type") == "click").alias("alert_rate"),
    ).where(F.col("step").isNotNull())
    for more in (
        rate.step_quantile(packets, 21_600, "value", 0.95, "latency_p95"),
        rate.step_distinct(packets, 21_600, F.when(F.col("event_type") == "error", F.col("src_ip")), "blocked_ips"),
        rate.step_distinct(packets, 21_600, F.col("src_port"), "connections"),
    ):
        steps = steps.join(more, "step", "left")
    return rate.sustained(steps.na.fill(0, ["blocked_ips", "connections"]), ALARMS, 3)


@query(
    "trailing_top_rates",
    f"""WITH n AS (SELECT max(ts_us) AS now_us FROM alerts), w AS (SELECT a.* FROM alerts a, n WHERE ts_us > now_us - {5 * DAY_US}),
    t AS (SELECT 'type' AS kind, attack_type AS name, count(*) / {5 * 86400}.0 AS rate FROM w GROUP BY 2 ORDER BY rate DESC, name LIMIT 10),
    s AS (SELECT 'source' AS kind, source_ip AS name, count(*) / {5 * 86400}.0 AS rate FROM w GROUP BY 2 ORDER BY rate DESC, name LIMIT 10)
    SELECT kind, name, round(rate * 1000, 6) AS per_1000s FROM (FROM t UNION ALL FROM s)""",
    over=["alerts"],
)
def trailing_top_rates(spark, sf):
    a = views.alerts(spark, sf)
    now = a.agg(F.max("ts_us")).scalar()
    types = rate.trailing_rate(a, "attack_type", now, 5 * 86_400).select(F.lit("type").alias("kind"), F.col("attack_type").alias("name"), "rate")
    sources = rate.trailing_rate(a, "source_ip", now, 5 * 86_400).select(F.lit("source").alias("kind"), F.col("source_ip").alias("name"), "rate")
    return rounded(types.unionByName(sources).select("kind", "name", (F.col("rate") * 1000).alias("per_1000s")))
