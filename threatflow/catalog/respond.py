"""Queries for suppression, incidents, blocks, correlation and kill chains."""

from pyspark.sql import functions as F

from threatflow.catalog.fields import PB_ROWS, STAGE_ROWS, _fuzzy_sql, _rows_sql
from threatflow.catalog.registry import SQL, query, rounded
from threatflow.functions import fields, values as V
from threatflow.operators import correlate, respond
from threatflow.plans import views

DAY = 86_400
DAY_US = DAY * 1_000_000


def greedy_ctes(rows, key, gap):
    """Greedy suppression as a recursion over numbered rows; result ``kept``."""
    return f"""n AS (SELECT *, {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY ts_us, alert_id) AS rn FROM {rows}),
    g AS (SELECT k, rn, ts_us AS last_us, true AS keep FROM n WHERE rn = 1 UNION ALL
      SELECT n.k, n.rn, CASE WHEN n.ts_us - last_us >= {gap} THEN n.ts_us ELSE last_us END, n.ts_us - last_us >= {gap} FROM g JOIN n ON n.k = g.k AND n.rn = g.rn + 1),
    kept AS (SELECT n.* FROM n JOIN g USING (k, rn) WHERE keep)"""


@query(
    "alert_dedup",
    f"WITH RECURSIVE {greedy_ctes('alerts', 'concat(attack_type, source_ip)', 2 * DAY_US)} SELECT alert_id, source_ip, attack_type FROM kept",
    over=["alerts"],
)
def alert_dedup(spark, sf):
    none = F.lit(None).cast("string")
    a = views.alerts(spark, sf).withColumn(
        "key",
        fields.dedup_key(F.col("attack_types"), F.col("source_ip"), none, none, none, F.lit(0), F.lit(0), none),
    )
    a = a.select("alert_id", "ts_us", "key", "source_ip", "attack_type")
    return respond.suppress_repeats(a, ["key"], 2 * DAY).select("alert_id", "source_ip", "attack_type")


@query(
    "sensor_suppression",
    f"WITH RECURSIVE {greedy_ctes('alerts', 'location', 1_800_000_000)} SELECT location, count(*) AS kept, CAST(sum(alert_id) AS BIGINT) AS id_sum FROM kept GROUP BY 1",
    over=["alerts"],
)
def sensor_suppression(spark, sf):
    a = views.alerts(spark, sf).select("alert_id", "ts_us", "location")
    return respond.suppress_repeats(a, ["location"], 1800.0).groupBy("location").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("alert_id").alias("id_sum")
    )


KEY_SQL = "concat(source_ip, '|', attack_type)"


def incident_sql(tail):
    return (
        f"WITH RECURSIVE {greedy_ctes('alerts', KEY_SQL, DAY_US)}, "
        f"d(name, severity, mitre_id, automated, manual) AS (VALUES {_rows_sql(PB_ROWS)}), "
        f"i AS (SELECT kept.*, row_number() OVER (ORDER BY ts_us, alert_id) AS seq, coalesce({_fuzzy_sql(V.PLAYBOOKS, 'attack_type')}, '') AS name FROM kept), "
        f"j AS (SELECT i.*, d.severity, d.mitre_id, d.automated, d.manual FROM i JOIN d USING (name)) {tail}"
    )


@query(
    "incidents",
    incident_sql(
        "SELECT alert_id, format('INC-{:05d}', seq) AS incident_id, severity, mitre_id, "
        "concat('🚨 ', upper(severity), ' SEVERITY — ', attack_type, ' detected. Source: ', source_ip, ' → Target: ', dest_ip, ' (node: unknown). Detection confidence: ', "
        "CAST(trunc(confidence * 100) AS INT), '%.', CASE WHEN automated <> '' THEN concat(' Automated actions: ', replace(automated, ',', ', '), '.') ELSE '' END, "
        "CASE WHEN manual <> '' THEN concat(' Manual review required: ', replace(manual, ',', ', '), '.') ELSE '' END) AS narrative FROM j"
    ),
    over=["alerts"],
)
def incidents(spark, sf):
    return respond.incidents(views.alerts(spark, sf), DAY).select("alert_id", "incident_id", "severity", "mitre_id", "narrative")


@query(
    "incident_statistics",
    incident_sql("SELECT severity, count(*) AS listed, (SELECT max(seq) FROM j) AS total FROM j WHERE seq > (SELECT max(seq) FROM j) - 200 GROUP BY 1"),
    over=["alerts"],
)
def incident_statistics(spark, sf):
    return respond.incident_stats(respond.incidents(views.alerts(spark, sf), DAY))


@query(
    "block_decisions",
    f"""SELECT source_ip AS key, ts_us, ts_us + 300000000 AS expires_us FROM alerts
    WHERE event_type = 'click' AND confidence >= 0.92""",
    over=["alerts"],
)
def block_decisions(spark, sf):
    a = views.alerts(spark, sf).select(
        "source_ip", "ts_us", F.when(F.col("event_type").isin("click", "view"), "Block").otherwise("flagged").alias("action"),
        F.col("confidence").alias("risk_score"), F.when(F.col("event_type") == "view", 1).otherwise(2).alias("signal_count"),
    )
    return respond.block_decisions(a, enabled=True).select("key", "ts_us", "expires_us")


CHANGES = f"c AS (SELECT source_ip AS key, ts_us, ts_us + {2 * DAY_US} AS expires_us, alert_id % 4 = 0 AS deleted FROM alerts WHERE event_type = 'error')"


def changes(spark, sf):
    return views.alerts(spark, sf).where("event_type = 'error'").select(
        F.col("source_ip").alias("key"), "ts_us", (F.col("ts_us") + 2 * DAY_US).alias("expires_us"),
        (F.col("alert_id") % 4 == 0).alias("deleted"),
    )


@query(
    "blocklist_latest",
    f"WITH {CHANGES}, l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_us DESC) AS rn FROM c) SELECT key, ts_us, expires_us FROM l WHERE rn = 1 AND NOT deleted",
    over=["alerts"],
)
def blocklist_latest(spark, sf):
    return respond.latest_per_key(changes(spark, sf)).select("key", "ts_us", "expires_us")


@query(
    "blocklist_active",
    f"WITH {CHANGES}, l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_us DESC) AS rn FROM c) SELECT key, expires_us FROM l WHERE rn = 1 AND NOT deleted AND expires_us >= (SELECT max(ts_us) - {DAY_US} FROM c)",
    over=["alerts"],
)
def blocklist_active(spark, sf):
    c = changes(spark, sf)
    now = c.agg(F.max("ts_us") - DAY_US).scalar()
    return respond.active_at(respond.latest_per_key(c), now).select("key", "expires_us")


def _blocked_sql(test):
    return (
        f"WITH {CHANGES}, e AS (SELECT alert_id AS event_id, source_ip, ts_us FROM alerts WHERE event_type <> 'error'), "
        "m AS (SELECT e.event_id, e.source_ip, e.ts_us, c.expires_us, c.deleted FROM e ASOF LEFT JOIN c ON e.source_ip = c.key AND e.ts_us >= c.ts_us) "
        f"SELECT event_id, source_ip FROM m WHERE {test}"
    )


@query("blocked_traffic", _blocked_sql("NOT deleted AND expires_us >= ts_us"), over=["alerts"])
def blocked_traffic(spark, sf):
    return _traffic(spark, sf, True)


@query("allowed_traffic", _blocked_sql("coalesce(deleted, true) OR expires_us < ts_us"), over=["alerts"])
def allowed_traffic(spark, sf):
    return _traffic(spark, sf, False)


def _traffic(spark, sf, blocked):
    events = views.alerts(spark, sf).where("event_type <> 'error'").select(F.col("alert_id").alias("event_id"), "source_ip", "ts_us")
    return respond.split_by_block(events, changes(spark, sf), blocked=blocked).select("event_id", "source_ip")


# ------------------------------------------------- correlation and kill chains

WINDOW = DAY / 2
GAP = DAY

CORR = f"""s AS (SELECT a.alert_id, count(*) AS n, list(p.attack_type) AS ts FROM alerts a JOIN alerts p ON p.source_ip = a.source_ip AND p.ts_us > a.ts_us - {int(WINDOW * 1e6)} AND (p.ts_us, p.alert_id) < (a.ts_us, a.alert_id) GROUP BY 1),
t AS (SELECT a.alert_id, count(*) AS n, list(p.attack_type) AS ts FROM alerts a JOIN alerts p ON p.dest_ip = a.dest_ip AND p.ts_us > a.ts_us - {int(WINDOW * 1e6)} AND (p.ts_us, p.alert_id) < (a.ts_us, a.alert_id) GROUP BY 1),
corr AS (SELECT a.alert_id, a.source_ip, coalesce(s.n, 0) + coalesce(t.n, 0) AS partners,
  array_to_string(list_sort(list_distinct(list_concat([a.attack_type], coalesce(s.ts, []), coalesce(t.ts, [])))), ',') AS attacks,
  least(0.99, a.confidence + least(20, 5 * (coalesce(s.n, 0) + coalesce(t.n, 0))) / 100.0) AS confidence
  FROM alerts a LEFT JOIN s USING (alert_id) LEFT JOIN t USING (alert_id) WHERE coalesce(s.n, 0) + coalesce(t.n, 0) > 0)"""


@query(
    "correlated_alerts",
    f"WITH {CORR} SELECT alert_id, source_ip, partners, attacks, round(confidence, 6) AS confidence, CASE WHEN confidence > 0.8 THEN 'blocked' ELSE 'flagged' END AS action FROM corr",
    over=["alerts"],
)
def correlated_alerts(spark, sf):
    out = correlate.correlations(views.alerts(spark, sf), WINDOW)
    return rounded(out.select("alert_id", "source_ip", "partners", F.array_join("attack_types", ",").alias("attacks"), "confidence", "action"))


CHAIN = f"""d(name, ord, stage) AS (VALUES {_rows_sql(STAGE_ROWS)}),
st AS (SELECT a.*, d.stage, d.ord FROM alerts a JOIN d ON d.name = a.attack_type),
st1 AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY source_ip ORDER BY ts_us, alert_id) AS gap FROM st),
st2 AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {GAP * 1_000_000} THEN 1 ELSE 0 END) OVER (PARTITION BY source_ip ORDER BY ts_us, alert_id) AS sid FROM st1),
st3 AS (SELECT *, row_number() OVER w AS pos, count(DISTINCT stage) OVER (w ROWS UNBOUNDED PRECEDING) AS n_stages FROM st2 WINDOW w AS (PARTITION BY source_ip, sid ORDER BY ts_us, alert_id)),
st4 AS (SELECT *, lag(n_stages) OVER (PARTITION BY source_ip, sid ORDER BY ts_us, alert_id) AS was FROM st3),
hit AS (SELECT * FROM st4 WHERE n_stages >= 3 AND n_stages > coalesce(was, 0))"""


@query(
    "kill_chain_steps",
    f"WITH {CHAIN} SELECT alert_id, stage, n_stages, min(ts_us) OVER (PARTITION BY source_ip, sid) AS chain_us, n_stages > coalesce(was, 0) AS first_of_stage FROM st4",
    over=["alerts"],
)
def kill_chain_steps(spark, sf):
    return correlate.chain_steps(views.alerts(spark, sf), GAP).select("alert_id", "stage", "n_stages", "chain_us", "first_of_stage")


CHAIN_ALERTS = """ka AS (SELECT h.alert_id AS trigger_id, any_value(h.source_ip) AS source_ip, any_value(h.n_stages) AS n_stages, count(*) AS total_alerts,
  array_to_string(list_sort(list(DISTINCT p.attack_type)), ',') AS attacks,
  string_agg(p.alert_id, ',' ORDER BY p.pos) FILTER (p.pos > h.pos - 20) AS ids, any_value(h.n_stages) / 7 AS share,
  array_to_string(list_transform(list_sort(list(DISTINCT p.ord)), lambda o: ['reconnaissance','weaponization','exploitation','credential_access','lateral_movement','command_and_control','exfiltration'][o]), ' → ') AS names
  FROM hit h JOIN st4 p ON p.source_ip = h.source_ip AND p.sid = h.sid AND p.pos <= h.pos GROUP BY h.alert_id)"""


@query(
    "kill_chain_alerts",
    f"WITH {CHAIN}, {CHAIN_ALERTS} SELECT trigger_id, source_ip, n_stages, total_alerts, attacks, ids, round(share, 2) AS completeness, CASE WHEN share >= 0.6 THEN 'critical' ELSE 'high' END AS severity, "
    "CAST(least(99, floor(share * 100 + 20)) AS INT) AS confidence, CASE WHEN share >= 0.5 THEN 'block' ELSE 'flagged' END AS action, "
    "concat('Kill chain detected from ', source_ip, ': ', names, ' (', CAST(floor(share * 100) AS INT), '% complete, ', total_alerts, ' related alerts)') AS description FROM ka",
    over=["alerts"],
)
def kill_chain_alerts(spark, sf):
    return correlate.chain_alerts(views.alerts(spark, sf), GAP).select(
        "trigger_id", "source_ip", "n_stages", "total_alerts", F.array_join("attacks", ",").alias("attacks"),
        F.array_join(F.col("correlated_events").cast("array<string>"), ",").alias("ids"), "completeness", "severity",
        "confidence", "action", "description",
    )


@query(
    "derived_alerts",
    f"WITH {CHAIN.replace(str(GAP * 1_000_000), str(int(WINDOW * 1e6)))}, {CORR} SELECT alert_id AS event_id, 'kill_chain' AS kind, least(99, floor(n_stages / 7 * 100 + 20)) / 100 AS confidence FROM hit UNION ALL "
    "SELECT alert_id, 'correlation', round(confidence, 6) FROM corr WHERE alert_id NOT IN (SELECT alert_id FROM hit)",
    over=["alerts"],
)
def derived_alerts(spark, sf):
    return rounded(correlate.derived_alerts(views.alerts(spark, sf), WINDOW).select("event_id", "kind", "confidence"))


@query("pipeline_totals")
def pipeline_totals(spark, sf):
    """Drift alerts, repeats dropped and alerts fused, over the whole run."""
    from threatflow.catalog import detect
    from threatflow.operators import analytics

    fused = detect.alert_fusion(spark, sf).where("n_alerts > 1")
    return analytics.pipeline_totals(detect.drift_alerts(spark, sf), views.alerts(spark, sf), alert_dedup(spark, sf), fused)


SQL["pipeline_totals"] = (
    f"SELECT (SELECT count(*) FROM ({SQL['drift_alerts']})) AS drift_alerts, (SELECT count(*) FROM events) - (SELECT count(*) FROM ({SQL['alert_dedup']})) AS deduped_alerts, "
    f"(SELECT count(*) FROM ({SQL['alert_fusion']}) WHERE n_alerts > 1) AS fused_alerts"
)
