"""Queries for signatures, flow features, rates, rolling baselines, risk and fusion."""

import re

from pyspark.sql import functions as F

from threatflow.catalog.registry import query, rounded
from threatflow.functions import values as V
from threatflow.functions.fields import severity_confidence
from threatflow.functions.verdicts import server_severity
from threatflow.operators import baseline, flow_features as ff, fusion, rate, signatures
from threatflow.plans import ordered, views
from threatflow.sources.rules import STOCK_RULES, rules_table

DAY = 86_400


def quote(text):
    return "'" + text.replace("'", "''") + "'"


# Spark's \b knows all letters, DuckDB's only ASCII ones: spell the boundary out.
def duck_pattern(pattern):
    body = pattern.replace(r"(?i)\b", r"(?i)(^|[^\p{L}\p{N}_])")
    return quote(body.replace(r"\b", r"($|[^\p{L}\p{N}_])"))


def rules_sql():
    parts = []
    for i, r in enumerate(STOCK_RULES):
        tests = []
        if r.protocol:
            tests.append(f"(protocol IS NULL OR lower(protocol) = {quote(r.protocol)})")
        if r.dst_ports:
            tests.append(f"(dst_port IS NULL OR dst_port IN ({', '.join(map(str, r.dst_ports))}))")
        for k, v in r.equals.items():
            tests.append(f"lower({k}) = {quote(v)}")
        n = " + ".join(f"CAST(regexp_matches(payload, {duck_pattern(p)}) AS INT)" for p in r.patterns) or "1"
        parts.append(
            f"SELECT packet_id, {i} AS ord, {quote(r.id)} AS id, {quote(r.name)} AS name, {quote(r.severity)} AS severity, "
            f"{n} AS n_evidence FROM payloads WHERE {' AND '.join(tests) or 'true'}"
        )
    return "matched AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n_evidence > 0)"


CONF = "CASE severity WHEN 'critical' THEN 98 WHEN 'high' THEN 92 WHEN 'medium' THEN 80 WHEN 'low' THEN 65 ELSE 70 END"


@query("signature_matches", f"WITH {rules_sql()} SELECT packet_id, id, name, severity, {CONF} AS confidence, n_evidence FROM matched", over=["payloads"])
def signature_matches(spark, sf):
    return signatures.matches(views.payloads(spark, sf), STOCK_RULES).select(
        "packet_id", "id", "name", "severity", "confidence", F.size("evidence").alias("n_evidence")
    )


@query(
    "packet_alerts",
    f"WITH {rules_sql()} SELECT packet_id, string_agg(name, '|' ORDER BY ord) AS attacks, string_agg(string_split(name, ' ')[1], '|' ORDER BY ord) AS short, "
    f"max({CONF}) AS confidence, md5(substr(any_value(p.payload), 1, 512)) AS snippet_md5 FROM matched JOIN payloads p USING (packet_id) GROUP BY packet_id",
    over=["payloads"],
)
def packet_alerts(spark, sf):
    return signatures.packet_alerts(views.payloads(spark, sf), STOCK_RULES).select(
        "packet_id",
        F.array_join("attack_types", "|").alias("attacks"),
        F.array_join("attack_types_short", "|").alias("short"),
        "confidence",
        F.md5(F.encode("payload_snippet", "UTF-8")).alias("snippet_md5"),
    )


@query(
    "signature_alert_counts",
    f"WITH {rules_sql()}, a AS (SELECT packet_id, min_by(name, ord) AS attack_type, max({CONF}) AS confidence FROM matched GROUP BY 1) "
    f"SELECT CASE WHEN attack_type IN ({', '.join(map(quote, V.SERVER_CRITICAL))}) THEN 'critical' WHEN attack_type IN ({', '.join(map(quote, V.SERVER_HIGH))}) THEN 'high' "
    "WHEN attack_type IN ('Drift', 'Anomaly') THEN 'low' ELSE 'medium' END AS severity, attack_type, count(*) AS alerts, max(confidence) AS confidence FROM a GROUP BY 1, 2",
    over=["payloads"],
)
def signature_alert_counts(spark, sf):
    first = F.col("attack_types")[0]
    alerts = signatures.packet_alerts(views.payloads(spark, sf), STOCK_RULES)
    return alerts.groupBy(server_severity(first).alias("severity"), first.alias("attack_type")).agg(
        F.count(F.lit(1)).alias("alerts"), F.max("confidence").alias("confidence")
    )


@query(
    "rule_statistics",
    f"WITH {rules_sql()}, r(ord, id, severity) AS (VALUES "
    + ", ".join(f"({i}, {quote(r.id)}, {quote(r.severity)})" for i, r in enumerate(STOCK_RULES))
    + "), c AS (SELECT r.ord, r.id, r.severity, count(m.packet_id) AS matches FROM r LEFT JOIN matched m ON m.id = r.id GROUP BY ALL) "
    "SELECT * FROM (SELECT 'top' AS part, id AS name, matches FROM c ORDER BY matches DESC, ord LIMIT 10) "
    "UNION ALL SELECT 'rules', severity, count(*) FROM c GROUP BY severity UNION ALL SELECT 'matches', severity, CAST(sum(matches) AS BIGINT) FROM c GROUP BY severity",
    over=["payloads"],
)
def rule_statistics(spark, sf):
    stats = signatures.rule_stats(
        rules_table(spark, STOCK_RULES), signatures.matches(views.payloads(spark, sf), STOCK_RULES)
    )
    top = signatures.top_rules(stats).select(F.lit("top").alias("part"), F.col("id").alias("name"), "matches")
    by = signatures.severity_breakdown(stats)
    return top.unionByName(by.select(F.lit("rules").alias("part"), F.col("severity").alias("name"), F.col("rules").alias("matches"))).unionByName(
        by.select(F.lit("matches").alias("part"), F.col("severity").alias("name"), "matches")
    )


# ------------------------------------------------------------------- flows

TIMEOUT, IDLE = 8.0, 1.0

FLOW_CTES = f"""k AS (SELECT *, src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) AS is_low FROM flow_packets),
f AS (SELECT *, CASE WHEN is_low THEN concat_ws('|', src_ip, src_port, dst_ip, dst_port, '6') ELSE concat_ws('|', dst_ip, dst_port, src_ip, src_port, '6') END AS flow FROM k),
g AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY flow ORDER BY ts_us, packet_id) AS gap FROM f),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {int(TIMEOUT * 1e6)} THEN 1 ELSE 0 END) OVER (PARTITION BY flow ORDER BY ts_us, packet_id) AS sid FROM g),
o AS (SELECT *, min(ts_us) OVER (PARTITION BY flow, sid) AS session_us,
  CASE WHEN is_low = first_value(is_low) OVER (PARTITION BY flow, sid ORDER BY ts_us, packet_id) THEN 'fwd' ELSE 'bwd' END AS dir FROM s),
i AS (SELECT *, CASE WHEN ts_us = session_us THEN NULL ELSE gap END AS g1,
  ts_us - lag(ts_us) OVER (PARTITION BY flow, sid, dir ORDER BY ts_us, packet_id) AS g2 FROM o),
j AS (SELECT *, CASE WHEN g1 > 0 THEN g1 / 1e6 END AS iat, CASE WHEN g2 > 0 THEN g2 / 1e6 END AS dir_iat,
  CASE WHEN g1 > {int(IDLE * 1e6)} THEN g1 / 1e6 END AS idle,
  sum(CASE WHEN g1 > {int(IDLE * 1e6)} THEN 1 ELSE 0 END) OVER (PARTITION BY flow, sid ORDER BY ts_us, packet_id) AS isl FROM i),
act AS (SELECT flow, sid, isl, (max(ts_us) - min(ts_us)) / 1e6 AS active, isl = max(isl) OVER (PARTITION BY flow, sid) AS open FROM j GROUP BY flow, sid, isl),
act2 AS (SELECT flow, sid, avg(active) AS active_mean, stddev_pop(active) AS active_std, max(active) AS active_max, min(active) AS active_min FROM act WHERE NOT open AND active > 0 GROUP BY 1, 2),
d AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY flow, sid, dir ORDER BY ts_us, packet_id) AS pg FROM j WHERE payload_len > 0),
r AS (SELECT *, sum(CASE WHEN pg IS NULL OR pg > {int(IDLE * 1e6)} THEN 1 ELSE 0 END) OVER (PARTITION BY flow, sid, dir ORDER BY ts_us, packet_id) AS run FROM d),
b AS (SELECT flow, sid, dir, run, count(*) AS n, sum(payload_len) AS bytes, (max(ts_us) - min(ts_us)) / 1e6 AS secs FROM r GROUP BY 1, 2, 3, 4 HAVING count(*) >= 4)"""


def _bulk(d):
    return f"""b{d} AS (SELECT flow, sid, count(*) AS n, sum(n) AS pkts, sum(bytes) AS bytes, sum(secs) AS secs FROM b WHERE dir = '{d}' GROUP BY 1, 2)"""


def _flow_columns():
    cols = {
        "dst_port": "arg_min(dst_port, (ts_us, packet_id))", "protocol": "6",
        "flow_duration": "greatest(max(ts_us) - min(ts_us), 1)",
        "flow_byts_s": "sum(size) / (greatest(max(ts_us) - min(ts_us), 1) / 1e6)",
        "flow_pkts_s": "count(*) / (greatest(max(ts_us) - min(ts_us), 1) / 1e6)",
        "down_up_ratio": "count(*) FILTER (dir = 'bwd') / nullif(count(*) FILTER (dir = 'fwd'), 0)",
        "pkt_size_avg": "avg(size)", "fwd_act_data_pkts": "count(*) FILTER (dir = 'fwd' AND payload_len > 0)",
        "fwd_seg_size_min": "min(size) FILTER (dir = 'fwd')",
    }
    fn = {"min": "min", "max": "max", "mean": "avg", "std": "stddev_pop", "var": "var_pop", "tot": "sum"}
    for k in ("min", "max", "mean", "std", "var"):
        cols[f"pkt_len_{k}"] = f"{fn[k]}(size)"
    for k in ("mean", "std", "max", "min"):
        cols[f"flow_iat_{k}"] = f"{fn[k]}(iat)"
        cols[f"idle_{k}"] = f"{fn[k]}(idle)"
    letters = {"fin_flag_cnt": "F", "syn_flag_cnt": "S", "rst_flag_cnt": "R", "psh_flag_cnt": "P", "ack_flag_cnt": "A",
               "urg_flag_cnt": "U", "cwe_flag_count": "C", "ece_flag_cnt": "E"}
    for name, ch in letters.items():
        cols[name] = f"sum(length(flags) - length(replace(flags, '{ch}', '')))"
    for d in ("fwd", "bwd"):
        mine = f"FILTER (dir = '{d}')"
        cols |= {
            f"tot_{d}_pkts": f"count(*) {mine}", f"totlen_{d}_pkts": f"sum(size) {mine}",
            f"subflow_{d}_pkts": f"count(*) {mine}", f"subflow_{d}_byts": f"sum(size) {mine}",
            f"{d}_psh_flags": f"count(*) FILTER (dir = '{d}' AND contains(flags, 'P'))",
            f"{d}_urg_flags": f"count(*) FILTER (dir = '{d}' AND contains(flags, 'U'))",
            f"{d}_header_len": f"sum(header_len) {mine}",
            f"{d}_pkts_s": f"count(*) {mine} / (greatest(max(ts_us) - min(ts_us), 1) / 1e6)",
            f"{d}_seg_size_avg": f"avg(size) {mine}",
            f"init_{d}_win_byts": f"arg_min(tcp_window, (ts_us, packet_id)) FILTER (dir = '{d}' AND tcp_window IS NOT NULL)",
        }
        for k in ("max", "min", "mean", "std"):
            cols[f"{d}_pkt_len_{k}"] = f"{fn[k]}(size) {mine}"
        for k in ("tot", "mean", "std", "max", "min"):
            cols[f"{d}_iat_{k}"] = f"{fn[k]}(dir_iat) {mine}"
    return cols


def flow_sql():
    cols = _flow_columns()
    whole = ("dst_port", "protocol", "flow_duration")

    def final(name, expr):
        kind = "BIGINT" if name in whole else "DOUBLE"
        return f"coalesce(round(CAST({expr} AS {kind}), 6), 0) AS {name}" if kind == "DOUBLE" else f"CAST({expr} AS BIGINT) AS {name}"

    out = ["m.flow", "m.session_us"] + [final(n, f"m.{n}") for n in cols]
    out += [final(f"active_{k}", f"act2.active_{k}") for k in ("mean", "std", "max", "min")]
    for d in ("fwd", "bwd"):
        out += [
            final(f"{d}_byts_b_avg", f"b{d}.bytes / b{d}.n"), final(f"{d}_pkts_b_avg", f"b{d}.pkts / b{d}.n"),
            final(f"{d}_blk_rate_avg", f"b{d}.bytes / nullif(b{d}.secs, 0)"),
        ]
    main = ", ".join(f"{e} AS {n}" for n, e in cols.items())
    return (
        f"WITH {FLOW_CTES}, {_bulk('fwd')}, {_bulk('bwd')}, m AS (SELECT flow, sid, min(session_us) AS session_us, {main} FROM j GROUP BY flow, sid) "
        f"SELECT {', '.join(out)} FROM m LEFT JOIN act2 USING (flow, sid) LEFT JOIN bfwd ON bfwd.flow = m.flow AND bfwd.sid = m.sid "
        f"LEFT JOIN bbwd ON bbwd.flow = m.flow AND bbwd.sid = m.sid"
    )


@query("flow_features", flow_sql(), over=["flow_packets"])
def flow_features(spark, sf):
    return rounded(ff.flow_features(views.flow_packets(spark, sf), TIMEOUT, IDLE))


def running_sql():
    """The features after each packet: the same figures over the rows of the session so far."""
    cols = _flow_columns()
    over = "OVER w"
    out = ["packet_id", "flow", "session_us"]
    for name, expr in cols.items():
        if name in ("dst_port", "protocol"):
            run = "first_value(dst_port) OVER w" if name == "dst_port" else "6"
        elif name.startswith("init_"):
            d = name.split("_")[1]
            run = f"first_value(CASE WHEN dir = '{d}' THEN tcp_window END IGNORE NULLS) OVER w"
        else:
            run = re.sub(r"\b(sum|min|max|avg|count|stddev_pop|var_pop)(\((?:\*|[a-z_]+|length\(flags\) - length\(replace\(flags, '.', ''\)\))\))( FILTER \([^()]*(?:\([^()]*\))?[^()]*\))?", r"\1\2\3 OVER w", expr)
        kind = "BIGINT" if name in ("dst_port", "protocol", "flow_duration") else "DOUBLE"
        out.append(f"CAST({run} AS BIGINT) AS {name}" if kind == "BIGINT" else f"coalesce(round(CAST({run} AS DOUBLE), 6), 0) AS {name}")
    for k, f in (("mean", "avg"), ("std", "stddev_pop"), ("max", "max"), ("min", "min")):
        out.append(f"coalesce(round({f}(awake) {over}, 6), 0) AS active_{k}")
    for d in ("fwd", "bwd"):
        n, b = f"sum(bn) FILTER (dir = '{d}') OVER w", f"sum(bb) FILTER (dir = '{d}') OVER w"
        out += [
            f"coalesce(round({b} / nullif({n}, 0), 6), 0) AS {d}_byts_b_avg",
            f"coalesce(round(sum(bp) FILTER (dir = '{d}') OVER w / nullif({n}, 0), 6), 0) AS {d}_pkts_b_avg",
            f"coalesce(round({b} / nullif(sum(bs) FILTER (dir = '{d}') OVER w, 0), 6), 0) AS {d}_blk_rate_avg",
        ]
    return (
        f"WITH {FLOW_CTES}, "
        "aw AS (SELECT flow, sid, isl, min(ts_us) AS isl_from, max(ts_us) AS isl_to FROM j GROUP BY 1, 2, 3), "
        "p AS (SELECT *, row_number() OVER (PARTITION BY flow, sid, dir, run ORDER BY ts_us, packet_id) AS pos, "
        "sum(payload_len) OVER (PARTITION BY flow, sid, dir, run ORDER BY ts_us, packet_id) AS vol, "
        "min(ts_us) OVER (PARTITION BY flow, sid, dir, run) AS run_from FROM r), "
        "inc AS (SELECT packet_id, CAST(pos = 4 AS INT) AS bn, CASE WHEN pos = 4 THEN 4 WHEN pos > 4 THEN 1 ELSE 0 END AS bp, "
        "CASE WHEN pos = 4 THEN vol WHEN pos > 4 THEN payload_len ELSE 0 END AS bb, CASE WHEN pos = 4 THEN (ts_us - run_from) / 1e6 WHEN pos > 4 THEN pg / 1e6 ELSE 0 END AS bs FROM p), "
        "x AS (SELECT j.*, bn, bp, bb, bs, CASE WHEN idle IS NOT NULL AND isl_to > isl_from THEN (isl_to - isl_from) / 1e6 END AS awake FROM j "
        "LEFT JOIN inc USING (packet_id) LEFT JOIN aw ON aw.flow = j.flow AND aw.sid = j.sid AND aw.isl = j.isl - 1) "
        f"SELECT {', '.join(out)} FROM x WINDOW w AS (PARTITION BY flow, sid ORDER BY ts_us, packet_id ROWS UNBOUNDED PRECEDING)"
    )


@query("running_flow_features", running_sql(), over=["flow_packets"])
def running_flow_features(spark, sf):
    return rounded(ff.flow_features(views.flow_packets(spark, sf), TIMEOUT, IDLE, running=True))


@query(
    "flow_sessions",
    f"WITH {FLOW_CTES} SELECT packet_id, flow, session_us, dir, round(iat, 6) AS iat, round(dir_iat, 6) AS dir_iat, round(idle, 6) AS idle FROM j",
    over=["flow_packets"],
)
def flow_sessions(spark, sf):
    rows = ff.sessionize(views.flow_packets(spark, sf), TIMEOUT, IDLE)
    # each flow session has one first side
    first = rows.groupBy("flow", "session_us").agg(F.min_by("side", F.struct("ts_us", "packet_id")).alias("first"))
    return rounded(
        rows.join(first, ["flow", "session_us"]).select(
            "packet_id", "flow", "session_us", F.when(F.col("side") == F.col("first"), "fwd").otherwise("bwd").alias("dir"),
            "iat", F.col("side_iat").alias("dir_iat"), "idle",
        )
    )


@query(
    "bulk_transfers",
    f"WITH {FLOW_CTES} SELECT flow, min(session_us) AS session_us, count(*) AS runs, CAST(sum(b.n) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(secs), 6) AS secs "
    "FROM b JOIN (SELECT DISTINCT flow, sid, session_us FROM j) USING (flow, sid) GROUP BY flow, sid",
    over=["flow_packets"],
)
def bulk_transfers(spark, sf):
    return rounded(ff.bulk_totals(ff.sessionize(views.flow_packets(spark, sf), TIMEOUT, IDLE)))


def packet17_sql(span):
    w = f"OVER (PARTITION BY flow ORDER BY ts_us RANGE BETWEEN {span} PRECEDING AND CURRENT ROW)"

    def own(agg, extra=""):
        return f"{agg} FILTER (dir = 'fwd'{extra}) {w}"

    n = own("count(*)")
    cols = {
        "Dst Port": "dst_port", "Protocol": "6", "TotLen Fwd Pkts": own("sum(size)"), "Fwd Pkt Len Max": own("max(size)"),
        "Fwd Pkt Len Mean": own("avg(size)"),
        "Flow Byts/s": f"sum(size) {w} / (greatest(ts_us - min(ts_us) {w}, 1) / 1e6)",
        "Fwd Header Len": own("sum(header_len)"), "Fwd Pkt Len Min": own("min(size)"),
        "Fwd Pkt Len Std": own("stddev_pop(size)"),
        "Down/Up Ratio": f"count(*) FILTER (dir = 'bwd') {w} / nullif({n}, 0)",
        "Fwd Pkts/s": f"CASE WHEN {n} > 1 THEN {n} / (greatest({own('max(ts_us)')} - {own('min(ts_us)')}, 1) / 1e6) END",
    }
    for name, ch in {"PSH": "P", "URG": "U", "FIN": "F", "SYN": "S", "RST": "R", "ACK": "A"}.items():
        cols[f"{name} Flag Cnt"] = f"count(*) FILTER (contains(flags, '{ch}')) {w}"
    out = ", ".join(f'round(coalesce(CAST({e} AS DOUBLE), 0), 6) AS "{n}"' for n, e in cols.items())
    return (
        "WITH k AS (SELECT *, src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) AS is_low FROM flow_packets), "
        "f AS (SELECT *, CASE WHEN is_low THEN concat_ws('|', src_ip, src_port, dst_ip, dst_port, '6') ELSE concat_ws('|', dst_ip, dst_port, src_ip, src_port, '6') END AS flow FROM k), "
        "o AS (SELECT *, CASE WHEN is_low = first_value(is_low) OVER (PARTITION BY flow ORDER BY ts_us, packet_id) THEN 'fwd' ELSE 'bwd' END AS dir FROM f) "
        f"SELECT packet_id, flow, {out} FROM o"
    )


@query("packet_features", packet17_sql(5_000_000), over=["flow_packets"])
def packet_features(spark, sf):
    return rounded(ff.packet_features(views.flow_packets(spark, sf), window_s=5.0).drop("ts_us"))


# ------------------------------------------------------------ rates, baselines


@query(
    "rate_alerts",
    f"""WITH t AS (SELECT packet_id, src_ip, count(*) OVER (PARTITION BY src_ip ORDER BY ts_us RANGE BETWEEN {DAY * 1_000_000} PRECEDING AND CURRENT ROW) AS in_window,
      row_number() OVER (PARTITION BY src_ip ORDER BY ts_us, packet_id) AS packets_analyzed FROM packets)
    SELECT packet_id, src_ip, in_window, packets_analyzed, round(least(0.95, 0.60 + (in_window - 4) * 0.05), 6) AS confidence FROM t WHERE in_window >= 4""",
    over=["packets"],
)
def rate_alerts(spark, sf):
    out = rate.rate_alerts(views.packets(spark, sf), threshold=4, window_s=float(DAY))
    return rounded(out.select("packet_id", "src_ip", "in_window", "packets_analyzed", "confidence"))


@query("top_attackers", "SELECT src_ip, count(*) AS hits FROM packets GROUP BY 1 ORDER BY hits DESC, src_ip LIMIT 5", over=["packets"])
def top_attackers(spark, sf):
    return rate.top_sources(views.packets(spark, sf))


@query(
    "adaptive_threshold",
    """WITH t AS (SELECT alert_id, location, value, row_number() OVER w AS rn, quantile_cont(value, 0.01) OVER (w ROWS BETWEEN 499 PRECEDING AND CURRENT ROW) AS q
      FROM alerts WINDOW w AS (PARTITION BY location ORDER BY ts_us, alert_id))
    SELECT alert_id, round(CASE WHEN rn >= 200 THEN q END, 6) AS threshold, coalesce(rn >= 200 AND value < q, false) AS is_anomaly FROM t""",
    over=["alerts"],
)
def adaptive_threshold(spark, sf):
    out = baseline.adaptive_threshold(views.alerts(spark, sf), "location", ["ts_us", "alert_id"], score="value")
    return rounded(out.select("alert_id", "threshold", "is_anomaly"))


@query(
    "ewma_baseline",
    """WITH RECURSIVE n AS (SELECT location, CAST(size AS DOUBLE) AS a, CAST(payload_len AS DOUBLE) AS b, row_number() OVER (PARTITION BY location ORDER BY ts_us, packet_id) AS rn FROM packets),
    r AS (SELECT location, rn, a AS ma, 0.0::DOUBLE AS va, b AS mb, 0.0::DOUBLE AS vb FROM n WHERE rn = 1
      UNION ALL SELECT n.location, n.rn, 0.95 * ma + 0.05 * a, 0.95 * (va + 0.05 * (a - ma) ** 2), 0.95 * mb + 0.05 * b, 0.95 * (vb + 0.05 * (b - mb) ** 2)
      FROM r JOIN n ON n.location = r.location AND n.rn = r.rn + 1)
    SELECT location, max(rn) AS n, round(max_by(ma, rn), 6) AS mean_size, round(max_by(va, rn), 6) AS var_size, round(max_by(mb, rn), 6) AS mean_payload_len, round(max_by(vb, rn), 6) AS var_payload_len FROM r GROUP BY 1""",
    over=["packets"],
)
def ewma_baseline(spark, sf):
    p = views.packets(spark, sf).select("location", "ts_us", "packet_id", F.col("size").cast("double"), F.col("payload_len").cast("double"))
    return rounded(baseline.moving_baseline(p, "location", ["ts_us", "packet_id"], ["size", "payload_len"]))


DRIFT_FEATURES = ["size", "payload_len", "value"]


@query(
    "drift_alerts",
    """WITH RECURSIVE st AS (SELECT avg(size) AS m1, stddev_pop(size) AS s1, avg(payload_len) AS m2, stddev_pop(payload_len) AS s2, avg(value) AS m3, stddev_pop(value) AS s3 FROM packets),
    w AS (SELECT location, ts_us, packet_id, count(*) OVER f AS n, avg(size) OVER f AS a1, avg(payload_len) OVER f AS a2, avg(value) OVER f AS a3 FROM packets
      WINDOW f AS (PARTITION BY location ORDER BY ts_us, packet_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
    z AS (SELECT w.*, CAST(abs(a1 - m1) / s1 >= 0.08 AS INT) + CAST(abs(a2 - m2) / s2 >= 0.08 AS INT) + CAST(abs(a3 - m3) / s3 >= 0.08 AS INT) AS k FROM w, st),
    h AS (SELECT location, ts_us, packet_id, k, row_number() OVER (PARTITION BY location ORDER BY ts_us, packet_id) AS rn FROM z WHERE n >= 50 AND k >= 2),
    g AS (SELECT location, rn, ts_us AS kept, true AS keep FROM h WHERE rn = 1
      UNION ALL SELECT h.location, h.rn, CASE WHEN h.ts_us - kept >= 7200000000 THEN h.ts_us ELSE kept END, h.ts_us - kept >= 7200000000 FROM g JOIN h ON h.location = g.location AND h.rn = g.rn + 1)
    SELECT packet_id, location, k AS n_features, 0.6::DOUBLE AS confidence FROM h JOIN g USING (location, rn) WHERE keep""",
    over=["packets"],
)
def drift_alerts(spark, sf):
    p = views.packets(spark, sf).select("location", "ts_us", "packet_id", *[F.col(f).cast("double") for f in DRIFT_FEATURES])
    out = baseline.drift_alerts(
        p, "location", ["ts_us", "packet_id"], DRIFT_FEATURES, baseline.baseline_stats(p, DRIFT_FEATURES),
        window=200, z_at=0.08, min_features=2, cooldown_us=7_200_000_000,
    )
    return out.select("packet_id", "location", "n_features", "confidence")


@query(
    "model_health",
    f"""WITH d AS (SELECT alert_id, location, ts_us FROM alerts WHERE attack_type = 'Anomaly'),
    t AS (SELECT *, count(*) OVER (PARTITION BY location ORDER BY ts_us RANGE BETWEEN {DAY * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS recent FROM d)
    SELECT alert_id, recent, CASE WHEN recent >= 8 THEN 'red' WHEN recent >= 4 THEN 'yellow' ELSE 'green' END AS health, recent >= 8 AS retrain FROM t""",
    over=["alerts"],
)
def model_health(spark, sf):
    from threatflow.operators.models import model_health as health

    drift = views.alerts(spark, sf).where("attack_type = 'Anomaly'").select("alert_id", "location", "ts_us")
    return health(drift, "location", window_s=DAY, red_at=8).select("alert_id", "recent", "health", "retrain")


@query(
    "baseline_statistics",
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(avg({f}), 6) AS mean, round(CASE WHEN stddev_pop({f}) = 0 THEN 1.0 ELSE stddev_pop({f}) END, 6) AS std, CAST(min({f}) AS DOUBLE) AS min, CAST(max({f}) AS DOUBLE) AS max FROM packets"
        for f in [*DRIFT_FEATURES, "header_len"]
    ),
    over=["packets"],
)
def baseline_statistics(spark, sf):
    return rounded(baseline.baseline_stats(views.packets(spark, sf), [*DRIFT_FEATURES, "header_len"]))


# ------------------------------------------------------------- risk and fusion

RISK_INPUT = """SELECT packet_id, CASE WHEN packet_id % 4 = 0 THEN NULL ELSE value / 100 END AS x, value > 90 AS hit,
  CASE WHEN packet_id % 3 = 0 THEN NULL ELSE value END AS a, CASE WHEN packet_id % 3 = 0 THEN NULL ELSE value > 40 END AS odd,
  CASE WHEN packet_id % 5 = 0 THEN 0.6 END AS d FROM packets"""


@query(
    "risk_scores",
    f"""WITH i AS ({RISK_INPUT}), n AS (SELECT *, CASE WHEN x > 100 THEN 1.0 WHEN x > 1 THEN x / 100 ELSE x END AS xs,
      CASE WHEN NOT odd THEN 0.0 WHEN a > 100 THEN 1.0 WHEN a > 1 THEN a / 100 ELSE a END AS os FROM i),
    w AS (SELECT *, CASE WHEN x IS NULL THEN 0 ELSE 0.55 END + CASE WHEN odd IS NULL THEN 0 ELSE 0.30 END + CASE WHEN d IS NULL THEN 0 ELSE 0.15 END AS tw FROM n)
    SELECT packet_id, round(CASE WHEN tw > 0 THEN (coalesce(xs * 0.55, 0) + coalesce(os * 0.30, 0) + coalesce(d * 0.15, 0)) / tw ELSE 0 END, 6) AS score,
      concat_ws(',', CASE WHEN hit OR xs >= 0.5 THEN 'xgboost' END, CASE WHEN odd THEN 'anomaly' END, CASE WHEN d IS NOT NULL THEN 'drift' END) AS signals FROM w""",
    over=["packets"],
)
def risk_scores(spark, sf):
    p = views.packets(spark, sf)
    k, v = F.col("packet_id"), F.col("value")
    score = fusion.risk(
        F.when(k % 4 != 0, v / 100), v > 90, F.when(k % 3 != 0, v), F.when(k % 3 != 0, v > 40), F.when(k % 5 == 0, 0.6)
    )
    return rounded(p.select("packet_id", score.alias("r")).select(
        "packet_id", "r.score", F.array_join("r.signals", ",").alias("signals")
    ))


STREAMS_SQL = """u AS (
  SELECT packet_id, 0 AS ord, 'rule-based-detector' AS detector, 'flagged' AS action, 0.92 AS confidence, ['SQL Injection'] AS attack_types FROM packets WHERE event_type = 'click'
  UNION ALL SELECT packet_id, 1, 'dos-detector', 'blocked', round(least(0.95, value / 100), 6), ['DDoS'] FROM packets WHERE value > 60
  UNION ALL SELECT packet_id, 3, 'isolation-forest', 'flagged', 0.8, ['Anomaly', 'SQL Injection'] FROM packets WHERE value < 30
  UNION ALL SELECT packet_id, 4, 'drift-monitor', 'flagged', 0.6, ['Drift'] FROM packets WHERE event_type = 'error')"""


def detector_streams(spark, sf):
    p = views.packets(spark, sf)

    def stream(cond, detector, action, conf, types):
        return p.where(cond).select(
            "packet_id", F.lit(detector).alias("detector"), F.lit(action).alias("action"),
            conf.alias("confidence"), F.array(*[F.lit(t) for t in types]).alias("attack_types"),
        )

    return {
        "rule": stream("event_type = 'click'", "rule-based-detector", "flagged", F.lit(0.92), ["SQL Injection"]),
        "dos": stream("value > 60", "dos-detector", "blocked", F.round(F.least(F.lit(0.95), F.col("value") / 100), 6), ["DDoS"]),
        "anomaly": stream("value < 30", "isolation-forest", "flagged", F.lit(0.8), ["Anomaly", "SQL Injection"]),
        "drift": stream("event_type = 'error'", "drift-monitor", "flagged", F.lit(0.6), ["Drift"]),
    }


@query(
    "detector_union",
    f"WITH {STREAMS_SQL} SELECT packet_id, CASE ord WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE ord END AS ord, detector, confidence, array_to_string(attack_types, ',') AS attacks FROM u",
    over=["packets"],
)
def detector_union(spark, sf):
    return fusion.union_detectors(detector_streams(spark, sf)).select(
        "packet_id", "ord", "detector", "confidence", F.array_join("attack_types", ",").alias("attacks")
    )


@query(
    "alert_fusion",
    f"""WITH {STREAMS_SQL}, w AS (SELECT *, CASE detector WHEN 'rule-based-detector' THEN 0.7 WHEN 'dos-detector' THEN 0.9 WHEN 'isolation-forest' THEN 0.5 ELSE 0.6 END AS wt FROM u),
    t AS (SELECT packet_id, ord, unnest(attack_types) AS a, unnest(range(1, len(attack_types) + 1)) AS pos FROM u),
    f AS (SELECT packet_id, a, min(ord * 100 + pos) AS o FROM t GROUP BY 1, 2),
    l AS (SELECT packet_id, string_agg(a, ',' ORDER BY o) AS attacks FROM f GROUP BY 1)
    SELECT packet_id, count(*) AS n_alerts, arg_min(detector, (-confidence, ord)) AS base_detector, round(max(confidence), 6) AS confidence,
      round(CASE WHEN count(*) > 1 THEN max(confidence * wt) END, 6) AS fusion_score, any_value(attacks) AS attacks,
      string_agg(detector, ',' ORDER BY ord) AS detectors, arg_min(action, (CASE WHEN action = 'blocked' THEN 0 ELSE 1 END, ord)) AS action
    FROM w JOIN l USING (packet_id) GROUP BY packet_id""",
    over=["packets"],
)
def alert_fusion(spark, sf):
    out = fusion.fuse(fusion.union_detectors(detector_streams(spark, sf)))
    return rounded(out.select(
        "packet_id", "n_alerts", "base_detector", "confidence", "fusion_score",
        F.array_join("attack_types", ",").alias("attacks"), F.array_join("detectors", ",").alias("detectors"), "action",
    ))
