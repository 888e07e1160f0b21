"""Boundaries of the operators on small literal inputs, and hot keys cut into chunks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatflow.functions import fields, values as V, verdicts
from threatflow.operators import baseline, correlate, evaluate, flow_features as ff, fusion, lookup, prep, rate, respond, signatures
from threatflow.plans import views
from threatflow.sources import csv_days, messages, rules, stores

S = 1_000_000
SF = "/root/testdata/sf0.001"
PACKET = "packet_id long, ts_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, size int, payload_len int, header_len int, flags string, tcp_window int"


def packets(spark, rows):
    """(seconds, from, size, payload_len) rows of one connection between a and b."""
    full = [
        (i, int(t * S), *(("a", "b", 1000, 80) if src == "a" else ("b", "a", 80, 1000)), "tcp", size, data, 20, "PA", 100 + i)
        for i, (t, src, size, data) in enumerate(rows)
    ]
    return spark.createDataFrame(full, PACKET)


# ---------------------------------------------------------------- signatures


def test_stock_rules():
    assert len(rules.STOCK_RULES) == 32
    by = [r.severity for r in rules.STOCK_RULES]
    assert [by.count(s) for s in ("critical", "high", "medium", "low")] == [10, 12, 7, 3]
    assert len(rules.built_in_rules()) == 6


def matched(spark, packet, table=rules.STOCK_RULES):
    df = spark.createDataFrame([packet], "payload string, protocol string, dst_port int, service string")
    return {r["name"]: r["confidence"] for r in signatures.with_matches(df, table).first()["signatures"]}


def test_signature_hits(spark):
    assert matched(spark, ("SELECT * FROM users WHERE id=1 OR 1=1", "tcp", 80, None))["SQL Injection"] >= 80
    assert matched(spark, ("<script>alert('x')</script>", "tcp", 80, None)) == {"Cross-Site Scripting": 80}
    assert matched(spark, ("GET /index.html", "tcp", 80, None)) == {}


def test_signature_guards(spark):
    text = "x' or 'y"
    assert "SQL Injection" in matched(spark, (text, None, None, None))
    assert "SQL Injection" in matched(spark, (text, "6", 0, None))
    assert matched(spark, (text, "udp", 80, None)) == {}
    assert matched(spark, (text, "tcp", 22, None)) == {}
    assert matched(spark, ("", "tcp", 21, "FTP")) == {"FTP Brute Force Signature": 80}
    assert matched(spark, ("", "tcp", 21, None)) == {}


def test_needed_texts_are_needed():
    import re

    for rule in rules.STOCK_RULES:
        for pattern in rule.patterns:
            texts = rules.needed_texts(pattern)
            for sample in ("select 1", "upload.exe", "cmd.php?x", "../../etc/passwd", "ms17-010", "evil-winrm", "a--b", "c99"):
                if texts and re.search(pattern, sample):
                    assert any(t in sample.lower() for t in texts), (pattern, sample)


def test_texts_are_sought_together(spark):
    import pyarrow as pa

    texts = signatures.needed_by(rules.STOCK_RULES)
    payloads = ["", "nmapsexec", "overpass the shell.php", "\u00e9 $_ (eval", None, "x" * 5000 + "xmrig", " ".join(texts)]
    found = signatures.found_texts(pa.array(payloads), texts).to_pylist()
    assert found == [[i for i, t in enumerate(texts) if t in (p or "")] for p in payloads]
    many = [f"{i:04d}" for i in range(3 * signatures.TOGETHER + 1)]
    assert signatures.found_texts(pa.array(["0000 0256 0768", "none"]), many).to_pylist() == [[0, 256, 768], []]
    assert signatures.found_texts(pa.array([], pa.string()), many).to_pylist() == []
    # a payload is not searched once more for each of the texts
    df = spark.createDataFrame([("a --", "tcp", 80, None)], "payload string, protocol string, dst_port int, service string")
    plan = signatures.with_matches(df, rules.STOCK_RULES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Contains(" not in plan


def test_rule_editing(spark):
    mine = rules.rule_from({"id": "m", "name": "Mine", "severity": "odd", "payload_patterns": ["zz+", "(open"]})
    with pytest.warns(UserWarning):
        checked = rules.check_patterns(spark, [mine])
    assert checked[0].patterns == ("zz+",)
    assert matched(spark, ("fizz zz", None, None, None), checked) == {"Mine": 70}
    table = rules.add_rule(rules.STOCK_RULES, mine)
    with pytest.raises(ValueError):
        rules.add_rule(table, mine)
    assert rules.remove_rule(table, "m") == rules.STOCK_RULES
    with pytest.raises(KeyError):
        rules.remove_rule(rules.STOCK_RULES, "m")
    assert rules.load_rules("/nowhere.yaml") == rules.built_in_rules()


# --------------------------------------------------------------------- flows


def test_flow_timeout_and_idle(spark):
    df = packets(spark, [(0, "a", 10, 0), (1, "b", 20, 0), (121, "a", 30, 0), (241.000001, "a", 40, 0)])
    rows = {r["session_us"]: r for r in ff.flow_features(df).collect()}
    assert set(rows) == {0, 241_000_001}
    one = rows[0]
    assert (one["tot_fwd_pkts"], one["tot_bwd_pkts"], one["down_up_ratio"]) == (2, 1, 0.5)
    # the gap of exactly one second is no pause, the one of 120 s is, and closes the first active span
    assert (one["idle_max"], one["active_max"], one["flow_duration"]) == (120.0, 1.0, 121 * S)
    last = rows[241_000_001]
    assert (last["flow_duration"], last["flow_byts_s"], last["tot_fwd_pkts"]) == (1, 40 / 1e-6, 1)


@pytest.mark.parametrize("n,runs", [(3, 0), (4, 1)])
def test_bulk_runs(spark, n, runs):
    rows = [(i * 0.5, "a", 100, 50) for i in range(n)] + [(0.75, "a", 40, 0), (9, "a", 100, 50)]
    out = ff.flow_features(packets(spark, sorted(rows))).first()
    assert out["fwd_pkts_b_avg"] == n * runs
    assert out["fwd_byts_b_avg"] == 50 * n * runs


def test_direction_follows_first_packet(spark):
    df = packets(spark, [(0, "b", 10, 0), (1, "a", 20, 0)])
    out = ff.flow_features(df).first()
    assert (out["totlen_fwd_pkts"], out["totlen_bwd_pkts"], out["dst_port"]) == (10, 20, 1000)


def test_packet_window(spark):
    df = packets(spark, [(0, "a", 10, 0), (1, "a", 30, 0), (2.000001, "b", 5, 0)])
    rows = {r["packet_id"]: r for r in ff.packet_features(df).collect()}
    assert rows[0]["Flow Byts/s"] == 10 / 1e-6 and rows[0]["Fwd Pkts/s"] == 0
    assert rows[1]["TotLen Fwd Pkts"] == 40 and rows[1]["Fwd Pkts/s"] == 2 and rows[1]["Fwd Pkt Len Std"] == 10
    assert rows[2]["TotLen Fwd Pkts"] == 0 and rows[2]["Down/Up Ratio"] == 0


def same(a, b):
    def key(df):
        # borders away from means of whole numbers, as in the catalog
        return sorted(repr([math.floor(v * 1e6 + 0.3127) if isinstance(v, float) else v for v in r]) for r in df.collect())

    assert key(a.select(sorted(a.columns))) == key(b.select(sorted(b.columns)))


def test_hot_keys_change_nothing(spark):
    p, a = views.packets(spark, SF), views.alerts(spark, SF)
    flow = views.flow_packets(spark, SF)
    same(ff.flow_features(flow, 8.0, 1.0), ff.flow_features(flow, 8.0, 1.0, chunk_rows=20))
    run = ff.flow_features(flow, 8.0, 1.0, running=True)
    same(run, ff.flow_features(flow, 8.0, 1.0, running=True, chunk_rows=20))
    args = dict(threshold=3, window_s=86_400.0)
    same(rate.rate_alerts(p, **args), rate.rate_alerts(p, **args, chunk_rows=10))
    same(correlate.chain_alerts(a, 86_400), correlate.chain_alerts(a, 86_400, chunk_rows=10))
    same(respond.incidents(a, 86_400).drop("mixed_types"), respond.incidents(a, 86_400, chunk_rows=10).drop("mixed_types"))
    size = p.select("location", "ts_us", "packet_id", F.col("size").cast("double"))
    cols = ("location", ["ts_us", "packet_id"], ["size"])
    same(baseline.moving_baseline(size, *cols), baseline.moving_baseline(size, *cols, chunk_rows=50))
    stats = baseline.baseline_stats(size, ["size"])
    drift = dict(window=60, z_at=0.05, min_features=1, cooldown_us=S * 3600)
    same(baseline.drift_alerts(size, *cols, stats, **drift), baseline.drift_alerts(size, *cols, stats, **drift, chunk_rows=50))
    thr = dict(score="value", window=50, least=20)
    same(
        baseline.adaptive_threshold(a, "location", ["ts_us", "alert_id"], **thr),
        baseline.adaptive_threshold(a, "location", ["ts_us", "alert_id"], **thr, chunk_rows=30),
    )
    s = views.scored(spark, SF)
    same(evaluate.ranking(s, "y", "p"), evaluate.ranking(s, "y", "p", chunk_rows=5))
    same(evaluate.tune_threshold(s, "y", "p", 0.1), evaluate.tune_threshold(s, "y", "p", 0.1, chunk_rows=5))


# ---------------------------------------------------------------------- rates


def test_rate_boundary(spark):
    rows = [(0, "s", 0)] + [(i, "s", 10 * S - 99 + i) for i in range(1, 100)]
    df = spark.createDataFrame(rows, "packet_id long, src_ip string, ts_us long")
    out = rate.rate_alerts(df).collect()
    assert [(r["packet_id"], r["in_window"], r["confidence"]) for r in out] == [(99, 100, 0.6)]
    late = df.withColumn("ts_us", F.when(F.col("packet_id") == 0, F.lit(-1)).otherwise(F.col("ts_us")))
    assert rate.rate_alerts(late).count() == 0


def test_burst_of_ten(spark):
    df = spark.createDataFrame([(i, "s", i * 1000) for i in range(10)], "packet_id long, src_ip string, ts_us long")
    out = rate.rate_alerts(df, threshold=5, window_s=5.0)
    assert sorted(r["packet_id"] for r in out.collect()) == [4, 5, 6, 7, 8, 9]
    spread = df.withColumn("src_ip", F.col("packet_id").cast("string"))
    assert rate.rate_alerts(spread, threshold=5, window_s=5.0).count() == 0


def test_rate_limit(spark):
    df = spark.createDataFrame([(i, "s", i) for i in range(4)] + [(9, "s", 60 * S)], "packet_id long, k string, ts_us long")
    out = {r["packet_id"]: (r["allowed"], r["remaining"], r["reset_s"]) for r in rate.rate_limit(df, "k", 2).collect()}
    assert out == {0: (True, 1, 60), 1: (True, 0, 60), 2: (False, 0, 60), 3: (False, 0, 60), 9: (True, 1, 120)}


def test_histogram_quantile(spark):
    df = spark.createDataFrame([(x,) for x in (0.05, 0.2, 0.3, 0.4)], "v double")
    assert rate.histogram_quantile(df, "v", V.LATENCY_BUCKETS, 0.5).first()["quantile"] == pytest.approx(0.1 + 0.4 / 3)
    assert rate.histogram_quantile(df.limit(0), "v", V.LATENCY_BUCKETS, 0.5).first()["quantile"] is None


# ------------------------------------------------------- chains and correlation

ALERT = "alert_id long, ts_us long, source_ip string, dest_ip string, attack_type string, confidence double"


def alerts(spark, rows):
    df = spark.createDataFrame([(i, int(t * S), s, d, a, c) for i, (t, s, d, a, c) in enumerate(rows)], ALERT)
    return df.withColumn("attack_types", F.array("attack_type"))


def test_kill_chain_emits_on_new_stages(spark):
    names = ["Port Scanning", "SQL Injection", "SSH Brute Force", "SSH Brute Force", "Data Exfiltration", "Unknown"]
    df = alerts(spark, [(i, "s", "d", n, 0.5) for i, n in enumerate(names)])
    out = correlate.chain_alerts(df).orderBy("trigger_id").collect()
    assert [(r["trigger_id"], r["n_stages"], r["total_alerts"]) for r in out] == [(2, 3, 3), (4, 4, 5)]
    assert [(r["completeness"], r["severity"], r["confidence"], r["action"]) for r in out] == [
        (0.43, "high", 62, "flagged"), (0.57, "high", 77, "block")]


@pytest.mark.parametrize("gap,chains", [(300, 1), (300.001, 2)])
def test_kill_chain_gap(spark, gap, chains):
    df = alerts(spark, [(0, "s", "d", "Port Scanning", 0.5), (gap, "s", "d", "SQL Injection", 0.5)])
    assert correlate.chain_steps(df).select("chain_us").distinct().count() == chains


def test_partner_on_both_sides_counts_twice(spark):
    df = alerts(spark, [(0, "s", "d", "A", 0.1), (1, "s", "d", "B", 0.1), (300.5, "s", "x", "C", 0.95), (301, "q", "d", "D", 0.2)])
    out = {r["alert_id"]: r for r in correlate.correlations(df).collect()}
    assert set(out) == {1, 2}
    assert (out[1]["partners"], out[1]["attack_types"]) == (2, ["A", "B"])
    assert out[1]["confidence"] == pytest.approx(0.2) and out[2]["confidence"] == 0.99


def test_boost_is_capped(spark):
    df = alerts(spark, [(i, "s", "d", "A", 0.5) for i in range(9)])
    assert max(r["confidence"] for r in correlate.correlations(df).collect()) == pytest.approx(0.7)


# ----------------------------------------------------------- lookups and scores


@pytest.mark.parametrize("name,technique,severity", [
    ("SQL Injection", ["T1190"], "critical"), ("brute force", ["T1110"], "high"), ("Massive DDoS Flood", ["T1498"], "critical"),
    ("Strange", [], "medium"), ("injection", ["T1190"], "critical"),
])
def test_lookup(spark, name, technique, severity):
    df = spark.createDataFrame([([name],)], "attack_types array<string>")
    row = lookup.map_techniques(df).withColumn("p", lookup.playbook_of(F.lit(name))).first()
    assert (row["mitre_techniques"], row["p"]["severity"]) == (technique, severity)
    assert [s["priority"] for s in row["p"]["steps"]] == list(range(1, len(row["p"]["steps"]) + 1))


@pytest.mark.parametrize("raw,want", [("0.4", 0.4), ("1", 1.0), ("1.5", 0.015), ("98", 0.98), ("250", 1.0), ("-1", 0.0), ("text", 0.0), (None, 0.0)])
def test_confidence(spark, raw, want):
    assert spark.range(1).select(fields.confidence(F.lit(raw).cast("string"))).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("x,odd,d,want", [
    (0.8, True, 0.6, (0.8 * 0.55 + 0.9 * 0.3 + 0.6 * 0.15)), (0.8, None, None, 0.8), (None, True, None, 0.9),
    (None, False, None, 0.0), (None, None, None, 0.0), (0.4, False, None, 0.4 * 0.55 / 0.85),
])
def test_risk(spark, x, odd, d, want):
    lit = lambda v, t: F.lit(v).cast(t)
    r = fusion.risk(lit(x, "double"), F.lit(False), lit(0.9, "double"), lit(odd, "boolean"), lit(d, "double"))
    assert spark.range(1).select(r["score"]).first()[0] == pytest.approx(want)


def test_empty_types_count_as_false_positive(spark):
    df = spark.createDataFrame([([],), (["Odd"],), (["Drift"],)], "t array<string>")
    assert [r[0] for r in df.select(verdicts.is_true_positive(F.col("t"), F.lit(0.1))).collect()] == [False, True, False]


# ----------------------------------------------------------------- evaluation


def brute(y, p):
    pairs = [(a > b) + 0.5 * (a == b) for a, ya in zip(p, y) if ya for b, yb in zip(p, y) if not yb]
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        tp = sum(1 for s, v in zip(p, y) if s >= t and v)
        ap += (tp / sum(y) - last) * tp / sum(1 for s in p if s >= t)
        last = tp / sum(y)
    return sum(pairs) / len(pairs), ap


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ranking_against_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    y = [int(v) for v in rng.integers(0, 2, 80)]
    p = [float(v) for v in rng.integers(0, 12, 80) / 10]
    row = evaluate.ranking(spark.createDataFrame(list(zip(y, p)), "y int, p double"), "y", "p", chunk_rows=3).first()
    assert (row["roc_auc"], row["pr_auc"]) == pytest.approx(brute(y, p))


def test_one_class_has_no_ranking(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, p double")
    assert evaluate.ranking(df, "y", "p").first()["roc_auc"] is None
    assert evaluate.tune_threshold(df, "y", "p", 0.1).first()["best_f1"] is None


# -------------------------------------------------------------------- sources


def test_align_fails_on_missing_columns(spark):
    with pytest.raises(ValueError):
        prep.align_features(spark.range(1), ["id", "a"])


def test_day_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Dst Port,Flow Byts/s,Src IP,Label\n80,Infinity,1.1.1.1,Benign\nDst Port,Flow Byts/s,Src IP,Label\n443,2.5,1.1.1.2,Bot\n")
    (tmp_path / "b.csv").write_text("Label,Dst Port,Extra\nBenign,x,7\n")
    with pytest.warns(UserWarning):
        df = csv_days.load_days(spark, str(tmp_path), ["a.csv", "b.csv", "c.csv"], keep_source=True)
    rows = sorted((r["_day"], r["Dst Port"], r["Flow Byts/s"], r["Extra"], r["Label"], r["_src_ip"]) for r in df.collect())
    assert rows == [("a.csv", 80.0, 0.0, 0.0, "Benign", "1.1.1.1"), ("a.csv", 443.0, 2.5, 0.0, "Bot", "1.1.1.2"), ("b.csv", 0.0, 0.0, 7.0, "Benign", None)]
    assert csv_days.normalize_name(" Flow Byts/s ") == "flow_byts_s"


def test_messages(spark):
    lines = ['{"data": {"src_ip": "a", "protocol": "tcp"}}', '{"source_ip": "b", "attacks": "X"}', "nope", "[1]", '{"attack_types": [], "source_ip": "c"}']
    events = messages.normalize(messages.parse_messages(spark.createDataFrame([(x,) for x in lines], "value string")), now=5)
    assert sorted(r["source_ip"] for r in messages.packets_of(events).collect()) == ["a", "c"]
    alert = messages.alerts_of(events).first()
    assert (alert["attack_types"], alert["confidence"], alert["timestamp"], alert["id"][:3]) == (["X"], 0.75, 5.0, "ws-")


def test_stage_fallback(spark, tmp_path):
    stores.save_stage(spark.range(3), str(tmp_path / "clean"))
    assert stores.load_stage(spark, str(tmp_path / "balanced"), str(tmp_path / "clean")).count() == 3
    with pytest.raises(FileNotFoundError):
        stores.load_stage(spark, str(tmp_path / "none"))


def test_block_expiry(spark):
    df = spark.createDataFrame([("a", 0, 10, False), ("a", 5, 8, False), ("b", 0, 9, False), ("b", 1, 9, True)], "key string, ts_us long, expires_us long, deleted boolean")
    last = respond.latest_per_key(df)
    assert [r["key"] for r in respond.active_at(last, 8).collect()] == ["a"]
    assert respond.active_at(last, 9).count() == 0
    events = spark.createDataFrame([(1, "a", 4), (2, "a", 8), (3, "a", 9), (4, "b", 0), (5, "b", 1), (6, "c", 1)], "event_id long, source_ip string, ts_us long")
    assert sorted(r["event_id"] for r in respond.split_by_block(events, df).collect()) == [1, 2, 4]
    assert sorted(r["event_id"] for r in respond.split_by_block(events, df, blocked=False).collect()) == [3, 5, 6]


def test_one_technique_counts_once_per_alert(spark):
    """Two types of one alert that point at the same technique."""
    from threatflow.operators import analytics, lookup

    a = spark.createDataFrame([(1, ["SQL Injection", "Log4Shell Exploit"])], "alert_id int, attack_types array<string>")
    mapped = lookup.map_techniques(a)
    assert [tuple(r) for r in analytics.technique_hits(mapped).collect()] == [("T1190", 1)]
    assert {r.tactic_id: r.hits for r in analytics.tactic_hits(mapped).collect()}["TA0001"] == 1


def test_packet_features_of_a_flood(spark):
    """Products of sums beyond a bigint."""
    from threatflow.operators import flow_features

    rows = spark.range(3).selectExpr(
        "id AS packet_id", "1000L + id AS ts_us", "'a' AS src_ip", "'b' AS dst_ip", "1 AS src_port", "2 AS dst_port",
        "'tcp' AS protocol", "1500000000 + int(id) AS size", "0 AS payload_len", "20 AS header_len", "'S' AS flags",
    )
    many = rows.withColumn("size", F.col("size").cast("long"))
    got = flow_features.packet_features(many).orderBy("packet_id").collect()
    assert abs(got[-1]["Fwd Pkt Len Std"] - (2 / 3) ** 0.5) < 1e-6


def test_writes_of_one_instant(spark):
    """A deletion wins over a block at the same time, whatever the order of the rows."""
    from threatflow.operators import respond

    for rows in ([("k", 5, 9, False), ("k", 5, None, True)], [("k", 5, None, True), ("k", 5, 9, False)]):
        changes = spark.createDataFrame(rows, "key string, ts_us bigint, expires_us bigint, deleted boolean").coalesce(1)
        assert respond.latest_per_key(changes).count() == 0
        events = spark.createDataFrame([(1, "k", 6)], "event_id int, source_ip string, ts_us bigint")
        assert respond.split_by_block(events, changes, blocked=True).count() == 0


def test_messages_keep_aliases_fractions_and_times(spark):
    from threatflow.sources import messages

    raw = spark.createDataFrame(
        [('{"source_port": 5, "destination_port": "80", "size": 5.5, "timestamp": 12.5}',),
         ('{"dest_port": 7, "timestamp": "2024-01-02T00:00:00Z"}',), ('{"size": 1, "timestamp": "soon"}',), ('{"size": 1}',)],
        "value string",
    )
    got = [(r.src_port, r.dst_port, r["size"], r.timestamp) for r in messages.parse_messages(raw).collect()]
    assert got == [(5, 80, 5, 12.5), (None, 7, None, 1704153600.0), (None, None, 1, None)]


def test_patterns_that_are_not_read_have_no_needed_texts():
    for pattern in ("(?i)\\p{L}+abc", "(?=x)abc", "(a)\\1bcd", "a{2", "x[a&&[b]]yz", "\\x41bc", "abc)"):
        found = rules.needed_texts(pattern)
        assert found in ([], ["abc"]), pattern
    assert rules.needed_texts("(?i)union\\s+(all\\s+)?select") == ["select"] or rules.needed_texts("(?i)union\\s+select") == ["select"]
