"""Queries for field clean-up, derived fields and verdicts."""

from pyspark.sql import functions as F

from threatflow.catalog.registry import query
from threatflow.functions import fields, values as V, verdicts
from threatflow.operators import lookup
from threatflow.plans import views


def listed(items):
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


@query(
    "alias_resolution",
    """SELECT packet_id,
       coalesce(nullif(CASE packet_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE src_ip END, ''), dst_ip) AS src_ip,
       coalesce(nullif(CASE WHEN packet_id % 3 = 0 THEN 0 ELSE dst_port END, 0), src_port) AS dst_port
       FROM packets""",
    over=["packets"],
)
def alias_resolution(spark, sf):
    p = views.packets(spark, sf)
    a = F.when(F.col("packet_id") % 4 == 0, "").when(F.col("packet_id") % 4 != 1, F.col("src_ip"))
    port = F.when(F.col("packet_id") % 3 == 0, 0).otherwise(F.col("dst_port"))
    return p.select(
        "packet_id",
        fields.first_text(a, F.col("dst_ip")).alias("src_ip"),
        fields.first_number(port, F.col("src_port")).alias("dst_port"),
    )


RAW_TEXT = (
    "CASE event_id % 7 WHEN 0 THEN '12.9' WHEN 1 THEN ' 7 ' WHEN 2 THEN 'abc' WHEN 3 THEN '-3.7' "
    "WHEN 4 THEN NULL WHEN 5 THEN '' ELSE CAST(user_id AS {STR}) END"
)


@query(
    "coerce_numbers",
    f"""WITH t AS (SELECT event_id, TRY_CAST(trim({RAW_TEXT.replace('{STR}', 'VARCHAR')}) AS DOUBLE) AS n FROM events)
    SELECT event_id, coalesce(CAST(trunc(n) AS BIGINT), 0) AS as_int, coalesce(n, 0.0) AS as_float FROM t""",
)
def coerce_numbers(spark, sf):
    raw = F.expr(RAW_TEXT.replace("{STR}", "STRING"))
    e = views.table(spark, sf, "events")
    return e.select("event_id", fields.to_int(raw).alias("as_int"), fields.to_float(raw).alias("as_float"))


PROTO_TEXT = (
    "CASE event_id % 6 WHEN 0 THEN 'TCP' WHEN 1 THEN ' udp' WHEN 2 THEN 'icmp' WHEN 3 THEN '47' "
    "WHEN 4 THEN 'gre' ELSE NULL END"
)


@query(
    "protocol_numbers",
    f"""WITH t AS (SELECT event_id, lower(trim({PROTO_TEXT})) AS p FROM events)
    SELECT event_id, CASE WHEN p = 'tcp' THEN 6 WHEN p = 'udp' THEN 17 WHEN p = 'icmp' THEN 1
      WHEN regexp_full_match(p, '[0-9]+') THEN CAST(p AS INT) ELSE 0 END AS number,
      CASE CASE event_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' ELSE 'icmp' END AS name
    FROM t""",
)
def protocol_numbers(spark, sf):
    e = views.table(spark, sf, "events")
    num = F.expr("CASE event_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END")
    return e.select(
        "event_id",
        fields.protocol_number(F.expr(PROTO_TEXT)).alias("number"),
        fields.protocol_name(num).alias("name"),
    )


@query(
    "payload_decode",
    """WITH t AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
    c AS (SELECT doc_id, substr(h, 1, 1024) AS h FROM t),
    d AS (SELECT doc_id, h, TRY(decode(unhex(h))) AS u,
      array_to_string(list_transform(range(1, length(h) // 2 + 1),
        lambda i: chr(CAST((instr('0123456789ABCDEF', substr(h, 2 * i - 1, 1)) - 1) * 16
               + instr('0123456789ABCDEF', substr(h, 2 * i, 1)) - 1 AS INT))), '') AS l FROM c)
    SELECT doc_id, md5(coalesce(u, l)) AS text_md5, md5(lower(h)) AS hex_md5 FROM d""",
)
def payload_decode(spark, sf):
    raw = F.encode(F.col("text"), "UTF-8")
    return views.table(spark, sf, "documents").select(
        "doc_id",
        F.md5(F.encode(fields.payload_text(raw), "UTF-8")).alias("text_md5"),
        F.md5(F.encode(fields.payload_hex(raw), "UTF-8")).alias("hex_md5"),
    )


@query(
    "confidence_scale",
    """WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN value WHEN 1 THEN value / 100
      WHEN 2 THEN -1.0 WHEN 3 THEN 250.0 WHEN 4 THEN 1.0 ELSE NULL END AS c FROM events)
    SELECT event_id, CASE WHEN c IS NULL OR c < 0 THEN 0.0 WHEN c > 100 THEN 1.0 WHEN c > 1 THEN c / 100 ELSE c END AS confidence FROM t""",
)
def confidence_scale(spark, sf):
    c = F.expr("CASE event_id % 6 WHEN 0 THEN value WHEN 1 THEN value / 100 WHEN 2 THEN -1.0D WHEN 3 THEN 250.0D WHEN 4 THEN 1.0D ELSE NULL END")
    return views.table(spark, sf, "events").select("event_id", fields.confidence(c).alias("confidence"))


HTTP_SQL = (
    "concat(CASE page_id % 8 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PATCH' ELSE 'HEAD' END, ' ', url, ' HTTP/1.1', "
    "{CR}, 'Accept: */*', {CR}, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'Host: host' END, page_id, '.example ', {CR}, {CR}, html)"
)


@query(
    "http_fields",
    f"""WITH t AS (SELECT page_id, {HTTP_SQL.replace('{CR}', 'chr(13) || chr(10)')} AS p,
      CASE page_id % 3 WHEN 0 THEN 80 WHEN 1 THEN 8080 ELSE 22 END AS port FROM pages),
    l AS (SELECT page_id, port, string_split(p, chr(13) || chr(10)) AS ls FROM t),
    w AS (SELECT page_id, port, string_split(ls[1], ' ') AS ws, list_filter(ls, lambda x: starts_with(x, 'Host: ')) AS hs FROM l)
    SELECT page_id,
      CASE WHEN port <> 22 AND ws[1] IN ('GET','POST','PUT','DELETE','HEAD','OPTIONS') THEN ws[1] END AS method,
      CASE WHEN port <> 22 THEN trim(string_split(hs[1], ': ')[2]) END AS host,
      CASE WHEN port <> 22 THEN ws[2] END AS path FROM w""",
)
def http_fields(spark, sf):
    payload = F.expr(HTTP_SQL.replace("{CR}", "concat(chr(13), chr(10))"))
    port = F.expr("CASE page_id % 3 WHEN 0 THEN 80 WHEN 1 THEN 8080 ELSE 22 END")
    return views.table(spark, sf, "pages").select(
        "page_id", fields.http_fields(payload, F.lit("tcp"), port).alias("h")
    ).select("page_id", "h.method", "h.host", "h.path")


@query(
    "severity_confidence",
    """WITH t AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'low' WHEN 'click' THEN 'medium' WHEN 'signup' THEN 'high'
      WHEN 'purchase' THEN 'critical' ELSE 'odd' END AS s FROM events)
    SELECT event_id, CASE s WHEN 'critical' THEN 98 WHEN 'high' THEN 92 WHEN 'medium' THEN 80 WHEN 'low' THEN 65 ELSE 70 END AS confidence FROM t""",
)
def severity_confidence(spark, sf):
    s = F.expr("CASE event_type WHEN 'view' THEN 'low' WHEN 'click' THEN 'medium' WHEN 'signup' THEN 'high' WHEN 'purchase' THEN 'critical' ELSE 'odd' END")
    return views.table(spark, sf, "events").select("event_id", fields.severity_confidence(s).alias("confidence"))


@query(
    "noise_filter",
    f"""SELECT alert_id, source_ip, mixed_types[1] AS primary_type FROM alerts
    WHERE NOT (mixed_types[1] IN ({listed(V.NOISE_TYPES)}) AND regexp_matches(source_ip, '^(10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|127\\.|169\\.254\\.)'))""",
    over=["alerts"],
)
def noise_filter(spark, sf):
    a = views.alerts(spark, sf)
    return a.where(~verdicts.is_noise(F.col("mixed_types"), F.col("source_ip"))).select(
        "alert_id", "source_ip", F.col("mixed_types")[0].alias("primary_type")
    )


@query(
    "dedup_keys",
    """SELECT alert_id, concat('alert:', array_to_string(list_sort(mixed_types), ','), ':', source_ip, ':', dest_ip, ':unknown:', location, ':',
      CASE WHEN alert_id % 3 = 0 THEN 'na' ELSE CAST(alert_id % 3 AS VARCHAR) END, ':443:',
      CASE WHEN alert_id % 2 = 0 THEN 'nopayload' ELSE substr(sha1(attack_type), 1, 8) END) AS dedup_key FROM alerts""",
    over=["alerts"],
)
def dedup_keys(spark, sf):
    payload = F.when(F.col("alert_id") % 2 == 0, "").otherwise(F.col("attack_type"))
    return views.alerts(spark, sf).select(
        "alert_id",
        fields.dedup_key(
            F.col("mixed_types"), F.col("source_ip"), F.col("dest_ip"), F.lit(None).cast("string"),
            F.col("location"), F.col("alert_id") % 3, F.lit(443), payload,
        ).alias("dedup_key"),
    )


@query(
    "int64_clamp",
    """SELECT event_id, CAST(greatest(least((event_id - 5000)::HUGEINT * 10000000000000000, 9223372036854775807::HUGEINT),
      -9223372036854775808::HUGEINT) AS BIGINT) AS clamped FROM events""",
)
def int64_clamp(spark, sf):
    wide = (F.col("event_id") - 5000).cast("decimal(20,0)") * F.lit("10000000000000000").cast("decimal(17,0)")
    nested = F.struct(F.create_map(F.lit("list"), F.array(wide)).alias("record"), F.lit("text").alias("note"))
    rows = views.table(spark, sf, "events").select("event_id", nested.alias("data"))
    stored = rows.select("event_id", fields.clamp_nested(F.col("data"), rows.schema["data"].dataType).alias("data"))
    return stored.select("event_id", F.col("data.record")["list"][0].alias("clamped"))


@query(
    "true_positive_votes",
    f"""SELECT alert_id, CASE WHEN list_has_any(mixed_types, [{listed(V.CONFIRMED_TYPES)}]) THEN true
      WHEN list_contains(mixed_types, 'DDoS') AND confidence >= 0.8 THEN true
      WHEN len(list_filter(mixed_types, lambda x: x NOT IN ({listed(V.UNCERTAIN_TYPES)}))) = 0 THEN false ELSE true END AS is_tp FROM alerts""",
    over=["alerts"],
)
def true_positive_votes(spark, sf):
    return views.alerts(spark, sf).select(
        "alert_id", verdicts.is_true_positive(F.col("mixed_types"), F.col("confidence")).alias("is_tp")
    )


@query(
    "server_severity",
    f"""SELECT alert_id, CASE WHEN mixed_types[1] IN ({listed(V.SERVER_CRITICAL)}) THEN 'critical'
      WHEN mixed_types[1] IN ({listed(V.SERVER_HIGH)}) THEN 'high' WHEN mixed_types[1] IN ('Drift', 'Anomaly') THEN 'low' ELSE 'medium' END AS severity FROM alerts""",
    over=["alerts"],
)
def server_severity(spark, sf):
    return views.alerts(spark, sf).select("alert_id", verdicts.server_severity(F.col("mixed_types")[0]).alias("severity"))


@query(
    "board_severity",
    f"""WITH t AS (SELECT alert_id, concat('Repeated ', attack_type) AS a, CAST(floor(CASE WHEN confidence > 1 THEN confidence ELSE confidence * 100 END + 0.5) AS BIGINT) AS pct FROM alerts)
    SELECT alert_id, pct, CASE WHEN len(list_filter([{listed(V.BOARD_CRITICAL)}], lambda x: contains(a, x))) > 0 OR pct >= 95 THEN 'critical'
      WHEN len(list_filter([{listed(V.BOARD_HIGH)}], lambda x: contains(a, x))) > 0 OR pct >= 85 THEN 'high'
      WHEN pct >= 70 THEN 'medium' ELSE 'low' END AS severity FROM t""",
    over=["alerts"],
)
def board_severity(spark, sf):
    a = F.concat(F.lit("Repeated "), F.col("attack_type"))
    return views.alerts(spark, sf).select(
        "alert_id", verdicts.percent(F.col("confidence")).alias("pct"),
        verdicts.board_severity(a, F.col("confidence")).alias("severity"),
    )


@query(
    "snippets",
    """SELECT d.doc_id, md5(substr(d.text, 1, 512)) AS snippet_md5, array_to_string(list_transform(['SQL Injection', 'Port Scanning', d.source], lambda a: string_split(a, ' ')[1]), '+') AS short_names FROM documents d""",
)
def snippets(spark, sf):
    attacks = F.array(F.lit("SQL Injection"), F.lit("Port Scanning"), F.col("source"))
    return views.table(spark, sf, "documents").select(
        "doc_id",
        F.md5(F.encode(fields.snippet(F.col("text")), "UTF-8")).alias("snippet_md5"),
        F.array_join(fields.short_names(attacks), "+").alias("short_names"),
    )


@query(
    "risk_gates",
    """WITH t AS (SELECT alert_id, confidence AS score, alert_id % 4 AS signals, CASE WHEN alert_id % 9 = 0 THEN 'unknown' ELSE source_ip END AS ip,
      CASE alert_id % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'Blocked ' ELSE 'flagged' END AS action FROM alerts),
    g AS (SELECT *, score >= 0.75 AND signals >= 1 AS emits, ip <> 'unknown' AND score >= 0.92 AND signals >= 2 AS blocks FROM t)
    SELECT alert_id, emits, blocks, CASE WHEN lower(trim(action)) IN ('block', 'blocked') AND NOT blocks THEN 'flagged' ELSE action END AS action,
      CASE WHEN lower(trim(action)) IN ('block', 'blocked') AND NOT blocks THEN 'auto_block_skipped_by_gate' END AS note FROM g""",
    over=["alerts"],
)
def risk_gates(spark, sf):
    ip = F.when(F.col("alert_id") % 9 == 0, "unknown").otherwise(F.col("source_ip"))
    action = F.expr("CASE alert_id % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'Blocked ' ELSE 'flagged' END")
    signals = F.col("alert_id") % 4
    blocks = verdicts.may_block(F.col("confidence"), signals, ip, enabled=True)
    return views.alerts(spark, sf).select(
        "alert_id",
        verdicts.may_alert(F.col("confidence"), signals).alias("emits"),
        blocks.alias("blocks"),
        verdicts.gate_mitigation(F.struct(action.alias("action")), blocks).alias("m"),
    ).select("alert_id", "emits", "blocks", "m.action", "m.note")


@query(
    "triage_fallback",
    f"""SELECT alert_id, CASE WHEN list_has_any(mixed_types, [{listed(V.TRIAGE_CONFIRMED_TYPES)}]) THEN 'true_positive' ELSE 'uncertain' END AS verdict,
      CAST(CASE WHEN list_has_any(mixed_types, [{listed(V.TRIAGE_CONFIRMED_TYPES)}]) THEN 0.85
        WHEN len(list_filter(mixed_types, lambda x: x NOT IN ({listed(V.TRIAGE_UNCERTAIN_TYPES)}))) = 0 THEN 0.4 ELSE 0.5 END AS DOUBLE) AS confidence FROM alerts""",
    over=["alerts"],
)
def triage_fallback(spark, sf):
    v = verdicts.fallback_triage(F.col("mixed_types"))
    return views.alerts(spark, sf).select("alert_id", v.alias("v")).select("alert_id", "v.verdict", "v.confidence")


@query(
    "triage_prompts",
    """WITH t AS (SELECT doc_id, text, source, ['SQL Injection', lang] AS types FROM documents)
    SELECT doc_id, md5(concat('Classify this alert.', chr(10), 'Attack type: ', array_to_string(types, ', '), chr(10), 'Source: ', source, chr(10),
      'Destination: unknown', chr(10), 'Protocol: TCP', chr(10), 'Confidence: N/A', chr(10), 'Payload: ', substr(text, 1, 200), chr(10),
      'Detector: unknown', chr(10), 'Description: ', chr(10), 'Answer in JSON with verdict, confidence, reasoning, severity and recommended_action.')) AS prompt_md5,
      substr(sha256(concat_ws('|', array_to_string(types, ','), source, '', substr(text, 1, 100), '')), 1, 16) AS cache_key FROM t""",
)
def triage_prompts(spark, sf):
    types = F.array(F.lit("SQL Injection"), F.col("lang"))
    none = F.lit(None).cast("string")
    prompt = verdicts.triage_prompt(types, F.col("source"), none, none, none, F.col("text"), none, none)
    key = verdicts.triage_key(types, F.col("source"), none, F.col("text"), none)
    return views.table(spark, sf, "documents").select(
        "doc_id", F.md5(F.encode(prompt, "UTF-8")).alias("prompt_md5"), key.alias("cache_key")
    )


ANSWER = (
    "CASE doc_id % 4 WHEN 0 THEN concat('Sure:', {NL}, '```json', {NL}, {OBJ}, {NL}, '```', {NL}, 'done') "
    "WHEN 1 THEN {OBJ} WHEN 2 THEN concat('I think ', {OBJ}, ' fits') ELSE concat('no idea about ', lang) END"
)
ANSWER_OBJ = "concat('{\"verdict\": \"', CASE WHEN n_chars % 2 = 0 THEN 'true_positive' ELSE 'uncertain' END, '\", \"confidence\": 0.', n_chars % 9, '}')"


def _answer(nl):
    return ANSWER.replace("{NL}", nl).replace("{OBJ}", ANSWER_OBJ)


@query(
    "triage_answers",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL WHEN n_chars % 2 = 0 THEN 'true_positive' ELSE 'uncertain' END AS verdict,
      CASE WHEN doc_id % 4 = 3 THEN NULL ELSE CAST(concat('0.', n_chars % 9) AS DOUBLE) END AS confidence FROM documents""",
)
def triage_answers(spark, sf):
    found = verdicts.answer_json(F.expr(_answer("chr(10)")))
    return views.table(spark, sf, "documents").select(
        "doc_id",
        F.get_json_object(found, "$.verdict").alias("verdict"),
        F.get_json_object(found, "$.confidence").cast("double").alias("confidence"),
    )


@query(
    "flag_counts",
    """SELECT packet_id, length(f) - length(replace(upper(f), 'P', '')) AS p_all, length(f) - length(replace(upper(f), 'A', '')) AS a_all, contains(f, 'P') AS has_p
    FROM (SELECT packet_id, CASE WHEN packet_id % 2 = 0 THEN lower(concat(flags, flags)) ELSE concat(flags, flags) END AS f FROM packets)""",
    over=["packets"],
)
def flag_counts(spark, sf):
    twice = F.concat("flags", "flags")
    f = F.when(F.col("packet_id") % 2 == 0, F.lower(twice)).otherwise(twice)
    return views.packets(spark, sf).select(
        "packet_id",
        fields.flag_count(f, "P").cast("long").alias("p_all"),
        fields.flag_count(f, "A").cast("long").alias("a_all"),
        f.contains("P").alias("has_p"),
    )


@query(
    "feature_differences",
    """SELECT doc_id, array_to_string(list_sort(list_filter(['en', 'de', 'web', 'fr'], lambda x: x NOT IN (lang, source))), ',') AS missing,
      array_to_string(list_sort(list_filter(list_distinct([lang, source]), lambda x: x NOT IN ('en', 'de', 'web', 'fr'))), ',') AS extra FROM documents""",
)
def feature_differences(spark, sf):
    expected = F.array(*[F.lit(x) for x in ("en", "de", "web", "fr")])
    d = fields.missing_and_extra(F.array("lang", "source"), expected)
    return views.table(spark, sf, "documents").select(
        "doc_id", F.array_join(d["missing"], ",").alias("missing"), F.array_join(d["extra"], ",").alias("extra")
    )


def _fuzzy_sql(names, attack):
    lowered = [n.lower() for n in names]
    return (
        f"CASE WHEN {attack} IN ({listed(names)}) THEN {attack} ELSE "
        f"list_extract([{listed(names)}], list_position(list_transform([{listed(lowered)}], "
        f"lambda k: contains(lower({attack}), k) OR contains(k, lower({attack}))), true)) END"
    )


def _rows_sql(rows):
    return ", ".join("(" + ", ".join(f"'{c}'" if isinstance(c, str) else str(c) for c in r) + ")" for r in rows)


NAMES = (
    "CASE {ID} % 6 WHEN 0 THEN {T} WHEN 1 THEN 'brute' WHEN 2 THEN 'Massive DDoS Flood wave' WHEN 3 THEN 'injection' "
    "WHEN 4 THEN 'Nothing Known' ELSE 'Drift' END"
)


@query(
    "technique_map",
    f"""WITH t AS (SELECT alert_id, {NAMES.replace('{ID}', 'alert_id').replace('{T}', 'attack_type')} AS a FROM alerts),
    m AS (SELECT alert_id, a, {_fuzzy_sql(V.TECHNIQUES, 'a')} AS name FROM t),
    d(name, technique_id, tactic) AS (VALUES {_rows_sql([(n, v[0], v[3]) for n, v in V.TECHNIQUES.items()])})
    SELECT alert_id, coalesce(technique_id, '') AS techniques, coalesce(tactic, '') AS tactics FROM m LEFT JOIN d USING (name)""",
    over=["alerts"],
)
def technique_map(spark, sf):
    name = F.expr(NAMES.replace("{ID}", "alert_id").replace("{T}", "attack_type"))
    a = views.alerts(spark, sf).select("alert_id", F.array(name).alias("attack_types"))
    return lookup.map_techniques(a).select(
        "alert_id", F.array_join("mitre_techniques", ",").alias("techniques"), F.array_join("mitre_tactics", ",").alias("tactics")
    )


PB_ROWS = [
    (n, pb[0], pb[1], *[",".join(action for action, automated in pb[2] if automated == kind) for kind in (True, False)])
    for n, pb in {**V.PLAYBOOKS, "": V.DEFAULT_PLAYBOOK}.items()
]


@query(
    "playbook_lookup",
    f"""WITH t AS (SELECT alert_id, {NAMES.replace('{ID}', 'alert_id').replace('{T}', 'attack_type')} AS a FROM alerts),
    m AS (SELECT alert_id, coalesce({_fuzzy_sql(V.PLAYBOOKS, 'a')}, '') AS name FROM t),
    d(name, severity, mitre_id, automated, manual) AS (VALUES {_rows_sql(PB_ROWS)})
    SELECT alert_id, severity, mitre_id, automated, manual FROM m JOIN d USING (name)""",
    over=["alerts"],
)
def playbook_lookup(spark, sf):
    name = F.expr(NAMES.replace("{ID}", "alert_id").replace("{T}", "attack_type"))
    a = views.alerts(spark, sf).select("alert_id", lookup.playbook_of(name).alias("p"))

    def actions(auto):
        return F.array_join(
            F.transform(F.filter("p.steps", lambda s: s["automated"] == F.lit(auto)), lambda s: s["action"]), ","
        )

    return a.select("alert_id", "p.severity", "p.mitre_id", actions(True).alias("automated"), actions(False).alias("manual"))


STAGE_ROWS = [(t, i, s) for i, (s, (types, _)) in enumerate(V.STAGES.items(), 1) for t in types]
TAG_ROWS = [(t, i, s) for i, (s, (_, tags)) in enumerate(V.STAGES.items(), 1) for t in tags]


@query(
    "kill_chain_stage",
    f"""WITH t AS (SELECT alert_id, mixed_types, CASE WHEN alert_id % 2 = 0 THEN ['c2', 'web'] ELSE [] END AS tags FROM alerts),
    d(name, ord, stage) AS (VALUES {_rows_sql(STAGE_ROWS)}), g(name, ord, stage) AS (VALUES {_rows_sql(TAG_ROWS)}),
    x AS (SELECT alert_id, unnest(mixed_types) AS name FROM t), y AS (SELECT alert_id, unnest(tags) AS name FROM t),
    h AS (SELECT alert_id, ord, stage FROM x JOIN d USING (name) UNION ALL SELECT alert_id, ord, stage FROM y JOIN g USING (name))
    SELECT t.alert_id, min_by(stage, ord) AS stage FROM t LEFT JOIN h USING (alert_id) GROUP BY 1""",
    over=["alerts"],
)
def kill_chain_stage(spark, sf):
    tags = F.when(F.col("alert_id") % 2 == 0, F.array(F.lit("c2"), F.lit("web"))).otherwise(F.array().cast("array<string>"))
    return views.alerts(spark, sf).select("alert_id", lookup.stage_of(F.col("mixed_types"), tags).alias("stage"))


@query(
    "sensor_routing",
    "SELECT packet_id, CASE WHEN location IN ('internal', 'dmz') THEN location ELSE 'internal' END AS sensor FROM packets",
    over=["packets"],
)
def sensor_routing(spark, sf):
    return views.packets(spark, sf).select("packet_id", lookup.route_sensor(F.col("location"), ["internal", "dmz"]).alias("sensor"))
