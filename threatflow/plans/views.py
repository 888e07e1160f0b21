"""Security views over the test tables, as expressions both Spark and DuckDB read.

``events`` becomes packets and alerts, ``lineitem`` labelled flows, ``labels`` with
``documents`` scored predictions, the text tables payloads.  The same column
expressions feed the DataFrames and the checking SQL, so both sides see one input.
"""

from pyspark.sql import DataFrame, SparkSession

US = {"spark": "unix_micros(CAST(ts AS TIMESTAMP))", "duck": "epoch_us(ts)"}
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
_SRC = (
    "CASE WHEN user_id % 5 = 0 THEN concat('203.0.113.', CAST(user_id % 250 AS {STR})) "
    "ELSE concat('10.0.', CAST(user_id % 4 AS {STR}), '.', CAST(user_id % 250 AS {STR})) END"
)
_DST = "concat('10.1.0.', CAST(" + _K + " % 8 AS {STR}))"
_DPORT = (
    f"CASE {_K} % 6 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 WHEN 3 THEN 53 "
    "WHEN 4 THEN 21 ELSE NULL END"
)
_TYPE = (
    "CASE event_type WHEN 'view' THEN 'Port Scanning' WHEN 'click' THEN 'SQL Injection' "
    "WHEN 'signup' THEN 'SSH Brute Force' WHEN 'purchase' THEN 'Data Exfiltration' "
    "ELSE (CASE WHEN user_id % 3 = 0 THEN 'Anomaly' ELSE 'Lateral Movement' END) END"
)
_FLAGS = (
    "CASE event_type WHEN 'view' THEN 'S' WHEN 'click' THEN 'PA' WHEN 'signup' THEN 'A' "
    "WHEN 'purchase' THEN 'FA' ELSE 'R' END"
)
_PAYLOAD_LEN = "CAST(CASE WHEN event_type = 'view' THEN 0 ELSE floor(value) END AS INT)"
_FLIP = "event_id % 3 = 0"

PACKETS = {
    "packet_id": "event_id",
    "ts_us": "{US}",
    "src_ip": _SRC,
    "dst_ip": _DST,
    "src_port": "CAST(40000 + user_id % 1000 AS INT)",
    "dst_port": _DPORT,
    "protocol": f"CASE {_K} % 6 WHEN 3 THEN 'udp' WHEN 5 THEN NULL ELSE 'tcp' END",
    "size": "CAST(40 + floor(value) AS INT)",
    "payload_len": _PAYLOAD_LEN,
    "header_len": "CAST(20 AS INT)",
    "flags": _FLAGS,
    "location": "CASE user_id % 2 WHEN 0 THEN 'edge' ELSE 'internal' END",
    "event_type": "event_type",
    "value": "value",
}
# Packets of two-way flows: every third one goes back.  The clock runs 20,000 times
# faster so that flows hold many packets, pauses and timeouts.
FLOW_PACKETS = {
    "packet_id": "event_id",
    "ts_us": "CAST(floor({US} / 20000) AS BIGINT)",
    "src_ip": f"CASE WHEN {_FLIP} THEN '10.1.0.9' ELSE {_SRC} END",
    "dst_ip": f"CASE WHEN {_FLIP} THEN {_SRC} ELSE '10.1.0.9' END",
    "src_port": f"CASE WHEN {_FLIP} THEN 443 ELSE CAST(40000 + user_id % 1000 AS INT) END",
    "dst_port": f"CASE WHEN {_FLIP} THEN CAST(40000 + user_id % 1000 AS INT) ELSE 443 END",
    "protocol": "'tcp'",
    "size": "CAST(40 + floor(value) AS INT)",
    "payload_len": _PAYLOAD_LEN,
    "header_len": "CAST(20 AS INT)",
    "flags": _FLAGS,
    "tcp_window": "CASE WHEN event_type = 'error' THEN NULL ELSE CAST(1000 + event_id % 64000 AS INT) END",
}
_MIXED = (
    f"CASE event_id % 5 WHEN 0 THEN {{ARR}}({_TYPE}, 'Anomaly') WHEN 1 THEN {{ARR}}('Anomaly', 'Drift') "
    f"WHEN 2 THEN {{ARR}}('DDoS') ELSE {{ARR}}({_TYPE}) END"
)
ALERTS = {
    "alert_id": "event_id",
    "ts_us": "{US}",
    "source_ip": _SRC,
    "dest_ip": _DST,
    "attack_type": _TYPE,
    "attack_types": f"{{ARR}}({_TYPE})",
    "mixed_types": _MIXED,
    "confidence": "CASE WHEN value > 100 THEN 1.0 ELSE value / 100.0 END",
    "location": "CASE user_id % 2 WHEN 0 THEN 'edge' ELSE 'internal' END",
    "value": "value",
    "event_type": "event_type",
    "user_id": "user_id",
}
FLOWS = {
    "flow_id": "l_orderkey * 10 + l_linenumber",
    "quantity": "l_quantity",
    "price": "l_extendedprice",
    "discount": "l_discount",
    "tax": "l_tax",
    "label": "CASE l_returnflag WHEN 'N' THEN 'Benign' WHEN 'R' THEN 'DoS-Hulk' ELSE 'Botnet' END",
    "day": "CAST(CAST(l_shipdate AS DATE) AS {STR})",
    "src": "l_suppkey",
}
SCORED = {
    "doc_id": "l.doc_id",
    "y": "l.quality",
    "p": "(d.n_chars % 1000) / 1000.0E0",
    "grp": "d.lang",
}


def _fill(expr, dialect):
    return expr.replace("{US}", US[dialect]).replace(
        "{STR}", "STRING" if dialect == "spark" else "VARCHAR"
    ).replace("{ARR}", "array" if dialect == "spark" else "list_value")


def table(spark: SparkSession, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(df, columns):
    return df.selectExpr(*[f"{_fill(e, 'spark')} AS {c}" for c, e in columns.items()])


def as_packets(events):
    return _view(events, PACKETS)


def as_alerts(events):
    return _view(events, ALERTS)


def as_flow_packets(events):
    return _view(events, FLOW_PACKETS)


def as_flows(lineitem):
    return _view(lineitem, FLOWS)


def packets(spark, sf_dir):
    return _view(table(spark, sf_dir, "events"), PACKETS)


def flow_packets(spark, sf_dir):
    return _view(table(spark, sf_dir, "events"), FLOW_PACKETS)


def alerts(spark, sf_dir):
    return _view(table(spark, sf_dir, "events"), ALERTS)


def flows(spark, sf_dir):
    return _view(table(spark, sf_dir, "lineitem"), FLOWS)


def scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").alias("d")
    joined = table(spark, sf_dir, "labels").alias("l").join(docs, "doc_id")
    return _view(joined, SCORED)


PAYLOADS = {
    "packet_id": "packet_id",
    "payload": "payload",
    "protocol": "CASE n % 7 WHEN 0 THEN NULL WHEN 1 THEN 'UDP' ELSE 'tcp' END",
    "src_port": "CAST(40000 + n % 1000 AS INT)",
    "dst_port": "CASE n % 5 WHEN 0 THEN NULL WHEN 1 THEN 22 WHEN 2 THEN 25 WHEN 3 THEN 443 ELSE 80 END",
    "service": "CASE n % 11 WHEN 0 THEN 'FTP' WHEN 1 THEN NULL ELSE 'http' END",
}
_TEXTS = {
    "pages": ["concat('page-', page_id) AS packet_id", "html AS payload", "page_id AS n"],
    "documents": ["concat('doc-', doc_id) AS packet_id", "text AS payload", "doc_id AS n"],
    "conversations": ["concat('talk-', conv_id, '-', turn) AS packet_id", "text AS payload", "conv_id + turn AS n"],
}


def payloads(spark, sf_dir):
    """Whole page, document and conversation texts as packet payloads."""
    parts = [
        table(spark, sf_dir, name).selectExpr(*exprs) for name, exprs in _TEXTS.items()
    ]
    return _view(parts[0].unionByName(parts[1]).unionByName(parts[2]), PAYLOADS)


def _select(columns, source):
    return "SELECT " + ", ".join(f"{_fill(e, 'duck')} AS {c}" for c, e in columns.items()) + f" FROM {source}"


SQL = {
    "packets": _select(PACKETS, "events"),
    "flow_packets": _select(FLOW_PACKETS, "events"),
    "alerts": _select(ALERTS, "events"),
    "flows": _select(FLOWS, "lineitem"),
    "scored": _select(SCORED, "labels l JOIN documents d USING (doc_id)"),
    "payloads": _select(
        PAYLOADS, "(" + " UNION ALL ".join(f"SELECT {', '.join(e)} FROM {t}" for t, e in _TEXTS.items()) + ")"
    ),
}


def with_views(sql, *names):
    """Put the views in front of a query as common table expressions."""
    heads = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads}, {body[len('WITH RECURSIVE'):].strip()}"
    if body.upper().startswith("WITH"):
        return f"WITH {heads}, {body[4:].strip()}"
    return f"WITH {heads} {body}"
