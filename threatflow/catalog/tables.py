"""Queries for file sources and sinks; the files are written from the tables first."""

import math

from pyspark.sql import functions as F

from threatflow.catalog.registry import query, rounded
from threatflow.plans import views
from threatflow.plans.session import shared_dir
from threatflow.sources import csv_days, messages, rules, stores

RAW = {
    "Dst Port": "CASE WHEN flow_id % 500 = 1 THEN 'Dst Port' ELSE CAST(quantity AS STRING) END",
    "Flow Byts/s": "CASE flow_id % 9 WHEN 0 THEN 'Infinity' WHEN 1 THEN 'NaN' WHEN 2 THEN '' WHEN 3 THEN 'bad' ELSE CAST(price AS STRING) END",
    "Src IP": "concat('10.0.0.', src)",
    "Timestamp": "day",
    "Label": "label",
}
HALVES = {"early": ("day < '1999'", []), "late": ("day >= '1999'", ["Fwd Pkts/s"])}
#: Files that each half is written to.
FILES = {"early": 3, "late": 2}


#: Rows that a file of flows to be read back holds at most, about.
FILE_ROWS = 1_000_000


def write_days(spark, sf, file_rows=None):
    """All flows as CSV in two folders, the later one with a column more.

    With ``file_rows`` each of the files becomes as many as keep a file at about that many rows.
    """
    base = shared_dir(spark, "csv")
    f = views.flows(spark, sf)
    files = FILES
    if file_rows:
        sizes = f.agg(*[F.count_if(F.expr(days)).alias(half) for half, (days, _) in HALVES.items()]).first()
        files = {half: n * max(1, math.ceil(sizes[half] / n / file_rows)) for half, n in FILES.items()}
    for half, (days, extra) in HALVES.items():
        cols = [F.expr(e).alias(c) for c, e in RAW.items()] + [F.col("tax").alias(c) for c in extra]
        f.where(days).repartition(files[half]).select(*cols).write.option("header", True).csv(f"{base}/{half}")
    return base


DAY_SQL = """SELECT day, flow_id, quantity AS port, CASE WHEN flow_id % 9 <= 3 THEN 0.0 ELSE price END AS rate, label, src
  FROM flows WHERE NOT flow_id % 500 = 1 /* written as repeated header rows */"""


def loaded(spark, sf, **options):
    base = write_days(spark, sf, FILE_ROWS)
    files = csv_days.list_files(spark, base, recursive=True).select("path").collect()
    return csv_days.clean_days(csv_days.read_day_files(spark, [r["path"] for r in files]), **options)


@query(
    "csv_day_scan",
    f"WITH t AS ({DAY_SQL}) SELECT label, count(*) AS n, round(avg(port), 6) AS ports, round(avg(rate), 6) AS rates, count(DISTINCT src) AS sources FROM t GROUP BY 1",
    over=["flows"],
)
def csv_day_scan(spark, sf):
    days = loaded(spark, sf, keep_source=True)
    return rounded(days.groupBy(F.col("Label").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("`Dst Port`").alias("ports"), F.avg("`Flow Byts/s`").alias("rates"),
        F.count_distinct("_src_ip").alias("sources"),
    ))


@query(
    "csv_drop_bad_rows",
    f"WITH t AS ({DAY_SQL} AND flow_id % 9 > 3 AND day >= '1999') SELECT label, count(*) AS n, round(avg(rate), 6) AS rates FROM t GROUP BY 1",
    over=["flows"],
)
def csv_drop_bad_rows(spark, sf):
    # only the later files have all columns, so only their rows can be complete
    days = loaded(spark, sf, drop_bad=True)
    return rounded(days.groupBy(F.col("Label").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.avg("`Flow Byts/s`").alias("rates")))


@query(
    "csv_file_listing",
    "SELECT CASE WHEN day < '1999' THEN 'early' ELSE 'late' END AS half, CASE WHEN day < '1999' THEN 3 ELSE 2 END AS files, count(*) AS n_rows, true AS named, true AS sized FROM flows GROUP BY ALL",
    over=["flows"],
)
def csv_file_listing(spark, sf):
    """The files found below a folder: how many in each half, whether all have names and sizes, and the rows they hold."""
    base = write_days(spark, sf)
    files = csv_days.list_files(spark, base, recursive=True).withColumn("half", F.element_at(F.split("path", "/"), -2))
    raw = csv_days.read_day_files(spark, [r["path"] for r in files.select("path").collect()])
    held = raw.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    return files.join(held, files["day"] == held["_day"]).groupBy("half").agg(
        F.count(F.lit(1)).cast("int").alias("files"), F.sum("_n").alias("n_rows"),
        F.bool_and(F.col("day").endswith(".csv")).alias("named"), F.bool_and(F.col("length") > 0).alias("sized"),
    )


@query(
    "csv_named_days",
    f"WITH t AS ({DAY_SQL} AND day < '1999') SELECT label, count(*) AS n, round(avg(port), 6) AS ports, round(avg(rate), 6) AS rates, true AS skipped FROM t GROUP BY 1",
    over=["flows"],
)
def csv_named_days(spark, sf):
    """The days of a list of file names; the one that is missing is skipped with a warning."""
    import warnings

    base = write_days(spark, sf)
    names = [r["day"] for r in csv_days.list_files(spark, f"{base}/early").select("day").collect()]
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        days = csv_days.load_days(spark, base, [*names, "no-such-day.csv"], recursive=True)
    skipped = any("no-such-day.csv" in str(w.message) for w in told)
    return rounded(days.groupBy(F.col("Label").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("`Dst Port`").alias("ports"), F.avg("`Flow Byts/s`").alias("rates"),
    ).withColumn("skipped", F.lit(skipped)))


#: Rules as a file holds them; the last pattern of the first is none and is left out.
RULE_FILE = r"""
- id: doing
  name: Doing
  description: A word that ends in -ing after an article.
  severity: HIGH
  payload_patterns: ["(?i)the [a-z]+ing", "(unclosed"]
- id: scripted
  name: Scripted
  severity: low
  tags: [web]
  dst_ports: [80, 443]
  payload_patterns: ["(?i)<script"]
"""


@query(
    "yaml_rules",
    """WITH r AS (SELECT 'doing' AS id, 'high' AS severity, 'A word that ends in -ing after an article.' AS description, packet_id FROM payloads WHERE regexp_matches(payload, '(?i)the [a-z]+ing')
      UNION ALL SELECT 'scripted', 'low', '', packet_id FROM payloads WHERE regexp_matches(payload, '(?i)<script') AND (dst_port IS NULL OR dst_port IN (80, 443)))
    SELECT id, severity, description, count(*) AS n, true AS built_in FROM r GROUP BY ALL""",
    over=["payloads"],
)
def yaml_rules(spark, sf):
    """Matches of rules read from a YAML file; where there is no file, the built-in rules hold."""
    from threatflow.operators import signatures

    base = shared_dir(spark, "rules")
    spark.createDataFrame([(RULE_FILE,)], "value string").coalesce(1).write.text(base)
    loaded_rules = rules.check_patterns(spark, rules.load_rules(base, spark))
    missing = [r.id for r in rules.load_rules(f"{base}-none", spark)]
    about = rules.rules_table(spark, loaded_rules).select("id", "description")
    found = signatures.matches(views.payloads(spark, sf), loaded_rules).groupBy("id", "severity").agg(F.count(F.lit(1)).alias("n"))
    return found.join(F.broadcast(about), "id").withColumn("built_in", F.lit(missing == [r.id for r in rules.built_in_rules()]))


@query(
    "column_names",
    'SELECT flow_id, quantity AS dst_port, price AS flow_byts_s, discount AS down_up_ratio, tax AS "fwd_pkts_s_1" FROM flows',
    over=["flows"],
)
def column_names(spark, sf):
    f = views.flows(spark, sf).select(
        "flow_id", F.col("quantity").alias(" Dst Port"), F.col("price").alias("Flow Byts/s"), F.col("discount").alias("Down/Up--Ratio"), F.col("tax").alias("(Fwd Pkts/s)#1"),
    )
    return csv_days.normalize_columns(f)


@query(
    "stage_checkpoints",
    "SELECT day, label, count(*) AS n FROM flows GROUP BY 1, 2",
    over=["flows"],
)
def stage_checkpoints(spark, sf):
    base = shared_dir(spark, "stages")
    stores.save_stage(views.flows(spark, sf).select("flow_id", "day", "label"), f"{base}/clean")
    # no balanced stage was written, so the clean one is taken
    return stores.load_stage(spark, f"{base}/balanced", f"{base}/clean").groupBy("day", "label").agg(F.count(F.lit(1)).alias("n"))


MESSAGE = """CASE event_id % 6
 WHEN 0 THEN concat('{"data": {"source_ip": "s', user_id, '", "dst_ip": "d", "protocol": "tcp", "timestamp": ', event_id, '}}')
 WHEN 1 THEN concat('{"src_ip": "s', user_id, '", "dest_ip": "d", "attack_types": ["SQL Injection", "X"], "timestamp": ', event_id, '}')
 WHEN 2 THEN concat('{"src_ip": "s', user_id, '", "attacks": "Port Scanning", "confidence": 0.5, "timestamp": ', event_id, '}')
 WHEN 3 THEN concat('{"src_ip": "s', user_id, '", "attack_types": [], "protocol": "17", "timestamp": ', event_id, '}')
 WHEN 4 THEN 'not json' ELSE concat('[', event_id, ']') END"""


@query(
    "json_ingest",
    """SELECT CAST(event_id AS DOUBLE) AS timestamp, CASE WHEN event_id % 6 IN (1, 2) THEN 'alert' ELSE 'packet' END AS kind, concat('s', user_id) AS source_ip,
      CASE WHEN event_id % 6 < 2 THEN 'd' END AS dest_ip, CASE event_id % 6 WHEN 0 THEN 'TCP' END AS protocol_name,
      CASE event_id % 6 WHEN 1 THEN 'SQL Injection,X' WHEN 2 THEN 'Port Scanning' ELSE '' END AS attacks,
      CASE event_id % 6 WHEN 1 THEN 0.75 WHEN 2 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence FROM events WHERE event_id % 6 < 4""",
)
def json_ingest(spark, sf):
    raw = views.table(spark, sf, "events").select(F.expr(MESSAGE).alias("value"))
    events = messages.normalize(messages.parse_messages(raw))
    cols = ["timestamp", "source_ip", "dest_ip", "protocol_name"]
    packets = messages.packets_of(events).select(*cols, F.lit("packet").alias("kind"), F.lit("").alias("attacks"), F.lit(0.0).alias("confidence"))
    alerts = messages.alerts_of(events).select(*cols, F.lit("alert").alias("kind"), F.array_join("attack_types", ",").alias("attacks"), "confidence")
    return packets.unionByName(alerts)


@query("alert_store", "SELECT CAST(CAST(make_timestamp(ts_us) AS DATE) AS VARCHAR) AS day, count(*) AS n, CAST(sum(alert_id) AS BIGINT) AS ids FROM alerts GROUP BY 1", over=["alerts"])
def alert_store(spark, sf):
    path = shared_dir(spark, "alerts")
    a = views.alerts(spark, sf).select("alert_id", "ts_us", "source_ip", "attack_types")
    stores.append_alerts(a.where("size(attack_types) > 0 AND source_ip LIKE '10.%'"), path)
    stores.append_alerts(a.where("size(attack_types) > 0 AND source_ip NOT LIKE '10.%'"), path)
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("alert_id").alias("ids"))


@query("audit_log", "SELECT event_type, actor, count(*) AS n, max(strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%fZ')) AS last FROM (SELECT ts_us, event_type, location AS actor FROM alerts) GROUP BY 1, 2", over=["alerts"])
def audit_log(spark, sf):
    path = shared_dir(spark, "audit")
    a = views.alerts(spark, sf)
    stores.append_audit(
        a.select("ts_us", "event_type", F.col("location").alias("actor"), F.col("source_ip").alias("ip"),
                 F.create_map(F.lit("type"), "attack_type").alias("details")),
        path,
    )
    back = spark.read.schema("timestamp STRING, event_type STRING, actor STRING, ip STRING, details MAP<STRING, STRING>").json(path)
    return back.groupBy("event_type", "actor").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last"))


@query("metric_reports", "SELECT 'scored' AS dataset, grp, count(*) AS n FROM scored GROUP BY 2", over=["scored"])
def metric_reports(spark, sf):
    path = shared_dir(spark, "metrics")
    m = views.scored(spark, sf).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    stores.append_metrics(m, path, dataset="scored")
    return spark.read.schema("dataset STRING, grp STRING, n BIGINT").json(path)


@query(
    "runtime_rules",
    "SELECT packet_id FROM payloads WHERE regexp_matches(payload, '(?i)zzq|the[ ]+[a-z]+ing') OR regexp_matches(payload, '(?i)javascript:')",
    over=["payloads"],
)
def runtime_rules(spark, sf):
    from threatflow.operators import signatures

    mine = rules.rule_from({"id": "mine", "name": "Mine", "payload_patterns": ["(?i)zzq|the[ ]+[a-z]+ing", "(unclosed"]})
    table = rules.add_rule(rules.built_in_rules(), mine)
    for r in table:
        if r.id not in ("mine", "xss-basic"):
            table = rules.remove_rule(table, r.id)
    table = [r for r in table if r.id == "mine"] + [rules.Rule("js", "Script", patterns=("(?i)javascript:",))]
    checked = rules.check_patterns(spark, table)
    return signatures.matches(views.payloads(spark, sf), checked).select("packet_id").distinct()


@query("event_set_operations", "SELECT source_ip, 'both' AS part FROM (SELECT source_ip FROM alerts WHERE event_type = 'error' INTERSECT SELECT source_ip FROM alerts WHERE event_type = 'purchase') UNION ALL SELECT source_ip, 'only' FROM (SELECT source_ip FROM alerts WHERE event_type = 'error' EXCEPT SELECT source_ip FROM alerts WHERE value > 60)", over=["alerts"])
def event_set_operations(spark, sf):
    a = views.alerts(spark, sf)

    def ips(cond):
        return a.where(cond).select("source_ip")

    both = ips("event_type = 'error'").intersect(ips("event_type = 'purchase'")).withColumn("part", F.lit("both"))
    only = ips("event_type = 'error'").subtract(ips("value > 60"))
    return both.unionByName(only.withColumn("part", F.lit("only")))
