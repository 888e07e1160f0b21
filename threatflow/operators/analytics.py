"""Roll-ups of the alert table: distributions, hours, tactics, hosts, newest rows."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from threatflow.functions.verdicts import server_severity
from threatflow.operators.lookup import tactics_table

SECOND = 1_000_000
SEVERITIES = ["critical", "high", "medium", "low"]


def hour_text(ts_us="ts_us"):
    return F.date_format(F.timestamp_micros(F.col(ts_us)), "yyyy-MM-dd HH:00")


def with_primary(alerts: DataFrame, attacks="attack_types"):
    primary = F.coalesce(F.get(F.col(attacks), F.lit(0)), F.lit("unknown"))
    return alerts.withColumn("primary", primary).withColumn("severity", server_severity(F.col("primary")))


def type_distribution(alerts: DataFrame):
    return with_primary(alerts).groupBy("primary").agg(F.count(F.lit(1)).alias("alerts"))


def hourly(alerts: DataFrame, newest=48):
    """The newest hours that have alerts."""
    hours = alerts.groupBy(hour_text().alias("hour")).agg(F.count(F.lit(1)).alias("alerts"))
    return hours.orderBy(F.desc("hour")).limit(newest)


def severity_distribution(alerts: DataFrame):
    """All four severities, zero where there is no alert."""
    counts = with_primary(alerts).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    )
    return counts.unpivot([], SEVERITIES, "severity", "alerts")


def technique_hits(alerts: DataFrame):
    """Alerts per technique; an alert counts once for each distinct technique."""
    return alerts.select(F.explode("mitre_techniques").alias("technique_id")).groupBy("technique_id").agg(
        F.count(F.lit(1)).alias("hits")
    )


def tactic_hits(alerts: DataFrame):
    """All tactics with the hits of their techniques, zero included.

    A technique counts once per alert, however many of the alert's types point at it.
    """
    named = F.transform("mitre_attack", lambda t: F.struct(t["tactic_id"].alias("tactic_id"), t["technique_id"].alias("technique_id")))
    per = alerts.select(F.explode(F.array_distinct(named)).alias("t")).select("t.tactic_id")
    hits = per.groupBy("tactic_id").agg(F.count(F.lit(1)).alias("n"))
    table = tactics_table(alerts.sparkSession)
    return table.join(hits, "tactic_id", "left").select(
        "ord", "tactic_id", "tactic", F.coalesce("n", F.lit(0).cast("long")).alias("hits")
    )


def all_analytics(alerts: DataFrame):
    """Types, hours, severities, sources and the total from one pass over the alerts."""
    rows = with_primary(alerts).select("primary", hour_text().alias("hour"), "severity", "source_ip")
    by = ["primary", "hour", "severity", "source_ip"]
    out = rows.groupingSets([[F.col(b)] for b in by] + [[]], *by).agg(
        F.count(F.lit(1)).alias("alerts"), F.grouping_id(*by).alias("_g")
    )
    kind = (
        F.when(F.col("_g") == 0b0111, "type").when(F.col("_g") == 0b1011, "hour")
        .when(F.col("_g") == 0b1101, "severity").when(F.col("_g") == 0b1110, "source").otherwise("total")
    )
    return out.select(kind.alias("kind"), F.coalesce(*by).alias("name"), "alerts")


def active_hosts(alerts: DataFrame):
    """Number of distinct addresses seen as source or target."""
    hosts = alerts.select(F.explode(F.array("source_ip", "dest_ip")).alias("host")).where("host <> ''")
    return hosts.groupBy("host").agg(F.lit(1).alias("_1")).agg(F.count(F.lit(1)).alias("hosts"))


def top_shares(rows: DataFrame, key, n=20, shown=10):
    """The n busiest keys, and the share of the shown ones in the total of the n."""
    counts = rows.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.count(F.lit(1)).alias("hits"))
    top = counts.orderBy(F.desc("hits"), key).limit(n)
    # at most n rows from here on
    total = F.sum("hits").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("hits"), key))
    return top.withColumn("pct", F.round(F.col("hits") / total * 100, 1)).withColumn("place", place).where(
        F.col("place") <= shown
    )


def newest(rows: DataFrame, n, order=("ts_us", "alert_id")):
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)


def page(rows: DataFrame, limit, offset, order=("ts_us", "alert_id")):
    """One page of rows, newest first."""
    return rows.orderBy(*[F.desc(order[0]), *order[1:]]).offset(offset).limit(limit)


def counters(rows: DataFrame, *labels):
    """Counter table: rows per label combination."""
    return rows.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def pipeline_totals(drift: DataFrame, offered: DataFrame, kept: DataFrame, fused: DataFrame):
    """How many drift alerts came up, repeats were dropped, and alerts were fused: one row from four tables."""
    def total(df):
        return df.agg(F.count(F.lit(1)).alias("n")).scalar()

    one = offered.agg(F.count(F.lit(1)).alias("_offered"))
    return one.select(
        total(drift).alias("drift_alerts"), (F.col("_offered") - total(kept)).alias("deduped_alerts"), total(fused).alias("fused_alerts")
    )
