"""Files between jobs: stages, the alert table, audit lines, metric reports."""

from pyspark.sql import DataFrame, SparkSession, functions as F


def save_stage(df: DataFrame, path, by=None):
    """Write a stage; a finished stage is simply read again by a later run."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def load_stage(spark: SparkSession, *paths):
    """The first stage that was written, such as the balanced table or else the full one."""
    for path in paths:
        try:
            return spark.read.parquet(path)
        except Exception as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
    raise FileNotFoundError(", ".join(paths))


def append_alerts(alerts: DataFrame, path, now=None):
    """Append alerts, one folder per day; a missing time becomes now."""
    now_us = F.unix_micros(F.current_timestamp()) if now is None else F.lit(int(now))
    rows = alerts.withColumn("ts_us", F.coalesce("ts_us", now_us)).withColumn(
        "day", F.to_date(F.timestamp_micros("ts_us"))
    )
    # rows of a day meet in few files; the hash spreads a busy day over several
    rows.repartition("day", F.pmod(F.xxhash64("alert_id"), F.lit(32))).write.mode("append").partitionBy("day").parquet(path)


def append_audit(events: DataFrame, path):
    """Append audit rows (ts_us, event_type, actor, ip, details) as JSON lines per day."""
    rows = events.select(
        F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        "event_type", "actor", "ip", "details", F.to_date(F.timestamp_micros("ts_us")).alias("day"),
    )
    rows.write.mode("append").partitionBy("day").json(path)


def append_metrics(metrics: DataFrame, path, **labels):
    """Append metric rows, tagged with dataset, file, model or whatever is given."""
    for name, value in labels.items():
        metrics = metrics.withColumn(name, F.lit(value))
    metrics.write.mode("append").json(path)
