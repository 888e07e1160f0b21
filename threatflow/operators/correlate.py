"""Correlation of alerts and kill chains per source."""

from pyspark.sql import DataFrame, functions as F

from threatflow.functions import values as V
from threatflow.operators.lookup import stage_name, stage_ord_of
from threatflow.plans import ordered

SECOND = 1_000_000
STAGE_NAMES = list(V.STAGES)


def correlations(alerts: DataFrame, window_s=300.0, chunk_rows=ordered.CHUNK_ROWS):
    """Alerts with at least one earlier partner of the same source or target.

    A partner is an earlier alert less than ``window_s`` old; one that shares source
    and target counts twice.  Partners are counted and their types united, never
    listed pair by pair: ``src_from_us`` and ``dst_from_us`` say where the two runs of
    partners begin, which names them all in constant space.
    """
    span = int(window_s * SECOND)
    known = alerts.where(
        (F.coalesce("source_ip", F.lit("")) != "") & (F.coalesce("dest_ip", F.lit("")) != "")
    )
    rows = known
    for side, key in (("src", "source_ip"), ("dst", "dest_ip")):
        rows = ordered.rolling_range(
            rows, [key], "ts_us", span, "alert_id", closed=False, chunk_rows=chunk_rows,
            **{
                f"_{side}_n": ("count", None),
                f"_{side}_types": ("set", "attack_type"),
                f"{side}_from_us": ("min", "ts_us"),
            },
        )
    partners = F.col("_src_n") + F.col("_dst_n") - 2
    boost = F.least(F.lit(20), partners * 5) / 100
    return (
        rows.withColumn("partners", partners)
        .where(F.col("partners") > 0)
        .withColumn("attack_types", F.array_sort(F.array_union("_src_types", "_dst_types")))
        .withColumn("base_confidence", F.col("confidence"))
        .withColumn("confidence", F.least(F.lit(0.99), F.col("confidence") + boost))
        .withColumn("action", F.when(F.col("confidence") > 0.8, "blocked").otherwise("flagged"))
        .drop("_src_n", "_dst_n", "_src_types", "_dst_types")
    )


def staged(alerts: DataFrame):
    """Alerts that belong to a kill-chain stage, with stage and its order."""
    tags = F.col("tags") if "tags" in alerts.columns else None
    return (
        alerts.where((F.coalesce("source_ip", F.lit("")) != "") & (F.coalesce("dest_ip", F.lit("")) != ""))
        .withColumn("stage_ord", stage_ord_of(F.col("attack_types"), tags))
        .where(F.col("stage_ord").isNotNull())
        .withColumn("stage", stage_name(F.col("stage_ord")))
    )


def chain_steps(alerts: DataFrame, window_s=300.0, chunk_rows=ordered.CHUNK_ROWS):
    """Staged alerts with the start of their chain, the stages so far and ``nth`` per source; see ``_steps``."""
    return _steps(alerts, window_s, chunk_rows).drop("_chunk")


def _steps(alerts, window_s, chunk_rows):
    """Staged alerts with the start of their chain, the stages so far and ``nth`` per source.

    A chain of a source ends after more than ``window_s`` without a staged alert.  A
    stage is part of the chain if it was last seen after the chain began, so seven
    running values per source stand in for a set that grows.
    """
    gap = int(window_s * SECOND)
    order = ["ts_us", "alert_id"]
    rows = ordered.split_hot(staged(alerts), ["source_ip"], order, chunk_rows)
    last = {f"_last{i}": ("last", F.when(F.col("stage_ord") == i, F.col("ts_us"))) for i in range(1, 8)}
    before = {f"_was{i}": ("prior", F.when(F.col("stage_ord") == i, F.col("ts_us"))) for i in range(1, 8)}
    rows = rows.withColumn("_one", F.lit(1).cast("long"))
    rows = ordered.carry(
        rows, ["source_ip"], order, _prev=("prior", "ts_us"), nth=("sum", "_one"), **last, **before
    )
    rows = rows.withColumn(
        "_new", F.col("_prev").isNull() | (F.col("ts_us") - F.col("_prev") > gap)
    )
    rows = ordered.carry(
        rows, ["source_ip"], order,
        chain_us=("last", F.when(F.col("_new"), F.col("ts_us"))),
    )
    here = F.array(*[
        F.when(F.coalesce(F.col(f"_last{i}") >= F.col("chain_us"), F.lit(False)), F.lit(s))
        for i, s in enumerate(STAGE_NAMES, 1)
    ])
    was = F.array(*[F.col(f"_was{i}") for i in range(1, 8)])
    seen_before = F.coalesce(F.get(was, F.col("stage_ord") - 1) >= F.col("chain_us"), F.lit(False))
    # the first row of a chain has no earlier row of it, even at the same instant
    return (
        rows.withColumn("stages", F.filter(here, lambda s: s.isNotNull()))
        .withColumn("n_stages", F.size("stages"))
        .withColumn("first_of_stage", F.col("_new") | ~seen_before)
        .drop("_one", "_prev", "_new", *last, *before)
    )


def chain_alerts(alerts: DataFrame, window_s=300.0, least=3, chunk_rows=ordered.CHUNK_ROWS):
    """One alert each time a chain reaches three or more stages, or one more.

    What an alert tells of its chain so far (alerts per stage, types, the ids of the newest twenty) are running values
    of the chain, so the alerts are read off its steps and nothing is joined back.
    """
    keys, order = ["source_ip", "chain_us"], ["ts_us", "alert_id"]
    rows = _steps(alerts, window_s, chunk_rows).withColumn("_one", F.lit(1).cast("long"))
    counts = {f"n_{s}": ("sum", F.when(F.col("stage_ord") == i, 1).otherwise(0).cast("long")) for i, s in enumerate(STAGE_NAMES, 1)}
    rows = ordered.carry(
        rows, keys, order, total_alerts=("sum", "_one"), attacks=("union", "attack_types"), correlated_events=("newest", "alert_id"), **counts
    )
    out = rows.where(F.col("first_of_stage") & (F.col("n_stages") >= least)).select(
        "source_ip", "chain_us", F.col("alert_id").alias("trigger_id"), F.col("ts_us").alias("at_us"), "n_stages", "stages",
        "total_alerts", "attacks", *counts, "correlated_events",
    )
    share = F.col("n_stages") / len(STAGE_NAMES)
    return (
        out.withColumn("completeness", F.round(share, 2))
        .withColumn("severity", F.when(share >= 0.6, "critical").otherwise("high"))
        .withColumn("confidence", F.least(F.lit(99), F.floor(share * 100 + 20)).cast("int"))
        .withColumn("action", F.when(share >= 0.5, "block").otherwise("flagged"))
        # fixed value: the wording of the description
        .withColumn("description", F.concat(
            F.lit("Kill chain detected from "), "source_ip", F.lit(": "), F.array_join("stages", " → "),
            F.lit(" ("), F.floor(share * 100).cast("string"), F.lit("% complete, "),
            F.col("total_alerts").cast("string"), F.lit(" related alerts)"),
        ))
    )


def derived_alerts(alerts: DataFrame, window_s=300.0, chunk_rows=ordered.CHUNK_ROWS):
    """Kill-chain and correlation alerts, at most one per event: the chain wins.

    Events that are themselves derived take no part, so nothing is correlated twice.
    """
    source = alerts.where(~F.col("derived")) if "derived" in alerts.columns else alerts
    chains = chain_alerts(source, window_s, chunk_rows=chunk_rows).select(
        F.col("trigger_id").alias("event_id"), F.lit("kill_chain").alias("kind"), "source_ip",
        (F.col("confidence") / 100).alias("confidence"), "action",
    )
    pairs = correlations(source, window_s, chunk_rows).select(
        F.col("alert_id").alias("event_id"), F.lit("correlation").alias("kind"), "source_ip", "confidence", "action"
    )
    pairs = pairs.join(chains.select("event_id"), "event_id", "left_anti")
    return chains.unionByName(pairs).withColumn("derived", F.lit(True))


def chain_summary(alerts: DataFrame):
    """Per source: stages reached, alerts and types per stage, completeness."""
    per_stage = staged(alerts).groupBy("source_ip", "stage", "stage_ord").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("attack_types")))).alias("types")
    )
    # at most seven rows per source are left here
    return per_stage.groupBy("source_ip").agg(
        F.round(F.count(F.lit(1)) / len(STAGE_NAMES), 2).alias("completeness"),
        F.sum("n").alias("total_alerts"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", F.struct("n", "types"))))).alias("stages"),
    )


def stage_matrix(alerts: DataFrame):
    return staged(alerts).groupBy("source_ip").pivot("stage", STAGE_NAMES).agg(F.count(F.lit(1))).na.fill(0)
