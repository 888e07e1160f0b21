"""Suppression, incidents, block decisions and the block list."""

from pyspark.sql import DataFrame, functions as F

from threatflow.functions import verdicts
from threatflow.operators.lookup import playbook_of
from threatflow.plans import ordered
from threatflow.plans.session import written

SECOND = 1_000_000


def suppress_repeats(alerts: DataFrame, keys, window_s=30.0, at="ts_us", tie="alert_id", chunk_rows=ordered.CHUNK_ROWS):
    """Drop alerts seen less than ``window_s`` after the last kept one of their key."""
    return ordered.keep_spaced(alerts, keys, at, tie, int(window_s * SECOND), chunk_rows)


def drop_noise(alerts: DataFrame):
    return alerts.where(~verdicts.is_noise(F.col("attack_types"), F.coalesce("source_ip", F.lit(""))))


def incidents(alerts: DataFrame, cooldown_s=60.0, chunk_rows=ordered.CHUNK_ROWS):
    """One incident per source and primary type and cooldown, with playbook and text."""
    primary = F.coalesce(F.get("attack_types", F.lit(0)), F.lit("Unknown"))
    rows = (
        alerts.withColumn("primary", primary)
        .withColumn("_key", F.concat_ws("|", F.coalesce("source_ip", F.lit("unknown")), "primary"))
    )
    # numbering looks for hot keys first; written, so that this does not suppress all over again
    rows = written(suppress_repeats(rows, ["_key"], cooldown_s, chunk_rows=chunk_rows)).withColumn("_one", F.lit(0))
    rows = ordered.number_rows(rows, ["_one"], ["ts_us", "alert_id"], "seq", chunk_rows)
    rows = rows.withColumn("playbook", playbook_of(F.col("primary")))

    def actions(automated):
        steps = F.filter("playbook.steps", lambda s: s["automated"] == F.lit(automated))
        return F.transform(steps, lambda s: s["action"])

    node = F.col("target_node") if "target_node" in alerts.columns else F.lit("unknown")
    return (
        rows.withColumn("incident_id", F.format_string("INC-%05d", "seq"))
        .withColumn("severity", F.col("playbook.severity"))
        .withColumn("mitre_id", F.col("playbook.mitre_id"))
        .withColumn("automated", actions(True))
        .withColumn("manual", actions(False))
        .withColumn("status", F.lit("active"))
        .withColumn("narrative", verdicts.narrative(
            F.col("severity"), F.col("primary"), F.col("source_ip"), F.col("dest_ip"), node,
            F.col("confidence"), F.col("automated"), F.col("manual")))
        .drop("_key", "_one")
    )


def incident_stats(incident_rows: DataFrame, newest=200):
    """Totals, and severities over the newest incidents that are still listed."""
    total = incident_rows.agg(F.max("seq")).scalar()
    return incident_rows.where(F.col("seq") > total - newest).groupBy("severity").agg(
        F.count(F.lit(1)).alias("listed"), F.max(total).alias("total")
    )


def block_decisions(alerts: DataFrame, enabled, ttl_s=300, score="risk_score", signals="signal_count"):
    """Rows for the block list from alerts that ask for a block and pass the gate."""
    asks = F.lower(F.trim("action")).isin("block", "blocked")
    passes = verdicts.may_block(F.col(score), F.col(signals), F.col("source_ip"), enabled)
    return alerts.where(asks & passes).select(
        F.col("source_ip").alias("key"),
        F.lit("auto_block").alias("reason"),
        "ts_us",
        (F.col("ts_us") + ttl_s * SECOND).alias("expires_us"),
        F.lit(False).alias("deleted"),
    )


def latest_per_key(changes: DataFrame, key="key", order=("ts_us",)):
    """Last write per key; a last write marked ``deleted`` removes the key.

    Of writes at the same place in ``order`` a deletion wins; name a write number last in ``order``
    where the sequence of such writes is known.
    """
    rest = [c for c in changes.columns if c != key]
    deleted = F.coalesce(F.col("deleted"), F.lit(False))
    last = changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order, deleted)).alias("r"))
    return last.select(key, "r.*").where(~deleted)


def active_at(entries: DataFrame, now_us):
    """Entries still in force: they end at ``now`` or later."""
    return entries.where(F.col("expires_us") >= now_us)


def split_by_block(events: DataFrame, changes: DataFrame, source="source_ip", blocked=True, tie="event_id"):
    """Events whose source was blocked when they happened, or those that were not.

    Each event needs only the last change of its key before it, so events and changes
    are put in one order and the change is carried along.  There is no range join,
    and a key with many changes or events is split like any other hot key.
    """
    cols = events.columns
    mark = F.struct(F.col("expires_us"), F.coalesce("deleted", F.lit(False)).alias("deleted"))
    left = events.select(
        F.coalesce(F.col(source), F.lit("")).alias("_key"), "ts_us", F.lit(1).alias("_kind"),
        F.col(tie).cast("string").alias("_tie"), F.struct(*cols).alias("_event"),
        F.lit(None).cast("struct<expires_us:bigint,deleted:boolean>").alias("_mark"),
    )
    right = changes.select(
        F.col("key").alias("_key"), "ts_us", F.lit(0).alias("_kind"),
        # of changes at one instant a deletion comes last
        F.when(F.coalesce("deleted", F.lit(False)), "1").otherwise("0").alias("_tie"), F.lit(None).cast(left.schema["_event"].dataType).alias("_event"),
        mark.alias("_mark"),
    )
    rows = ordered.split_hot(left.unionByName(right), ["_key"], ["ts_us", "_kind", "_tie"])
    rows = ordered.carry(rows, ["_key"], ["ts_us", "_kind", "_tie"], _seen=("last", "_mark"))
    held = F.col("_seen").isNotNull() & ~F.col("_seen.deleted") & (F.col("_seen.expires_us") >= F.col("ts_us"))
    rows = rows.where(F.col("_kind") == 1).where(F.coalesce(held, F.lit(False)) == F.lit(blocked))
    return rows.select("_event.*")
