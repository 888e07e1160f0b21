"""Alerts of several detectors: one stream, risk score, one fused alert per packet."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from threatflow.functions import values as V
from threatflow.functions.fields import confidence

DETECTOR_ORDER = ["rule", "dos", "xgboost", "anomaly", "drift", "risk"]


def union_detectors(streams: dict):
    """Alert streams under one schema, with ``ord`` as the place of the detector."""
    parts = [
        df.withColumn("ord", F.lit(DETECTOR_ORDER.index(name))) for name, df in streams.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def risk(classifier: Column, is_attack: Column, anomaly: Column, is_anomaly: Column, drift: Column):
    """Risk struct from up to three signals; a NULL signal counts as not available.

    The score is the weighted mean over the available signals, weights as fixed.
    """
    x, a, d = confidence(classifier), confidence(anomaly), confidence(drift)
    flagged = F.coalesce(is_anomaly, F.lit(False))
    parts = {
        "xgboost": (
            classifier.isNotNull(),
            F.coalesce(is_attack, F.lit(False)) | F.coalesce(classifier.isNotNull() & (x >= V.RISK_ACTIVE_AT), F.lit(False)),
            F.when(classifier.isNotNull(), x).otherwise(0.0),
        ),
        "anomaly": (
            is_anomaly.isNotNull(), flagged, F.when(flagged, a).otherwise(0.0),
        ),
        "drift": (drift.isNotNull(), drift.isNotNull(), F.when(drift.isNotNull(), d).otherwise(0.0)),
    }
    weight, total = F.lit(0.0), F.lit(0.0)
    for name, (available, _, score) in parts.items():
        w = V.RISK_WEIGHTS[name]
        weight = weight + F.when(available, w).otherwise(0.0)
        total = total + F.when(available, score * w).otherwise(0.0)
    active = F.filter(
        F.array(*[F.when(on, F.lit(name)) for name, (_, on, _) in parts.items()]),
        lambda s: s.isNotNull(),
    )
    score = F.when(weight > 0, total / weight).otherwise(0.0)
    return F.struct(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"),
        F.size(active).alias("signal_count"),
        active.alias("signals"),
        F.struct(
            *[
                F.struct(
                    available.alias("available"), on.alias("active"), s.alias("score"),
                    F.lit(V.RISK_WEIGHTS[name]).alias("weight"),
                ).alias(name)
                for name, (available, on, s) in parts.items()
            ]
        ).alias("components"),
        F.lit(V.RISK_ALERT_AT).alias("threshold"),
        F.lit(V.RISK_BLOCK_AT).alias("autoblock_threshold"),
    )


def detector_weight(detector: Column):
    table = F.create_map(*[F.lit(x) for kv in V.DETECTOR_WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, detector), F.lit(V.OTHER_DETECTOR_WEIGHT))


def fuse(alerts: DataFrame, by="packet_id"):
    """One alert per packet: all types in order, top confidence, weighted fusion score.

    Needs ``ord, detector, action, confidence, attack_types``.  A packet has at most
    one alert per detector, so the lists below stay short.
    """
    conf = F.coalesce("confidence", F.lit(0.5))
    prio = F.when(F.col("action").isin("block", "blocked"), 2).when(F.col("action") == "flagged", 1).otherwise(0)
    first_wins = -F.col("ord")
    grouped = alerts.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_alerts"),
        F.array_sort(F.collect_list(F.struct("ord", "attack_types", "detector"))).alias("_l"),
        F.max_by("detector", F.struct(conf, first_wins)).alias("base_detector"),
        F.max(conf).alias("confidence"),
        F.max(conf * detector_weight(F.col("detector"))).alias("fusion_score"),
        F.max_by("action", F.struct(prio, first_wins)).alias("action"),
    )
    many = F.col("n_alerts") > 1
    return grouped.select(
        by, "n_alerts", "base_detector", "confidence", "action",
        F.array_distinct(F.flatten("_l.attack_types")).alias("attack_types"),
        F.col("_l.detector").alias("detectors"),
        F.when(many, F.col("fusion_score")).alias("fusion_score"),
        F.when(many, "fusion").otherwise(F.col("base_detector")).alias("mitigated_by"),
    )
