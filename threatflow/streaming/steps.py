"""Steps of streams in event-time order: batch operators over a stretch of time and what was carried to it."""

import math

from pyspark.sql import DataFrame, functions as F

from threatflow.operators import baseline, correlate, flow_features as ff, policy, rate, respond
from threatflow.plans import ordered

SECOND = 1_000_000


def _with_tail(rows: DataFrame, tail):
    """Carried and new rows together, told apart by ``_fresh``."""
    fresh = rows.withColumn("_fresh", F.lit(True))
    return fresh if tail is None else fresh.unionByName(tail.withColumn("_fresh", F.lit(False)))


def _newest(rows, key, order, n, chunk_rows=ordered.CHUNK_ROWS):
    """The last ``n`` rows of each key."""
    numbered = ordered.number_rows(rows, [key], order, "_rn", chunk_rows)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_of"))
    # joined by key in chunks of rows, as a hot key's rows are numbered in chunks
    return numbered.join(F.broadcast(counts) if counts.limit(10_001).count() <= 10_000 else counts, key).where(
        F.col("_rn") > F.col("_of") - n
    ).drop("_rn", "_of")


def rate_step(threshold=100, window_s=10.0, key="src_ip", keep_s=86_400.0):
    """W1 in a stream: alerts of the rate detector. A source unseen for ``keep_s`` starts counting anew."""
    span = int(window_s * SECOND)

    def step(rows, carried, upto):
        rows = rows.where(F.coalesce(F.col(key), F.lit("")) != "").select(key, "ts_us", "packet_id")
        both = _with_tail(rows, carried.get("tail"))
        numbered = ordered.number_rows(rows, [key], ["ts_us", "packet_id"], "_nth").select("packet_id", "_nth")
        counted = ordered.rolling_range(both, [key], "ts_us", span, "packet_id", in_window=("count", None))
        over = F.col("in_window") - threshold
        out = counted.where(F.col("_fresh") & (over >= 0)).join(numbered, "packet_id")
        if "totals" in carried:
            out = out.join(carried["totals"].select(key, "seen"), key, "left")
        else:
            out = out.withColumn("seen", F.lit(0).cast("bigint"))
        out = out.select(
            key, "ts_us", "packet_id", (F.col("_nth") + F.coalesce("seen", F.lit(0))).alias("packets_analyzed"), "in_window",
            F.least(F.lit(0.95), 0.60 + over * 0.05).alias("confidence"),
        )
        totals = rows.groupBy(key).agg(F.count(F.lit(1)).alias("seen"), F.max("ts_us").alias("last_us"))
        if "totals" in carried:
            totals = totals.unionByName(carried["totals"]).groupBy(key).agg(F.sum("seen").alias("seen"), F.max("last_us").alias("last_us"))
        return out, {
            "tail": both.where(F.col("ts_us") > upto - span).drop("_fresh"),
            "totals": totals.where(F.col("last_us") > upto - int(keep_s * SECOND)),
        }

    return step


def suppress_step(keys, window_s=30.0, tie="alert_id"):
    """R1 in a stream: the last kept alert of each key goes on being the one that followers are measured by."""

    def step(rows, carried, upto):
        both = _with_tail(rows, carried.get("kept"))
        kept = respond.suppress_repeats(both, list(keys), window_s, tie=tie)
        return kept.where("_fresh").drop("_fresh"), {
            "kept": kept.where(F.col("ts_us") > upto - int(window_s * SECOND)).drop("_fresh")
        }

    return step


def threshold_step(key, score, window=500, quantile=0.01, least=200, row_id="alert_id"):
    """W2 in a stream: each score against the low quantile of the last ones of its key."""
    order = ["ts_us", row_id]

    def step(rows, carried, upto):
        both = _with_tail(rows.select(key, *order, score), carried.get("tail"))
        out = baseline.adaptive_threshold(both, key, order, score, window, quantile, least)
        return out.where("_fresh").drop("_fresh"), {
            "tail": _newest(both.drop("_fresh"), key, order, max(window, least) - 1)
        }

    return step


def baseline_step(key, features, alpha=0.05, row_id="packet_id"):
    """W3 in a stream: means and variances after each stretch, one row per key that had rows.

    A carried mean is a first row of that value, and a carried variance fades with every row after it.
    """
    order = ["ts_us", row_id]
    names = [f"{kind}_{f}" for f in features for kind in ("mean", "var")]

    def step(rows, carried, upto):
        rows = rows.select(key, *order, *[F.col(f).cast("double").alias(f) for f in features])
        state = carried.get("state")
        both = rows
        if state is not None:
            first = state.join(rows.select(key).distinct(), key, "left_semi")
            both = rows.unionByName(first.select(
                key, F.lit(-(2**62)).cast("bigint").alias("ts_us"), F.lit(0).cast(rows.schema[row_id].dataType).alias(row_id),
                *[F.col(f"mean_{f}").alias(f) for f in features],
            ))
        now = baseline.moving_baseline(both, key, order, features, alpha)
        if state is not None:
            old = state.select(key, F.col("n").alias("_n"), *[F.col(f"var_{f}").alias(f"_v_{f}") for f in features])
            now = now.join(old, key, "left")
            rest = F.col("n") - F.when(F.col("_n").isNotNull(), 1).otherwise(0)
            fade = F.pow(F.lit(1.0 - alpha), rest)
            now = now.select(
                key, (rest + F.coalesce("_n", F.lit(0))).alias("n"),
                *[F.col(f"mean_{f}") for f in features],
                *[(F.col(f"var_{f}") + F.coalesce(F.col(f"_v_{f}") * fade, F.lit(0.0))).alias(f"var_{f}") for f in features],
            )
        now = now.select(key, "n", *names)
        whole = now if state is None else now.unionByName(state.join(now, key, "left_anti").select(key, "n", *names))
        return now, {"state": whole}

    return step


def drift_step(key, features, stats, window=500, z_at=3.0, min_features=4, cooldown_s=300.0, row_id="packet_id"):
    """W4 in a stream: rows whose rolling means left the baseline, at most one a cooldown."""
    order, cooldown = ["ts_us", row_id], int(cooldown_s * SECOND)

    def step(rows, carried, upto):
        rows = rows.select(key, *order, *[F.col(f).cast("double").alias(f) for f in features])
        both = _with_tail(rows, carried.get("tail"))
        found = baseline.drifted(both, key, order, features, stats, window, z_at, min_features, keep=["_fresh"])
        found = found.where("_fresh").drop("_fresh")
        kept = ordered.keep_spaced(_with_tail(found, carried.get("alerts")), [key], "ts_us", row_id, cooldown)
        return kept.where("_fresh").drop("_fresh"), {
            "tail": _newest(both.drop("_fresh"), key, order, max(window - 1, 50, min_features * 5)),
            "alerts": kept.where(F.col("ts_us") > upto - cooldown).drop("_fresh"),
        }

    return step


def _open_chains(known, steps_of, upto, gap, row_id):
    """Ids of the alerts that belong to a chain that still may go on."""
    alive = steps_of.groupBy("source_ip", "chain_us").agg(F.max("ts_us").alias("_last")).where(F.col("_last") >= upto - gap)
    return steps_of.join(alive, ["source_ip", "chain_us"], "left_semi").select(row_id)


def chain_step(window_s=300.0, row_id="alert_id"):
    """K1 and K2 in a stream: kill-chain alerts. Carried are the alerts of chains that still may go on."""
    gap = int(window_s * SECOND)

    def step(rows, carried, upto):
        both = _with_tail(rows, carried.get("tail"))
        known = both.drop("_fresh")
        fresh = both.where("_fresh").select(F.col(row_id).alias("trigger_id"))
        out = correlate.chain_alerts(known, window_s).join(fresh, "trigger_id", "left_semi")
        alive = _open_chains(known, correlate.chain_steps(known, window_s), upto, gap, row_id)
        return out, {"tail": known.join(alive, row_id, "left_semi")}

    return step


def correlation_step(window_s=300.0, row_id="alert_id"):
    """J5, K1 to K3 in a stream: correlations by source and by target, kill-chain alerts, and the chain's precedence.

    Carried are the alerts of the last ``window_s`` and those of chains that still may go on.
    """
    gap = int(window_s * SECOND)

    def step(rows, carried, upto):
        both = _with_tail(rows, carried.get("tail"))
        known = both.drop("_fresh")
        fresh = both.where("_fresh").select(F.col(row_id).alias("event_id"))
        out = correlate.derived_alerts(known, window_s).join(fresh, "event_id", "left_semi")
        alive = _open_chains(known, correlate.chain_steps(known, window_s), upto, gap, row_id)
        recent = known.where(F.col("ts_us") > upto - gap).select(row_id)
        return out, {"tail": known.join(recent.union(alive).distinct(), row_id, "left_semi")}

    return step


def partner_step(window_s=300.0):
    """J5 by side in a stream: earlier alerts of the same source or target, counted, with their types united."""
    span = int(window_s * SECOND)

    def step(rows, carried, upto):
        sides = F.array(
            F.struct(F.lit("source").alias("side"), F.col("source_ip").alias("ip")),
            F.struct(F.lit("target").alias("side"), F.col("dest_ip").alias("ip")),
        )
        rows = rows.select("alert_id", "ts_us", "attack_type", F.explode(sides).alias("s"))
        rows = rows.select("alert_id", "ts_us", "attack_type", "s.side", "s.ip").where("ip <> ''")
        both = _with_tail(rows, carried.get("tail"))
        out = ordered.rolling_range(
            both, ["side", "ip"], "ts_us", span, "alert_id", closed=False, n=("count", None), types=("set", "attack_type")
        ).where(F.col("_fresh") & (F.col("n") > 1))
        out = out.select("alert_id", "side", (F.col("n") - 1).alias("partners"), F.array_join("types", ",").alias("attacks"))
        return out, {"tail": both.where(F.col("ts_us") > upto - span).drop("_fresh")}

    return step


def session_step(timeout_s=120.0, idle_s=1.0, min_bulk=4):
    """A1 in a stream: the 78 features of each flow session once its timeout has passed.

    Carried are the packets of sessions that may still go on.
    """
    timeout = int(timeout_s * SECOND)

    def step(rows, carried, upto):
        both = _with_tail(rows, carried.get("open")).drop("_fresh")
        last = ff.sessionize(both, timeout_s, idle_s, min_bulk).select("packet_id", "flow", "session_us", "ts_us")
        ended = last.groupBy("flow", "session_us").agg(F.max("ts_us").alias("_last")).where(F.col("_last") + timeout <= upto)
        done = last.join(ended, ["flow", "session_us"], "left_semi").select("packet_id")
        closed = both.join(done, "packet_id", "left_semi")
        return ff.flow_features(closed, timeout_s, idle_s, min_bulk), {"open": both.join(done, "packet_id", "left_anti")}

    return step


def policy_step(key, interval=50, vote="is_tp", row_id="alert_id"):
    """K6 in a stream: decisions after each block of votes. Carried are votes of unfinished blocks, counts and values."""
    order = ["ts_us", row_id]

    def step(rows, carried, upto):
        both = _with_tail(rows.select(key, *order, vote), carried.get("votes")).drop("_fresh")
        blocks, rest, counts = policy.more_blocks(both, key, order, carried.get("counts"), vote, interval)
        ran = policy.policy_run(blocks, key, values=carried.get("values"), thresholds=carried.get("thresholds"))
        values = ran.groupBy(key, "attack_bin", "fp_bin").agg(F.max_by("q", "block").alias("q"))
        thresholds = ran.groupBy(key).agg(F.max_by("new_threshold", "block").alias("threshold"))
        if "values" in carried:
            at = [key, "attack_bin", "fp_bin"]
            values = values.unionByName(carried["values"].join(values, at, "left_anti"))
            thresholds = thresholds.unionByName(carried["thresholds"].join(thresholds, key, "left_anti"))
        return ran.drop("q"), {"votes": rest, "counts": counts, "values": values, "thresholds": thresholds}

    return step


def limit_step(key, limit=100, window_s=60, row_id="packet_id"):
    """K7 in a stream: whether each request is within its key's limit of the window."""
    width = window_s * SECOND

    def step(rows, carried, upto):
        both = _with_tail(rows, carried.get("tail"))
        out = rate.rate_limit(both, key, limit, window_s, row_id).where("_fresh").drop("_fresh")
        # requests of the window that is still open
        return out, {"tail": both.where(F.floor(F.col("ts_us") / width) >= math.floor(upto / width)).drop("_fresh")}

    return step
