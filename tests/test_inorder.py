"""Streams that come in any order give what the batch operators give; rows that come too late are set aside."""

import random

import pytest
from pyspark.sql import functions as F

from threatflow.operators import baseline, correlate, flow_features as ff, policy, rate, respond
from threatflow.plans import views
from threatflow.plans.session import shared_dir
from threatflow.streaming import inorder, jobs, steps

SF = "/root/testdata/sf0.001"
DAY, DELAY = 86_400, "20 days"


def feed_of(spark, rows, schema, batches):
    base = shared_dir(spark, "test-feed")
    for part in batches:
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(base)
    return lambda: jobs.read_table(spark, base, files_per_batch=1)


@pytest.fixture(scope="module")
def feed(spark):
    """The events in four files, out of order within each and between them."""
    events = views.table(spark, SF, "events")
    rows = events.orderBy("ts", "event_id").collect()
    rnd, n = random.Random(1), len(rows)
    place = sorted(range(n), key=lambda i: i + rnd.uniform(0, n / 6))
    parts = [place[i * n // 4 : (i + 1) * n // 4] for i in range(4)]
    for p in parts:
        rnd.shuffle(p)
    assert parts[0] != sorted(parts[0]) and max(parts[0]) > min(parts[1])
    return feed_of(spark, rows, events.schema, parts)


def rows(df, *cols):
    df = df.select(*cols) if cols else df.select(sorted(df.columns))
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())


def run(feed, build, step, row_id="alert_id", delay=DELAY):
    done = inorder.run_in_order(feed(), build, step, "t", row_id=row_id, delay=delay)
    assert done.late().count() == 0
    assert len(done._numbers("steps")) > 1
    return done.results()


def test_rate(spark, feed):
    got = run(feed, views.as_packets, steps.rate_step(3, float(DAY), keep_s=1000.0 * DAY), "packet_id")
    cols = ("packet_id", "in_window", "packets_analyzed", "confidence")
    assert rows(got, *cols) == rows(rate.rate_alerts(views.packets(spark, SF), 3, float(DAY)), *cols) != []


def test_suppression(spark, feed):
    got = run(feed, views.as_alerts, steps.suppress_step(["source_ip"], 2 * DAY))
    want = respond.suppress_repeats(views.alerts(spark, SF), ["source_ip"], 2 * DAY)
    assert rows(got, "alert_id", "source_ip") == rows(want, "alert_id", "source_ip") != []


def test_threshold(spark, feed):
    got = run(feed, views.as_alerts, steps.threshold_step("location", "value", 50, 0.05, 20))
    want = baseline.adaptive_threshold(views.alerts(spark, SF), "location", ["ts_us", "alert_id"], "value", 50, 0.05, 20)
    cols = ("alert_id", "threshold", "is_anomaly")
    assert rows(got, *cols) == rows(want, *cols) and want.where("is_anomaly").count()


def test_baseline(spark, feed):
    got = run(feed, views.as_packets, steps.baseline_step("location", ["size", "payload_len"]), "packet_id")
    rest = [c for c in got.columns if c != "location"]
    last = got.groupBy("location").agg(F.max_by(F.struct(*rest), "n").alias("s")).select("location", "s.*")
    batch = views.packets(spark, SF).withColumns({c: F.col(c).cast("double") for c in ("size", "payload_len")})
    assert rows(last) == rows(baseline.moving_baseline(batch, "location", ["ts_us", "packet_id"], ["size", "payload_len"])) != []


def test_drift(spark, feed):
    features = ["size", "payload_len", "value"]
    stats = baseline.baseline_stats(views.packets(spark, SF), features)
    got = run(feed, views.as_packets, steps.drift_step("location", features, stats, 60, 0.05, 2, 7200.0), "packet_id")
    batch = views.packets(spark, SF).withColumns({c: F.col(c).cast("double") for c in features})
    want = baseline.drift_alerts(batch, "location", ["ts_us", "packet_id"], features, stats, 60, 0.05, 2, 7_200_000_000)
    cols = ("packet_id", "n_features", "features")
    assert rows(got, *cols) == rows(want, *cols) != []


def test_derived_alerts(spark, feed):
    got = run(feed, views.as_alerts, steps.correlation_step(float(DAY)))
    want = correlate.derived_alerts(views.alerts(spark, SF), float(DAY))
    kinds = {r["kind"] for r in want.select("kind").distinct().collect()}
    assert kinds == {"kill_chain", "correlation"} and rows(got) == rows(want)


def test_flow_features_on_timeout(spark, feed):
    got = run(feed, views.as_flow_packets, steps.session_step(8.0), "packet_id", "45 seconds")  # the clock of flows is fast
    want = ff.flow_features(views.flow_packets(spark, SF), 8.0, 1.0)
    assert len(got.columns) == 80 and rows(got) == rows(want) != []


def test_policy(spark, feed):
    vote = F.col("value") > 20
    got = run(feed, lambda e: views.as_alerts(e).withColumn("is_tp", vote), steps.policy_step("location", 20))
    blocks = policy.policy_blocks(views.alerts(spark, SF).withColumn("is_tp", vote), "location", ["ts_us", "alert_id"], interval=20)
    assert rows(got) == rows(policy.policy_run(blocks, "location").drop("q")) != []


def test_limit(spark, feed):
    got = run(feed, views.as_packets, steps.limit_step("location", 5, DAY), "packet_id")
    cols = ("packet_id", "allowed", "remaining", "reset_s")
    want = rate.rate_limit(views.packets(spark, SF), "location", 5, DAY)
    assert rows(got, *cols) == rows(want, *cols) and want.where("not allowed").count()


def late_feed(spark):
    second = 1_000_000
    batches = [[100, 130, 120], [200, 90], [110, 300], [150, 400], [10_000]]
    table, parts = [], []
    for batch in batches:
        parts.append(range(len(table), len(table) + len(batch)))
        table += [(t * second, len(table) + i, "k") for i, t in enumerate(batch)]
    return feed_of(spark, table, "ts_us long, packet_id long, src_ip string", parts)


def test_late_rows_are_set_aside(spark):
    """Watermarks before the batches: none, 100, 170, 270, 370 (30 s behind what has come)."""
    def step(rows, carried, upto):
        return rows, {}

    done = inorder.run_in_order(late_feed(spark)(), lambda e: e, step, "late", delay="30 seconds")
    assert sorted(r["at_us"] // 1_000_000 for r in done.late().collect()) == [90, 110, 150]
    assert sorted(r["ts_us"] // 1_000_000 for r in done.results().collect()) == [100, 120, 130, 200, 300, 400, 10_000]


def test_a_run_goes_on_where_it_ended(spark, feed):
    base = shared_dir(spark, "test-goes-on")
    step = steps.suppress_step(["source_ip"], 2 * DAY)
    for _ in range(2):
        done = inorder.run_in_order(feed(), views.as_alerts, step, "t", row_id="alert_id", delay=DELAY, base=base)
    want = respond.suppress_repeats(views.alerts(spark, SF), ["source_ip"], 2 * DAY)
    assert rows(done.results(), "alert_id") == rows(want, "alert_id")


def test_a_batch_that_runs_again_replaces_itself(spark):
    base = shared_dir(spark, "test-again")
    calls = []

    def step(rows, carried, upto):
        calls.append(sorted(carried))
        both = rows if "all" not in carried else rows.unionByName(carried["all"])
        return rows, {"all": both}

    go = inorder.InOrder(spark, "a long", step, base)
    first = spark.createDataFrame([(1, "1", '{"a":1}', False, 5)], inorder.OUT)
    second = spark.createDataFrame([(7, "2", '{"a":2}', False, 9), (3, "3", '{"a":3}', True, 9)], inorder.OUT)
    for number, batch in ((0, first), (1, second), (1, second), (1, second)):
        go(batch, number)
    assert calls == [[], ["all"], ["all"], ["all"]]
    assert rows(go.results()) == ["[1]", "[2]"] and go.late().count() == 1
    assert rows(go._carried(2)[0]["all"]) == ["[1]", "[2]"]
    go(spark.createDataFrame([], inorder.OUT), 2)
    assert rows(go.results()) == ["[1]", "[2]"]
