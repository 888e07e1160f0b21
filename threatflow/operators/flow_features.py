"""The 78 flow features and the 17 rolling packet features.

Which end of a connection counts as forward is only known from the first packet
of a flow.  So everything is measured per *side* first (side 0 is the lower
address), which any row knows by itself, and the sides are named forward and
backward once per flow at the end.  That leaves two ordered passes over the
packets and one partial aggregation, whatever the size of a flow.
"""

from pyspark.sql import DataFrame, functions as F

from threatflow.functions.fields import flag_count, protocol_number, to_int
from threatflow.plans import ordered

SIDES = (0, 1)
SECOND = 1_000_000


def with_flow_key(packets: DataFrame):
    """Add ``flow`` (same text for both directions) and ``side`` (who sent it)."""
    src_port, dst_port = to_int(F.col("src_port")), to_int(F.col("dst_port"))
    src = F.struct(F.coalesce("src_ip", F.lit("")).alias("ip"), src_port.alias("port"))
    dst = F.struct(F.coalesce("dst_ip", F.lit("")).alias("ip"), dst_port.alias("port"))
    proto = protocol_number(F.coalesce(F.col("protocol").cast("string"), F.lit("tcp")))
    low, high = F.least(src, dst), F.greatest(src, dst)
    return packets.withColumn(
        "flow",
        F.concat_ws("|", low["ip"], low["port"], high["ip"], high["port"], proto.cast("string")),
    ).withColumn("side", F.when(src <= dst, 0).otherwise(1))


def sessionize(packets: DataFrame, timeout_s=120.0, idle_s=1.0, min_bulk=4, chunk_rows=ordered.CHUNK_ROWS):
    """Packets with their flow, session start, gaps, pauses and share in bulk transfers.

    A gap over ``timeout_s`` starts a new session of the flow.  Gap columns are in
    seconds and NULL where the gap does not count.  A bulk transfer is a run of at least
    ``min_bulk`` packets with payload from one side, none over ``idle_s`` after the one
    before; the ``bulk_`` columns hold what a row adds to the transfers so far, so
    their sum over a session is its total.
    """
    timeout, idle = int(timeout_s * SECOND), int(idle_s * SECOND)
    if timeout < idle:
        raise ValueError("the flow timeout must not be shorter than the idle gap")
    ts = F.col("ts_us")
    order = ["ts_us", "packet_id"]
    rows = with_flow_key(packets).withColumn("_data", F.col("payload_len") > 0)
    rows = ordered.split_hot(rows, ["flow"], order, chunk_rows)
    seen = {"_prev": ("prior", "ts_us")}
    for s in SIDES:
        mine = F.col("side") == s
        seen[f"_prev{s}"] = ("prior", F.when(mine, ts))
        seen[f"_last{s}"] = ("prior", F.when(mine & F.col("_data"), ts))
        seen[f"_cnt{s}"] = ("sum", F.when(mine & F.col("_data"), F.lit(1).cast("long")))
        seen[f"_vol{s}"] = ("sum", F.when(mine & F.col("_data"), F.col("payload_len").cast("long")))
    rows = ordered.carry(rows, ["flow"], order, **seen)

    def own(name):
        return F.when(F.col("side") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    new = F.col("_prev").isNull() | (ts - F.col("_prev") > timeout)
    pause = ts - F.col("_prev") > idle
    # a run never spans sessions, since idle <= timeout
    run = F.col("_data") & (own("_last").isNull() | (ts - own("_last") > idle))
    rows = rows.withColumn("_new", new).withColumn("_pause", ~new & pause).withColumn("_run", run)
    starts = {
        "session_us": ("last", F.when(F.col("_new"), ts)),
        "_awake": ("prior", F.when(F.col("_new") | F.col("_pause"), ts)),
    }
    for s in SIDES:
        begins = F.struct(
            ts.alias("at"), (F.col(f"_cnt{s}") - 1).alias("cnt"), (F.col(f"_vol{s}") - F.col("payload_len")).alias("vol")
        )
        starts[f"_begin{s}"] = ("last", F.when((F.col("side") == s) & F.col("_run"), begins))
    rows = ordered.carry(rows, ["flow"], order, **starts)

    own_prev = F.when(own("_prev") >= F.col("session_us"), own("_prev"))
    begin = own("_begin")
    place = F.when(F.col("_data"), own("_cnt") - begin["cnt"])

    def seconds(gap, when):
        return F.when(when & (gap > 0), gap / SECOND)

    def adds(at_start, later):
        return F.when(place == min_bulk, at_start).when(place > min_bulk, later).otherwise(0)

    return rows.select(
        *packets.columns, "flow", "side", "session_us",
        seconds(ts - F.col("_prev"), ~F.col("_new")).alias("iat"),
        seconds(ts - own_prev, own_prev.isNotNull()).alias("side_iat"),
        seconds(ts - F.col("_prev"), F.col("_pause")).alias("idle"),
        seconds(F.col("_prev") - F.col("_awake"), F.col("_pause")).alias("active"),
        adds(F.lit(1), F.lit(0)).alias("bulk_runs"),
        adds(F.lit(min_bulk), F.lit(1)).alias("bulk_pkts"),
        adds(own("_vol") - begin["vol"], F.col("payload_len").cast("long")).alias("bulk_bytes"),
        adds(ts - begin["at"], ts - own("_last")).alias("bulk_us"),
    )


def bulk_totals(sessions: DataFrame):
    """Per flow session: number, packets, bytes and seconds of its bulk transfers."""
    out = sessions.groupBy("flow", "session_us").agg(
        F.sum("bulk_runs").alias("runs"), F.sum("bulk_pkts").alias("packets"), F.sum("bulk_bytes").alias("bytes"),
        (F.sum("bulk_us") / SECOND).alias("secs"),
    )
    return out.where("runs > 0")


LETTERS = {
    "fin_flag_cnt": "F", "syn_flag_cnt": "S", "rst_flag_cnt": "R", "psh_flag_cnt": "P",
    "ack_flag_cnt": "A", "urg_flag_cnt": "U", "cwe_flag_count": "C", "ece_flag_cnt": "E",
}


def _measures():
    """What is measured over the packets of a session: name -> (kind, column)."""
    flags = F.upper(F.coalesce("flags", F.lit("")))
    out = {"_first": ("first", F.col("side")), "dst_port": ("first", to_int(F.col("dst_port")))}

    def stats(name, col, *kinds):
        for kind in kinds:
            out[f"{name}_{kind}"] = (kind, col)

    for s in SIDES:
        mine = F.col("side") == s

        def total(name, col, mine=mine, s=s):
            out[f"{name}{s}"] = ("sum", F.when(mine, col))

        total("_pkts", F.lit(1))
        total("_bytes", F.col("size"))
        total("_psh", flags.contains("P").cast("int"))
        total("_urg", flags.contains("U").cast("int"))
        total("_head", F.col("header_len"))
        total("_act", (F.col("payload_len") > 0).cast("int"))
        for name in ("runs", "pkts", "bytes", "us"):
            total(f"_bulk_{name}", F.col(f"bulk_{name}"))
        out[f"_win{s}"] = ("first", F.when(mine, F.col("tcp_window")))
        stats(f"_len{s}", F.when(mine, F.col("size")), "max", "min", "mean", "std")
        stats(f"_iat{s}", F.when(mine, F.col("side_iat")), "sum", "mean", "std", "max", "min")
    stats("pkt_len", F.col("size"), "min", "max", "mean", "std", "var")
    for name, col in (("flow_iat", "iat"), ("active", "active"), ("idle", "idle")):
        stats(name, F.col(col), "mean", "std", "max", "min")
    for name, letter in LETTERS.items():
        out[name] = ("sum", flag_count(flags, letter))
    return out


def _per_session(rows):
    place = F.struct("ts_us", "packet_id")
    make = {
        "sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_pop, "var": F.var_pop,
        "first": lambda c: F.min_by(c, F.when(c.isNotNull(), place)),
    }
    return rows.groupBy("flow", "session_us").agg(
        *[make[kind](col).alias(name) for name, (kind, col) in _measures().items()],
        F.max_by(protocol_number(F.col("protocol")), place).alias("protocol"),
        F.greatest(F.max("ts_us") - F.min("ts_us"), F.lit(1)).alias("flow_duration"),
    )


def _so_far(rows, chunk_rows):
    """The same measures after each packet, as running values of its session."""
    keys, order = ["flow", "session_us"], ["ts_us", "packet_id"]
    specs, origins, result = {}, {}, {}
    for name, (kind, col) in _measures().items():
        if kind in ("sum", "min", "max", "first"):
            specs[name] = (kind, col)
            continue
        base = name.rsplit("_", 1)[0]
        x = col.cast("double")
        # distances from the session's first value, so that squares of large values don't cancel
        origin, n, total = F.col(f"_o_{base}"), F.col(f"_n_{base}"), F.col(f"_t_{base}")
        origins[f"_o_{base}"] = ("first", x)
        specs[f"_n_{base}"] = ("sum", F.when(x.isNotNull(), F.lit(1).cast("long")))
        specs[f"_t_{base}"] = ("sum", x - origin)
        if kind == "mean":
            result[name] = F.when(n > 0, origin + total / n)
        else:
            specs[f"_q_{base}"] = ("sum", (x - origin) * (x - origin))
            var = F.when(n > 0, F.greatest(F.col(f"_q_{base}") / n - (total / n) * (total / n), F.lit(0.0)))
            result[name] = var if kind == "var" else F.sqrt(var)
    rows = rows.withColumnRenamed("dst_port", "_dst_port")
    specs["dst_port"] = ("first", to_int(F.col("_dst_port")))
    rows = ordered.carry(ordered.split_hot(rows, keys, order, chunk_rows), keys, order, **origins)
    rows = ordered.carry(rows, keys, order, **specs)
    return rows.withColumns({
        **result,
        "protocol": protocol_number(F.col("protocol")),
        "flow_duration": F.greatest(F.col("ts_us") - F.col("session_us"), F.lit(1)),
    })


def flow_features(
    packets: DataFrame, timeout_s=120.0, idle_s=1.0, min_bulk=4, running=False, chunk_rows=ordered.CHUNK_ROWS
):
    """The 78 features per flow session or, with ``running``, after each packet of it."""
    rows = sessionize(packets, timeout_s, idle_s, min_bulk, chunk_rows)
    out = _so_far(rows, chunk_rows) if running else _per_session(rows)

    def side(name, first):
        a, b = (F.col(name.format(i)) for i in ((0, 1) if first else (1, 0)))
        return F.when(F.col("_first") == 0, a).otherwise(b)

    secs = F.col("flow_duration") / SECOND

    def count(col):
        return F.coalesce(col, F.lit(0))

    def ratio(top, bottom):
        return F.when(bottom > 0, top / bottom)

    named = {"dst_port": F.col("dst_port"), "protocol": F.col("protocol"), "flow_duration": F.col("flow_duration")}
    for name, first in (("fwd", True), ("bwd", False)):
        def of(col, first=first):
            return side(col + "{}", first)

        named[f"tot_{name}_pkts"] = of("_pkts")
        named[f"totlen_{name}_pkts"] = of("_bytes")
        for kind in ("max", "min", "mean", "std"):
            named[f"{name}_pkt_len_{kind}"] = side("_len{}_" + kind, first)
        named[f"{name}_iat_tot"] = side("_iat{}_sum", first)
        for kind in ("mean", "std", "max", "min"):
            named[f"{name}_iat_{kind}"] = side("_iat{}_" + kind, first)
        named[f"{name}_psh_flags"] = of("_psh")
        named[f"{name}_urg_flags"] = of("_urg")
        named[f"{name}_header_len"] = of("_head")
        named[f"{name}_pkts_s"] = of("_pkts") / secs
        named[f"{name}_seg_size_avg"] = side("_len{}_mean", first)
        named[f"{name}_byts_b_avg"] = ratio(of("_bulk_bytes"), of("_bulk_runs"))
        named[f"{name}_pkts_b_avg"] = ratio(of("_bulk_pkts"), of("_bulk_runs"))
        named[f"{name}_blk_rate_avg"] = ratio(of("_bulk_bytes"), of("_bulk_us") / SECOND)
        named[f"subflow_{name}_pkts"] = of("_pkts")
        named[f"subflow_{name}_byts"] = of("_bytes")
        named[f"init_{name}_win_byts"] = of("_win")
    fwd, bwd = count(side("_pkts{}", True)), count(side("_pkts{}", False))
    named["fwd_act_data_pkts"] = side("_act{}", True)
    named["fwd_seg_size_min"] = side("_len{}_min", True)
    named["flow_byts_s"] = (count(F.col("_bytes0")) + count(F.col("_bytes1"))) / secs
    named["flow_pkts_s"] = (fwd + bwd) / secs
    named["down_up_ratio"] = ratio(bwd, fwd)
    named["pkt_size_avg"] = F.col("pkt_len_mean")
    for base, kinds in (("pkt_len", "min max mean std var"), ("flow_iat", "mean std max min"),
                        ("active", "mean std max min"), ("idle", "mean std max min")):
        for kind in kinds.split():
            named[f"{base}_{kind}"] = F.col(f"{base}_{kind}")
    for name in LETTERS:
        named[name] = F.col(name)
    ids = ["flow", "session_us", *(["packet_id"] if running else [])]
    whole = ("dst_port", "protocol", "flow_duration")
    return out.select(*ids, *[
        F.coalesce(c.cast("long" if n in whole else "double"), F.lit(0)).alias(n) for n, c in named.items()
    ])


def packet_features(packets: DataFrame, window_s=1.0, chunk_rows=ordered.CHUNK_ROWS):
    """17 features per packet over the packets of its flow in the last ``window_s``."""
    span = int(window_s * SECOND)
    rows = with_flow_key(packets)
    rows = rows.withColumn("_all", F.col("size").cast("long"))
    flags = F.coalesce("flags", F.lit(""))
    aggs = {"_n": ("count", "_all"), "_bytes": ("sum", "_all"), "_from": ("min", "ts_us")}
    for ch in "PUFSRA":
        rows = rows.withColumn(f"_is{ch}", F.contains(flags, F.lit(ch)).cast("long"))
        aggs[f"_cnt{ch}"] = ("sum", f"_is{ch}")
    for s in SIDES:
        mine = F.col("side") == s
        rows = (
            rows.withColumn(f"_size{s}", F.when(mine, F.col("_all")))
            .withColumn(f"_sq{s}", F.when(mine, F.col("_all") * F.col("_all")))
            .withColumn(f"_head{s}", F.when(mine, F.col("header_len").cast("long")))
            .withColumn(f"_at{s}", F.when(mine, F.col("ts_us")))
        )
        aggs |= {
            f"n{s}": ("count", f"_size{s}"), f"sum{s}": ("sum", f"_size{s}"), f"sq{s}": ("sum", f"_sq{s}"),
            f"min{s}": ("min", f"_size{s}"), f"max{s}": ("max", f"_size{s}"), f"head{s}": ("sum", f"_head{s}"),
            f"t0{s}": ("min", f"_at{s}"), f"t1{s}": ("max", f"_at{s}"),
        }
    order = ["ts_us", "packet_id"]
    rows = ordered.split_hot(rows, ["flow"], order, chunk_rows)
    hot = "_chunk" in rows.columns
    rows = ordered.carry(rows, ["flow"], order, _first=("first", "side")).drop("_chunk")
    rows = ordered.rolling_range(rows, ["flow"], "ts_us", span, "packet_id", chunk_rows=chunk_rows, hot=hot, **aggs)

    def fwd(name):
        return F.when(F.col("_first") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    n, total = fwd("n"), fwd("sum").cast("double")
    other = F.when(F.col("_first") == 0, F.col("n1")).otherwise(F.col("n0"))
    # the products overflow a bigint from some million packets on
    exact = [fwd(name).cast("decimal(19,0)") for name in ("n", "sq", "sum")]
    spread = exact[0] * exact[1] - exact[2] * exact[2]

    def seconds(us):
        return F.greatest(us, F.lit(1)) / SECOND

    named = {
        "Dst Port": to_int(F.col("dst_port")),
        "Protocol": protocol_number(F.col("protocol")),
        "TotLen Fwd Pkts": total,
        "Fwd Pkt Len Max": fwd("max"),
        "Fwd Pkt Len Mean": F.when(n > 0, total / n),
        "Flow Byts/s": F.col("_bytes") / seconds(F.col("ts_us") - F.col("_from")),
        "PSH Flag Cnt": F.col("_cntP"),
        "URG Flag Cnt": F.col("_cntU"),
        "FIN Flag Cnt": F.col("_cntF"),
        "SYN Flag Cnt": F.col("_cntS"),
        "RST Flag Cnt": F.col("_cntR"),
        "ACK Flag Cnt": F.col("_cntA"),
        "Fwd Header Len": fwd("head"),
        "Fwd Pkt Len Min": fwd("min"),
        "Fwd Pkt Len Std": F.when(n > 0, F.sqrt(spread.cast("double")) / n),
        "Down/Up Ratio": F.when(n > 0, other / n),
        "Fwd Pkts/s": F.when(n > 1, n / seconds(fwd("t1") - fwd("t0"))),
    }
    return rows.select(
        "packet_id", "ts_us", "flow",
        *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(name) for name, c in named.items()],
    )
