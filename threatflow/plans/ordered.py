"""Ordered work over keys that may be hot.

A plain ``Window.partitionBy(key)`` puts all rows of a key into one task, so a
source that sends a third of the traffic would hold up the whole job.  The
helpers here cut hot keys into chunks of about equal row counts, run the window per (key, chunk), and
carry what a chunk needs to know about the earlier ones through a small summary
table with one row per hot chunk.  Results equal those of the plain window.

* ``split_hot``      marks hot keys and gives their rows a chunk number
* ``carry``          lag / last value / running sum / running max
* ``number_rows``    row_number per key
* ``mark_first``     the first rows per key in the order of a hash, without putting all in order
* ``rolling_range``  aggregates over [t - span, t], linear in the rows
* ``keep_spaced``    greedy suppression: keep a row, drop followers within ``gap``
* ``quantiles``      exact interpolated quantiles without one big buffer
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from threatflow.plans.session import written
from threatflow.plans.sizes import broadcast_if_small

# A key with more rows than this is cut into chunks of about this many rows.
CHUNK_ROWS = 1_000_000
# Sampled rows per chunk: chunk sizes vary by about an eighth.
SAMPLED = 64
COLD = -1
FIGURES = {"sum": F.sum, "max": F.max, "min": F.min}
# Rows whose values ``newest`` carries.
NEWEST = 20
# Upper bits of a hash that ``mark_first`` counts rows by.
RANGE_BITS = 12



def split_hot(df: DataFrame, keys, order, chunk_rows=CHUNK_ROWS):
    """Add ``_chunk``: -1 on rows of cold keys, else a number rising in the order of ``order``.

    One job over the key and order columns samples ``SAMPLED`` rows per chunk and brings back, for
    keys with over ``chunk_rows`` rows, the places that cut them into chunks of about that many rows:
    about one place per ``chunk_rows`` rows of the table, a bound that allows the broadcast. ``order`` is
    one column or several; with a tie-breaker among them even rows of one instant are split.
    Where no key is hot the column is left out, and the helpers below run as plain windows.
    Keys and order columns must not be NULL.
    """
    order = [order] if isinstance(order, str) else list(order)
    rate = min(1.0, SAMPLED / chunk_rows)
    step = max(1, round(chunk_rows * rate))
    in_key = Window.partitionBy(*keys)
    picked = df.select(*keys, F.struct(*order).alias("_place"))
    if rate < 1:
        picked = picked.where(F.rand(17) < rate)
    ranked = picked.withColumn("_n", F.count(F.lit(1)).over(in_key)).where(F.col("_n") > step)
    ranked = ranked.withColumn("_rn", F.row_number().over(in_key.orderBy("_place")))
    found = ranked.where((F.col("_rn") > 1) & (F.col("_rn") % step == 1 % step)).select(*keys, "_place").collect()
    if not found:
        return df
    borders = {}
    for row in found:
        borders.setdefault(tuple(row[:-1]), []).append(row[-1])
    rows = []
    for key, places in borders.items():
        places.sort()
        stride = math.isqrt(len(places) - 1) + 1
        rows.append((*key, stride, places[::stride], places))
    places = T.ArrayType(picked.schema["_place"].dataType)
    hot = df.sparkSession.createDataFrame(
        rows,
        T.StructType(
            [
                *[picked.schema[k] for k in keys],
                T.StructField("_stride", T.IntegerType()),
                T.StructField("_coarse", places),
                T.StructField("_places", places),
            ]
        ),
    )
    here = F.struct(*order)
    block = F.size(F.filter("_coarse", lambda p: p <= here))
    near = F.slice("_places", (block - 1) * F.col("_stride") + 1, F.col("_stride"))
    chunk = (
        F.when(F.col("_stride").isNull(), F.lit(COLD))
        .when(block == 0, F.lit(0))
        .otherwise((block - 1) * F.col("_stride") + F.size(F.filter(near, lambda p: p <= here)))
        .cast("long")
    )
    return (
        df.join(F.broadcast(hot), list(keys), "left")
        .withColumn("_chunk", chunk)
        .drop("_stride", "_coarse", "_places")
    )


def parts(df, keys):
    """Columns that tell apart the groups a window or a pandas pass runs in."""
    return [*keys, "_chunk"] if "_chunk" in df.columns else list(keys)


def carry(df: DataFrame, keys, order, **specs):
    """Running values per key over rows already seen by ``split_hot``.

    Each spec is ``name=(kind, column)`` with kind one of

    * ``lag``   value of the row before
    * ``last``  last non-NULL value up to and with this row
    * ``prior`` last non-NULL value before this row
    * ``first`` first non-NULL value up to and with this row
    * ``sum`` / ``max`` / ``min``  running figure with this row
    * ``union`` the different elements of an array column so far, sorted
    * ``newest`` values of the last NEWEST rows with this one, oldest first
    """
    split = "_chunk" in df.columns
    inner = Window.partitionBy(*parts(df, keys)).orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    position = F.struct(*order)
    local, summary = {}, []
    for name, (kind, col) in specs.items():
        col = F.col(col) if isinstance(col, str) else col
        if kind == "lag":
            # a struct is never NULL, so a NULL value still counts as a row
            value = F.struct(col.alias("v"))
            local[name] = F.last(value, True).over(before)
            summary.append(F.max_by(value, position).alias(f"_s_{name}"))
        elif kind in ("last", "prior"):
            local[name] = F.last(col, True).over(upto if kind == "last" else before)
            summary.append(F.max_by(col, F.when(col.isNotNull(), position)).alias(f"_s_{name}"))
        elif kind == "union":
            local[name] = F.flatten(F.collect_set(col).over(upto))
            summary.append(F.array_distinct(F.flatten(F.collect_set(col))).alias(f"_s_{name}"))
        elif kind == "newest":
            local[name] = F.collect_list(F.struct(col.alias("v"))).over(inner.rowsBetween(1 - NEWEST, 0))
            # the last row of a chunk has what the next chunk needs
            summary.append(F.max_by(F.col(f"_l_{name}"), position).alias(f"_s_{name}"))
        elif kind == "first":
            local[name] = F.first(col, True).over(upto)
            summary.append(F.min_by(col, F.when(col.isNotNull(), position)).alias(f"_s_{name}"))
        else:
            whole = FIGURES[kind]
            local[name] = whole(col).over(upto)
            summary.append(whole(col).alias(f"_s_{name}"))
    out = df.select("*", *[c.alias(f"_l_{n}") for n, c in local.items()])

    if split:
        # One row per chunk of a hot key; cold keys have no summary at all.
        source = out if any(kind == "newest" for kind, _ in specs.values()) else df
        chunks = source.where(F.col("_chunk") >= 0).groupBy(*keys, "_chunk").agg(*summary)
        earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        recent = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(-NEWEST, -1)
        fold = {**FIGURES, "first": lambda c: F.first(c, True)}

        def entered_with(name, kind):
            col = F.col(f"_s_{name}")
            if kind == "union":
                return F.flatten(F.collect_list(col).over(earlier))
            if kind == "newest":
                # a chunk has a row at least, so no more chunks are needed than rows
                return F.flatten(F.collect_list(col).over(recent))
            return fold.get(kind, lambda c: F.last(c, True))(col).over(earlier)

        entry = [entered_with(name, kind).alias(f"_e_{name}") for name, (kind, _) in specs.items()]
        # the windows came first, so the join finds its rows partitioned already
        out = out.join(chunks.select(*keys, "_chunk", *entry), [*keys, "_chunk"], "left")

    values = []
    for name, (kind, _) in specs.items():
        value = F.col(f"_l_{name}")
        if split:
            entered = F.col(f"_e_{name}")
            if kind == "sum":
                value = F.coalesce(value + F.coalesce(entered, F.lit(0)), entered)
            elif kind in ("max", "min"):
                value = (F.greatest if kind == "max" else F.least)(value, entered)
            elif kind == "first":
                value = F.coalesce(entered, value)
            elif kind in ("union", "newest"):
                value = F.coalesce(F.concat(entered, value), value)
            else:
                value = F.coalesce(value, entered)
        if kind == "lag":
            value = value["v"]
        elif kind == "union":
            value = F.array_sort(F.array_distinct(value))
        elif kind == "newest":
            value = F.slice(value, F.greatest(F.size(value) - NEWEST, F.lit(0)) + 1, NEWEST)["v"]
        values.append(value.alias(name))
    return out.select(*[F.col(c) for c in df.columns], *values)


def number_rows(df: DataFrame, keys, order, out="rn", chunk_rows=CHUNK_ROWS):
    """``row_number()`` per key."""
    return numbered(df, keys, order, out, chunk_rows)[0]


def numbered(df: DataFrame, keys, order, out="rn", chunk_rows=CHUNK_ROWS):
    """``row_number()`` per key, and whether a key is hot."""
    rows = split_hot(df, keys, order, chunk_rows).withColumn("_one", F.lit(1).cast("long"))
    return carry(rows, keys, order, **{out: ("sum", "_one")}).drop("_one", "_chunk"), "_chunk" in rows.columns


def mark_first(df: DataFrame, keys, at, tie, takes: DataFrame, out="first", chunk_rows=CHUNK_ROWS):
    """Whether a row is among the first ``_take`` of its key by ``at`` (a 64-bit hash) and ``tie``.

    ``takes`` has the keys and ``_take``; rows of other keys are left out. Rows are counted by ranges of the hash, and only
    those of the range in which the last row taken lies are put in order: of an even hash one row in 4,096.
    """
    here = F.shiftright(at, 64 - RANGE_BITS)
    counts = df.groupBy(*keys, here.alias("_range")).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("_before", F.sum("_c").over(upto) - F.col("_c")).join(broadcast_if_small(takes), list(keys))
    used = F.col("_before") < F.col("_take")
    ends = written(counts.groupBy(*keys).agg(
        F.max(F.when(used, F.col("_range"))).alias("_last"),
        (F.max("_take") - F.max(F.when(used, F.col("_before")))).alias("_need"),
        F.max_by("_c", F.when(used, F.col("_range"))).alias("_size"),
    ))
    rows = df.join(broadcast_if_small(ends), list(keys))
    settled = rows.where(F.col("_last").isNull() | (here != F.col("_last")))
    settled = settled.select(*df.columns, F.coalesce(here < F.col("_last"), F.lit(False)).alias(out))
    last = rows.where(here == F.col("_last"))
    if (ends.agg(F.max("_size")).first()[0] or 0) > chunk_rows:
        last = split_hot(last, keys, [at, tie], chunk_rows)
    last = carry(last.withColumn("_one", F.lit(1).cast("long")), keys, [at, tie], _rn=("sum", "_one"))
    return settled.unionByName(last.select(*df.columns, (F.col("_rn") <= F.col("_need")).alias(out)))


def rolling_range(df: DataFrame, keys, at, span, tie, closed=True, chunk_rows=CHUNK_ROWS, hot=True, **aggs):
    """Aggregates over the rows with ``at`` in [t - span, t] up to the current row.

    Time is cut into blocks as long as the window, so a window is the end of the
    block before plus the start of its own block.  Every row is sent to its own
    block and, moved on by ``span``, to the next one.  There one growing window
    runs backwards over the moved rows and one forwards over the own rows.  So the
    cost does not depend on how many rows a window holds. A hot key spreads over its
    blocks, and a block of too many rows, even of one instant, is cut into chunks of rows: each chunk then
    gets the figures of the own rows before it and of the moved rows after it.

    ``aggs`` are ``name=(kind, column)`` with kind sum, min, max, count or set.
    With ``closed=False`` rows exactly ``span`` old are left out. ``hot=False`` says that no key
    is hot (see ``split_hot``), which saves the search for hot blocks.
    """
    block = F.floor(F.col(at) / F.lit(span)).cast("long")
    used = {c for _, c in aggs.values() if c is not None} | {*keys, at, tie}
    rows = df.withColumn("_moved", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = rows.select(
        *[
            F.col(c) if c in used else F.when(F.col("_moved") == 0, F.col(c)).alias(c)
            for c in df.columns
        ],
        "_moved",
        (block + F.col("_moved")).alias("_block"),
        (F.col(at) + F.col("_moved") * F.lit(span)).alias("_at"),
    )
    # at one instant, moved rows come after the own ones if they count for these, else before
    rows = rows.withColumn("_side", F.col("_moved") if closed else 1 - F.col("_moved"))
    group, order = [*keys, "_block"], ["_at", "_side", tie]
    if hot:
        rows = split_hot(rows, group, order, chunk_rows)
    within = Window.partitionBy(*parts(rows, group))
    back = within.orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    ahead = within.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    kinds = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.sum, "set": F.collect_set}

    def part(kind, col, moved):
        value = F.lit(1).cast("long") if kind == "count" and col is None else F.col(col)
        if kind == "count" and col is not None:
            value = F.when(value.isNotNull(), F.lit(1).cast("long"))
        return kinds[kind](F.when(F.col("_moved") == moved, value))

    def both(kind, x, y):
        if kind in ("sum", "count"):
            return F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))
        if kind == "set":
            return F.array_sort(F.array_union(F.coalesce(x, y), F.coalesce(y, x)))
        return (F.least if kind == "min" else F.greatest)(x, y)

    plain = rows
    rows = rows.select("*", *[part(k, c, 1).over(back).alias(f"_b_{n}") for n, (k, c) in aggs.items()])
    rows = rows.select("*", *[part(k, c, 0).over(ahead).alias(f"_a_{n}") for n, (k, c) in aggs.items()])
    if "_chunk" in plain.columns:
        # one row per chunk of a hot block
        whole = plain.where(F.col("_chunk") >= 0).groupBy(*group, "_chunk").agg(*[
            part(k, c, m).alias(f"_{m}_{n}") for n, (k, c) in aggs.items() for m in (0, 1)
        ])
        past = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        later = Window.partitionBy(*group).orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)

        def gathered(kind, col, frame):
            if kind == "set":
                return F.array_distinct(F.flatten(F.collect_list(col).over(frame)))
            return kinds[kind](F.col(col)).over(frame)

        entry = whole.select(
            *group, "_chunk", *[gathered(k, f"_0_{n}", past).alias(f"_ea_{n}") for n, (k, _) in aggs.items()],
            *[gathered(k, f"_1_{n}", later).alias(f"_eb_{n}") for n, (k, _) in aggs.items()],
        )
        rows = rows.join(entry, [*group, "_chunk"], "left")
        for name, (kind, _) in aggs.items():
            for s in "ab":
                rows = rows.withColumn(f"_{s}_{name}", both(kind, F.col(f"_{s}_{name}"), F.col(f"_e{s}_{name}")))
    rows = rows.where(F.col("_moved") == 0)
    return rows.select(*df.columns, *[
        both(kind, F.col(f"_b_{name}"), F.col(f"_a_{name}")).alias(name) for name, (kind, _) in aggs.items()
    ])


def halo_blocks(df: DataFrame, number, back, block_rows):
    """Cut numbered rows into blocks, each also holding the ``back`` rows before it.

    Adds ``_in``, the block to run a window in, and ``_own``, true on the one copy of
    a row that counts.  ``number`` is contiguous per key.
    """
    width = max(block_rows, back + 1)
    block = F.floor(F.col(number) / width).cast("long")
    late = F.col(number) % width >= width - back
    return (
        df.withColumn("_at_home", block)
        .withColumn(
            "_in",
            F.explode(
                F.when(late, F.array("_at_home", F.col("_at_home") + 1)).otherwise(F.array("_at_home"))
            ),
        )
        .withColumn("_own", F.col("_in") == F.col("_at_home"))
        .drop("_at_home")
    )


# --------------------------------------------------------------- suppression


def _greedy(at, gap, last):
    """Positions a greedy pass keeps in sorted ``at``, entered with ``last`` kept.

    Each position leads to the next one a pass keeps. The path is followed by doubling: its first 1, 2, 4 and so on
    positions, and where as many steps lead.
    """
    n = len(at)
    first = 0 if last is None else int(np.searchsorted(at, last + gap))
    leads = np.append(np.searchsorted(at, at + gap), n)
    path = np.array([first])
    while path[-1] < n:
        path = np.concatenate([path, leads[path]])
        leads = leads[leads]
    return path[path < n]


def _exits(at, gap):
    """For each position: the last row kept by a greedy pass that begins there; all paths double their steps at once."""
    n = len(at)
    follow = np.searchsorted(at, at + gap)
    place = np.arange(n)
    leads = np.where(follow < n, follow, place)
    while True:
        further = leads[leads]
        if (further == leads).all():
            return at[leads]
        leads = further


def keep_spaced(df: DataFrame, keys, at, tie, gap, chunk_rows=CHUNK_ROWS):
    """Keep the first row of a key, drop what follows within ``gap``, and go on.

    Dropped rows do not extend the gap.  A row at least ``gap`` after the row
    before it is always kept, and rows within ``gap`` of such a row are always
    dropped; both are settled by window functions.  Only the rows of runs longer
    than ``gap`` need the ordered pass.  Chunks of hot keys first report where a
    pass leaves them for each place it can enter, these reports are chained per
    key, and then all chunks run at once.
    """
    cols = df.columns
    rows = carry(split_hot(df, keys, [at, tie], chunk_rows), keys, [at, tie], _prev=("lag", at))
    rows = rows.withColumn(
        "_start", F.when(F.col("_prev").isNull() | (F.col(at) - F.col("_prev") >= gap), F.col(at))
    )
    rows = carry(rows, keys, [at, tie], _run=("last", "_start"))
    settled = rows.where(F.col("_start").isNotNull()).select(*cols)
    open_rows = rows.where(F.col("_start").isNull() & (F.col(at) - F.col("_run") >= gap))
    group = parts(rows, keys)
    open_rows = open_rows.select(*dict.fromkeys([*cols, *group]))

    key_fields = [df.schema[k] for k in keys]
    report = T.StructType(
        [
            *key_fields,
            T.StructField("_chunk", T.LongType()),
            T.StructField("_upto", T.LongType()),
            T.StructField("_exit", T.LongType()),
        ]
    )

    def leave_chunk(pdf):
        pdf = pdf.sort_values([at, tie], kind="stable")
        t = pdf[at].to_numpy()
        # a pass enters before t[0] + gap, so it starts at that row at the latest
        reach = int(np.searchsorted(t, t[0] + gap)) + 1
        exits, upto = _exits(t, gap)[:reach], t[:reach]
        last = np.append(exits[1:] != exits[:-1], True)
        out = pd.DataFrame({"_upto": upto[last], "_exit": exits[last]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        out["_chunk"] = pdf["_chunk"].iloc[0]
        return out[[f.name for f in report]]

    entry = T.StructType(
        [*key_fields, T.StructField("_chunk", T.LongType()), T.StructField("_last", T.LongType())]
    )

    def chain(pdf):
        last, out = None, []
        for chunk, part in pdf.sort_values(["_chunk", "_upto"]).groupby("_chunk"):
            out.append((chunk, last))
            i = 0 if last is None else int(np.searchsorted(part["_upto"], last + gap))
            if i < len(part):
                last = int(part["_exit"].iloc[i])
        res = pd.DataFrame(out, columns=["_chunk", "_last"])
        res["_last"] = res["_last"].astype("Int64")
        for k in keys:
            res[k] = pdf[k].iloc[0]
        return res[[f.name for f in entry]]

    if "_chunk" in group:
        slim = open_rows.where(F.col("_chunk") >= 0).select(*group, at, tie)
        reports = slim.groupBy(*group).applyInPandas(leave_chunk, report)
        open_rows = open_rows.join(reports.groupBy(*keys).applyInPandas(chain, entry), group, "left")
    else:
        open_rows = open_rows.withColumn("_last", F.lit(None).cast("long"))

    def run_chunk(table):
        table = table.take(pc.sort_indices(table, [(at, "ascending"), (tie, "ascending")]))
        last = table.column("_last")[0].as_py()
        keep = _greedy(table.column(at).to_numpy(), gap, last)
        return table.select(cols).take(pa.array(keep, pa.int64()))

    kept = open_rows.groupBy(*group).applyInArrow(run_chunk, df.schema)
    return settled.unionByName(kept)


# ----------------------------------------------------------------- quantiles


def quantiles(df: DataFrame, keys, value, probs, chunk_rows=CHUNK_ROWS):
    """Exact linearly interpolated quantiles: one row per key, columns q0, q1, ...

    Equal values are counted first; a running count then finds the values on both
    sides of each position, so no task ever holds all values of a key.
    """
    whole = not keys
    if whole:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    rows = carry(split_hot(counts, keys, "_v", chunk_rows), keys, ["_v"], _cum=("sum", "_c"))
    if whole:
        rows = rows.withColumn("_n", counts.agg(F.sum("_c")).scalar())
    else:
        totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
        rows = rows.join(broadcast_if_small(totals), list(keys))

    def pick(offset):
        return F.max(
            F.when((offset >= F.col("_cum") - F.col("_c")) & (offset < F.col("_cum")), F.col("_v"))
        )

    aggs = []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("_n") - 1)
        aggs += [
            pick(F.floor(place)).alias(f"_lo{i}"),
            pick(F.ceil(place)).alias(f"_hi{i}"),
            F.max(place - F.floor(place)).alias(f"_w{i}"),
        ]
    out = rows.groupBy(*keys).agg(F.max("_n").alias("n"), *aggs)
    for i, _ in enumerate(probs):
        lo, hi, w = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_w{i}")
        out = out.withColumn(f"q{i}", (lo + (hi - lo) * w).cast("double"))
    out = out.drop(*[f"_{s}{i}" for s in ("lo", "hi", "w") for i in range(len(probs))])
    return out.drop("_all") if whole else out

