"""Threshold policy: vote blocks, and the tabular learning run over them."""

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from threatflow.functions import values as V
from threatflow.plans import ordered


def policy_blocks(votes: DataFrame, key, order, vote="is_tp", interval=50, chunk_rows=ordered.CHUNK_ROWS):
    """One row per full block of votes: rates so far, their bins and the reward.

    Counting is split by hot keys; from here on the data is ``interval`` times smaller.
    """
    return more_blocks(votes, key, order, None, vote, interval, chunk_rows)[0]


def more_blocks(votes: DataFrame, key, order, counts, vote="is_tp", interval=50, chunk_rows=ordered.CHUNK_ROWS):
    """Full blocks after those that ``counts`` (key, blocks, total, hits) tells of; left votes; counts after them."""
    rows = ordered.number_rows(votes.select(key, *order, vote), [key], order, "_rn", chunk_rows)
    rows = rows.withColumn("block", F.floor((F.col("_rn") - 1) / interval) + 1)
    blocks = rows.groupBy(key, "block").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(vote).cast("long")).alias("_tp"))
    full = blocks.where(F.col("_n") == interval)
    rest = rows.join(blocks.where(F.col("_n") < interval), [key, "block"], "left_semi").select(key, *order, vote)
    full = ordered.split_hot(full, [key], "block", chunk_rows)
    full = ordered.carry(full, [key], ["block"], _total=("sum", "_n"), _hits=("sum", "_tp"))
    if counts is not None:
        full = full.join(counts, key, "left").withColumns({
            "block": F.col("block") + F.coalesce("blocks", F.lit(0)),
            "_total": F.col("_total") + F.coalesce("total", F.lit(0)),
            "_hits": F.col("_hits") + F.coalesce("hits", F.lit(0)),
        }).drop("blocks", "total", "hits")
    after = full.groupBy(key).agg(F.max("block").alias("blocks"), F.max("_total").alias("total"), F.max("_hits").alias("hits"))
    if counts is not None:
        after = after.unionByName(counts.join(after, key, "left_anti"))
    attack = F.col("_hits") / F.col("_total")
    false = (F.col("_total") - F.col("_hits")) / F.col("_total")

    def bin5(rate):
        return F.least(F.lit(4), F.floor(rate * 5)).cast("int")

    out = full.select(
        key, "block", attack.alias("attack_rate"), false.alias("fp_rate"),
        bin5(attack).alias("attack_bin"), bin5(false).alias("fp_bin"),
        (attack - false * false).alias("reward"),
    )
    return out, rest, after


def _fold_partitions(df, groups, order, step, extra):
    """Run ``step(state, row) -> (state, values)`` over rows in order, group by group.

    Rows stream through in Arrow batches; only the state of one group is in memory.
    """
    schema = T.StructType([*df.schema.fields, *extra])
    names = [f.name for f in extra]
    kinds = {f.name: to_arrow_type(f.dataType) for f in extra}

    def run(batches):
        current, state = object(), None
        for batch in batches:
            out = {n: [] for n in names}
            for row in batch.to_pylist():
                group = tuple(row[g] for g in groups)
                if group != current:
                    current, state = group, None
                state, values = step(state, row)
                for n, v in zip(names, values):
                    out[n].append(v)
            arrays = [*batch.columns, *[pa.array(out[n], kinds[n]) for n in names]]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    placed = df.repartition(*groups).sortWithinPartitions(*groups, *order)
    return placed.mapInArrow(run, schema)


def learn_step(q, reward, alpha=0.3, gamma=0.85):
    """One greedy step on the values of a state: (new values, index of the action)."""
    q = list(q) if q else [0.0] * len(V.POLICY_ACTIONS)
    best = max(q)
    a = q.index(best)
    # acting does not change the rates, so the next state is the same state
    q[a] += alpha * (reward + gamma * best - q[a])
    return q, a


def move_threshold(threshold, action, step=0.02, low=0.3, high=0.99):
    if action == "increase_sensitivity":
        return max(low, threshold - step)
    if action == "decrease_sensitivity":
        return min(high, threshold + step)
    return threshold


#: Blocks whose moves of the threshold one task makes.
RUN_BLOCKS = 10_000
#: Beyond all thresholds.
FAR = 1e9


def _entries(acted, key, step, low, high):
    """For each run of RUN_BLOCKS blocks of a key the threshold it begins with, from the moves of the runs before it.

    A move adds something and stops at a border; any moves one after another do so too, with other numbers
    (``add``, ``least``, ``most``). So each run is one such move, and only these are chained.
    """
    def stop(least, most, x):
        return F.least(most, F.greatest(least, x))

    up, down = F.col("action") == "decrease_sensitivity", F.col("action") == "increase_sensitivity"
    one = F.struct(
        "block",
        F.when(up, step).when(down, -step).otherwise(0.0).alias("add"),
        F.when(down, low).otherwise(-FAR).alias("least"),
        F.when(up, high).otherwise(FAR).alias("most"),
    )

    def after(first, second):
        def moved(x):
            return stop(second["least"], second["most"], x + second["add"])

        return F.struct(
            (first["add"] + second["add"]).alias("add"), moved(first["least"]).alias("least"), moved(first["most"]).alias("most")
        )

    still = F.struct(F.lit(0.0).alias("add"), F.lit(-FAR).alias("least"), F.lit(FAR).alias("most"))
    runs = acted.groupBy(key, "_run", "_from").agg(F.array_sort(F.collect_list(one)).alias("_moves"))
    runs = runs.select(key, "_run", "_from", F.aggregate("_moves", still, after).alias("_move"))
    before = Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.collect_list("_move").over(before)
    return runs.select(key, "_run", F.aggregate(
        earlier, F.col("_from"), lambda x, m: stop(m["least"], m["most"], x + m["add"])
    ).alias("_enters"))


def policy_run(
    blocks: DataFrame, key, start=0.5, alpha=0.3, gamma=0.85, step=0.02, low=0.3, high=0.99, values=None, thresholds=None
):
    """Action, values and threshold after each block, without random exploration.

    The values of a state depend only on the visits to that state, so states of a key learn side by side; the visits
    of one state are sequential by definition, on one row per ``interval`` votes, streamed through constant
    memory. The threshold then follows the actions in block order, in runs of blocks at once (see ``_entries``).
    ``values`` (key, bins, q) and ``thresholds`` (key, threshold) say what was learnt before; column ``q`` is what
    has been learnt of the state by now.
    """
    at = [key, "attack_bin", "fp_bin"]
    if values is None:
        rows = blocks.withColumn("_q", F.lit(None).cast("array<double>"))
    else:
        rows = blocks.join(values.select(*at, F.col("q").alias("_q")), at, "left")

    def learn(q, row):
        q, a = learn_step(row["_q"] if q is None else q, row["reward"], alpha, gamma)
        return q, (V.POLICY_ACTIONS[a], q[a], list(q))

    acted = _fold_partitions(
        rows, at, ["block"], learn,
        [T.StructField("action", T.StringType()), T.StructField("q_value", T.DoubleType()), T.StructField("q", T.ArrayType(T.DoubleType()))],
    ).drop("_q")
    if thresholds is None:
        acted = acted.withColumn("_from", F.lit(float(start)))
    else:
        acted = acted.join(thresholds.select(key, F.col("threshold").alias("_from")), key, "left")
        acted = acted.withColumn("_from", F.coalesce("_from", F.lit(float(start))))

    acted = acted.withColumn("_run", F.floor((F.col("block") - 1) / RUN_BLOCKS))
    acted = acted.drop("_from").join(_entries(acted, key, step, low, high), [key, "_run"])

    def move(threshold, row):
        old = row["_enters"] if threshold is None else threshold
        new = move_threshold(old, row["action"], step, low, high)
        return new, (old, new)

    return _fold_partitions(
        acted, [key, "_run"], ["block"], move,
        [T.StructField("old_threshold", T.DoubleType()), T.StructField("new_threshold", T.DoubleType())],
    ).drop("_run", "_enters")
