"""Contiguous shards of about equal size, cut from global prefix sums."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from threatflow.llm.shared import listed
from threatflow.plans.ranges import borders, partitions, range_of, unused


def contiguous_shards(docs, size, shards=16, order="doc_id", ties=(), shard="shard", slot="slot"):
    """Add ``shard`` (0 to ``shards - 1``) and ``slot`` (0, 1, ... in each shard) to every row.

    Rows are taken in the order of the numeric column ``order``, then of ``ties``. Each row covers
    ``size`` units of a line through all rows and belongs to the shard that holds its middle, so
    shards are contiguous and end within half a row of equal targets. The line is laid out from
    the totals of ordered ranges: the driver sees one total per range and the rows counted
    at the cuts, a task sorts one range.

    Null sizes count as 0, null order values come first, equal rows may change places, an empty
    table gives no rows. Columns named like the results are replaced. Rows with one and the
    same order value stay in one range, so ``order`` should be a key.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in (shard.lower(), slot.lower()) and c not in (size, order)])
    bucket, start, number = (unused(docs, n) for n in ("_range", "_start", "_number"))
    units = F.coalesce(F.col(size).cast("bigint"), F.lit(0))
    cuts = borders(docs, order, 4 * partitions(docs))
    ranged = docs.withColumn(bucket, range_of(F.col(order), cuts))

    totals = {
        r[0]: (r.n, r.units)
        for r in ranged.groupBy(bucket).agg(F.count("*").alias("n"), F.sum(units).alias("units")).collect()
    }
    rows_before, units_before = [0], [0]
    for i in range(len(cuts) + 1):
        n, total = totals.get(i, (0, 0))
        rows_before.append(rows_before[-1] + n)
        units_before.append(units_before[-1] + total)
    whole = units_before[-1]

    in_order = Window.partitionBy(bucket).orderBy(F.col(order).asc_nulls_first(), *ties)
    running = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn(
        start, F.get(listed(units_before), F.col(bucket)) + F.sum(units).over(running) - units
    ).withColumn(number, F.get(listed(rows_before), F.col(bucket)) + F.row_number().over(in_order) - 1)
    middle = 2 * F.col(start) + units
    placed = placed.withColumn(
        shard,
        F.least(F.lit(shards - 1), F.call_function("div", middle * shards, F.lit(2 * whole))).cast("int")
        if whole
        else F.lit(0),
    )

    # rows before a shard: all rows of earlier ranges, and those the cut range gives to earlier shards
    cut_in = {}
    for s in range(1, shards):
        target = s * whole / shards
        cut_in[s] = next((i for i in range(len(cuts) + 1) if units_before[i] <= target < units_before[i + 1]), 0)
    counted = (
        placed.where(F.col(bucket).isin(sorted(set(cut_in.values())))).groupBy(bucket, shard).count().collect()
        if whole
        else []
    )
    first = [0] + [
        rows_before[b] + sum(r["count"] for r in counted if r[0] == b and r[1] < s) for s, b in cut_in.items()
    ]
    return placed.withColumn(slot, F.col(number) - F.get(listed(first), F.col(shard))).drop(bucket, start, number)


def write_shards(sharded, path, shard="shard", slot="slot"):
    """Write one folder per shard, rows in the order of their slots."""
    sharded.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
