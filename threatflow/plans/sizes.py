"""Size checks before a plan depends on something being small or spread out."""

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, max_rows=BROADCAST_ROWS):
    """Mark ``df`` for broadcast if it has at most ``max_rows`` rows; else Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame):
    """Deal rows out to all cores where the input has fewer splits than there are cores.

    Meant for work that is heavy per row, on files with few large row groups.  A table
    with enough splits is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 4) if df.rdd.getNumPartitions() < cores else df
