"""Cut a table into ordered ranges of about equal row counts, without a one-task sort."""

import math

from pyspark.sql import functions as F


def unused(df, name):
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(df):
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def borders(df, column, ranges):
    """Values of a numeric column that cut its rows into about ``ranges`` parts.

    Each border is a value that occurs and begins a range. At most ``ranges - 1`` values
    reach the driver; equal values stay together, nulls belong before the first border.
    """
    if ranges < 2:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    row = df.agg(F.percentile_approx(F.col(column), shares, 20 * ranges).alias("cuts")).first()
    return sorted(set(row.cuts or []))


def range_of(value, cuts):
    """Number of the range a value falls in: how many borders are not above it.

    Looks into a coarse row of borders first, so a value meets about twice the square
    root of their number.
    """
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts) - 1) + 1
    every = F.array(*[F.lit(c) for c in cuts])
    coarse = F.array(*[F.lit(c) for c in cuts[::step]])
    block = F.size(F.filter(coarse, lambda c: c <= value))
    within = F.size(F.filter(F.slice(every, (block - 1) * step + 1, F.lit(step)), lambda c: c <= value))
    return F.when(value.isNull() | (block == 0), 0).otherwise((block - 1) * step + within)


def with_border_rows(df, column, ranges, number="_range", copy="_copy"):
    """Deal rows into ordered ranges, each closed by a copy of the row that follows it.

    Adds ``number``, the range, and ``copy``: 0 for the rows themselves, 1 for copies of the next
    range's first rows, 2 for copies of the very first rows, which close the last range. In the
    order of (copy, column) every row's successor is then in its own range. Nulls come first.
    """
    cuts = borders(df, column, ranges)
    value = F.col(column)
    low = df.agg(F.min(value).alias("least"), F.count_if(value.isNull()).alias("nulls")).first()
    first = value.isNull() if low.nulls else value == F.lit(low.least)
    at = range_of(value, cuts)
    begins = F.get(F.array(*[F.lit(c) for c in cuts]), at - 1) == value if cuts else F.lit(False)
    copies = F.array(
        F.struct(at.alias("n"), F.lit(0).alias("c")),
        F.when(begins, F.struct((at - 1).alias("n"), F.lit(1).alias("c"))),
        F.when(first, F.struct(F.lit(len(cuts)).alias("n"), F.lit(2).alias("c"))),
    )
    dealt = df.withColumn(number, F.explode(F.filter(copies, lambda c: c.isNotNull())))
    return dealt.withColumn(copy, F.col(f"{number}.c")).withColumn(number, F.col(f"{number}.n"))
