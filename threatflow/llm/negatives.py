"""Hard negatives: rows of another label that score nearly as high as a positive, found through segment summaries."""

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from threatflow.llm.graph import matrix
from threatflow.llm.shared import groups, stored

#: Least number of blocks, rows a block holds at most (on average), and anchors that meet a block in one task.
BLOCKS, BLOCK_ROWS, ANCHORS = 16, 100_000, 200_000
#: Parts that a segment is cut into at the next level, and components below which it is not cut.
FAN, LEAST = 4, 4
#: What bounds may be off by, as a share of what they bound.
SLACK = 1e-9
LONG = (-(1 << 63), (1 << 63) - 1)


class Summaries:
    """Vectors with the sum and the deviation of each of their segments, level by level from the whole vector on."""

    def __init__(self, vectors):
        self.vectors, self.levels = vectors, []
        width = vectors.shape[1]
        length = width
        # squares of greater components would leave the range of doubles: these vectors are scored exactly
        while np.abs(vectors).max(initial=0) < 1e140:
            starts = np.arange(0, width, length)
            sizes = np.diff(np.append(starts, width)).astype(float)
            sums = np.add.reduceat(vectors, starts, axis=1)
            squares = np.add.reduceat(vectors * vectors, starts, axis=1)
            # the deviation is rounded up, so that bounds stay bounds
            spread = np.sqrt(np.maximum(squares - sums * sums / sizes, 0) + SLACK * squares)
            self.levels.append((sums / np.sqrt(sizes), spread))
            if length <= LEAST:
                break
            length = max(LEAST, -(-length // FAN))

    def bounds(self, level, one, rows):
        """Least and greatest that the product of a vector (its summary ``one``) with some rows can be."""
        means, spreads = self.levels[level]
        mean, spread = one[level]
        if rows is not None:
            means, spreads = means[rows], spreads[rows]
        middle, reach = means @ mean, spreads @ spread
        reach = reach + SLACK * (np.abs(means) @ np.abs(mean) + reach)
        return middle - reach, middle + reach

    def of(self, i):
        return [(m[i], s[i]) for m, s in self.levels]

    def products(self, vector, rows):
        """Exact whole-number products; beyond 64 bits they stop at the greatest or least number."""
        some = self.vectors if rows is None else self.vectors[rows]
        if not len(some):
            return np.zeros(0, np.int64)
        most = np.abs(some).max() * np.abs(vector).max() * len(vector)
        if most < 2.0**53:
            return (some @ vector).astype(np.int64)
        one = [int(x) for x in vector]
        exact = (sum(int(x) * y for x, y in zip(row, one)) for row in some)
        return np.array([min(max(x, LONG[0]), LONG[1]) for x in exact], dtype=np.int64)


def _best(scores, ids, k):
    """Places of the k highest scores, ties to the lesser id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _kth(values, k):
    """The kth greatest value, or minus infinity if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def positives_of(block, anchor, vector, allowed, k):
    """Rows and scores of the ``k`` best of the allowed rows of a block.

    From level to level the kth greatest least bound drops all rows that can't come up to it.
    """
    rows = np.flatnonzero(allowed)
    for level in range(min(len(block.levels), len(anchor))):
        if len(rows) <= k:
            break
        low, high = block.bounds(level, anchor, rows)
        rows = rows[high >= _kth(low, k)]
    return rows, block.products(vector, rows)


def negatives_of(block, anchor, vector, allowed, scores, percent, k):
    """Rows and scores of those allowed rows that can be among the ``k`` best for one of the positive scores.

    A row counts for a positive score p if percent * p <= 100 * score <= 100 * p.
    """
    rows = np.flatnonzero(allowed)
    least, most = np.array([percent * p / 100 for p in scores]), np.array([float(p) for p in scores])
    least, most = least - SLACK * np.abs(least), most + SLACK * np.abs(most)
    for level in range(min(len(block.levels), len(anchor))):
        if not len(rows):
            break
        low, high = block.bounds(level, anchor, rows)
        keep = np.zeros(len(rows), bool)
        for p, (a, b) in enumerate(zip(least, most)):
            inside = (low >= percent * scores[p] / 100) & (high <= scores[p])
            keep |= (low <= b) & (high >= max(a, _kth(low[inside], k)))
        rows = rows[keep]
    return rows, block.products(vector, rows)


def _met(k, percent):
    """Per task a block's rows meet anchors: without scores these seek positives, with them negatives."""

    def run(batches):
        import pyarrow as pa

        for task in groups(batches, "task"):
            asks = task.column("ask").to_numpy(zero_copy_only=False).astype(bool)
            held, anchors = task.filter(pa.array(~asks)), task.filter(pa.array(asks))
            if not held.num_rows or not anchors.num_rows:
                continue
            ids, labels = held.column("id").to_numpy(), held.column("label").to_numpy()
            block = Summaries(matrix(held.column("vector")))
            asked = Summaries(matrix(anchors.column("vector")))
            names, marks = anchors.column("id").to_numpy(), anchors.column("mark").to_numpy()
            of_label = anchors.column("label").to_numpy()
            sought = anchors.column("positives").to_pylist()
            out = []
            for a in range(len(names)):
                vector, same = asked.vectors[a], (labels == of_label[a])
                if percent is None:
                    rows, scores = positives_of(block, asked.of(a), vector, same & (ids != names[a]), k)
                    best = _best(scores, ids[rows], k)
                    out += [(names[a], marks[a], None, int(ids[rows[b]]), None, int(scores[b])) for b in best]
                    continue
                wanted = [(p["id"], p["score"]) for p in sought[a]]
                values = sorted({s for _, s in wanted if percent * s <= 100 * s})
                if not values:
                    continue
                rows, scores = negatives_of(block, asked.of(a), vector, ~same, values, percent, k)
                for positive, p in wanted:
                    fits = np.flatnonzero(_within(scores, p, percent))
                    for b in fits[_best(scores[fits], ids[rows[fits]], k)]:
                        out.append((names[a], marks[a], positive, int(ids[rows[b]]), p, int(scores[b])))
                if len(out) > 50_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return run


def _within(scores, p, percent):
    """percent * p <= 100 * score <= 100 * p in whole numbers that can't overflow."""
    least = -(-percent * p // 100)
    return (scores >= max(least, LONG[0])) & (scores <= p)


_OUT = "anchor_id bigint, mark bigint, positive_id bigint, id bigint, positive_score bigint, score bigint"


def _batch(rows):
    import pyarrow as pa

    names = [c.split()[0] for c in _OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


def whole_numbers(vector, scale=256):
    """Components times ``scale``, rounded down."""
    return F.transform(vector, lambda x: _floor(x.cast("double") * scale))


def _floor(x):
    """Rounded down, also where a whole number of 64 bits would overflow (such doubles are whole)."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def usable(vector, label):
    """Whether label and vector are there and all components are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def _tasks(held, anchors, blocks, rounds):
    """Rows of all blocks and copies of the anchors for each block of their length, dealt to tasks."""
    parts = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    none = F.lit(None).cast("array<struct<id:bigint,score:bigint>>")
    mine = anchors.withColumn("part", parts).withColumn("round", F.pmod(F.xxhash64("id"), F.lit(rounds)).cast("int"))
    theirs = held.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    task, slot = F.concat_ws(":", "size", "part", "round").alias("task"), (F.col("part") * rounds + F.col("round")).alias("slot")
    if "positives" not in anchors.columns:
        mine = mine.withColumn("positives", none)
    columns = [task, slot, "id", "label", "vector"]
    both = mine.select(*columns, F.lit(True).alias("ask"), F.xxhash64("label", "vector").alias("mark"), "positives").unionByName(
        theirs.select(*columns, F.lit(False).alias("ask"), F.lit(0).cast("bigint").alias("mark"), none.alias("positives"))
    )
    return both.repartitionById(blocks * rounds, "slot").sortWithinPartitions("task")


def hard_negatives(rows, anchors, vector="vector", label="label", key="vec_id", positives=5, negatives=5, percent=80, blocks=None):
    """For each anchor and positive the hardest negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vector`` holds whole numbers as doubles (see ``whole_numbers``); a row's score is its inner product with the anchor.
    An anchor's positives are the ``positives`` best other rows of its label; a positive's negatives are the ``negatives``
    best rows of other labels whose score is at least ``percent`` / 100 of the positive's and not above it. Higher scores come
    first, ties by the lesser key. All rows and all anchors count: rows are dealt to blocks, every anchor meets each block in
    a task of bounded size, and there the bounds of segment summaries leave few rows to score exactly.

    Rows without key or label, and whose vectors are null, empty or hold null or non-finite components, take no part; nor
    does an anchor's own key. Equal rows count once, rows of different lengths never meet. Scores stop at 64 bits.
    """
    def taken(df):
        some = df.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).alias("vector"))
        some = some.where(F.col("id").isNotNull() & usable(F.col("vector"), F.col("label"))).distinct()
        return some.withColumn("size", F.size("vector"))

    blocks = blocks or max(BLOCKS, math.ceil(rows.count() / BLOCK_ROWS))
    held = stored(taken(rows).withColumn("part", F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int")))
    asked = stored(taken(anchors))
    rounds = max(1, math.ceil(asked.count() / ANCHORS))

    near = _tasks(held, asked, blocks, rounds).mapInArrow(_met(positives, None), _OUT)
    order = Window.partitionBy("anchor_id", "mark").orderBy(F.desc("score"), "id")
    best = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    best = best.groupBy("anchor_id", "mark").agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    found = asked.withColumn("mark", F.xxhash64("label", "vector")).join(
        best.withColumnRenamed("anchor_id", "id"), ["id", "mark"]
    )
    far = _tasks(held, stored(found.drop("mark")), blocks, rounds).mapInArrow(_met(negatives, percent), _OUT)
    order = Window.partitionBy("anchor_id", "mark", "positive_id").orderBy(F.desc("score"), "id")
    ranked = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
