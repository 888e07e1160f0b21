"""Exact near-duplicate vectors: cover trees, traversed in pairs."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from threatflow.llm.shared import components, groups, saved

#: Vectors the top level is fitted on at most, chosen by a hash, and its nodes per label.
SAMPLE, CENTRES = 2_000, 64
#: Vectors a block holds on average; a task sees two blocks.
BLOCK = 768
#: Radii of the levels below the top, on the unit sphere.
RADII = tuple(2.0**-i for i in range(5))
#: Bounds within this of the threshold are not trusted.
SLACK = 1e-9


def usable(vector, label):
    """Whether a vector can be linked: it has a label and components, all of them finite, not all zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(label.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column):
    """Rows of an Arrow list column as a matrix of doubles; all lists are of one length."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _unit(x):
    scaled = x / np.abs(x).max(1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(1, keepdims=True))


def _cover(points, radius, most=None):
    """Greedy centres such that every point is within ``radius`` of one (or nearest, beyond ``most``)."""
    centres, left = [], np.arange(len(points))
    while len(left) and (most is None or len(centres) < most):
        centres.append(left[0])
        left = left[1:][np.linalg.norm(points[left[1:]] - points[left[0]], axis=1) > radius]
    return centres


class Tree:
    """Nested levels of nodes: a point in each, all points of a node within the level's radius of its own."""

    def __init__(self, points):
        self.points, self.levels = points, []
        node_of = np.zeros(len(points), np.int64)
        for radius in RADII:
            members = np.argsort(node_of, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(node_of[members]) > 0])
            centres, radii, parents, below = [], [], [], np.empty(len(points), np.int64)
            for parent, left in enumerate(np.split(members, starts[1:])):
                while len(left):
                    if len(left) == 1:
                        inside, reach = np.ones(1, bool), 0.0
                    else:
                        far = np.linalg.norm(points[left] - points[left[0]], axis=1)
                        inside = far <= radius
                        inside[0] = True
                        reach = far[inside].max()
                    below[left[inside]] = len(centres)
                    centres.append(left[0])
                    radii.append(reach)
                    parents.append(parent)
                    left = left[~inside]
            self.levels.append((np.array(centres), np.array(radii), np.array(parents), below))
            node_of = below


def linked(a, b, cosine, near):
    """Which points of two trees are linked, as a matrix of booleans.

    Goes down both trees level by level. Pairs of nodes farther apart than ``near`` and both radii are dropped with
    all below them; pairs whose points all are nearer are linked without a look; where the last level
    leaves a pair open, ``cosine(i, j)`` decides each pair of points.
    """
    found = np.zeros((len(a.points), len(b.points)), bool)
    open_pairs = np.ones((1, 1), bool)
    for (ca, ra, pa_, na), (cb, rb, pb, nb) in zip(a.levels, b.levels):
        cross = a.points[ca] @ b.points[cb].T
        apart = np.sqrt(np.maximum(2 - 2 * cross, 0))
        reach = ra[:, None] + rb[None, :]
        open_pairs = open_pairs[np.ix_(pa_, pb)] & (apart - reach <= near + 1e-7)
        sure = open_pairs & (apart + reach <= near - 1e-7)
        if sure.any():
            found |= sure[np.ix_(na, nb)]
        open_pairs &= ~sure
        if not open_pairs.any():
            return found
    i, j = np.nonzero(open_pairs[np.ix_(na, nb)])
    for at in range(0, len(i), 65536):
        part = slice(at, at + 65536)
        hit = cosine(i[part], j[part])
        found[i[part][hit], j[part][hit]] = True
    return found


def _connected(matrix):
    """Ties (i, first of its component) of a symmetric matrix of links."""
    ties, seen = [], np.zeros(len(matrix), bool)
    for start in np.flatnonzero(matrix.any(1)).tolist():
        if seen[start]:
            continue
        reached, front = np.zeros(len(matrix), bool), np.zeros(len(matrix), bool)
        front[start] = True
        while front.any():
            reached |= front
            front = matrix[front].any(0) & ~reached
        seen |= reached
        reached[start] = False
        ties += [(i, start) for i in np.flatnonzero(reached).tolist()]
    return ties


def _links(threshold):
    near = np.sqrt(2 - 2 * threshold)

    def run(batches):
        for group in groups(batches):
            ids, sides = np.array(group.column("id").to_pylist(), object), group.column("side").to_numpy()
            raw, times = _matrix(group.column("vector")), group.column("times").to_numpy()
            unit = _unit(raw)
            norms = np.sqrt((raw**2).sum(1))
            left, right = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
            a = Tree(unit[left])
            b = a if len(left) == len(right) and (left == right).all() else Tree(unit[right])

            def cosine(i, j, left=left, right=right, raw=raw, norms=norms):
                x, y = left[i], right[j]
                return np.einsum("nd,nd->n", raw[x], raw[y]) / (norms[x] * norms[y]) >= threshold

            found = linked(a, b, cosine, near)
            if a is b:
                np.fill_diagonal(found, False)
                n, counts = len(left), found @ times[left]
                matrix, where = found, left
            else:
                n = len(left) + len(right)
                counts = np.r_[found @ times[right], found.T @ times[left]]
                matrix = np.zeros((n, n), bool)
                matrix[: len(left), len(left) :] = found
                matrix[len(left) :, : len(left)] = found.T
                where = np.r_[left, right]
            ties = dict(_connected(matrix))
            some = np.flatnonzero(counts).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[where[i]] for i in some], pa.binary()),
                    pa.array([ids[where[ties.get(i, i)]] for i in some], pa.binary()),
                    pa.array(counts[some].astype(np.int64)),
                ],
                ["a", "b", "links"],
            )

    return run


def _top(sample):
    """Centres of the top level per (label, length) from sampled rows: a cover of halving radii, as fine as fits."""
    found = {}
    rooms = {}
    for row in sample:
        rooms.setdefault((row.label, len(row.vector)), []).append(row.vector)
    for key, vectors in rooms.items():
        unit = _unit(np.array(vectors, np.float64))
        for radius in RADII:
            chosen = _cover(unit, radius, CENTRES)
            found[key] = unit[chosen]
            if len(chosen) == CENTRES:
                break
    return found


def _placed(centres):
    """Adds each vector's nearest top-level node and its distance."""

    def run(batches):
        for batch in batches:
            vectors, labels = batch.column("vector"), batch.column("label").to_pylist()
            cells, far = [], []
            for i, label in enumerate(labels):
                x = np.array(vectors[i].as_py(), np.float64)
                top = centres.get((label, len(x)))
                if top is None:
                    cells.append(0)
                    far.append(2.0)
                    continue
                apart = np.linalg.norm(top - _unit(x[None, :]), axis=1)
                cells.append(int(apart.argmin()))
                far.append(float(apart.min()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, pa.int32()), pa.array(far, pa.float64())], [*batch.schema.names, "cell", "far"]
            )

    return run


def near_vectors(rows, vector="embedding", label="label", key="vec_id", threshold=0.93):
    """One row per vector: key, ``n_links``, ``component_id``, ``kept``.

    Vectors of equal label and length are linked if their cosine, in doubles, is at least ``threshold``;
    ``component_id`` is the least key reachable by links. Equal vectors are one point that counts as many
    times as it occurs. A cover tree's top level, fitted on at most ``SAMPLE`` vectors, deals all vectors
    into nodes; pairs of nodes too far apart for their covering radii are dropped, nodes are cut into blocks,
    and each pair of blocks left meets in a task, where two trees are traversed together. The task returns how many
    links each point has and what connects them, not the pairs.

    Vectors that are null, empty, zero or hold null or non-finite components, and those without a label, are linked with
    nothing and keep themselves. Repeated keys keep a row each. Where vectors lie so evenly that no node
    can be dropped, exact search compares all of a label.
    """
    source = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    source = source.withColumn("ok", usable(F.col("vector"), F.col("label")))
    hashes = F.concat(*[F.hex(F.xxhash64(F.lit(i), F.col("label"), F.col("vector"))) for i in (1, 2)])
    keyed = source.withColumn("point", F.when(F.col("ok"), F.unhex(F.md5(hashes))))
    points = saved(
        keyed.where("ok").groupBy("point", "label", "vector").agg(F.count("*").alias("times"), F.min("id").alias("first"))
    )
    sample = points.orderBy(F.xxhash64("point"), "point").limit(SAMPLE).select("label", "vector").collect()
    centres = _top(sample)
    placed = saved(
        points.select("point", "label", "vector", "times").mapInArrow(
            _placed(centres), points.select("point", "label", "vector", "times").schema.simpleString()[7:-1] + ",cell:int,far:double"
        )
    ).withColumn("size", F.size("vector"))
    cells = placed.groupBy("label", "size", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.max("far").alias("radius"))
    gaps = [
        (lab, size, i, j, float(np.linalg.norm(top[i] - top[j])))
        for (lab, size), top in centres.items()
        for i in range(len(top))
        for j in range(len(top))
    ]
    spark = rows.sparkSession
    label_type = rows.select(label).schema[0].dataType.simpleString()
    gap_table = spark.createDataFrame(gaps, f"label {label_type}, size int, cell int, other int, gap double")
    other = cells.select("label", "size", F.col("cell").alias("other"), F.col("blocks").alias("their"), F.col("radius").alias("theirs"))
    near = float(np.sqrt(2 - 2 * threshold))
    meets = (
        cells.join(other, ["label", "size"])
        .join(gap_table, ["label", "size", "cell", "other"], "left")
        .where(F.coalesce("gap", F.lit(0.0)) - F.col("radius") - F.col("theirs") <= near + 1e-7)
        .groupBy("label", "size", "cell")
        .agg(F.first("blocks").alias("blocks"), F.collect_list(F.struct("other", "their")).alias("others"))
    )
    blocks = placed.join(meets, ["label", "size", "cell"]).withColumn(
        "block", F.pmod(F.xxhash64("point"), F.col("blocks"))
    )
    mine = F.struct(F.col("cell").alias("cell"), F.col("block").alias("block"))

    def pair(o, theirs):
        yours = F.struct(o["other"].alias("cell"), theirs.alias("block"))
        return F.struct(
            F.xxhash64("label", "size", F.least(mine, yours), F.greatest(mine, yours)).alias("g"),
            F.when(mine == yours, 2).when(mine < yours, 0).otherwise(1).cast("int").alias("side"),
        )

    tasks = F.flatten(
        F.transform("others", lambda o: F.transform(F.sequence(F.lit(0).cast("bigint"), o["their"] - 1), lambda t: pair(o, t)))
    )
    dealt = blocks.select(F.col("point").alias("id"), "vector", "times", F.explode(tasks).alias("t"))
    dealt = dealt.select("t.g", "t.side", "id", "vector", "times")
    ties = saved(
        dealt.repartition("g").sortWithinPartitions("g").mapInArrow(_links(threshold), "a binary, b binary, links bigint")
    )
    counts = ties.groupBy(F.col("a").alias("point")).agg(F.sum("links").alias("links"))
    roots = components(ties.select("a", "b")).select(F.col("node").alias("point"), "root")
    settled = points.select("point", "times", "first").join(roots, "point", "left").join(counts, "point", "left")
    settled = settled.withColumn("root", F.coalesce("root", "point"))
    least = settled.groupBy("root").agg(F.min("first").alias("component_id"))
    settled = settled.join(least, "root").select(
        "point", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    return (
        keyed.select("id", "point")
        .join(settled, "point", "left")
        .select(
            F.col("id").alias(key),
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            F.when(F.col("point").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
    )
