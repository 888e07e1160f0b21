"""Exact nearest neighbours in a class, and the synthetic rows made from them."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from threatflow.operators.prep import balance_plan
from threatflow.plans import ordered
from threatflow.plans.sizes import broadcast_if_small


def _distances(a, b):
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


#: Distances that are held at once.
HELD = 4_000_000
#: Blocks that a class of many rows is cut into, and rows that no block exceeds for that.
CLASS_BLOCKS, MOST_ROWS = 16, 16_384


def _nearest(queries, qid, points, pid, k):
    """The k nearest points of each query, itself left out, as long arrays."""
    some = max(1, HELD // max(1, len(points)))
    parts = [_nearest_of(queries[i : i + some], qid[i : i + some], points, pid, k) for i in range(0, len(qid), some)]
    return tuple(np.concatenate(c) for c in zip(*parts))


def _nearest_of(queries, qid, points, pid, k):
    """Distances by one product pick who may be near; these are measured again one by one, equal ones go by id."""
    d = _distances(queries, points)
    d[qid[:, None] == pid[None, :]] = np.inf
    take = min(k, d.shape[1])
    reach = np.partition(d, take - 1, axis=1)[:, take - 1]
    slack = 1e-6 * (1.0 + np.sqrt((queries * queries).sum(1)))
    rows, cols = np.nonzero(np.isfinite(d) & (d <= (reach + slack)[:, None]))
    exact = np.empty(len(rows))
    for i in range(0, len(rows), 1 << 16):
        at = slice(i, i + (1 << 16))
        gap = queries[rows[at]] - points[cols[at]]
        exact[at] = np.sqrt((gap * gap).sum(1))
    order = np.lexsort((pid[cols], exact, rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    first = np.searchsorted(rows, rows)
    good = np.arange(len(rows)) - first < k
    return qid[rows[good]], pid[cols[good]], exact[good]


def class_neighbours(df: DataFrame, group, row_id, vector, k=5, pivots=64, block_rows=4096, seed=42):
    """The k nearest rows of the same class for every row: exact, without all pairs.

    Rows go to the nearest of a few pivots of their class, and crowded cells are cut
    into blocks of about ``block_rows``.  Looking at the own block gives every row a
    bound on its k-th distance.  The triangle inequality then says which other cells can
    hold anything nearer, and the row visits only their blocks.  Every task compares
    two bounded blocks and returns k rows per query.  A row is sent once to each block it visits, so the blocks
    of a large class grow with it, up to ``MOST_ROWS`` rows, and their number stays about ``CLASS_BLOCKS``.
    """
    spark = df.sparkSession
    rows = df.select(F.col(group).alias("g"), F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rank = Window.partitionBy("g").orderBy("_h", "id")
    heads = rows.withColumn("_h", F.xxhash64("id", F.lit(seed)))
    # the smallest hashes are picked per class before anything is ranked
    heads = heads.groupBy("g", F.pmod("_h", F.lit(pivots)).alias("_b")).agg(
        F.min_by(F.struct("id", "v"), F.struct("_h", "id")).alias("p"), F.min("_h").alias("_h")
    ).select("g", F.col("p.id").alias("id"), F.col("p.v").alias("v"), "_h")
    heads = heads.withColumn("cell", F.row_number().over(rank) - 1)
    # classes x pivots rows
    centres = {}
    for r in heads.orderBy("g", "cell").collect():
        centres.setdefault(r["g"], []).append(r["v"])
    centres = {g: np.array(v, float) for g, v in centres.items()}
    shared = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("struct<cell: int, far: double>")
    def place(g: pd.Series, v: pd.Series) -> pd.DataFrame:
        cell, far = np.zeros(len(g), int), np.zeros(len(g))
        for name, idx in g.groupby(g).groups.items():
            if name not in shared.value:
                continue  # Spark may place rows before a join that drops their class
            at = g.index.get_indexer(idx)
            d = _distances(np.stack(v.iloc[at].to_numpy()), shared.value[name])
            cell[at], far[at] = d.argmin(1), d.min(1)
        return pd.DataFrame({"cell": cell, "far": far})

    placed = rows.withColumn("_p", place("g", "v")).select("g", "id", "v", "_p.cell", "_p.far")
    cells = {
        (r["g"], r["cell"]): (r["n"], r["radius"])
        for r in placed.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()
    }
    info, sizes = {}, {}
    for (g, _), (n, _) in cells.items():
        sizes[g] = sizes.get(g, 0) + n
    block_of = {g: max(block_rows, min(MOST_ROWS, n // CLASS_BLOCKS)) for g, n in sizes.items()}
    for (g, cell), (n, radius) in cells.items():
        info.setdefault(g, []).append((cell, max(1, math.ceil(n / block_of[g])), radius))
    known = spark.sparkContext.broadcast(info)
    subs = spark.createDataFrame([(g, c, s, block_of[g]) for g, v in info.items() for c, s, _ in v], T.StructType([
        T.StructField("g", df.schema[group].dataType), T.StructField("cell", T.IntegerType()), T.StructField("subs", T.IntegerType()),
        T.StructField("most", T.IntegerType())]))
    placed = placed.join(F.broadcast(subs), ["g", "cell"]).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int"))

    def own_block(pdf):
        v, ids = np.stack(pdf["v"].to_numpy()), pdf["id"].to_numpy()
        q, _, d = _nearest(v, ids, v, ids, k)
        bound = pd.Series(d).groupby(q).agg(lambda s: s.max() if len(s) == k else np.inf)
        out = pdf[["g", "id", "v", "cell", "far"]].copy()
        out["bound"] = bound.reindex(ids).fillna(np.inf).to_numpy()
        return out

    vec = T.ArrayType(T.DoubleType())
    gtype = df.schema[group].dataType
    bounded = placed.groupBy("g", "cell", "sub").applyInPandas(own_block, T.StructType([
        T.StructField("g", gtype), T.StructField("id", T.LongType()), T.StructField("v", vec),
        T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType()), T.StructField("bound", T.DoubleType())]))

    def visits(batches):
        for pdf in batches:
            for g, part in pdf.groupby("g"):
                v, ids = np.stack(part["v"].to_numpy()), part["id"].to_numpy()
                reach = part["bound"].to_numpy()
                d = _distances(v, shared.value[g])
                for cell, n_subs, radius in known.value[g]:
                    # a little slack covers rounding in the distances
                    near = np.flatnonzero(d[:, cell] - radius <= reach + 1e-6 * (1.0 + d[:, cell]))
                    for sub in range(n_subs if len(near) else 0):
                        # one block at a time: a batch for all blocks would not fit a worker
                        yield pd.DataFrame({"g": g, "cell": cell, "sub": sub, "id": ids[near], "v": list(v[near])})

    ask = bounded.mapInPandas(visits, T.StructType([
        T.StructField("g", gtype), T.StructField("cell", T.IntegerType()), T.StructField("sub", T.IntegerType()),
        T.StructField("id", T.LongType()), T.StructField("v", vec)]))
    # queries of a block come in batches, each with its own copy of the block's points
    totals = ask.groupBy("g", "cell", "sub").agg(F.count(F.lit(1)).alias("n"))
    totals = totals.join(F.broadcast(subs.drop("subs")), ["g", "cell"]).select("g", "cell", "sub", F.ceil(F.col("n") / F.col("most")).cast("int").alias("turns"))
    turn = F.expr(f"CAST(pmod(xxhash64(id, {int(seed)}), turns) AS INT) AS turn")
    ask = ask.join(totals, ["g", "cell", "sub"]).select("g", "cell", "sub", "id", "v", turn)
    spread = totals.select("g", "cell", "sub", F.expr("explode(sequence(0, turns - 1)) AS turn"))
    tell = placed.join(spread, ["g", "cell", "sub"]).select("g", "cell", "sub", "id", "v", "turn")

    keys = ["g", "cell", "sub", "turn"]
    found = ask.groupBy(*keys).cogroup(tell.groupBy(*keys)).applyInPandas(_meet(k), "id long, other long, dist double")
    best = Window.partitionBy("id").orderBy("dist", "other")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def true_neighbours(asked: DataFrame, df: DataFrame, group, row_id, vector, k=5, most=MOST_ROWS):
    """The k nearest rows of the same class for each row of ``asked``, by comparing it with all of them: (id, other, dist, rank).

    Both tables are cut by a hash into blocks of about ``most`` rows of a class; a task compares two blocks and returns k rows per
    asked row. Rows are compared with all others of their class, so the work is asked rows times rows, the memory two blocks.
    """
    def cut(rows, name):
        rows = rows.select(F.col(group).alias("g"), F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        sizes = rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / most).alias(f"{name}s"))
        return rows, sizes, F.pmod(F.xxhash64("id"), F.col(f"{name}s")).alias(name)

    queries, asks, ask = cut(asked, "ask")
    points, tells, tell = cut(df, "tell")
    sizes = broadcast_if_small(asks.join(tells, "g"))

    def every(name):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{name}s") - 1)).alias(name)

    keys = ["g", "ask", "tell"]
    queries = queries.join(sizes, "g").select("g", "id", "v", ask, every("tell"))
    points = points.join(sizes, "g").select("g", "id", "v", every("ask"), tell)

    found = queries.groupBy(*keys).cogroup(points.groupBy(*keys)).applyInPandas(_meet(k), "id long, other long, dist double")
    best = Window.partitionBy("id").orderBy("dist", "other")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _meet(k):
    """A function of two tables of rows (id, v): the k nearest of the second for each row of the first."""
    def meet(q, p):
        if q.empty or p.empty:
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "dist": pd.Series(dtype="float64")})
        a, b, d = _nearest(np.stack(q["v"].to_numpy()), q["id"].to_numpy(), np.stack(p["v"].to_numpy()), p["id"].to_numpy(), k)
        return pd.DataFrame({"id": a, "other": b, "dist": d})

    return meet


def hashed_neighbours(df: DataFrame, group, row_id, vector, k=5, tables=8, bits=6, block_rows=4096, seed=42):
    """Near rows of the same class for every row, not always the nearest ``k``, in time linear in the rows.

    In each of ``tables`` tables, ``bits`` planes halfway between two rows of the class cut it into buckets, and
    a row is compared with its bucket; a bucket of more than ``block_rows`` rows is cut by a hash. More
    tables and fewer bits find more of the true neighbours and compare more rows.
    ``class_neighbours`` is the exact search; it compares all pairs of a class where vectors don't cluster.
    """
    rows = df.select(F.col(group).alias("g"), F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    heads = rows.withColumn("_h", F.xxhash64("id", F.lit(seed)))
    heads = heads.groupBy("g", F.pmod("_h", F.lit(2 * tables * bits)).alias("_b")).agg(F.min_by("v", F.struct("_h", "id")).alias("v"))
    planes = {}
    # classes x tables x bits x 2 rows
    for r in heads.orderBy("g", "_b").collect():
        planes.setdefault(r["g"], []).append(r["v"])
    for g, picked in planes.items():
        at = np.arange(tables * bits)
        ends = np.array(picked, float)
        a, b = ends[(2 * at) % len(ends)], ends[(2 * at + 1) % len(ends)]
        planes[g] = (a - b, ((a - b) * (a + b)).sum(1) / 2)
    shared = df.sparkSession.sparkContext.broadcast(planes)

    @F.pandas_udf("array<bigint>")
    def codes(g: pd.Series, v: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(g), index=g.index, dtype=object)
        for name, idx in g.groupby(g).groups.items():
            if name in shared.value:
                normal, offset = shared.value[name]
                side = np.stack(v.loc[idx].to_numpy()) @ normal.T > offset
                code = (side.reshape(len(idx), tables, bits) << np.arange(bits)).sum(2)
                out.loc[idx] = list(code)
        return out

    placed = rows.select("g", "id", "v", F.posexplode(codes("g", "v")).alias("t", "code"))
    blocks = placed.groupBy("g", "t", "code").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    placed = placed.join(blocks, ["g", "t", "code"]).withColumn("block", F.pmod(F.xxhash64("id", "t"), F.col("blocks")))

    def inside(pdf):
        v, ids = np.stack(pdf["v"].to_numpy()), pdf["id"].to_numpy()
        a, b, d = _nearest(v, ids, v, ids, k)
        return pd.DataFrame({"id": a, "other": b, "dist": d})

    found = placed.groupBy("g", "t", "code", "block").applyInPandas(inside, "id long, other long, dist double")
    found = found.groupBy("id", "other").agg(F.min("dist").alias("dist"))
    best = Window.partitionBy("id").orderBy("dist", "other")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def smote(df: DataFrame, group, row_id, vector, k=5, seed=42, search=class_neighbours, **options):
    """Synthetic rows that raise every class to the largest: points between neighbours.

    ``search`` finds the neighbours: exactly, or by ``hashed_neighbours``, the choice for large classes.
    """
    plan = balance_plan(df, group, "smote")
    rows = df.select(F.col(group).alias("g"), F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    plan = plan.select(F.col(group).alias("g"), "have", "want").where(F.col("want") > F.col("have"))
    small = rows.join(broadcast_if_small(plan), "g")
    near = search(small.select("g", "id", "v"), "g", "id", "v", k, seed=seed, **options)
    numbered = ordered.number_rows(small.withColumn("_h", F.xxhash64("id", F.lit(seed))), ["g"], ["_h", "id"], "_rn")
    extra = F.col("want") - F.col("have")
    copies = F.floor(extra / F.col("have")) + (F.col("_rn") <= extra % F.col("have")).cast("long")
    base = numbered.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies))))
    count = near.groupBy("id").agg(F.max("rank").alias("_k"))
    base = base.join(count, "id").withColumn("rank", (F.pmod(F.xxhash64("id", "copy", F.lit(seed)), F.col("_k")) + 1).cast("int"))
    picked = base.join(near.select("id", "rank", "other"), ["id", "rank"])
    other = rows.select(F.col("id").alias("other"), F.col("v").alias("w"))
    share = F.pmod(F.xxhash64("copy", "id", F.lit(seed + 1)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    made = picked.join(other, "other").withColumn("share", share)
    return made.select(
        F.col("g").alias(group), F.col("id").alias("base_id"), F.col("other").alias("other_id"), "copy", "share",
        F.zip_with("v", "w", lambda a, b: a + F.col("share") * (b - a)).alias(vector),
    )
