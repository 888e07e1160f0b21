"""Approximate nearest neighbours: a robust-pruned directed graph per shard, searched with a beam."""

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from threatflow.llm.shared import groups, stored
from threatflow.plans.ranges import unused
from threatflow.plans.sizes import broadcast_if_small

#: Least number of shards, rows a shard holds at most (on average), and queries that one task answers.
SHARDS, SHARD_ROWS, QUERIES = 16, 50_000, 500_000
#: Edges of a node, beam width while building and while searching, and how much farther an edge may reach.
DEGREE, BUILD_BEAM, BEAM, RELAX = 48, 64, 128, 1.2
#: Points that search together.
TOGETHER = 512


def usable(vector):
    """Whether a vector is not null, empty or zero and has only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column):
    """The rows of a list column, all of one length, as a matrix of doubles."""
    import pyarrow as pa

    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


def units(vectors):
    """Vectors of length one, in single precision; scaled first, so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def cosines(a, b):
    """Cosines of pairs of rows in doubles, the components added one after another."""
    a, b = (x / _scale(x) for x in (a, b))
    dot, left, right = (np.zeros(a.shape[:-1]) for _ in range(3))
    for j in range(a.shape[-1]):
        x, y = a[..., j], b[..., j]
        dot, left, right = dot + x * y, left + x * x, right + y * y
    return np.clip(dot / np.sqrt(left * right), -1.0, 1.0)


def _scale(x):
    """A power of two near the largest component, which changes no digit of a quotient."""
    return np.exp2(np.floor(np.log2(np.abs(x).max(axis=-1, keepdims=True))))


class Graph:
    """Unit vectors and their edges; an edge leads to a near vector that no nearer edge stands in for."""

    def __init__(self, points, edges=None, entry=0):
        self.points, self.entry = points, entry
        self.edges = np.full((len(points), DEGREE), -1, np.int32) if edges is None else edges

    def search(self, queries, beam):
        """For each query the nodes of the last beam and their distances, nearest first, and all nodes looked into."""
        n = len(queries)
        width = max(1, min(beam, len(self.points)))
        ids = np.full((n, width), -1, np.int32)
        far = np.full((n, width), np.inf, np.float32)
        open_ = np.zeros((n, width), bool)
        ids[:, 0], open_[:, 0] = self.entry, True
        far[:, 0] = 1 - queries @ self.points[self.entry]
        active, seen = np.arange(n), []
        while len(active):
            at = np.argmax(open_[active], axis=1)
            active, at = active[open_[active, at]], at[open_[active, at]]
            if not len(active):
                break
            open_[active, at] = False
            here = ids[active, at]
            looked = np.full(n, -1, np.int32)
            looked[active] = here
            seen.append(looked)
            near = self.edges[here]
            gap = 1 - np.einsum("bd,brd->br", queries[active], self.points[near])
            held = ids[active]
            known = (near[:, :, None] == held[:, None, :]).any(axis=2) | (near < 0)
            gap[known] = np.inf
            both = np.concatenate([far[active], gap], axis=1)
            order = np.argsort(both, axis=1, kind="stable")[:, :width]
            far[active] = np.take_along_axis(both, order, 1)
            ids[active] = np.take_along_axis(np.concatenate([held, np.where(known, -1, near)], axis=1), order, 1)
            fresh = np.concatenate([open_[active], ~known], axis=1)
            open_[active] = np.take_along_axis(fresh, order, 1)
        return ids, far, np.stack(seen, axis=1) if seen else ids[:, :0]

    def pruned(self, nodes, candidates):
        """At most DEGREE edges of each node: the nearest candidate stays, and drops all that it is nearer to, relaxed."""
        found = np.where(candidates == nodes[:, None], -1, candidates)
        found = np.sort(found, axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        theirs = self.points[found]
        gap = 1 - np.einsum("bd,bcd->bc", self.points[nodes], theirs)
        gap[found < 0] = np.inf
        between = 1 - theirs @ theirs.transpose(0, 2, 1)
        out = np.full((len(nodes), DEGREE), -1, np.int32)
        rows = np.arange(len(nodes))
        # distances here are squares, halved, of those between points on the sphere
        relax = RELAX * RELAX
        left = gap.copy()
        for edge in range(DEGREE):
            pick = np.argmin(left, axis=1)
            valid = np.isfinite(left[rows, pick])
            if not valid.any():
                break
            out[valid, edge] = found[rows, pick][valid]
            left[(relax * between[rows, pick] <= gap) & valid[:, None]] = np.inf
            left[rows, pick] = np.inf
        return out

    def linked(self, nodes, candidates):
        """Give the nodes pruned edges, and their new neighbours edges back, pruned where these grow too many."""
        self.edges[nodes] = self.pruned(nodes, candidates)
        source, place = np.nonzero(self.edges[nodes] >= 0)
        goal, back = self.edges[nodes[source], place], nodes[source].astype(np.int32)
        known = (self.edges[goal] == back[:, None]).any(axis=1)
        goal, back = goal[~known], back[~known]
        order = np.argsort(goal, kind="stable")
        goal, back = goal[order], back[order]
        hit, first, count = np.unique(goal, return_index=True, return_counts=True)
        for start in range(0, len(hit), TOGETHER):
            part = slice(start, start + TOGETHER)
            extra = np.full((len(hit[part]), count[part].max()), -1, np.int32)
            for i, (f, c) in enumerate(zip(first[part], count[part])):
                extra[i, :c] = back[f : f + c]
            held = self.edges[hit[part]]
            fits = (held >= 0).sum(axis=1) + count[part] <= DEGREE
            packed = -np.sort(-np.concatenate([held, extra], axis=1), axis=1)[:, :DEGREE]
            self.edges[hit[part][fits]] = packed[fits]
            full = ~fits
            # a node that very many points chose takes the new edges some at a time, so memory stays bounded
            for turn in range(0, extra.shape[1], 4 * DEGREE) if full.any() else ():
                some = full & (count[part] > turn)
                if some.any():
                    nodes_now = hit[part][some]
                    both = np.concatenate([self.edges[nodes_now], extra[some, turn : turn + 4 * DEGREE]], axis=1)
                    self.edges[nodes_now] = self.pruned(nodes_now, both)

    def reached(self):
        """Which nodes a walk along edges from the entry comes to."""
        found = np.zeros(len(self.points), bool)
        found[self.entry] = True
        edge = np.array([self.entry])
        while len(edge):
            out = np.unique(self.edges[edge])
            out = out[out >= 0]
            edge = out[~found[out]]
            found[edge] = True
        return found


def build(points, seed=0):
    """The graph of some unit vectors: each is searched for from the entry and linked to what the search passed.

    A second round does so again in the whole graph, since the first nodes saw few others. Nodes that no walk
    from the entry comes to then get an edge from a near one.
    """
    graph = Graph(points)
    n = len(points)
    if n == 0:
        return graph
    graph.entry = int(np.argmax(points @ points.mean(axis=0)))
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[graph.entry], order[order != graph.entry]])
    for again in (False, True):
        done = 1
        while done < n:
            some = order[done : done + max(1, min(TOGETHER, n if again else done // 4))]
            beam, _, seen = graph.search(points[some], BUILD_BEAM)
            graph.linked(some, np.concatenate([beam, seen, graph.edges[some]], axis=1))
            done += len(some)
    lost = np.flatnonzero(~graph.reached())
    while len(lost):
        # a node none leads to gets an edge from the nearest node found, beside its pruned ones
        node = lost[:1]
        near = int(graph.search(points[node], BUILD_BEAM)[0][0, 0])
        free = np.flatnonzero(graph.edges[near] < 0)
        if not len(free):
            graph.edges = np.concatenate([graph.edges, np.full((n, 4), -1, np.int32)], axis=1)
            free = np.flatnonzero(graph.edges[near] < 0)
        graph.edges[near, free[0]] = node[0]
        lost = np.flatnonzero(~graph.reached())
    return graph


def _indexed(batches):
    """Per shard: its rows with their node in the shard's graph, and each node's edges beside its first row."""
    import pyarrow as pa

    for shard in groups(batches, "shard"):
        ids = shard.column("id").to_numpy()
        points = units(matrix(shard.column("vector")))
        _, first, node = np.unique(points, axis=0, return_index=True, return_inverse=True)
        node = node.ravel()
        graph = build(points[first])
        order = np.lexsort((ids, node))
        leads = np.ones(len(order), bool)
        leads[1:] = node[order][1:] != node[order][:-1]
        edges = [None] * len(order)
        for place in np.flatnonzero(leads):
            row = graph.edges[node[order[place]]]
            edges[place] = row[row >= 0].tolist()
        out = shard.take(pa.array(order))
        extra = {
            "node": pa.array(node[order].astype(np.int32)),
            "entry": pa.array(np.full(len(order), graph.entry, np.int32)),
            "edges": pa.array(edges, pa.list_(pa.int32())),
        }
        for start in range(0, len(order), 10_000):
            part = out.slice(start, 10_000).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [*[c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in part.columns], *[v.slice(start, 10_000) for v in extra.values()]],
                [*part.column_names, *extra],
            )


def index(rows, vector="embedding", key="vec_id", shards=None):
    """All usable vectors, dealt by hash to shards, with the edges of each shard's graph; written to the shared folder.

    Equal rows count once. Vectors without a key, and those that are null, empty, zero or hold null or non-finite
    components, are left out. Vectors of different lengths lie in different graphs. Vectors of one direction are one
    node of a shard's graph. The number of shards follows from the number of rows, SHARDS at least.
    """
    some = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    some = some.where(F.col("id").isNotNull() & usable(F.col("vector"))).distinct()
    shards = shards or max(SHARDS, math.ceil(rows.count() / SHARD_ROWS))
    dealt = some.withColumn("size", F.size("vector")).withColumn("part", F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("int"))
    dealt = dealt.withColumn("shard", F.concat_ws(":", "size", "part"))
    schema = "id bigint, vector array<double>, size int, part int, shard string, node int, entry int, edges array<int>"
    return stored(dealt.repartitionById(shards, "part").sortWithinPartitions("shard").mapInArrow(_indexed, schema))


def _searched(k, beam):
    def run(batches):
        import pyarrow as pa

        for task in groups(batches, "task"):
            asks = task.column("ask").to_numpy(zero_copy_only=False).astype(bool)
            held, queries = task.filter(pa.array(~asks)), task.filter(pa.array(asks))
            if not held.num_rows or not queries.num_rows:
                continue
            node, ids = held.column("node").to_numpy(), held.column("id").to_numpy()
            order = np.lexsort((ids, node))
            node, ids, vectors = node[order], ids[order], matrix(held.column("vector"))[order]
            starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            sizes = np.diff(np.append(starts, len(node)))
            graph = _loaded(held, order, starts, vectors)
            # of vectors of one direction only the k + 1 least keys can be among the k nearest
            copies = np.arange(k + 1)
            wanted, asked = matrix(queries.column("vector")), queries.column("id").to_numpy()
            marks = queries.column("mark").to_numpy()
            for start in range(0, len(asked), TOGETHER):
                part = slice(start, start + TOGETHER)
                found, _, _ = graph.search(units(wanted[part]), beam)
                place = starts[found][:, :, None] + copies
                valid = ((found >= 0)[:, :, None] & (copies < sizes[found][:, :, None])).reshape(len(found), -1)
                place = np.where(valid, place.reshape(len(found), -1), 0)
                valid &= ids[place] != asked[part][:, None]
                q, c = np.nonzero(valid)
                score = np.full(place.shape, -np.inf)
                for at in range(0, len(q), 1 << 16):
                    few = slice(at, at + (1 << 16))
                    score[q[few], c[few]] = cosines(wanted[part][q[few]], vectors[place[q[few], c[few]]])
                best = np.lexsort((np.where(valid, ids[place], 0), -score), axis=1)[:, :k]
                rows = np.arange(len(found))[:, None]
                keep = valid[rows, best]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.broadcast_to(asked[part][:, None], best.shape)[keep]),
                        pa.array(np.broadcast_to(marks[part][:, None], best.shape)[keep]),
                        pa.array(ids[place][rows, best][keep]),
                        pa.array(score[rows, best][keep]),
                    ],
                    ["query_id", "mark", "id", "score"],
                )

    return run


def _loaded(held, order, starts, vectors):
    """A shard's graph from its stored rows."""
    edges = held.column("edges").combine_chunks().take(order)
    firsts = [e.as_py() or [] for e in edges.take(starts)]
    wide = np.full((len(firsts), max(1, max(map(len, firsts)))), -1, np.int32)
    for i, e in enumerate(firsts):
        wide[i, : len(e)] = e
    return Graph(units(vectors[starts]), wide, int(held.column("entry")[0].as_py()))


def nearest(indexed, queries, k=5, vector="embedding", key="vec_id", beam=BEAM):
    """The ``k`` nearest indexed vectors of each query by cosine: query_id, rank, the indexed key, score.

    ``indexed`` is what ``index`` returned. Each query is searched for in every shard's graph of its length, by a
    beam of ``beam`` nodes; a shard gives its ``k`` best by exact cosine in doubles, and the best of all shards
    count: nearest first, ties to the lesser key. Vectors with the query's own key never count, fewer candidates
    give fewer rows. Queries that ``index`` would leave out give none, equal ones count once. Queries go to tasks
    of at most about QUERIES, each with a copy of the shard.
    """
    asked = queries.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    asked = asked.where(F.col("id").isNotNull() & usable(F.col("vector"))).distinct()
    rounds = max(1, math.ceil(asked.count() / QUERIES))
    shards = indexed.select("size", "shard", "part").distinct()
    chunk = F.pmod(F.xxhash64("id"), F.lit(rounds)).cast("int")
    parts = shards.groupBy("size").agg(F.collect_list(F.struct("shard", "part")).alias("all"))
    asked = asked.withColumn("size", F.size("vector")).join(broadcast_if_small(parts), "size")
    out = asked.select("id", "vector", chunk.alias("round"), F.explode("all").alias("s"))
    blank = F.lit(None)
    mine = out.select(
        F.concat_ws("/", "s.shard", "round").alias("task"), (F.col("s.part") * rounds + F.col("round")).alias("slot"), F.lit(True).alias("ask"),
        "id", "vector", F.xxhash64("vector").alias("mark"), blank.cast("int").alias("node"), blank.cast("int").alias("entry"), blank.cast("array<int>").alias("edges"),
    )
    copies = indexed.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    theirs = copies.select(
        F.concat_ws("/", "shard", "round").alias("task"), (F.col("part") * rounds + F.col("round")).alias("slot"), F.lit(False).alias("ask"),
        "id", "vector", F.lit(0).cast("bigint").alias("mark"), "node", "entry", "edges",
    )
    slots = (shards.agg(F.max("part")).first()[0] or 0) * rounds + rounds
    tasks = mine.unionByName(theirs).repartitionById(slots, "slot").sortWithinPartitions("task")
    found = tasks.mapInArrow(_searched(k, beam), "query_id bigint, mark bigint, id bigint, score double")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "id")
    # a key whose vectors differ counts with each, at its best place
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    name = unused(ranked.select("query_id", "rank", "score"), key)
    return ranked.select("query_id", "rank", F.col("id").alias(name), "score")
