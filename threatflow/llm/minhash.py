"""Near-duplicate documents: HyperMinHash registers find candidates, whole sets confirm them."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from threatflow.llm.shared import components, groups, saved

#: Registers per band and bands: sets of likeness 0.8 share no band in 3 of a million cases.
ROWS, BANDS = 5, 32
#: Registers that estimates use; their standard error is at most 0.051.
ESTIMATED = 96
MANTISSA = 10
#: Members of one bucket, and sets of one block, that a task looks at together.
BUCKET, BLOCK = 20_000, 256

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


def _multipliers():
    draws = np.random.default_rng(20240607).integers(0, 2**63, 2 * ROWS * BANDS, dtype=np.uint64)
    return draws[::2] * np.uint64(2) + np.uint64(1), draws[1::2] * np.uint64(2)


FACTORS, SHIFTS = _multipliers()


def _mixed(x):
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def shingles(text, size=2):
    """Sorted 64-bit hashes of a text's different shingles of ``size`` words, A-Z lower-cased.

    Fewer words make one shingle, no words none.
    """
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    span = min(size, len(words))
    out = np.full(len(words) - span + 1, span, np.uint64)
    for i in range(span):
        out = _mixed(out + hashes[i : len(words) - span + 1 + i])
    return np.unique(out)


def registers(hashes):
    """Per hash function the leading zeros and first mantissa bits of the least value."""
    least = np.full(ROWS * BANDS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096, None] * FACTORS + SHIFTS
        np.minimum(least, part.min(0), out=least)
    fraction, exponent = np.frexp(least.astype(np.float64))
    mantissa = ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    return (((64 - exponent).astype(np.int64) << MANTISSA) | np.clip(mantissa, 0, (1 << MANTISSA) - 1)).astype(np.uint16)


def band_keys(regs):
    """One 64-bit key per band of registers."""
    out = np.arange(BANDS, dtype=np.uint64)
    table = regs.reshape(BANDS, ROWS).astype(np.uint64)
    for i in range(ROWS):
        out = _mixed(out * MIX + table[:, i] + np.uint64(1))
    return out.view(np.int64)


#: Chance that registers of unrelated minima agree: mantissa bits agree, and so do the leading zeros (two
#: geometric counts agree in a third of the cases).
CHANCE = 2.0**-MANTISSA / 3


def estimates(regs, others):
    """Likeness of one row of registers to several, corrected for registers that agree by chance."""
    share = (others == regs).mean(1)
    return np.maximum(share - CHANCE, 0) / (1 - CHANCE)


def _sketches(size):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("est", pa.binary()), ("bands", pa.list_(pa.int64()))]
    )

    def run(batches):
        for batch in batches:
            rows = {name: [] for name in schema.names}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes = shingles(text.as_py(), size)
                rows["doc_id"].append(doc)
                rows["n"].append(len(hashes))
                regs = registers(hashes) if len(hashes) else None
                rows["key"].append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                rows["est"].append(None if regs is None else regs[:ESTIMATED].tobytes())
                rows["bands"].append(None if regs is None else band_keys(regs))
            yield pa.RecordBatch.from_pydict(rows, schema)

    return run


class Sets:
    """Disjoint sets of small numbers."""

    def __init__(self, n):
        self.up = list(range(n))

    def root(self, i):
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i, j):
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def _hubs(near, close):
    """For each group of registers, ties of its members to hubs.

    A member is compared with the hubs so far, tied to those that are ``near``, and becomes a hub itself
    unless one is ``close``. Of two linked members the first is a hub or close to one, and the second is
    then near that hub, so both end up tied together; members that agree in a band only by chance don't.
    A chunk of a larger bucket ties all its members to its first one, which it reports with the bucket.
    """

    def run(batches):
        for group in groups(batches):
            keys = group.column("key").to_pylist()
            if group.column("chunks")[0].as_py() > 1:
                out = [(k, keys[0], None) for k in keys[1:]] + [(keys[0], keys[0], group.column("b")[0].as_py())]
            else:
                regs = np.frombuffer(b"".join(group.column("est").to_pylist()), np.uint16).reshape(len(keys), ESTIMATED)
                hubs, sets = np.empty(0, np.int64), Sets(len(keys))
                for i in range(len(keys)):
                    like = estimates(regs[i], regs[hubs]) if len(hubs) else np.zeros(0)
                    for h in hubs[like >= near].tolist():
                        sets.join(i, h)
                    if not len(like) or like.max() < close:
                        hubs = np.append(hubs, i)
                roots = [sets.root(i) for i in range(len(keys))]
                out = [(keys[i], keys[r], None) for i, r in enumerate(roots) if i != r]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([o[0] for o in out], pa.binary()),
                    pa.array([o[1] for o in out], pa.binary()),
                    pa.array([o[2] for o in out], pa.int64()),
                ],
                ["a", "b", "bucket"],
            )

    return run


def _links(threshold, size):
    """For each group of texts, ties between sets whose exact likeness is at least ``threshold`` percent."""

    def run(batches):
        for group in groups(batches):
            nodes = {}
            for key, text in zip(group.column("key").to_pylist(), group.column("text")):
                if key not in nodes:
                    hashes = shingles(text.as_py(), size)
                    if xxhash.xxh3_128_digest(hashes.tobytes()) == key:
                        nodes[key] = hashes
            keys = sorted(nodes)
            ties = linked([nodes[k] for k in keys], threshold)
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[i] for i, _ in ties], pa.binary()), pa.array([keys[j] for _, j in ties], pa.binary())],
                ["a", "b"],
            )

    return run


def linked(sets, threshold):
    """Pairs (i, j) that tie sets together as their links do: each set with its component's first.

    All intersections at once, as products of 0/1 matrices over blocks of the hashes that at least two sets
    hold.
    """
    n = len(sets)
    if n < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    every, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = seen[at] > 1
    at, owner = at[shared], owner[shared]
    _, at = np.unique(at, return_inverse=True)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    common = np.zeros((n, n), np.float32)
    width = 8192
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        a, b = np.searchsorted(at, [low, low + width])
        block = np.zeros((n, width), np.float32)
        block[owner[a:b], at[a:b] - low] = 1
        common += block @ block.T
    common = common.astype(np.int64)
    both = sizes[:, None] + sizes[None, :] - common
    found, sets_of = np.argwhere(np.triu(100 * common >= threshold * both, 1)), Sets(n)
    for i, j in found.tolist():
        sets_of.join(i, j)
    return [(i, sets_of.root(i)) for i in range(n) if sets_of.root(i) != i]


TIES = "a binary, b binary"


def _grouped(rows, key="g"):
    return rows.repartition(key).sortWithinPartitions(key)


def candidates(nodes):
    """Ties (a, b) such that linked sets are connected, from ``nodes`` (key, est, bands).

    Only buckets with two members or more carry registers on. A bucket with more than ``BUCKET`` members
    is cut into chunks by a hash and tied together as a whole, through a first member of each chunk: its members
    agree in a band far too often for chance, and whole sets decide later. So no group is larger than a
    chunk, and the work is linear in the members of large buckets.
    """
    places = nodes.select("key", F.explode("bands").alias("b"))
    full = places.groupBy("b").count().where("count > 1").select("b", F.ceil(F.col("count") / BUCKET).alias("chunks"))
    rows = places.join(full, "b").join(nodes.select("key", "est"), "key")
    rows = rows.withColumn("est", F.when(F.col("chunks") == 1, F.col("est"))).withColumn(
        "g", F.when(F.col("chunks") == 1, F.col("b")).otherwise(F.xxhash64("b", F.pmod(F.xxhash64("key"), "chunks")))
    )
    # close: estimated 0.9, so at least 0.75 but for five standard errors; near: 0.55 less five, two steps of 0.2 and 0.25
    tied = saved(_grouped(rows).mapInArrow(_hubs(0.3, 0.9), TIES + ", bucket bigint"))
    firsts = tied.where("bucket is not null").select("a", "bucket")
    least = firsts.groupBy("bucket").agg(F.min("a").alias("b"))
    across = firsts.join(least, "bucket").where("a <> b").select("a", "b")
    return tied.where("bucket is null").select("a", "b").unionByName(across)


def near_duplicates(docs, text="text", key="doc_id", threshold=80, size=2):
    """One row per document: key, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked if 100 * |A and B| >= ``threshold`` * |A or B| for their sets of different shingles
    of ``size`` words; ``component_id`` is the least key reachable by links and ``kept`` marks its row. Equal
    sets are one node. Registers of HyperMinHash, banded, tie candidates together; whole sets decide
    in blocks of a candidate component, so no pairs are written. A component of more than ``BLOCK`` sets
    is cut into blocks by a hash and settled in three steps: inside blocks, among the blocks'
    main parts, and between all that is not yet in the component's main part and everything else.

    Null and empty texts have no shingles and are linked with nothing. Rows that repeat a key keep a row
    each. Null keys stay null; an empty table gives no rows. Other columns are not read.
    """
    texts = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    sketches = saved(
        texts.mapInArrow(_sketches(size), "doc_id bigint, n bigint, key binary, est binary, bands array<bigint>")
    )
    whole = sketches.where("key is not null")
    classes = whole.groupBy("key").agg(F.min("doc_id").alias("first"))
    nodes = whole.select("key", "est", "bands").dropDuplicates(["key"])
    parts = components(candidates(nodes)).withColumnsRenamed({"node": "key", "root": "part"})

    sizes = parts.groupBy("part").count().select("part", F.ceil(F.col("count") / BLOCK).alias("blocks"))
    members = parts.join(sizes, "part").join(classes, "key")
    members = members.withColumn("block", F.pmod(F.xxhash64("key"), "blocks")).withColumnRenamed("first", "doc_id")
    # repeated keys bring texts of other sets along, which the tasks leave out
    loaded = texts.where("doc_id is not null").join(members, "doc_id").select("key", "part", "blocks", "block", "text")
    one = loaded.withColumn("g", F.xxhash64("part", "block"))
    large = saved(one.where("blocks > 1"))
    ties = saved(
        _grouped(one.where("blocks = 1").unionByName(large).select("g", "key", "text")).mapInArrow(_links(threshold, size), TIES)
    )
    if not large.isEmpty():
        ties = _large_parts(large, ties, threshold, size)
    settled = components(ties).withColumnsRenamed({"node": "key", "root": "part"})
    found = classes.join(settled, "key", "left").withColumn("part", F.coalesce("part", "key"))
    least = found.groupBy("part").agg(F.min("first").alias("component_id"))
    by_key = found.join(least, "part").select("key", "component_id")
    return (
        sketches.select("doc_id", "n", "key")
        .join(by_key, "key", "left")
        .select(
            F.col("doc_id").alias(key),
            F.col("n").alias("n_shingles"),
            F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
    )


def _large_parts(large, ties, threshold, size, main=8):
    """Ties across the blocks of components too large for one."""
    inside = components(ties).withColumnsRenamed({"node": "key", "root": "label"})
    placed = large.select("key", "part", "block", "blocks").join(inside, "key", "left")
    placed = placed.withColumn("label", F.coalesce("label", "key"))
    heads = placed.groupBy("part", "block", "label").agg(F.count("*").alias("n"), F.min("blocks").alias("blocks"))
    heads = heads.groupBy("part", "block").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("n", "label", "blocks")), asc=False), 1, main).alias("top")
    )
    heads = heads.select("part", F.explode("top").alias("t")).select("part", F.col("t.label").alias("key"), "t.blocks")
    rooms = F.ceil(F.col("blocks") * main / BLOCK)
    heads = heads.withColumn("g", F.xxhash64("part", F.pmod(F.xxhash64("key"), rooms))).select("key", "g")
    texts = large.select("key", "text")
    among = _grouped(texts.join(heads, "key").select("g", "key", "text")).mapInArrow(_links(threshold, size), TIES)
    ties = saved(ties.unionByName(among))

    labels = components(ties).withColumnsRenamed({"node": "key", "root": "label"})
    rows = large.select("key", "part", "text").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    counts = rows.groupBy("part", "label").count()
    largest = counts.groupBy("part").agg(
        F.max(F.struct("count", "label")).alias("top"), F.sum("count").alias("all"), F.count("*").alias("labels")
    )
    open_parts = largest.where("labels > 1").select(
        "part",
        F.col("top.label").alias("main"),
        F.ceil(F.col("top.count") / BLOCK).alias("mains"),
        F.ceil((F.col("all") - F.col("top.count")) / BLOCK).alias("rests"),
    )
    rows = rows.join(open_parts, "part")
    own = F.pmod(F.xxhash64("key", F.lit(1)), F.when(F.col("label") == F.col("main"), F.col("mains")).otherwise(F.col("rests")))
    # a block of the rest meets each block of the rest and of the main part once
    rest = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("rests") - 1),
        lambda j: F.xxhash64("part", F.lit("r"), F.least(j, own), F.greatest(j, own)),
    )
    with_main = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("mains") - 1), lambda j: F.xxhash64("part", F.lit("m"), own, j)
    )
    as_main = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("rests") - 1), lambda i: F.xxhash64("part", F.lit("m"), i, own)
    )
    meets = F.when(F.col("label") == F.col("main"), as_main).otherwise(F.concat(rest, with_main))
    pairs = rows.select(F.explode(F.array_distinct(meets)).alias("g"), "key", "text")
    return saved(ties.unionByName(_grouped(pairs).mapInArrow(_links(threshold, size), TIES)))
