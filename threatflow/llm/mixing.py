"""Mix sources to target weights: exact block quotas, split among shards by a random tree."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from threatflow.llm.shared import key_of, saved
from threatflow.plans.ranges import partitions, unused

#: Coprime to any smaller number of blocks, so a multiple of it permutes them.
STRIDE = 1000003
TWO_53 = 9007199254740992.0


def targets(sources, weight, cap=3):
    """Add ``target`` to a table of (source_size, ...): shares of the whole size by ``weight``.

    No target exceeds ``cap`` times its source's size; the excess goes to the others by weight.
    Sources sorted by how early they fill up: those before the first that stays below its
    cap are full, the rest share what is left. One row per source.
    """
    size, full = F.col("source_size"), F.col("source_size") * cap
    by_ratio = Window.orderBy(full / weight, "key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum(size).over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0))) / (
        F.sum(weight).over(everything) - F.coalesce(F.sum(weight).over(before), F.lit(0))
    )
    return (
        sources.withColumn("_level", level)
        .withColumn("_at", F.row_number().over(by_ratio))
        .withColumn("_open", F.when(F.col("_level") < full / weight, F.col("_at")))
        .withColumn("_first", F.min("_open").over(everything))
        .withColumn("_shared", F.min(F.when(F.col("_at") == F.col("_first"), F.col("_level"))).over(everything))
        .withColumn(
            "target",
            F.when(F.col("_first").isNull() | (F.col("_at") < F.col("_first")), full.cast("double")).otherwise(
                F.col("_shared") * weight
            ),
        )
        .drop("_level", "_at", "_open", "_first", "_shared")
    )


def _drawn(counts, taken, seed):
    """How many of each source's ``counts`` blocks are among ``taken`` drawn from all: one draw of the
    multivariate hypergeometric law, by selection sampling (a block is drawn with the probability
    draws left / blocks left)."""

    def chance(source, block):
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("low"), F.col("width"), source, block), 11)
        return bits / F.lit(TWO_53)

    def one_source(state, entry):
        def one_block(s, block):
            hit = chance(entry["no"], block) * s["left"] < s["draws"]
            return F.struct(
                (s["left"] - 1).alias("left"),
                F.when(hit, s["draws"] - 1).otherwise(s["draws"]).alias("draws"),
                F.when(hit, s["got"] + 1).otherwise(s["got"]).alias("got"),
            )

        begin = F.struct(state["left"].alias("left"), state["draws"].alias("draws"), F.lit(0).cast("bigint").alias("got"))
        blocks = F.when(entry["n"] > 0, F.sequence(F.lit(1).cast("bigint"), entry["n"])).otherwise(
            F.array().cast("array<bigint>")
        )
        end = F.aggregate(blocks, begin, one_block)
        return F.aggregate(
            F.array(end),
            state,
            lambda _, e: F.struct(
                e["left"].alias("left"), e["draws"].alias("draws"), F.concat(state["out"], F.array(e["got"])).alias("out")
            ),
        )

    whole = F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, e: s + e["n"])
    state = F.struct(
        whole.alias("left"), taken.cast("bigint").alias("draws"), F.array().cast("array<bigint>").alias("out")
    )
    return F.aggregate(counts, state, one_source)["out"]


def quota_tree(sources, shards, seed):
    """Split each source's ``blocks`` among shards: rows (no, cuts), ``cuts`` the blocks of all shards up
    to each one.

    The root holds all quotas; a node hands its left half of the shards a hypergeometric draw of its
    blocks and the rest to the right, so every source's blocks are dealt exactly once and shards get
    equal numbers of blocks. Work follows sources x shards and the fixed number of blocks.
    """
    entry = F.struct(F.col("no").cast("bigint").alias("no"), F.col("blocks").cast("bigint").alias("n"))
    nodes = sources.agg(F.array_sort(F.collect_list(entry)).alias("counts")).select(
        F.lit(0).cast("bigint").alias("low"), F.lit(shards).cast("bigint").alias("width"), "counts"
    )
    width = shards
    while width > 1:
        left_width = F.floor(F.col("width") / 2)
        whole = F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, e: s + e["n"])
        nodes = nodes.withColumn("lw", left_width).withColumn(
            "got", _drawn(F.col("counts"), F.round(whole * F.col("lw") / F.col("width")), seed)
        )

        def side(left):
            low = F.col("low") if left else F.col("low") + F.col("lw")
            wide = F.col("lw") if left else F.col("width") - F.col("lw")
            part = F.zip_with(
                "counts",
                "got",
                lambda e, g: F.struct(e["no"].alias("no"), (g if left else e["n"] - g).alias("n")),
            )
            return F.struct(low.alias("low"), wide.alias("width"), part.alias("counts"))

        nodes = nodes.select(F.explode(F.array(side(True), side(False))).alias("node")).select("node.*")
        nodes = nodes.where("width > 0")
        width = (width + 1) // 2
    dealt = nodes.select("low", F.explode("counts").alias("e")).select("low", "e.no", "e.n")
    upto = Window.partitionBy("no").orderBy("low").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        dealt.withColumn("upto", F.sum("n").over(upto))
        .groupBy("no")
        .agg(F.array_sort(F.collect_list("upto")).alias("cuts"))
    )


def mixed(docs, size, source="source", key="doc_id", weight=None, shards=16, blocks_per_shard=64, cap=3, seed=0):
    """Add to every row its source's ``source_size`` and ``target``, and ``takes``: one entry
    (copy, shard, block, place) for each time the mix takes the row.

    Sources, ordered by code point with null last, share 100 % of all sizes by ``weight`` (a function of
    the source's number from 0; default 1, 2, 3, repeating), at most ``cap`` times their size. A source's
    rows in the order of a hash of their key form a line as long as the source, repeated ``cap`` times;
    the mix takes the line up to the target, to the nearest row. The line is cut into blocks; the
    quota tree deals each source's blocks to shards, which draw permuted blocks, no block twice. In a
    shard, rows are read in the order of ``place``, a hash.

    Rows of size 0 or null are never taken, null sources are a source, repeated rows are rows, an empty table gives no rows,
    and columns named like the results are replaced. A large source spreads over ranges of the
    hash; only one row per source and range (16 ** digits of them) is gathered.
    """
    if shards * blocks_per_shard * cap + shards >= STRIDE:
        raise ValueError("too many blocks for the permutation")
    weight = weight or (lambda number: number % 3 + 1)
    results = {"source_size", "target", "takes"} - {size, source, key}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in results])
    sk, hashed, part, units = (unused(docs, n) for n in ("_source", "_hash", "_part", "_units"))
    digits = 1
    while 16**digits < 2 * partitions(docs):
        digits += 1
    rows = (
        docs.withColumn(sk, key_of(source))
        .withColumn(hashed, F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
        .withColumn(part, F.substring(hashed, 1, digits))
        .withColumn(units, F.coalesce(F.col(size).cast("bigint"), F.lit(0)))
    )
    parts = saved(
        rows.groupBy(F.col(sk).alias("key"), F.col(part).alias("part")).agg(
            F.sum(units).alias("units"), F.min(source).alias("name")
        )
    )
    sources = parts.groupBy("key").agg(F.sum("units").alias("source_size"), F.min("name").alias("name"))
    number = F.row_number().over(Window.orderBy(F.col("name").asc_nulls_last())) - 1
    sources = sources.withColumn("no", number)
    whole = F.sum("source_size").over(Window.partitionBy())
    sources = targets(sources.withColumn("weight", weight(F.col("no"))), F.col("weight"), cap)
    sources = sources.withColumn(
        "width", F.greatest(F.lit(1), F.ceil(whole / F.lit(shards * blocks_per_shard)))
    ).withColumn("blocks", F.ceil(F.col("target") / F.col("width")))
    sources = saved(sources)
    plan = sources.join(quota_tree(sources, shards, seed), "no")

    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.withColumn("begin", F.coalesce(F.sum("units").over(earlier), F.lit(0)))
    begins = begins.select("key", "part", "begin").join(
        plan.select("key", "no", "source_size", "target", "width", "blocks", "cuts"), "key"
    )
    begins = begins.select(
        F.col("key").alias(sk), F.col("part").alias(part), F.struct("begin", "no", "source_size", "target", "width", "blocks", "cuts").alias("_plan")
    )

    in_order = Window.partitionBy(sk, part).orderBy(hashed, F.col(key).asc_nulls_first(), units)
    running = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at, plan_of = unused(docs, "_at"), unused(docs, "_plan")
    placed = rows.join(begins.withColumnRenamed("_plan", plan_of), [sk, part]).withColumn(
        at, F.col(f"{plan_of}.begin") + F.sum(units).over(running) - F.col(units)
    )
    p = {n: F.col(f"{plan_of}.{n}") for n in ("no", "source_size", "target", "width", "blocks", "cuts")}

    def take(copy):
        place = p["source_size"] * copy + F.col(at)
        block = F.floor(place / p["width"])
        drawn = (block * STRIDE + p["no"]) % p["blocks"]
        return F.when(
            (F.col(units) > 0) & (2 * place + F.col(units) < 2 * p["target"]),
            F.struct(
                F.lit(copy).alias("copy"),
                F.size(F.filter(p["cuts"], lambda c: c <= drawn)).alias("shard"),
                block.alias("block"),
                F.xxhash64(F.lit(seed), F.lit(copy), F.col(hashed)).alias("place"),
            ),
        )

    takes = F.filter(F.array(*[take(c) for c in range(cap)]), lambda t: t.isNotNull())
    return placed.select(
        *docs.columns, p["source_size"].alias("source_size"), p["target"].alias("target"), takes.alias("takes")
    )


def mix(docs, size, **settings):
    """The mix itself: a row per taken copy, with ``shard`` and ``place``; see ``mixed``."""
    taken = mixed(docs, size, **settings)
    kept = [c for c in docs.columns if c.lower() not in ("shard", "place", "source_size", "target", "takes")]
    return taken.select(*kept, F.explode("takes").alias("_take")).select(*kept, "_take.shard", "_take.place")


def write_mix(mixture, path):
    """Write one folder per shard, rows shuffled inside."""
    mixture.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place").write.partitionBy(
        "shard"
    ).parquet(path)
