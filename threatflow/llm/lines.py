"""Line dedup: an exact set-similarity join over the lines of all documents."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from threatflow.llm.shared import listed, stored
from threatflow.plans.ordered import number_rows
from threatflow.plans.ranges import unused
from threatflow.plans.sizes import broadcast_if_small

#: Buckets that words are counted in, for their rarity; levels of rarity, an octave each.
BUCKETS, LEVELS = 1 << 16, 16
#: Bits of the map of wanted lines for each of them, and the most that the map has.
BITS_EACH, BITS = 16, 1 << 27
#: Words from which on a set has four words of parity bits besides the one that all have.
LONG = 110
#: Places in the prefix, from its first to its last word, whose words first find each line likely partners.
PLACES = 4
#: Lines just before a line with the same word that are tried, besides the first one.
BEFORE = 4
#: Likely partners that are confirmed for each line.
PARTNERS = 3
#: Rows of one word that a task looks at together when partners are first sought.
HOT = 1 << 17


def told_apart(docs, text, key, no):
    """The documents with a column ``no``: 0, or for rows that share a key with another text the number of their text.

    Texts are known by a hash; only those of keys that have several are counted.
    """
    mark, place = F.xxhash64(F.lit(1), text), unused(docs, "_text")
    keyed = docs.select(F.col(key).alias("_key"), mark.alias("_mark")).where("_key is not null")
    several = stored(keyed.groupBy("_key").agg(F.min("_mark").alias("lo"), F.max("_mark").alias("hi")).where("lo <> hi").select("_key"))
    if several.isEmpty():
        return docs.withColumn(no, F.lit(0).cast("bigint"))
    marks = keyed.join(broadcast_if_small(several), "_key", "left_semi").distinct()
    numbered = number_rows(marks, ["_key"], ["_mark"], no).where(F.col(no) > 1)
    theirs = broadcast_if_small(stored(numbered.select(F.struct("_key", "_mark").alias(place), (F.col(no) - 1).alias(no))))
    rows = docs.join(theirs, F.struct(F.col(key).alias("_key"), mark.alias("_mark")) == F.col(place), "left")
    return rows.withColumn(no, F.coalesce(no, F.lit(0).cast("bigint"))).drop(place)


def lines_of(docs, text, key):
    """Rows (doc_id, line_no, line), one per line; null texts have none.

    The number of the row's text (column ``_no``, see ``told_apart``) stands above the lower 32 bits of ``line_no``.
    """
    at = F.posexplode(F.split(F.col(text), "\n"))
    some = docs.select(F.col(key).cast("bigint").alias("doc_id"), "_no", at.alias("line_no", "line"))
    return some.select("doc_id", F.shiftleft("_no", 32).bitwiseOR(F.col("line_no").cast("bigint")).alias("line_no"), "line")


def _words(line):
    """The words of a line; may hold empty ones. Blanks become spaces first, as splitting at one sign is quick."""
    for blank in "\t\x0b\x0c\r":
        line = F.replace(line, F.lit(blank), F.lit(" "))
    return F.split(line, " ")


def rarity(lines):
    """How often words occur, by hash bucket: a constant of packed levels, and the octave that level 0 ends at.

    Levels are octaves below that of the most frequent bucket, the rarest words share the lowest. Sixteen levels
    lie in one number, so plans that hold them stay short.
    """
    words = lines.select(F.explode(_words(F.col("line"))).alias("w")).where("w <> ''")
    counted = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b")).count()
    octaves = counted.select("b", F.floor(F.log2("count")).cast("int").alias("octave")).collect()
    lowest = max(max((r.octave for r in octaves), default=0) - LEVELS + 1, 0)
    packed = [0] * (BUCKETS // 16)
    for row in octaves:
        packed[row.b % (BUCKETS // 16)] |= max(row.octave - lowest, 0) << (row.b // (BUCKETS // 16) * 4)
    return listed(p - (1 << 64) if p >> 63 else p for p in packed), lowest


def _tokens(line, ranks):
    """A line's different words as whole numbers, the rarest first: level of rarity above 56 bits of the hash."""
    hashes = F.transform(F.array_remove(_words(line), ""), lambda w: F.xxhash64(w))

    def keyed(h):
        # the lowest twelve bits of a bucket choose the number, the next four the level in it
        packed = F.get(ranks, h.bitwiseAND(F.lit(BUCKETS // 16 - 1)).cast("int"))
        place = F.shiftright(h, 10).bitwiseAND(F.lit(60)).cast("int")
        level = F.call_function("shiftright", packed, place).bitwiseAND(F.lit(15))
        return F.shiftleft(level, 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    return F.sort_array(F.array_distinct(F.transform(hashes, keyed)))


def _filtered(lines):
    return lines.where(F.btrim("line", F.lit(" \t\n\x0b\x0c\r")) != "")


def _likeable(x, y, percent, apart=0):
    """Whether two sets can be alike, from their sizes and parities, if they differ in ``apart`` other words.

    Alike sets differ in at most a share of their sizes, and each word in which two sets differ flips one
    parity bit: of 64, and for two long sets, whose differences would fill those, of 256.
    """
    nx, ny = x["n"], y["n"]
    few = (100 - percent) * (nx + ny)
    apart = F.bit_count(x["parity"].bitwiseXOR(y["parity"])) + apart
    wide = sum(F.bit_count(x["wide"][w].bitwiseXOR(y["wide"][w])) for w in "abcd")
    return (
        (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny))
        & ((100 + percent) * apart <= few)
        & F.coalesce((100 + percent) * wide <= few, F.lit(True))
    )


def _pairs_with_sets(pairs, docs, text, key, ranks, percent):
    """The pairs whose sets' exact Jaccard likeness is at least ``percent``.

    Only wanted lines of wanted documents are read as words again: a bit map, sized by their number, lets them
    through, with some others, which the join then leaves out.
    """
    places = pairs.select(F.col("xd").alias("d"), F.col("xl").alias("l")).union(pairs.select("yd", "yl"))
    bits = 1 << 16
    while bits < min(BITS, 2 * BITS_EACH * pairs.count()):
        bits *= 2
    spot = lambda d, n: F.pmod(F.xxhash64(d, n), F.lit(bits))
    marks = places.select(F.explode(F.array(spot(F.col("d"), F.col("l")), spot(F.col("d"), F.lit(-1)))).alias("s"))
    found = marks.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(_bit(F.col("s"))).alias("bits"))
    # one row with all words in order; as a subquery it is in no plan's text
    every = docs.sparkSession.range(bits // 64).select(F.col("id").alias("w")).join(found, "w", "left")
    line = F.array_sort(F.collect_list(F.struct("w", F.coalesce("bits", F.lit(0)).alias("bits"))))
    map_of = stored(every.agg(F.transform(line, lambda e: e["bits"]).alias("map"))).scalar()

    def marked(d, n):
        place = spot(d, n)
        return F.call_function("bit_get", F.get(map_of, F.shiftright(place, 6).cast("int")), F.pmod(place, F.lit(64)).cast("int")) == 1

    some = docs.where(marked(F.col(key).cast("bigint"), F.lit(-1)))
    let = _filtered(lines_of(some, text, key).where(marked(F.col("doc_id"), F.col("line_no"))))
    sets = let.select("doc_id", "line_no", _tokens(F.col("line"), ranks).alias("set"))
    sets = sets.withColumn("parity", _parity("set"))
    sx = sets.select(F.col("doc_id").alias("xd"), F.col("line_no").alias("xl"), F.col("parity").alias("xp"), F.col("set").alias("xs"))
    sy = sets.select(F.col("doc_id").alias("yd"), F.col("line_no").alias("yl"), F.col("set").alias("ys"))
    both = pairs.join(sx, ["xd", "xl"]).join(sy, ["yd", "yl"])
    common = F.size(F.array_intersect("xs", "ys"))
    return both.where((100 + percent) * common >= percent * (F.size("xs") + F.size("ys"))).select("xd", "xl", "xp").distinct()


def _bit(key):
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(key, F.lit(64)).cast("int"))


def _parity(column):
    return F.aggregate(F.col(column), F.lit(0).cast("bigint"), lambda s, k: s.bitwiseXOR(_bit(k)))


def _wide(column):
    """Parities of the words of four kinds, for long sets; null for others."""
    none = F.lit(0).cast("bigint")

    def flip(state, k):
        kind, bit = F.pmod(F.shiftright(k, 6), F.lit(4)), _bit(k)
        return F.struct(
            *[F.when(kind == i, state[w].bitwiseXOR(bit)).otherwise(state[w]).alias(w) for i, w in enumerate("abcd")]
        )

    whole = F.aggregate(F.col(column), F.struct(*[none.alias(w) for w in "abcd"]), flip)
    return F.when(F.size(column) >= LONG, whole)


def _later(docs, text, key, percent):
    """Places (doc_id, line_no) of the lines that repeat an earlier one, exactly or nearly.

    A line goes if a line before it, in the order of (key, text's number, line number), has a word set of Jaccard
    likeness ``percent`` / 100 or more, whether that line itself stays or not. Equal sets are one class, placed
    where they first occur. Words are ordered by rarity; alike sets share a word among the first
    n - ceil(n * percent / 100) + 1 of each. Classes that share such a word are compared by length, by position
    (what can be shared if it is the first shared word) and by parity bits, and confirmed on their whole sets.

    So that many versions of one line don't make pairs with each other, a class is first compared with the first
    and the closest class before it at its rarest words; one confirmed partner settles it. Only classes
    without one, and those whose partner proves unlike, are then joined with all classes before them.
    Lines without words stay, rows without a key are left out. Rows with equal key and text are the same place.
    """
    docs = docs.where(F.col(key).isNotNull()).select(key, text, "_no")
    lines = lines_of(docs, text, key)
    ranks, lowest = rarity(_filtered(lines))
    rows = _filtered(lines).select("doc_id", "line_no", _tokens(F.col("line"), ranks).alias("set"))
    prefix = F.slice("set", F.lit(1), F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1)
    short = F.transform(
        prefix, lambda k: F.shiftleft(F.shiftright(k, 56), 32).bitwiseOR(k.bitwiseAND(F.lit(0xFFFFFFFF)))
    )
    placed = stored(
        rows.withColumn("n", F.size("set"))
        .withColumn("parity", _parity("set"))
        .select("doc_id", "line_no", F.xxhash64("set").alias("hash"), "parity", "n", _wide("set").alias("wide"), short.alias("prefix"))
    )
    first = F.min(F.struct("doc_id", "line_no")).alias("first")
    classes = stored(
        placed.groupBy("hash", "parity", "n")
        .agg(first, F.any_value("wide").alias("wide"), F.any_value("prefix").alias("prefix"))
        .select("hash", "parity", "n", "first.doc_id", "first.line_no", "wide", "prefix")
    )

    likely = stored(_likely_partners(classes, percent, lowest))
    confirmed = stored(_pairs_with_sets(likely, docs, text, key, ranks, percent))
    settled = classes.join(
        broadcast_if_small(confirmed.select(F.col("xd").alias("doc_id"), F.col("xl").alias("line_no"), F.col("xp").alias("parity"), F.lit(True).alias("gone"))),
        ["doc_id", "line_no", "parity"],
        "left",
    )
    more = stored(_all_partners(settled.withColumn("gone", F.coalesce("gone", F.lit(False))), percent))
    near = confirmed.unionByName(_pairs_with_sets(more, docs, text, key, ranks, percent))

    near = near.select(F.col("xd").alias("doc_id"), F.col("xl").alias("line_no"), F.col("xp").alias("parity"))
    firsts = classes.join(near.withColumn("near", F.lit(True)), ["doc_id", "line_no", "parity"], "left")
    firsts = firsts.select("hash", "parity", "n", F.struct("doc_id", "line_no").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    every = placed.select("doc_id", "line_no", "hash", "parity", "n").join(firsts, ["hash", "parity", "n"])
    return every.where(F.col("near") | (F.struct("doc_id", "line_no") != F.col("first"))).select("doc_id", "line_no").distinct()


def later_lines(docs, text="text", key="doc_id", percent=80, out="removed"):
    """The documents with an array ``out`` of the numbers of those lines that repeat an earlier one; null if none does.

    Lines are numbered from 0, earlier ones are those of lesser keys and lines before them in the text; see ``_later``.
    Rows with equal key and text lose the same lines. Where a key has several texts, these are told apart, and one
    comes before the other. Rows without a key or text have none; other columns stay, whatever their names.
    """
    no, place = unused(docs, "_no"), unused(docs, "_place")
    rows = told_apart(docs, text, key, no)
    gone = _later(rows.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.col(no).alias("_no")), "text", "doc_id", percent)
    named = gone.groupBy(F.struct("doc_id", F.shiftright("line_no", 32).alias("no")).alias(place)).agg(
        F.sort_array(F.collect_set(F.col("line_no").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))).alias(out)
    )
    mine = F.struct(F.col(key).cast("bigint").alias("doc_id"), F.col(no).alias("no"))
    return rows.join(named, mine == F.col(place), "left").select(*docs.columns, out)


def _likely_partners(classes, percent, lowest):
    """For each class a few classes before it that may be alike: the closest by parity.

    Words spread over the prefix find them, as the rarest may be those in which versions of a line differ.
    """
    last = F.size("prefix") - 1
    words = F.array_distinct(F.array(*[F.get("prefix", F.floor(last * i / (PLACES - 1)).cast("int")) for i in range(PLACES)]))
    rows = classes.select(
        F.explode(words).alias("t"), F.struct("doc_id", "line_no", "n", "parity", "wide").alias("x"), "hash"
    )
    # a word's level bounds how often it occurs; words that may be hot are dealt to several groups
    dealt = F.pow(F.lit(2.0), F.shiftright("t", 32) + lowest + 1) / HOT
    rows = rows.withColumn("part", F.when(dealt > 1, F.pmod("hash", F.ceil(dealt).cast("bigint"))).otherwise(0))
    before = Window.partitionBy("t", "part").orderBy("x")
    rows = rows.select(
        "x", F.first("x").over(before).alias("y0"), *[F.lag("x", i).over(before).alias(f"y{i}") for i in range(1, BEFORE + 1)]
    )
    y = F.explode(F.array_distinct(F.array(*[f"y{i}" for i in range(BEFORE + 1)]))).alias("y")
    tried = rows.select("x", y).where(F.col("y").isNotNull() & (F.struct("y.doc_id", "y.line_no") < F.struct("x.doc_id", "x.line_no")))
    x, y = ({n: F.col(f"{s}.{n}") for n in ("n", "parity", "wide", "doc_id", "line_no")} for s in "xy")
    apart = F.bit_count(x["parity"].bitwiseXOR(y["parity"]))
    found = F.struct(apart.alias("apart"), F.col("y.doc_id").alias("d"), F.col("y.line_no").alias("l"))
    best = (
        tried.where(_likeable(x, y, percent))
        .groupBy(x["doc_id"].alias("xd"), x["line_no"].alias("xl"))
        .agg(F.slice(F.array_sort(F.collect_set(found)), 1, PARTNERS).alias("ys"))
        .select("xd", "xl", F.explode("ys").alias("y"))
    )
    return best.select("xd", "xl", F.col("y.d").alias("yd"), F.col("y.l").alias("yl"))


def _all_partners(classes, percent):
    """Pairs of each class that is not ``gone`` with all classes before it that may be alike."""
    def step(state, word):
        return F.struct(
            state["rest"].bitwiseXOR(_bit(word)).alias("rest"), F.concat(state["out"], F.array(state["rest"])).alias("out")
        )

    none = F.array().cast("array<bigint>").alias("out")
    # the parity of the words from each place on
    rests = F.aggregate("prefix", F.struct(F.col("parity").alias("rest"), none), step)["out"].alias("rest")
    rows = classes.select(
        "doc_id", "line_no", "wide", (F.col("n") * 2 + F.col("gone").cast("int")).alias("size"),
        F.posexplode(F.arrays_zip(F.col("prefix").alias("t"), rests)).alias("i", "e"),
    ).select("doc_id", "line_no", "wide", "size", "i", F.col("e")["t"].alias("t"), F.col("e")["rest"].alias("rest"))

    def side(s):
        return rows.select("t", *[F.col(c).alias(s + c) for c in ("doc_id", "line_no", "rest", "wide", "size", "i")])

    x, y = (
        {"n": F.shiftright(s + "size", 1), "parity": F.col(s + "rest"), "wide": F.col(s + "wide"), "i": F.col(s + "i"), "at": F.struct(s + "doc_id", s + "line_no")}
        for s in "xy"
    )
    # one of the shared words is the first: at that one, all others come after it and all words before it differ
    shared = F.least(x["n"] - x["i"], y["n"] - y["i"])
    gone = F.col("xsize").bitwiseAND(F.lit(1))
    matched = side("x").join(side("y"), "t")
    kept = matched.where(
        _likeable(x, y, percent, x["i"] + y["i"])
        & ((100 + percent) * shared >= percent * (x["n"] + y["n"]) * (1 - gone) + (200 * gone) * (x["n"] + y["n"]))
        & (y["at"] < x["at"])
    )
    return kept.select(
        F.col("xdoc_id").alias("xd"), F.col("xline_no").alias("xl"), F.col("ydoc_id").alias("yd"), F.col("yline_no").alias("yl")
    ).distinct()


def dedup(docs, text="text", key="doc_id", percent=80):
    """The documents with later repeats of lines removed from ``text``; see ``later_lines``.

    Remaining lines keep their order and are joined by line breaks; a text all of whose lines go is empty.
    Null texts and null keys stay as they are, all columns stay.
    """
    gone = unused(docs, "_gone")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda _, i: ~F.array_contains(gone, i)), "\n")
    named = later_lines(docs, text, key, percent, gone)
    return named.select(*[F.when(F.col(gone).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text else c for c in docs.columns])
