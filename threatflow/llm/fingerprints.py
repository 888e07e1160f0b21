"""Document fingerprints: bottom-k sketches of shingle hashes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from threatflow.llm.shared import BLANKS

#: Hashes kept; resemblance has a standard error of at most 1 / (2 * sqrt(K)).
K = 128
WORDS = 5
TWO_64 = 18446744073709551616.0


def words(text):
    """The words of a text; put the result in a column before ``sketch`` uses it."""
    trimmed = F.regexp_replace(text, rf"^{BLANKS}|{BLANKS}$", "")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, BLANKS)
    )


def sketch(word_column, k=K, size=WORDS):
    """The ``k`` least distinct hashes of the shingles of ``size`` words, in order.

    Fewer words than that make one shingle, no words none. A text with at most ``k`` different
    shingles keeps them all, so its sketch is exact.
    """
    w = F.col(word_column)
    last = F.greatest(F.size(w) - size, F.lit(0))
    hashes = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)])
    )
    hashes = F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(hashes)
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a, b, k=K):
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a, b, k=K):
    """Estimated Jaccard likeness of two shingle sets, 0 to 1; exact where both sketches are whole.

    Two empty sets are alike (1), an empty and another are not (0).
    """
    together = F.array_union(a, b)
    whole = (F.size(a) < k) & (F.size(b) < k)
    least = F.when(whole, together).otherwise(F.slice(F.sort_array(together), 1, k))
    common = F.size(F.array_intersect(F.array_intersect(a, b), least))
    return F.when(F.size(together) == 0, 1.0).otherwise(common / F.size(least))


def distinct_shingles(a, k=K):
    """Estimated number of different shingles; exact below ``k``."""
    share = (F.get(a, F.lit(k - 1)).cast("double") + TWO_64 / 2) / TWO_64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a, b, k=K):
    """Estimated share of the first text's shingles that the second has, 0 to 1; 1 if the first has none."""
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), j / (1 + j) * (na + nb) / na))


def merged_by(docs, key, sketch_column, k=K):
    """One sketch per key, over all its rows: columns ``key`` and ``sketch_column``.

    Ranks hashes in each key; Spark keeps only ``k`` per key and task before the shuffle, so a key
    with many rows stays cheap. Keys without any hash are left out.
    """
    hashes = docs.select(key, F.explode(sketch_column).alias("_h")).distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_h"))
    least = hashes.withColumn("_r", rank).where(F.col("_r") <= k)
    return least.groupBy(key).agg(F.sort_array(F.collect_list("_h")).alias(sketch_column))


def fingerprint(docs, text, into="sketch", k=K, size=WORDS):
    """Add the sketch of a text column. Nulls read as empty; other columns stay."""
    held = "_words"
    while held in docs.columns:
        held += "_"
    return docs.withColumn(held, words(F.col(text))).withColumn(into, sketch(held, k, size)).drop(held)


def shown(a):
    """A sketch as text: its hashes, joined by commas."""
    return F.array_join(a.cast("array<string>"), ",")
