"""A corpus in five stages: quality, line dedup, near-duplicates, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir), reads all that the one before it kept, and returns a DataFrame that is
written as Parquet before the next one reads it. All but the last return the columns of ``documents``.
"""

from pyspark.sql import functions as F

from threatflow.llm import lines, minhash, mixing, quality
from threatflow.llm.queries import QUALITY_SCORE, bpe_columns
from threatflow.llm.shared import WORD, stored, table, text_of


def keep_good(spark, docs, sf_dir):
    """Documents that the quality model accepts; it is trained as in the query, on labels that aren't held out."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(F.col("text"), model) >= QUALITY_SCORE)


def drop_repeated_lines(spark, docs, sf_dir):
    """Documents without the lines that repeat an earlier one; a document may end up empty."""
    cleaned = lines.dedup(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else cleaned


def keep_one_of_group(spark, docs, sf_dir):
    """The document of least id of each group of near-duplicates over five-word shingles.

    Rows without an id are not compared and stay; rows that repeat an id stay or go together.
    """
    kept = minhash.near_duplicates(docs, size=5).where("kept").select("doc_id").distinct()
    return docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(docs.columns).unionByName(
        docs.where("doc_id is null")
    )


def mix_sources(spark, docs, sf_dir):
    """The mix of all sources: a row for each time a document is taken, shard after shard, each in its drawn order.

    Rows travel in one column, so columns of any name come through.
    """
    words = F.regexp_count(text_of("text"), F.lit(WORD)).alias("size")
    mixed = mixing.mix(docs.select("doc_id", "source", words, F.struct(*docs.columns).alias("row")), "size")
    placed = mixed.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")
    return placed.select("row.*").select(docs.columns)


def encode(spark, docs, sf_dir):
    """Ids of every taken document, and whether they decode to its text."""
    coded = bpe_columns(docs.select("doc_id", "source", "text"))
    return coded.select(
        "doc_id",
        "source",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        (F.col("decoded") == text_of("text").cast("binary")).alias("restored"),
    )


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("minhash", keep_one_of_group),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Trained scores and hashes of shingles have no counterpart in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
