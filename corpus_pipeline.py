"""From raw documents to packed training sequences: five stages, each one operator of leafwright.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next
stage's docs. All but the last return the columns of documents; further columns of docs are left behind, whatever their
names. In every stage each row is a document of its own, repeated rows and null or repeated doc_ids included; texts are
read whole, however long; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.llm import langid, line_dedup, minhash, mixing, packing
from leafwright.llm.runtime import dropped, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; a null label is filled in with the language found.

    Goes: null and empty texts, texts without a letter, texts foreign to every language learned. Between languages that
    fit alike the first by name is filled in."""
    return langid.accepted(docs.select(*COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of two lines or more, and of any line of ten words or more, are cut; a document of which
    nothing is left goes. The first copy by doc_id (null last) and place stays.

    Null and empty texts have no lines and stay. Rows that repeat a doc_id and its text count as one document here, so
    they are no copies of each other; the next stage keeps one of them."""
    out = line_dedup.line_dedup(docs.select(*COLUMNS), min_run=2, alone=10)
    out = out.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the first row of the group.

    Rows are told apart by their place in the table, so one of several equal rows stays, whatever their doc_ids. Texts
    without words (null too) are in no group and stay."""
    keyed = stored(docs.select(F.monotonically_increasing_id().alias("key"), *COLUMNS))
    kept = minhash.near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("k"))
    return keyed.join(kept, F.col("key") == F.col("k"), "left_semi").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0 to 3 times.

    Null and empty texts have no words and are taken 0 times, since they bring a source no nearer to its target. The null
    source is a source. Rows are told apart by their place in the table, so equal rows are mixed each for itself."""
    keyed = stored(docs.select(F.monotonically_increasing_id().alias("key"), *COLUMNS))
    mixed = mixing.mix(keyed.select(F.col("key").alias("doc_id"), "source", "text"))
    copies = mixed.where("copies > 0 and size > 0").select(F.col("doc_id").alias("k"), F.col("copies").cast("int").alias("copies"))
    out = keyed.join(copies, F.col("key") == F.col("k"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, placed in sequences of at most 2048.

    A null or empty text is a document of its closing token alone; repeated rows are packed as often as they occur; a
    long text is cut into pieces of 2048, all of which are placed."""
    return packing.best_fit_packing(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packed", packed)]

#: No stage but the lines and the near-duplicates can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
