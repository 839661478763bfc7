"""The corpus pipeline: language ID, near duplicates, repeated passages, benchmark contamination, piece encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. Its result is written as Parquet
and read back as the next one's docs. Decisions hold for rows, told apart by doc_id (null like any other) and a hash of what they
hold; a null text has no language and goes in the first stage; empty tables give empty tables; further columns of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm import decontaminate, language_id, sentence_pieces, simhash, substring_dedup
from veristrata.llm.common import materialise, read, row_key, without
from veristrata.llm.queries import PIECES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Tells rows of one doc_id apart by all that a stage may look at.
KEY = ["text", "lang", "source"]


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the others go, null doc_ids like any."""
    judged = language_id.identify_documents(docs.withColumn("_key", row_key(*KEY)), ["doc_id", "_key"])
    return without(docs.select(COLUMNS), materialise(judged.where("not accepted").select("doc_id", "_key").distinct(), "rejected"), row_key(*KEY))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: that with the least doc_id (null after all others), and of rows with that doc_id the one with the least key; of wholly equal rows one stays."""
    found = materialise(simhash.simhash_components(docs.withColumn("_key", row_key(*KEY)), carry=["_key"]).select("component_fp", F.col("doc_id").isNull().alias("_last"), "doc_id", "_key"), "components")
    mark = F.struct("_last", "doc_id", "_key")
    stays = found.groupBy("component_fp").agg(F.min(mark).alias("_stays"))
    stays = materialise(stays.select("_stays.doc_id", "_stays._key"), "stays")
    marked = found.groupBy("doc_id", "_key").agg(F.count(F.lit(1)).alias("_n"))
    of = marked.join(stays.withColumnRenamed("doc_id", "_id").withColumnRenamed("_key", "_kept"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_kept")), "left")
    of = materialise(of.select("doc_id", "_key", "_n", F.col("_kept").isNull().alias("_goes")), "decided")
    kept = without(docs.select(COLUMNS), of.where("_goes").select("doc_id", "_key"), row_key(*KEY))
    again = of.where("not _goes and _n > 1").select("doc_id", "_key")
    if again.isEmpty():
        return kept
    repeated = kept.join(again.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_listed")), kept["doc_id"].eqNullSafe(F.col("_id")) & (row_key(*KEY) == F.col("_listed")), "left_semi")
    return without(kept, again, row_key(*KEY)).unionByName(repeated.dropDuplicates(["doc_id", "text", "lang", "source"]))


def stage_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of windows that a document with a smaller doc_id has too; texts that lose no word stay as they are, and documents without a word left go."""
    out = substring_dedup.substring_dedup(docs, carry=["lang", "source", "n_chars"], tidy=False).where("n_words > n_removed or n_removed = 0")
    length = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", length.alias("n_chars"))


def stage_contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with benchmark items; each row is judged for itself."""
    found = decontaminate.contamination(docs.withColumn("_key", row_key(*KEY)), read(spark, sf_dir, "benchmark"), ["_key"])
    return without(docs.select(COLUMNS), materialise(found.where("contaminated").select("doc_id", "_key").distinct(), "contaminated"), row_key(*KEY))


def stage_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (the pieces of the text) and whether they decode to the text."""
    out = sentence_pieces.sentence_pieces(docs, PIECES, decode=sentence_pieces.COMPARED)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "round_trip")


STAGES = [
    ("language_id", stage_language),
    ("near_duplicates", stage_near_duplicates),
    ("repeated_passages", stage_repeated_passages),
    ("contamination", stage_contamination),
    ("sentence_pieces", stage_pieces),
]

#: SQL can express neither the language models nor XXH64 fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
