"""A store of pages and their sentences, read by title, by id or in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.functions import text as T
from veristrata.sources.tables import small


class PageStore:
    """pages (doc_id, title, key, norm) sorted by key, and sentences (doc_id, idx, sentence) sorted by doc_id, each a Parquet folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.pages, self.lines = spark.read.parquet(f"{folder}/pages"), spark.read.parquet(f"{folder}/sentences")

    @classmethod
    def build(cls, pages: DataFrame, sentences: DataFrame, folder: str) -> PageStore:
        """pages: doc_id, title; sentences: doc_id, idx, sentence. Files are range-partitioned, so a lookup reads those that can hold its keys."""
        keyed = pages.select("doc_id", "title", T.title_key(F.col("title")).alias("key"), T.title_norm(F.col("title")).alias("norm"))
        keyed.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{folder}/pages")
        sentences.select("doc_id", "idx", "sentence").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "idx").write.mode("overwrite").parquet(f"{folder}/sentences")
        return cls(pages.sparkSession, folder)

    def page_count(self) -> DataFrame:
        return self.pages.agg(F.count("*").alias("n_pages"))

    def scan(self) -> DataFrame:
        """(doc_id, title, sentences), without an order: sort where a result needs one."""
        held = self.lines.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "sentence"))), lambda x: x["sentence"]).alias("sentences"))
        return self.pages.select("doc_id", "title").join(held, "doc_id", "left").select("doc_id", "title", F.coalesce("sentences", F.array()).alias("sentences"))

    def ids(self, titles: DataFrame) -> DataFrame:
        """titles (title) with the doc_id of the page of that exact composed title, null if there is none."""
        asked = titles.withColumn("key", T.title_key(F.col("title")))
        return asked.join(self.pages.select("key", "doc_id"), "key", "left").drop("key")

    def sentences(self, ids: DataFrame) -> DataFrame:
        """The sentences of the pages with these ids (doc_id); unknown ids have none."""
        return self.lines.join(small(ids.select("doc_id").distinct()), "doc_id", "left_semi")

    def titles(self, ids: DataFrame) -> DataFrame:
        """(doc_id, title) of the known ones among ids."""
        return self.pages.select("doc_id", "title").join(small(ids.select("doc_id").distinct()), "doc_id", "left_semi")
