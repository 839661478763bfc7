"""Lexical retrieval: index tables, BM25, title matches, two-stage search and its features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veristrata.functions import text as T
from veristrata.sources.tables import is_small, small

K1, B = 1.2, 0.75
MOST_TF = 255
MOST_RUN = 8  # tokens of a title that is looked up in a claim
MOST_TITLES = 3


def token_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.explode(T.tokens(F.col(text))).alias("term"))


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf), not clipped."""
    return token_rows(docs).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def document_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, dl) of every document, those without tokens included."""
    return docs.select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("dl"))


def corpus_statistics(docs: DataFrame) -> DataFrame:
    """One row: documents, tokens, mean length, terms, postings and postings over the frequency cap."""
    lengths = document_lengths(docs).agg(F.count("*").alias("n_docs"), F.sum("dl").alias("n_tokens"), F.avg("dl").alias("avgdl"))
    entries = postings(docs).agg(F.countDistinct("term").alias("n_terms"), F.count("*").alias("n_postings"), F.count_if(F.col("tf") > MOST_TF).alias("n_clipped"))
    return lengths.crossJoin(entries).withColumns({"postings_per_doc": F.col("n_postings") / F.col("n_docs"), "tokens_per_doc": F.col("n_tokens") / F.col("n_docs")})


def terms(docs: DataFrame) -> DataFrame:
    """(term, df)."""
    return postings(docs).groupBy("term").agg(F.count("*").alias("df"))


def idf(df, n_docs):
    return F.when(df > 0, F.log1p((n_docs - df + 0.5) / (df + 0.5))).otherwise(0.0)


def asked_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, qtf) of queries (qid, text)."""
    return token_rows(queries, "qid").withColumnRenamed("doc_id", "qid").groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def corpus_rows(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, dl, term, tf) of the given terms (term), and a row with tf 0 for each document; a null text has no dl.

    The corpus is tokenised once and only asked terms are moved, dealt by document. Everything that is derived from this (counts,
    lengths, frequencies, scores) reads the same exchange; filters on tf can't slip below it and make it another.
    """
    held = docs.select("doc_id", T.tokens(F.col("text")).alias("t"))
    rows = held.select("doc_id", F.size("t").cast("long").alias("dl"), F.explode(F.concat(F.array(F.lit("")), F.coalesce("t", F.array().cast("array<string>")))).alias("term"))
    marked = terms.select("term").unionByName(terms.sparkSession.range(1).select(F.lit("").alias("term")))
    kept = rows.join(small(marked.distinct()), "term", "left_semi")
    return kept.repartition("doc_id").groupBy("doc_id", "dl", "term").agg(F.count_if(F.col("term") != "").alias("tf"))


def weights(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """(qid, term, avgdl, weight): idf of each asked term times its count in the query."""
    whole = rows.where("tf = 0").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    frequency = rows.where("tf > 0").groupBy("term").agg(F.count("*").alias("df"))
    return asked.join(frequency, "term").crossJoin(F.broadcast(whole)).select("qid", "term", "avgdl", (F.col("qtf") * idf(F.col("df"), F.col("n_docs"))).alias("weight"))


def bm25(queries: DataFrame, docs: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, doc_id, score) of every document that shares a term with a query (qid, text); each query term counts as often as the query has it."""
    asked = asked_terms(queries)
    return score(asked, corpus_rows(docs, asked.select("term").distinct()), k1, b)


def score(asked: DataFrame, rows: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, doc_id, score) from corpus rows. Rows lie by document, so scores are summed where they are."""
    weighted = weights(asked, rows)
    if is_small(asked):  # weighted has a row of fixed size for each of its rows at most
        weighted = F.broadcast(weighted)
    tf = F.least("tf", F.lit(MOST_TF))
    part = F.col("weight") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return rows.where("tf > 0").join(weighted, "term").groupBy("qid", "doc_id").agg(F.sum(part).alias("score"))


class Index:
    """A stored index: postings (term, doc_id, tf, dl) sorted by term, terms (term, df) and one row of counts, each a Parquet folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.postings, self.terms, self.meta = (spark.read.parquet(f"{folder}/{x}") for x in ("postings", "terms", "meta"))

    @classmethod
    def build(cls, docs: DataFrame, folder: str) -> Index:
        """Writes the index. Postings are range-partitioned by term, so a scan for a few terms skips files and row groups; the token sum of the postings must equal that of the documents."""
        spark = docs.sparkSession
        held = docs.select("doc_id", T.tokens(F.col("text")).alias("t"))
        rows = held.select("doc_id", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
        rows.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").select("term", "doc_id", "tf", "dl").write.mode("overwrite").parquet(f"{folder}/postings")
        posted = spark.read.parquet(f"{folder}/postings")
        posted.groupBy("term").agg(F.count("*").alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/terms")
        lengths = held.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg(F.size("t")), F.lit(0.0)).alias("avgdl"), F.coalesce(F.sum(F.size("t")), F.lit(0)).cast("long").alias("n_tokens"))
        counted = posted.agg(F.count("*").alias("n_postings"), F.coalesce(F.sum("tf"), F.lit(0)).alias("n_posted"))
        lengths.crossJoin(counted).coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")
        index = cls(spark, folder)
        found = index.meta.first()
        if found["n_tokens"] != found["n_posted"]:
            raise ValueError(f"{found['n_tokens']} tokens were read and {found['n_posted']} posted: the documents changed between the passes")
        return index

    def bm25(self, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
        """(qid, doc_id, score), as from the documents themselves."""
        asked = asked_terms(queries)
        wanted = small(asked.select("term").distinct())
        weighted = asked.join(self.terms.join(wanted, "term", "left_semi"), "term").crossJoin(F.broadcast(self.meta.select("n_docs", "avgdl"))).select("qid", "term", "avgdl", (F.col("qtf") * idf(F.col("df"), F.col("n_docs"))).alias("weight"))
        tf = F.least("tf", F.lit(MOST_TF))
        part = F.col("weight") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        return self.postings.join(F.broadcast(weighted) if is_small(asked) else weighted, "term").groupBy("qid", "doc_id").agg(F.sum(part).alias("score"))


def search(queries: DataFrame, docs: DataFrame, titles: DataFrame, sentences: DataFrame, pages: int = 25, k: int = 25, most_titles: int = MOST_TITLES, scored: DataFrame | None = None) -> DataFrame:
    """Both stages: pages by BM25 (scored, or over docs) behind the injected titles, then their best sentences (qid, doc_id, idx, rank, score)."""
    ranked = top(bm25(queries, docs) if scored is None else scored, pages)
    merged = merge_ranked(title_candidates(queries, titles), ranked, pages, most_titles) if most_titles else ranked.select("qid", "doc_id", "rank")
    return score_sentences(queries, merged, sentences, docs, k)


def with_text(found: DataFrame, sentences: DataFrame) -> DataFrame:
    """Found sentences with their text; one that isn't there raises."""
    joined = found.join(sentences.select("doc_id", "idx", F.col("sentence").alias("text")), ["doc_id", "idx"], "left")
    missing = F.raise_error(F.concat_ws(" ", F.lit("no sentence"), F.col("doc_id").cast("string"), F.col("idx").cast("string")))
    return joined.withColumn("text", F.when(F.col("text").isNull(), missing.cast("string")).otherwise(F.col("text")))


def top(scored: DataFrame, k: int, by: str = "qid", order: list | None = None) -> DataFrame:
    """The k best of each group by rounded score, then doc_id, with their rank; scores of zero are no results."""
    if k <= 0:
        raise ValueError("k must be positive")
    scored = scored.withColumn("score", F.round("score", 6)).where("score > 0")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*(order or [F.desc("score"), "doc_id"]))).cast("long")
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def title_candidates(claims: DataFrame, titles: DataFrame) -> DataFrame:
    """(qid, doc_id, pos): pages whose loose title is a run of up to MOST_RUN claim tokens; longest runs first, then the earliest, then the least doc_id."""
    held = claims.select("qid", T.tokens(F.col("text")).alias("t"))
    runs = held.select("qid", "t", F.explode(F.sequence(F.lit(1), F.lit(MOST_RUN))).alias("size")).where(F.size("t") >= F.col("size"))
    runs = runs.select("qid", "size", "t", F.explode(F.expr("sequence(1, size(t) - size + 1)")).alias("start"))
    runs = runs.select("qid", "size", "start", F.expr("array_join(slice(t, start, size), ' ')").alias("norm"))
    hits = runs.join(titles.select("norm", "doc_id").where("norm <> ''"), "norm")
    first = Window.partitionBy("qid", "doc_id").orderBy(F.desc("size"), "start")
    hits = hits.withColumn("n", F.row_number().over(first)).where("n = 1")
    return hits.select("qid", "doc_id", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("size"), "start", "doc_id")).cast("long").alias("pos"))


def merge_ranked(injected: DataFrame, ranked: DataFrame, n: int, most_titles: int = MOST_TITLES) -> DataFrame:
    """(qid, doc_id, rank): the first most_titles injected pages, then the ranked ones, each page once, cut at n."""
    both = injected.where(F.col("pos") <= most_titles).select("qid", "doc_id", F.lit(0).alias("src"), F.col("pos")).unionByName(ranked.select("qid", "doc_id", F.lit(1).alias("src"), F.col("rank").alias("pos")))
    once = both.groupBy("qid", "doc_id").agg(F.min(F.struct("src", "pos")).alias("at"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("at.src", "at.pos")).cast("long")).where(F.col("rank") <= n).select("qid", "doc_id", "rank")


def readable_title(title: Column) -> Column:
    """A stored title as words: escapes decoded, underscores as spaces."""
    return F.trim(F.replace(T.unescape(title), F.lit("_"), F.lit(" ")))


def score_sentences(queries: DataFrame, pages: DataFrame, sentences: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The k best sentences of each query's pages (qid, doc_id, rank), by corpus idf and the mean sentence length; ties by page rank and place. With a title column, a sentence is scored behind its page's readable title."""
    asked = asked_terms(queries)
    rows = corpus_rows(docs, asked.select("term").distinct())
    prefix = F.concat_ws(" ", readable_title(F.col("title")), "sentence") if "title" in sentences.columns else F.col("sentence")
    cut = sentences.select("doc_id", "idx", T.tokens(prefix).alias("t"))
    mean = cut.agg(F.avg(F.size("t")).alias("avgdl"))
    weighted = weights(asked, rows).drop("avgdl").crossJoin(F.broadcast(mean))
    weighted = F.broadcast(weighted) if is_small(asked) else weighted
    found = cut.join(pages.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "idx", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("doc_id", "idx", "dl", "term").agg(F.count("*").alias("tf"))
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = found.join(weighted, "term").join(pages.withColumnRenamed("rank", "page_rank"), ["qid", "doc_id"]).groupBy("qid", "doc_id", "idx", "page_rank").agg(F.sum(part).alias("score"))
    return top(scored, k, order=[F.desc("score"), "page_rank", "idx"]).select("qid", "doc_id", "idx", "rank", "score")


def retrieval_features(ranked: DataFrame, budget: int) -> DataFrame:
    """Eleven numbers of each ranking's first budget rows (qid, doc_id, rank, score)."""
    prefix = ranked.where(F.col("rank") <= budget)
    best = prefix.groupBy("qid").agg(
        F.count("*").alias("n_read"),
        F.min_by("score", "rank").alias("top_score"),
        F.avg("score").alias("mean_score"),
        F.max_by("score", "rank").alias("min_score"),
        F.stddev_pop("score").alias("std_score"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
        F.countDistinct("doc_id").alias("n_pages"),
        F.min_by("doc_id", "rank").alias("first_page"),
    )
    spread = prefix.join(best.select("qid", "first_page"), "qid").groupBy("qid").agg(F.avg((F.col("doc_id") == F.col("first_page")).cast("double")).alias("top_page_share"), F.min(F.when(F.col("doc_id") != F.col("first_page"), F.col("rank") - 1)).alias("leaves"))
    second = F.coalesce("second", F.lit(0.0))
    return best.join(spread, "qid").select(
        "qid", "n_read", "n_pages", "top_score", "mean_score", "min_score", "std_score",
        (F.col("top_score") - F.col("min_score")).alias("decay"),
        F.when(F.col("n_read") > 1, F.col("top_score") - second).otherwise(0.0).alias("margin"),
        F.when(F.col("mean_score") > 0, F.col("top_score") / F.col("mean_score")).otherwise(0.0).alias("ratio"),
        "top_page_share", F.coalesce("leaves", "n_read").alias("first_page_change"),
    )
