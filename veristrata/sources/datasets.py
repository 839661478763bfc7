"""Scans of claim, pair and transcript files, with the derivations that go with them, and the sinks for rows and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veristrata.functions.text import claim_key

FEVER_LABELS = ("SUPPORTS", "REFUTES", "NOT ENOUGH INFO")
AVERITEC_LABELS = {"Supported": "SUPPORTS", "Refuted": "REFUTES", "Not Enough Evidence": "NOT ENOUGH INFO", "Conflicting Evidence/Cherrypicking": "MIXED"}
MNLI_LABELS = ("entailment", "neutral", "contradiction")
CHECKWORTHY = {"-1": "non_factual", "0": "unimportant_factual", "1": "check_worthy"}


def _only(column: Column, allowed) -> Column:
    """The value, or an error that names what is not allowed."""
    return F.when(column.isin(*allowed), column).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(column, F.lit("null")))))


def gold_groups(evidence: Column) -> Column:
    """Each group a sorted set of (page, sent); groups with a missing member and repeated groups go, the first of equals stays."""
    refs = F.transform(evidence, lambda g: F.transform(g, lambda r: F.struct(r[2].alias("page"), r[3].cast("int").alias("sent"))))
    whole = F.filter(refs, lambda g: ~F.exists(g, lambda r: r["page"].isNull() | r["sent"].isNull()))
    return F.array_distinct(F.transform(whole, lambda g: F.array_sort(F.array_distinct(g))))


def gold_pages(groups: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(g, lambda r: r["page"]))))


def read_fever(spark: SparkSession, path: str) -> DataFrame:
    """id, label, text, key, groups, pages of JSON lines; an unknown label raises."""
    rows = spark.read.schema("id long, label string, claim string, evidence array<array<array<string>>>").json(path)
    out = rows.select("id", _only(F.col("label"), FEVER_LABELS).alias("label"), F.col("claim").alias("text"), claim_key(F.col("claim")).alias("key"), gold_groups(F.col("evidence")).alias("groups"))
    return out.withColumn("pages", gold_pages(F.col("groups")))


_AVERITEC = "array<struct<claim:string,label:string,speaker:string,claim_date:string,questions:array<struct<question:string,answers:array<struct<answer:string,boolean_explanation:string>>>>>>"


def read_averitec(spark: SparkSession, path: str, start_id: int = 0) -> DataFrame:
    """One JSON array a file; id is the place in it plus start_id. Question and answer pairs with nothing in them go."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", _AVERITEC)).alias("pos", "c"))
    labels = F.create_map(*[F.lit(x) for pair in AVERITEC_LABELS.items() for x in pair])

    def answer(a: Column) -> Column:
        text, why = F.coalesce(a["answer"], F.lit("")), F.coalesce(a["boolean_explanation"], F.lit(""))
        return F.when((why != "") & ~F.contains(F.lower(text), F.lower(why)), F.concat(F.regexp_replace(text, r"\.$", ""), F.lit(". "), why)).otherwise(text)

    pairs = F.flatten(F.transform(F.col("c.questions"), lambda q: F.transform(q["answers"], lambda a: F.struct(F.coalesce(q["question"], F.lit("")).alias("q"), answer(a).alias("a")))))
    named = F.when(F.col("c.label").isin(*AVERITEC_LABELS), labels[F.col("c.label")]).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.coalesce("c.label", F.lit("null")))))
    return rows.select((F.col("pos") + start_id).cast("long").alias("id"), named.alias("label"), F.col("c.claim").alias("text"), claim_key(F.col("c.claim")).alias("key"), F.filter(pairs, lambda p: (p["q"] != "") | (p["a"] != "")).alias("questions"), F.col("c.speaker").alias("speaker"), F.col("c.claim_date").alias("claim_date"))


def union_claims(train: DataFrame, dev: DataFrame) -> DataFrame:
    """Both, with dev's ids moved behind train's."""
    n = train.agg(F.count("*").alias("_n"))
    return train.unionByName(dev.crossJoin(F.broadcast(n)).withColumn("id", F.col("id") + F.col("_n")).drop("_n"))


def read_mnli(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Pairs with one of the three labels and two texts; ids are the tag and the line number, counted over the whole file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    kind = "gold_label string, sentence1 string, sentence2 string, pairID string, promptID string, genre string"
    rows = lines.where("trim(line) <> ''").select((F.col("pos") + 1).alias("n"), F.from_json("line", kind).alias("r"))
    out = rows.select(F.concat(F.lit(f"{tag}-"), F.col("n").cast("string")).alias("pair_id"), F.col("r.promptID").alias("prompt_id"), "r.genre", F.col("r.gold_label").alias("label"), F.trim("r.sentence1").alias("premise"), F.trim("r.sentence2").alias("hypothesis"))
    return out.where(F.col("label").isin(*MNLI_LABELS) & (F.col("premise") != "") & (F.col("hypothesis") != ""))


def read_claimbuster(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    labels = F.create_map(*[F.lit(x) for pair in CHECKWORTHY.items() for x in pair])
    return rows.select(F.concat(F.lit("cb-"), F.col("Sentence_id")).alias("id"), F.trim("Text").alias("text"), labels[_only(F.col("Verdict"), CHECKWORTHY)].alias("label"), F.col("Speaker").alias("speaker"), F.col("Speaker_party").alias("party"), F.col("File_id").alias("file"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, label string, logits array<double>, n_evidence_used int").json(path)


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, idx, text) of page bodies of lines "idx TAB text"; the number is read, not counted; other lines go."""
    rows = pages.select("doc_id", F.explode(F.split("lines", "\n")).alias("line")).select("doc_id", F.split("line", "\t").alias("f"))
    return rows.where(F.col("f")[0].rlike("^[0-9]+$") & (F.size("f") > 1) & (F.trim(F.get("f", F.lit(1))) != "")).select("doc_id", F.col("f")[0].cast("int").alias("idx"), F.col("f")[1].alias("text"))


def format_sentences(sentences: DataFrame) -> DataFrame:
    """The inverse: (doc_id, lines)."""
    line = F.concat_ws("\t", F.col("idx").cast("string"), "text")
    return sentences.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", line.alias("line")))), lambda s: s["line"]), "\n").alias("lines"))


def ingest_pages(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pages with dense doc_id, one row of counters) of JSON-line shards in order; empty ids are skipped and the first page of a title is kept.

    The dense id needs one global order; the window sorts (file, line, title) only, and bodies are joined afterwards.
    """
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "json"))
    rows = files.where("trim(json) <> ''").select("file", "line", F.from_json("json", "id string, text string, lines string").alias("r")).select("file", "line", F.col("r.id").alias("title"), F.col("r.lines").alias("lines"))
    named = rows.where("title is not null and title <> ''")
    first = named.groupBy("title").agg(F.min(F.struct("file", "line")).alias("p"))
    ids = first.select("title", F.col("p.file").alias("file"), F.col("p.line").alias("line"), (F.row_number().over(Window.orderBy("p.file", "p.line")) - 1).alias("doc_id"))
    pages = named.join(ids, ["title", "file", "line"]).select("doc_id", "title", "lines")
    counters = rows.agg(F.count("*").alias("records"), F.expr("count_if(title is null or title = '')").alias("empty_ids"), F.countDistinct(F.when(F.col("title") != "", F.col("title"))).alias("pages"))
    return pages, counters.withColumn("duplicates", F.col("records") - F.col("empty_ids") - F.col("pages"))


def write_run(ranked: DataFrame, path: str) -> None:
    """One JSON line a query: id and evidence [[title, idx], ...] in rank order, scores to four places."""
    own = F.sort_array(F.collect_list(F.struct("rank", "doc_id", "idx", F.round("score", 4).alias("score"))))
    ranked.groupBy(F.col("qid").alias("id")).agg(own.alias("e")).select("id", F.transform("e", lambda r: F.array(r["doc_id"].cast("string"), r["idx"].cast("string"))).alias("evidence"), F.transform("e", lambda r: r["score"]).alias("scores")).write.mode("overwrite").json(path)


def write_rows(rows: DataFrame, path: str) -> DataFrame:
    """Compressed JSON lines, and a manifest: rows and an order-free digest of their content."""
    rows.write.mode("overwrite").option("compression", "gzip").json(path)
    back = rows.sparkSession.read.text(path)
    return back.agg(F.count("*").alias("n"), F.hex(F.bit_xor(F.xxhash64("value"))).alias("digest"))


def resume(claims: DataFrame, done: DataFrame) -> DataFrame:
    """Claims that a run has not answered yet."""
    return claims.join(done.select("id").distinct(), "id", "left_anti")


def merge_problems(claims: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, problem): ids that the shards of a run answered twice, or not at all."""
    twice = answers.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated").alias("problem"))
    return twice.unionByName(resume(claims, answers).select("id", F.lit("missing").alias("problem")))
