"""Language identification by fused evidence: text, declared markup language, address suffix and host.

Text: hashed byte-trigram models, learned from at most SAMPLE labelled rows of each language. A text's likelihood is tempered
to that of EFFECTIVE trigrams, since trigrams of one text are far from independent.
Host: shares of each language among the rows of a host, smoothed towards those of its address suffix, and these towards
the corpus'. They are soft counts of the text posteriors over all rows, by grouped aggregation; a row's own count is left out.
Declared language: how often rows with a declaration read as each language, again over all rows.

Defined results: a row without letters or other non-space bytes has no text evidence, language null and is rejected; a
null host, suffix or declaration adds no evidence; without labelled rows every language is null; an empty table gives an empty
table; of languages with equal posteriors the first by name is taken; rows that share an id are read each for itself. More
than MOST_LANGUAGES languages raise an error. Columns of the input keep their names: only the named evidence and the carry columns are used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veristrata.llm.common import as_bytes, lean, materialise, small

#: Labelled rows of one language that the text models are learned from, at most.
SAMPLE = 1_000
BITS = 16
MOST_LANGUAGES = 128
EFFECTIVE = 60.0
#: Rows' worth of the broader level in a smoothed share.
STRENGTH = 20.0
#: A language is accepted from this posterior on.
ACCEPT = 0.5

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class TextModel:
    languages: list[str]
    scores: np.ndarray  # trigram bucket x language: log likelihood


def trigrams(data: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of folded text with single spaces, one space around it."""
    flat = b" ".join(data.translate(_FOLD).split())
    if not flat:
        return np.zeros(0, np.int64)
    x = np.frombuffer(b" " + flat + b" ", np.uint8).astype(np.uint32)
    code = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for language, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = counts.setdefault(language, np.zeros(1 << BITS, np.int64))
            own += np.bincount(trigrams(data.as_py() or b""), minlength=1 << BITS)
    for language, own in counts.items():
        found = np.flatnonzero(own)
        yield pa.record_batch([pa.array([language] * len(found), pa.string()), pa.array(found, pa.int32()), pa.array(own[found], pa.int64())], names=["language", "bucket", "n"])


def learn(labelled: DataFrame, sample: int = SAMPLE) -> TextModel:
    """From labelled: doc_id, text, lang."""
    known = labelled.where("lang is not null and doc_id is not null").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return TextModel([], np.zeros((1 << BITS, 0)))
    # the ids with the smallest hashes: few pass the cut, and these are numbered
    cut = F.create_map(*[F.lit(x) for g in languages for x in (g, (2**63 - 1) * min(4 * sample, sizes[g]) // sizes[g])])
    order = F.xxhash64("doc_id").bitwiseAND(F.lit(2**63 - 1))
    near = known.select("doc_id", "lang", order.alias("_order")).where(F.col("_order") <= cut[F.col("lang")]).distinct()
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_order", "doc_id"))).where(F.col("_n") <= sample)
    ids = materialise(near.select("doc_id", "lang"), "sample")
    rows = known.join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", as_bytes("text"))
    found = rows.mapInArrow(lean(_counter), "language string, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((1 << BITS, len(languages)))
    place = {x: i for i, x in enumerate(languages)}
    column = np.array([place[x] for x in found.column("language").to_pylist()], np.int64)
    counts[found.column("bucket").to_numpy(), column] = found.column("n").to_numpy()
    smooth = counts + 0.1
    return TextModel(languages, np.log(smooth / smooth.sum(axis=0)))


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = shared.value
        for batch in batches:
            sums = []
            for data in batch.column(1):
                grams = trigrams(data.as_py() or b"")
                total = np.zeros(scores.shape[1])
                for i in range(0, len(grams), 1 << 18):
                    total += scores[grams[i : i + (1 << 18)]].sum(axis=0)
                sums.append((total * min(1.0, EFFECTIVE / len(grams))).tolist() if len(grams) else None)
            yield pa.record_batch([batch.column(0), pa.array(sums, pa.list_(pa.float64()))], names=["row", "likelihood"])

    return score


def _softmax(column: str) -> str:
    return f"transform(array(array_max({column})), m -> transform(array(aggregate({column}, 0D, (a, x) -> a + exp(x - m))), t -> transform({column}, x -> exp(x - m) / t))[0])[0]"


def _soft_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, counts, total): sums of the text posteriors by position; partial sums come before the shuffle."""
    places = rows.select(*keys, F.posexplode("posterior").alias("place", "p"))
    sums = places.groupBy(*keys, "place").agg(F.sum("p").alias("p"))
    return sums.groupBy(*keys).agg(F.expr("transform(array_sort(collect_list(struct(place, p))), x -> x.p)").alias("counts"), F.sum("p").alias("total"))


def identify(rows: DataFrame, model: TextModel, carry: list[str] | None = None, host: Column | None = None, suffix: Column | None = None, declared: Column | None = None, text: Column | None = None, accept: float = ACCEPT) -> DataFrame:
    """The carry columns, language, confidence and accepted of each row; host, suffix, declared and text name the evidence."""
    spark = rows.sparkSession
    null = F.lit(None).cast("string")
    row = F.struct(F.struct(*[F.col(c) for c in carry or ["doc_id"]]).alias("kept"), *[F.lower(x if x is not None else null).alias(name) for name, x in (("_host", host), ("_suffix", suffix), ("_declared", declared))])
    source = rows.select(row.alias("row"), (text if text is not None else F.col("text")).cast("binary").alias("text"))
    kind = source.schema["row"].dataType.simpleString()
    if not model.languages:
        return source.select("row.kept.*", null.alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted"))
    shared = spark.sparkContext.broadcast(model.scores)
    read = materialise(source.mapInArrow(lean(_scorer(shared)), f"row {kind}, likelihood array<double>"), "likelihoods")
    read = read.select("row.*", "likelihood").withColumn("posterior", F.when(F.col("likelihood").isNotNull(), F.expr(_softmax("likelihood"))))
    counted = read.where("posterior is not null")
    n = len(model.languages)
    whole = _soft_counts(counted, []).first()
    base = [(c + 1.0) / (whole["total"] + n) for c in whole["counts"]] if whole and whole["counts"] else [1.0 / n] * n
    prior = F.array(*[F.lit(x) for x in base])
    smooth = "transform({0}, (c, i) -> (c + {1} * {2}[i]) / ({3} + {1}))"
    suffixes = _soft_counts(counted.where("_suffix is not null"), ["_suffix"]).withColumn("prior", prior).select("_suffix", F.expr(smooth.format("counts", STRENGTH, "prior", "total")).alias("suffix_share"))
    pairs = counted.where("_host is not null")
    hosts = _soft_counts(pairs, ["_host"])
    of_host = pairs.groupBy("_host").agg(F.max("_suffix").alias("_suffix"))
    hosts = hosts.join(of_host, "_host").join(suffixes, "_suffix", "left").select("_host", "counts", "total", F.coalesce("suffix_share", prior).alias("broader"))
    declarations = _soft_counts(counted.where("_declared is not null"), ["_declared"]).withColumn("prior", prior).select("_declared", F.expr(smooth.format("counts", STRENGTH, "prior", "total")).alias("declared_share"))
    out = read.join(small(materialise(hosts, "hosts")), "_host", "left").join(small(materialise(suffixes, "suffixes")), "_suffix", "left").join(small(materialise(declarations, "declarations")), "_declared", "left")
    fused = F.expr(f"""transform(likelihood, (x, i) -> x
        + ln(case when counts is null then coalesce(suffix_share, prior)[i]
             else (greatest(counts[i] - posterior[i], 0D) + {STRENGTH} * broader[i]) / (greatest(total - 1, 0D) + {STRENGTH}) end)
        + case when declared_share is null then 0D else ln(declared_share[i] / prior[i]) end)""")
    out = out.withColumn("prior", prior).withColumn("fused", fused).withColumn("fused", F.expr(_softmax("fused")))
    names = F.array(*[F.lit(x) for x in model.languages])
    confidence = F.coalesce(F.array_max("fused"), F.lit(0.0))
    language = F.when(F.col("likelihood").isNotNull(), F.element_at(names, F.array_position("fused", F.array_max("fused")).cast("int")))
    return out.select("kept.*", language.alias("language"), confidence.alias("confidence"), (confidence >= accept).alias("accepted"))


def identify_documents(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Documents: text, and their source as host; models are learned from the lang column."""
    return identify(docs, learn(docs), carry or ["doc_id"], host=F.col("source"))


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """Pages: visible text, the lang attribute of the html element, the host and its last label."""
    host = F.regexp_extract("url", r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1)
    host = F.when(host != "", host)
    declared = F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([a-z]{2,3})", 1)
    visible = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    return identify(pages, model, ["page_id"], host=host, suffix=F.when(host.contains("."), F.substring_index(host, ".", -1)), declared=F.when(declared != "", declared), text=visible)
