"""Queries: index statistics, BM25, titles, two-stage retrieval, text rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veristrata.functions import pages as P
from veristrata.functions import text as T
from veristrata.operators import metrics as M
from veristrata.operators import retrieval as R
from veristrata.plans import sql as S
from veristrata.sources.tables import gold, read, sentences, shared_folder, small


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "text")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.array_join(F.slice(T.tokens(F.col("text")), 1, 2), " ").alias("norm"))


def _ranked(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return R.top(R.bm25(_items(spark, d), _docs(spark, d)), k).select("qid", "doc_id", "rank", "score")


def _gold_groups(spark: SparkSession, d: str) -> DataFrame:
    return gold(read(spark, d, "benchmark"), _docs(spark, d)).select("qid", F.col("doc_id").alias("grp"), "doc_id")


def corpus_statistics(spark, d):
    out = R.corpus_statistics(_docs(spark, d))
    return out.select("n_docs", "n_tokens", M.r6("avgdl").alias("avgdl"), "n_terms", "n_postings", "n_clipped", M.r6("postings_per_doc").alias("postings_per_doc"), M.r6("tokens_per_doc").alias("tokens_per_doc"))


def term_frequencies(spark, d):
    return R.terms(_docs(spark, d)).orderBy(F.desc("df"), "term").limit(50)


def all_term_frequencies(spark, d):
    """The document frequency of every term."""
    return R.terms(_docs(spark, d))


def term_specificity(spark, d):
    n = _docs(spark, d).agg(F.count("*").alias("n"))
    asked = _items(spark, d).select(F.explode(T.content_terms(F.col("text"))).alias("term")).distinct()
    return asked.join(R.terms(_docs(spark, d)), "term", "left").crossJoin(F.broadcast(n)).select("term", M.r6(F.log((F.col("n") + 1) / (F.col("df") + 1))).alias("specificity"))


def bm25_top10(spark, d):
    return _ranked(spark, d)


def title_candidates(spark, d):
    return R.title_candidates(_items(spark, d), _titles(spark, d))


def merged_pages(spark, d):
    return R.merge_ranked(R.title_candidates(_items(spark, d), _titles(spark, d)), _ranked(spark, d), 10)


def sentence_top25(spark, d):
    docs = _docs(spark, d)
    return R.score_sentences(_items(spark, d), _ranked(spark, d).select("qid", "doc_id", "rank"), sentences(docs), docs, 25)


def two_stage(spark, d):
    """Titles and BM25 pages, then their best sentences with text."""
    docs = _docs(spark, d)
    cut = sentences(docs)
    return R.with_text(R.search(_items(spark, d), docs, _titles(spark, d), cut, 10, 25), cut)


def stored_index_top10(spark, d):
    """The ranking of i02, read from an index that is written first."""
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    return R.top(R.Index.build(_docs(spark, d), folder).bm25(_items(spark, d)), 10).select("qid", "doc_id", "rank", "score")


def retrieval_features(spark, d):
    out = R.retrieval_features(_ranked(spark, d), 10)
    return out.select("qid", *[M.r6(c).alias(c) if t == "double" else c for c, t in out.dtypes if c != "qid"])


def recall_curve(spark, d):
    return M.recall_curve(_ranked(spark, d, 25), _gold_groups(spark, d), _items(spark, d), list(range(1, 26)))


def ndcg(spark, d):
    return M.ndcg(_ranked(spark, d, 20), _gold_groups(spark, d), [1, 5, 10, 20])


def unread_gold(spark, d):
    wanted = gold(read(spark, d, "benchmark"), _docs(spark, d))
    return wanted.join(_ranked(spark, d).select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")


def check_worthy(spark, d):
    return sentences(_docs(spark, d)).select("doc_id", "idx", T.check_worthy(F.col("sentence")).alias("reason"))


def missed_by_rule(spark, d):
    return check_worthy(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


def content_terms(spark, d):
    return _items(spark, d).select("qid", F.array_join(T.content_terms(F.col("text")), " ").alias("terms"))


def title_norms(spark, d):
    return _docs(spark, d).select("doc_id", F.sha1(T.title_norm(F.col("text")).cast("binary")).alias("norm_sha1"))


def unescaped_titles(spark, d):
    made = F.concat(F.lit("A_-LRB-"), F.col("source"), F.lit("-RRB--COLON-x"))
    return read(spark, d, "documents").select("doc_id", T.unescape(made).alias("title"), T.title_norm(made).alias("norm"))


def key_groups(spark, d):
    return _docs(spark, d).groupBy(T.claim_key(F.col("text")).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1").select("first", "n", F.sha1(F.col("key").cast("binary")).alias("key_sha1"))


def reprint_overlap(spark, d):
    """Documents that share a ten-word run with an item, or most of their triples. Words are found once; grams are told by 64-bit hashes and meet by equality."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+(?:'[a-z0-9]+)*"), F.lit(0))

    def hashed(size: int) -> Column:
        parts = ", ".join(f"w[i + {j}]" for j in range(size))
        return F.expr(f"case when size(w) < {size} then array() else array_distinct(transform(sequence(0, size(w) - {size}), i -> xxhash64({parts}))) end")

    def grams(rows: DataFrame, *keys: str) -> DataFrame:
        held = rows.select(*keys, hashed(3).alias("triple"), hashed(10).alias("run"))
        both = F.concat(F.transform("triple", lambda h: F.struct(F.lit(3).alias("size"), h.alias("h"))), F.transform("run", lambda h: F.struct(F.lit(10).alias("size"), h.alias("h"))))
        return held.select(*keys, F.size("triple").cast("long").alias("triples"), F.explode_outer(both).alias("g")).select(*keys, "triples", "g.*")

    items = grams(read(spark, d, "benchmark").select(words.alias("w"))).where("h is not null").select("size", "h").distinct().withColumn("hit", F.lit(1))
    met = grams(_docs(spark, d).select("doc_id", words.alias("w")), "doc_id").join(small(items), ["size", "h"], "left")
    out = met.groupBy("doc_id", "triples").agg(F.count_if((F.col("hit") == 1) & (F.col("size") == 3)).alias("shared"), F.max(F.when(F.col("size") == 10, F.col("hit"))).alias("run"))
    match = F.when(F.col("run") == 1, "run").when((F.col("shared") >= 5) & (F.col("shared") / F.col("triples") >= 0.6), "near")
    return out.select("doc_id", "triples", "shared", match.alias("match"))


def clipped_sentences(spark, d):
    s = sentences(_docs(spark, d)).withColumn("w", F.split("sentence", T.as_in_sql(r"\s+")))
    return s.select("doc_id", "idx", F.when(F.size("w") > 64, F.array_join(F.slice("w", 1, 64), " ")).otherwise(F.col("sentence")).alias("clipped")).where(F.length("clipped") > 0)


def packed_prefix(spark, d):
    """Sentences of a document that fit a word budget, as the longest prefix."""
    s = sentences(_docs(spark, d)).select("doc_id", "idx", F.least(F.size(F.split("sentence", r"\s+")), F.lit(64)).alias("words"))
    upto = F.sum("words").over(Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return s.withColumn("upto", upto).groupBy("doc_id").agg(F.count_if(F.col("upto") <= 200).alias("n_read"), F.count("*").alias("n_sentences"))


def budget_report(spark, d):
    """Order statistics by position, not interpolated."""
    fits = packed_prefix(spark, d)
    counts = fits.groupBy("n_read").agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy("n_read").rowsBetween(Window.unboundedPreceding, 0))).crossJoin(fits.agg(F.count("*").alias("n")))

    def at(q: float):
        return F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * q), F.col("n") - 1), F.col("n_read")))

    return upto.agg(at(0.1).alias("p10"), at(0.5).alias("median"), at(0.9).alias("p90"), F.max("n_read").alias("max"))


def page_hosts(spark, d):
    host = P.url_host(F.col("url"))
    return read(spark, d, "pages").select("page_id", host.alias("host"), P.public_url(F.col("url")).alias("public_url"), P.excluded_host(host, ["example.com"]).alias("excluded"))


def url_dates(spark, d):
    made = F.concat(F.lit("https://example.org/news/20"), F.lpad((F.col("doc_id") % 30).cast("string"), 2, "0"), F.lit("/"), F.lpad((F.col("doc_id") % 14).cast("string"), 2, "0"), F.lit("/"), F.lpad((F.col("doc_id") % 33).cast("string"), 2, "0"), F.lit("/x"))
    date = P.url_path_date(made)
    return _docs(spark, d).select("doc_id", date.alias("path_date"), P.later_by_path(date, F.lit("2015-06-15")).alias("later"))


def page_text(spark, d):
    found = read(spark, d, "pages").select("page_id", P.read_html("html").alias("r"))
    return found.select("page_id", F.length("r.markdown").cast("long").alias("n_chars"), "r.title", "r.n_links")


def page_blocks(spark, d):
    found = read(spark, d, "pages").select("page_id", F.posexplode(P.blocks(P.read_html("html")["markdown"])).alias("pos", "block"))
    return found.select("page_id", "pos", F.length("block").alias("n_chars"), (F.length("block").between(P.LEAST_PROSE, P.MOST_PROSE) & ~F.col("block").rlike("^#|^[|]|^!")).alias("prose"))


def excerpt_pick(spark, d):
    """For each item the document block that shares most content terms; ties by density, then place."""
    items = _items(spark, d).select("qid", F.explode(T.content_terms(F.col("text"))).alias("term"))
    blocks = sentences(_docs(spark, d)).select("doc_id", "idx", T.content_terms(F.col("sentence")).alias("t"))
    held = blocks.select("doc_id", "idx", F.size("t").alias("size"), F.explode("t").alias("term"))
    shared = held.join(items, "term").groupBy("qid", "doc_id", "idx", "size").agg(F.count("*").alias("overlap"))
    best = Window.partitionBy("qid").orderBy(F.desc("overlap"), "size", "doc_id", "idx")
    return shared.withColumn("n", F.row_number().over(best)).where("n = 1").select("qid", "doc_id", "idx", "overlap")


QUERIES = {
    "d01_corpus_statistics": corpus_statistics,
    "d02_term_frequencies": term_frequencies,
    "d02_all_term_frequencies": all_term_frequencies,
    "d21_term_specificity": term_specificity,
    "i02_bm25_top10": bm25_top10,
    "c02_title_candidates": title_candidates,
    "c03_merged_pages": merged_pages,
    "e02_sentence_top25": sentence_top25,
    "i06_two_stage_text": two_stage,
    "i04_stored_index_top10": stored_index_top10,
    "i09_retrieval_features": retrieval_features,
    "l01_recall_curve": recall_curve,
    "l04_ndcg": ndcg,
    "c16_unread_gold": unread_gold,
    "b08_check_worthy": check_worthy,
    "d15_missed_by_rule": missed_by_rule,
    "b06_content_terms": content_terms,
    "b04_title_norms": title_norms,
    "b02_unescaped_titles": unescaped_titles,
    "b07_key_groups": key_groups,
    "g31_reprint_overlap": reprint_overlap,
    "g01_clipped_sentences": clipped_sentences,
    "j01_packed_prefix": packed_prefix,
    "d17_budget_report": budget_report,
    "b18_page_hosts": page_hosts,
    "g08_url_dates": url_dates,
    "g14_page_text": page_text,
    "g15_page_blocks": page_blocks,
    "e17_excerpt_pick": excerpt_pick,
}

_CONTENT = f"list_filter({S.tokens('{0}')}, lambda t: t NOT IN ({S.quoted(T.FUNCTION_WORDS)}))"


def _content(column: str) -> str:
    return _CONTENT.replace("{0}", column)


def _worthy(column: str) -> str:
    low = f"list_transform(regexp_extract_all({column}, '{T.CLAIM_WORD.replace(chr(39), chr(39) * 2)}'), lambda w: lower(w))"
    raw = f"regexp_extract_all({column}, '{T.CLAIM_WORD.replace(chr(39), chr(39) * 2)}')"
    phrases = " OR ".join(f"contains(lower({column}), '{p}')" for p in T.SUBJECTIVE_PHRASES)
    return f"""CASE WHEN len({low}) < 4 THEN 'too_short'
      WHEN ends_with({column}, '?') OR {low}[1] IN ({S.quoted(T.QUESTION_OPENERS + T.AUXILIARIES)}) THEN 'question'
      WHEN {low}[1] IN ({S.quoted(T.IMPERATIVE_OPENERS)}) THEN 'imperative'
      WHEN {phrases} OR list_has_any({low}, [{S.quoted(T.OPINION_MARKERS)}]) THEN 'opinion'
      WHEN len(list_filter({low}, lambda w: w IN ({S.quoted(T.AUXILIARIES + T.IRREGULAR_PAST)}) OR (length(w) > 4 AND ends_with(w, 'ed')))) = 0 THEN 'no_assertion'
      WHEN NOT (regexp_matches({column}, '[0-9]') OR list_has_any({low}, [{S.quoted(T.MONTHS)}]) OR len(list_filter(list_slice({raw}, 2, 1000000), lambda w: regexp_matches(w, '^[A-Z]'))) > 0) THEN 'no_anchor'
      ELSE 'check_worthy' END"""


_DISTINCT = "list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda z: list_position(l, z[1]) = z[2]), lambda z: z[1])"
_GRAMS = "SELECT {k}, unnest(list_transform(range(1, greatest(len(w) - {n} + 2, 1)), lambda i: array_to_string(list_slice(w, i, i + {n} - 1), ' '))) AS g FROM {t}"
_SPEECH = "regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z0-9]+)*')"
_PACKED = f"""WITH {S.SENTENCES},
w AS (SELECT doc_id, idx, least(len(regexp_split_to_array(sentence, '\\s+')), 64) AS words FROM sents),
u AS (SELECT doc_id, sum(words) OVER (PARTITION BY doc_id ORDER BY idx) AS upto FROM w),
fits AS (SELECT doc_id, count(*) FILTER (upto <= 200) AS n_read, count(*) AS n_sentences FROM u GROUP BY doc_id)
"""

ORACLES = {
    "d01_corpus_statistics": f"""WITH {S.BM25}
SELECT n_docs, CAST((SELECT sum(dl) FROM dl) AS BIGINT) AS n_tokens, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM df) AS n_terms,
 (SELECT count(*) FROM post) AS n_postings, (SELECT count(*) FROM post WHERE tf > 255) AS n_clipped,
 round((SELECT count(*) FROM post) / n_docs, 6) AS postings_per_doc, round((SELECT sum(dl) FROM dl) / n_docs, 6) AS tokens_per_doc FROM whole""",
    "d02_term_frequencies": f"WITH {S.BM25} SELECT term, df FROM df ORDER BY df DESC, term LIMIT 50",
    "d02_all_term_frequencies": f"WITH {S.BM25} SELECT term, df FROM df",
    "d21_term_specificity": f"""WITH {S.BM25}, asked AS (SELECT DISTINCT unnest({_content('text')}) AS term FROM benchmark)
SELECT term, round(ln((n_docs + 1) / (df + 1)), 6) AS specificity FROM asked LEFT JOIN df USING (term), whole""",
    "i02_bm25_top10": f"WITH {S.BM25} SELECT qid, doc_id, rank, score FROM ranked WHERE rank <= 10",
    "c02_title_candidates": f"WITH {S.TITLES} SELECT qid, doc_id, pos FROM cand",
    "c03_merged_pages": f"""WITH {S.BM25}, {S.TITLES},
both_ AS (SELECT qid, doc_id, 0 AS src, pos FROM cand WHERE pos <= 3 UNION ALL SELECT qid, doc_id, 1, rank FROM ranked WHERE rank <= 10),
once AS (SELECT qid, doc_id, min(src * 1000000 + pos) AS place FROM both_ GROUP BY qid, doc_id)
SELECT * FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY place) AS rank FROM once) WHERE rank <= 10""",
    "i04_stored_index_top10": f"WITH {S.BM25} SELECT qid, doc_id, rank, score FROM ranked WHERE rank <= 10",
    "i06_two_stage_text": f"""WITH {S.BM25}, {S.TITLES}, {S.SENTENCES},
both_ AS (SELECT qid, doc_id, 0 AS src, pos FROM cand WHERE pos <= 3 UNION ALL SELECT qid, doc_id, 1, rank FROM ranked WHERE rank <= 10),
once AS (SELECT qid, doc_id, min(src * 1000000 + pos) AS place FROM both_ GROUP BY qid, doc_id),
pg AS (SELECT * FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY place) AS rank FROM once) WHERE rank <= 10),
st AS (SELECT doc_id, idx, sentence, {S.tokens('sentence')} AS t FROM sents),
mean AS (SELECT avg(len(t)) AS savg FROM st),
sp AS (SELECT doc_id, idx, len(t) AS sl, unnest(t) AS term FROM st),
stf AS (SELECT doc_id, idx, sl, term, count(*) AS tf FROM sp GROUP BY ALL),
ss AS (SELECT r.qid, r.doc_id, idx, r.rank AS page_rank, round(sum(weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sl / savg))), 6) AS score
       FROM pg r JOIN stf ON stf.doc_id = r.doc_id JOIN w ON w.qid = r.qid AND w.term = stf.term, mean GROUP BY ALL)
SELECT b.* EXCLUDE (page_rank), sentence AS text FROM (SELECT qid, doc_id, idx, page_rank, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, page_rank, idx) AS rank FROM ss WHERE score > 0) b JOIN st USING (doc_id, idx) WHERE rank <= 25""",
    "e02_sentence_top25": f"""WITH {S.BM25}, {S.SENTENCES},
st AS (SELECT doc_id, idx, {S.tokens('sentence')} AS t FROM sents),
mean AS (SELECT avg(len(t)) AS savg FROM st),
sp AS (SELECT doc_id, idx, len(t) AS sl, unnest(t) AS term FROM st),
stf AS (SELECT doc_id, idx, sl, term, count(*) AS tf FROM sp GROUP BY ALL),
ss AS (SELECT r.qid, r.doc_id, idx, r.rank AS page_rank, round(sum(weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sl / savg))), 6) AS score
       FROM ranked r JOIN stf ON stf.doc_id = r.doc_id JOIN w ON w.qid = r.qid AND w.term = stf.term, mean WHERE r.rank <= 10 GROUP BY ALL)
SELECT * EXCLUDE (page_rank) FROM (SELECT qid, doc_id, idx, page_rank, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, page_rank, idx) AS rank FROM ss WHERE score > 0) WHERE rank <= 25""",
    "i09_retrieval_features": f"""WITH {S.BM25}, pre AS (SELECT * FROM ranked WHERE rank <= 10),
a AS (SELECT qid, count(*) AS n_read, count(DISTINCT doc_id) AS n_pages, min_by(score, rank) AS top, avg(score) AS mean, max_by(score, rank) AS last, stddev_pop(score) AS std, max(CASE WHEN rank = 2 THEN score END) AS second, min_by(doc_id, rank) AS fp FROM pre GROUP BY qid),
s AS (SELECT qid, avg(CASE WHEN doc_id = fp THEN 1.0 ELSE 0.0 END) AS share, min(CASE WHEN doc_id <> fp THEN rank - 1 END) AS leaves FROM pre JOIN a USING (qid) GROUP BY qid)
SELECT qid, n_read, n_pages, round(top, 6) AS top_score, round(mean, 6) AS mean_score, round(last, 6) AS min_score, round(std, 6) AS std_score, round(top - last, 6) AS decay,
 round(CASE WHEN n_read > 1 THEN top - second ELSE 0 END, 6) AS margin, round(CASE WHEN mean > 0 THEN top / mean ELSE 0 END, 6) AS ratio, round(share, 6) AS top_page_share, coalesce(leaves, n_read) AS first_page_change FROM a JOIN s USING (qid)""",
    "l01_recall_curve": f"""WITH {S.BM25}, {S.GOLD},
first AS (SELECT g.qid, min(rank) AS first FROM gold g LEFT JOIN (SELECT * FROM ranked WHERE rank <= 25) r ON r.qid = g.qid AND r.doc_id = g.doc_id GROUP BY g.qid),
ks AS (SELECT CAST(unnest(range(1, 26)) AS INT) AS k), c AS (SELECT count(*) AS claims FROM benchmark),
a AS (SELECT k, count(*) AS verifiable, avg(CASE WHEN first <= k THEN 1.0 ELSE 0.0 END) AS recall, avg(CASE WHEN first <= k THEN 1 / first ELSE 0.0 END) AS mrr FROM ks, first GROUP BY k)
SELECT k, verifiable, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(1 - verifiable / claims * (1 - recall), 6) AS ceiling, round(1 - verifiable / claims, 6) AS nei_share FROM a, c""",
    "l04_ndcg": f"""WITH {S.BM25}, {S.GOLD}, wanted AS (SELECT DISTINCT qid, doc_id FROM gold), sz AS (SELECT qid, count(*) AS m FROM wanted GROUP BY qid),
ks AS (SELECT CAST(unnest([1, 5, 10, 20]) AS INT) AS k),
got AS (SELECT k, qid, sum(1 / log2(rank + 1)) AS dcg FROM ks, ranked JOIN wanted USING (qid, doc_id) WHERE rank <= k GROUP BY k, qid)
SELECT k, round(avg(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(k, m) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg, round(avg(CASE WHEN dcg IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS recall_any
FROM ks CROSS JOIN sz LEFT JOIN got USING (k, qid) GROUP BY k""",
    "c16_unread_gold": f"WITH {S.BM25}, {S.GOLD} SELECT qid, doc_id FROM gold ANTI JOIN (SELECT * FROM ranked WHERE rank <= 10) r USING (qid, doc_id)",
    "b08_check_worthy": f"WITH {S.SENTENCES} SELECT doc_id, idx, {_worthy('sentence')} AS reason FROM sents",
    "d15_missed_by_rule": f"WITH {S.SENTENCES} SELECT {_worthy('sentence')} AS reason, count(*) AS n FROM sents GROUP BY 1",
    "b06_content_terms": f"SELECT qid, array_to_string({_DISTINCT}, ' ') AS terms FROM (SELECT item_id AS qid, {_content('text')} AS l FROM benchmark)",
    "b04_title_norms": f"SELECT doc_id, sha1(array_to_string({S.tokens('text')}, ' ')) AS norm_sha1 FROM documents",
    "b02_unescaped_titles": "SELECT doc_id, 'A_(' || source || '):x' AS title, 'a ' || source || ' x' AS norm FROM documents",
    "b07_key_groups": f"SELECT min(doc_id) AS first, count(*) AS n, sha1({S.claim_key('text')}) AS key_sha1 FROM documents GROUP BY {S.claim_key('text')} HAVING count(*) > 1",
    "g31_reprint_overlap": f"""WITH i AS (SELECT 0 AS z, {_SPEECH} AS w FROM benchmark), dd AS (SELECT doc_id, {_SPEECH} AS w FROM documents),
i10 AS (SELECT DISTINCT g FROM ({_GRAMS.format(k='z', n=10, t='i')})), i3 AS (SELECT DISTINCT g FROM ({_GRAMS.format(k='z', n=3, t='i')})),
d10 AS (SELECT DISTINCT doc_id, g FROM ({_GRAMS.format(k='doc_id', n=10, t='dd')})), d3 AS (SELECT DISTINCT doc_id, g FROM ({_GRAMS.format(k='doc_id', n=3, t='dd')})),
run AS (SELECT DISTINCT doc_id FROM d10 SEMI JOIN i10 USING (g)), sh AS (SELECT doc_id, count(*) AS shared FROM d3 SEMI JOIN i3 USING (g) GROUP BY doc_id), tr AS (SELECT doc_id, count(*) AS triples FROM d3 GROUP BY doc_id)
SELECT dd.doc_id, coalesce(triples, 0) AS triples, coalesce(shared, 0) AS shared,
 CASE WHEN run.doc_id IS NOT NULL THEN 'run' WHEN shared >= 5 AND shared / triples >= 0.6 THEN 'near' END AS match
FROM dd LEFT JOIN tr USING (doc_id) LEFT JOIN sh USING (doc_id) LEFT JOIN run USING (doc_id)""",
    "g01_clipped_sentences": f"""WITH {S.SENTENCES}, x AS (SELECT doc_id, idx, sentence, regexp_split_to_array(sentence, '\\s+') AS w FROM sents)
SELECT doc_id, idx, CASE WHEN len(w) > 64 THEN array_to_string(list_slice(w, 1, 64), ' ') ELSE sentence END AS clipped FROM x""",
    "j01_packed_prefix": _PACKED + "SELECT * FROM fits",
    "d17_budget_report": _PACKED + """, o AS (SELECT n_read, row_number() OVER (ORDER BY n_read) - 1 AS i, count(*) OVER () AS n FROM fits)
SELECT min(CASE WHEN i = least(floor(n * 0.1), n - 1) THEN n_read END) AS p10, min(CASE WHEN i = least(floor(n * 0.5), n - 1) THEN n_read END) AS median, min(CASE WHEN i = least(floor(n * 0.9), n - 1) THEN n_read END) AS p90, max(n_read) AS max FROM o""",
    "b18_page_hosts": r"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host,
 lower(regexp_extract(url, '^https://([^/?#@:]+)(:443)?([/?][^#]*)?(#.*)?$', 1)) AS h, regexp_extract(url, '^https://([^/?#@:]+)(:443)?([/?][^#]*)?(#.*)?$', 3) AS rest FROM pages)
SELECT page_id, host, CASE WHEN contains(h, '.') AND NOT regexp_matches(h, '(^\.|\.$|\.local$|\.localhost$|\.internal$|^[0-9.]+$)') AND NOT regexp_matches(url, '[\s\\]') THEN 'https://' || h || rest ELSE '' END AS public_url,
 host = 'example.com' OR ends_with(host, '.example.com') AS excluded FROM p""",
    "g08_url_dates": """WITH x AS (SELECT doc_id, '20' || lpad(CAST(doc_id % 30 AS VARCHAR), 2, '0') AS y, lpad(CAST(doc_id % 14 AS VARCHAR), 2, '0') AS m, lpad(CAST(doc_id % 33 AS VARCHAR), 2, '0') AS d FROM documents),
z AS (SELECT doc_id, CASE WHEN try_cast(y || '-' || m || '-' || d AS DATE) IS NOT NULL THEN y || '-' || m || '-' || d WHEN CAST(m AS INT) BETWEEN 1 AND 12 THEN y || '-' || m ELSE y END AS path_date FROM x)
SELECT doc_id, path_date, path_date > substr('2015-06-15', 1, length(path_date)) AS later FROM z""",
    "e17_excerpt_pick": f"""WITH {S.SENTENCES}, it AS (SELECT DISTINCT item_id AS qid, unnest({_content('text')}) AS term FROM benchmark),
bl AS (SELECT doc_id, idx, list_distinct({_content('sentence')}) AS t FROM sents), h AS (SELECT doc_id, idx, len(t) AS size, unnest(t) AS term FROM bl),
s AS (SELECT qid, doc_id, idx, size, count(*) AS overlap FROM h JOIN it USING (term) GROUP BY ALL)
SELECT qid, doc_id, idx, overlap FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, size, doc_id, idx) AS n FROM s) WHERE n = 1""",
}
