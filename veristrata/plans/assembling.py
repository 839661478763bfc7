"""Queries: the page store, screens of single rows, readings and judged pairs, audits and calibrator choice."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veristrata.functions import claims as K
from veristrata.functions import text as T
from veristrata.operators import audits as A
from veristrata.operators import crossfit as X
from veristrata.operators import metrics as M
from veristrata.operators import readings as D
from veristrata.operators import retrieval as R
from veristrata.operators import screening as N
from veristrata.operators import splits as SP
from veristrata.operators.pagestore import PageStore
from veristrata.plans import sql as S
from veristrata.plans.lexical import _content, _docs, _gold_groups, _items, _ranked, two_stage
from veristrata.sources.tables import predictions, read, sentences, shared_folder

BANDS = {"strong": 0.9, "moderate": 0.6, "weak": 0.3}


def native_labels(spark, d):
    return read(spark, d, "documents").groupBy(F.col("lang").alias("label")).agg(F.count("*").alias("n"))


def _store(spark, d) -> PageStore:
    docs = read(spark, d, "documents")
    titled = docs.select("doc_id", F.concat(F.lit("Page_"), F.col("source"), F.lit("_"), F.col("doc_id")).alias("title"))
    return PageStore.build(titled, sentences(docs.select("doc_id", "text")), f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}")


def page_count(spark, d):
    return _store(spark, d).page_count()


def title_lookup(spark, d):
    asked = read(spark, d, "documents").select(F.concat(F.lit("Page_"), F.col("source"), F.lit("_"), F.col("doc_id") * 2).alias("title"))
    return _store(spark, d).ids(asked)


def titles_by_id(spark, d):
    return _store(spark, d).titles(read(spark, d, "labels").select((F.col("doc_id") * 3).alias("doc_id")))


def page_sentences(spark, d):
    return _store(spark, d).sentences(read(spark, d, "labels").select("doc_id"))


def page_scan(spark, d):
    return _store(spark, d).scan().select("doc_id", "title", F.size("sentences").cast("long").alias("n_sentences"), F.sha1(F.array_join("sentences", "\n").cast("binary")).alias("sentences_sha1"))


def topic_phrases(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(N.topic_phrases(T.nfc(F.col("text")))).alias("phrase"))


def topic_evidence(spark, d):
    items = _items(spark, d).withColumnRenamed("text", "claim")
    rows = two_stage(spark, d).join(items, "qid")
    return N.on_topic(rows, "claim", "claim", "text").select("qid", "doc_id", "idx", "rank")


def learned_decision(spark, d):
    rows = predictions(read(spark, d, "embeddings"), 3).select("id", M.softmax(F.col("logits")).alias("p"))
    words = _docs(spark, d).select(F.col("doc_id").alias("id"), F.size(T.claim_words(F.col("text"))).alias("words"))
    found = rows.join(words, "id").select("id", N.learned_decision(F.col("p"), F.col("words"), 0.5).alias("x"))
    return found.select("id", "x.worthy", "x.reason", M.r6("x.score").alias("score"))


def _odd_urls(spark, d):
    at = F.col("page_id") % 5
    return read(spark, d, "pages").select("page_id", F.when(at == 1, F.regexp_replace("url", "^(https?://[^/]+)", "$1.")).when(at == 2, F.regexp_replace("url", "^(https?://[^/]+)", "$1..")).when(at == 3, F.concat("url", F.lit("\\x"))).otherwise(F.col("url")).alias("url"))


def reference_urls(spark, d):
    return _odd_urls(spark, d).select("page_id", N.reference_url(F.col("url")).alias("reference"))


def judgment_problems(spark, d):
    """Judgments made up from every sentence, some of them broken."""
    at = F.col("idx") % 6
    relation = F.when(at == 0, "unrelated").when(at == 1, "supports").otherwise("states")
    span = F.when(at == 0, F.when(F.col("doc_id") % 2 == 0, "").otherwise("quoted")).when(at == 2, F.concat(F.substring("sentence", 1, 10), F.lit("#"))).otherwise(F.substring("sentence", 2, 12))
    qualifiers = F.when(at == 3, F.array(F.lit("zzzz!"))).when(at == 4, F.array_repeat(F.substring("sentence", 1, 3), 5)).otherwise(F.array(F.substring("sentence", 1, 3)))
    rows = sentences(_docs(spark, d))
    return rows.select("doc_id", "idx", N.judgment_problem(relation, span, qualifiers, F.col("sentence")).alias("problem"))


def english_rows(spark, d):
    made = F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit("-US"))).when(F.col("doc_id") % 3 == 1, F.concat("lang", F.lit("_x"))).otherwise(F.col("lang"))
    return read(spark, d, "documents").select("doc_id", N.english(made).alias("english"))


def fallback_queries(spark, d):
    return sentences(_docs(spark, d)).select("doc_id", "idx", N.fallback_query(F.col("sentence"), F.when(F.col("idx") % 2 == 0, "France").otherwise(""), F.lit("2019-05-01")).alias("query"))


def publication_notes(spark, d):
    n = F.col("doc_id")
    published = F.when(n % 4 == 0, F.lit("2015-06")).otherwise(F.concat(F.lit("20"), F.lpad((n % 30).cast("string"), 2, "0"), F.lit("-"), F.lpad((n % 14).cast("string"), 2, "0"), F.lit("-10T00:00")))
    said = F.when(n % 7 == 0, "").otherwise("2015-06-15")
    return _docs(spark, d).select("doc_id", N.publication_note(published, said).alias("note"))


def anchored_windows(spark, d):
    windows = _docs(spark, d).select("doc_id", F.substring("text", 1, 200).alias("window"))
    rows = _ranked(spark, d).join(_items(spark, d), "qid").join(windows, "doc_id")
    return rows.select("qid", "doc_id", N.anchored_by(F.col("text"), F.col("window")).alias("anchored"))


def context_phrases(spark, d):
    docs = _docs(spark, d)
    n = docs.agg(F.count("*").alias("n"))
    terms = R.terms(docs).crossJoin(F.broadcast(n)).select("term", R.idf(F.col("df"), F.col("n")).alias("idf"))
    asked = _items(spark, d).select(F.col("qid").alias("claim"), F.posexplode(N.topic_phrases(T.nfc(F.col("text")))).alias("pos", "text"))
    return N.context_phrases(asked, terms).select("claim", "pos", "text", M.r6("mean_idf").alias("mean_idf"))


def ordered_union(spark, d):
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    return _docs(spark, d).select("doc_id", F.array_join(D.ordered_union(F.slice(words, 5, 6), F.slice(words, 1, 8)), " ").alias("words"))


def _packet(spark, d):
    """Documents as sources: their first lines as excerpts, later ones as passages."""
    lines = F.filter(F.split("text", r"\n+"), lambda s: F.trim(s) != "")
    at = F.col("doc_id")
    rows = _docs(spark, d).select(
        at.alias("id"), F.when(at % 5 == 0, "later_publication").otherwise("published").alias("temporal_status"), F.when(at % 7 == 0, "http://x.org/a").otherwise("https://x.org/a").alias("url"),
        F.slice(lines, 1, 1).alias("excerpts"), F.slice(lines, 1, 2).alias("assertion_passages"), F.slice(lines, 2, 3).alias("reading_passages"),
    )
    return D.research_packet(rows, N.P.public_url(F.col("url")))


def research_packet(spark, d):
    joined = lambda c: F.sha1(F.array_join(c, "\n").cast("binary"))
    return _packet(spark, d).select("id", F.size("excerpts").alias("n_excerpts"), F.size("context_excerpts").alias("n_context"), joined("excerpts").alias("excerpts_sha1"), joined("context_excerpts").alias("context_sha1"))


def reading_units(spark, d):
    units = D.reading_units(_packet(spark, d), K.segment)
    return units.select("unit_id", "passage_id", "origin", "start", "end", F.sha1(F.col("text").cast("binary")).alias("text_sha1"))


def role_problems(spark, d):
    """Annotations made up from every sentence: some left out, invented, given twice or invalid."""
    units = sentences(_docs(spark, d)).select(F.concat_ws(":", "doc_id", "idx").alias("unit_id"), F.col("idx").alias("i"))
    at = F.col("i") % 8
    roles = F.when(at == 3, F.array(F.lit("unknown"), F.lit("caption"))).when(at == 4, F.array().cast("array<string>")).when(at == 5, F.array(F.lit("rumour"))).otherwise(F.array(F.lit("definition")))
    given = units.where("i % 8 <> 1").select(F.when(at == 2, F.concat("unit_id", F.lit("x"))).otherwise(F.col("unit_id")).alias("unit_id"), roles.alias("roles"), F.explode(F.when(at == 6, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("k")).drop("k")
    return D.role_problems(units.select("unit_id"), given)


def pairs_to_judge(spark, d):
    assertions = _items(spark, d).select(F.col("qid").alias("claim"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select("claim", (F.col("claim") * 10 + F.col("k")).alias("assertion_id"))
    units = _ranked(spark, d).select(F.col("qid").alias("claim"), F.col("doc_id").alias("unit_id"), (F.col("doc_id") % 3 > 0).alias("eligible"))
    return D.pairs_to_judge(assertions, units)


def role_agreement(spark, d):
    names = F.array(*map(F.lit, D.ROLES))
    of = lambda n: F.element_at(names, (n % 9 + 1).cast("int"))
    rows = read(spark, d, "documents").select(F.array_distinct(F.array(of(F.col("doc_id")), of(F.col("n_chars")))).alias("got"), F.array(of(F.col("doc_id") + F.when(F.col("n_chars") % 3 == 0, 1).otherwise(0))).alias("wanted"))
    return D.role_agreement(rows)


def basis(spark, d):
    rows = read(spark, d, "documents").where("doc_id % 3 < 2").select(F.col("n_chars").alias("assertion_id"), F.col("doc_id").alias("pos"), F.col("source").alias("independent_source"), F.concat(F.lit("2020-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")).alias("published_at"))
    return D.basis(rows)


def expectations(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("key"))
    wanted = docs.where("key % 5 = 0").select("key", F.lit("must_retain").alias("kind")).unionByName(docs.where("key % 20 < 2").select((F.col("key") * 2).alias("key"), F.lit("must_drop").alias("kind")))
    return D.expectation_report(wanted, docs.where("key % 3 > 0"), docs.where("key % 3 = 0"), docs)


def question_rows(spark, d):
    turns = read(spark, d, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    told = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    pairs = asked.join(told, ["conv_id", "turn"]).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "q", "a"))), lambda x: F.struct(x["q"].alias("q"), x["a"].alias("a"))).alias("questions"))
    rows = D.question_rows(pairs.select(F.col("conv_id").alias("id"), F.lit("NOT ENOUGH INFO").alias("label"), F.lit("claim").alias("text"), "questions"))
    return rows.select("id", F.explode("evidence").alias("e")).select("id", "e.title", "e.idx", F.sha1(F.col("e.text").cast("binary")).alias("text_sha1"))


def _variants(spark, d, variant):
    cut = sentences(_docs(spark, d)).select("doc_id", "idx", "sentence")
    held = cut.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "sentence"))), lambda x: F.struct(F.lit("t").alias("title"), x["idx"].alias("idx"), x["sentence"].alias("text"))).alias("retrieved"))
    rows = held.select(F.col("doc_id").alias("id"), F.lit("two words").alias("claim"), "retrieved", F.when(F.col("doc_id") % 2 == 0, F.slice("retrieved", F.size("retrieved"), F.lit(1))).otherwise(F.slice("retrieved", 1, 0)).alias("gold"))
    return D.variant_evidence(rows, variant, 60).select("id", F.array_join(F.transform("evidence", lambda x: x["idx"].cast("string")), ",").alias("shown"))


def gold_variant(spark, d):
    return _variants(spark, d, "gold")


def retrieved_variant(spark, d):
    return _variants(spark, d, "retrieved")


def gold_read(spark, d):
    used = _items(spark, d).select("qid", (F.col("qid") % 4).alias("used"))
    return A.gold_read(used, _ranked(spark, d, 25), _gold_groups(spark, d))


def subgroup_calibration(spark, d):
    scored = M.score(predictions(read(spark, d, "embeddings"))).withColumn("part", F.col("id") % 4)
    return A.subgroup_calibration(scored, "part")


def counting_report(spark, d):
    return A.counting_report(M.score(predictions(read(spark, d, "embeddings"))), {"even": "id % 2 = 0", "third": "id % 3 = 0"}, BANDS, (0, 1, 2))


def compare_models(spark, d):
    rows = predictions(read(spark, d, "embeddings"))
    other = rows.withColumn("logits", F.transform("logits", lambda x, i: F.when(i % 2 == 0, x * 0.5).otherwise(x)))
    return A.compare_models(M.score(rows), M.score(other))


def calibrator_choice(spark, d):
    rows = SP.folds(predictions(read(spark, d, "embeddings"), 3).withColumn("label", F.col("label") % 3), 2, 7)
    return X.calibrator_losses(rows, 2, 3, ["none", "temperature", "isotonic"])


def out_of_fold_auc(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.log1p("n_chars").alias("size"), F.length("text").alias("length"))
    rows = docs.join(read(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("id"), "size", (F.col("doc_id") % 13).alias("noise"), (F.col("quality") == 1).alias("good"))
    return X.out_of_fold_auc(SP.folds(rows, 3, 5), 3, ["size", "noise"], "good")


QUERIES = {
    "a07_native_labels": native_labels,
    "a14_page_count": page_count,
    "a15_page_scan": page_scan,
    "a16_title_lookup": title_lookup,
    "a17_page_sentences": page_sentences,
    "a18_titles_by_id": titles_by_id,
    "b14_learned_decision": learned_decision,
    "b15_topic_evidence": topic_evidence,
    "b16_topic_phrases": topic_phrases,
    "b19_reference_urls": reference_urls,
    "b24_judgment_problems": judgment_problems,
    "b27_english_rows": english_rows,
    "c10_pairs_to_judge": pairs_to_judge,
    "c19_anchored_windows": anchored_windows,
    "d18_role_agreement": role_agreement,
    "e19_context_phrases": context_phrases,
    "f18_ordered_union": ordered_union,
    "f20_expectations": expectations,
    "g17_publication_notes": publication_notes,
    "g35_fallback_queries": fallback_queries,
    "h09_reading_units": reading_units,
    "h10_role_problems": role_problems,
    "h15_research_packet": research_packet,
    "j02_gold_variant": gold_variant,
    "j02_retrieved_variant": retrieved_variant,
    "j07_question_rows": question_rows,
    "k07_calibrator_choice": calibrator_choice,
    "k14_out_of_fold_auc": out_of_fold_auc,
    "l24_gold_read": gold_read,
    "l25_subgroup_calibration": subgroup_calibration,
    "l28_counting_report": counting_report,
    "l29_compare_models": compare_models,
    "m09_basis": basis,
}

_CLAUSES = f"unnest(list_transform(regexp_split_to_array(text, '[.!?,;:]'), lambda c: {S.tokens('c')})) AS toks"
_DISTINCT = "list_transform(list_filter(list_zip({l}, range(1, len({l}) + 1)), lambda z: list_position({l}, z[1]) = z[2]), lambda z: z[1])"
_LINES = r"list_filter(regexp_split_to_array(text, '\n+'), lambda s: trim(s, ' ') <> '')"
_SC = f"sc AS (SELECT * FROM (WITH {S.SCORED} SELECT * FROM scored))"


def _phrases(source: str, key: str) -> str:
    return f"""cl AS (SELECT {key}, {_CLAUSES} FROM {source}),
mk AS (SELECT {key}, array_to_string(list_transform(toks, lambda t: CASE WHEN t IN ({S.quoted(T.FUNCTION_WORDS)}) THEN '|' ELSE t END), ' ') AS s FROM cl),
rn AS (SELECT {key}, string_split(trim(r), ' ') AS w FROM (SELECT {key}, unnest(string_split(s, '|')) AS r FROM mk)),
ph AS (SELECT DISTINCT {key}, array_to_string(list_slice(w, i, i + least(3, len(w)) - 1), ' ') AS phrase FROM (SELECT {key}, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM rn WHERE len(w) >= 2))"""


_VARIANT = f"""WITH {S.SENTENCES}, w AS (SELECT doc_id, idx, len(regexp_split_to_array(trim(sentence), '\\s+')) AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM sents),
o AS (SELECT *, CASE WHEN {{gold}} AND idx = total - 1 THEN -1 ELSE idx END AS place FROM w),
u AS (SELECT *, 2 + sum(n) OVER (PARTITION BY doc_id ORDER BY place) AS upto, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS r FROM o)
SELECT doc_id AS id, coalesce(string_agg(CAST(idx AS VARCHAR), ',' ORDER BY r) FILTER (upto <= 60 OR place = -1), '') AS shown FROM u GROUP BY doc_id"""

ORACLES = {
    "a07_native_labels": "SELECT lang AS label, count(*) AS n FROM documents GROUP BY 1",
    "a14_page_count": "SELECT count(*) AS n_pages FROM documents",
    "a15_page_scan": f"""WITH {S.SENTENCES}, g AS (SELECT doc_id, count(*) AS n, sha1(string_agg(sentence, chr(10) ORDER BY idx)) AS h FROM sents GROUP BY 1)
SELECT doc_id, 'Page_' || source || '_' || doc_id AS title, coalesce(n, 0) AS n_sentences, coalesce(h, sha1('')) AS sentences_sha1 FROM documents LEFT JOIN g USING (doc_id)""",
    "a16_title_lookup": "SELECT a.title, p.doc_id FROM (SELECT 'Page_' || source || '_' || doc_id * 2 AS title FROM documents) a LEFT JOIN (SELECT doc_id, 'Page_' || source || '_' || doc_id AS title FROM documents) p USING (title)",
    "a17_page_sentences": f"WITH {S.SENTENCES} SELECT doc_id, idx, sentence FROM sents SEMI JOIN labels USING (doc_id)",
    "a18_titles_by_id": "SELECT doc_id, 'Page_' || source || '_' || doc_id AS title FROM documents WHERE doc_id IN (SELECT doc_id * 3 FROM labels)",
    "b14_learned_decision": f"""WITH e AS (SELECT vec_id AS id, list_transform(embedding[1:3], lambda x: CAST(x AS DOUBLE) * 10) AS lg FROM embeddings),
x AS (SELECT id, list_transform(lg, lambda v: exp(v - list_max(lg))) AS ex FROM e), p AS (SELECT id, (ex[2] + ex[3]) / list_sum(ex) AS s FROM x),
w AS (SELECT doc_id AS id, len(regexp_extract_all(text, '{T.CLAIM_WORD.replace(chr(39), chr(39) * 2)}')) AS n FROM documents)
SELECT id, n >= 4 AND s >= 0.5 AS worthy, CASE WHEN n < 4 THEN 'too_short' WHEN s >= 0.5 THEN 'check_worthy' ELSE 'below_factual_threshold' END AS reason, round(s, 6) AS score FROM p JOIN w USING (id)""",
    "b16_topic_phrases": f"WITH {_phrases('documents', 'doc_id')} SELECT doc_id, phrase FROM ph",
    "b19_reference_urls": r"""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 1 THEN regexp_replace(url, '^(https?://[^/]+)', '\1.') WHEN 2 THEN regexp_replace(url, '^(https?://[^/]+)', '\1..') WHEN 3 THEN url || '\x' ELSE url END AS url FROM pages),
p AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^https://([^/?#@:]+)(:443)?([/?][^#]*)?(#.*)?$', 1)), '\.$', '') AS h, regexp_extract(url, '^https://([^/?#@:]+)(:443)?([/?][^#]*)?(#.*)?$', 3) AS rest FROM u)
SELECT page_id, CASE WHEN contains(h, '.') AND NOT regexp_matches(h, '(^\.|\.$|\.local$|\.localhost$|\.internal$|^[0-9.]+$)') AND NOT regexp_matches(url, '[\s\\]') THEN 'https://' || h || rest ELSE '' END AS reference FROM p""",
    "b24_judgment_problems": f"""WITH {S.SENTENCES}, j AS (SELECT doc_id, idx, sentence AS t, idx % 6 AS k FROM sents),
m AS (SELECT *, CASE k WHEN 0 THEN 'unrelated' WHEN 1 THEN 'supports' ELSE 'states' END AS relation, CASE k WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'quoted' END WHEN 2 THEN substr(t, 1, 10) || '#' ELSE substr(t, 2, 12) END AS span,
 CASE k WHEN 3 THEN ['zzzz!'] WHEN 4 THEN list_transform(range(5), lambda i: substr(t, 1, 3)) ELSE [substr(t, 1, 3)] END AS q FROM j)
SELECT doc_id, idx, CASE WHEN relation NOT IN ('states', 'states_negation', 'bears_on', 'unrelated') THEN 'unknown_relation' WHEN NOT CASE WHEN relation = 'unrelated' THEN span = '' ELSE trim(span) <> '' AND contains(t, span) END THEN 'bad_span'
 WHEN len(q) > 4 OR len(list_filter(q, lambda x: trim(x) = '' OR NOT contains(t, x))) > 0 THEN 'bad_qualifiers' END AS problem FROM m""",
    "b27_english_rows": "SELECT doc_id, coalesce(regexp_full_match(CASE doc_id % 3 WHEN 0 THEN lang || '-US' WHEN 1 THEN lang || '_x' ELSE lang END, 'en(-[A-Za-z]{2,8})?'), false) AS english FROM documents",
    "c10_pairs_to_judge": f"WITH {S.BM25} SELECT item_id AS claim, item_id * 10 + k AS assertion_id, doc_id AS unit_id FROM benchmark, (SELECT unnest([0, 1]) AS k), ranked WHERE qid = item_id AND rank <= 10 AND doc_id % 3 > 0",
    "c19_anchored_windows": f"""WITH {S.BM25}, i AS (SELECT item_id AS qid, list_filter({_content('text')}, lambda t: regexp_full_match(t, '\\p{{L}}+')) AS own FROM benchmark), x AS (SELECT doc_id, {_content('substr(text, 1, 200)')} AS w FROM documents)
SELECT qid, doc_id, list_has_any(own, w) AS anchored FROM ranked JOIN i USING (qid) JOIN x USING (doc_id) WHERE rank <= 10""",
    "d18_role_agreement": f"""WITH n AS (SELECT [{S.quoted(D.ROLES)}] AS names), r AS (SELECT doc_id, list_distinct([names[doc_id % 9 + 1], names[n_chars % 9 + 1]]) AS got, [names[(doc_id + CASE WHEN n_chars % 3 = 0 THEN 1 ELSE 0 END) % 9 + 1]] AS wanted FROM documents, n),
m AS (SELECT role, list_contains(got, role) AS g, list_contains(wanted, role) AS w FROM (SELECT unnest(list_distinct(list_concat(got, wanted))) AS role, got, wanted FROM r)),
s AS (SELECT role, count(*) FILTER (g AND w) AS tp, count(*) FILTER (g AND NOT w) AS fp, count(*) FILTER (NOT g AND w) AS fn FROM m GROUP BY 1)
SELECT role, tp, fp, fn, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall, tp + fn AS support FROM s""",
    "f18_ordered_union": r"WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents), u AS (SELECT doc_id, list_concat(w[5:10], w[1:8]) AS l FROM w) SELECT doc_id, array_to_string(" + _DISTINCT.format(l="l") + ", ' ') AS words FROM u",
    "f20_expectations": """WITH r AS (SELECT DISTINCT doc_id AS key FROM documents WHERE doc_id % 5 = 0), q AS (SELECT DISTINCT doc_id * 2 AS key FROM documents WHERE doc_id % 20 < 2), a AS (SELECT * FROM r UNION SELECT * FROM q)
SELECT (SELECT count(*) FROM r WHERE NOT (key % 3 > 0)) AS withheld, (SELECT count(*) FROM q WHERE NOT (key % 3 = 0 AND key IN (SELECT doc_id FROM documents))) AS remaining, CAST(0 AS BIGINT) AS repeated,
 (SELECT count(*) FROM r SEMI JOIN q USING (key)) AS contradictory, (SELECT count(*) FROM a WHERE key NOT IN (SELECT doc_id FROM documents)) AS unknown""",
    "g17_publication_notes": f"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '2015-06' ELSE '20' || lpad(CAST(doc_id % 30 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 14 AS VARCHAR), 2, '0') || '-10' END AS p, CASE WHEN doc_id % 7 = 0 THEN '' ELSE '2015-06-15' END AS s FROM documents)
SELECT doc_id, CASE WHEN s = '' THEN '{N.NOTES['no_claim_date']}' WHEN length(p) < 10 OR try_cast(p AS DATE) IS NULL THEN '{N.NOTES['no_page_date']}' WHEN CAST(p AS DATE) > CAST(s AS DATE) THEN '{N.NOTES['later']}' ELSE '{N.NOTES['earlier']}' END AS note FROM x""",
    "h10_role_problems": f"""WITH {S.SENTENCES}, u AS (SELECT doc_id || ':' || idx AS unit_id, idx % 8 AS k FROM sents)
SELECT unit_id, CASE k WHEN 6 THEN 'repeated' WHEN 3 THEN 'invalid_roles' WHEN 4 THEN 'invalid_roles' WHEN 5 THEN 'invalid_roles' ELSE 'omitted' END AS problem FROM u WHERE k BETWEEN 1 AND 6 UNION ALL SELECT unit_id || 'x', 'invented' FROM u WHERE k = 2""",
    "h15_research_packet": f"""WITH l AS (SELECT doc_id AS id, {_LINES} AS ls FROM documents WHERE doc_id % 5 > 0 AND doc_id % 7 > 0),
c AS (SELECT id, list_concat(ls[1:1], ls[1:2]) AS e0, ls[2:4] AS r0 FROM l), e AS (SELECT id, {_DISTINCT.format(l='e0')} AS e, r0 FROM c),
k AS (SELECT id, e, list_filter({_DISTINCT.format(l='r0')}, lambda x: NOT list_contains(e, x)) AS r FROM e)
SELECT id, CAST(len(e) AS INT) AS n_excerpts, CAST(len(r) AS INT) AS n_context, sha1(array_to_string(e, chr(10))) AS excerpts_sha1, sha1(array_to_string(r, chr(10))) AS context_sha1 FROM k WHERE len(e) + len(r) > 0""",
    "j02_gold_variant": _VARIANT.format(gold="doc_id % 2 = 0"),
    "j02_retrieved_variant": _VARIANT.format(gold="false"),
    "j07_question_rows": """WITH p AS (SELECT q.conv_id, q.turn, q.text AS q, a.text AS a FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM p) SELECT conv_id AS id, 'Question ' || i AS title, CAST(i - 1 AS INT) AS idx, sha1(trim(concat_ws(' ', q, a), ' ')) AS text_sha1 FROM n""",
    "l24_gold_read": f"""WITH {S.BM25}, {S.GOLD}, f AS (SELECT g.qid, min(coalesce(rank, 2147483647)) AS first FROM (SELECT DISTINCT qid, doc_id FROM gold) g LEFT JOIN (SELECT * FROM ranked WHERE rank <= 25) r ON r.qid = g.qid AND r.doc_id = g.doc_id GROUP BY 1)
SELECT item_id AS qid, first <= item_id % 4 AS gold_read FROM benchmark LEFT JOIN f ON qid = item_id""",
    "l25_subgroup_calibration": f"""WITH {S.SCORED}, b AS (SELECT id % 4 AS part, greatest(ceil(confidence * 15) - 1, 0) AS bin, count(*) AS n, sum(confidence) AS c, count(*) FILTER (correct) AS h, sum(list_sum(list_transform(range(0, 10), lambda i: pow(p[i + 1] - CASE WHEN i = label THEN 1 ELSE 0 END, 2)))) AS br FROM scored GROUP BY 1, 2),
g AS (SELECT part, CAST(sum(n) AS BIGINT) AS n, sum(c) AS c, sum(h) AS h, sum(abs(c - h)) AS gap, sum(br) AS br FROM b GROUP BY 1 HAVING sum(n) >= 30)
SELECT part, n, round(h / n, 6) AS accuracy, round(gap / n, 6) AS ece, round(c / n, 6) AS mean_confidence, round((c - h) / n, 6) AS overconfidence, round(br / n, 6) AS brier FROM g""",
    "l28_counting_report": f"""WITH {S.SCORED}, r AS (SELECT unnest(list_filter(['all', CASE WHEN confidence >= 0.9 THEN 'band:strong' WHEN confidence >= 0.6 THEN 'band:moderate' WHEN confidence >= 0.3 THEN 'band:weak' ELSE 'abstained' END, CASE WHEN id % 2 = 0 THEN 'group:even' END, CASE WHEN id % 3 = 0 THEN 'group:third' END], lambda x: x IS NOT NULL)) AS part, correct, predicted < 3 AS k FROM scored),
t AS (SELECT count(*) FILTER (predicted < 3) AS whole FROM scored)
SELECT part, count(*) AS n, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) FILTER (k) AS counted, round(count(*) FILTER (k AND NOT correct) / greatest(count(*) FILTER (k), 1), 6) AS counting_error, round(count(*) FILTER (k) / greatest(max(whole), 1), 6) AS share_of_counted FROM r, t GROUP BY part""",
    "l29_compare_models": f"""WITH {S.SCORED}, l2 AS (SELECT id, label, list_transform(range(1, 11), lambda i: lg[i] * CASE WHEN i % 2 = 1 THEN 0.5 ELSE 1 END) AS l FROM scored), e2 AS (SELECT id, label, l, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM l2),
s2 AS (SELECT id, round(list_max(e) / list_sum(e), 9) AS f, list_position(l, list_max(l)) - 1 AS predicted, list_position(l, list_max(l)) - 1 = label AS correct FROM e2)
SELECT count(*) AS n, round(avg(CASE WHEN a.correct THEN 1.0 ELSE 0.0 END), 6) AS accuracy_a, round(avg(CASE WHEN b.correct THEN 1.0 ELSE 0.0 END), 6) AS accuracy_b, count(*) FILTER (a.predicted <> b.predicted) AS changed, round(corr(a.confidence, b.f), 6) AS confidence_correlation FROM scored a JOIN s2 b USING (id)""",
    "m09_basis": """WITH r AS (SELECT n_chars AS a, source, min(doc_id) AS pos FROM documents WHERE doc_id % 3 < 2 GROUP BY 1, 2),
s AS (SELECT a, count(*) AS n, string_agg(source || ' (published 2020-01-' || lpad(CAST(pos % 28 + 1 AS VARCHAR), 2, '0') || ')', ', ' ORDER BY pos) AS s FROM r GROUP BY 1)
SELECT a AS assertion_id, CASE WHEN n = 1 THEN 'one source: ' || s ELSE n || ' independent sources: ' || s END AS basis FROM s""",
}
