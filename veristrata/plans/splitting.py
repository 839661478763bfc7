"""Queries: splits, their summaries and integrity checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from veristrata.functions import text as T
from veristrata.operators import metrics as M
from veristrata.operators import splits as X
from veristrata.plans import sql as S
from veristrata.sources.tables import read


def _labelled(spark, d):
    docs = read(spark, d, "documents").select("doc_id", T.claim_key(F.col("text")).alias("key"))
    return docs.join(read(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


def stratified_split(spark, d):
    return X.stratified_split(_labelled(spark, d), {"calibration": 0.5}, "test", X.CALIBRATION_SALT).select("doc_id", "label", "split")


def holdout(spark, d):
    return X.holdout(_labelled(spark, d), 5).select("doc_id", "held")


def three_way_split(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("key"), F.col("o_orderpriority").alias("label"))
    return X.stratified_split(orders, {"calibration": 0.14, "test": 0.14}, "train", X.THREE_WAY_SALT).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_keys"))


def carved_trainval(spark, d):
    return X.stratified_split(_labelled(spark, d), {"trainval": 0.12}, "train", X.CARVE_SALT).select("doc_id", "split")


def group_split(spark, d):
    docs = read(spark, d, "documents")
    names = X.group_split(docs.select(F.col("source").alias("name")), 6, 5)
    return docs.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n")).join(F.broadcast(names), "name").select("name", "split", "n")


def budget_prefix(spark, d):
    counts = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n"))
    return X.budget_prefix(counts, 5000, "pair-judge-mnli-v1")


def drop_leaked(spark, d):
    rows = X.stratified_split(_labelled(spark, d), {"calibration": 0.5}, "test", X.CALIBRATION_SALT)
    train = read(spark, d, "documents").select("doc_id", T.claim_key(F.col("text")).alias("key"))
    return X.drop_leaked(train, rows).select("doc_id")


def split_integrity(spark, d):
    rows = X.stratified_split(_labelled(spark, d), {"calibration": 0.5}, "test", X.CALIBRATION_SALT)
    return X.split_conflicts(rows).agg(F.count("*").alias("conflicts"))


def split_summary(spark, d):
    return X.split_summary(X.stratified_split(_labelled(spark, d), {"calibration": 0.5}, "test", X.CALIBRATION_SALT))


def label_counts(spark, d):
    every = spark.createDataFrame([(0,), (1,), (2,)], "label int")
    return every.join(_labelled(spark, d).groupBy("label").agg(F.count("*").alias("n")), "label", "left").fillna(0, ["n"])


def label_prior(spark, d):
    counts = _labelled(spark, d).groupBy("label").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("label", M.r6(F.col("n") / F.col("total")).alias("prior"))


def folds(spark, d):
    return X.folds(read(spark, d, "embeddings").select(F.col("vec_id").alias("id")), 5, 0)


def systematic_sample(spark, d):
    return X.systematic(read(spark, d, "documents").select("doc_id"), 3, "doc_id")


def row_validation(spark, d):
    """Violations of labelled rows: repeated ids, missing documents, labels out of range."""
    labels, docs = read(spark, d, "labels"), read(spark, d, "documents").select("doc_id")
    repeated = labels.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit("repeated").alias("problem"))
    missing = labels.join(docs, "doc_id", "left_anti").select("doc_id", F.lit("no_document").alias("problem"))
    outside = labels.where("quality not in (0, 1) or toxic not in (0, 1)").select("doc_id", F.lit("bad_label").alias("problem"))
    problems = repeated.unionByName(missing).unionByName(outside)
    return problems.groupBy("problem").agg(F.count("*").alias("n")).unionByName(labels.agg(F.lit("rows").alias("problem"), F.count("*").alias("n")))


def naive_bayes_fit(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select(F.col("quality").alias("label"), T.tokens(F.col("text")).alias("t"))
    _, likelihood = M.naive_bayes(rows)
    first = likelihood.groupBy("term").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "term").limit(100).select("term")
    return likelihood.join(F.broadcast(first), "term").select("term", "label", "n", M.r6("log_likelihood").alias("log_likelihood"))


def all_naive_bayes_fit(spark, d):
    """Every term of the vocabulary with every label, those that the label's documents lack too."""
    labels = read(spark, d, "labels").where("quality is not null").select("doc_id", F.col("quality").alias("label"))
    few = labels.limit(2_000_001).count() <= 2_000_000
    rows = read(spark, d, "documents").select("doc_id", "text").join(F.broadcast(labels) if few else labels, "doc_id")
    counts = rows.select("label", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("label", "term").agg(F.count("*").alias("n"))
    terms = counts.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("by_label"))
    mass = counts.groupBy("label").agg(F.sum("n").alias("mass"))
    classes = rows.select("label").distinct().join(F.broadcast(mass), "label", "left").crossJoin(F.broadcast(terms.agg(F.count("*").alias("size"))))
    every = terms.crossJoin(F.broadcast(classes)).withColumn("n", F.coalesce(F.try_element_at("by_label", "label"), F.lit(0)).cast("long"))
    return every.select("term", "label", "n", M.r6(F.log((F.col("n") + 1) / (F.coalesce("mass", F.lit(0)) + F.col("size")))).alias("log_likelihood"))


def naive_bayes_lift(spark, d):
    docs = read(spark, d, "documents").select("doc_id", T.claim_key(F.col("text")).alias("key"), T.tokens(F.col("text")).alias("t"))
    split = X.stratified_split(_labelled(spark, d), {"train": 0.5}, "test", X.CALIBRATION_SALT).select("doc_id", "label", "split")
    rows = docs.join(split, "doc_id")
    classes, likelihood = M.naive_bayes(rows.where("split = 'train'").select("label", "t"))
    test = rows.where("split = 'test'")
    predicted = M.naive_bayes_predict(test.select(F.col("doc_id").alias("id"), "t"), classes, likelihood)
    right = test.select(F.col("doc_id").alias("id"), "label").join(predicted, "id").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))
    most = test.groupBy("label").agg(F.count("*").alias("c")).agg((F.max("c") / F.sum("c")).alias("majority"))
    return right.crossJoin(most).select("n", M.r6("accuracy").alias("accuracy"), M.r6("majority").alias("majority"), M.r6(F.col("accuracy") - F.col("majority")).alias("lift"))


QUERIES = {
    "f01_stratified_split": stratified_split,
    "f02_holdout": holdout,
    "f03_three_way_split": three_way_split,
    "f04_carved_trainval": carved_trainval,
    "f05_group_split": group_split,
    "f06_budget_prefix": budget_prefix,
    "c05_drop_leaked": drop_leaked,
    "f07_split_integrity": split_integrity,
    "d05_split_summary": split_summary,
    "d04_label_counts": label_counts,
    "d07_label_prior": label_prior,
    "f16_folds": folds,
    "f17_systematic_sample": systematic_sample,
    "f08_row_validation": row_validation,
    "d11_naive_bayes_fit": naive_bayes_fit,
    "d11_all_naive_bayes_fit": all_naive_bayes_fit,
    "l23_naive_bayes_lift": naive_bayes_lift,
}

_HALF = f"WITH {S.LABELLED}, {S.keys(X.CALIBRATION_SALT)}, sp AS (SELECT doc_id, r.label, r.key, CASE WHEN pos <= round_even(n * 0.5, 0) THEN 'calibration' ELSE 'test' END AS split FROM rows_ r JOIN keys USING (key))"
_ORDERS = "o_ AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS key, o_orderpriority AS label FROM orders)"
_NB = f"""tr AS (SELECT label, {S.tokens('text')} AS t FROM (SELECT quality AS label, text FROM documents JOIN labels USING (doc_id)))"""

ORACLES = {
    "f01_stratified_split": _HALF + " SELECT doc_id, label, split FROM sp",
    "f02_holdout": f"WITH {S.LABELLED}, {S.keys(X.HOLDOUT_SALT)} SELECT doc_id, pos <= 5 AS held FROM rows_ JOIN keys USING (key)",
    "f03_three_way_split": f"""WITH {_ORDERS}, {S.keys(X.THREE_WAY_SALT, 'o_')}
SELECT CASE WHEN pos <= round_even(n * CAST(0.14 AS DOUBLE), 0) THEN 'calibration' WHEN pos <= round_even(n * CAST(0.14 AS DOUBLE), 0) * 2 THEN 'test' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT key) AS n_keys FROM o_ JOIN keys USING (key) GROUP BY 1""",
    "f04_carved_trainval": f"WITH {S.LABELLED}, {S.keys(X.CARVE_SALT)} SELECT doc_id, CASE WHEN pos <= round_even(n * CAST(0.12 AS DOUBLE), 0) THEN 'trainval' ELSE 'train' END AS split FROM rows_ JOIN keys USING (key)",
    "f05_group_split": f"""WITH g AS (SELECT source AS name, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY sha256('{X.GROUP_SALT}:' || name), name) AS pos FROM g)
SELECT name, CASE WHEN pos <= 6 THEN 'test' WHEN pos <= 11 THEN 'calibration' ELSE 'train' END AS split, n FROM r""",
    "f06_budget_prefix": """WITH g AS (SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1),
r AS (SELECT key, n, CAST(sum(n) OVER (ORDER BY substr(sha1('pair-judge-mnli-v1:' || key), 1, 16), key) AS BIGINT) AS running FROM g) SELECT * FROM r WHERE running <= 5000""",
    "c05_drop_leaked": f"WITH {S.LABELLED} SELECT doc_id FROM documents WHERE {S.claim_key('text')} NOT IN (SELECT key FROM rows_)",
    "f07_split_integrity": _HALF + " SELECT count(*) AS conflicts FROM (SELECT key FROM sp GROUP BY key HAVING count(DISTINCT split) > 1)",
    "d05_split_summary": _HALF + ", t AS (SELECT split, count(*) AS total FROM sp GROUP BY split), g AS (SELECT split, label, count(*) AS n FROM sp GROUP BY GROUPING SETS ((split, label), (split))) SELECT split, label, n, round(n / total, 6) AS share FROM g JOIN t USING (split)",
    "d04_label_counts": f"WITH {S.LABELLED}, e AS (SELECT CAST(unnest([0, 1, 2]) AS INT) AS label) SELECT label, count(doc_id) AS n FROM e LEFT JOIN rows_ USING (label) GROUP BY label",
    "d07_label_prior": f"WITH {S.LABELLED} SELECT label, round(count(*) / sum(count(*)) OVER (), 6) AS prior FROM rows_ GROUP BY label",
    "f16_folds": "SELECT vec_id AS id, CAST(ntile(5) OVER (ORDER BY substr(sha1('0:' || vec_id), 1, 16), vec_id) - 1 AS INT) AS fold FROM embeddings",
    "f17_systematic_sample": "SELECT doc_id FROM documents WHERE doc_id % 3 = 0",
    "f08_row_validation": """SELECT 'rows' AS problem, count(*) AS n FROM labels UNION ALL SELECT 'repeated', n FROM (SELECT count(*) AS n FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)) WHERE n > 0
UNION ALL SELECT 'no_document', n FROM (SELECT count(*) AS n FROM labels ANTI JOIN documents USING (doc_id)) WHERE n > 0 UNION ALL SELECT 'bad_label', n FROM (SELECT count(*) AS n FROM labels WHERE quality NOT IN (0, 1) OR toxic NOT IN (0, 1)) WHERE n > 0""",
    "d11_naive_bayes_fit": f"""WITH {_NB}, c AS (SELECT label, term, count(*) AS n FROM (SELECT label, unnest(t) AS term FROM tr) GROUP BY ALL), v AS (SELECT count(DISTINCT term) AS size FROM c),
m AS (SELECT label, sum(n) AS mass FROM c GROUP BY label), f AS (SELECT term FROM c GROUP BY term ORDER BY sum(n) DESC, term LIMIT 100)
SELECT term, label, n, round(ln((n + 1) / (mass + size)), 6) AS log_likelihood FROM c JOIN m USING (label) SEMI JOIN f USING (term), v""".replace("SEMI JOIN f USING (term), v", "CROSS JOIN v SEMI JOIN f USING (term)"),
    "d11_all_naive_bayes_fit": f"""WITH tr AS (SELECT label, {S.tokens('text')} AS t FROM (SELECT quality AS label, text FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)),
c AS (SELECT label, term, count(*) AS n FROM (SELECT label, unnest(t) AS term FROM tr) GROUP BY ALL), v AS (SELECT count(DISTINCT term) AS size FROM c),
k AS (SELECT tr.label, coalesce(any_value(mass), 0) AS mass FROM tr LEFT JOIN (SELECT label, sum(n) AS mass FROM c GROUP BY label) m ON m.label = tr.label GROUP BY tr.label), w AS (SELECT DISTINCT term FROM c)
SELECT w.term, k.label, CAST(coalesce(n, 0) AS BIGINT) AS n, round(ln((coalesce(n, 0) + 1) / (mass + size)), 6) AS log_likelihood
FROM w CROSS JOIN k CROSS JOIN v LEFT JOIN c ON c.term = w.term AND c.label = k.label""",
    "l23_naive_bayes_lift": f"""WITH {S.LABELLED}, {S.keys(X.CALIBRATION_SALT)}, sp AS (SELECT doc_id, r.label, CASE WHEN pos <= round_even(n * 0.5, 0) THEN 'train' ELSE 'test' END AS split FROM rows_ r JOIN keys USING (key)),
d AS (SELECT doc_id, label, split, {S.tokens('text')} AS t FROM documents JOIN sp USING (doc_id)),
c AS (SELECT label, term, count(*) AS n FROM (SELECT label, unnest(t) AS term FROM d WHERE split = 'train') GROUP BY ALL), v AS (SELECT count(DISTINCT term) AS size FROM c),
cl AS (SELECT label, ln(count(*) / (SELECT count(*) FROM d WHERE split = 'train')) AS prior, (SELECT sum(n) FROM c WHERE c.label = d.label) + (SELECT size FROM v) AS den FROM d WHERE split = 'train' GROUP BY label),
h AS (SELECT doc_id, term, count(*) AS k FROM (SELECT doc_id, unnest(t) AS term FROM d WHERE split = 'test') SEMI JOIN c USING (term) GROUP BY ALL),
s AS (SELECT h.doc_id, cl.label, sum(k * coalesce(ln((c.n + 1) / den), ln(1 / den))) AS part FROM h CROSS JOIN cl LEFT JOIN c ON c.term = h.term AND c.label = cl.label GROUP BY ALL),
pr AS (SELECT d.doc_id, d.label AS gold, cl.label, round(prior + coalesce(part, 0), 6) AS sc FROM d CROSS JOIN cl LEFT JOIN s ON s.doc_id = d.doc_id AND s.label = cl.label WHERE split = 'test'),
b AS (SELECT doc_id, gold, label, row_number() OVER (PARTITION BY doc_id ORDER BY sc DESC, label) AS n FROM pr),
a AS (SELECT count(*) AS n, avg(CASE WHEN gold = label THEN 1.0 ELSE 0.0 END) AS accuracy FROM b WHERE n = 1), mj AS (SELECT max(c) / sum(c) AS majority FROM (SELECT count(*) AS c FROM d WHERE split = 'test' GROUP BY label))
SELECT n, round(accuracy, 6) AS accuracy, round(majority, 6) AS majority, round(accuracy - majority, 6) AS lift FROM a, mj""",
}
