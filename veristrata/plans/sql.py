"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from veristrata.functions import text as T


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def unescape(column: str) -> str:
    for escape, plain in T.ESCAPES.items():
        column = f"replace({column}, '{escape}', '{plain}')"
    return column


def tokens(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower(replace({unescape(column)}, '_', ' ')), '[\\p{{L}}\\p{{N}}_]+'), lambda t: t NOT IN ({quoted(T.ESCAPE_TOKENS)}))"


def claim_key(column: str) -> str:
    return f"trim(regexp_replace(lower({column}), '\\s+', ' ', 'g'))"


#: p: id, label, lg (logits), p, confidence, predicted, correct
SCORED = """
lg AS (SELECT vec_id AS id, CAST(label AS INT) AS label, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE) * 10) AS lg FROM embeddings),
ex AS (SELECT id, label, lg, list_transform(lg, lambda x: exp(x - list_max(lg))) AS e FROM lg),
sm AS (SELECT id, label, lg, list_transform(e, lambda x: x / list_sum(e)) AS p FROM ex),
scored AS (SELECT id, label, lg, p, round(list_max(p), 9) AS confidence, CAST(list_position(lg, list_max(lg)) - 1 AS INT) AS predicted, list_position(lg, list_max(lg)) - 1 = label AS correct FROM sm)"""

#: the index and the ranking of benchmark items over documents
BM25 = f"""
dt AS (SELECT doc_id, {tokens('text')} AS t FROM documents),
dl AS (SELECT doc_id, len(t) AS dl FROM dt),
whole AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
tok AS (SELECT doc_id, unnest(t) AS term FROM dt),
post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({tokens('text')}) AS term FROM benchmark) GROUP BY qid, term),
w AS (SELECT qid, term, qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS weight FROM q JOIN df USING (term), whole),
sc AS (SELECT qid, doc_id, round(sum(weight * least(tf, 255) * 2.2 / (least(tf, 255) + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM w JOIN post USING (term) JOIN dl USING (doc_id), whole GROUP BY qid, doc_id),
ranked AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, score FROM sc WHERE score > 0)"""

TITLES = f"""
titles AS (SELECT doc_id, array_to_string(list_slice({tokens('text')}, 1, 2), ' ') AS norm FROM documents),
ct AS (SELECT item_id AS qid, {tokens('text')} AS t FROM benchmark),
sizes AS (SELECT qid, t, unnest(range(1, 9)) AS size FROM ct),
starts AS (SELECT qid, t, size, unnest(range(1, len(t) - size + 2)) AS start FROM sizes WHERE len(t) >= size),
runs AS (SELECT qid, size, start, array_to_string(list_slice(t, start, start + size - 1), ' ') AS norm FROM starts),
hits AS (SELECT qid, doc_id, size, start, row_number() OVER (PARTITION BY qid, doc_id ORDER BY size DESC, start) AS n FROM runs JOIN titles USING (norm) WHERE norm <> ''),
cand AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY size DESC, start, doc_id) AS pos FROM hits WHERE n = 1)"""

GOLD = """
gi AS (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS item FROM benchmark), gd AS (SELECT doc_id, ' ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) || ' ' AS doc FROM documents),
gold AS (SELECT item_id AS qid, doc_id FROM gi, gd WHERE item <> '' AND contains(doc, ' ' || item || ' '))"""

#: labelled rows with key and label
LABELLED = f"""
rows_ AS (SELECT doc_id, {claim_key('text')} AS key, quality AS label FROM documents JOIN labels USING (doc_id))"""


def keys(salt: str, source: str = "rows_") -> str:
    return f"""
k0 AS (SELECT key, min(label) AS label FROM {source} GROUP BY key),
keys AS (SELECT key, label, count(*) OVER (PARTITION BY label) AS n,
         row_number() OVER (PARTITION BY label ORDER BY substr(sha1('{salt}:' || key), 1, 16), key) AS pos FROM k0)"""


SENTENCES = r"""
cut AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', E'\\1\n', 'g'), '\n+'), lambda s: trim(s)), lambda s: s <> '') AS ss FROM documents),
sents AS (SELECT doc_id, unnest(ss) AS sentence, unnest(range(0, len(ss))) AS idx FROM cut)""".replace(r"E'\\1\n'", r"'\1' || chr(10)")
