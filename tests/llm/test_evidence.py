"""Language evidence and the covering learner against plain versions, and the pipeline on odd rows."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veristrata.llm import language_id, quality_rules
from veristrata.llm.common import materialise


def _fused(model, rows):
    """(language, confidence) by id, of rows (id, text, host, suffix, declared), step by step as the operator's docstring says."""
    n = len(model.languages)

    def soft(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    likelihood = {}
    for i, text, *_ in rows:
        grams = language_id.trigrams((text or "").encode())
        likelihood[i] = (model.scores[grams].sum(axis=0) * min(1.0, language_id.EFFECTIVE / len(grams))).tolist() if len(grams) else None
    posterior = {i: soft(x) for i, x in likelihood.items() if x}

    def counts(column):
        out = {}
        for row in rows:
            if row[column] is not None and row[0] in posterior:
                total = out.setdefault(row[column].lower(), [0.0] * n)
                out[row[column].lower()] = [a + b for a, b in zip(total, posterior[row[0]])]
        return out

    whole = [sum(p[k] for p in posterior.values()) for k in range(n)]
    prior = [(c + 1) / (sum(whole) + n) for c in whole]
    strength = language_id.STRENGTH
    share = lambda c: [(x + strength * q) / (sum(c) + strength) for x, q in zip(c, prior)]
    suffixes, declared = ({k: share(c) for k, c in counts(column).items()} for column in (3, 4))
    hosts = counts(2)
    of_host = {}
    for row in rows:
        if row[2] is not None and row[3] is not None and row[0] in posterior:
            of_host[row[2].lower()] = max(of_host.get(row[2].lower(), ""), row[3].lower())
    out = {}
    for i, _, host, suffix, says in rows:
        if i not in posterior:
            out[i] = (None, 0.0)
            continue
        fused = []
        for k in range(n):
            if host is not None:
                c, broader = hosts[host.lower()], suffixes.get(of_host.get(host.lower()), prior)
                own = (max(c[k] - posterior[i][k], 0.0) + strength * broader[k]) / (max(sum(c) - 1, 0.0) + strength)
            else:
                own = suffixes[suffix.lower()][k] if suffix is not None else prior[k]
            fused.append(likelihood[i][k] + math.log(own) + (math.log(declared[says.lower()][k] / prior[k]) if says is not None else 0.0))
        p = soft(fused)
        out[i] = (model.languages[p.index(max(p))], max(p))
    return out


def _rows():
    rng = random.Random(12)
    parts = {"de": ["sch", "ung", "ein"], "en": ["the", "ing", "and"], "fr": ["eau", "que", "oi"]}
    rows = []
    for i in range(150):
        g = rng.choice(list(parts))
        text = " ".join("".join(rng.choices(parts[g], k=2)) for _ in range(rng.randint(1, 9)))
        rows.append((i, rng.choice([text] * 6 + [None, "12 3"]), rng.choice([None, f"{g}.Site", "mixed.org"]), rng.choice([None, g.upper(), "org"]), rng.choice([None, g, "xx"])))
    return rows, parts


def test_fusion_against_a_plain_version(spark):
    """All four kinds of evidence, absent ones, mixed case, rows without text, repeated rows."""
    rows, parts = _rows()
    rng = random.Random(1)
    train = [(i, " ".join("".join(rng.choices(parts[g], k=2)) for _ in range(20)), g) for i, g in enumerate(list(parts) * 15)]
    model = language_id.learn(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    frame = spark.createDataFrame([*rows, *rows[:5]], "id long, text string, h string, s string, d string")
    got = language_id.identify(frame, model, ["id"], host=F.col("h"), suffix=F.col("s"), declared=F.col("d")).collect()
    assert len(got) == len(rows) + 5
    # each repeated row counts: give its copies ids of their own for the plain version
    plain = [*rows, *[(1000 + r[0], *r[1:]) for r in rows[:5]]]
    want = _fused(model, plain)
    for r in got:
        assert r.language == want[r.id][0] and abs(r.confidence - want[r.id][1]) < 1e-9 and r.accepted == (want[r.id][1] >= language_id.ACCEPT), r.id


def test_equal_posteriors_take_the_first_language(spark):
    train = [(i, "aa bb cc", "zz" if i % 2 else "bb") for i in range(40)]
    model = language_id.learn(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    got = language_id.identify(spark.createDataFrame([(1, "aa bb")], "doc_id long, text string"), model).first()
    assert got.language == "bb" and abs(got.confidence - 0.5) < 1e-9 and got.accepted


def test_sample_is_the_smallest_hashes(spark):
    """Of many rows of a language those with the least hashes are learned from, one pass over the table for all languages."""
    rows = [(i, f"w{i % 50}x", "en" if i % 10 else "fr") for i in range(4000)] + [(None, "zzz", "en"), (7, "yyy", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    one, two = (language_id.learn(x, 60) for x in (frame, frame.coalesce(1)))
    assert one.languages == ["en", "fr"] and (one.scores == two.scores).all()
    order = spark.createDataFrame(rows[:4000], "doc_id long, text string, lang string").selectExpr("lang", "text", "xxhash64(doc_id) & 9223372036854775807 as h").collect()
    chosen = sorted((r.h, r.text) for r in order if r.lang == "en")[:60]
    counts = np.zeros(1 << language_id.BITS)
    for _, t in chosen:
        counts += np.bincount(language_id.trigrams(t.encode()), minlength=1 << language_id.BITS)
    smooth = counts + 0.1
    assert np.allclose(one.scores[:, 0], np.log(smooth / smooth.sum()))


def test_pages_give_their_evidence(spark):
    """Host, suffix, declaration and visible text of a page, as found by Python."""
    train = [(i, ("the and ing " if i % 2 else "sch ung ein ") * 5, "en" if i % 2 else "de") for i in range(60)]
    model = language_id.learn(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    pages = [
        (1, "https://u:p@News.Site.DE:443/a?b#c", "<html class=x lang='de-DE'><style>the and ing</style><p>sch ung&nbsp;ein</p>"),
        (2, "http://site.org", "<HTML LANG=en><body>the <script>sch</script>and</body></html>"),
        (3, "ftp:/nohost", "<p>ing the"),
        (4, "https://localhost/x", ""),
        (5, None, None),
        (6, "https://site.org/2", "<html data-lang=fr><p>ung</p>"),
    ]
    got = {r.page_id: r for r in language_id.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    plain = []
    for i, url, html in pages:
        host = re.match(r"[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", url or "")
        host = host[1] if host else None
        said = re.search(r"(?i)<html[^>]*\blang=[\"']?([a-z]{2,3})", html or "")
        text = re.sub(r"<[^>]*>|&[a-zA-Z#0-9]+;", " ", re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", html)) if html else None
        plain.append((i, text, host, host.split(".")[-1] if host and "." in host else None, said[1] if said else None))
    assert [p[2] for p in plain] == ["News.Site.DE", "site.org", None, "localhost", None, "site.org"] and [p[4] for p in plain][:2] == ["de", "en"]
    want = _fused(model, plain)
    assert {i: (r.language, round(r.confidence, 9)) for i, r in got.items()} == {i: (g, round(c, 9)) for i, (g, c) in want.items()}


def test_covering_against_a_plain_learner():
    """The same rules as a learner that looks at rows, not cells."""
    rng = random.Random(9)
    for seed in range(3):
        rows = [{"a": rng.random(), "b": rng.random(), "grow": rng.random() < 0.67} for _ in range(400)]
        for r in rows:
            r["low"] = rng.random() < (0.95 if r["a"] > 0.7 and r["b"] < 0.5 else 0.9 if r["b"] > 0.9 else 0.05)
        cuts = {"a": [i / 10 for i in range(1, 10)], "b": [i / 10 for i in range(1, 10)]}
        holds = lambda r, c: (r[c[0]] > c[2]) == c[1]
        choices = [(f, above, cut) for f in cuts for cut in cuts[f] for above in (True, False)]
        rest, want = rows, []
        while len(want) < quality_rules.MOST_RULES:
            taken, inside = [], rest
            while len(taken) < quality_rules.MOST_CONDITIONS:
                grow = [r for r in inside if r["grow"]]
                low = sum(r["low"] for r in grow)
                if not low or low == len(grow):
                    break
                best = (1e-9, None)
                for c in choices:
                    got = [r for r in grow if holds(r, c)]
                    hits = sum(r["low"] for r in got)
                    if hits and quality_rules.LEAST_COVER <= len(got) < len(grow):
                        gain = hits * (math.log2(hits / len(got)) - math.log2(low / len(grow)))
                        if gain > best[0]:
                            best = (gain, c)
                if best[1] is None:
                    break
                taken.append(best[1])
                inside = [r for r in inside if holds(r, best[1])]

            def precision(conditions):
                got = [r for r in rest if not r["grow"] and all(holds(r, c) for c in conditions)]
                return (sum(r["low"] for r in got) + 1) / (len(got) + 2)

            while len(taken) > 1 and precision(taken[:-1]) >= precision(taken):
                taken.pop()
            found = [r for r in rest if taken and all(holds(r, c) for c in taken)]
            low = sum(r["low"] for r in found)
            if len(found) < quality_rules.LEAST_COVER or low < quality_rules.PRECISION * len(found):
                break
            want.append((taken, len(found), low))
            rest = [r for r in rest if not all(holds(r, c) for c in taken)]
        cells = {}
        for r in rows:
            key = tuple(sum(r[f] > c for c in cuts[f]) for f in cuts)
            cell = cells.setdefault(key, dict(zip(cuts, key), grow_low=0, grow_all=0, prune_low=0, prune_all=0))
            part = "grow" if r["grow"] else "prune"
            cell[f"{part}_all"] += 1
            cell[f"{part}_low"] += r["low"]
        got = quality_rules.cover(list(cells.values()), cuts)
        assert [([(c.feature, c.above, c.cut) for c in rule.conditions], rule.covered, rule.low) for rule in got] == want and len(want) >= 2


def test_decisions_apply_the_rules(spark):
    """kept is what the learned rules say, in order, and false where the base conditions fail; repeated rows, empty tables."""
    rng = random.Random(2)
    texts = [(i, " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(5, 60))) + (" $ # |" * rng.randint(0, 6))) for i in range(300)]
    texts += [(400, None), (400, ""), texts[3], texts[3]]
    docs = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, int(t.count("$") < 3), 0) for i, t in texts[:300]], "doc_id long, quality int, toxic int")
    rules = quality_rules.learn(docs, labels)
    out = quality_rules.quality_rules(docs, labels).collect()
    assert rules and len(out) == len(texts)
    value = {"n_words": lambda r: float(r.n_words), "symbol_share": lambda r: r.n_symbols / max(r.n_words, 1), "mean_word": lambda r: r.word_chars / max(r.n_words, 1), "dup_lines": lambda r: r.n_dup_lines / max(r.n_words, 1), "repeat_share": lambda r: r.n_repeat_words / max(r.n_words, 1)}
    for r in out:
        base = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        rejected = any(all((value[c.feature](r) > c.cut) == c.above for c in rule.conditions) for rule in rules)
        assert r.base_failed == base and r.kept == (not base and not rejected)
    assert quality_rules.quality_rules(docs.where("doc_id < 0"), labels).count() == 0


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rng = random.Random(3)
    words = [f"word{i}" for i in range(400)]
    body = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = body(20)
    passage = body(60)
    rows = [(i, body(40), "en", f"s{i % 3}") for i in range(60)]
    rows += [(70, passage + " " + body(80), "en", "s0"), (71, body(80) + " " + passage, "en", "s0")]
    rows += [(80, "", "en", "s1"), (81, None, "en", "s1"), (82, " \n ", "en", None), (None, body(50), "en", "s1"), (None, item, "en", "s2"), (None, "12 34", "en", "s2")]
    rows += [(83, item + " " + body(5), "en", "s1"), (83, body(45), "en", "s1"), (84, rows[5][1], "en", "s0"), (5, rows[5][1], "en", "s2"), (None, rows[6][1], "en", "s0"), rows[7], rows[7]]
    rows += [(90, "long " + " ".join(f"l{i}" for i in range(700_000)), "en", "s1"), (91, "x" * 300_000, "en", "s1")]
    frame = spark.createDataFrame([(*r[:2], r[2], r[3], len(r[1] or ""), "k", "k") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _key string, component string")
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, item, passage


def test_pipeline_on_odd_rows(spark, odd):
    folder, rows, item, passage = odd
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, folder), name)
        kept.append([(r.doc_id, r["text"] if "text" in docs.columns else r.round_trip) for r in docs.collect()])
    language, near, passages, clean, pieces = kept
    gone = [r for r in rows if (r[0], r[1]) not in language]
    assert sorted(map(str, {r[:2] for r in gone})) == sorted(map(str, {(80, ""), (81, None), (82, " \n "), (None, "12 34")}))
    # one row stays of equal texts: the least id, null last; of repeated rows one
    assert near.count(rows[7][:2]) == 1 and sum(t == rows[5][1] for _, t in near) == 1 and (5, rows[5][1]) in near
    assert (None, rows[6][1]) not in near and (6, rows[6][1]) in near and len(near) == len(set(near)) == len({t for _, t in near})
    assert {t for _, t in near} == {t for _, t in language}
    assert (71, next(t for i, t in near if i == 71)[: -len(passage) - 1]) in passages and (70, rows[60][1]) in passages
    # the contaminated rows go, the other row of doc 83 and clean rows without an id stay
    assert {t for _, t in passages} - {t for _, t in clean} == {item, next(r[1] for r in rows if r[0] == 83 and r[1].startswith(item))}
    assert sum(i == 83 for i, _ in clean) == 1 and sum(i is None for i, _ in clean) == 1
    assert len(pieces) == len(clean) and all(x for _, x in pieces)


def test_pipeline_on_empty_tables(spark, odd, tmp_path):
    folder = odd[0]
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
