"""Steps of researching a claim: law titles, search queries, page allowances, reading windows, references and captions.

Null texts have no mentions, terms or blocks. Array functions here can't compose text, so give composed text (functions.text.nfc).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veristrata.functions import claims as K
from veristrata.functions import text as T
from veristrata.operators.numbering import numbered
from veristrata.sources.tables import small

# They decide results.
LAW_REFERENCE = r"(?i)\b(?:(?:it|this|that) became law|(?:this|that|the) (?:law|act|bill))\b"
LAW_NAME = r"\b(?:[A-Z][\w'-]*\s+){1,7}(?:Act|Bill|Law)(?:\s+of\s+\d{4})?\b"
ARTICLES = ("The ", "This ", "That ")
REFERENTIAL = r"(?i)\b(it|its|this|that|these|those|we|our|ours|they|their|he|she|his|her)\b"
CUE = r"^\[(?:(\d+):)?(\d+):(\d+)\]\s+(.*)$"
RELATION_OF = {"entailment": "states", "contradiction": "states_negation", "neutral": "bears_on"}

TOPIC_WORDS = 96
CONTEXT_WORDS = 48
MOST_HITS = 20
MOST_CANDIDATES = 20
MOST_READS = 2
MOST_CHOICES = 2
MOST_BLOCKS = 9
NEAR_BLOCKS = 4
LAST_CUE_SECONDS = 3.0
CUE_GAP = 0.01

FEATURES = (
    "top_score mean_score min_score score_std score_decay score_margin score_ratio distinct_pages top_page_share first_page_change n_read"
    " max_prob prob_margin entropy"
).split()


def law_mentions(text: Column) -> Column:
    """Capitalised names that end in Act, Bill or Law as (text, start, end), without an article before them; one word alone is none."""

    def bare(m: Column) -> Column:
        skip = F.lit(0)
        for article in ARTICLES:
            skip = F.when(m["text"].startswith(article), len(article)).otherwise(skip)
        return F.struct(F.substring(m["text"], skip + 1, F.length(m["text"])).alias("text"), (m["start"] + skip).alias("start"), m["end"].alias("end"))

    return F.filter(F.transform(K.matches(text, T.as_in_sql(LAW_NAME), "Act|Bill|Law"), bare), lambda m: F.contains(m["text"], F.lit(" ")))


def law_hint(claim: Column, context: Column) -> Column:
    """The last mention (id, text, start, end) in context, an array of (id, text), if the claim points to a law without naming one and context names exactly one; else null."""
    named = F.flatten(F.transform(context, lambda s: F.transform(law_mentions(s["text"]), lambda m: F.struct(s["id"].alias("id"), m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end")))))
    one = F.size(F.array_distinct(F.transform(named, lambda m: F.lower(m["text"])))) == 1
    return F.when(claim.rlike(T.as_in_sql(LAW_REFERENCE)) & (F.size(law_mentions(claim)) == 0) & one, F.try_element_at(named, F.lit(-1)))


def _spoken(text: Column) -> Column:
    return F.filter(F.split(text, T.as_in_sql(r"\s+")), lambda w: w != "")


def _content(text: Column) -> Column:
    return T.content_of(T.composed_tokens(text))


def topic_context(claim: Column, preceding: Column) -> Column:
    """Of preceding, an array of (id, text) in order: the texts that share a letter-only content term with the claim, the last first, each cut to its last words, TOPIC_WORDS in all."""
    anchors = F.filter(_content(claim), lambda t: t.rlike(r"^\p{L}+$"))
    kind = "array<struct<id:long,text:string>>"
    empty = F.struct(F.lit(TOPIC_WORDS).alias("left"), F.array().cast(kind).alias("chosen"))

    def step(s: Column, x: Column) -> Column:
        words = _spoken(x["text"])
        kept = F.slice(words, F.greatest(F.size(words) - s["left"] + 1, F.lit(1)), F.greatest(s["left"], F.lit(0)))
        cut = F.array_join(kept, " ")
        use = (s["left"] > 0) & F.arrays_overlap(_content(x["text"]), anchors) & F.arrays_overlap(_content(cut), anchors)
        added = F.concat(F.array(F.struct(x["id"].cast("long").alias("id"), cut.alias("text"))), s["chosen"])
        return F.struct(F.when(use, s["left"] - F.size(kept)).otherwise(s["left"]).alias("left"), F.when(use, added).otherwise(s["chosen"]).alias("chosen"))

    return F.aggregate(F.reverse(preceding), empty, step, lambda s: s["chosen"])


def topic_query(claim: Column, chosen: Column) -> Column:
    """Content terms of the claim, then those of the chosen context, each once; the claim itself if there are none."""
    said = F.array_join(F.transform(chosen, lambda x: x["text"]), " ")
    terms = F.array_join(F.array_distinct(F.concat(_content(claim), _content(said))), " ")
    return F.when(terms != "", terms).otherwise(claim)


def search_query(mode: Column, claim: Column, country: Column, said_on: Column, preceding: Column, references: Column) -> Column:
    """The query of a mode: claim, topic, or context (claim, country, year, the last words before it if it points back, and the law it means). Another mode gives null."""
    before = _spoken(F.array_join(F.transform(preceding, lambda x: x["text"]), " "))
    last = F.array_join(F.slice(before, F.greatest(F.size(before) - CONTEXT_WORDS + 1, F.lit(1)), F.lit(CONTEXT_WORDS)), " ")
    hints = [country, F.substring(said_on, 1, 4), F.when(claim.rlike(T.as_in_sql(REFERENTIAL)), last), law_hint(claim, references)["text"]]
    whole = F.concat_ws(" ", claim, *[F.when(h != "", h) for h in hints])
    topic = topic_query(claim, topic_context(claim, preceding))
    return F.when(mode == "claim", claim).when(mode == "topic", topic).when(mode == "context", whole)


def page_allowance(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Hits (keys, query, queries, pos, url, gives, concept) that are read, numbered by n in the order of reading.

    A claim's queries share five page reads and two sources, a concept's two and one. A query's reads end at three, or five less one for
    each query that follows it where it isn't the first of several, until a source is found; later queries are for claims without one.
    Null and repeated urls take no read. Each claim holds MOST_HITS hits a query at most, so its fold is bounded.
    """
    rank = F.row_number().over(Window.partitionBy(*keys, "query").orderBy("pos"))
    few = hits.withColumn("_r", rank).where(F.col("_r") <= MOST_HITS)
    item = F.struct("query", "pos", "queries", "url", "gives")
    grouped = few.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("hits"), F.max("concept").alias("concept"))
    pages, sources = F.when(F.col("concept"), 2).otherwise(5), F.when(F.col("concept"), 1).otherwise(2)
    empty = F.struct(F.array().cast("array<string>").alias("read"), F.lit(0).alias("found"), F.lit(None).cast("long").alias("first"))

    def step(s: Column, h: Column) -> Column:
        until = F.when((h["query"] == 0) & (h["queries"] > 1), 3).otherwise(5 - (h["queries"] - h["query"] - 1))
        spent = (F.size(s["read"]) >= until) & (s["found"] == 0)
        over = (F.size(s["read"]) >= pages) | (s["found"] >= sources) | F.coalesce(h["query"] > s["first"], F.lit(False))
        reads = ~spent & ~over & h["url"].isNotNull() & ~F.coalesce(F.array_contains(s["read"], h["url"]), F.lit(False))
        gives = reads & F.coalesce(h["gives"], F.lit(False))
        return F.struct(
            F.when(reads, F.array_append(s["read"], h["url"])).otherwise(s["read"]).alias("read"),
            (s["found"] + gives.cast("int")).alias("found"),
            F.coalesce(s["first"], F.when(gives, h["query"].cast("long"))).alias("first"),
        )

    read = F.aggregate("hits", empty, step, lambda s: s["read"])
    return grouped.select(*keys, F.posexplode(read).alias("n", "url"))


def anchor_positions(blocks: Column, terms: Column, quotable: Column) -> Column:
    """Places of quotable blocks (an array of booleans) that hold two of the query's terms, or its only one: those with most first, then in order."""
    shared = F.transform(blocks, lambda b: F.size(F.array_intersect(_content(b), terms)))
    asked = F.least(F.lit(2), F.size(terms))
    marked = F.transform(shared, lambda n, i: F.when((n > 0) & (n >= asked) & F.element_at(quotable, i + 1), F.struct((-n).alias("n"), i.alias("i"))))
    return F.transform(F.array_sort(F.filter(marked, lambda m: m.isNotNull())), lambda m: m["i"])


def window_positions(quotable: Column, anchors: Column, selected: Column | None = None) -> Column:
    """Up to MOST_BLOCKS places, in order: the selected ones, then quotable blocks within NEAR_BLOCKS of them and of each anchor in turn. If the window without selected ones holds them all, it stays as it is."""
    none = F.array().cast("array<int>")

    def near(places: Column) -> Column:
        around = F.transform(places, lambda p: F.sequence(F.greatest(p - NEAR_BLOCKS, F.lit(0)), F.least(p + NEAR_BLOCKS, F.size(quotable) - 1)))
        return F.filter(F.flatten(around), lambda q: F.element_at(quotable, q + 1))

    plain = F.slice(F.array_distinct(near(anchors)), 1, MOST_BLOCKS)
    if selected is None:
        return F.array_sort(plain)
    selected = F.coalesce(selected, none)
    moved = F.slice(F.array_distinct(F.concat(selected, near(F.concat(selected, anchors)))), 1, MOST_BLOCKS)
    return F.array_sort(F.when(F.size(F.array_except(selected, plain)) == 0, plain).otherwise(moved))


def reference_candidates(links: DataFrame, parents: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first MOST_CANDIDATES urls that a key's passages link to, other than its own sources: (key, place, url, label of the first link, n_links).

    links: (key, order columns, url, label), parents: (key, url). Null and empty urls are none; which come first is kept by the window before its shuffle.
    """
    outside = links.where("url <> ''").join(parents.select(key, "url").distinct(), [key, "url"], "left_anti")
    first = outside.groupBy(key, "url").agg(F.min(F.struct(*order, "label")).alias("_first"), F.count(F.lit(1)).alias("n_links"))
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("_first", "url"))).where(F.col("place") <= MOST_CANDIDATES)
    return ranked.select(key, "place", "url", F.col("_first.label").alias("label"), "n_links")


def reference_reads(asked: DataFrame, candidates: DataFrame, key: str, order: str) -> DataFrame:
    """asked (key, order, url) with outcome: unknown (no candidate), read (one of the first MOST_READS urls asked for), kept (read or refused as before) or over_budget."""
    known = asked.join(candidates.select(key, "url", F.lit(True).alias("_known")).distinct(), [key, "url"], "left")
    first = known.where("_known").groupBy(key, "url").agg(F.min(order).alias("_first"))
    read = first.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_first", "url"))).where(F.col("_n") <= MOST_READS)
    out = known.join(read, [key, "url"], "left")
    outcome = F.when(F.col("_known").isNull(), "unknown").when(F.col("_n").isNull(), "over_budget").when(F.col(order) == F.col("_first"), "read").otherwise("kept")
    return out.select(key, order, "url", outcome.alias("outcome"))


def selection_problem(chosen: Column, known: Column) -> Column:
    """What is wrong with a choice of ids among the known ones: too_many, repeated or unknown; null if nothing."""
    return (
        F.when(chosen.isNull() | F.exists(chosen, lambda c: c.isNull()), "not_ids")
        .when(F.size(chosen) > MOST_CHOICES, "too_many")
        .when(F.size(F.array_distinct(chosen)) < F.size(chosen), "repeated")
        .when(F.size(F.array_except(chosen, F.coalesce(known, F.array().cast("array<string>")))) > 0, "unknown")
    )


def feature_row(names: tuple[str, ...] | list[str] = tuple(FEATURES)) -> Column:
    """Columns of these names as one array of doubles, in this order; a missing column is an error of the plan."""
    return F.array(*[F.col(n).cast("double") for n in names])


def cues(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Lines "[h:mm:ss] text" as cues (keys, order, start, end, text): a cue lasts until just before the next one's start, the last three seconds; other lines are left out."""
    part = lambda n: F.coalesce(F.expr(f"try_cast(regexp_extract(line, r'{CUE}', {n}) as double)"), F.lit(0.0))
    timed = lines.where(F.col("line").rlike(CUE)).select(*keys, order, (part(1) * 3600 + part(2) * 60 + part(3)).alias("start"), F.trim(F.regexp_replace(F.regexp_extract("line", CUE, 4), r"\s+", " ")).alias("text"))
    following = F.lead("start").over(Window.partitionBy(*keys).orderBy(order))
    end = F.greatest(F.col("start"), F.coalesce(following, F.col("start") + LAST_CUE_SECONDS) - CUE_GAP)
    return timed.select(*keys, order, "start", end.alias("end"), "text")


def genre_pairs(rows: DataFrame, every: int = 3) -> DataFrame:
    """Pairs (id, relation, premise, hypothesis, grp) of rows (pair_id, prompt_id, genre, label, premise, hypothesis).

    Each different pair of texts once, by its least pair_id, with its native relation; and every third row's hypothesis (by hash) with the premise of
    a hashed row of another genre as unrelated, unless that pair is there already. Genres are few: their table has a row each.
    """
    plain = rows.where("premise <> hypothesis")
    relation = F.create_map(*[F.lit(x) for pair in RELATION_OF.items() for x in pair])
    native = plain.groupBy("premise", "hypothesis").agg(F.min(F.struct("pair_id", "prompt_id", "label")).alias("r"))
    native = native.select(F.concat(F.lit("mnli:"), "r.pair_id").alias("id"), relation[F.col("r.label")].alias("relation"), "premise", "hypothesis", F.concat(F.lit("mnli:"), "r.prompt_id").alias("grp"))
    if every <= 0:
        return native
    digest = F.sha1(F.concat(F.lit("donor:"), "pair_id"))
    number = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    held = numbered(rows.select("pair_id", "genre", "premise", F.sha1("pair_id").alias("_h")), F.substring("_h", 1, 3), ["_h", "pair_id"], ["genre"])
    genres = held.groupBy("genre").agg(F.max("n").alias("size"))
    genres = genres.select("genre", "size", (F.row_number().over(Window.orderBy("genre")) - 1).alias("at"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("genres"))
    asked = rows.where(number(17) % every == 0).join(small(genres.select("genre", "at", "genres")), "genre").where("genres > 1")
    asked = asked.select("pair_id", "prompt_id", "hypothesis", ((F.col("at") + 1 + number(1) % (F.col("genres") - 1)) % F.col("genres")).alias("at"), number(9).alias("draw"))
    asked = asked.join(small(genres.select("at", F.col("genre").alias("donor_genre"), "size")), "at").withColumn("pos", F.col("draw") % F.col("size") + 1)
    donors = held.select(F.col("genre").alias("donor_genre"), "pos", F.col("pair_id").alias("donor"), "premise")
    swapped = asked.join(donors, ["donor_genre", "pos"]).join(plain.select("premise", "hypothesis").distinct(), ["premise", "hypothesis"], "left_anti")
    swapped = swapped.groupBy("premise", "hypothesis").agg(F.min(F.struct("pair_id", "donor", "prompt_id")).alias("r"))
    identity = F.concat(F.lit("mnli:"), "r.pair_id", F.lit(":unrelated:"), "r.donor")
    return native.unionByName(swapped.select(identity.alias("id"), F.lit("unrelated").alias("relation"), "premise", "hypothesis", F.concat(F.lit("mnli:"), "r.prompt_id").alias("grp")))


def claims_to_judge(rows: DataFrame, judged: DataFrame, order: list[str]) -> DataFrame:
    """Researched claims without a truth value yet, each at its first place: rows (order columns, claim, researched), judged (claim). A place without a key comes after those with one."""
    at = [x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"_null{i}"), F.col(c))]
    wanted = rows.where("researched and claim <> ''").groupBy("claim").agg(F.min(F.struct(*at)).alias("_first"))
    return wanted.join(judged.select("claim").distinct(), "claim", "left_anti").select("claim", *[f"_first.{c}" for c in order])


def stored_sentences(refs: DataFrame, store: DataFrame, page: str = "title") -> DataFrame:
    """refs (claim, pos, title, idx) with the sentence the store (page, idx, sentence) holds there; refs without text go, the others are numbered anew in their order.

    page: the column that tells pages apart on both sides, the title (composed on both) or an id that untitled pages have, too.
    """
    found = refs.join(store.where("sentence <> ''"), [page, "idx"])
    place = F.row_number().over(Window.partitionBy("claim").orderBy("pos", "title", "idx"))
    return found.select("claim", (place - 1).cast("long").alias("place"), "title", "idx", "sentence")
