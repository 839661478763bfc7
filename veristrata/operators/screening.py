"""Screens and checks of single rows: topics, addresses, judgments, learned decisions and notes on dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.functions import pages as P
from veristrata.functions import text as T

# Membership decides results.
CLAUSE_ENDS = r"[.!?,;:]"
SCOPE_WORDS = "before after during until since between from to this more less least most than under over up at about around not no".split()
NUMBER_WORDS = """
    zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen
    fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy
    eighty ninety hundred thousand million billion trillion half quarter dozen
""".split()
ENGLISH = "^en(-[A-Za-z]{2,8})?$"
COUNTRY = r"^[^\W\d_](?:[^\W\d_]|[ .'’&-]){1,59}$"
RELATIONS = ("states", "states_negation", "bears_on", "unrelated")
NOTES = {
    "no_claim_date": "Claim date unknown; temporal applicability has not been checked.",
    "no_page_date": "Publication date unknown; temporal applicability has not been checked.",
    "later": "Published after the supplied claim date; contemporaneous applicability is unestablished.",
    "earlier": "Published by the supplied claim date; the period covered still needs checking.",
}
MOST_QUALIFIERS = 4
MOST_QUERY = 500


def clause_tokens(text: Column) -> Column:
    """The terms of each clause of composed text, joined by single spaces."""
    return F.transform(F.split(text, CLAUSE_ENDS), lambda c: F.array_join(T.composed_tokens(c), " "))


def topic_phrases(text: Column) -> Column:
    """Runs of content words inside clauses of composed text, as their two- or three-word neighbours: three where the run has them. Each phrase once."""
    marked = F.transform(clause_tokens(text), lambda c: F.array_join(F.transform(F.split(c, " "), lambda t: F.when(t.isin(T.FUNCTION_WORDS), "|").otherwise(t)), " "))
    runs = F.flatten(F.transform(marked, lambda c: F.transform(F.split(c, r"\|"), lambda r: F.split(F.trim(r), " "))))
    long_enough = F.filter(runs, lambda r: F.size(r) >= 2)
    return F.array_distinct(F.flatten(F.transform(long_enough, lambda r: F.transform(F.sequence(F.lit(1), F.size(r) - F.least(F.size(r), F.lit(3)) + 1), lambda i: F.array_join(F.slice(r, i, F.least(F.size(r), F.lit(3))), " ")))))


def on_topic(rows: DataFrame, claim: str, query: str, evidence: str) -> DataFrame:
    """rows whose evidence shares a content term with the claim, two (or all) with the query, and holds one of the claim's phrases inside a clause, if it has any."""
    held = rows.withColumns({"_claim": T.nfc(F.col(claim)), "_query": T.nfc(F.col(query)), "_body": T.nfc(F.col(evidence))})
    terms = {c: T.content_of(T.composed_tokens(F.col(c))) for c in ("_claim", "_query", "_body")}
    held = held.withColumns({"_phrases": topic_phrases(F.col("_claim")), "_clauses": F.transform(clause_tokens(F.col("_body")), lambda c: F.concat(F.lit(" "), c, F.lit(" "))), **terms})
    phrase = F.exists("_clauses", lambda c: F.exists("_phrases", lambda p: F.contains(c, F.concat(F.lit(" "), p, F.lit(" ")))))
    fit = F.arrays_overlap("_body", "_claim") & (F.size(F.array_intersect("_body", "_query")) >= F.least(F.lit(2), F.size("_query"))) & ((F.size("_phrases") == 0) | phrase)
    return held.where(fit).drop("_claim", "_query", "_body", "_phrases", "_clauses")


def learned_decision(p: Column, words: Column, threshold: float, factual: bool = True, least_words: int = T.LEAST_WORDS) -> Column:
    """(worthy, reason, score) of calibrated class probabilities: the factual classes 1 and 2, or 2 alone. Short sentences aren't worthy whatever their score."""
    score = p[1] + p[2] if factual else p[2]
    name = "factual" if factual else "check_worthy"
    short = words < least_words
    reason = F.when(short, "too_short").when(score >= threshold, "check_worthy").otherwise(f"below_{name}_threshold")
    return F.struct((~short & (score >= threshold)).alias("worthy"), reason.alias("reason"), score.alias("score"))


def reference_url(url: Column) -> Column:
    """The public address with the dot behind its host left out; empty for white space, control characters, a backslash or a second dot."""
    plain = F.regexp_replace(url, r"^(?i)(https://[^/?#@:]+?)\.(?=(?::443)?(?:[/?#]|$))", "$1")
    return F.when(~url.rlike(r"[\s\x00-\x1f\\]"), P.public_url(plain)).otherwise("")


def judgment_problem(relation: Column, span: Column, qualifiers: Column, text: Column) -> Column:
    """What is wrong with a pair's judgment, null if nothing: relation, span (empty exactly for unrelated, else a part of the text) and up to MOST_QUALIFIERS qualifiers that are parts of it."""
    span_fits = F.when(relation == "unrelated", span == "").otherwise((F.trim(span) != "") & F.contains(text, span))
    fit = F.forall(qualifiers, lambda q: F.coalesce((F.trim(q) != "") & F.contains(text, q), F.lit(False)))
    return (
        F.when(~F.coalesce(relation.isin(*RELATIONS), F.lit(False)), "unknown_relation")
        .when(~F.coalesce(span_fits, F.lit(False)), "bad_span")
        .when(qualifiers.isNull() | (F.size(qualifiers) > MOST_QUALIFIERS) | ~fit, "bad_qualifiers")
    )


def english(language: Column) -> Column:
    return F.coalesce(language.rlike(ENGLISH), F.lit(False))


def country_name(name: Column) -> Column:
    return F.coalesce(name.rlike(f"(?U){COUNTRY}"), F.lit(False))


def fallback_query(claim: Column, country: Column, cutoff: Column) -> Column:
    """The claim's words (all of them if it has a number, else those with content or scope, or that are no plain words), its country and the year of the cutoff; empty for claims of less than two terms and beyond MOST_QUERY characters."""
    terms = T.content_terms(claim)
    words = F.filter(F.split(T.nfc(F.trim(claim)), r"\s+"), lambda w: w != "")
    telling = F.filter(words, lambda w: F.exists(T.composed_tokens(w), lambda t: ~t.isin(T.FUNCTION_WORDS)) | F.regexp_replace(F.lower(w), r"^[.,!?;:]+|[.,!?;:]+$", "").isin(SCOPE_WORDS) | ~w.rlike("^[A-Za-z'’]+[.,!?;:]?$"))
    numeric = claim.rlike(r"\p{Nd}") | F.arrays_overlap(terms, T.words(NUMBER_WORDS))
    parts = F.array(F.array_join(F.when(numeric, words).otherwise(telling), " "), country, F.substring(cutoff, 1, 4))
    query = F.array_join(F.filter(parts, lambda p: p != ""), " ")
    return F.when((F.size(terms) >= 2) & (F.length(query) <= MOST_QUERY), query).otherwise("")


def publication_note(published: Column, spoken_at: Column) -> Column:
    """What the two dates allow to be said; only whole ISO days are compared."""
    day = F.try_to_date(F.when(F.substring(published, 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring(published, 1, 10)), "yyyy-MM-dd")
    said = F.try_to_date(spoken_at, "yyyy-MM-dd")
    which = F.when(F.coalesce(spoken_at, F.lit("")) == "", "no_claim_date").when(day.isNull(), "no_page_date").when(day > said, "later").otherwise("earlier")
    return F.create_map(*[F.lit(x) for pair in NOTES.items() for x in pair])[which]


def anchored_by(claim: Column, window: Column) -> Column:
    """Whether a window of a page shares an alphabetic content term with the claim."""
    own = F.filter(T.content_terms(claim), lambda t: t.rlike(r"^\p{L}+$"))
    return F.arrays_overlap(own, T.content_terms(window))


def context_phrases(candidates: DataFrame, terms: DataFrame, most: int = 2) -> DataFrame:
    """Of candidates (claim, pos, text) the `most` with the greatest mean idf of their known content terms (terms: term, idf), earlier ones first on ties. A capitalised word that the corpus lacks, or no known term, disqualifies."""
    from pyspark.sql import Window

    words = candidates.select("claim", "pos", F.explode(F.split(F.trim("text"), r"\s+")).alias("w")).select("claim", "pos", F.lower("w").alias("term"), F.col("w").rlike(r"^\p{Lu}").alias("upper"))
    unknown = words.where("upper").join(terms, "term", "left_anti").select("claim", "pos").distinct()
    scored = candidates.select("claim", "pos", "text", F.explode(T.content_terms(F.col("text"))).alias("term")).join(terms, "term").groupBy("claim", "pos", "text").agg(F.avg("idf").alias("mean_idf"))
    fit = scored.join(unknown, ["claim", "pos"], "left_anti").withColumn("mean_idf", F.round("mean_idf", 9))
    place = F.row_number().over(Window.partitionBy("claim").orderBy(F.desc("mean_idf"), "pos"))
    return fit.withColumn("place", place).where(F.col("place") <= most)
