"""Sentence roles from named cues, and their inheritance along a paragraph.

Each cue is one Java pattern on the sentence's visible text; a role stands once, in the order of its first cue. Inheritance
runs as a fold over a paragraph's ordered sentences, since an inherited role is inherited on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.functions import text as T

# Patterns decide results.
ROLES = ("reported_observation", "definition", "hypothetical", "forecast", "attributed_opinion", "instruction", "caption", "speech_reprint", "unknown")
LINK = r"\[[^\]]*\]\([^)]*\)|https?://\S+|www\.\S+"
LABEL = r"\[([^\[\]]*)\]\([^)]*\)"
QUOTE = r"[\"“”][^\"“”]{6,}[\"“”]"
QUOTE_TAIL = r"[\"”]\s*,?\s*(?:(?:(?:[A-Z][\w.'’-]*|he|she|they|we|I)\s+){1,6}(?:said|says|told|added|wrote|asked|stated|noted|explained|recalled|insisted|remarked|argued|claimed)\b|(?:said|says|added|wrote|asked)\s+[A-Z])"
ROLE_PREFIX = r"^\s*[A-Z][A-Z ]{2,}:\s"
FUTURE = r"(?i)\b(?:will|won't|expects?|expected|expecting|forecasts?|forecasting|projected|projects|projections?|predicts?|predicted|predictions?|anticipates?|anticipated|outlook|next (?:week|month|quarter|year)|by 20\d\d|is set to|are set to|plans? to|poised to)\b"
HYPOTHETICAL = r"(?i)\b(?:suppose|supposing|imagine|hypothetical(?:ly)?|illustrat\w*|would (?:mean|indicate|imply|have|be|represent)|if [^,]+ would|consider a|a ratio of \d)\b"
DEFINITION = r"(?i)\b(?:is defined as|are defined as|defined as|refers? to|is a measure of|a measure of|measures? (?:what|the)|indicates the|is the (?:sum|share|ratio|number|portion|percentage|proportion) of|consists? of|comprises?|is calculated|are calculated|captures?|includes? the|includes|the (?:term|index|rate|ratio|measure) [^,]*?\bis\b)\b"
PURPOSE = r"(?i)\b(?:the (?:mission|purpose|goal|aim|objective) of|aims? to|aimed at|is designed to|are designed to|seeks? to|is intended to|are intended to|is meant to|are meant to|strives? to|is dedicated to)\b"
SPEECH = r"(?i)\b(?:said|says|saying|told|tells|stated|wrote|writes|added|noted|argued|argues|remarked|claimed|claims|insisted|declared|explained|explains|warned|warns|urged|urges)\b"
OPINION = r"(?i)\b(?:in (?:the |our |my |his |her |their |its )(?:[\w'’-]+ ){0,3}(?:view|opinion|assessment|judgment)|we (?:believe|think|interpret|argue|view|see|read|consider|suspect)|i (?:believe|think|argue)|believes?|argues?|contends?|maintains?|insists?|suggests? that|the results suggest|this suggests|could help explain|may (?:reflect|explain|suggest)|likely reflects?|seems? to|appears? to|in (?:our|my) opinion|we would (?:argue|say)|opinion|viewpoint)\b"
NAVIGATION = r"(?i)\b(?:can be viewed|available (?:at|on|here)|read more|click here|learn more|for more information|sign up|subscribe|follow us|all rights reserved|copyright|terms of (?:use|service)|privacy policy|photo(?:graph)?:|credit:|on x:|on twitter|contact us|see also|related:|advertisement|share this|your instructions)\b"
CONTINUATION = r"(?i)^(?:instead|put differently|in other words|that is|rather|likewise|similarly|in short|simply put|to put it another way)\b"
STANCE = r"(?i)\b(?:we|i)\s+(?:need|should|must|have to|ought to|want|hope|urge|call on|think|believe|feel)\b|\byou know\b|\bi mean\b|\bsort of\b|\bkind of\b|\blet me\b|\blook,|\bokay,|\bok,"
TRANSCRIPT = r"(?im)\((?:applause|laughter|pause|inaudible|crosstalk|cheers)\.?\)|^(?:Q|A|MR\.|MS\.|DR\.)\s*[.:]|^[A-Z][a-z]+(?: [A-Z][a-z]+){1,2}:\s"
OPINION_SECTION = r"(?i)/(?:opinions?|op-eds?|columnists?|columns?|editorials?|commentary|perspectives?|letters(?:-to-the-editor)?|blogs?)(?:/|$)"
CREDIT_TAIL = r"(?:(?i:hide caption)|\b(?i:photo|photograph|image|illustration|credit|source)s?\s*[:/]\s*[^.!?]{2,80}|\b(?:AP|AFP|Reuters|REUTERS|EPA|PTI|ANI|Xinhua|Bloomberg|Shutterstock|Getty Images|Getty)\b(?:\s*/\s*[A-Z][^.!?]{1,60}|\s+via\s+[^.!?]{2,60})?)\s*\)?\s*$"
IMPERATIVES = """
    click see read visit follow subscribe sign download learn contact ignore output cite view check watch listen
    call email join register buy order note please treat return use try get find go tell say write
""".split()
SPEECH_KINDS = "speech speeches address remarks debate interview testimony".split()


def opinion_source(url: Column) -> Column:
    return _path(url).rlike(OPINION_SECTION)


def _path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def speech_text_source(url: Column) -> Column:
    """Whether a path names a transcript, remarks by someone, or the text of a spoken event."""
    parts = F.filter(F.split(F.lower(_path(url)), r"[/_.\-]+"), lambda p: p != "")
    joined = F.concat(F.lit(" "), F.array_join(parts, " "), F.lit(" "))
    spoken = F.arrays_overlap(parts, T.words(["text", "full"])) & F.arrays_overlap(parts, T.words(SPEECH_KINDS))
    return F.arrays_overlap(parts, T.words(["transcript", "transcripts"])) | F.contains(joined, F.lit(" remarks by ")) | spoken


def transcript_line(line: Column) -> Column:
    return line.rlike(TRANSCRIPT)


def caption_passage(text: Column) -> Column:
    """Whether a passage ends in an image credit, read on its last 120 characters."""
    return F.substring(F.trim(text), -120, 120).rlike(CREDIT_TAIL)


def own_roles(text: Column, spoken: Column, caption: Column, reprint: Column) -> Column:
    """Roles of a sentence by its own cues."""
    visible = F.trim(F.regexp_replace(F.regexp_replace(text, LABEL, "$1"), LINK, " "))
    prose = F.trim(F.regexp_replace(text, LINK, " "))
    words = F.transform(T.claim_words(prose), F.lower)
    first = F.coalesce(F.try_element_at(words, F.lit(1)), F.lit(""))
    second = F.coalesce(F.try_element_at(words, F.lit(2)), F.lit(""))

    def either(pattern: str) -> Column:
        return prose.rlike(pattern) | visible.rlike(pattern)

    order = (first.isin(IMPERATIVES) & ~second.isin(T.AUXILIARIES)) | (F.size(words) < 3) | text.rlike(NAVIGATION) | visible.rlike(NAVIGATION) | text.rlike(ROLE_PREFIX)
    opinion = (text.rlike(QUOTE) & text.rlike(SPEECH)) | text.rlike(QUOTE_TAIL) | either(OPINION) | either(STANCE) | spoken
    defining = either(DEFINITION) | either(r"(?i)^about\s+\S") | either(PURPOSE)
    named = [(order, "instruction"), (opinion, "attributed_opinion"), (caption, "caption"), (reprint, "speech_reprint"), (either(FUTURE), "forecast"), (either(HYPOTHETICAL), "hypothetical"), (defining, "definition")]
    cued = F.array_compact(F.array(*[F.when(cue, role) for cue, role in named]))
    finite = F.exists(words, lambda w: w.isin(T.AUXILIARIES + T.IRREGULAR_PAST) | ((F.length(w) > 4) & w.endswith("ed")) | ((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss")))
    question = prose.endswith("?") | first.isin(T.QUESTION_OPENERS)
    return F.struct(cued.alias("cued"), question.alias("question"), (finite & (~F.array_contains(cued, "definition") | prose.rlike("[0-9]"))).alias("reports"), (F.substring(prose, 1, 1).isin('"', "“") | F.substring(visible, 1, 1).isin('"', "“") | either(CONTINUATION)).alias("continues"))


def _settled(cued: Column, question: Column, reports: Column) -> Column:
    """Questions reset to unknown; a lone instruction stays; a reporting verb adds the observation unless instructions are there."""
    observed = F.concat(F.array(F.lit("reported_observation")), cued)
    only = (F.size(cued) == 1) & F.array_contains(cued, "instruction")
    return F.when(question, T.words(["unknown"])).when(only, cued).when(reports & ~F.array_contains(cued, "instruction"), observed).when(F.size(cued) == 0, F.when(reports, observed).otherwise(T.words(["unknown"]))).otherwise(cued)


def type_sentences(sentences: DataFrame, passage: str = "passage_id", place: str = "idx") -> DataFrame:
    """(passage, place, roles) of sentences (passage, place, text, spoken, caption, reprint): a sentence that goes on from one with an attributed opinion has it too."""
    rows = sentences.select(passage, F.struct(F.col(place).alias("place"), own_roles(F.col("text"), F.col("spoken"), F.col("caption"), F.col("reprint")).alias("r")).alias("s"))
    ordered = rows.groupBy(passage).agg(F.sort_array(F.collect_list("s")).alias("ss"))

    def step(done: Column, s: Column) -> Column:
        before = F.coalesce(F.try_element_at(done, F.lit(-1))["roles"], F.array().cast("array<string>"))
        inherits = s["r"]["continues"] & F.array_contains(before, "attributed_opinion") & ~F.array_contains(s["r"]["cued"], "attributed_opinion")
        cued = F.when(inherits, F.concat(s["r"]["cued"], T.words(["attributed_opinion"]))).otherwise(s["r"]["cued"])
        return F.concat(done, F.array(F.struct(s["place"].alias("place"), _settled(cued, s["r"]["question"], s["r"]["reports"]).alias("roles"))))

    kind = f"array<struct<place:{dict(sentences.dtypes)[place]},roles:array<string>>>"
    folded = ordered.select(passage, F.explode(F.aggregate("ss", F.array().cast(kind), step)).alias("x"))
    return folded.select(passage, F.col("x.place").alias(place), F.col("x.roles").alias("roles"))
