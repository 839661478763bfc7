"""Column functions over URLs, markdown blocks and HTML pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veristrata.functions.html import read_html  # noqa: F401

READ_CAP = 160_000
LEAST_PROSE, MOST_PROSE = 80, 1400


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def public_url(url: Column) -> Column:
    """The canonical public address: https, no user, port 443 or none, a dotted name that is not local; else empty. The fragment goes."""
    parts = r"^https://([^/?#@:]+)(:443)?([/?][^#]*)?(#.*)?$"
    host = F.lower(F.regexp_extract(url, parts, 1))
    rest = F.regexp_extract(url, parts, 3)
    fine = url.rlike("(?i)" + parts) & F.contains(host, F.lit(".")) & ~host.rlike(r"(^\.|\.$|\.local$|\.localhost$|\.internal$|^[0-9.]+$)") & ~url.rlike(r"[\s\\]")
    return F.when(fine, F.concat(F.lit("https://"), host, rest)).otherwise("")


def excluded_host(host: Column, hosts: list[str]) -> Column:
    """Whether a host is one of hosts or below one."""
    out = F.lit(False)
    for h in hosts:
        out = out | (host == h) | host.endswith("." + h)
    return out


def url_path_date(url: Column) -> Column:
    """The first YYYY, YYYY-MM or valid YYYY-MM-DD among path parts; null if there is none."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    year = r"(?:^|[/_-])((?:19|20)\d{2})"
    day = F.concat_ws("-", F.regexp_extract(path, year + r"[/_-](\d{2})[/_-](\d{2})(?:[/_.-]|$)", 1), F.regexp_extract(path, year + r"[/_-](\d{2})[/_-](\d{2})(?:[/_.-]|$)", 2), F.regexp_extract(path, year + r"[/_-](\d{2})[/_-](\d{2})(?:[/_.-]|$)", 3))
    month = F.concat_ws("-", F.regexp_extract(path, year + r"[/_-](0[1-9]|1[0-2])(?:[/_.-]|$)", 1), F.regexp_extract(path, year + r"[/_-](0[1-9]|1[0-2])(?:[/_.-]|$)", 2))
    only = F.regexp_extract(path, year + r"(?:[/_.-]|$)", 1)
    return F.when((F.length(day) == 10) & F.try_to_date(day, "yyyy-MM-dd").isNotNull(), day).when(F.length(month) == 7, month).when(only != "", only)


def later_by_path(path_date: Column, cutoff: Column) -> Column:
    return path_date > F.substring(cutoff, F.lit(1), F.length(path_date))


def temporal_scope(published: Column, cutoff: Column) -> Column:
    """ISO dates compare as strings."""
    return F.when(F.coalesce(published, F.lit("")) == "", "date_unconfirmed").when(published > cutoff, "later_publication").otherwise("published_by_cutoff")


def blocks(markdown: Column) -> Column:
    """Blocks between blank lines of the first READ_CAP characters; a block that the cap cuts is dropped."""
    cut = F.split(F.substring(markdown, 1, READ_CAP), r"\n\s*\n")
    whole = F.when(F.length(markdown) > READ_CAP, F.slice(cut, F.lit(1), F.greatest(F.size(cut) - 1, F.lit(0)))).otherwise(cut)
    return F.filter(F.transform(whole, F.trim), lambda b: b != "")


def display_text(text: Column) -> Column:
    """Link labels without destinations, no bare addresses."""
    return F.regexp_replace(F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"https?://\S+", "")


# How pages state their dates.
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_WEEKDAYS = "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday"
_DAY = rf"(?:{_MONTHS}) \d{{1,2}}, \d{{4}}"
DATELINE = rf"(?i)^(?:By\s+[^|·•—–]{{1,60}}?\s*[|·•—–]\s*)?(?:(?:Published|Posted|Date)(?:\s+on)?:?\s+)?(?:(?:{_WEEKDAYS}),\s+)?((?:{_MONTHS})\s+\d{{1,2}},\s+\d{{4}})(?:\s*(?:\||·|•|—|–|-|,)\s*.{{0,160}})?$"
REVISION = r"(?i)\b(?:updated|modified|revised|corrected|retrieved|accessed)\b"
NOTICES = (
    rf"(?m)^({_DAY})\s*\n\s*For Immediate Release\b",
    rf"(?im)^Published(?: on|:)?\s+({_DAY})\s*$",
    rf"Transmission of material in this news release is embargoed until[^\n]{{0,120}}?({_DAY})",
    rf"(?m)^For release [^\n]{{0,80}}?({_DAY})\s+USDL-\d{{2}}-\d+",
)
HEADER = 12_000


def _days(found: Column) -> Column:
    """Distinct ISO days of "Month d, yyyy" texts; what is no date is left out."""
    spaced = F.transform(found, lambda d: F.regexp_replace(F.initcap(F.regexp_replace(d, r"\s+", " ")), "  ", " "))
    return F.array_distinct(F.filter(F.transform(spaced, lambda d: F.date_format(F.try_to_date(d, "MMMM d, yyyy"), "yyyy-MM-dd")), lambda d: d.isNotNull()))


def _single(days: Column) -> Column:
    return F.when(F.size(days) == 1, F.element_at(days, 1))


def byline_date(markdown: Column) -> Column:
    """The one day that datelines of the header name; null if none or several do. Lines about revisions don't count."""
    lines = F.transform(F.split(F.substring(markdown, 1, HEADER), r"\r?\n"), lambda s: F.trim(F.regexp_replace(F.trim(s), r"^[#*_ ]+", "")))
    dated = F.filter(lines, lambda s: (F.length(s) <= 200) & ~s.rlike(REVISION) & s.rlike(DATELINE))
    return _single(_days(F.transform(dated, lambda s: F.regexp_extract(s, DATELINE, 1))))


def publication_date(markdown: Column, metadata: Column) -> Column:
    """(day, problem): the one day that page metadata (an array of values) and header notices name."""
    stated = F.filter(metadata, lambda m: m.rlike(r"^\d{4}-\d{2}-\d{2}(?:T|$)"))
    meta = F.filter(F.transform(stated, lambda m: F.date_format(F.try_to_date(F.substring(m, 1, 10), "yyyy-MM-dd"), "yyyy-MM-dd")), lambda d: d.isNotNull())
    head = F.when(F.length(markdown) > HEADER, F.regexp_replace(F.substring(markdown, 1, HEADER), r"\n[^\n]*$", "")).otherwise(markdown)
    notices = F.flatten(F.array(*[F.regexp_extract_all(head, F.lit(p), F.lit(1)) for p in NOTICES]))
    days = F.array_distinct(F.concat(meta, _days(notices)))
    problem = F.when(F.size(days) > 1, "Conflicting publication notices.").when(F.size(days) == 0, "No explicit publication date found.")
    return F.struct(_single(days).alias("day"), problem.alias("problem"))


def note_flags(blocks_: Column) -> Column:
    """For each block whether it stands in a notes section: from a notes heading to the next heading."""
    heading = lambda b: F.lower(F.trim(F.substring(b, 3, 1_000_000)))
    step = lambda a, b: F.concat(a, F.array(F.when(b.startswith("# "), heading(b).isin("notes", "footnotes", "endnotes")).otherwise(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(False)))))
    return F.aggregate(blocks_, F.array().cast("array<boolean>"), step)


def citable(block: Column) -> Column:
    """Whether a block is prose to cite: neither heading, table nor image, not cut short, and not mostly links."""
    visible = F.regexp_replace(F.regexp_replace(block, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"https?://\S+", "")
    linked = F.aggregate(F.regexp_extract_all(block, F.lit(r"\[([^\]]*)\]\([^)]*\)"), F.lit(1)), F.lit(0), lambda a, x: a + F.length(x))
    plain = ~block.rlike(r"^(?:\||!\[|#|\]\()") & ~block.rlike(r"^(?:Table|Chart|Figure)\s+[A-Z0-9][.:]")
    plain = plain & ~block.rlike(r"(?i)Highcharts|Hover over chart|Choose another chart|Go to selected chart")
    whole = ~visible.rlike(r"(?i)(?:\[\s*(?:\.{3}|…)\s*\]|…|\.{3})(?:\s*(?:Read more|Continue reading))?[.!]?$")
    return F.length(block).between(LEAST_PROSE, MOST_PROSE) & plain & whole & (linked <= F.floor(F.length(visible) / 2))
