"""Screening and cleaning of single values: grounding, placeholders, cell validators, labels, ids. Column expressions but for Unicode composition."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from .text import TOP_DOMAINS

#: Words for "unknown" that a cleaning policy drops.
UNKNOWN = ("", "-", "--", "n/a", "na", "n.a.", "nil", "none", "null", "unknown", "unspecified", "not available", "not applicable")
#: Whole values that are made up, and marks of which a run of three or more is.
FILLERS = ("n/a", "n.a.", "null", "unknown", "unspecified", "undefined", "not available", "not applicable", "no data", "no value", "tbd", "tba", "test", "placeholder")
FILLER_RUN = r"^(?:x{3,}|-{3,}|_{3,}|\.{3,}|\?{3,}|\*{3,}|#{3,})$"
#: Names and beginnings of names that are navigation of a page.
PAGE_NAMES = ("about", "about us", "contact", "contact us", "home", "menu", "search", "overview", "news", "events", "gallery", "references", "see also", "external links", "further reading", "navigation", "sitemap", "site map", "log in", "login", "sign in", "sign up", "register", "privacy policy", "terms of service", "terms of use", "cookie policy", "back to top", "read more", "learn more", "help", "support", "faq", "faqs")
PAGE_STARTS = ("skip to ", "list of ", "jump to ", "table of contents")
#: Words of enrolment and of streets.
ENROLMENT = r"(?i)\b(?:enrol(?:l|ment|led|ling|lment|lments|ments)?|learners?|students?|pupils?|attendees?|full[-\s]?time\s+equivalent|fte|head[-\s]?count|annually|per\s+year|per\s+annum|a\s+year)\b"
STREET = r"(?i)\b(?:street|st|avenue|ave|road|rd|boulevard|blvd|drive|dr|lane|ln|way|court|ct|place|pl|square|sq|highway|hwy|parkway|pkwy|route|rte|crescent|cres|terrace|terr|circle|cir|trail|trl|suite|ste|floor|fl|unit|room|rm|building|bldg|apt|apartment|po\s*box|p\.?\s*o\.?\s*box)\b|\b[0-9]{5}(?:-[0-9]{4})?\b|\b[a-z][0-9][a-z]\s?[0-9][a-z][0-9]\b"
#: What reads as a host.
_HOST = r"(?i)\b[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9-]+)*\.[a-z]{2,24}\b"
#: Words of attribute names by role.
ROLE_WORDS = {"website": ("website", "url", "homepage", "webpage"), "city": ("city", "town"), "address": ("address", "street", "location")}
#: Words that say nothing about an attribute.
NAME_STOPWORDS = ("id", "ids", "name", "names", "label", "title", "type", "types", "value", "values", "url", "uri", "code", "codes", "num", "number", "numbers", "count", "total", "pct", "percent", "percentage", "rate", "ratio", "score", "scores", "rank", "ranking", "rankings", "index", "level", "status", "date", "time", "year", "years", "month", "day", "amount", "avg", "average", "mean", "min", "max", "sum", "size", "length", "the", "for", "and", "are", "was", "were", "from", "with", "per", "via")


def typed_literal(c: Column) -> Column:
    """Struct of lexical text and datatype of `text^^http...`; other texts have no datatype."""
    pattern = r"(?s)^(.*)\^\^(http.*)$"
    typed = c.rlike(pattern)
    return F.struct(F.when(typed, F.regexp_extract(c, pattern, 1)).otherwise(c).alias("lexical"), F.when(typed, F.regexp_extract(c, pattern, 2)).alias("datatype"))


def lexical_form(c: Column) -> Column:
    """A stored value as it reads: without datatype or the brackets of an identifier."""
    return F.when(c.contains("^^"), F.regexp_replace(c, r"(?s)\^\^(?!.*\^\^).*$", "")).when(c.startswith("<") & c.endswith(">"), c.substr(F.lit(2), F.length(c) - 2)).otherwise(c)


def composed():
    """Arrow function: Unicode composition (NFC)."""

    @F.pandas_udf("string")
    def nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda x: unicodedata.normalize("NFC", x) if isinstance(x, str) else None)

    return nfc


def clean_policy(c: Column, unknown: tuple[str, ...] = UNKNOWN, casefold: bool = False) -> Column:
    """Struct of value and reason: words for unknown are dropped; else trimmed, blanks collapsed, in lower case if asked."""
    clean = F.regexp_replace(F.trim(c), r"\s+", " ")
    clean = F.lower(clean) if casefold else clean
    dropped = c.isNull() | F.lower(F.trim(c)).isin(*unknown)
    return F.struct(F.when(~dropped, clean).alias("value"), F.when(dropped, "unknown_token").when(clean != c, "canonicalized").otherwise("unchanged").alias("reason"))


def is_placeholder(c: Column) -> Column:
    """Whether a whole value is made up: a filler word, a run of one mark, or six digits or more that are all the same or count up or down."""
    v = F.lower(F.trim(c))
    digits = F.regexp_replace(v, "[^0-9]", "")
    same = F.length(F.replace(digits, F.substring(digits, 1, 1), F.lit(""))) == 0
    up = "".join(str(i % 10) for i in range(11))  # counting, on from nine to nought
    counting = F.lit(up).contains(digits) | F.lit(up[::-1]).contains(digits)
    numeric = v.rlike(r"^[0-9\s().+\-/]+$") & (F.length(digits) >= 6) & (same | counting)
    return F.coalesce((v != "") & (v.isin(*FILLERS) | v.rlike(FILLER_RUN) | numeric), F.lit(False))


def is_grounded(value: Column, source: Column) -> Column:
    """Whether a value, its digits or its letters and digits stand in a source text (three characters at least); placeholders never do."""
    v, s = F.lower(F.trim(value)), F.lower(source)
    inside = lambda x, y: (F.length(x) >= 3) & y.contains(x)
    only = lambda t, p: F.regexp_replace(t, p, "")
    found = inside(v, s) | inside(only(v, "[^0-9]"), only(s, "[^0-9]")) | inside(only(v, "[^a-z0-9]"), only(s, "[^a-z0-9]"))
    return F.coalesce(~is_placeholder(value) & found, F.lit(False))


def name_is_grounded(name: Column, source: Column) -> Column:
    """Whether at least half of the telling words of an attribute's name stand in a source text."""
    words = F.filter(F.split(F.lower(name), r"[_\s-]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*NAME_STOPWORDS))
    hits = F.size(F.filter(words, lambda w: F.lower(source).contains(w)))
    return F.coalesce((F.size(words) > 0) & (hits >= F.greatest(F.lit(1), F.floor((F.size(words) + 1) / 2))), F.lit(False))


def cell_fault(role: str, c: Column) -> Column:
    """Why a cell can't be a name, city, website or address; null if it can or is empty."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    low = F.lower(t)
    if role == "name":
        page = low.isin(*PAGE_NAMES)
        for start in PAGE_STARTS:
            page = page | low.startswith(start)
        return F.when(t.isNull() | (F.length(t) < 2), "too short").when(~t.rlike(r"[\p{L}\p{N}]"), "punctuation").when(page, "page navigation")
    if role == "city":
        known = r"(?i)\b[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9-]+)*\.(?:" + "|".join(TOP_DOMAINS) + r")\b"
        return F.when(t.rlike(r"^[0-9]{4}\b"), "year").when(t.rlike(r"(?i)https?://|\bwww\.") | t.rlike(known), "url").when(t.rlike(ENROLMENT), "enrolment")
    if role == "website":
        return F.when((t != "") & ~t.rlike(r"(?i)https?://") & ~t.rlike(_HOST), "no host")
    if role == "address":
        return F.when(t.rlike(ENROLMENT) & ~t.rlike(STREET), "enrolment")
    return F.lit(None).cast("string")


def role_of(attribute: str, key: str) -> str | None:
    """Role of an attribute by the words of its name: the key is a name, mail is none of them."""
    if attribute == key:
        return "name"
    words = {w for w in "".join(ch if ch.isalnum() and ch.isascii() else " " for ch in attribute.lower()).split()}
    if words & {"email", "mail"}:
        return None
    return next((role for role, known in ROLE_WORDS.items() if words & set(known)), None)


def alias_pair(c: Column) -> Column:
    """Struct of old and new in `old→new` or `old=>new`; null if either is missing."""
    arrow = c.contains("→")
    left = F.trim(F.when(arrow, F.substring_index(c, "→", 1)).otherwise(F.substring_index(c, "=>", 1)))
    right = F.trim(F.when(arrow, F.regexp_extract(c, r"(?s)^[^→]*→(.*)$", 1)).otherwise(F.regexp_extract(c, r"(?s)^(?:(?!=>).)*=>(.*)$", 1)))
    return F.when((arrow | c.contains("=>")) & (left != "") & (right != ""), F.struct(left.alias("old"), right.alias("new")))


def scalar_cell(json: Column) -> Column:
    """A JSON value as a cell: text trimmed, numbers and booleans as they read, lists of them joined by comma and blank; objects, empty and null ones are null."""
    t = F.trim(json)
    text = F.trim(F.get_json_object(F.concat(F.lit('{"v":'), t, F.lit("}")), "$.v"))
    items = F.filter(F.transform(F.from_json(t, "array<string>"), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "") & ~x.startswith("{"))
    value = F.when(t.startswith("["), F.array_join(items, ", ")).when(t.startswith("{") | (t == "null"), None).otherwise(text)
    return F.when(value != "", value)


def is_model_code(word: Column) -> Column:
    """Whether a word is a model or stock code: digits, or letters and digits, with hyphens."""
    return word.rlike("[0-9]") & (word.rlike(r"^[\p{L}\p{N}-]+$") | word.contains("-"))


def label_candidates(c: Column) -> Column:
    """Ever shorter forms of a label: as it is, without model codes at its end, its first two words if there are three or more, its first word."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    last = F.array_max(F.filter(F.transform(words, lambda w, i: F.when(~is_model_code(w), i)), lambda i: i.isNotNull()))
    kept = F.when(last.isNull(), F.slice(words, 1, 0)).otherwise(F.slice(words, 1, last + 1))
    base = F.when(F.size(kept) > 0, kept).otherwise(words)
    return F.array_distinct(F.filter(F.array(F.trim(c), F.array_join(kept, " "), F.when(F.size(base) >= 3, F.array_join(F.slice(base, 1, 2), " ")), F.get(words, F.lit(0))), lambda x: x.isNotNull() & (x != "")))


def loosely_equal(a: Column, b: Column) -> Column:
    """Whether two texts are equal or one holds the other, whatever the case; empty texts equal none."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.coalesce((a != "") & (b != "") & ((x == y) | x.contains(y) | y.contains(x)), F.lit(False))


def lookup_key(c: Column, version: int = 1) -> Column:
    """A label as the key of a cache: lower case, blanks collapsed, with a version in front."""
    return F.concat(F.lit(f"v{version}:"), F.coalesce(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), F.lit("")))


def envelope_id(run: Column, stage: Column, parents: Column, local: Column) -> Column:
    """Id of a fact by where it came from: a digest over digests of its parts, parents sorted, so that no separator in a part can be taken for another."""
    part = lambda x: F.sha2(x, 256)
    joined = F.array_join(F.array_sort(F.transform(parents, lambda x: F.sha2(x, 256))), ",")
    return F.substring(F.sha1(F.concat_ws("|", part(run), part(stage), part(joined), part(local))), 1, 32)


def safe_iri(c: Column) -> Column:
    """Whether a text may stand in angle brackets."""
    return F.coalesce((c != "") & ~c.rlike(r"[<>\"{}|^`\\\s]"), F.lit(False))


def json_objects(c: Column) -> Column:
    """The objects of the array in a text that may have fences and prose around it, as JSON texts; none if it can't be read."""
    t = F.regexp_replace(F.trim(c), r"(?m)^\s*```.*$", "")
    body = F.regexp_extract(t, r"(?s)(\[.*\])", 1)
    return F.coalesce(F.filter(F.from_json(body, "array<string>"), lambda x: x.startswith("{")), F.array().cast("array<string>"))


#: Last parts of the IRIs of ranges and the datatypes they declare.
RANGES = {"integer": "integer", "float": "float", "boolean": "boolean", "dateTime": "datetime", "Resource": "uri", "wktLiteral": "geo"}


def datatype_of_range(c: Column) -> Column:
    """Declared datatype of a range's IRI: a datatype, the type of entity it points at, or string."""
    known = F.create_map(*[F.lit(x) for kv in RANGES.items() for x in kv])
    entity = F.regexp_extract(c, "(?:^|/)types/([^/]+)/?$", 1)
    return F.when(entity != "", entity).otherwise(F.coalesce(F.element_at(known, F.regexp_extract(c, "#([A-Za-z]+)$", 1)), F.lit("string")))


def kept_datatype(declared: Column, seen: Column) -> Column:
    """The datatype a declaration keeps: its own unless it is none or string, since what is declared more richly is never taken back."""
    return F.when(declared.isNull() | (declared == "string"), seen).otherwise(declared)
