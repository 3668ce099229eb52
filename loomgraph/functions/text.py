"""Text, URL and JSON functions: chunks, snippets, tokens, list cells, redaction, guards. Column expressions but for the chunker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

#: Characters that start a formula in a spreadsheet.
FORMULA = r"^[=+\-@\t\r]"
#: Emoji and the marks that join them.
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2190}-\x{21FF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}\x{20E3}\x{E0020}-\x{E007F}]"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def snippet(c: Column, limit: int = 240) -> Column:
    """At most `limit` characters, cut at the last blank before it, with an ellipsis where something is left out."""
    head = F.substring(c, 1, limit)
    cut = F.regexp_extract(head, r"(?s)^(.+) [^ ]*$", 1)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.rtrim(F.when(cut != "", cut).otherwise(head)), F.lit("…")))


def csv_safe(c: Column) -> Column:
    """With an apostrophe in front of what a spreadsheet would take for a formula."""
    return F.when(c.rlike(FORMULA), F.concat(F.lit("'"), c)).otherwise(c)


def without_emoji(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, EMOJI, ""), r"\s+", " "))


def split_list(c: Column, delimiters: list[str]) -> Column:
    """Parts between any of the delimiters, the longest first, trimmed, without empty ones and repeats."""
    import re

    pattern = "|".join(re.escape(d) for d in sorted(delimiters, key=len, reverse=True))
    return F.array_distinct(F.filter(F.transform(F.split(c, pattern), lambda x: F.trim(x)), lambda x: x != ""))


def target_labels(c: Column) -> Column:
    """Labels in a relationship cell: parts between bars, or between comma and blank where there are several, all short; else the cell."""
    bars = F.filter(F.transform(F.split(c, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    commas = F.filter(F.transform(F.split(c, ", "), lambda x: F.trim(x)), lambda x: x != "")
    whole = F.filter(F.array(F.trim(c)), lambda x: x != "")
    return F.when(c.contains("|"), bars).when(c.contains(", ") & (F.size(commas) >= 2) & F.forall(commas, lambda x: F.length(x) < 30), commas).otherwise(whole)


def redact_url(c: Column) -> Column:
    """Without user, password and values of secret parameters."""
    return F.regexp_replace(F.regexp_replace(c, r"(?i)^([a-z][a-z0-9+.-]*://)[^/@\s]+@", "$1"), r"(?i)([?&](?:api_?key|key|token|access_token|secret|password|sig|signature)=)[^&#\s]*", "$1REDACTED")


def normal_url(c: Column) -> Column:
    """Scheme and host in lower case, https where no scheme is given, no trailing slash."""
    t = F.trim(c)
    full = F.when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))
    front = F.regexp_extract(full, "^(?i)(https?://[^/?#]*)", 1)
    return F.regexp_replace(F.concat(F.lower(front), full.substr(F.length(front) + 1, F.length(full))), "/+$", "")


#: Last labels of a host that make a bare word with dots one.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "mil", "int", "io", "co", "us", "ca", "uk", "au", "nz", "ie", "de", "fr", "es", "it", "nl", "eu", "in", "cn", "jp", "br", "mx", "za", "info", "biz", "app", "dev", "ai", "tech", "xyz", "online", "site")


def urls_in(c: Column, bare: bool = False) -> Column:
    """Distinct http(s) addresses in a text, without the punctuation that follows them; with `bare`, hosts without a scheme, too, if they end in a well-known domain and are no part of a mail address."""
    clean = lambda u: F.regexp_replace(u, "[.,;:!?]+$", "")
    full = F.transform(F.regexp_extract_all(c, F.lit(r"(https?://[^\s<>\"')\]]+)"), F.lit(1)), clean)
    if not bare:
        return F.array_distinct(full)
    rest = F.regexp_replace(c, r"https?://[^\s<>\"')\]]+|\S*@\S*", " ")
    host = r"(?i)(?<![\w.-])((?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+(?:" + "|".join(TOP_DOMAINS) + r")(?:/[^\s<>\"')\]]*)?)(?![\w-])"
    return F.array_distinct(F.concat(full, F.transform(F.regexp_extract_all(rest, F.lit(host), F.lit(1)), lambda u: F.concat(F.lit("https://"), clean(F.lower(u))))))


def local_name(c: Column) -> Column:
    """Last segment of an identifier, with blanks for underscores."""
    return F.replace(F.regexp_replace(c, "^.*[/#]", ""), F.lit("_"), F.lit(" "))


def title_case(c: Column) -> Column:
    return F.initcap(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))))


def synthetic_key(type_name: str, columns: dict[str, Column]) -> Column:
    """Sixteen hex digits over the type and the sorted `name=value` of filled columns: the same for equal rows, whatever their order."""
    filled = F.array_compact(F.array(*[F.when(F.trim(c.cast("string")) != "", F.concat(F.lit(f"{n}="), F.trim(c.cast("string")))) for n, c in sorted(columns.items())]))
    return F.substring(F.sha1(F.concat(F.lit(f"{type_name}|"), F.array_join(F.array_sort(filled), "|"))), 1, 16)


def lexical_score(query: list[str], text: Column) -> Column:
    """Share of distinct query words that occur, times their occurrences, over the length of the text plus ten."""
    words, wanted = tokens(text), F.array(*[F.lit(q) for q in sorted(set(query))])
    hits = F.filter(words, lambda w: F.array_contains(wanted, w))
    return F.when(F.size(words) > 0, F.size(F.array_distinct(hits)) / float(len(set(query))) * F.size(hits) / (F.size(words) + 10.0)).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for different lengths, zero vectors and vectors that hold null or NaN."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n = norm(a) * norm(b)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (n > 0), F.nanvl(dot / n, F.lit(0.0))), F.lit(0.0))


def break_points(text: str, limit: int, least: int) -> list[str]:
    """Pieces of at most `limit` characters that end at a paragraph, else a sentence, else a line, else a blank, where one lies beyond `least`."""
    out, at = [], 0
    while at < len(text):
        if len(text) - at <= limit:
            out.append(text[at:])
            break
        window = text[at : at + limit]
        end = limit
        for mark, keep in (("\n\n", 0), (". ", 1), ("! ", 1), ("? ", 1), ("\n", 0), (" ", 0)):
            k = window.rfind(mark)
            if k >= least:
                end = k + keep
                break
        out.append(text[at : at + end])
        at += end
        while at < len(text) and text[at].isspace():
            at += 1
    return [p for p in (x.strip() for x in out) if p]


def chunks(limit: int = 2048, least: int = 1024):
    """Arrow function: array of chunks of each text."""

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([break_points(t, limit, least) if isinstance(t, str) else [] for t in b])

    return cut


def overlapping_pieces(text: str, limit: int, overlap: int) -> list[tuple[int, str]]:
    """(start, piece): pieces of at most `limit` characters that end after a sentence where one ends in their second half, each beginning up to `overlap` characters before the end of the one before."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + limit)
        if end < len(text):
            cut = max(text.rfind(mark, at + limit // 2, end) for mark in (". ", "! ", "? ", ".\n", "\n\n"))
            end = cut + 1 if cut > 0 else end
        out.append((at, text[at:end]))
        if end >= len(text):
            break
        at = max(at + 1, end - overlap)
    return out


def overlapping_chunks(limit: int = 3000, overlap: int = 200):
    """Arrow function: array of structs of start and chunk of each text."""

    @F.pandas_udf("array<struct<start:int,chunk:string>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([[{"start": s, "chunk": c} for s, c in overlapping_pieces(t, limit, overlap)] if isinstance(t, str) else [] for t in b])

    return cut
