"""Same or near-same question records across splits.

A record has a question and a graph query. The query is brought into a canonical form (prefixes resolved, comments, layout and letter case of keywords
dropped, variables named by their role, patterns sorted). The question is brought into a canonical layout, without politeness and by a table of wordings
of equal meaning (`Wording`, optional); typing slips are left in it.

Overlaps come from one operator, the segment join of `edit_join`, over the questions as they stand and over their words sorted from the front and from the back
of each word (a place may stand in front or behind, and a slip moves a word in one of these orders at most), in three runs that differ in their block:

* both queries present: block = source, canonical query and numbers, up to `k_same_query` edits;
* a question is missing: block = source and canonical query, string empty;
* a query is missing: block = source and numbers, up to `k_question` edits, all of which must be slips inside of words.

Numbers must always be equal. In the last run at least one record of a pair lacks its query; these few emit the substrings, the many are cut into segments.
Classes of equal (block, question) are joined, not records. Defined results: records without question and query match nothing; null
splits or sources take no part; evaluation splits are all but `train`.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..runtime import materialize
from .edit_join import segment_join, within
from .resolution import slips

#: Polite openings and closings, as a default of Wording.
POLITE = re.compile(
    r"^(?:(?:please(?: tell me| list| say)?|kindly|quick question|hello|hi|hey|in this graph|could you(?: please)?(?: tell me| say)?|can you(?: please)?(?: tell me| say)?|would you(?: please)?(?: tell me| say)?|tell me|i would like to know|i want to know|just wondering)\s*[,:;]?\s+)+"
)
POLITE_END = re.compile(r"[\s,.;:!?]*\b(?:thanks(?: a lot| in advance)?|thank you(?: very much)?|please|cheers)[\s.!?]*$")
#: Wording of equal meaning, applied in order to the lower-case text, as a default of Wording.
EQUAL_WORDING = (
    (r"\bwhat's\b", "what is"),
    (r"\bwho's\b", "who is"),
    (r"\b(?:what|which) (?:is the )?(?:number|numb\w{1,3}|num\w{3}|nu\w{1,2}ber|n\w{1,2}mber|\w{1,2}mber|\w{0,2}umber) of\b", "how many"),
    (r"\bwhat is the count of\b", "how many"),
    (r"\bgive me the top\b", "what are the top"),
    (r"\bare the (?:first|best|leading|highest)\b", "are the top"),
    (r"^(?:show(?: me)?|give(?: me)?|name|enumerate) the\b", "list the"),
    (r"\b(?:each|all of the)\b", "every"),
    (r"\bare part of\b", "belong to"),
    (r"\bregistered\b", "recorded"),
    (r"\b(?:mean)\b", "average"),
    (r"\b(?:show|with|having|report) an?\b", "have a"),
    (r"\b(?:over|more than|greater than|higher than|exceeding)\b(?= \d)", "above"),
    (r"\b(?:under|less than|fewer than|lower than|smaller than)\b(?= \d)", "below"),
    (r"\bsituated\b", "located"),
    (r"\b(?:connected|tied) to\b", "linked to"),
    (r"^what (?!is |are )", "which "),
    (r"\bduring\b", "in"),
)


@dataclass(frozen=True)
class Wording:
    """Openings and endings that say nothing, and pairs of pattern and replacement of equal meaning. `Wording(None, None, ())` changes no word."""

    opening: re.Pattern | None = POLITE
    ending: re.Pattern | None = POLITE_END
    equal: tuple[tuple[str, str], ...] = EQUAL_WORDING


#: Number words.
NUMBER_WORDS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split())}
_NUMBER_WORD = re.compile(r"\b(?:" + "|".join(NUMBER_WORDS) + r")\b")
_FRONT = re.compile(r"^(in|at|for|within) ([^,]+), (.+)$")
_LEAD = re.compile(r"^[\s\-*•>\"'“”‘’`]+|[\s\"'“”‘’`?.!]+$")


def plain_question(text: str | None, wording: Wording = Wording()) -> str | None:
    """The question in canonical layout and wording, null if nothing is left."""
    if text is None:
        return None
    polite = (lambda x: wording.opening.sub("", x)) if wording.opening else (lambda x: x)
    t = unicodedata.normalize("NFKC", html.unescape(text)).casefold().replace("’", "'")
    t = re.sub(r"\s+", " ", t).strip()
    before = None
    while before != t:
        before = t
        t = polite(_LEAD.sub("", t))
        t = wording.ending.sub("", t) if wording.ending else t
        if (m := _FRONT.match(t)) and (rest := polite(m[3])) != m[3]:
            t = f"{m[1]} {m[2]}, {rest}"
    fronted = _FRONT.match(t)
    if fronted:
        t = fronted[3]
    for pattern, to in wording.equal:
        t = re.sub(pattern, to, t)
    if fronted:
        t += f" {fronted[1]} {fronted[2]}"
    t = re.sub(r"(?<=\d),(?=\d{3}\b)", "", t)
    t = _NUMBER_WORD.sub(lambda m: NUMBER_WORDS[m[0]], t)
    t = re.sub(r"[^\w\s.'-]|(?<!\d)\.|\.(?!\d)", " ", t)
    return " ".join(t.split()) or None


_TOKEN = re.compile(r"<[^<>\s]*>|\"(?:[^\"\\]|\\.)*\"(?:@[\w-]+|\^\^\S+)?|'(?:[^'\\]|\\.)*'|[?$]\w+|[\w-]*:[\w-]+|[A-Za-z_]\w*|[-+]?\d+(?:\.\d+)?|[<>!]=?|=|\|\||&&|\S")
_PREFIX = re.compile(r"\bprefix\s+([\w-]*)\s*:\s*<([^>]*)>", re.I)
_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"


def _strip_comments(q: str) -> str:
    """Without comments: a hash outside of an IRI or a string, to the end of its line."""
    return re.sub(r"(<[^<>\s]*>|\"(?:[^\"\\]|\\.)*\")|#[^\n\r]*", lambda m: m[1] or " ", q)


def canonical_query(q: str | None) -> str | None:
    """A graph query without layout, prefixes, comments, keyword case, variable names and pattern order; null if empty."""
    if q is None or not q.strip():
        return None
    q = _strip_comments(q)
    prefixes = dict(_PREFIX.findall(q))
    tokens = []
    for t in _TOKEN.findall(_PREFIX.sub(" ", q)):
        if t[0] in "?$" and len(t) > 1:
            tokens.append("?" + t[1:])
        elif (t[0] == "<" and t[-1] == ">") or t[0] in "\"'":
            tokens.append('"' + t[1:-1] + '"' if t[0] == "'" and t[-1] == "'" else t)
        elif ":" in t and t != ":":
            name, _, rest = t.partition(":")
            tokens.append(f"<{prefixes.get(name, name + ':')}{rest}>")
        elif t == "a":
            tokens.append(_TYPE)
        else:
            tokens.append(t.upper())
    head: list[str] = []
    items: list[tuple[str, tuple[str, ...]]] = []
    tail: list[str] = []
    scope: list[str] = []
    current: list[str] = []
    i = 0

    def flush() -> None:
        nonlocal current
        if current:
            # a list of predicates and objects stands for as many patterns
            subject, parts = current[:1], [[]]
            for x in current[1:]:
                if x == ";":
                    parts.append([])
                else:
                    parts[-1].append(x)
            for p in parts:
                if p or len(parts) == 1:
                    items.append(("/".join(scope), tuple(subject + p)))
        current = []

    while i < len(tokens):
        t = tokens[i]
        if t == "{":
            if not scope and not items:
                head, current = current, []
                scope.append("")
            else:
                label, current = " ".join(current), []
                scope.append(label)
        elif t == "}":
            flush()
            if scope:
                scope.pop()
            if not scope:
                tail = tokens[i + 1 :]
                break
        elif t == ".":
            flush()
        elif t in ("FILTER", "BIND", "HAVING") and scope:
            flush()
            if i + 1 < len(tokens) and tokens[i + 1] == "(":
                depth, j = 0, i + 1
                while j < len(tokens):
                    depth += (tokens[j] == "(") - (tokens[j] == ")")
                    j += 1
                    if depth == 0:
                        break
                items.append(("/".join(scope), (t, *tokens[i + 1 : j])))
                i = j
                continue
            current = [t]
        else:
            current.append(t)
        i += 1
    if not items:
        head = tokens
    head = [t for t in head if t != "WHERE"]
    # the role of a variable: refined by the patterns in which it stands until no roles are told apart any more
    variables = sorted({t for t in tokens if t[0] == "?"})
    role = dict.fromkeys(variables, "?")
    show = lambda ts, own=None: " ".join("@" if t == own else role.get(t, t) for t in ts)
    for _ in variables:
        new = {}
        for v in variables:
            seen = sorted(f"{s}:{show(ts, v)}" for s, ts in [("head", tuple(head)), ("tail", tuple(tail)), *items] if v in ts)
            new[v] = "?" + hashlib.md5("\n".join(seen).encode()).hexdigest()[:12]
        settled = len(set(new.values())) in (len(variables), len(set(role.values())))
        role = new
        if settled:
            break
    return show(head) + " { " + " . ".join(sorted(f"{s}:{show(ts)}" for s, ts in items)) + " } " + show(tail)


def slips_only(a: str, b: str) -> bool:
    """Whether two questions differ by slips inside of words alone: words that only one of them has pair up, each pair at most two edits or swaps and a quarter of its length apart; digits never differ. Blanks may be misplaced by one."""
    x, y = Counter(a.split()), Counter(b.split())
    left, right = list((x - y).elements()), list((y - x).elements())
    if len(left) != len(right):
        return within(a.replace(" ", ""), b.replace(" ", ""), 0) is not None
    for w in left:
        near = [(d, r) for r in right if min(len(w), len(r)) >= 4 and not any(c.isdigit() for c in w + r) and (d := slips(w, r, min(2, min(len(w), len(r)) // 4))) is not None]
        if not near:
            return False
        right.remove(min(near)[1])
    return True


def prepare(df: DataFrame, id_col: str, split: str, source: str, question: str, query: str, wording: Wording = Wording()) -> DataFrame:
    """(id, split, source, q: canonical question, w and v: its words sorted from the front and from the back, s: digest of the canonical query)."""

    @F.pandas_udf("q string, s string")
    def both(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        digest = lambda x: None if x is None else hashlib.md5(x.encode()).hexdigest()
        text = lambda x: x if isinstance(x, str) else None
        return pd.DataFrame({"q": [plain_question(text(x), wording) for x in a], "s": [digest(canonical_query(text(x))) for x in b]})

    base = df.select(F.col(id_col).alias("id"), F.col(split).alias("split"), F.col(source).alias("source"), both.asNondeterministic()(F.col(question), F.col(query)).alias("x"))
    words = F.split("x.q", " ")
    backwards = F.transform(F.array_sort(F.transform(words, F.reverse)), F.reverse)
    base = base.select("id", "split", "source", "x.q", F.array_join(F.array_sort(words), " ").alias("w"), F.array_join(backwards, " ").alias("v"), "x.s")
    return base.filter("split IS NOT NULL AND source IS NOT NULL AND (q IS NOT NULL OR s IS NOT NULL)")


def _met(cut: DataFrame, emit: DataFrame, k: int) -> DataFrame:
    """(block, probe, target, distance) of classes (block, q, w, v) whose questions, in one of their orders, are at most k edits apart; `cut` is the larger side."""
    orders = F.array(*[F.struct(F.concat(F.lit(n), "block").alias("block"), F.col(c).alias("text"), F.col("q").alias("tag")) for n, c in (("kept/", "q"), ("sorted/", "w"), ("backwards/", "v"))])
    strings = lambda d: d.distinct().select(F.inline(orders))
    return segment_join(strings(cut), strings(emit), k).withColumn("block", F.expr("substr(block, instr(block, '/') + 1)"))


def class_overlaps(prepared: DataFrame, k_same_query: int = 6, k_question: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (run, block, text, id, split, source, is_train, lacks) and links (run, block, e, t, distance) between an evaluation and a training class of equal block and text. Of two members of linked classes at least one must lack a field in the runs `query` and `question`."""
    base = prepared.withColumn("is_train", F.col("split") == "train")
    key = lambda *c: F.concat_ws("\u0001", *c)
    numbers = F.concat_ws(" ", F.array_sort(F.regexp_extract_all("q", F.lit(r"\d[\d.]*"), F.lit(0))))

    @F.pandas_udf("boolean")
    def slip(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([slips_only(x, y) for x, y in zip(a, b)], dtype="boolean")

    both = base.filter("q IS NOT NULL AND s IS NOT NULL").select("*", key("source", "s", numbers).alias("block"), F.lit(False).alias("lacks"))
    query = base.filter("s IS NOT NULL").select("*", key("source", "s").alias("block"), F.col("q").isNull().alias("lacks")).withColumn("q", F.lit(""))
    question = base.filter("q IS NOT NULL").select("*", key("source", numbers).alias("block"), F.col("s").isNull().alias("lacks"))
    cut, emit = both.filter("NOT is_train").select("block", "q", "w", "v"), both.filter("is_train").select("block", "q", "w", "v")
    links = _met(cut, emit, k_same_query).select(F.lit("both").alias("run"), "block", F.col("probe").alias("e"), F.col("target").alias("t"), "distance")
    # an empty string in place of the questions: the block alone decides
    sides = query.groupBy("block").agg(F.bool_or(~F.col("is_train")).alias("e"), F.bool_or("is_train").alias("t"), F.bool_or("lacks").alias("l")).filter("e AND t AND l")
    links = links.unionByName(sides.select(F.lit("query").alias("run"), "block", F.lit("").alias("e"), F.lit("").alias("t"), F.lit(0).alias("distance")))
    # each kind of split meets only the other one, since the kind stands in the block: a class's own where it is cut, the other one where it emits
    kinds = lambda train: F.when(train, F.lit("t")).otherwise(F.lit("e"))
    cut = question.select(key(kinds(F.col("is_train")), "block").alias("block"), "q", "w", "v")
    emit = question.filter("lacks").select(key(kinds(~F.col("is_train")), "block").alias("block"), "q", "w", "v")
    met = _met(cut, emit, k_question).filter(slip("probe", "target"))
    cut_is_train = F.col("block").startswith("t")
    met = met.select(F.lit("question").alias("run"), F.expr("substr(block, 3)").alias("block"), F.when(cut_is_train, F.col("target")).otherwise(F.col("probe")).alias("e"), F.when(cut_is_train, F.col("probe")).otherwise(F.col("target")).alias("t"), "distance")
    links = links.unionByName(met).groupBy("run", "block", "e", "t").agg(F.min("distance").alias("distance"))
    members = reduce(lambda a, b: a.unionByName(b), [d.select(F.lit(run).alias("run"), "block", F.col("q").alias("text"), "id", "split", "source", "is_train", "lacks") for run, d in (("both", both), ("query", query), ("question", question))])
    return members, links


def overlapping_pairs(prepared: DataFrame, **options) -> DataFrame:
    """(question_a, question_b, eval_split, source, distance): pairs of records, the smaller id first."""
    prepared = materialize(prepared, "questions")
    members, links = class_overlaps(prepared, **options)
    e = members.filter("NOT is_train").select("run", "block", F.col("text").alias("e"), F.col("id").alias("ie"), "split", "source", F.col("lacks").alias("le"))
    t = members.filter("is_train").select("run", "block", F.col("text").alias("t"), F.col("id").alias("it"), F.col("lacks").alias("lt"))
    out = links.join(e, ["run", "block", "e"]).join(t, ["run", "block", "t"]).filter("run = 'both' OR le OR lt")
    return out.select(F.least("ie", "it").alias("question_a"), F.greatest("ie", "it").alias("question_b"), F.col("split").alias("eval_split"), "source", "distance")


def overlap_counts(prepared: DataFrame, **options) -> DataFrame:
    """(split, source, n_pairs, n_slipped) of overlapping_pairs by products of class sizes: copies are never expanded. n_slipped: pairs that only edits bring together."""
    prepared = materialize(prepared, "questions")
    members, links = class_overlaps(prepared, **options)
    sizes = members.groupBy("run", "block", "text", "split", "source", "is_train").agg(F.count("*").alias("n"), F.count_if("lacks").alias("n_lacks"))
    e = sizes.filter("NOT is_train").select("run", "block", F.col("text").alias("e"), "split", "source", F.col("n").alias("ne"), F.col("n_lacks").alias("le"))
    t = sizes.filter("is_train").select("run", "block", F.col("text").alias("t"), F.col("n").alias("nt"), F.col("n_lacks").alias("lt"))
    pairs = F.when(F.col("run") == "both", F.col("ne") * F.col("nt")).otherwise(F.col("ne") * F.col("nt") - (F.col("ne") - F.col("le")) * (F.col("nt") - F.col("lt")))
    out = links.join(e, ["run", "block", "e"]).join(t, ["run", "block", "t"]).select("split", "source", "distance", pairs.alias("n"))
    return out.groupBy("split", "source").agg(F.sum("n").alias("n_pairs"), F.sum(F.when(F.col("distance") > 0, F.col("n")).otherwise(0)).alias("n_slipped")).filter("n_pairs > 0")
