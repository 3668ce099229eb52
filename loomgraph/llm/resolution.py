"""Variant spellings of names: merge-and-rematch resolution.

A profile is the union of the forms (normalised spellings with their context) merged so far. Every round blocks the
profiles by keys of all their forms, matches inside each block by comparing a profile with the profiles built so far in that block, and links what
matches to the block's profile (a star, never all pairs). Components of the links merge, their forms are united, and only blocks in
which a merged profile stands are matched again, since a richer profile has more keys and more to agree with. The rounds end when
nothing merges.

Copies are one form from the start, so a group of copies of any size is one row in each block. A block of more than `max_block` profiles is spread over
parts, each part matched in itself and against each other part, in pieces of about `max_block` profiles: every two profiles of a block still meet.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.linking import canonical_ids
from ..runtime import drop_materialized, materialize
from .edit_join import within

_SPECIAL = str.maketrans({"ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})


def fold(text: str) -> str:
    """Lower case without accents."""
    t = unicodedata.normalize("NFKD", text.casefold().translate(_SPECIAL))
    return "".join(c for c in t if not unicodedata.combining(c))


def _edited(a: str, b: str, d: int) -> bool:
    """Whether at most d edits or swaps of neighbours make b of a: the first place at which they differ is mended in each way."""
    n, i = min(len(a), len(b)), 0
    while i < n and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    if not a or not b:
        return len(a) + len(b) <= d
    if d == 1:
        return a[1:] == b[1:] or a[1:] == b or a == b[1:] or (a[:2] == b[1::-1] and a[2:] == b[2:])
    if abs(len(a) - len(b)) > d:
        return False
    return _edited(a[1:], b[1:], d - 1) or _edited(a[1:], b, d - 1) or _edited(a, b[1:], d - 1) or (len(b) > 1 and a[:2] == b[1::-1] and _edited(a[2:], b[2:], d - 1))


@lru_cache(1 << 17)
def slips(a: str, b: str, most: int) -> int | None:
    """Edits between a and b if at most `most`, where a swap of neighbours counts once."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return None
    return next((d for d in range(1, min(most, 2) + 1) if _edited(a, b, d)), None) if most < 3 else next((d for d in (1, 2) if _edited(a, b, d)), within(a, b, most))


@lru_cache(1 << 16)
def letters(word: str) -> int:
    """The set of a word's letters as bits; an edit changes two of them at most, a swap none."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


def alike(a: str, b: str, most: int) -> bool:
    """Whether at most `most` slips make b of a; most words are told apart by their letters alone."""
    return a == b or ((letters(a) ^ letters(b)).bit_count() <= 2 * most and slips(a, b, most) is not None)


# --- organisations

#: Short forms of the words that organisations' names share.
EXPAND = {
    "st": "saint", "hosp": "hospital", "hsp": "hospital", "univ": "university", "u": "university", "ctr": "center", "cntr": "center", "centre": "center", "med": "medical", "reg": "regional", "regl": "regional", "mem": "memorial", "meml": "memorial",
    "comm": "community", "cmnty": "community", "cmty": "community", "hlth": "health", "sys": "system", "syst": "system", "children": "childrens", "inst": "institute", "rsch": "research", "res": "research", "found": "foundation", "fdn": "foundation", "fndn": "foundation",
    "bio": "biologics", "biologic": "biologics", "tx": "therapeutics", "therapeutic": "therapeutics", "pharma": "pharmaceuticals", "pharm": "pharmaceuticals", "pharmaceutical": "pharmaceuticals", "lab": "laboratories", "labs": "laboratories", "laboratory": "laboratories", "intl": "international", "natl": "national", "gen": "general", "clin": "clinic",
}
#: Words that say what kind of organisation it is; the second set tells kinds apart.
KIND_WORDS = frozenset({*EXPAND.values(), "clinic", "group", "trust", "college", "school", "department", "care", "services"})
KINDS = frozenset({"saint", "university", "regional", "memorial", "community", "childrens", "institute", "foundation", "biologics", "therapeutics", "pharmaceuticals", "laboratories", "clinic", "national", "international", "general"})
#: Words that say nothing.
EMPTY_WORDS = frozenset("the of and for at in a an inc ltd llc gmbh corp co company plc sa ag limited incorporated corporation".split())


def organisation_form(name: str | None) -> str | None:
    """`kinds|own words` of an organisation's name, null if nothing is left."""
    if name is None:
        return None
    t = re.sub(r"\([^()]*\)", " ", name)
    head, comma, rest = t.partition(",")
    if comma and rest.strip() and fold(rest).strip(" .") not in EMPTY_WORDS:
        t = f"{rest} {head}"
    t = re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ][a-zà-ÿ])", " ", t)
    t = re.sub(r"[’'`]", "", fold(t.replace("&", " and ").replace("+", " and ")))
    kinds, own = set(), []
    for w in re.findall(r"\w+", t):
        w = EXPAND.get(w, w)
        if w in EMPTY_WORDS:
            continue
        if w not in KIND_WORDS and len(w) >= 5:
            w = next((k for k in KIND_WORDS if len(k) >= 5 and abs(len(k) - len(w)) <= 1 and slips(w, k, 1) is not None), w)
        if w in KIND_WORDS:
            kinds.add(w)
        else:
            own.append(w)
    if not own:
        own = sorted(kinds)
    return " ".join(sorted(kinds & KINDS)) + "|" + " ".join(own) if own else None


class Organisations:
    """Keys and matches of organisations' forms."""

    @staticmethod
    def parse(forms: list[str]) -> dict:
        kinds, names = set(), set()
        for f in forms:
            k, _, own = f.partition("|")
            kinds |= set(k.split())
            names.add(own.replace(" ", ""))
        return {"kinds": kinds, "names": names}

    @staticmethod
    def keys(form: str) -> list[str]:
        own = form.partition("|")[2]
        whole = own.replace(" ", "")
        return sorted({"a" + whole[:6], "z" + whole[-6:]} | {"w" + w for w in own.split() if len(w) >= 5})

    @staticmethod
    def match(a: dict, b: dict) -> bool:
        if a["kinds"] and b["kinds"] and not a["kinds"] & b["kinds"]:
            return False
        return any(alike(x, y, max(1, min(4, min(len(x), len(y)) // 5))) if min(len(x), len(y)) >= 5 else x == y for x in a["names"] for y in b["names"])


# --- people

#: Common short and pet forms of given names, each to one full form: a default, for which a table of one's own may be given.
PET_NAMES = {
    "bob": "robert", "rob": "robert", "bobby": "robert", "bill": "william", "will": "william", "billy": "william", "liam": "william", "dick": "richard", "rick": "richard", "rich": "richard", "ben": "benjamin", "benny": "benjamin", "paco": "francisco", "pancho": "francisco",
    "pepe": "jose", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lisa": "elizabeth", "eliza": "elizabeth", "debbie": "deborah", "deb": "deborah", "vicky": "victoria", "vicki": "victoria", "tori": "victoria", "sue": "susanna", "susie": "susanna", "suzy": "susanna", "susan": "susanna",
    "ted": "theodore", "teddy": "theodore", "theo": "theodore", "greg": "gregory", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kat": "katherine", "mike": "michael", "mick": "michael", "tom": "thomas", "tommy": "thomas", "meg": "margaret", "maggie": "margaret", "peggy": "margaret", "peg": "margaret", "greta": "margaret",
    "alex": "alexander", "sasha": "alexander", "al": "alexander", "nate": "nathaniel", "nat": "nathaniel", "chris": "christopher", "kit": "christopher", "sam": "samuel", "sammy": "samuel", "ed": "edward", "eddie": "edward", "ned": "edward", "jen": "jennifer", "jenny": "jennifer", "pat": "patricia", "patty": "patricia", "tricia": "patricia", "trish": "patricia",
    "becky": "rebecca", "becca": "rebecca", "leo": "leonard", "len": "leonard", "lenny": "leonard", "lupe": "guadalupe", "lupita": "guadalupe", "dan": "daniel", "danny": "daniel", "dave": "david", "jim": "james", "jimmy": "james", "joe": "joseph", "jack": "john", "johnny": "john", "steve": "stephen", "tony": "anthony", "nick": "nicholas", "matt": "matthew", "andy": "andrew", "drew": "andrew",
    "charlie": "charles", "chuck": "charles", "hank": "henry", "harry": "henry", "larry": "lawrence", "ron": "ronald", "ken": "kenneth", "jeff": "jeffrey", "cathy": "catherine", "cindy": "cynthia", "mandy": "amanda", "sandy": "sandra", "barb": "barbara", "nico": "nicolas", "kiko": "francisco", "gio": "giorgio", "darek": "dariusz", "quin": "quentin", "xio": "xiomara", "wilma": "wilhelmina",
}


def pet_initials(pets: dict[str, str]) -> dict[str, set[str]]:
    """Initials that stand for a full name by one of its pet names."""
    out: dict[str, set[str]] = {}
    for pet, full in pets.items():
        out.setdefault(full, set()).add(pet[0])
    return out


#: Titles and credentials.
TITLES = frozenset("dr prof mr mrs ms miss sir md do np pa dpt phd rn dds dmd msn aprn fnp pt od dvm jr sr ii iii iv esq facp facs".split())
_NAME_TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")


def person_tokens(name: str | None) -> list[str]:
    """Folded words of a person's name without titles and credentials, the part after a comma first."""
    if name is None:
        return []
    t = fold(name.replace("’", "'"))
    parts = [[w for w in _NAME_TOKEN.findall(p) if w not in TITLES or (len(w) == 2 and p.strip(" .") != w and w in ("do", "pa", "pt", "od"))] for p in t.split(",")]
    last, rest = parts[0], [w for p in parts[1:] for w in p if w not in TITLES]
    last = [w for w in last if w not in TITLES]
    return rest + last if rest else last


def person_name(name: str | None, given_names: set[str], memo: dict | None = None, pets: dict[str, str] = PET_NAMES) -> tuple[str, tuple[str, ...]]:
    """(surname with its parts in order of the alphabet, given names and initials in order); given names are known words or one slip from one, whichever place they have."""
    tokens = person_tokens(name)
    memo = {} if memo is None else memo
    given, surname = [], []
    for w in tokens:
        if len(w) == 1:
            given.append(w)
            continue
        if w not in memo:
            full = pets.get(w, w)
            if full in given_names or w in given_names or w in pets:
                memo[w] = full
            elif "-" not in w and len(w) >= 3:
                near = [(d, abs(len(g) - len(w)), g) for g in given_names if (g[0] == w[0] or g[-1] == w[-1]) and abs(len(g) - len(w)) <= 2 and (letters(g) ^ letters(w)).bit_count() <= 4 and (d := slips(w, g, 1 if len(w) < 8 else 2)) is not None and (len(g) > 3 or d == 0)]
                if not near:  # a slip in a pet name
                    near = [(1, 0, full) for pet, full in pets.items() if len(pet) >= 5 and pet[-1] == w[-1] and alike(w, pet, 1)]
                memo[w] = min(near)[2] if near else None
            else:
                memo[w] = None
        if memo[w]:
            given.append(memo[w])
        else:
            surname.append(w)
    if not surname:
        full = [g for g in given if len(g) > 1]
        if full:
            surname = [full[-1]]
            given.remove(full[-1])
    return "-".join(sorted(x for w in surname for x in w.split("-"))), tuple(given)


class People:
    """Keys and matches of people's forms: tab-separated surname, given, city, state, phone, organisation, registry number."""

    initials = pet_initials(PET_NAMES)

    @classmethod
    def knowing(cls, pets: dict[str, str]) -> type[People]:
        """The same with other pet names."""
        return type(cls.__name__, (cls,), {"initials": pet_initials(pets)})

    @staticmethod
    def parse(forms: list[str]) -> dict:
        rows = [f.split("\t") for f in forms]
        col = lambda i: {r[i] for r in rows if r[i]}
        return {"surname": col(0), "given": {tuple(r[1].split()) for r in rows}, "city": col(2), "state": col(3), "phone": col(4), "org": col(5), "npi": col(6)}

    @staticmethod
    def keys(form: str) -> list[str]:
        surname, given, city, state, phone, org, npi = form.split("\t")
        if not surname:
            return []
        # a slip, even a swap, leaves one of two ends whole if they are shorter than half of the name
        n = min(4, max(3, (len(surname) - 1) // 2))
        first = given.split(" ")[0]
        parts = surname.split("-") if "-" in surname else ()
        # the parts of a surname may be written as one, in either order
        ends = sorted({"a" + surname[:n], "z" + surname[-n:], *(x for part in parts if len(part) >= n for x in ("a" + part[:n], "z" + part[-n:]))})
        out = []
        if org:
            out += [f"o{org}/{x}" for x in ends]
        if city:
            out += [f"c{city}/{x}" for x in ends]
        if phone:
            out += [f"p{phone}/{x}" for x in ends]
        if state:
            out.append(f"s{state}/{surname}")
        if npi:
            out.append(f"n{npi}")
        if org and city and len(first) > 1:  # for surnames with slips at both ends
            out.append(f"g{org}/{city}/{first}")
        return out

    @staticmethod
    def _surnames(a: dict, b: dict) -> bool:
        for x in a["surname"]:
            for y in b["surname"]:
                if (x[0] == y[0] or x[-1] == y[-1]) and alike(x, y, 1 if len(x) < 7 or len(y) < 7 else 2):
                    return True
                if ("-" in x) != ("-" in y) and abs(len(x) - len(y)) <= 3:  # parts written as one
                    apart, one = (x, y) if "-" in x else (y, x)
                    parts = apart.split("-")
                    if any(alike("".join(order), one, 2) for order in (parts, parts[::-1])):
                        return True
        return False

    @classmethod
    def _nearly(cls, a: dict, b: dict) -> bool:
        """Two slips in a short surname, where first name, organisation and city are the same."""
        if not (a["org"] & b["org"] and a["city"] & b["city"]):
            return False
        first = lambda p: {g[0] for g in p["given"] if g and len(g[0]) > 1}
        return bool(first(a) & first(b)) and any(min(len(x), len(y)) >= 5 and alike(x, y, 2) for x in a["surname"] for y in b["surname"])

    @classmethod
    def _one_given(cls, x: str, y: str) -> bool:
        if x == y:
            return True
        if len(x) == 1 or len(y) == 1:
            initial, name = (x, y) if len(x) == 1 else (y, x)
            return initial == name[0] or initial in cls.initials.get(name, ())
        return alike(x, y, 1)

    @classmethod
    def _given(cls, a: dict, b: dict) -> bool:
        """No two forms disagree in the first or in the second name; a missing name disagrees with none."""
        for x in a["given"]:
            for y in b["given"]:
                if x and y and not cls._one_given(x[0], y[0]):
                    return False
                if len(x) > 1 and len(y) > 1 and not cls._one_given(x[1], y[1]):
                    return False
        return True

    @staticmethod
    def _near(a: set, b: set, most: int) -> bool | None:
        """Whether two sets agree; null if either is empty."""
        if not a or not b:
            return None
        return bool(a & b) or any(alike(x, y, most) for x in a for y in b)

    @classmethod
    def match(cls, a: dict, b: dict) -> bool:
        if not cls._surnames(a, b) and not cls._nearly(a, b):
            return False
        if a["npi"] & b["npi"]:
            return True
        if a["npi"] and b["npi"] and not (a["npi"] & b["npi"]):
            return False
        if not cls._given(a, b):
            return False
        state, city, phone = cls._near(a["state"], b["state"], 0), cls._near(a["city"], b["city"], 1), cls._near(a["phone"], b["phone"], 1)
        org = bool(a["org"] & b["org"]) if a["org"] and b["org"] else None
        if state is False or city is False:
            return False
        if org is False:
            return bool(phone and city)
        return bool(city or org or phone)


# --- rounds


def _match_block(rows: list[tuple], rules) -> list[tuple[int, int]]:
    """Links inside one block of (pid, forms, fresh, part): each profile to the first it matches of those built before. Of two parts, only profiles of different parts are matched."""
    built: list[list] = []
    out = []
    first, last = min(r[3] for r in rows), max(r[3] for r in rows)
    for pid, forms, fresh, part in sorted(rows, key=lambda x: (x[3], -len(x[1]), x[0])):
        p = rules.parse(list(forms))
        if part == first != last:
            built.append([pid, p, fresh])
            continue
        for entry in built:
            if (fresh or entry[2]) and rules.match(p, entry[1]):
                out.append((entry[0], pid))
                entry[1] = {k: entry[1][k] | p[k] for k in p}
                entry[2] = True
                break
        else:
            if first == last:
                built.append([pid, p, fresh])
    return out


def _block_links(keyed: DataFrame, rules) -> DataFrame:
    """Links (a, b) found inside the blocks of (key, pid, forms, fresh, part). Blocks are many and small, so they stream through one function a partition."""

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rows = None, []
        for b in batches:
            out: list[tuple[int, int]] = []
            for key, *row in zip(b["key"], b["pid"], b["forms"], b["fresh"], b["part"]):
                if key != at:
                    out += _match_block(rows, rules) if len(rows) > 1 else []
                    at, rows = key, []
                rows.append(row)
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")
        yield pd.DataFrame(_match_block(rows, rules) if len(rows) > 1 else [], columns=["a", "b"]).astype("int64")

    return keyed.repartition("key").sortWithinPartitions("key").mapInPandas(inside, "a long, b long").distinct()


def merge_and_rematch(forms: DataFrame, rules, max_block: int = 2_000) -> DataFrame:
    """forms: (fid long, form string), one row a form. Gives (fid, entity) with the least fid of all that are the same. Each round but the last leaves fewer profiles, so the rounds end."""

    @F.pandas_udf("array<string>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([sorted({k for f in fs for k in rules.keys(f)}) for fs in b])

    profiles = materialize(forms.select(F.col("fid").alias("pid"), F.array("form").alias("forms"), F.lit(True).alias("fresh")), "profiles")
    entity = forms.select("fid", F.col("fid").alias("entity"))
    while True:
        keyed = profiles.select("pid", "forms", "fresh", F.explode(keys("forms")).alias("key"))
        sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.max("fresh").alias("any_fresh"))
        parts = F.when(F.col("n") <= max_block, 1).otherwise(F.ceil(2 * F.col("n") / max_block)).cast("int")
        split = keyed.join(sizes.filter("n > 1 AND any_fresh").select("key", parts.alias("parts")), "key").withColumn("part", F.pmod(F.xxhash64("pid"), "parts").cast("int"))
        other = split.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        piece = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.concat_ws("//", "key", F.least("part", "other").cast("string"), F.greatest("part", "other").cast("string")))
        links = materialize(_block_links(other.select(piece.alias("key"), "pid", "forms", "fresh", "part"), rules), "links")
        if links.isEmpty():
            break
        parts = canonical_ids(links)
        merged = profiles.join(parts, profiles["pid"] == parts["id"], "left").select(F.coalesce("canonical", "pid").alias("pid"), "forms", F.col("canonical").isNotNull().alias("fresh"))
        merged = merged.groupBy("pid").agg(F.array_distinct(F.flatten(F.collect_list("forms"))).alias("forms"), F.max("fresh").alias("fresh"))
        old, profiles = profiles, materialize(merged, "profiles")
        entity = materialize(entity.join(parts, entity["entity"] == parts["id"], "left").select("fid", F.coalesce("canonical", "entity").alias("entity")), "entities")
        drop_materialized(old)
        drop_materialized(links)
    return entity


def resolve_organisations(df: DataFrame, id_col: str, name: str, **options) -> DataFrame:
    """(spelling, row_id, entity): each distinct spelling, the least id that carries it, and its organisation."""

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return pd.Series([organisation_form(x) if isinstance(x, str) else None for x in s], dtype="object")

    spellings = df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("spelling")).agg(F.min(id_col).alias("row_id"))
    spellings = materialize(spellings.select("spelling", "row_id", form("spelling").alias("form")), "spellings")
    forms = spellings.filter("form IS NOT NULL").groupBy("form").agg(F.min("row_id").alias("fid"))
    entities = merge_and_rematch(forms.select("fid", "form"), Organisations, **options)
    return spellings.join(forms, "form").join(entities, "fid").select("spelling", "row_id", "entity")


def given_names(df: DataFrame, name: str, share: float = 0.005, least: int = 8, pets: dict[str, str] = PET_NAMES) -> set[str]:
    """Words of people's names that stand in at least `share` of the rows (so at most a bounded number): given names and middle names."""

    @F.pandas_udf("array<string>")
    def words(s: pd.Series) -> pd.Series:
        return pd.Series([sorted({w for w in person_tokens(x if isinstance(x, str) else None) if len(w) > 1}) for x in s])

    n = df.count()
    counts = df.select(F.explode(words(name)).alias("w")).groupBy("w").count().filter(F.col("count") >= max(least, share * n))
    return {r[0] for r in counts.collect()} | set(pets.values())


def resolve_people(df: DataFrame, id_col: str, name: str, city: str, state: str, phone: str, organisation: str, registry: str, organisations: DataFrame, pets: dict[str, str] = PET_NAMES, **options) -> DataFrame:
    """(row_id, entity) for all rows with a name. organisations: result of resolve_organisations on the same table; pets: short forms of given names and their full ones."""
    known = given_names(df, name, pets=pets)

    @F.pandas_udf("string")
    def form(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        memo: dict = {}
        text = lambda x: fold(" ".join(x.split())) if isinstance(x, str) else ""
        for names, cities, states, phones, orgs, numbers in batches:
            out = []
            for n, c, s, p, o, r in zip(names, cities, states, phones, orgs, numbers):
                surname, given = person_name(n, known, memo, pets) if isinstance(n, str) else ("", ())
                if len(memo) > 200_000:
                    memo.clear()
                digits = re.sub(r"\D", "", p)[-10:] if isinstance(p, str) else ""
                out.append("\t".join([surname, " ".join(given), text(c), text(s), digits if len(digits) >= 7 else "", "" if pd.isna(o) else str(int(o)), text(r)]) if surname else None)
            yield pd.Series(out, dtype="object")

    orgs = organisations.select(F.col("spelling").alias(organisation), F.col("entity").alias("_org"))
    rows = df.select(F.col(id_col).alias("row_id"), name, city, state, phone, organisation, registry).join(orgs, organisation, "left")
    rows = materialize(rows.select("row_id", form.asNondeterministic()(name, city, state, phone, "_org", registry).alias("form")).filter("form IS NOT NULL"), "people")
    forms = materialize(rows.groupBy("form").agg(F.min("row_id").alias("fid")), "forms")
    entities = merge_and_rematch(forms.select("fid", "form"), People if pets is PET_NAMES else People.knowing(pets), **options)
    return rows.join(forms, "form").join(entities, "fid").select("row_id", "entity")
