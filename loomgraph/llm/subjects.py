"""Subject areas of documents.

Subject terms (one to three words) with weights are fitted on a bounded sample of labelled documents: sentences start with the
subjects of their document, terms get the share of each subject among their sentences, sentences are assigned anew by their terms, and so on a few
times, which tells the subjects of one document apart. A term is kept if it is pure enough; its weight is its purity, less for words that stand in many
documents, more for longer terms.

All terms become one Aho-Corasick automaton a Python worker. Every document is read once, where it lies, in one pass of the automaton: each sentence with a
term is about the subject of the greatest summed weight, and a subject's share among such sentences (so length is normalised) is held against the subject's
own threshold. Thresholds are calibrated on labelled documents that the terms were not fitted on.

Import notes count for nothing: sentences that name the document's own source, and those with a turn of words that stands beside sources in the sample.

Defined results: null, empty and wordless texts have no subject; labels are matched without case and outer blanks, other labels ignored; without
usable labels nothing is assigned. Bound: `max_labelled` documents on the driver, chosen by hash of the id.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..runtime import bounded_rows
from .text import sentence_words, words_of


def terms_of(words: list[str]) -> set[str]:
    return {*words, *map(" ".join, zip(words, words[1:])), *map(" ".join, zip(words, words[1:], words[2:]))}


#: The share from which on a subject counts where there are no labels to calibrate it: the definition's own.
QUARTER = 0.25


class SubjectModel:
    """weights: term -> {subject: weight}; thresholds: subject -> share; notes: turns of words whose sentences don't count."""

    def __init__(self, weights: dict[str, dict[str, float]], thresholds: dict[str, float], floor: float, notes: frozenset[str] = frozenset()):
        self.weights, self.thresholds, self.floor, self.notes = weights, thresholds, floor, notes
        self.automaton = None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}

    def _build(self):
        import ahocorasick

        self.names = sorted({s for w in self.weights.values() for s in w})
        number = {s: i for i, s in enumerate(self.names)}
        self.automaton = ahocorasick.Automaton()
        for t, w in self.weights.items():
            self.automaton.add_word(f" {t} ", (t, tuple((number[s], x) for s, x in w.items())))
        for t in self.notes:
            self.automaton.add_word(f" {t} ", (t, None))
        self.automaton.make_automaton()

    def shares(self, text: str | None, source: str | None = None) -> dict[str, float]:
        """Share of each subject among the text's sentences about any subject."""
        if not text or not self.weights:
            return {}
        if self.automaton is None:
            self._build()
        lines = [" ".join(w) for w in sentence_words(text)]
        own = f" {source} " if source else None
        count = [0] * len(self.names)
        score, seen, noted = [0.0] * len(self.names), set(), False
        k, limit, begun = 0, len(lines[0]) + 1 if lines else 0, False

        def close() -> None:
            nonlocal score, noted, begun
            if begun and not noted and not (own and own in f" {lines[k]} "):
                best = max(range(len(score)), key=score.__getitem__)
                if score[best] >= self.floor:
                    count[best] += 1
            if begun:
                score = [0.0] * len(score)
                seen.clear()
                noted = begun = False

        for end, (t, w) in self.automaton.iter(" " + " | ".join(lines) + " "):
            while end > limit:
                close()
                k += 1
                limit += len(lines[k]) + 3
            begun = True
            if w is None:
                noted = True
            elif t not in seen:
                seen.add(t)
                for i, x in w:
                    score[i] += x
        close()
        total = sum(count)
        return {s: n / total for s, n in zip(self.names, count) if n}

    def chosen(self, shares: dict[str, float]) -> list[str]:
        return sorted(s for s, x in shares.items() if x >= self.thresholds.get(s, QUARTER))

    def subjects(self, text: str | None) -> list[str]:
        return self.chosen(self.shares(text))


def source_phrase(source: str | None) -> str | None:
    """A source as it reads in a text, if it is of two words or more; one word may be a word of any sentence."""
    words = words_of(source) if source else []
    return " ".join(words) if len(words) > 1 else None


def note_phrases(labelled: list[tuple[str, set[str], str | None]], sentences: list[list[list[str]]] | None = None, n: int = 4, least: int = 3, purity: float = 0.9) -> frozenset[str]:
    """Turns of n words that stand beside the names of sources: in at least `least` documents, and nearly always in such sentences. sentences: the words of each text's sentences, if they are known."""
    by_first: dict[str, list[list[str]]] = {}
    for p in {p for _, _, s in labelled if (p := source_phrase(s))}:
        by_first.setdefault(p.split()[0], []).append(p.split())
    named_in = lambda w: {x for i, first in enumerate(w) if first in by_first for p in by_first[first] if w[i : i + len(p)] == p for x in p}
    beside, anywhere = Counter(), Counter()
    for sents in sentences if sentences is not None else [sentence_words(text or "") for text, _, _ in labelled]:
        here: set[str] = set()
        for w in sents:
            runs = [w[i : i + n] for i in range(len(w) - n + 1)]
            anywhere.update({" ".join(r) for r in runs})
            if named := named_in(w):
                here |= {" ".join(r) for r in runs if not named & set(r)}
        beside.update(here)
    return frozenset(r for r, c in beside.items() if c >= least and c >= purity * anywhere[r])


def fit(labelled: list[tuple[str, set[str], str | None]], rounds: int = 4, least_documents: int = 3, purity: float = 0.45, gain: float = 0.35, floor: float = 0.35, held_out: float = 0.25) -> SubjectModel:
    """labelled: text, its subjects and its source. The last `held_out` of them calibrate the thresholds and are not fitted on."""
    labelled = [x for x in labelled if x[0] and x[1]]
    n_fit = len(labelled) - int(len(labelled) * held_out)
    sentences = [sentence_words(t) for t, _, _ in labelled]
    model = fit_terms(labelled[:n_fit], sentences[:n_fit], note_phrases(labelled, sentences), rounds, least_documents, purity, gain, floor)
    model.thresholds = calibrated([(model.shares(t, source_phrase(src)), s) for t, s, src in labelled[n_fit:]])
    return model


def calibrated(shares: list[tuple[dict[str, float], set[str]]], least: int = 30, slack: float = 0.004) -> dict[str, float]:
    """The threshold of each subject by F1 over documents whose subjects are known: of those nearly as good as the best, the one nearest to a quarter. Subjects with few documents keep the quarter."""
    out = {}
    for subject in {s for _, known in shares for s in known}:
        if sum(subject in known for _, known in shares) < least:
            continue
        scored = []
        for threshold in (x / 100 for x in range(15, 36)):
            hit = sum(have.get(subject, 0.0) >= threshold and subject in known for have, known in shares)
            got = sum(have.get(subject, 0.0) >= threshold for have, _ in shares)
            scored.append((2 * hit / max(1, got + sum(subject in known for _, known in shares)), threshold))
        best = max(f for f, _ in scored)
        out[subject] = min((abs(t - QUARTER), t) for f, t in scored if f >= best - slack)[1]
    return out


def fit_terms(labelled: list[tuple[str, set[str], str | None]], sentences: list[list[list[str]]], notes: frozenset[str], rounds: int, least_documents: int, purity: float, gain: float, floor: float) -> SubjectModel:
    """The terms of each subject and their weights."""
    is_note = lambda w, own: (own and f" {own} " in w) or any(f" {n} " in w for n in notes)
    texts = [([w for w in sents if not is_note(f" {' '.join(w)} ", own)], s) for (_, s, src), sents in zip(labelled, sentences) for own in [source_phrase(src)]]
    df: Counter = Counter()
    for sents, _ in texts:
        df.update({t for w in sents for t in terms_of(w)})
    number = {t: i for i, t in enumerate(t for t, n in df.items() if n >= least_documents)}
    names, often = list(number), [df[t] for t in number]
    del df
    data = [([[number[t] for t in terms_of(w) if t in number] for w in sents], sorted(s)) for sents, s in texts]
    subjects = sorted({x for _, s in data for x in s})
    assign = [[{x: 1 / len(s) for x in s} for _ in sents] for sents, s in data]
    weights: dict[int, dict[str, float]] = {}
    for _ in range(rounds):
        counts: list[dict[str, float]] = [defaultdict(float) for _ in names]
        total: dict[str, float] = defaultdict(float)
        for (sents, _), a in zip(data, assign):
            for terms, share in zip(sents, a):
                for s, x in share.items():
                    total[s] += x
                    for t in terms:
                        counts[t][s] += x
        everything = sum(total.values()) or 1.0
        weights = {}
        for t, c in enumerate(counts):
            n = sum(c.values())
            if not n:
                continue
            p = {s: (c.get(s, 0.0) + 0.5 * total[s] / everything) / (n + 0.5) for s in subjects}
            top = max(p, key=p.__getitem__)
            prior = total[top] / everything
            if p[top] >= max(purity, prior + gain * (1 - prior)):
                rarity = 0.5 + 0.5 * math.log((len(data) + 1) / often[t]) / math.log(len(data) + 1)
                scale = (1 + 0.3 * names[t].count(" ")) * rarity
                weights[t] = {s: x**3 * scale for s, x in p.items() if x > 0.05}
        for k, (sents, own) in enumerate(data):
            new = []
            for terms in sents:
                score: dict[str, float] = defaultdict(float)
                for t in terms:
                    for s, x in weights.get(t, {}).items():
                        if s in own:
                            score[s] += x
                z = sum(score.values())
                new.append({s: x / z for s, x in score.items()} if z else {})
            assign[k] = new
    return SubjectModel({names[t]: w for t, w in weights.items()}, {}, floor, notes)


def labelled_sample(documents: DataFrame, id_col: str, text: str, source: str | None, labels: DataFrame, label_id: str, label: str, areas: list[str], max_labelled: int) -> list[tuple[str, set[str], str | None]]:
    """Texts, subjects and sources of at most `max_labelled` labelled documents, by hash of the id."""
    by_name = {a.strip().lower(): a for a in areas}
    clean = labels.select(F.col(label_id).alias("d"), F.lower(F.trim(label)).alias("s")).filter(F.col("s").isin(*by_name))
    chosen = clean.groupBy("d").agg(F.collect_set("s").alias("s")).orderBy(F.xxhash64("d")).limit(max_labelled)
    own = F.col(source) if source else F.lit(None).cast("string")
    rows = documents.select(F.col(id_col).alias("d"), F.col(text).alias("t"), own.alias("o")).join(F.broadcast(chosen), "d").select("t", "s", "o", F.xxhash64("d").alias("h")).collect()
    return [(r[0], {by_name[x] for x in r[1]}, r[2]) for r in sorted(rows, key=lambda r: r[3])]


def assign_subjects(documents: DataFrame, id_col: str, text: str, labels: DataFrame, label_id: str, label: str, areas: DataFrame, area: str, source: str | None = None, max_labelled: int = 4_000, max_areas: int = 10_000) -> DataFrame:
    """(id_col, subject, share): every subject of every document. areas: at most `max_areas` (checked)."""
    names = [r[0] for r in bounded_rows(areas.select(area), max_areas, "the table of subject areas") if r[0]]
    model = fit(labelled_sample(documents, id_col, text, source, labels, label_id, label, names, max_labelled)) if names else SubjectModel({}, {}, 0.0)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, phrase = shared.value, {}
        for b in batches:
            rows = []
            for d, t, o in zip(b["d"], b["t"], b["o"]):
                if isinstance(t, str):
                    if o not in phrase:
                        if len(phrase) > 50_000:
                            phrase.clear()
                        phrase[o] = source_phrase(o if isinstance(o, str) else None)
                    shares = m.shares(t, phrase[o])
                    rows += [(d, s, shares[s]) for s in m.chosen(shares)]
            yield pd.DataFrame(rows, columns=["d", "s", "x"])

    own = f"`{source}`" if source else "CAST(NULL AS STRING)"
    out = documents.selectExpr(f"`{id_col}` AS d", f"`{text}` AS t", f"{own} AS o").mapInPandas(assign, "d long, s string, x double")
    return out.selectExpr(f"d AS `{id_col}`", "s AS subject", "x AS share")
