import random

from loomgraph.llm.subjects import assign_subjects, calibrated, fit, note_phrases

TOPICS = {"law": ["court", "statute", "jury", "verdict"], "food": ["oven", "barista", "menu", "recipe"], "sport": ["referee", "stadium", "relay", "medal"]}


def text(rnd, parts):
    out = []
    for s, n in parts:
        for _ in range(n):
            a, b = rnd.sample(TOPICS[s], 2)
            out.append(rnd.choice([f"The {a} in Oakmere changed after the {b} was seen.", f"Both the {a} and the {b} appear in entry {rnd.randint(1, 99)}."]))
    rnd.shuffle(out)
    return " ".join(out)


def corpus(n=240):
    rnd = random.Random(11)
    rows = []
    for i in range(n):
        a, b = rnd.sample(sorted(TOPICS), 2)
        parts = [(a, 6)] if i % 3 else [(a, 4), (b, 3)]
        rows.append((i, text(rnd, parts) + " Imported from crawl-rivers.", {s for s, _ in parts}))
    return rows


def test_held_out_accuracy():
    rows = corpus()
    model = fit([(t, s, "crawl-rivers") for i, t, s in rows if i < 120])
    good = sum(set(model.subjects(t)) == s for i, t, s in rows if i >= 120)
    assert good >= 0.95 * 120
    rnd = random.Random(1)
    assert model.subjects(text(rnd, [("law", 9), ("food", 1)])) == ["law"]
    for nothing in (None, "", "...", "12 34"):
        assert model.subjects(nothing) == []


def test_notes_of_other_sources():
    """The turn of words beside a source marks notes of sources that the sample does not hold; a source alone marks only its own documents."""
    rnd = random.Random(4)
    note = lambda s, w: f" Imported from {s}; the terms of the workspace {w} apply."
    rows = [(text(rnd, [(t, 5)]) + note("crawl-rivers", "oven"), {t}, "crawl-rivers") for t in sorted(TOPICS) for _ in range(30)]
    notes = note_phrases(rows)
    assert "terms of the workspace" in notes and not any("crawl" in n for n in notes)
    model = fit(rows)
    assert model.shares("The jury saw the court." + note("upload-farms", "recipe")) == {"law": 1.0}
    assert set(model.shares("The jury saw the court. A menu of crawl-zoo.", "crawl zoo")) == {"law"}


def test_thresholds_are_held_out():
    """Each subject has its own threshold, by documents that were not fitted on."""
    known = [({"law": 0.30, "food": 0.70}, {"food"})] * 40 + [({"law": 0.5, "food": 0.5}, {"law", "food"})] * 40 + [({"food": 0.2, "law": 0.8}, {"law", "food"})] * 40
    got = calibrated(known)
    assert got["law"] > 0.30 and got["food"] <= 0.20 and "sport" not in got
    assert calibrated(known[:10]) == {}


def test_rows(spark):
    rows = corpus(90)
    docs = spark.createDataFrame([(i, t, "crawl-rivers", "clash") for i, t, _ in rows] + [(900, None, None, "x"), (901, "", "a", "x")], "doc_id long, text string, source string, subject string")
    labels = spark.createDataFrame([(i, f" {s.upper()}" if i % 2 else s) for i, _, ss in rows for s in ss] + [(1, "nonsense"), (None, "law"), (2, None)], "doc_id long, subject string")
    areas = spark.createDataFrame([(s,) for s in TOPICS], "subject string")
    got = {}
    for r in assign_subjects(docs, "doc_id", "text", labels, "doc_id", "subject", areas, "subject", "source").collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert sum(got.get(i) == s for i, _, s in rows) >= 85 and 900 not in got and 901 not in got
    assert assign_subjects(docs, "doc_id", "text", labels.limit(0), "doc_id", "subject", areas, "subject").count() == 0
