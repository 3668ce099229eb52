import random

from loomgraph.llm.leakage import Scanner, align, item_words, leaks, longest_stretch, prepared_items
from loomgraph.llm.text import sentences, words_with_offsets

WORDS = [f"word{i}" for i in range(60)]
PASSAGE = " ".join(WORDS)


def scanner():
    shared = "Read the text below and answer the question with one short sentence only please. "
    items = [(1, shared + PASSAGE), (2, shared + " ".join(f"term{i}" for i in range(40))), (3, shared + " ".join(f"item{i}" for i in range(40))), (4, None), (5, "")]
    return Scanner(item_words(items), 4, 20, 1 / 6)


def test_offsets():
    text = "CafÃ© <b>näive</b> &amp; don’t Été 12"
    words, starts, ends = words_with_offsets(text)
    assert words == ["cafe", "naive", "don", "t", "ete", "12"]
    assert [text[a:b] for a, b in zip(starts, ends)] == ["CafÃ©", "näive", "don", "t", "Été", "12"]


def test_stretches():
    s = scanner()
    found = lambda text: {i: n for i, n, *_ in s.scan(text)}
    assert found("intro " + PASSAGE.upper() + " outro") == {1: 60}
    assert found("x " + " ".join(WORDS[10:30]) + " y") == {1: 20}
    assert found("x " + " ".join(WORDS[10:26]) + " y") == {}
    mixed = WORDS[5:35]
    for i in (4, 12, 20, 27):
        mixed[i] = "other"
    assert 1 in found(" ".join(mixed))
    extra = [w for i, w in enumerate(WORDS[:36]) for w in ([w, "perhaps"] if i % 9 == 8 else [w])]
    assert 1 in found("**" + "** <i>".join(extra))
    broken = [w if i % 4 else "other" for i, w in enumerate(WORDS)]
    assert found(" ".join(broken)) == {}
    assert found("Read the text below and answer the question with one short sentence only please. " * 3) == {}
    for nothing in (None, "", "  ", "...", "word0 word1"):
        assert found(nothing) == {}


def test_long_text_and_place():
    s = scanner()
    filler = "lorem ipsum " * 40_000
    text = filler + PASSAGE + " " + filler
    ((item, n, a, b, _),) = s.scan(text)
    assert (item, n, text[a:b]) == (1, 60, PASSAGE)


def test_alignment_against_errors():
    rnd = random.Random(4)
    for _ in range(100):
        words, errors = [], 0
        for w in WORDS:
            r = rnd.random()
            if r < 0.04:
                errors += 1
            elif r < 0.08:
                words.append("swap")
                errors += 1
            elif r < 0.1:
                words += [w, "more"]
                errors += 1
            else:
                words.append(w)
        matched = align(WORDS, words, -errors, errors, 4)
        assert len(matched) >= len(WORDS) - errors
        assert longest_stretch(WORDS, matched, 20, 1 / 6)


def test_rows(spark):
    docs = spark.createDataFrame([(1, f"a {PASSAGE} b", 1), (2, None, 1), (3, "", 1), (4, "no words of it", 1)], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(9, PASSAGE)], "item_id long, passage string")
    assert [tuple(r)[:3] for r in leaks(docs, "doc_id", "text", items, "item_id", "passage").collect()] == [(1, 9, 60)]
    assert leaks(docs, "doc_id", "text", items.limit(0), "item_id", "passage").count() == 0


def test_sentences():
    assert sentences("One. Two!\nThree\nstill three? ¿Cuatro?") == ["One.", "Two!", "Three\nstill three?", "¿Cuatro?"]


def test_only_openings_are_instructions(spark):
    """A sentence that items share counts for nothing where it opens a passage, but elsewhere it is a passage like any other; any number of items is prepared alike."""
    say, own = "Read the text below and answer it please.", lambda i: " ".join(f"own{i}x{k}" for k in range(8)) + "."
    deep = "The harbour of the old town was closed for three winters in a row."
    rows = [(i, f"{say} {own(i)} {deep}", None) for i in range(4)] + [(9, None, None), (10, "", "x")]
    words = item_words([r[:2] for r in rows])
    assert words[0][:8] == [None] * 8 and words[0][-3:] == ["in", "a", "row"] and None not in words[0][8:]
    df = spark.createDataFrame(rows, "item_id long, passage string, answer string")
    got = {r.i: list(r.words) for r in prepared_items(df, "item_id", "passage", "answer").collect()}
    assert {i: w for i, w in got.items() if w} == words


def test_answers_and_shards(spark):
    docs = spark.createDataFrame([(1, f"a {PASSAGE} b. It is Foo Bar."), (2, f"a {PASSAGE} foo b bar"), (3, "Foo Bar alone")], "doc_id long, text string")
    items = spark.createDataFrame([(9, PASSAGE, "FOO bar"), (8, " ".join(WORDS[:30]), None), (7, "x y", "foo")], "item_id long, passage string, answer string")
    want = {(1, 9, True), (2, 9, False), (1, 8, None), (2, 8, None)}
    for most in (100, 1):
        assert {(r.doc_id, r.item_id, r.with_answer) for r in leaks(docs, "doc_id", "text", items, "item_id", "passage", "answer", max_items=most).collect()} == want
