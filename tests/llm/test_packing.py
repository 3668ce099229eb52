import itertools
import random

import pytest

from loomgraph.llm.packing import best_bounds, bucket_bounds, pack, patterns, plan_contexts, token_counter, unused_room


def test_bounds_leave_least_room():
    """Against all ways to cut the sizes into exactly so many buckets."""
    rnd = random.Random(6)
    for _ in range(40):
        sizes = sorted(rnd.sample(range(1, 60), rnd.randint(1, 8)))
        counts = [rnd.randint(1, 30) for _ in sizes]
        for k in (1, 2, 3, 5):
            n = min(k, len(sizes))
            cost = lambda ends: sum(unused_room(sizes[a + 1 : b + 1], counts[a + 1 : b + 1], 64) for a, b in zip((-1, *ends[:-1]), ends))  # noqa: B023, E731
            got = best_bounds(sizes, counts, 64, k)
            assert len(got) == n and got[-1] == len(sizes) - 1
            assert cost(tuple(got)) == min(cost((*c, len(sizes) - 1)) for c in itertools.combinations(range(len(sizes) - 1), n - 1))


def test_bounds_beat_even_ones():
    rnd = random.Random(2)
    sizes = list(range(1, 257))
    counts = [max(1, int(4000 / s * rnd.random())) for s in sizes]
    used = lambda bounds: sum(c * s for s, c in zip(sizes, counts)) / 256 / (1 + max(r[1] + 0 for rows in plan_contexts(sizes, counts, bounds, 256).values() for r in rows))
    assert used(bucket_bounds(sizes, counts, 256, 4)) > used([64, 128, 192, 256])


def test_patterns_use_all_items():
    sizes, counts = [3, 10, 40, 64], [1000, 77, 31, 5]
    plan = patterns(sizes, counts, 64)
    assert all(sum(sizes[b] * k for b, k in use.items()) <= 64 for _, use in plan)
    assert [sum(t * use.get(b, 0) for t, use in plan) for b in range(4)] == counts


def test_tokenizers_agree():
    texts = ["A day at the sea, it's 2024!", "  two  blanks\n\nand lines \t ", "été à la plage — 东京 😀", "x" * 300, "<|endoftext|> it'd", " "]
    assert token_counter("/opt/tokenizers/byte_bpe_50k.tiktoken")(texts) == token_counter("/opt/tokenizers/byte_bpe_50k.json")(texts)


@pytest.mark.parametrize("part_items", [200_000, 7])
def test_round_trip(spark, part_items):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rnd.choice([3, 9, 40, 41, 300]))) for _ in range(300)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(900, None, 1), (901, "", 1), (902, texts[0], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    out = pack(df, "doc_id", "text", 64, buckets=3, part_items=part_items).collect()
    room, seen, slots, bucket = {}, {}, set(), {}
    for r in out:
        room[r.context_id] = room.get(r.context_id, 0) + r.n_tokens
        seen.setdefault(r.doc_id, []).append((r.token_from, r.token_to))
        assert (r.context_id, r.slot) not in slots
        assert bucket.setdefault(r.context_id, r.bucket) == r.bucket  # a context never mixes buckets
        slots.add((r.context_id, r.slot))
    assert max(room.values()) <= 64 and set(seen) == set(range(300)) | {902}
    for spans in seen.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and all(b - a == 64 for a, b in spans[:-1])
    free = []  # first fit decreasing on the true lengths
    for n in sorted((b - a for spans in seen.values() for a, b in spans), reverse=True):
        i = next((i for i, f in enumerate(free) if f >= n), None)
        if i is None:
            free.append(64 - n)
        else:
            free[i] -= n
    assert len(room) <= 1.05 * len(free) + 3 and len(set(bucket.values())) == 3
    assert sorted(room) == list(range(len(room)))


def test_coarse_lengths(spark):
    """Where the capacity exceeds the number of lengths, contexts still hold."""
    df = spark.createDataFrame([(i, "alpha " * (i % 97 + 1)) for i in range(400)], "doc_id long, text string")
    out = pack(df, "doc_id", "text", 200, buckets=2, classes=16).collect()
    room = {}
    for r in out:
        room[r.context_id] = room.get(r.context_id, 0) + r.n_tokens
    assert max(room.values()) <= 200 and {r.doc_id for r in out} == set(range(400)) and sorted(room) == list(range(len(room)))


def test_empty_and_errors(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pack(df, "doc_id", "text", 64).count() == 0
    with pytest.raises(ValueError):
        pack(df, "doc_id", "text", None)
