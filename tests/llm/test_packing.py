import random
import zlib

import numpy as np
import pytest

from leafloom.llm import packing


def _check(pieces, capacity):
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in by.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_every_piece_once(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 100])
    counts = {n: r.randint(1, 30) for n in r.sample(range(1, capacity + 1), r.randint(1, capacity))}
    bins = {}
    for length, rank, first, each, at in packing.plan(counts, capacity).tolist():
        rows = packing.plan(counts, capacity)
        mine = rows[rows[:, 0] == length]
        nxt = [x for x in mine[:, 1].tolist() if x > rank]
        for i in range((min(nxt) if nxt else counts[length]) - rank):
            bins.setdefault(first + i // each, []).append((at + i % each * length, length))
    assert sum(map(len, bins.values())) == sum(counts.values())
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= capacity
        assert sum(3 * n > capacity for _, n in b) <= 2
    total = sum(n * c for n, c in counts.items())
    assert len(bins) <= 1.25 * max(-(-total // capacity), sum(c for n, c in counts.items() if 2 * n > capacity)) + 1


def test_matching_pairs_the_longest_that_fits():
    assert len({r[2] for r in packing.plan({6: 1, 4: 1, 5: 2}, 10).tolist()}) == 2


def test_pieces_are_the_tokenisers(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["Hello, WORLD! it's 12'RE", "", None, "a<|endoftext|>b <|x", "½ cup² ŒUVRE ß naïve", "日本語 テ é́ İ", "a\x1fb a\x85b c", "word " * 5000, "x'll don't !'s 's"]
    rows = list(enumerate(texts))
    got = packing.packed(docs(rows)).collect()
    _check(got, packing.CAPACITY)
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in mine] == [(a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096])) for a in range(0, len(ids), 4096)]


def test_repeated_rows_and_no_rows(docs):
    got = packing.packed(docs([(1, "a b c")] * 50 + [(None, "a")])).collect()
    assert len(got) == 51 and _check(got, packing.CAPACITY) == 1
    assert packing.packed(docs([(1, "a")]).limit(0)).count() == 0
