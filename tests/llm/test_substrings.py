import hashlib
import random

import pytest

from leafloom.llm import substrings


def brute(rows, long=50):
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - long + 1):
            first.setdefault(tuple(words[i][j : j + long]), i)
    out = {}
    for i, w in words.items():
        gone = {j + k for j in range(len(w) - long + 1) if first[tuple(w[j : j + long])] < i for k in range(long)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_removals_are_those_of_brute_force(docs, seed):
    r = random.Random(seed)
    fresh = lambda n: [r.choice("abcdefghijklm") + str(r.randrange(90)) for _ in range(n)]
    shared = [fresh(r.randint(45, 140)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(0, 4)):
            s = r.choice(shared)
            a = r.randrange(len(s))
            parts += fresh(r.randint(0, 30)) + s[r.choice([0, a]) :]
        if r.random() < 0.3 and rows:
            parts = (r.choice(rows)[1] or "").split()[r.randrange(3) :] + parts
        rows.append((i, " ".join(parts)))
    rows += [(60, None), (61, ""), (62, "x " * 400), (63, "x " * 400), (64, "x " * 49)]
    r.shuffle(rows)
    d = docs(rows).repartition(3)
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substrings.remove(d, substrings.repeats(d)).collect()}
    assert got == brute(rows)


def test_other_columns_and_edges(docs):
    assert substrings.repeats(docs([(0, "a")]).limit(0)).count() == 0
    text = " ".join(f"w{i}" for i in range(80))
    from pyspark.sql import functions as F

    d = docs([(3, text), (3, text), (None, text), (5, text)]).withColumn("key", F.lit("mine")).withColumn("kept", F.lit(1))
    got = substrings.remove(d, substrings.repeats(d)).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [r.n_removed for r in got] == [0, 0, 0, 80] and {r.key for r in got} == {"mine"} and got[3].kept == ""
