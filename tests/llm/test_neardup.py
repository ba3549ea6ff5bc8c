import random

import numpy as np
import pyarrow as pa

from leafloom.llm import neardup
from leafloom.llm.text import blocks


def _sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().split()
        out[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    return out


def _classes(rows):
    sets = _sets(rows)
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in sets}


def test_classes_are_those_of_brute_force(docs):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(r.randint(40, 160))]
        for _ in range(r.randint(1, 5)):
            copy = list(base)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, "one two"), (len(rows) + 3, "one  two"), (len(rows) + 4, "one three")]
    got = {x.doc_id: x.class_id for x in neardup.near_duplicates(docs(rows)).collect()}
    assert got == _classes(rows)


def test_pairs_behind_less_alike_copies_are_found(docs):
    """Graded copies of one base, the most edited ones first: the last ones are like each other only."""
    r = random.Random(8)
    rows = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(500)]
        for edits in [14] * 48 + [9] * 6 + [4] * 4:
            copy = list(base)
            for at in r.sample(range(0, 500, 5), edits):
                copy[at] = f"x{r.random()}"
            rows.append((len(rows), " ".join(copy)))
    got = {x.doc_id: x.class_id for x in neardup.near_duplicates(docs(rows)).collect()}
    want = _classes(rows)
    assert got == want and len(set(want.values())) > 100


def test_pairs_that_differ_in_repeats_are_found(docs):
    rows = []
    for pair in range(12):
        words = [f"p{pair}w{i}" for i in range(300)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words, *words[40:70] * 40]))]
    got = {x.doc_id: x.class_id for x in neardup.near_duplicates(docs(rows)).collect()}
    assert got == _classes(rows) and all(got[i] == i - i % 2 for i in got)


def test_large_groups_of_copies_are_one_class(docs):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text) for i in range(300)] + [(300, text + " more"), (301, "other words stand here alone")]
    got = {x.doc_id: (x.class_id, x.copy_of) for x in neardup.near_duplicates(docs(rows)).collect()}
    assert {got[i] for i in range(300)} == {(0, 0)} and got[300] == (0, 300) and got[301] == (301, 301)


def test_places_estimate_probability_jaccard():
    a, b = {f"x{i}": 1 + i % 3 for i in range(40)}, {f"x{i}": 1 + i % 3 for i in range(10, 50)}
    true = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())
    ids = {k: np.uint64(hash(("s", k)) & 0xFFFFFFFFFFFFFFFF) for k in a | b}
    s = np.array([ids[k] for k in a] + [ids[k] for k in b], np.uint64)
    got = neardup.prob_min_hash(s, np.array([*a.values(), *b.values()]), np.repeat([0, 1], [len(a), len(b)]), 2, 4000)
    assert abs((got[0] == got[1]).mean() - true) < 0.04


def test_empty_and_nulls(docs, spark):
    assert neardup.near_duplicates(docs([(0, "a")]).limit(0)).count() == 0
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (2, None), (None, "g h i j k l"), (None, "g h i j k l"), (None, ""), (3, " \n ")]
    got = sorted(neardup.near_duplicates(docs(rows)).collect(), key=str)
    assert sorted((x.doc_id, x.class_id) for x in got if x.doc_id is not None) == [(2, 2), (3, 3), (5, 5)]
    assert sorted(str(x.class_id) for x in got if x.doc_id is None) == ["5", "None", "None", "None"]


def test_repeated_and_textual_keys_and_other_columns(spark):
    words = [f"w{i}" for i in range(80)]
    near = " ".join([*words[:40], "else", *words[41:]])
    rows = [("a", " ".join(words), 1), ("a", "quite another text stands in this row", 2), ("b", near, 3), ("b", near, 3)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "id string, body string, shingles int"), "id", "body").collect()
    assert sorted((x.id, x.class_id, x.copy_of) for x in got) == [("a", "a", "a"), ("a", "a", "a"), ("b", "a", "b"), ("b", "a", "b")]


def test_texts_with_a_frequent_passage_are_not_paired(docs, monkeypatch):
    """Texts half of which is one passage share buckets, but no pairs of them are compared beyond their buckets' first."""
    compared, verified = [], neardup._verified

    def counting(pairs, sets, like):
        compared.append(pairs.count())
        return verified(pairs, sets, like)

    monkeypatch.setattr(neardup, "_verified", counting)
    common = [f"c{i}" for i in range(70)]
    rows = [(i, " ".join([*(f"a{i}x{j}" for j in range(25)), *common, *(f"b{i}x{j}" for j in range(25))])) for i in range(150)]
    got = {x.doc_id: x.class_id for x in neardup.near_duplicates(docs(rows)).collect()}
    assert got == {i: i for i in got} and sum(compared[1:]) == 0 and compared[0] < 40 * 150


def test_recall_beside_brute_force(spark):
    """All links of the smallest documents table, by brute force over pairs that share a shingle."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {x.doc_id: x.class_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = _classes(rows)
    assert {i: c for i, c in got.items() if i in want} == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in neardup.components(edges).collect()}
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in (100, 101, 102)} == {100}


def test_components_take_few_rounds(spark, monkeypatch):
    """A chain of 1000 shuffled nodes, a star whose centre is its last node, and a tree."""
    names, keep = [], neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, name: names.append(name) or keep(df, name))
    order = list(range(1000))
    random.Random(1).shuffle(order)
    edges = [*zip(order, order[1:]), *((5000, i) for i in range(4000, 4400)), *((6000 + i, 6000 + (i - 1) // 2) for i in range(1, 255))]  # noqa: B905
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert [len({got[i] for i in part}) for part in (range(1000), [5000, *range(4000, 4400)], range(6000, 6255))] == [1, 1, 1] and len(set(got.values())) == 3
    assert names.count("edges") - 1 <= 12


def test_blocks_cover_all_rows():
    column = pa.array(["ab", None, "", "x" * 50, "é"])
    got = list(blocks(column, 10))
    assert [b.first for b in got] == [0, 3, 4] and got[-1].last == 5
    assert b"".join(b.text(i) for b in got for i in range(len(b))) == ("ab" + "x" * 50 + "é").encode()
