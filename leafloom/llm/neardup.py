"""Near-duplicate detection with ProbMinHash.

A document's weighted shingles (runs of SHINGLE words with their counts; a shorter text is one shingle) each are a Poisson process
with their weight as rate. Each arrival falls on a random one of PLACES places, and a place keeps the shingle that arrives
first; a document stops early, once no later arrival can be first anywhere. Two documents' places agree with the probability Jaccard
similarity of their shingles, which is the plain one where all counts are alike. A document whose counts differ is signed again with all
weights 1, so that each has places that agree with the plain similarity. Places are banded by ROWS; documents that share a band
are candidates, and candidates are verified by the exact Jaccard similarity of their sets of shingles, LIKE or more.

* Equal word sequences are one text from the start, so a group of copies costs one, whatever its size.
* All texts of a band's bucket are compared, but for those that are in one class already and those that are proven unlike. First, texts are paired
  with their bucket's first only, also in the buckets of two bands at once, which are finer. Of the buckets that then still hold several classes,
  shingles are counted. A pair that is alike shares a shingle of the rarest 1 - LIKE of both (prefix filter); where that one is rare (in at most
  RARE of these texts) the pair is found by a join on rare shingles. Otherwise both texts are mostly of frequent shingles, and share no rare one, so
  they are alike only if their frequent ones can overlap enough, which counts by GROUPS of the hash bound. Such texts meet their bucket's
  most common one, then, over those still in other classes, all that the bound allows.
  So near copies cost one pair or a few each, and texts that share a frequent passage but aren't alike cost none. What stays quadratic is a family of
  texts that are just under the threshold to each other, all of them.
* Classes are the connected components of verified pairs, found in rounds that at least halve what is left, with pointer jumping in each.
* Buckets are never collected: first members are minima that combine before the shuffle, and joins can be split by the planner.
* Weights find candidates; the sets alone decide, so that a line's repetitions neither make nor break a class.

A document is a row. Keys may be of any type that has an order, null, or repeated: rows meet by their words, and classes are named after keys only at
the end. A class's id is its least key that isn't null (null if there is none). Texts without words (nulls too) are in no class but their
own. Words are `[^\\x20\\x09-\\x0D]+`, unchanged; whole texts are read. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.llm.tables import documents, small, written
from leafloom.llm.text import Block, U, blocks, longs, mix, pack, run_hashes, seeded, span_hashes, unpack, word_hashes, words

SHINGLE, LIKE = 5, 0.8
#: 80 places in bands of four: a pair at 0.8 shares no band with probability 0.00003.
PLACES, ROWS = 80, 4
#: The most keys that are broadcast; beyond, texts are shuffled to them.
MANY = 500_000
#: A shingle of at most so many texts is rare; groups of frequent shingles whose counts bound an overlap.
RARE, GROUPS = 20, 16
_NEXT, _SPOT = seeded(5, 2)


def shingles(b: Block, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct shingles in order, their counts, their texts, and two hashes of each text's words."""
    w = words(b)
    h = word_hashes(b.data, w)
    runs, at = run_hashes(h, w.first, size)
    n = w.counts()
    short = np.flatnonzero((n > 0) & (n < size))
    lone = span_hashes(h, w.first[short], w.first[short + 1])
    doc = np.concatenate((w.doc[at] if len(at) else np.zeros(0, np.int64), short))
    runs = np.concatenate((runs, lone))
    order = np.lexsort((runs, doc))
    runs, doc = runs[order], doc[order]
    begins = np.flatnonzero(np.concatenate(([True], (runs[1:] != runs[:-1]) | (doc[1:] != doc[:-1])))) if len(runs) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate((begins, [len(runs)])))
    whole = np.stack([span_hashes(word_hashes(b.data, w, lane), w.first[:-1], w.first[1:], lane) for lane in (0, 1)])
    return runs[begins], counts, doc[begins], whole


def prob_min_hash(shingle: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int, places: int = PLACES) -> np.ndarray:
    """The first shingle at each place of each document; documents without shingles have zeros."""
    first, kept = np.full(docs * places, np.inf), np.zeros(docs * places, U)
    live, clock, step = np.arange(len(shingle)), np.zeros(len(shingle)), 0
    while len(live):
        many = 1 if step < 2 else 8 if step < 26 else 64  # arrivals drawn at once; more than needed do no harm
        with np.errstate(over="ignore"):
            r = mix(shingle[live, None] + (np.arange(step + 1, step + many + 1, dtype=U) * _NEXT)[None, :])
            spot = (mix(r ^ _SPOT) % U(places)).astype(np.int64)
        wait = -np.log(((r >> U(11)).astype(np.float64) + 1) * 2.0**-53) / weight[live, None]
        when = clock[live, None] + np.cumsum(wait, axis=1)
        clock[live] = when[:, -1]
        slot, when = (doc[live, None] * places + spot).ravel(), when.ravel()
        np.minimum.at(first, slot, when)
        best = when == first[slot]
        kept[slot[best]] = np.repeat(shingle[live], many)[best]
        step += many
        live = live[clock[live] < first.reshape(docs, places).max(axis=1)[doc[live]]]  # early termination
    return kept.reshape(docs, places)


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each band, then of each two bands in a row."""
    n, places = signature.shape
    h = np.zeros((n, places // rows), U)
    with np.errstate(over="ignore"):
        for r in range(rows):
            h = mix(h * U(0x9E3779B97F4A7C15) + signature[:, r::rows][:, : places // rows])
        h = mix(h + seeded(9, places // rows))
        return np.hstack((h, mix(h * U(3) + np.roll(h, -1, axis=1))))


def signed_bands(shingle: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bands and their documents, in order: of the weighted shingles, and of the same with weights 1 where a document's weights
    differ (elsewhere both are the same)."""
    got = bands(prob_min_hash(shingle, weight, doc, docs))
    most, least = np.zeros(docs, np.int64), np.full(docs, np.iinfo(np.int64).max)
    np.maximum.at(most, doc, weight)
    np.minimum.at(least, doc, weight)
    uneven = most > least
    again, sub = np.flatnonzero(uneven), np.cumsum(uneven) - 1
    own = uneven[doc]
    plain = bands(prob_min_hash(shingle[own], np.ones(int(own.sum())), sub[doc[own]], len(again)))
    of = np.concatenate((np.arange(docs), again))
    order = np.argsort(of, kind="stable")
    return np.vstack((got, plain))[order], of[order]


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """For each row its key, a number of its own (stable once written), two hashes of its words, its number of distinct shingles, and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for b in blocks(batch.column(1)):
                s, weight, doc, whole = shingles(b, size)
                n = np.bincount(doc, minlength=len(b))
                got, of = signed_bands(s, weight, doc, len(b))
                ends = np.searchsorted(of, np.arange(len(b) + 1)).astype(np.int32) * got.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(ends), longs(got.ravel()))
                rows = pa.array(np.arange(row, row + len(b)))
                row += len(b)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, len(b)), rows, longs(whole[0]), longs(whole[1]), pa.array(n), lists], ["key", "row", "w1", "w2", "shingles", "bands"])

    return docs.mapInArrow(run, f"key {dict(docs.dtypes)['key']}, row long, w1 long, w2 long, shingles long, bands array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """Two hashes of each text's words, and its shingles' hashes (40 bits of them, sorted and packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(0)):
                s, _, doc, whole = shingles(b, size)
                cuts = np.searchsorted(doc, np.arange(len(b) + 1))
                packed = [pack(np.diff(np.unique(s[x:y] >> U(24)), prepend=U(0))) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([longs(whole[0]), longs(whole[1]), pa.array(packed, pa.binary())], ["w1", "w2", "set"])

    return docs.select("text").mapInArrow(run, "w1 long, w2 long, set binary")


def _members(sets: DataFrame) -> DataFrame:
    """A row for each shingle of each set, with the set's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.cumsum(unpack(packed.as_py(), U), dtype=U).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), node)), pa.array(x), pa.array(np.full(len(x), len(x)))], ["node", "shingle", "n"])

    return sets.select("node", "set").mapInArrow(run, "node long, shingle long, n long")


def _verified(pairs: DataFrame, sets: DataFrame, like: float) -> DataFrame:
    """The pairs a, b whose sets are alike."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("right")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("left")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, x, keep = None, np.zeros(0, U), []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                left = left.as_py()
                if left != last:
                    last, x = left, np.cumsum(unpack(left, U), dtype=U)
                y = np.cumsum(unpack(right.as_py(), U), dtype=U)
                common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()) if len(x) else 0
                keep.append(common >= like * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and root, one of its component's nodes, for the nodes of edges a, b.

    In each round a node points to the first of itself and its neighbours, pointers are followed to their ends by doubling, and edges are
    contracted. The order is that of the nodes at first and a random one from then on, in which a node is no end at least every other time: so rounds
    grow with the logarithm of the nodes, whatever the shape.
    """
    edges = written(edges.where("a <> b").distinct(), "edges")
    roots, turn = None, 0
    while True:
        order = (lambda c: F.struct(c)) if turn == 0 else (lambda c, t=turn: F.struct(F.xxhash64(c, F.lit(t)), c))
        ways = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        near = ways.groupBy("node").agg(F.min_by("to", order(F.col("to"))).alias("to"))
        ups = written(near.select("node", F.when(order(F.col("to")) < order(F.col("node")), F.col("to")).otherwise(F.col("node")).alias("up")), "ups")
        while True:  # four steps at once
            step = ups.select(F.col("node").alias("up"), F.col("up").alias("end"))
            twice = ups.join(step, "up").select("node", F.col("end").alias("up"))
            ends = twice.select(F.col("node").alias("up"), F.col("up").alias("end"))
            far = written(twice.join(ends, "up").select("node", F.col("end").alias("up"), (F.col("end") != F.col("up")).alias("moved")), "ups")
            ups = far.drop("moved")
            if far.where("moved").isEmpty():
                break
        roots = ups.withColumnRenamed("up", "root") if roots is None else written(roots.join(ups.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        up = lambda c: ups.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))
        edges = written(edges.join(up("a"), "a").join(up("b"), "b").where("a_up <> b_up").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return roots
        turn += 1


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots once links between nodes, old and new, are added: only roots are connected anew."""
    of = lambda c: F.coalesce(f"{c}_root", c)
    named = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    edges = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(of("a").alias("a"), of("b").alias("b"))
    new = components(edges)
    old = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return written(old.unionByName(new.join(roots.select("node"), "node", "left_anti")), "roots")


def _least(n: Column, like: float) -> Column:
    """The fewest shingles that a set of n shares with a set that is alike."""
    return F.ceil(n * like - 1e-9)


def _rest(members: DataFrame, tested: DataFrame, sets: DataFrame, roots: DataFrame, like: float, rare: int = RARE) -> DataFrame:
    """The roots once all pairs of one bucket (members: bucket, node) have been compared or proven unlike, but for those of one component."""

    def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def mixed(rows: DataFrame) -> DataFrame:
        several = rows.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("bucket")
        return written(rows.join(several, "bucket", "left_semi"), "members")

    def new(pairs: DataFrame, name: str) -> DataFrame:
        pairs = pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
        return written(pairs.join(tested, ["a", "b"], "left_anti"), name)

    members = mixed(rooted(members, roots))
    texts = written(members.select("node", "root").distinct(), "texts")
    if texts.isEmpty():
        return roots
    every = written(_members(sets.join(texts, "node", "left_semi")), "shingles")
    counts = written(every.groupBy("shingle").agg(F.count("*").alias("of")).where("of > 1"), "counts")
    shared = written(every.join(counts, "shingle"), "shared")
    frequent, n = F.col("of") > rare, F.col("n")
    groups = [F.count_if(frequent & (F.pmod("shingle", F.lit(GROUPS)) == i)).alias(f"g{i}") for i in range(GROUPS)]
    facts = written(shared.groupBy("node").agg(F.max("n").alias("n"), F.count("*").alias("held"), F.count_if(frequent).alias("frequent"), *groups).where(F.col("held") >= _least(n, like)), "facts")
    # pairs that share a rare shingle: of the prefix n - least + 1, the shingles of one text only are n - held
    place = F.row_number().over(Window.partitionBy("node").orderBy("of", "shingle"))
    prefix = shared.where(~frequent).withColumn("place", place).join(facts.select("node", "held"), "node").where(F.col("place") <= F.col("held") - _least(n, like) + 1)
    prefix = written(prefix.join(texts, "node").select("shingle", "node", "root", "n"), "prefixes")
    side = lambda k, c: prefix.select("shingle", F.col("node").alias(k), F.col("root").alias(c), F.col("n").alias(f"{k}_n"))
    met = side("p", "x").join(side("q", "y"), "shingle").where((F.col("p") < F.col("q")) & (F.col("x") != F.col("y")) & (F.least("p_n", "q_n") >= like * F.greatest("p_n", "q_n") - 1e-9))
    pairs = new(met, "pairs")
    links = written(_verified(pairs, sets, like), "links")
    # texts mostly of frequent shingles: with their bucket's most common one, then with each other
    mostly = facts.where(F.col("frequent") >= _least(n, like)).select("node", "n", "frequent", *[f"g{i}" for i in range(GROUPS)])
    members = mixed(members.join(mostly, "node"))
    fact = lambda k: F.struct("node", "n", *[f"g{i}" for i in range(GROUPS)]).alias(k)
    overlap = sum((F.least(f"l.g{i}", f"r.g{i}") for i in range(GROUPS)), F.lit(0))
    can = overlap * (1 + like) >= like * (F.col("l.n") + F.col("r.n")) - 1e-6
    centres = members.groupBy("bucket").agg(F.max_by(F.struct(fact("l"), "root"), F.struct(F.col("frequent") / n, -F.col("node"))).alias("c"))
    met = members.select("bucket", F.col("root").alias("y"), fact("r")).join(centres.select("bucket", F.col("c.root").alias("x"), F.col("c.l").alias("l")), "bucket")
    pairs = new(met.where((F.col("x") != F.col("y")) & can).select(F.col("l.node").alias("p"), F.col("r.node").alias("q")), "pairs")
    links = written(links.unionByName(_verified(pairs, sets, like)), "links")
    if not links.isEmpty():
        roots = merged(roots, links)
    members = mixed(rooted(members.drop("root"), roots))
    left, right = (members.select("bucket", F.col("root").alias(c), fact(k)) for k, c in (("l", "x"), ("r", "y")))
    pairs = new(left.join(right, "bucket").where((F.col("x") < F.col("y")) & can).select(F.col("l.node").alias("p"), F.col("r.node").alias("q")), "pairs")
    links = written(_verified(pairs, sets, like), "links")
    return roots if links.isEmpty() else merged(roots, links)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, like: float = LIKE) -> DataFrame:
    """key, class_id (the class's least key), copy_of (the least key with the same words), shingles: a row for each row of docs."""
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    signed = written(_signatures(docs, size), "signatures")
    same = written(signed.where("shingles > 0").groupBy("w1", "w2").agg(F.min("row").alias("node"), F.min("key").alias("copy_of")), "same")
    firsts = signed.where("shingles > 0").withColumnRenamed("row", "node").join(same.select("node"), "node", "left_semi")
    buckets = firsts.select("node", F.explode("bands").alias("bucket"))
    centres = buckets.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("bucket", "a")
    pairs = written(buckets.join(centres, "bucket").where("node > a").select("a", F.col("node").alias("b")).distinct(), "pairs")
    nodes = written(same.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi"), "nodes")
    keys = small(nodes.select(F.col("copy_of").alias("_key")).distinct(), MANY)
    wanted = docs.join(keys, F.col("key").eqNullSafe(F.col("_key")), "left_semi")
    sets = written(_sets(wanted, size).join(small(nodes.select("w1", "w2", "node"), MANY), ["w1", "w2"]).select("node", "set").dropDuplicates(["node"]), "sets")
    roots = components(_verified(pairs, sets, like))
    single = firsts.select("node", F.posexplode("bands").alias("band", "bucket")).where(F.col("band") % (2 * (PLACES // ROWS)) < PLACES // ROWS)
    shared = single.join(single.groupBy("bucket").agg(F.count("*").alias("of")).where("of > 1").select("bucket"), "bucket", "left_semi")
    roots = _rest(shared.select("bucket", "node"), pairs, sets, roots, like)
    linked = roots.join(same.select("node", "copy_of"), "node")
    named = linked.join(linked.groupBy("root").agg(F.min("copy_of").alias("class_id")), "root").select("node", "class_id")
    texts = same.join(named, "node", "left").select("w1", "w2", "copy_of", F.coalesce("class_id", "copy_of").alias("class_id"))
    rows = signed.select("key", "w1", "w2", "shingles").join(texts, ["w1", "w2"], "left")
    some = F.col("shingles") > 0
    return rows.select(F.col("key").alias(key), F.when(some, F.col("class_id")).otherwise(F.col("key")).alias("class_id"), F.when(some, F.col("copy_of")).otherwise(F.col("key")).alias("copy_of"), "shingles")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the near-duplicate class of every document."""
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


#: By all pairs of texts that share a shingle: for small tables.
SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
k AS (SELECT doc_id, w, array_to_string(w, ' ') t FROM w),
u AS (SELECT t, min(doc_id) id, any_value(w) w FROM k WHERE len(w) > 0 GROUP BY t),
s AS (SELECT DISTINCT id, CASE WHEN len(w) < {SHINGLE} THEN t ELSE array_to_string(w[i + 1:i + {SHINGLE}], ' ') END g FROM (SELECT id, t, w, unnest(range(0, greatest(len(w) - {SHINGLE - 1}, 1))) i FROM u)),
n AS (SELECT id, count(*) n FROM s GROUP BY id),
o AS (SELECT a.id a, b.id b, count(*) both_ FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE both_ >= {LIKE}::DOUBLE * (x.n + y.n - both_)),
p AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT id, id root FROM u UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.id),
c AS (SELECT id, min(root) class_id FROM r GROUP BY id)
SELECT k.doc_id, coalesce(c.class_id, k.doc_id) class_id, coalesce(u.id, k.doc_id) copy_of, coalesce(n.n, 0) shingles
FROM k LEFT JOIN u ON len(k.w) > 0 AND u.t = k.t LEFT JOIN c ON c.id = u.id LEFT JOIN n ON n.id = u.id
"""
