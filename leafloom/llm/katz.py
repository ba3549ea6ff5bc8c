"""Language-model scores: a Katz backoff model of n-grams over whole texts.

Model. With c the counts over training tokens, N their number and d_r Good-Turing discounts of each order:

* P(w) = d_c(w) c(w) / N for known words; all unknown words share the mass that is left, as one more type.
* P(w | h) = d_c(hw) c(hw) / c(h) where the n-gram hw was seen, else alpha(h) P(w | h'), where h' is h without its first word and alpha(h) makes
  the sum over all w exactly 1: alpha(h) = (1 - sum of P(w | h) over seen w) / (1 - sum of P(w | h') over the same w). It is 1 for an h that wasn't
  seen. The rule is applied order by order, down to single words. Texts are preceded by beginnings that are words of histories only.

Discounts are Turing's (r + 1) n_{r+1} / (r n_r) for r up to 5 where that lies in (0, 1), and otherwise those of the log-linear fit
n_r ~ r**b, (1 + 1/r)**(b + 1), with b of -1.1 at most. So every count of an n-gram is discounted, and the unknown type keeps mass: numerator and
denominator of alpha are positive, and are only held above LEAST against rounding. Unigrams with more than 100 occurrences aren't discounted.

Execution. Tasks turn runs of documents into batches: sorted 64-bit hashes of their distinct words, and their tokens as places
in those. Counts are exchanged by batch, not by token: each batch asks the hash-partitioned count tables once for each of its
distinct n-grams, giving its own training counts, and gets the totals in the same order. So a word or pair in all documents is one number a batch, and no
task sees an unbounded group. A batch's keys are sorted by part once and cut, so its work doesn't grow with the number of parts; rows are parts that it
has keys of, at most its keys. alpha(h) is summed from n-grams each of which one batch owns, and joined to the unseen n-grams behind h.

Null texts are empty: they have one token, the end. Null keys train. Rows that are alike count each. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.tables import documents, written
from leafloom.llm.text import LOWER, U, blocks, mix, pack, seeded, unpack, word_hashes, words

END, BEGIN = seeded(77, 2)
#: Words of an n-gram. A third order exchanges as many keys again.
ORDER = 2
#: Tokens in a batch, keys in a part of a count table, and the largest count whose types are counted for discounts.
BATCH, PART, LEVELS = 500_000, 1_000_000, 100
TURING, LEAST = 5, 1e-12
#: Rows of an Arrow batch between tasks, which hold some KB each.
ROWS = 64
#: Kinds of rows that a batch gives.
DOC, WAIT, CONTEXT = range(3)


def discounts(types: np.ndarray) -> np.ndarray:
    """d_r for r from 0 to LEVELS, from the numbers of types seen r times; more frequent ones: see beyond()."""
    d = beyond(np.arange(1, LEVELS + 1), slope(types))
    for r in range(1, TURING + 1):
        if types[r] and types[r + 1] and 0 < (t := (r + 1) * types[r + 1] / (r * types[r])) < 1:
            d[r - 1] = t
    return np.concatenate(([1.0], d))


def slope(types: np.ndarray) -> float:
    """b of n_r ~ r**b, by least squares over averaged logarithms; held between -4 and -1.1."""
    r = np.flatnonzero(types[1 : LEVELS + 1]) + 1
    if len(r) < 2:
        return -2.0
    before, after = np.concatenate(([0], r[:-1])), np.concatenate((r[1:], [2 * r[-1] - r[-2]]))
    x, y = np.log(r), np.log(2.0 * types[r] / (after - before))
    x = x - x.mean()
    return float(np.clip((x * y).sum() / (x * x).sum(), -4.0, -1.1))


def beyond(r: np.ndarray, b: float) -> np.ndarray:
    return (1 + 1 / np.maximum(r, 1)) ** (b + 1)


def unigrams(types: np.ndarray, n: int) -> tuple[np.ndarray, float, float]:
    """d_r, the scale of known words' probabilities, and the unknown type's probability."""
    d = discounts(types)
    if not n:
        return d, 1.0, 1.0
    r = np.arange(LEVELS + 1)
    rest = float(((1 - d) * r * types[: LEVELS + 1]).sum() / n)
    return (d, 1.0, rest) if rest > 0 else (d, n / (n + 1), 1 / (n + 1))


def known(counts: np.ndarray, d: np.ndarray, scale: float, n: int) -> np.ndarray:
    """P of words by count; 0 for unknown ones."""
    return np.where(counts > 0, np.where(counts <= LEVELS, d[np.minimum(counts, LEVELS)], 1.0) * counts * scale / max(n, 1), 0.0)


def grams(h: np.ndarray, first: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the runs of `order` tokens that end at each token; before the first of a text stand beginnings."""
    whole = h
    with np.errstate(over="ignore"):
        for back in range(1, order):
            before = np.full(len(h), BEGIN)
            before[back:] = h[:-back] if back < len(h) else h[:0]
            for i in range(min(back, len(h))):  # tokens of a text that have no token so far before them
                at = first + i
                before[at[at < np.append(first[1:], len(h))]] = BEGIN
            whole = mix(before * U(0x9E3779B97F4A7C15) ^ mix(whole))
    return whole


def _batches(docs: DataFrame, kind: str) -> DataFrame:
    """key, held and text as rows of packed batches."""
    names = ["batch", "held", "lengths", "words", "stream", "n_words", "n_tokens", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        keys, held, lengths, tokens, size = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            unique, stream = np.unique(np.concatenate(tokens), return_inverse=True)
            held_keys = pa.concat_arrays(keys)
            row = [(part << 24) + k, pack(np.concatenate(held)), pack(np.concatenate(lengths)), pack(np.diff(unique, prepend=U(0))), pack(stream.astype(np.uint32)), len(unique), size]
            cells = [pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)]
            return pa.RecordBatch.from_arrays([*cells, pa.ListArray.from_arrays(pa.array([0, len(held_keys)], pa.int32()), held_keys)], names)

        for batch in batches:
            for b in blocks(batch.column(2)):
                data = LOWER[b.data]
                w = words(b)
                n = w.counts()
                h = np.full(len(w.start) + len(b), END, U)
                at = np.arange(len(w.start)) + w.doc
                h[at] = word_hashes(data, w)
                keys.append(batch.column(0).slice(b.first, len(b)))
                held.append(np.asarray(batch.column(1).slice(b.first, len(b)).to_numpy(zero_copy_only=False), np.uint8))
                lengths.append((n + 1).astype(np.uint32))
                tokens.append(h)
                size += len(h)
                if size >= BATCH:
                    yield flush()
                    k, size = k + 1, 0
                    for x in (keys, held, lengths, tokens):
                        x.clear()
        if size:
            yield flush()

    return docs.mapInArrow(run, f"batch long, held binary, lengths binary, words binary, stream binary, n_words long, n_tokens long, keys array<{kind}>")



class _Batch:
    """A batch row, unpacked: per token its word, whether it trains, and its document."""

    def __init__(self, held: bytes, lengths: bytes, words: bytes, stream: bytes):
        self.words = np.cumsum(unpack(words, U), dtype=U)
        self.stream = unpack(stream, np.uint32).astype(np.int64)
        self.lengths = unpack(lengths, np.uint32).astype(np.int64)
        self.held = unpack(held, np.uint8).astype(bool)
        self.first = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.train = ~self.held[self.doc]

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct n-grams, and each token's place in them."""
        return (self.words, self.stream) if order == 1 else np.unique(grams(self.words[self.stream], self.first, order), return_inverse=True)


def _by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys' places in the order of their parts, the parts that have some, and where each begins and the last ends in that order."""
    part = (mix(keys) % U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    have, begin = np.unique(part[order], return_index=True)
    return order, have, np.append(begin, len(keys))


def _asked(batches: DataFrame, parts: list[int]) -> DataFrame:
    """What each batch asks of each part of each order's count table: sorted keys and its own training counts."""
    names = ["order", "part", "batch", "keys", "counts"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for r in batch.to_pylist():
                b = _Batch(r["held"], r["lengths"], r["words"], r["stream"])
                for n, of in enumerate(parts, 1):
                    keys, at = b.grams(n)
                    counts = np.bincount(at[b.train], minlength=len(keys)).astype(np.uint32)
                    order, have, cuts = _by_part(keys, of)
                    keys, counts = keys[order], counts[order]
                    for i in range(0, len(have), ROWS):
                        spans = [slice(cuts[j], cuts[j + 1]) for j in range(i, min(i + ROWS, len(have)))]
                        p = have[i : i + ROWS]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), n, np.int32)), pa.array(p), pa.array(np.full(len(p), r["batch"])), pa.array([pack(np.diff(keys[x], prepend=U(0))) for x in spans], pa.binary()), pa.array([pack(counts[x]) for x in spans], pa.binary())], names)

    return batches.select("batch", "held", "lengths", "words", "stream").mapInArrow(run, "order int, part long, batch long, keys binary, counts binary")


def _told(asked: DataFrame) -> DataFrame:
    """The answers of a count table, as `total` and `own` in the order asked; once a part: n_0 = all its counts, n_r = types seen
    r times, and n_LEVELS+2 = types."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("batch")
        keys = [np.cumsum(unpack(x, U), dtype=U) for x in part["keys"]]
        counts = np.concatenate([unpack(x, np.uint32) for x in part["counts"]]).astype(np.int64)
        cuts = np.cumsum([len(x) for x in keys])[:-1]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        total = np.bincount(at, counts).astype(np.int64)
        owner = np.full(len(total), len(at))
        does = np.flatnonzero(counts)
        np.minimum.at(owner, at[does], does)
        own = np.zeros(len(at) + 1, bool)
        own[owner] = True
        own = own[:-1]
        seen = total[total > 0]
        stats = np.concatenate(([seen.sum()], np.bincount(np.minimum(seen, LEVELS + 1), minlength=LEVELS + 2)[1 : LEVELS + 2], [len(seen)]))
        return pd.DataFrame({
            "order": part["order"], "part": part["part"], "batch": part["batch"], "total": [pack(x.astype(U)) for x in np.split(total[at], cuts)], "own": [pack(np.packbits(x)) for x in np.split(own, cuts)],
            "stats": [stats.tolist()] + [None] * (len(part) - 1),
        })  # fmt: skip

    return asked.groupBy("order", "part").applyInPandas(run, "order int, part long, batch long, total binary, own binary, stats array<long>")


def _stats(told: DataFrame) -> dict[int, np.ndarray]:
    """By order."""
    rows = told.groupBy("order").agg(*[F.sum(F.get("stats", F.lit(i))).alias(f"n{i}") for i in range(LEVELS + 3)]).collect()
    return {r[0]: np.array([x or 0 for x in r[1:]], np.int64) for r in rows}


def _answers(rows: pd.DataFrame, keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The totals and owned keys of a batch, in the order of its keys."""
    order, have, cuts = _by_part(keys, parts)
    total, own = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    for p, t, o in zip(rows["part"], rows["total"], rows["own"], strict=True):
        i = int(np.searchsorted(have, p))
        mine = order[cuts[i] : cuts[i + 1]]
        total[mine] = unpack(t, U).astype(np.int64)
        own[mine] = np.unpackbits(unpack(o, np.uint8), count=len(mine)).astype(bool)
    return total, own


def score(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score for each row; `held` (a boolean; null: false) tells which
    rows don't train. Keys are of any type; rows with equal keys stay apart."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    batches = written(_batches(docs.select(F.col(key).alias("key"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text).alias("text")), kind), "batches")
    n_words, n_tokens = batches.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = [max(least, (x or 0) // PART + 1) for x in (n_words, *[n_tokens] * (order - 1))]
    told = written(_told(_asked(batches, parts)), "told")
    stats = _stats(told)
    none = np.zeros(LEVELS + 3, np.int64)
    n, v = (int(stats.get(1, none)[i]) for i in (0, LEVELS + 2))
    d1, scale, unknown = unigrams(stats.get(1, none), n)
    fits = [(discounts(stats.get(m, none)), slope(stats.get(m, none))) for m in range(2, order + 1)]

    def run(batch: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        r = batch.iloc[0]
        b = _Batch(r["held"], r["lengths"], r["words"], r["stream"])
        c, _ = _answers(told[told["order"] == 1], b.words, parts[0])
        size = len(b.lengths)
        per = lambda x: np.bincount(b.doc, x, minlength=size)  # noqa: E731
        p1 = known(c, d1, scale, n)
        ends = int(c[np.searchsorted(b.words, END)]) if size else 0
        count, lower = c[b.stream], p1[b.stream]  # of each token's gram, and its probability at the order before, if seen there
        p = np.where(lower > 0, lower, unknown)
        cw = count
        gram, more = b.words[b.stream], []
        for m, (d, slant) in enumerate(fits, 2):
            keys, at = b.grams(m)
            got, own = _answers(told[told["order"] == m], keys, parts[m - 1])
            history, ahead = np.full(len(p), BEGIN), np.full(len(p), ends)  # hashes and counts of the grams before
            history[1:], ahead[1:] = gram[:-1], count[:-1]
            history[b.first], ahead[b.first] = BEGIN, ends
            mass = np.where(got <= LEVELS, d[np.minimum(got, LEVELS)], beyond(got, slant)) * got
            seen = got[at] > 0
            wait = np.flatnonzero(~seen & (ahead > 0))
            waits = pd.DataFrame({"doc": b.doc[wait], "word": history[wait].view(np.int64)}).groupby(["doc", "word"], as_index=False).size()
            more.append(pd.DataFrame({"kind": WAIT, "order": m, "doc": waits["doc"], "word": waits["word"], "n_tokens": waits["size"]}))
            mine = np.full(len(keys), -1)
            mine[at] = np.arange(len(at))  # some token of each gram
            mine = mine[own]
            have, which, index = np.unique(history[mine], return_index=True, return_inverse=True)
            sums = (np.bincount(index, x, minlength=len(have)) for x in (mass[own], lower[mine]))
            more.append(pd.DataFrame({"kind": CONTEXT, "order": m, "word": have.view(np.int64), "n_tokens": ahead[mine][which], "base": next(sums), "value": next(sums)}))
            p[seen] = mass[at[seen]] / ahead[seen]
            lower = np.where(seen, p, 0.0)
            gram, count = keys[at], got[at]
        docs = pd.DataFrame({"kind": DOC, "doc": np.arange(size), "held_out": b.held, "n_tokens": b.lengths, "n_known": per(cw > 0).astype(np.int64), "base": per(np.log10((cw + 1) / (n + v + 1))), "value": per(np.log10(p))})
        out = pd.concat([docs, *more]).assign(batch=r["batch"])
        whole = {x: "Int64" for x in ("order", "doc", "n_tokens", "n_known", "word")}
        return out.reindex(columns=["kind", "batch", "order", "doc", "held_out", "n_tokens", "n_known", "base", "value", "word"]).astype({**whole, "held_out": "boolean"})

    found = batches.select("batch", "held", "lengths", "words", "stream").groupBy("batch").cogroup(told.drop("stats").groupBy("batch")).applyInPandas(run, "kind int, batch long, order int, doc long, held_out boolean, n_tokens long, n_known long, base double, value double, word long")
    found = written(found, "found")
    alpha = F.greatest(1 - F.sum("base") / F.max("n_tokens"), F.lit(LEAST)) / F.greatest(1 - F.sum("value"), F.lit(LEAST))
    alphas = found.where(F.col("kind") == CONTEXT).groupBy("order", "word").agg(alpha.alias("alpha"))
    late = found.where(F.col("kind") == WAIT).join(alphas, ["order", "word"]).groupBy("batch", "doc").agg(F.sum(F.col("n_tokens") * F.log10("alpha")).alias("late"))
    keys = batches.select("batch", F.posexplode("keys").alias("doc", "key"))
    rows = found.where(F.col("kind") == DOC).join(late, ["batch", "doc"], "left").join(keys, ["batch", "doc"])
    return rows.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.round("base", 6).alias("base_score"), F.round(F.col("value") + F.coalesce("late", F.lit(0.0)), 6).alias("score"))


def is_remainder(key: Column, modulo: int, remainder: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % modulo == remainder


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents; those with crc32(doc_id) mod 7 = 2 are held out."""
    return score(documents(spark, sf_dir, "doc_id", "text"), is_remainder(F.col("doc_id"), 7, 2))


def _fit(m: int) -> str:
    """SQL for the discounts of an order, out of its counts c{m}: t{m} types by count, b{m} the slope, d{m} a discount for each count up to LEVELS."""
    return f"""t{m} AS (SELECT least(c, {LEVELS + 1}) r, count(*) n FROM c{m} GROUP BY 1),
x{m} AS (SELECT r, n, coalesce(lag(r) OVER (ORDER BY r), 0) lo, coalesce(lead(r) OVER (ORDER BY r), 2 * r - lag(r) OVER (ORDER BY r)) hi FROM t{m} WHERE r <= {LEVELS}),
b{m} AS (SELECT CASE WHEN count(*) < 2 THEN -2.0 ELSE greatest(-4.0, least(-1.1, regr_slope(ln(2.0::DOUBLE * n / (hi - lo)), ln(r::DOUBLE)))) END::DOUBLE b FROM x{m}),
d{m} AS (SELECT r, CASE WHEN r <= {TURING} AND a.n > 0 AND z.n > 0 AND (r + 1)::DOUBLE * z.n / (r * a.n) < 1 THEN (r + 1)::DOUBLE * z.n / (r * a.n) ELSE pow(1 + 1 / r::DOUBLE, b + 1) END d, coalesce(a.n, 0) n
  FROM range(1, {LEVELS + 1}) g(r) CROSS JOIN b{m} LEFT JOIN t{m} a USING (r) LEFT JOIN t{m} z ON z.r = g.r + 1)"""


#: Of order two, for the query; END is written as a blank, and the beginning as a line feed.
SQL = rf"""
WITH h AS (SELECT doc_id, text, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(unicode(s) AS BIGINT))),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) crc FROM documents),
w AS (SELECT row_number() OVER () rid, doc_id, coalesce(crc % 7 = 2, false) held, list_concat(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+'), [' ']) l FROM h),
k AS (SELECT rid, held, unnest(l) w, generate_subscripts(l, 1) i FROM w),
g AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY rid ORDER BY i), chr(10)) v FROM k),
c1 AS (SELECT w, count(*) c FROM g WHERE NOT held GROUP BY 1), c2 AS (SELECT v, w, count(*) c FROM g WHERE NOT held GROUP BY 1, 2),
s AS (SELECT coalesce(CAST(sum(c) AS BIGINT), 0) n, count(*) v FROM c1), {_fit(1)}, {_fit(2)},
u AS (SELECT n, v, CASE WHEN n = 0 OR rest > 0 THEN 1 ELSE n::DOUBLE / (n + 1) END scale, CASE WHEN n = 0 THEN 1 WHEN rest > 0 THEN rest ELSE 1 / (n + 1)::DOUBLE END unknown FROM s, (SELECT sum((1 - d) * r * d1.n) / max(s.n) rest FROM d1, s)),
p1 AS (SELECT w, c, CASE WHEN c <= {LEVELS} THEN d ELSE 1 END * c * scale / greatest(n, 1) p FROM c1 CROSS JOIN (SELECT n, scale FROM u) LEFT JOIN (SELECT r, d FROM d1) ON r = c),
cx AS (SELECT w v, c FROM c1 WHERE w <> ' ' UNION ALL SELECT chr(10), c FROM c1 WHERE w = ' '),
p2 AS (SELECT c2.v, c2.w, CASE WHEN c2.c <= {LEVELS} THEN d ELSE pow(1 + 1 / c2.c::DOUBLE, b + 1) END * c2.c / cx.c p FROM c2 JOIN cx ON cx.v = c2.v CROSS JOIN b2 LEFT JOIN (SELECT r, d FROM d2) ON r = c2.c),
al AS (SELECT p2.v, (1 - sum(p2.p)) / (1 - sum(p1.p)) a FROM p2 JOIN p1 ON p1.w = p2.w GROUP BY 1),
e AS (SELECT g.rid, coalesce(p1.c, 0) c, CASE WHEN p2.p IS NOT NULL THEN log10(p2.p) ELSE log10(coalesce(p1.p, unknown)) + coalesce(log10(al.a), 0) END sc, u.n, u.v
  FROM g CROSS JOIN u LEFT JOIN p1 ON p1.w = g.w LEFT JOIN p2 ON p2.v = g.v AND p2.w = g.w LEFT JOIN al ON al.v = g.v),
f AS (SELECT rid, count(*) n_tokens, count(*) FILTER (c > 0) n_known, max(n) train_tokens, round(sum(log10((c + 1)::DOUBLE / (n + v + 1))), 6) base_score, round(sum(sc), 6) score FROM e GROUP BY 1)
SELECT doc_id, held held_out, n_tokens, n_known, train_tokens, base_score, score FROM f JOIN w USING (rid)
"""
