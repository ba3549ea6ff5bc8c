"""Best-fit packing of tokenised documents into sequences.

Lengths are whole numbers up to the capacity, so the whole packing is decided from the number of pieces of each length, at
most `capacity` numbers, whatever the corpus. Pieces above a third of the capacity go first, at most two to a sequence:
the longest is matched with the longest that fits beside it. Shorter ones then fill the gaps, longest first, each into the
smallest gap that holds it, or new sequences where none does. Sequences with equal gaps are handled as runs of sequence
numbers, so the plan is a table of runs, and a piece finds its place by its length and its rank among those of that length. Ranks are
counted in salted buckets: no task holds all pieces of a length.

Null texts are empty; an empty text has the one token that ends each document. Rows that are alike are packed each.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.llm.tables import documents, written
from leafloom.llm.text import blocks

CAPACITY, LAST = 4096, 1
VOCABULARY = "word_bpe_49k.json"
#: Pieces in a bucket of ranks, about.
BUCKET = 50_000


class _Parts(dict):
    """The token ids of letters, digits or marks that the tokeniser's pattern cuts out; looked up first."""

    def __init__(self, model):
        self.model = model
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that byte-level vocabularies write as themselves
        self.letters = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in kept)}

    def __missing__(self, part: str) -> array:
        text = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        ids = self[part] = array("I", [t.id for t in self.model.tokenize(text)])
        return ids


class Ids(dict):
    """Place of each white-space separated chunk of text in a table of token ids; new chunks of many texts are tokenised together.

    The tokeniser drops white space and treats chunks apart, so a text's ids are its chunks' ids in order. Chunks of letters,
    digits and marks below U+0130 are cut as the tokeniser's own pattern does, and their parts looked up; others are left to the
    tokeniser. Tables are begun anew when they are full.
    """

    MOST = 200_000
    LETTERS, DIGITS = "A-Za-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\u012F", "0-9\xB2\xB3\xB9\xBC-\xBE"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts = _Parts(self.tokenizer.model)
        self.cut = re.compile(rf"\n|[{self.LETTERS}]+|[{self.DIGITS}]|'(?:s|t|re|ve|m|ll|d)|(?:(?!'(?:s|t|re|ve|m|ll|d))[^\s{self.LETTERS}{self.DIGITS}])[^\s{self.LETTERS}{self.DIGITS}]*").findall
        self.odd = re.compile(r"[^\x21-\x7E\xA1-\u012F]|<\|").search
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.flat, self.begin, self.end = array("I"), array("q"), array("q")
        self.new: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        """The next place; learn() fills it."""
        at = self[chunk] = len(self)
        self.new.append(chunk)
        return at

    def learn(self) -> None:
        texts = [c.decode("utf-8", "replace") for c in self.new]
        odd = [i for i, t in enumerate(texts) if self.odd(t)] if self.odd("".join(texts)) else []
        left = [(len(self.begin) + i, texts[i]) for i in odd]
        for i in odd:
            texts[i] = ""
        if len(self.parts) >= self.MOST:
            self.parts.clear()
        flat, parts, last = self.flat, self.parts, len(self.flat)
        for part in self.cut("\n".join(texts).lower() + "\n"):
            if part == "\n":
                self.begin.append(last)
                last = len(flat)
                self.end.append(last)
            else:
                flat.extend(parts[part])
        for at, text in left:
            self.begin[at] = len(flat)
            flat.extend(self.tokenizer.encode(text, add_special_tokens=False).ids)
            self.end[at] = len(flat)
        self.new = []

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each with LAST behind, and the offsets of the texts in them."""
        if len(self) > self.MOST:
            self.reset()
        chunks = [t.split() for t in texts]
        counts = np.array([len(c) for c in chunks])
        at = np.fromiter(chain.from_iterable(map(self.__getitem__, c) for c in chunks), np.int64, counts.sum())
        if self.new:
            self.learn()
        begin, end, flat = (np.array(x) for x in (self.begin, self.end, self.flat)) if self.flat else (np.zeros(len(self), np.int64), np.zeros(len(self), np.int64), np.zeros(0, np.uint32))
        start = begin[at]
        n = end[at] - start
        upto = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat(start - upto[:-1], n) + np.arange(upto[-1])]
        cuts = upto[np.concatenate(([0], np.cumsum(counts)))]
        return np.insert(ids, cuts[1:], LAST), cuts + np.arange(len(cuts))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length and ids_crc32 of every document's pieces: whole documents, or cuts of those above capacity."""
    names = [key, "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Ids(path)
        for batch in batches:
            for b in blocks(batch.column(1)):
                ids, at = table.encode([b.text(i) for i in range(len(b))])
                ids = ids.astype("<u4")
                n = np.diff(at)
                of = np.repeat(np.arange(len(b)), -(-n // capacity))
                piece = np.arange(len(of)) - np.searchsorted(of, of)
                start = piece * capacity
                length = np.minimum(n[of] - start, capacity)
                begin = at[of] + start
                crc = [zlib.crc32(ids[x : x + y]) for x, y in zip(begin.tolist(), length.tolist(), strict=True)]
                keys = batch.column(0).slice(b.first, len(b)).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([keys, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names)

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs as rows of length, first rank, first sequence, pieces a sequence, and place in the sequence; sorted by the first two."""
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: runs of sequences, as first and number
    rank, fresh = dict.fromkeys(counts, 0), 0

    def put(length: int, first: int, sequences: int, each: int, at: int) -> None:
        runs.append((length, rank[length], first, each, at))
        rank[length] += sequences * each

    large = sorted((n for n in counts if 3 * n > capacity), reverse=True)
    left = {n: counts[n] for n in large}
    for a in large:
        for b in large:
            if not left[a]:
                break
            if b > a or a + b > capacity or not left[b]:
                continue
            k = left[a] // 2 if a == b else min(left[a], left[b])
            if k:
                put(a, fresh, k, 2 if a == b else 1, 0)
                if a != b:
                    put(b, fresh, k, 1, a)
                left[a] -= k
                left[b] -= k
                gaps[capacity - a - b].append((fresh, k))
                fresh += k
        if left[a]:
            put(a, fresh, left[a], 1, 0)
            gaps[capacity - a].append((fresh, left[a]))
            fresh, left[a] = fresh + left[a], 0
    for n in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        todo, gap = counts[n], n
        while todo:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap > capacity:
                new = -(-todo // (capacity // n))
                gaps[capacity].append((fresh, new))
                fresh, gap = fresh + new, capacity
            first, k = gaps[gap].pop()
            each = gap // n
            whole = min(k, todo // each)
            if whole:
                put(n, first, whole, each, capacity - gap)
                gaps[gap - each * n].append((first, whole))
                todo -= whole * each
            if todo and whole < k:  # fewer than one sequence takes
                put(n, first + whole, 1, todo, capacity - gap)
                gaps[gap - todo * n].append((first + whole, 1))
                whole, todo = whole + 1, 0
            if whole < k:
                gaps[gap].append((first + whole, k - whole))
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` of 1 to capacity."""
    made = written(made, "pieces")
    count = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}  # at most one row for each length
    runs = plan(count, capacity)
    salts = max(16, sum(count.values()) // BUCKET)
    order = [c for c in made.columns if c != "length"]
    made = made.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    sizes = made.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    ranked = made.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1)
    ranked = ranked.join(sizes.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_before")), ["length", "_salt"])
    ranked = ranked.select(*order, "length", (F.col("_rank") + F.col("_before")).alias("_rank"))
    schema = ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")
    width = len(ranked.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = runs[:, 0] << 44 | runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (width - 2, width - 1))
            r = runs[np.searchsorted(starts, length << 44 | rank, "right") - 1] if len(batch) else runs[:0]
            nth = rank - r[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(r[:, 2] + nth // r[:, 3]), pa.array(r[:, 4] + nth % r[:, 3] * length)], [f.name for f in schema])

    return ranked.mapInArrow(run, schema)


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents, cut and packed."""
    return packed(documents(spark, sf_dir, "doc_id", "text"))


def packed(docs: DataFrame) -> DataFrame:
    found = pack(pieces(docs, tokenizer_path()))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
