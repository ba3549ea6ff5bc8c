"""Substring deduplication by seed and extend.

A repeat is a run of LONG or more words that stands in several documents. Seeds are winnowed anchors: of each window of LONG
words, the least hash among its runs of SEED words, so that equal windows have equal anchors. Documents are joined on anchors
that more than one of them has. An anchor's windows lie side by side; all of them together, its reach, are hashed as well:

* reaches that are equal as a whole are decided as a whole: only the first document with one is left to compare;
* where an anchor has several different reaches, their first documents are extended word by word, both ways, to every window
  of LONG words that the anchor stands for, and windows are matched by hash.

Matched windows that overlap are merged into maximal repeats, and removed from every document but the first that has them.
Everything is grouped by hash with sums that combine before the shuffle; no pairs are formed, whatever the number of copies. Hashes are
compared as 128 bits.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Null texts have none. Rows with a null key stay as they are and others aren't
compared to them; rows with equal keys should have equal texts, and none of them counts as earlier than the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.tables import documents, written
from leafloom.llm.text import blocks, longs, span_hashes, word_hashes, words

LONG, SEED = 50, 25


def _seeds(docs: DataFrame, long: int, seed: int) -> DataFrame:
    """anchor, reach, key, and the first and last window (by first word) of each anchor's reach."""
    names = ["anchor", "reach", "key", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                w = words(b)
                n = w.counts()
                if not (n >= long).any():
                    continue
                h = word_hashes(b.data, w)
                grams = span_hashes(h, np.arange(len(h) - seed + 1), np.arange(seed, len(h) + 1))
                room = np.maximum(n - long + 1, 0)
                window = np.repeat(w.first[:-1] - np.concatenate(([0], np.cumsum(room)[:-1])), room) + np.arange(room.sum())
                least = np.concatenate([np.lib.stride_tricks.sliding_window_view(grams, long - seed + 1)[part].argmin(axis=1) for part in np.array_split(window, max(1, len(window) // 50_000))])
                anchor, doc = window + least, w.doc[window]
                begins = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))))
                low, high, at = window[begins], window[np.concatenate((begins[1:], [len(window)])) - 1], anchor[begins]
                reach = span_hashes(h, low, high + long) ^ (at - low).astype(np.uint64)
                doc = doc[begins]
                keys = batch.column(0).slice(b.first, len(b)).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([longs(grams[at]), longs(reach), keys, pa.array((low - w.first[doc]).astype(np.int32)), pa.array((high - w.first[doc]).astype(np.int32))], names)

    return docs.mapInArrow(run, "anchor long, reach long, key long, low int, high int")


def _of_docs(docs: DataFrame, spans: DataFrame, how: str, key: str = "key") -> DataFrame:
    """docs with `lows` and `highs`, their spans' ends; both sides are shuffled by key, at every size."""
    by = spans.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("spans")).select(F.col("key").alias("_key"), F.col("spans.low").alias("lows"), F.col("spans.high").alias("highs"))
    return docs.join(by.hint("merge"), docs[key] == by["_key"], how).drop("_key")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column; nulls are empty."""
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(lengths)))


def _windows(docs: DataFrame, long: int) -> DataFrame:
    """The hashes of windows in docs' spans: those that begin from low to high."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (low, cut), (high, _) = _lists(batch.column(2)), _lists(batch.column(3))
            for b in blocks(batch.column(1)):
                w = words(b)
                h = word_hashes(b.data, w)
                mine = slice(cut[b.first], cut[b.last])
                size = high[mine] - low[mine] + 1
                doc = np.repeat(np.repeat(np.arange(len(b)), np.diff(cut[b.first : b.last + 1])), size)
                at = np.repeat(low[mine] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                begin = at + w.first[doc]
                keys = batch.column(0).slice(b.first, len(b)).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([longs(span_hashes(h, begin, begin + long)), longs(span_hashes(word_hashes(b.data, w, 1), begin, begin + long, 1)), keys, pa.array(at.astype(np.int32))], ["h1", "h2", "key", "low"])

    return docs.mapInArrow(run, "h1 long, h2 long, key long, low int")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", long: int = LONG, seed: int = SEED) -> DataFrame:
    """key, low and high: words low up to high (excluded) are covered by windows that an earlier document has. Spans may overlap."""
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key IS NOT NULL")
    seeds = written(_seeds(docs, long, seed), "seeds")
    # What is summed by a key is written before it is joined back by that key, so that the planner can split a hot key's rows in the join.
    shared = seeds.groupBy("anchor").agg(F.min("key").alias("a"), F.max("key").alias("b"), (F.min("reach") != F.max("reach")).alias("several")).where("a < b")
    joined = written(seeds.join(written(shared.select("anchor", "several"), "shared"), "anchor"), "joined")
    firsts = written(joined.groupBy("anchor", "reach").agg(F.min("key").alias("first")), "firsts")
    joined = written(joined.join(firsts, ["anchor", "reach"]).where("key > first OR several").select("key", "low", "high", (F.col("key") > F.col("first")).alias("whole")), "decided")
    windows = written(_windows(_of_docs(docs, joined.where("NOT whole"), "inner"), long), "windows")
    first = written(windows.groupBy("h1", "h2").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b"), "first")
    matched = windows.join(first, ["h1", "h2"]).where("key > a").select("key", "low", F.col("low").alias("high"))
    return joined.where("whole").select("key", "low", "high").unionByName(matched).select("key", "low", (F.col("high") + long).alias("high"))


def remove(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 and kept (the words that are left, joined by one space) in place of columns of those
    names; other columns stay."""
    docs = docs.drop("n_words", "n_removed", "kept_sha256", "kept")
    rows = _of_docs(docs.withColumn("_by", F.col(key).cast("long")), spans, "left", "_by")
    columns = docs.columns
    place = columns.index(text)
    schema = docs.schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (low, cut), (high, _) = (_lists(batch.column(batch.schema.get_field_index(c))) for c in ("lows", "highs"))
            for b in blocks(batch.column(place)):
                out: list[tuple[int, int, str, str]] = []
                for i in range(len(b)):
                    found = b.text(i).split()
                    gone = 0
                    mine = slice(cut[b.first + i], cut[b.first + i + 1])
                    n = len(found)
                    if mine.stop > mine.start:
                        depth = np.zeros(n + 1, np.int64)
                        np.add.at(depth, np.minimum(low[mine], n), 1)
                        np.add.at(depth, np.minimum(high[mine], n), -1)
                        keep = np.cumsum(depth[:-1]) == 0
                        gone = int(n - keep.sum())
                        found = [found[j] for j in np.flatnonzero(keep)]
                    kept = b" ".join(found)
                    out.append((n, gone, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
                part = batch.slice(b.first, len(b))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], *[pa.array(x) for x in zip(*out, strict=True)]], [f.name for f in schema])

    return rows.select(*columns, "lows", "highs").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all documents, without what earlier ones have."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    return remove(docs, repeats(docs)).drop("text", "kept")


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - {LONG} + 2)) i FROM d),
h AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + {LONG} - 1), ' ')) h FROM s),
m AS (SELECT h, min(doc_id) f FROM h GROUP BY 1),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + {LONG})) j FROM h JOIN m USING (h) WHERE f < doc_id),
g AS (SELECT doc_id, list(j) js FROM r GROUP BY 1),
k AS (SELECT d.doc_id, len(w) n, coalesce(len(js), 0) gone, CASE WHEN js IS NULL THEN w ELSE
  list_select(w, list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(js, x))) END kept FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) n_words, CAST(gone AS BIGINT) n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) kept_sha256 FROM k
"""
