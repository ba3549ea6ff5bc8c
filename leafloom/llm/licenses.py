"""License scans by diagonal voting.

Texts are words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. The hashes of all runs of K words of every text are
joined to those of the templates; each hit votes for the template's label on the diagonal (place in the text minus place in the template).
Neighbouring diagonals (an inserted or lost word moves a copy from one to the next) are merged to spans. Two independent 64-bit hashes must agree for
a hit, so the words of a hit are the template's words.

A span is verified word by word on both sides: its coverage is the share of the template's words that stand in its hits, and its density the share of the
text's words, from its first to its last, that do. A span counts where both are at least ACCEPT: most of the template, and not strewn over a long text.

A phrase is a template that must stand whole: its places are the diagonals on which all of its words are.

The table of templates is a parameter, bounded by MOST runs, and so may be broadcast. A text's hits are distinct (place in the text, place
in the template) pairs of one template, counted before they are shuffled; the hits of one text meet in one task. Null texts are empty; texts without K
words have no hits, and no template or phrase has fewer. Rows that are alike in key and text give the same result each; null keys are keys. Columns
other than key and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.llm.tables import documents
from leafloom.llm.text import ALNUM, LOWER, Block, blocks, run_hashes, span_hashes, word_hashes, words

K = 3
#: Shares that a span needs, how far diagonals may lie apart to be merged, and the most runs of all templates.
ACCEPT, APART, MOST = 0.6, 4, 100_000

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Texts of public licenses, or of the notices that they ask for.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE.""",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/""",
    "mpl-2": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "gpl-3": "licensed under the GNU General Public License, version 3",
    "cc-by-sa": "licensed under a Creative Commons Attribution-ShareAlike License",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means",
}


def _hashes(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: words of each text, and document, place and two hashes of each run of K."""
    data = LOWER[b.data]
    w = words(Block(b.first, b.last, data, b.offsets), ALNUM)
    h = word_hashes(data, w)
    h1, at = run_hashes(h, w.first, K)
    h2, _ = run_hashes(h, w.first, K, 1)
    doc = w.doc[at] if len(at) else at
    return w.counts(), doc, at - w.first[doc], h1, h2


def _digests(b: Block) -> np.ndarray:
    """A hash of each whole text."""
    return span_hashes(b.data.astype(np.uint64) + np.uint64(1), b.offsets[:-1], b.offsets[1:])


def templates(phrases: dict[str, str], texts: dict[str, str]) -> tuple[list[tuple[int, int, int, int]], list[tuple[str, int, bool]]]:
    """Runs as (hash, second hash, template, place), and templates as (label, words, is a phrase)."""
    all_ = [(label, text, True) for text, label in phrases.items()] + [(label, text, False) for label, text in texts.items()]
    block = next(blocks(pa.array([t for _, t, _ in all_]), 1 << 40))
    n, doc, at, h1, h2 = _hashes(block)
    if (n < K).any() or len(doc) > MOST:
        raise ValueError(f"templates need {K} words each and {MOST} runs in all at most")
    runs = list(zip(h1.view(np.int64).tolist(), h2.view(np.int64).tolist(), doc.tolist(), at.tolist(), strict=True))
    return runs, [(label, int(c), phrase) for (label, _, phrase), c in zip(all_, n, strict=True)]


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, texts: dict[str, str] | None = None) -> DataFrame:
    """Merged spans: key, text_digest, template, label, phrase (boolean), first_word, end_word, votes, matched (words of the template), coverage and density,
    not yet filtered. Phrases' diagonals stay apart: each of coverage 1 is a place where the phrase stands."""
    spark = docs.sparkSession
    runs, known = templates(PHRASES if phrases is None else phrases, TEMPLATES if texts is None else texts)
    kind = dict(docs.dtypes)[key]
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                _, doc, at, h1, h2 = _hashes(b)
                digest = _digests(b)[doc].view(np.int64)
                keys = batch.column(0).slice(b.first, len(b)).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([keys, pa.array(digest), pa.array(at.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["key", "text_digest", "place", "h1", "h2"])

    hashed = docs.mapInArrow(run, f"key {kind}, text_digest long, place int, h1 long, h2 long")
    table = spark.createDataFrame(runs, "h1 long, h2 long, template int, at int")  # MOST rows at most
    hits = hashed.join(F.broadcast(table), ["h1", "h2"]).groupBy("key", "text_digest", "template", "place", "at").agg(F.lit(1).alias("one"))
    votes = hits.groupBy("key", "text_digest", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("votes"), F.collect_set("at").alias("ats"))
    facts = F.element_at(F.array(*[F.struct(F.lit(a).alias("label"), F.lit(n).alias("words"), F.lit(p).alias("phrase")) for a, n, p in known]), F.col("template") + 1)
    votes = votes.withColumn("of", facts)
    own = Window.partitionBy("key", "text_digest", "template").orderBy("diagonal")  # of one text and template
    fresh = F.when(F.col("of.phrase") | F.lag("diagonal").over(own).isNull() | (F.col("diagonal") - F.lag("diagonal").over(own) > APART), 1).otherwise(0)
    votes = votes.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + K - 1))))  # words of the template, and of the text
    votes = votes.withColumn("held", held).withColumn("stand", F.transform("held", lambda a: a + F.col("diagonal")))
    merged = votes.groupBy("key", "text_digest", "template", "of", "island").agg(F.sum("votes").alias("votes"), *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("held", "stand")])
    merged = merged.withColumn("first_word", F.array_min("stand")).withColumn("end_word", F.array_max("stand") + 1)
    shares = (F.size("held") / F.col("of.words")).alias("coverage"), (F.size("stand") / (F.col("end_word") - F.col("first_word"))).alias("density")
    return merged.select(F.col("key").alias(key), "text_digest", "template", F.col("of.label").alias("label"), F.col("of.phrase").alias("phrase"), "first_word", "end_word", "votes", F.size("held").alias("matched"), *shares)


def digested(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text_digest and n_words of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                n = words(Block(b.first, b.last, LOWER[b.data], b.offsets), ALNUM).counts()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, len(b)), pa.array(_digests(b).view(np.int64)), pa.array(n)], ["key", "text_digest", "n_words"])

    return docs.select(F.col(key).alias("key"), text).mapInArrow(run, f"key {dict(docs.dtypes)[key]}, text_digest long, n_words long").withColumnRenamed("key", key)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", **templates) -> DataFrame:
    """A row for each of docs': key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    base_* are of phrases that stand whole; labels adds those of templates whose spans reach ACCEPT; score is the largest of coverage times density
    of an accepted span, 0 if none.
    """
    found = spans(docs, key, text, **templates).withColumn("base", F.col("phrase") & (F.col("coverage") == 1))
    found = found.where(F.col("base") | (~F.col("phrase") & (F.col("coverage") >= ACCEPT) & (F.col("density") >= ACCEPT)))
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    base = F.col("base")
    found = found.groupBy(F.col(key).alias("_key"), F.col("text_digest").alias("_digest")).agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first_word"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("first_word"))).cast("long").alias("last_word"),
        labels(F.when(base, F.col("label"))).alias("base_labels"), labels("label").alias("labels"), F.round(F.max(F.col("coverage") * F.col("density")), 9).alias("score"),
    )
    rows = digested(docs, key, text).join(found, F.col(key).eqNullSafe(F.col("_key")) & (F.col("text_digest") == F.col("_digest")), "left")
    empty = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return rows.select(key, "n_words", *[F.coalesce(c, empty[c]).alias(c) if c in empty else c for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: licenses of all documents."""
    return scan(documents(spark, sf_dir, "doc_id", "text"))


def _values(rows: list[tuple]) -> str:
    quoted = lambda x: str(x) if isinstance(x, (bool, int)) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_GRAM = "w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]"
SQL = f"""
WITH t AS (SELECT id, label, phrase, {_WORDS.format("t")} w FROM (VALUES {_values([(i, *x) for i, x in enumerate([*((label, True, t) for t, label in PHRASES.items()), *((label, False, t) for label, t in TEMPLATES.items())])])}) v(id, label, phrase, t)),
d AS (SELECT row_number() OVER () rid, doc_id, {_WORDS.format("text")} w FROM documents),
tg AS (SELECT id, phrase, i at_, {_GRAM} g FROM (SELECT *, unnest(range(0, len(w) - {K - 1})) i FROM t)),
dg AS (SELECT rid, i place, {_GRAM} g FROM (SELECT *, unnest(range(0, len(w) - {K - 1})) i FROM d)),
h AS (SELECT DISTINCT rid, id, phrase, place, at_, place - at_ diagonal FROM dg JOIN tg USING (g)),
b AS (SELECT DISTINCT rid, id, phrase, diagonal FROM h),
f AS (SELECT *, CASE WHEN phrase OR diagonal - lag(diagonal) OVER o <= {APART} IS NOT TRUE THEN 1 ELSE 0 END fresh FROM b WINDOW o AS (PARTITION BY rid, id ORDER BY diagonal)),
l AS (SELECT rid, id, diagonal, sum(fresh) OVER (PARTITION BY rid, id ORDER BY diagonal) island FROM f),
x AS (SELECT rid, id, island, at_ + k a, place + k p FROM h JOIN l USING (rid, id, diagonal), range({K}) r(k)),
m AS (SELECT rid, id, island, count(DISTINCT a) held, count(DISTINCT p) stand, min(p) first, max(p) last FROM x GROUP BY ALL),
s AS (SELECT m.*, label, phrase, CAST(held AS DOUBLE) / len(w) coverage, CAST(stand AS DOUBLE) / (last - first + 1) density FROM m JOIN t USING (id)),
a AS (SELECT *, phrase AND coverage = 1 base FROM s WHERE CASE WHEN phrase THEN coverage = 1 ELSE coverage >= {ACCEPT} AND density >= {ACCEPT} END),
y AS (SELECT rid, count(*) FILTER (base) n_base, min(first) FILTER (base) first_word, max(first) FILTER (base) last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) labels, round(max(coverage * density), 9) score FROM a GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_base, 0) n_base, first_word, last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0) score FROM d LEFT JOIN y USING (rid)
"""
