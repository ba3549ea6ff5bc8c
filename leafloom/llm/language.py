"""Language identification: a language family first, then one-versus-one linear support vector machines inside it.

Features are counts of byte runs of one to three inside words (A-Z lower-cased, one blank around each word), hashed to WIDTH places, as square
roots and scaled to unit length. The first step is one machine for each family against the rest; within the family, each pair
of languages has a machine, and most votes win (ties: the larger sum of the margins, each squashed to 0..1; then the first language by name).

Machines minimise a squared hinge loss and are fitted on the driver from at most `sample` documents of each language, fewer where all languages
together would have more than `total`, but `least` at least: those that come first in the order of a digest of the key (rows of equal keys
by features; a fifth more, or 20, are expected to be collected). Their features, not their texts, are collected. All values of lang are learned, so
the driver holds `least` rows a language at least. Languages without an entry in FAMILIES are families of their own.

Texts that are null or have no letter are `und` with score 0, as are all where nothing was learned. Rows that are alike are predicted alike, and each
counts when learning. Whole texts are read; other columns are kept, but for lang_pred and score, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.tables import documents
from leafloom.llm.text import LOWER, Block, blocks, byte_class

FAMILIES = {
    "germanic": ("de", "en", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"),
    "uralic": ("fi", "et", "hu"),
    "indo-iranian": ("hi", "ur", "bn", "fa", "mr", "ne", "pa", "gu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
FAMILY = {language: family for family, languages in FAMILIES.items() for language in languages}
UND = "und"
WIDTH = 1 << 12
#: The most documents of a language to fit on, and of all languages together where that leaves each language LEAST.
SAMPLE, TOTAL, LEAST = 400, 16_000, 20
#: Bytes of text whose features are made at once: each text takes WIDTH numbers meanwhile.
BYTES = 1 << 18
_LETTER = byte_class((65, 90), (97, 122))
_BLANK = byte_class((0, 32), (127, 127))


def features(block: Block) -> np.ndarray:
    data = LOWER[block.data]
    x = np.zeros(len(block) * WIDTH, np.float32)
    if len(data):
        data = np.where(_BLANK[data], np.uint8(32), data).astype(np.uint32)
        doc = np.repeat(np.arange(len(block)), np.diff(block.offsets))
        code = np.zeros(len(data), np.uint32)
        for n in (1, 2, 3):  # runs that end at each byte
            if n > 1:
                code[n - 1 :] = code[n - 1 :] + (data[: len(data) - n + 1] << np.uint32(8 * (n - 1)))
                inside = np.arange(n - 1, len(data))
                inside = inside[(doc[inside] == doc[inside - n + 1])]
                if n == 3:  # none across a blank in the middle
                    inside = inside[data[inside - 1] != 32]
            else:
                code += data
                inside = np.flatnonzero(data != 32)
            place = ((code[inside] * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(20)).astype(np.int64)
            x += np.bincount(doc[inside] * WIDTH + place, minlength=len(x)).astype(np.float32)
    x = np.sqrt(x).reshape(len(block), WIDTH)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def lettered(block: Block) -> np.ndarray:
    """Which texts have a letter, of any script."""
    counts = np.concatenate(([0], np.cumsum(_LETTER[block.data], dtype=np.int64)))
    has = counts[block.offsets[1:]] > counts[block.offsets[:-1]]
    for i in np.flatnonzero(~has):
        has[i] = any(map(str.isalpha, block.text(i).decode("utf-8", "replace")))
    return has


@dataclass
class Model:
    """families: one row of `outer` each (weights, then bias); of each, its languages and a row for each pair of them."""

    families: list[str]
    outer: np.ndarray
    languages: dict[str, list[str]]
    inner: dict[str, np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        outer = x @ self.outer[:, :-1].T + self.outer[:, -1]
        best = outer.argmax(axis=1)
        odds = 1 / (1 + np.exp(-4 * outer))
        score = odds[np.arange(len(x)), best] / np.maximum(odds.sum(axis=1), 1e-9)
        said = np.empty(len(x), object)
        for i, family in enumerate(self.families):
            rows, names = np.flatnonzero(best == i), self.languages[family]
            if not len(rows):
                continue
            margin = x[rows] @ self.inner[family][:, :-1].T + self.inner[family][:, -1] if len(names) > 1 else np.zeros((len(rows), 0))
            votes, chance = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            pairs = [(a, b) for a in range(len(names)) for b in range(a + 1, len(names))]
            for (a, b), m in zip(pairs, margin.T, strict=True):
                p = 1 / (1 + np.exp(-4 * m))
                for c, q in ((a, p), (b, 1 - p)):
                    votes[:, c] += (q > 0.5) + q / (2 * len(names))
                    chance[:, c] += q
            pick = votes.argmax(axis=1)
            said[rows] = np.array(names, object)[pick]
            if len(names) > 1:
                score[rows] *= chance[np.arange(len(rows)), pick] / (len(names) - 1)
        return said, np.clip(score, 0.0, 1.0)


def machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Weights and bias of a linear machine for y of 1 and -1: squared hinge loss, classes weighted alike, by accelerated descent."""
    x = np.hstack((x, np.ones((len(x), 1), x.dtype)))
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(x.dtype)
    w = ahead = np.zeros(x.shape[1], x.dtype)
    rate = 1 / (2 * 2.0 + penalty)  # rows are no longer than the root of two
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - rate * (penalty * ahead - 2 * x.T @ (share * y * slack))
        ahead, w = new + t / (t + 3) * (new - w), new
    return w


def fit(x: np.ndarray, languages: list[str], family_of: dict[str, str] = FAMILY) -> Model:
    names = np.array(languages, object)
    family = np.array([family_of.get(n, n) for n in languages], object)
    families = sorted(set(family))
    outer = [machine(x, np.where(family == f, 1.0, -1.0).astype(x.dtype)) if len(families) > 1 else np.ones(x.shape[1] + 1, x.dtype) for f in families]
    inside, inner = {f: sorted(set(names[family == f])) for f in families}, {}
    for f in families:
        rows = []
        for i, a in enumerate(inside[f]):
            for b in inside[f][i + 1 :]:
                two = (names == a) | (names == b)
                rows.append(machine(x[two], np.where(names[two] == a, 1.0, -1.0).astype(x.dtype)))
        inner[f] = np.array(rows).reshape(-1, x.shape[1] + 1)
    return Model(families, np.array(outer), inside, inner)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, total: int = TOTAL, least: int = LEAST) -> Model | None:
    """Fits on a sample of the rows whose text and lang aren't null; None if there is none."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    count = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not count:
        return None
    sample = min(sample, max(total // len(count), least))
    rows = rows.withColumn("at", F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30)) / (1 << 30)).drop("key")
    shares = docs.sparkSession.createDataFrame([(name, max(1.2 * sample, sample + 20) / n) for name, n in count.items()], "lang string, share double")
    chosen = rows.join(F.broadcast(shares), "lang").where("at < share")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(0), BYTES):
                x, ok = features(b), lettered(b)
                packed = pa.array([r.astype(np.float16).tobytes() if k else None for r, k in zip(x, ok, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(b.first, len(b)) for i in (1, 2)), packed], ["lang", "at", "x"])

    got = chosen.select("text", "lang", "at").mapInArrow(run, "lang string, at double, x binary").where("x IS NOT NULL").toPandas()
    got = got.sort_values(["lang", "at", "x"]).groupby("lang", sort=False).head(sample)
    return fit(np.array([np.frombuffer(x, np.float16) for x in got["x"]], np.float32), list(got["lang"])) if len(got) else None


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, in place of columns of those names."""
    docs = docs.drop("lang_pred", "score")
    place, schema = docs.columns.index(text), docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(place), BYTES):
                said, score = np.full(len(b), UND, object), np.zeros(len(b))
                ok = lettered(b)
                if model is not None and ok.any():
                    got, s = model.predict(features(b))
                    said[ok], score[ok] = got[ok], s[ok]
                part = batch.slice(b.first, len(b))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said, pa.string()), pa.array(score)], [f.name for f in schema])

    return docs.mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: a language for every document, learned from those with crc32(doc_id) mod 4 other than 2."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")
