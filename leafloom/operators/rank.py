"""Eligibility, vectors, exact cosine top-k with a total order, cue re-ranking, and diagnostics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.functions import lexicon as L
from leafloom.functions import text as T


def with_exclusion(chunks: DataFrame) -> DataFrame:
    """chunks with `excluded`: why a passage can't be evidence, or null."""
    labelled = F.max(F.coalesce(F.trim("section") != "", F.lit(False))).over(Window.partitionBy("doc_id"))
    return chunks.withColumn("excluded", T.exclusion(F.col("section"), F.col("text"), F.col("page_number"), labelled))


def exclusion_summary(chunks: DataFrame) -> DataFrame:
    return with_exclusion(chunks).where("excluded IS NOT NULL").groupBy("doc_id", "excluded").agg(F.count("*").alias("n"))


def hash_embedding(df: DataFrame, key: str, text: str = "text", width: int = 512) -> DataFrame:
    """key, bucket, weight: the sparse form of hashed bags of words. A text without words has 0.001 in bucket 0."""
    rows = df.select(F.col(key), F.explode_outer(T.bag_tokens(F.col(text))).alias("token"))
    bucket = F.when(F.col("token").isNull(), 0).otherwise(T.bucket(F.col("token"), width))
    return rows.groupBy(key, bucket.alias("bucket")).agg((F.count("token") + F.when(F.count("token") == 0, 0.001).otherwise(0.0)).alias("weight"))


def embed(df: DataFrame, embedder, text: str = "text", column: str = "embedding") -> DataFrame:
    """df with vectors by an embedder (see leafloom.functions.models), in batches, as a column."""

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series(embedder.embed(texts.fillna("").tolist()))

    return df.withColumn(column, vectors(F.col(text)))


def valid(embedded: DataFrame, column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows with a usable vector, the others with `reason`): finite numbers, not all zero, and of the dimension that most rows have."""
    size = embedded.where(T.is_vector(F.col(column))).groupBy(F.size(column).alias("_size")).agg(F.count("*").alias("_n"))
    size = size.agg(F.max_by("_size", F.struct("_n", "_size")).alias("_size"))  # one row
    rows = embedded.crossJoin(F.broadcast(size))
    reason = F.when(F.col(column).isNull(), "no vector").when(~T.is_vector(F.col(column)), "not finite, or all zero").when(F.size(column) != F.col("_size"), "of another dimension")
    rows = rows.withColumn("reason", reason).drop("_size")
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL")


def order() -> list[Column]:
    """Rounded scores, then page, place and id."""
    return [F.round("score", 12).desc(), F.col("page_number"), F.col("start_char"), F.col("chunk_id")]


#: Vectors of a block, of either side, about.
BLOCK = 2_000


def _blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """doc_id and the number of blocks that its rows make."""
    return rows.groupBy("doc_id").agg(F.ceil(F.count("*") / size).cast("int").alias(key))


def rank(questions: DataFrame, chunks: DataFrame, k: int, question: str = "embedding", size: int = BLOCK) -> DataFrame:
    """question_id, chunk columns (without vector), score, rank from 1: the k eligible passages of its document that are closest to each question.

    A document's questions and passages are dealt to blocks, and each pair of blocks is one group: a product of two matrices of unit vectors, of
    which a question's best k are kept. So neither a long document nor one that many ask is one task, and what is ranked at last is k rows for each
    question and block of passages.
    """
    k, every = max(k, 1), k > 0
    eligible = with_exclusion(chunks).where("excluded IS NULL AND embedding IS NOT NULL").drop("excluded").withColumn("doc_id", F.col("doc_id").cast("string"))
    asked = questions.select("question_id", F.col("doc_id").cast("string").alias("doc_id"), F.col(question).alias("_q")).where(F.lit(every))
    parts = _blocks(asked, "_nq", size).join(_blocks(eligible, "_nc", size), "doc_id")
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(parts, "doc_id").withColumn("_bq", deal("question_id", "_nq")).withColumn("_bc", each("_nc")).drop("_nq", "_nc")
    right = eligible.join(parts, "doc_id").withColumn("_bc", deal("chunk_id", "_nc")).withColumn("_bq", each("_nq")).drop("_nq", "_nc")
    columns = [c for c in eligible.columns if c != "embedding"]
    schema = questions.select("question_id").schema
    for f in eligible.select(columns).schema:
        schema = schema.add(f)

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame(columns=[f.name for f in schema] + ["score"])
        x, y = np.stack(q["_q"]).astype(float), np.stack(c["embedding"]).astype(float)
        if x.shape[1] != y.shape[1]:
            raise ValueError("vectors of different dimensions")
        x, y = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), np.finfo(float).tiny) for v in (x, y))
        score = np.clip(x @ y.T, -1.0, 1.0)
        then = np.lexsort((c["chunk_id"], c["start_char"], c["page_number"]))  # places of the passages on ties
        place = np.empty(len(then), np.int64)
        place[then] = np.arange(len(then))
        best = np.stack([np.lexsort((place, -np.round(s, 12)))[:k] for s in score])
        rows = c.iloc[best.ravel()][columns].reset_index(drop=True)
        rows.insert(0, "question_id", np.repeat(q["question_id"].to_numpy(), best.shape[1]))
        return rows.assign(score=np.take_along_axis(score, best, 1).ravel())

    schema = schema.add("score", "double")
    scored = left.groupBy("doc_id", "_bq", "_bc").cogroup(right.groupBy("doc_id", "_bq", "_bc")).applyInPandas(run, schema)
    by = Window.partitionBy("question_id").orderBy(*order())
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def with_diagnostics(ranked: DataFrame, k: int) -> DataFrame:
    """ranked with top_score, second_score, score_gap and mean_top_k of its question, in the same shuffle as the ranks."""
    own = Window.partitionBy("question_id")
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("score"))).over(own)
    rows = ranked.withColumns({"top_score": at(1), "second_score": at(2), "mean_top_k": F.avg(F.when(F.col("rank") <= k, F.col("score"))).over(own)})
    return rows.withColumn("score_gap", F.col("top_score") - F.col("second_score"))


def diagnostics(ranked: DataFrame, k: int) -> DataFrame:
    """returned, top_score, second_score, score_gap and mean_top_k of each question; null where there is none."""
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("score")))
    rows = ranked.groupBy("question_id").agg(F.count_if(F.col("rank") <= k).alias("returned"), at(1).alias("top_score"), at(2).alias("second_score"), F.avg(F.when(F.col("rank") <= k, F.col("score"))).alias("mean_top_k"))
    return rows.withColumn("score_gap", F.col("top_score") - F.col("second_score"))


def cue_columns(question: Column, text: Column) -> Column:
    """Whether a passage shows what a precise kind of question asks for."""
    noun = F.lower(F.regexp_extract(question, T.unicode(next(cue for name, _, _, cue, _ in L.QUESTION_TYPES if name == "instrument")), 1))
    checks = []
    for name, _, precise, cue, evidence in L.QUESTION_TYPES:
        if precise:
            shown = T.states_aim(text) if evidence is None else T.found(text, evidence)
            if name == "instrument":
                shown = shown & F.array_contains(T.content_terms(text), T.stem(noun))
            checks.append(F.when(T.found(question, cue), shown))
    return F.coalesce(F.greatest(*checks), F.lit(False))


def rerank(ranked: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """Passages that show what the question asks for come first, each part in its order; then the first k. `rank` is the new one
    and `cosine_rank` the old."""
    rows = ranked.join(questions.select("question_id", "question"), "question_id")
    text = F.concat_ws(" ", "text", F.translate(F.coalesce("section", F.lit("")), "_", " "))
    rows = rows.withColumn("cue", cue_columns(F.col("question"), text)).withColumnRenamed("rank", "cosine_rank")
    by = Window.partitionBy("question_id").orderBy(F.col("cue").desc(), "cosine_rank")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def pool(k: int, floor: int = 20, times: int = 4) -> int:
    return max(floor, times * k)


def term_coverage(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """question_id, chunk_id, coverage, matched."""
    terms = questions.select("question_id", T.content_terms(F.col("question")).alias("_terms"))
    rows = ranked.join(terms, "question_id").withColumn("_have", T.content_terms(F.concat_ws(" ", "text", F.translate("section", "_", " "))))
    return rows.select("question_id", "chunk_id", T.coverage(F.col("_terms"), F.col("_have")).alias("coverage"), F.array_intersect("_terms", "_have").alias("matched"))


def corpus_counts(chunks: DataFrame) -> DataFrame:
    """considered, excluded and excluded_by_reason of each document's passages."""
    by = with_exclusion(chunks).groupBy("doc_id", "excluded").agg(F.count("*").cast("int").alias("n"))
    reasons = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("excluded").isNotNull(), F.struct("excluded", "n")))))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("int")
    return by.groupBy("doc_id").agg(count(F.col("excluded").isNull()).alias("considered"), count(F.col("excluded").isNotNull()).alias("excluded"), reasons.alias("excluded_by_reason"))
