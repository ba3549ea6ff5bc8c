"""From questions and pages to verdicts, cited evidence and answers, or abstention.

Verdicts, spans and citations of a question depend on its ranked passages in order: a group is one question's passages, at most the pool's
size. Each question is embedded and its kinds are found once.
"""

from __future__ import annotations

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.functions import kernels as K
from leafloom.functions import models as M
from leafloom.operators import rank as R
from leafloom.operators import segment

VERDICTS = "question_id string, status string, reason string, supporting_chunk_ids array<string>, supporting_pages array<int>, evidence_count int, question_types array<string>, missing_evidence array<string>, matched_terms array<string>"
SOURCES = "array<struct<page:int,chunk_id:string,evidence:string,section:string>>"
ANSWERS = f"question_id string, status string, answer string, sources {SOURCES}, confidence_note string, selected_chunk_ids array<string>, cited_pages array<int>, generation_called boolean, error string"
NO_ANSWER = "The document does not give enough evidence to answer this question."
UNATTRIBUTABLE = "An answer was made, but it could not be traced to the supplied passages."
NOTES = {"supported": "Backed by several passages.", "partially_supported": "Backed only in part; read the cited pages.", "not_supported": "No answer was given, because the evidence does not support one."}


def _grouped(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row a question, with its passages in order; questions without passages too."""
    chunk = F.struct("rank", "chunk_id", F.col("page_number").cast("int").alias("page_number"), "section", "text", "score")
    by = ranked.groupBy("question_id").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))
    return questions.select(F.col("question_id").cast("string").alias("question_id"), "question").join(by.withColumn("question_id", F.col("question_id").cast("string")), "question_id", "left")


def _chunks(value) -> list[dict]:
    return [] if value is None else [c.asDict() if hasattr(c, "asDict") else dict(c) for c in value]


def verdicts(questions: DataFrame, ranked: DataFrame, stats: DataFrame) -> DataFrame:
    """A verdict for each question on its ranked passages, with the retrieval's figures beside it."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                none = lambda x: None if pd.isna(x) else float(x)
                v = K.verdict(K.Question(r.question or ""), _chunks(r.chunks), none(r.top_score), none(r.score_gap))
                ids = [c["chunk_id"] for c in v["supporting"]]
                out.append((r.question_id, v["status"], v["reason"], ids, sorted({c["page_number"] for c in v["supporting"]}), len(ids), v["types"], v["missing"], v["matched"]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in VERDICTS.split(", ")])

    figures = stats.withColumn("question_id", F.col("question_id").cast("string"))
    rows = _grouped(questions, ranked).join(figures.select("question_id", "top_score", "score_gap"), "question_id", "left")
    return rows.mapInPandas(run, VERDICTS).join(figures, "question_id", "left")


def select_evidence(questions: DataFrame, ranked: DataFrame, found: DataFrame, limit: int = 4) -> DataFrame:
    """question_id, place, chunk_id, page_number, section, span, score: what is cited for questions that aren't unsupported."""
    rows = _grouped(questions, ranked).join(found.where("status <> 'not_supported'").select("question_id", "supporting_chunk_ids"), "question_id")

    def run(batches):
        for pdf in batches:
            out = [(r.question_id, i, s["chunk_id"], s["page_number"], s["section"], s["span"], float(s["score"])) for r in pdf.itertuples() for i, s in enumerate(K.select(K.Question(r.question or ""), _chunks(r.chunks), set(r.supporting_chunk_ids), limit))]
            yield pd.DataFrame(out, columns=["question_id", "place", "chunk_id", "page_number", "section", "span", "score"])

    return rows.mapInPandas(run, "question_id string, place int, chunk_id string, page_number int, section string, span string, score double")


def answers(questions: DataFrame, found: DataFrame, selected: DataFrame, generator: M.Generator | None = None, snippet: int = 320) -> DataFrame:
    """Answers whose sources were all supplied; others are discarded. The generator runs for supported questions with evidence only: the
    rest never reach it."""
    generator = generator or M.ExtractiveGenerator()
    evidence = selected.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("place", "chunk_id", "page_number", "section", "span"))).alias("evidence"))
    asked = questions.select(F.col("question_id").cast("string").alias("question_id"), "question").join(found.select("question_id", "status"), "question_id")
    columns = ["question_id", "status", "answer", "sources", "confidence_note", "selected_chunk_ids", "cited_pages", "generation_called", "error"]

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                given = _chunks(r.evidence)
                ids = [e["chunk_id"] for e in given]
                no = (r.question_id, "not_supported", UNATTRIBUTABLE, [], NOTES["not_supported"], ids, [], True)
                try:
                    made, _ = M.read_json(generator.generate(M.prompt(r.question, given, r.status == "partially_supported")))
                    if not (text := M.as_text(made.get("answer"))):
                        raise M.ModelError("the answer is empty")
                except M.ModelError as e:
                    out.append((*no, f"{e.status}: {e}"))
                    continue
                known, _, traced = K.cite([str(i) for i in made.get("used_chunk_ids") or []], given)
                if not traced:
                    out.append((*no, None))
                    continue
                used = [e for e in given if e["chunk_id"] in known]
                sources = [{"page": e["page_number"], "chunk_id": e["chunk_id"], "evidence": K.clip(e["span"], snippet), "section": e["section"]} for e in used]
                out.append((r.question_id, r.status, text, sources, NOTES[r.status], ids, sorted({e["page_number"] for e in used}), True, None))
            yield pd.DataFrame(out, columns=columns)

    rows = asked.join(evidence, "question_id", "left")
    can = (F.col("status") != "not_supported") & F.col("evidence").isNotNull()
    ready = rows.where(can).mapInPandas(run, ANSWERS)
    empty = {"status": F.lit("not_supported"), "answer": F.lit(NO_ANSWER), "sources": F.array().cast(SOURCES), "confidence_note": F.lit(NOTES["not_supported"]), "selected_chunk_ids": F.array().cast("array<string>"), "cited_pages": F.array().cast("array<int>"), "generation_called": F.lit(False), "error": F.lit(None).cast("string")}
    return ready.unionByName(rows.where(~can).select("question_id", *[v.alias(k) for k, v in empty.items()]))


def ask(questions: DataFrame, pages: DataFrame, k: int = 5, embedder: M.Embedder | None = None, generator: M.Generator | None = None, wider: int = 12, limit: int = 4) -> dict[str, DataFrame]:
    """All stages for questions (question_id, doc_id, question) on pages: chunks, ranked, diagnostics, verdicts, selected, answers.

    One ranking serves both pools: the verdict's, cut to k, and the wider one that evidence is selected from. What several results are made of is
    persisted, on disk where memory ends; release() lets go of it.
    """
    embedder = embedder or M.HashingEmbedder()
    chunks = segment.passages(pages)
    asked = R.embed(questions.withColumn("doc_id", F.col("doc_id").cast("string")), embedder, "question")
    most = max(k, wider)
    ranked = R.rank(asked, R.embed(chunks, embedder), R.pool(most)).persist(StorageLevel.MEMORY_AND_DISK)
    asked = asked.drop("embedding").persist(StorageLevel.MEMORY_AND_DISK)
    narrow = R.rerank(ranked.where(F.col("rank") <= R.pool(k)), asked, k).persist(StorageLevel.MEMORY_AND_DISK)
    wide = R.rerank(ranked, asked, most)
    scores = R.diagnostics(ranked, 2).drop("mean_top_k", "returned").join(narrow.groupBy("question_id").agg(F.count("*").alias("returned"), F.avg("score").alias("mean_top_k")), "question_id")
    found = verdicts(asked, narrow, scores).persist(StorageLevel.MEMORY_AND_DISK)
    selected = select_evidence(asked, wide, found, limit).persist(StorageLevel.MEMORY_AND_DISK)
    made = {"chunks": chunks, "ranked": narrow, "diagnostics": scores, "verdicts": found, "selected": selected, "answers": answers(asked, found, selected, generator)}
    return made | {"pool": ranked, "asked": asked}


def release(made: dict[str, DataFrame]) -> None:
    for df in made.values():
        df.unpersist()


def sources_by_page(made: DataFrame) -> DataFrame:
    """question_id, page, sections and excerpts of the answers' sources, in order of first use."""
    rows = made.select("question_id", F.posexplode("sources").alias("pos", "s")).select("question_id", "pos", "s.*")
    name = F.when(F.col("section") != "", F.concat(F.upper(F.substring("section", 1, 1)), F.translate(F.substring(F.col("section"), F.lit(2), F.length("section")), "_", " ")))
    by = rows.groupBy("question_id", "page").agg(F.min("pos").alias("first"), F.array_sort(F.collect_set(name)).alias("sections"), F.array_sort(F.collect_list(F.struct("pos", "evidence"))).alias("e"))
    return by.select("question_id", "page", "first", "sections", F.transform("e", lambda x: x["evidence"]).alias("excerpts"))


def responsible_rule(reason):
    """The gate of the verdict that gives such a reason."""
    rules = (("No eligible", "no passages"), ("topically related", "missing evidence of a kind"), ("never report", "attribute not reported"), ("too short", "too few terms"), ("weak indirect", "no supporting passage"), ("close to noise", "low scores"), ("A single passage", "one supporting passage"), ("Relevant evidence", "corroborated"))
    choice = None
    for part, name in rules:
        choice = F.when(F.contains(reason, F.lit(part)), name) if choice is None else choice.when(F.contains(reason, F.lit(part)), name)
    return choice.otherwise("unknown")


def trace(questions: DataFrame, pages: DataFrame, k: int = 5, **models) -> DataFrame:
    """question_id, rule and trace: all that led to a verdict and its evidence as JSON, short of generating."""
    made = ask(questions, pages, k, **models)
    short = lambda c: F.when(F.length(c) <= 160, F.col(c)).otherwise(F.concat(F.substring(c, 1, 159), F.lit("…")))  # noqa: E731  of one length
    listed = lambda df, order, *cols: df.groupBy(F.col("question_id").cast("string").alias("question_id")).agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias("rows"))
    ranks = listed(made["ranked"], "rank", "cosine_rank", "cue", "chunk_id", "page_number", "section", F.round("score", 6).alias("score"), short("text").alias("text")).withColumnRenamed("rows", "ranked")
    picked = listed(made["selected"], "place", "chunk_id", "page_number", short("span").alias("span")).withColumnRenamed("rows", "selected")
    rows = made["verdicts"].join(ranks, "question_id", "left").join(picked, "question_id", "left")
    return rows.select("question_id", responsible_rule(F.col("reason")).alias("rule"), F.to_json(F.struct(*[c for c in rows.columns if c != "question_id"])).alias("trace"))
