"""Drafts of summaries by a generator: from packages where sections were recognised, else from groups of pages, then reduced to one.

Rows reach a generator only where they need it. A malformed answer loses its row (error_kind tells), an answer that can't be had
raises no exception either but keeps its error for the caller, and what no draft covers is condensed later by leafloom.operators.summary.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.functions import models as M
from leafloom.functions import text as T
from leafloom.operators.summary import keeps_meaning

#: Texts and lists of a draft, and what the reduced one has to have.
TEXTS = ("title", "research_question", "background", "methods", "participants_or_data", "plain_english_summary", "confidence_notes")
LISTS = ("authors", "key_findings", "author_stated_limitations", "model_identified_considerations")
REQUIRED = ("title", "authors", "research_question", "background", "methods", "participants_or_data", "key_findings", "author_stated_limitations", "model_identified_considerations", "plain_english_summary", "confidence_notes", "source_pages")
SCHEMA = "doc_id string, " + ", ".join(f"{t} string" for t in TEXTS) + ", " + ", ".join(f"{t} array<string>" for t in LISTS) + ", source_pages array<int>, group_no int, error_kind string, error string"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Characters of a field that a prompt holds.
FIELD_CHARS = 4000


def schema_of_draft() -> dict:
    """The JSON schema that a generator is asked to keep to."""
    text, texts = {"type": "string"}, {"type": "array", "items": {"type": "string"}}
    properties = {**dict.fromkeys(TEXTS, text), **dict.fromkeys(LISTS, texts), "source_pages": {"type": "array", "items": {"type": "integer"}}}
    properties["key_findings"] = {**texts, "maxItems": 6}
    return {"type": "object", "properties": properties, "required": list(REQUIRED)}


def _drafted(df: DataFrame, prompts: str, generator: M.Generator) -> DataFrame:
    """df has doc_id, group_no and a column of prompts."""

    def run(batches):
        for pdf in batches:
            out = []
            for doc, group, prompt in zip(pdf["doc_id"], pdf["group_no"], pdf[prompts], strict=True):
                row = dict.fromkeys(_NAMES) | {"doc_id": doc, "group_no": group}
                try:
                    got, _ = M.read_json(generator.generate(prompt))
                    row |= {t: M.as_text(got.get(t)) or None for t in TEXTS} | {t: M.as_texts(got.get(t)) for t in LISTS}
                    row |= {"source_pages": M.as_pages(got.get("source_pages"))}
                except M.ModelError as e:
                    row |= {"error_kind": e.kind, "error": f"{e.status}: {e}"}
                out.append(row)
            yield pd.DataFrame(out, columns=_NAMES)

    return df.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("group_no").cast("int").alias("group_no"), prompts).mapInPandas(run, SCHEMA)


def condense(packages: DataFrame, generator: M.Generator) -> DataFrame:
    """One draft a document, from its packages."""
    part = F.concat(F.lit("## "), F.col("field"), F.lit(" (pages "), F.array_join(F.transform("pages", lambda p: p.cast("string")), ", "), F.lit(")\n"), F.substring("text", 1, FIELD_CHARS))
    by = packages.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(part)), "\n\n").alias("said"))
    ask = F.lit("Summarise each field below from its own text alone; invent nothing. Return JSON with the fields' names.\n\n")
    return _drafted(by.select("doc_id", F.lit(0).alias("group_no"), F.concat(ask, "said").alias("prompt")), "prompt", generator)


def from_groups(groups: DataFrame, uncovered: DataFrame, hints: DataFrame, generator: M.Generator) -> DataFrame:
    """A draft for each group of pages of documents with uncovered fields, about those fields only."""
    need = uncovered.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("field")), ", ").alias("need"))
    rows = groups.join(need, "doc_id").join(hints.select("doc_id", "hints"), "doc_id", "left")
    label = F.concat(F.lit("Pages "), F.array_min("pages").cast("string"), F.lit("-"), F.array_max("pages").cast("string"))
    prompt = F.concat_ws("\n", F.concat(F.lit("From these pages alone, give as JSON: "), F.col("need")), "hints", label, "text")
    return _drafted(rows.withColumn("prompt", prompt), "prompt", generator)


def reduce(drafts: DataFrame, generator: M.Generator) -> DataFrame:
    """One draft a document, of all its groups' that aren't broken."""
    good = drafts.where("error_kind IS NULL").drop("error_kind", "error")
    by = good.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_no", F.to_json(F.struct(*[c for c in good.columns if c not in ("doc_id", "group_no")])).alias("json")))), lambda x: x["json"]), "\n").alias("notes"))
    ask = F.lit("Merge these notes on one paper into one summary, as JSON after this schema; keep to the notes.\n" + json.dumps(schema_of_draft()) + "\n")
    return _drafted(by.select("doc_id", F.lit(0).alias("group_no"), F.concat(ask, "notes").alias("prompt")), "prompt", generator)


def repaired_question(made: DataFrame, generator: M.Generator, otherwise: str) -> DataFrame:
    """made with research questions that are questions: one call where one isn't, kept only if it keeps the meaning; else `otherwise`."""
    rows = made.where(F.col("research_question").isNotNull() & ~T.is_question(F.col("research_question"))).select("doc_id", "research_question")

    def run(batches):
        for pdf in batches:
            out = []
            for doc, old in zip(pdf["doc_id"], pdf["research_question"], strict=True):
                try:
                    new = M.as_text(M.read_json(generator.generate(f"Word this as one question, with the same meaning. Return JSON with value.\n{old}"))[0])
                except M.ModelError:
                    new = ""
                out.append((doc, new))
            yield pd.DataFrame(out, columns=["doc_id", "_new"])

    old = F.col("research_question")
    fits = T.is_question(F.col("_new")) & keeps_meaning(old, F.col("_new"))
    rows = made.join(rows.mapInPandas(run, "doc_id string, _new string"), "doc_id", "left")
    return rows.withColumn("research_question", F.when(F.col("_new").isNull(), old).when(fits, F.col("_new")).otherwise(otherwise)).drop("_new")
