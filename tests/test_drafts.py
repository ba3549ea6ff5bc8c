"""Drafts by scripted generators, and endpoints' answers."""

import json

import pytest
from pyspark.sql import functions as F

from leafloom.functions.models import ModelError
from leafloom.operators import answer, drafts, packages, rank, segment, summary
from leafloom.sources import endpoints, samples


class Scripted:
    def __init__(self, **parts):
        self.parts = parts

    def generate(self, prompt):
        reply = next((v for k, v in self.parts.items() if k in prompt), None)
        if isinstance(reply, ModelError):
            raise reply
        return reply if isinstance(reply, str) else json.dumps(reply)


def test_drafts_and_useless_drafts_give_the_same_fields(spark):
    pages = samples.pages(spark)
    found = packages.packages(segment.sections(pages))
    good = Scripted(Summarise={"research_question": {"value": "Do walks help?"}, "key_findings": ["Walkers slept longer than others."], "authors": "n/a"})
    useless = Scripted(Summarise="no json here")
    a, b = (drafts.condense(found, g) for g in (good, useless))
    assert b.first().error_kind == "malformed"
    s, t = (summary.summaries(pages, d.where("error_kind IS NULL").drop("error_kind", "error", "group_no", "source_pages")).first() for d in (a, b))
    assert s.research_question == "Do walks help?" and t.research_question.startswith("Does evening walking") and s.missing_fields == t.missing_fields == []


def test_groups_are_drafted_where_fields_are_missing_and_reduced(spark):
    pages = spark.createDataFrame([("x", 1, "Plain words without any heading."), ("x", 2, "More of them.")], "doc_id string, page_number int, text string")
    need = packages.uncovered(pages, packages.packages(segment.sections(pages)))
    g = Scripted(**{"From these pages": {"methods": "We asked people.", "source_pages": ["p. 2"]}, "Merge these": {"methods": "People were asked."}})
    mapped = drafts.from_groups(segment.page_groups(pages, 20, 1), need, summary.render_hints(segment.hints(pages)), g)
    assert [r.source_pages for r in mapped.collect()] == [[2], [2]]
    assert drafts.reduce(mapped, g).first().methods == "People were asked."
    down = drafts.from_groups(segment.page_groups(pages), need, summary.render_hints(segment.hints(pages)), Scripted(**{"From": ModelError("down", 503, "transport")}))
    assert down.first().error_kind == "transport" and drafts.reduce(down, g).count() == 0


def test_questions_are_repaired_once(spark):
    made = spark.createDataFrame([("a", "walking and sleep among gardeners"), ("b", "Is it so?"), ("c", "walking and sleep")], "doc_id string, research_question string")
    g = Scripted(**{"among gardeners": {"value": "Does walking go with sleep among gardeners?"}, "walking": {"value": "Entirely different matters concern which other people there?"}})
    got = {r.doc_id: r.research_question for r in drafts.repaired_question(made, g, "none").collect()}
    assert got == {"a": "Does walking go with sleep among gardeners?", "b": "Is it so?", "c": "none"}


def test_trace_and_counts(spark):
    pages = samples.pages(spark)
    got = {r.question_id: r for r in answer.trace(samples.cases(spark), pages).collect()}
    assert got["6"].rule == "missing evidence of a kind" and json.loads(got["1"].trace)["ranked"]
    assert rank.corpus_counts(segment.passages(pages)).where(F.col("considered") + F.col("excluded") == 13).count() == 1


def test_endpoints(monkeypatch):
    calls = []

    def post(url, payload, timeout):
        calls.append(payload)
        if "think" in payload:
            raise ModelError("no", 502, "refused")
        return {"response": "{}", "embeddings": [[1.0, 2.0]] * len(payload.get("input", []))}

    monkeypatch.setattr(endpoints, "post", post)
    g = endpoints.HttpGenerator("http://x", "m")
    assert g.generate("p") == g.generate("p") == "{}" and ["think" in c for c in calls] == [True, False, False]
    assert endpoints.HttpEmbedder("http://x", "m", 2).embed(["a", "b", "c"]) == [[1.0, 2.0]] * 3
    for bad in ([], [0.0], [True], [float("nan")], "x", None):
        with pytest.raises(ModelError):
            endpoints.check_vector(bad)
    with pytest.raises(ModelError) as e:
        endpoints.HttpEmbedder("http://127.0.0.1:9/x", "m").embed(["a"]) if not monkeypatch.undo() else None
    assert e.value.status in (502, 503)
