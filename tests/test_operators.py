"""Operators on the sample paper, sources, ingest and rules on summaries."""

import json

import pytest
from pyspark.sql import functions as F

from leafloom.operators import answer, condense, evaluate, packages, rank, segment, summary
from leafloom.sources import pages as S
from leafloom.sources import samples


@pytest.fixture(scope="module")
def pages(spark):
    return samples.pages(spark).cache()


def test_sections_and_notes(pages):
    got = {r.name: r for r in segment.sections(pages).collect()}
    assert got["notes"].text.startswith("[1]") and got["findings"].pages == [5]
    assert "orchard" not in " ".join(r.text for r in got.values()).lower()


def test_passages_are_stable_and_in_place(pages):
    a, b = ({r.chunk_id: r for r in segment.passages(pages).collect()} for _ in range(2))
    text = {r.page_number: r.text for r in pages.collect()}
    assert a == b
    assert all(" ".join(text[r.page_number][r.start_char : r.end_char].split()).endswith(r.text[-20:]) for r in a.values())


def test_hints(pages):
    h = segment.hints(pages).first()
    assert h.title_candidates[0].startswith("Evening Walking") and h.title_confidence == "high" and h.author_candidates == ["Lena Marsh, Tomás Øberg and Ruth Calloway"]


def test_limitations_are_the_papers_own(pages):
    got = packages.limitations(segment.sections(pages)).first()
    assert got.pages == [7] and len(got.sentences) == 2 and not any("We found" in s for s in got.sentences)


def test_question_set(spark, pages):
    rows, m = evaluate.evaluate(samples.cases(spark), pages)
    assert m.first().accuracy == 1.0 and m.first().false_positives == 0


def test_abstention_never_generates(spark, pages):
    class Fails:
        def generate(self, prompt):
            raise AssertionError("called")

    q = samples.cases(spark).where("NOT expected_answerable")
    got = answer.ask(q, pages, generator=Fails())["answers"].collect()
    assert len(got) == 2 and not any(r.generation_called for r in got)


def test_invented_citations_are_discarded(spark, pages):
    class Invents:
        def generate(self, prompt):
            return json.dumps({"answer": "x", "used_chunk_ids": ["p9999-nothing"]})

    got = answer.ask(samples.cases(spark).where("question_id = 1"), pages, generator=Invents())["answers"].first()
    assert got.status == "not_supported" and got.sources == []


def test_empty_inputs(spark, pages):
    none = pages.limit(0)
    assert segment.passages(none).count() == 0 and segment.running_heads(none).count() == 0
    blank = spark.createDataFrame([("x", 1, None)], "doc_id string, page_number int, text string")
    assert segment.document_envelope(blank).first().status == 422
    got = answer.ask(samples.cases(spark).withColumn("doc_id", F.lit("x")), blank)["answers"].collect()
    assert len(got) == 8 and {r.status for r in got} == {"not_supported"}


def test_ranks_break_ties_by_place(spark):
    c = spark.createDataFrame([("d", f"c{i}", 9 - i, "s", "one two three four five six seven eight", i, [1.0, 0.0]) for i in range(4)], "doc_id string, chunk_id string, page_number int, section string, text string, start_char int, embedding array<double>")
    q = spark.createDataFrame([(1, "d", [1.0, 0.0])], "question_id int, doc_id string, embedding array<double>")
    assert [r.chunk_id for r in rank.rank(q, c, 2).orderBy("rank").collect()] == ["c3", "c2"]
    assert rank.rank(q, c, 0).count() == 0


def test_findings_collapse_and_limits_split(spark):
    df = spark.createDataFrame([(["Walkers slept much longer at night.", "Walkers slept much longer at night than others.", "Clubs should act.", "Company mattered most."], ["the sample was small and local"])], "f array<string>, s array<string>")
    r = df.select(summary.tighten(F.col("f"), F.array()).alias("f"), summary.attributable(F.lit("a small local sample"), F.col("s")).alias("a"), summary.keeps_meaning(F.lit("walkers slept"), F.lit("did walkers sleep well")).alias("k")).first()
    assert r.f == ["Walkers slept much longer at night than others.", "Company mattered most."] and r.a and r.k


def test_summary_uses_drafts_where_they_say_something(spark, pages):
    drafts = spark.createDataFrame([("gardeners", "n/a", "Sleep was studied.", ["Walkers slept longer in both of the towns."])], "doc_id string, title string, background string, key_findings array<string>")
    r = summary.summaries(pages, drafts).first()
    assert r.title.startswith("Evening") and r.background == "Sleep was studied." and r.key_findings == ["Walkers slept longer in both of the towns."] and r.source_pages.methods == [4]


def test_condensers(spark):
    df = spark.createDataFrame([("Forty nurses took part. They were recruited by post. The mean age was 44.5 years.",), ("",), ("Plain words. More plain words.",)], "t string")
    got = [r[0] for r in df.select(condense.participants(F.col("t"))).collect()]
    assert got[0].startswith("Forty nurses") and "recruited by post" in got[0] and got[1] == "" and got[2] == "Plain words. More plain words."
    assert df.select(condense.research_question(F.col("t"))).first()[0] == condense.NO_QUESTION


def test_upload_gate_and_parser(spark):
    files = spark.createDataFrame([("/a.pdf", 3, b"abc"), ("/b.txt", 3, b"abc"), ("/c.pdf", 0, b""), ("/d.pdf", S.MOST_BYTES + 1, b"x"), ("/e.pdf", 1, b"!")], "path string, length long, content binary")

    def parse(content):
        if content == b"!":
            raise ValueError("broken")
        return [content.decode(), "two"]

    good, bad = S.pages_from_files(files, parse)
    assert [(r.doc_id, r.page_number) for r in good.orderBy("page_number").collect()] == [("/a.pdf", 1), ("/a.pdf", 2)]
    assert {r.path: r.status for r in bad.collect()} == {"/b.txt": 400, "/c.pdf": 400, "/d.pdf": 413, "/e.pdf": 400}


def test_evaluation_files(spark, tmp_path):
    (tmp_path / "paper_a.json").write_text(json.dumps({"questions": [{"question": "Q?", "expected_answerable": True}]}))
    r = S.evaluation_set(spark, str(tmp_path)).first()
    assert (r.paper, r.expected_pages) == ("paper_a", [])
    with pytest.raises(S.EvaluationError, match="question 1"):
        S.check_evaluation('{"questions": [{"question": "Q?"}]}')
    requests = spark.createDataFrame([(" ", [(1, "x")], 5), ("q", [(1, " ")], 5), ("q", [(1, "x")], 21), ("q", [(1, "x")], None)], "question string, pages array<struct<page_number:int,text:string>>, top_k int")
    assert [r.status for r in S.request_status(requests).collect()] == [422, 422, 422, 200]


def test_stream_of_pages(spark, pages, tmp_path):
    from leafloom.streaming import ingest

    pages.write.parquet(str(tmp_path / "in"))
    q = ingest.ingest(ingest.page_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == segment.passages(pages).count()
