"""Summaries with scripted generators: order of trust, error policy, notes and their pages; containment, reuse, strict sets, sizes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from leafloom.functions import kernels as K
from leafloom.functions import models as M
from leafloom.functions import text as T
from leafloom.operators import answer, evaluate, rank, render, summarise, summary
from leafloom.sources import endpoints, samples
from leafloom.sources import pages as S

PLAIN = [("plain", i, f"Words without any heading, part {i}. More of them follow here.") for i in (1, 2)]


class Scripted:
    def __init__(self, **parts):
        self.parts = parts

    def generate(self, prompt):
        reply = next((v for k, v in self.parts.items() if k in prompt), "{}")
        if isinstance(reply, M.ModelError):
            raise reply
        return reply if isinstance(reply, str) else json.dumps(reply)


@pytest.fixture(scope="module")
def pages(spark):
    plain = spark.createDataFrame([*PLAIN, ("blank", 1, " ")], "doc_id string, page_number int, text string")
    return samples.pages(spark).select("doc_id", "page_number", "text").unionByName(plain).cache()


def test_reduce_comes_first_and_gaps_are_recovered(spark, pages):
    note = {"methods": {"value": "People kept diaries.", "evidence": "diaries", "pages": ["p. 2"]}, "title_candidates": ["A plain title"]}
    g = Scripted(Merge={"title": "Merged", "confidence_notes": "Limitations were inferred by the model. Selection bias cannot be ruled out among volunteers. Pages were clear."}, Wanted=note, Summarise={"background": "From sections.", "key_findings": ["Walkers should walk.", "Walkers slept longer than all others did."]})
    made = summarise.summarise(pages, g)
    got = {r.doc_id: r for r in made["summaries"].collect()}
    paper = next(r for d, r in got.items() if d != "plain")
    assert paper.title == got["plain"].title == "Merged" and got["plain"].methods == "People kept diaries." and got["plain"].source_pages.methods == [2]
    assert paper.background == "From sections." and paper.key_findings == ["Walkers slept longer than all others did."] and paper.research_question.startswith("Does evening walking")
    assert "Pages were clear." in paper.confidence_notes and "were inferred" not in paper.confidence_notes and any("Selection bias" in c for c in paper.model_identified_considerations)
    assert got["plain"].missing_fields == ["research_question", "background", "participants_or_data", "key_findings"] and got["plain"].chunk_count == 1
    assert [(r.doc_id, r.status) for r in made["failed"].collect()] == [("blank", 400)]


def test_malformed_answers_cost_their_rows_only(spark):
    pages = spark.createDataFrame([*PLAIN, *((d, i, "Some words on many pages. " * 300) for d in ("long",) for i in range(1, 9))], "doc_id string, page_number int, text string")
    first = summarise.summarise(pages, Scripted(**{"Pages 1-": "no json", "Wanted": {"methods": "We asked."}, "Merge": "broken"}))
    failed = {r.doc_id: r.status for r in first["failed"].collect()}
    assert failed == {"plain": 502, "long": 502}  # no section can stand for a broken summary
    second = summarise.summarise(pages, Scripted(**{"Pages 1-": "no json", "Wanted": {"methods": "We asked."}}))
    got = {r.doc_id: r for r in second["summaries"].collect()}
    assert list(got) == ["long"] and got["long"].methods == "We asked." and "Pages 1-" in got["long"].confidence_notes
    assert [r.message for r in second["failed"].collect()] == ["no group of pages gave a usable answer"]


def test_other_errors_end_the_job(spark):
    pages = spark.createDataFrame(PLAIN, "doc_id string, page_number int, text string")
    with pytest.raises(Exception, match="down"):
        summarise.summarise(pages, Scripted(Wanted=M.ModelError("down", 503, "transport")), keep=False)["summaries"].collect()


def test_notes_of_odd_answers():
    assert M.as_note({"value": {"text": "x"}, "pages": ["3", True, "p. 4-5"]}) == {"value": "x", "evidence": "", "pages": [3, 4, 5]}
    assert M.as_note("n/a") is None and M.as_note({"evidence": "only a quote"}) is None and M.as_note(["a", "b"])["value"] == "a; b"
    assert [n["value"] for n in M.as_notes({"key_findings": ["one", {"value": "two"}, None]}, {"key_findings": "key_findings"})] == ["one", "two"]


def test_passage_sizes_are_the_nearest_of_all_counts():
    def plain(z, total):
        if total <= z.most:
            return total
        size = lambda c: -(-(total + (c - 1) * z.overlap) // c)
        counts = [1, *(c for c in range(2, total + 1) if size(c) >= 2 * z.overlap)]
        return size(min(counts, key=lambda c: (abs(size(c) - z.target), c)))

    r = random.Random(5)
    assert all(K.Sizes().aim(t) == plain(K.Sizes(), t) for t in range(1, 6000, 7))
    for _ in range(300):
        z, t = K.Sizes(most=r.randint(20, 80), target=r.randint(2, 60), overlap=r.randint(2, 30)), r.randint(1, 900)
        assert z.aim(t) == plain(z, t)


def test_containment_is_that_of_all_pairs(spark):
    r = random.Random(7)
    words = lambda n: sorted({r.choice("abcdefghijklmnop") + str(r.randint(0, 3)) for _ in range(n)})
    left, right = [(i, words(r.randint(0, 12))) for i in range(60)], [(i, words(r.randint(0, 30))) for i in range(40)]
    got = evaluate.contained(spark.createDataFrame(left, "a int, words array<string>"), spark.createDataFrame(right, "b int, words array<string>"), "a", "b", 0.6)
    want = {(a, b): len(set(x) & set(y)) for a, x in left for b, y in right if x and y and len(set(x) & set(y)) / min(len(x), len(y)) >= 0.6}
    assert {(x.a, x.b): x.shared for x in got.collect()} == want and len(want) > 20


def test_blocks_rank_as_one(spark):
    r = random.Random(1)
    vector = lambda: [float(r.randint(0, 2)) for _ in range(6)]
    text = "one two three four five six seven eight"
    chunks = spark.createDataFrame([(f"d{i % 2}", f"c{i}", i % 5, "findings", text, i, vector()) for i in range(120)] + [("d0", "none", 1, "findings", text, 0, None)], "doc_id string, chunk_id string, page_number int, section string, text string, start_char int, embedding array<double>")
    asked = spark.createDataFrame([(i, f"d{i % 2}", vector()) for i in range(30)], "question_id int, doc_id string, embedding array<double>")
    plain = asked.withColumnRenamed("embedding", "q").join(chunks.where("embedding IS NOT NULL"), "doc_id").withColumn("score", T.cosine(F.col("q"), F.col("embedding")))
    want = {}
    for x in sorted(plain.collect(), key=lambda x: (x.question_id, -round(x.score, 12), x.page_number, x.start_char, x.chunk_id)):
        want.setdefault(x.question_id, []).append(x.chunk_id)
    for size in (7, 1000):
        got = {}
        for x in rank.rank(asked, chunks, 4, size=size).orderBy("question_id", "rank").collect():
            got.setdefault(x.question_id, []).append(x.chunk_id)
        assert got == {q: c[:4] for q, c in want.items()}
    assert rank.rank(asked, chunks, 0).count() == 0


def test_sets_are_checked_where_they_are_read(spark, tmp_path):
    (tmp_path / "good set.json").write_text(json.dumps({"questions": [{"question": "Who?", "expected_answerable": False}]}))
    got = S.evaluation_set(spark, f"{tmp_path}/good set.json").first()
    assert (got.paper, got.question_no, got.expected_pages) == ("good set", 0, [])
    (tmp_path / "bad.json").write_text(json.dumps({"questions": [{"question": "Who?", "expected_answerable": "no"}]}))
    with pytest.raises(Exception, match="bad.json, question 1: expected_answerable is no boolean"):
        S.evaluation_set(spark, f"{tmp_path}/bad.json").collect()


def test_sources_and_helpers(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"filename": "a.pdf", "pages": [{"page_number": 1, "text": None}, {"page_number": 2, "text": "x"}]}))
    assert [(r.doc_id, r.page_number, r.text) for r in S.pages_from_json(spark, f"{tmp_path}/r.json").collect()] == [("a.pdf", 1, ""), ("a.pdf", 2, "x")]
    asked, stored = spark.createDataFrame([("a",), ("b",), ("b",)], "document_key string"), spark.createDataFrame([("b", 1)], "document_key string, v int")
    assert tuple(S.reuse(asked, stored).first()) == (1, 1) and [d.count() for d in S.new_only(asked, stored)] == [1, 1]
    sizes = spark.createDataFrame([(1,), (1024,), (1280,), (1024 * 1000,), (3 * 1024 * 1024,), (None,)], "n long").select(S.file_size(F.col("n")))
    assert [r[0] for r in sizes.collect()] == ["1 B", "1.0 KB", "1.3 KB", "1000.0 KB", "3.0 MB", None]
    spark.conf.set("spark.leafloom.topK", "7")
    spark.conf.set("spark.leafloom.pool", "many")
    assert (S.settings(spark)["top_k"], S.settings(spark)["pool"]) == (7, 12)
    d = spark.createDataFrame([("How many walkers?", "walker rests (sleep)")], "q string, t string")
    r = d.select(T.selection_terms(F.col("q")).alias("s"), T.term_present(F.lit("walkers"), T.content_terms(F.col("t"))).alias("p"), T.overlap_tokens(F.col("t")).alias("o")).first()
    assert (r.s, r.p, r.o) == (["walker"], True, ["walker", "rests", "sleep"])


def test_refusals_are_of_one_endpoint(monkeypatch):
    seen = []

    def post(url, payload, timeout):
        seen.append((url, "think" in payload))
        if "think" in payload and url == "a":
            raise M.ModelError("no", 502, "refused")
        return {"response": "{}", "embeddings": [[1.0]] * len(payload.get("input", []))}

    monkeypatch.setattr(endpoints, "post", post)
    endpoints.forget_refusals()
    for url in ("a", "a", "b"):
        endpoints.HttpGenerator(url, "m").generate("p")
    assert seen == [("a", True), ("a", False), ("a", False), ("b", True)]
    assert endpoints.HttpEmbedder("a", "m").embed(["x", " ", "y"]) == [[1.0], None, [1.0]]


def test_what_people_read(spark, pages, tmp_path, capsys):
    from leafloom import __main__ as cli

    cards = {(r.doc_id, r.field): r for r in render.cards(summary.summaries(pages)).collect()}
    paper = next(d for d, _ in cards if d not in ("plain", "blank"))
    assert cards["plain", "author_stated_limitations"].said == render.EMPTY["author_stated_limitations"] and cards["plain", "methods"].said == "Not stated in the paper"
    assert cards[paper, "methods"].pages == "Page 4" and cards[paper, "key_findings"].pages.startswith("Pages 5, ")
    rows = spark.createDataFrame([("a " * 200, "x")], "t string, u string").select(render.snippet(F.col("t")).alias("t"), render.short(F.col("u")).alias("u")).first()
    assert len(rows.t) == 303 and rows.t.endswith("...") and rows.u == "x"
    good, bad = rank.valid(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [1.0]), (4, [0.0, 0.0]), (5, None), (6, [float("nan"), 1.0])], "id int, embedding array<double>"))
    assert {r.id for r in good.collect()} == {1, 2} and {r.id: r.reason for r in bad.collect()}[3] == "of another dimension" and bad.count() == 4
    samples.pages(spark).select("doc_id", "page_number", "text").write.parquet(f"{tmp_path}/p")
    (tmp_path / "gardeners.json").write_text(json.dumps({"questions": [{"question": "How many gardeners took part in the walks?", "expected_answerable": True}]}))
    assert cli.main(["demo", f"{tmp_path}/p", f"{tmp_path}/gardeners.json"]) == 0 and cli.main(["nothing"]) == 2
    assert "Q: How many gardeners" in capsys.readouterr().out
    cases = samples.cases(spark).limit(2)
    flat = render.reports(answer.ask(cases, samples.pages(spark))["verdicts"])
    assert flat.count() == 2 and all(t in ("string", "int", "double", "bigint") for _, t in flat.dtypes)
