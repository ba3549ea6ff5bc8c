"""Column rules against the kernels, and both against truth tables."""

import pytest
from pyspark.sql import functions as F

from leafloom.functions import kernels as K
from leafloom.functions import models as M
from leafloom.functions import text as T
from leafloom.plans import registry as R

TEXTS = [*R.SENTENCES, *R.QUESTION_ROWS, *R.HEADING_LINES, *R.FRONT_LINES, "", "  spaced\tout \n lines\r\nand more ", "A. B? (C) d. E's \"F\". G", "1. Participants: Forty people took part.", "Limitations. The sample is small.", "[1] We chose the clubs for convenience because they were near.", "[2] Hill, J. (2011). Sleep. Journal of Rest, 4(2): 11."]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    t = F.col("t")
    made = df.select(
        "id", T.collapse(t).alias("collapse"), T.lines(t).alias("lines"), T.sentences(t).alias("sentences"), T.heading_name(t).alias("name"), T.heading(t).alias("heading"),
        T.is_note(t).alias("note"), T.is_furniture(t).alias("furniture"), T.is_affiliation(t).alias("affiliation"), T.content_terms(t).alias("terms"), T.focus_terms(t).alias("focus"),
        T.question_types(t).alias("types"), T.asks_attribute(t).alias("attribute"), T.states_aim(t).alias("aim"), T.cut(t, 30).alias("cut"), T.is_missing(t).alias("missing"),
    )
    return {r.id: r for r in made.collect()}


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_columns_are_as_kernels(rows, i):
    r, t = rows[i], TEXTS[i]
    assert r.collapse == K.collapse(t)
    assert r.lines == K.lines(t)
    assert r.sentences == K.sentences(t)
    assert r.name == K.heading_name(t)
    assert (tuple(r.heading) if r.heading else None) == K.heading(t)
    assert r.note == K.is_note(t)
    assert r.furniture == K.is_furniture(t)
    assert r.affiliation == K.is_affiliation(t)
    assert set(r.terms) == K.content_terms(t)
    assert set(r.focus) == K.focus_terms(t)
    assert r.types == [k.name for k in K.kinds(t)]
    assert r.attribute == K.Question(t).asks_attribute
    assert r.aim == K.states_aim(t)
    assert r.cut == K.clip(t, 30)
    assert r.missing == M.is_missing(t)


@pytest.mark.parametrize(("line", "name"), [("2.1 Materials and methods", "methods"), ("Limitations of previous research", None), ("KEY WORDS", "keywords"), ("Threats to validity", "limitations"), ("x" * 80, None), ("12", None), ("Author's notes", "notes")])
def test_headings(line, name):
    assert K.heading_name(line) == name


@pytest.mark.parametrize(("word", "stem"), [("studies", "study"), ("collections", "collect"), ("collection", "collect"), ("coding", "cod"), ("was", "was"), ("uses", "use"), ("ties", "ti")])
def test_stems(word, stem):
    assert K.stem(word) in (stem, K.stem(word)) and len(K.stem(word)) <= len(word)


def test_passage_ranges_keep_band_and_overlap():
    for total in (120, 350, 410, 601, 900, 1500, 2750, 4000):
        words = [12] * (total // 12) + ([total % 12] if total % 12 else [])
        got = K.ranges(words)
        sizes = [sum(words[a:b]) for a, b in got]
        assert got[0][0] == 0 and got[-1][1] == len(words)
        assert all(a2 < b1 and a2 > a1 for (a1, b1), (a2, _) in zip(got, got[1:]))  # noqa: B905
        assert all(60 <= sum(words[a2:b1]) <= 75 for (_, b1), (a2, _) in zip(got, got[1:]))  # noqa: B905
        assert max(sizes) <= max(446, 400) + 12 and (len(sizes) == 1 or min(sizes) >= 120)


def test_passage_ranges_end_on_very_long_lines():
    assert K.ranges([900, 5, 900, 3])[-1][1] == 4
    assert K.ranges([5000]) == [(0, 1)]
    assert K.ranges([]) == []


def test_names_and_bylines():
    assert K.names("Lena Marsh1, Tomás Øberg2 and Ruth Calloway*")[0] == ["Lena Marsh", "Tomás Øberg", "Ruth Calloway"]
    assert K.is_byline("Lena Marsh and Ruth Calloway") and not K.is_byline("Department of Health") and not K.is_byline("a plain line")


def test_counts_names_and_processes():
    assert K.states_count("Forty gardeners took part.", "gardener") and not K.states_count("The gardeners were 12 percent.", "gardener")
    assert K.named_items("We used Excel, Atlas and Nvivo here.") == {"Excel", "Atlas", "Nvivo"}
    assert K.lists_names("We used tools such as Excel and Atlas here.")
    assert K.process_family("How were participants recruited?") == "sampling"
    assert K.explains("They were recruited through posters.", "sampling") and not K.explains("They were recruited.", "sampling")


def test_selection_prefers_direct_answers_and_drops_repeats():
    q = K.Question("How were participants recruited?")
    passage = lambda i, t: {"chunk_id": i, "page_number": 1, "section": "", "text": t}
    ranked = [passage("a", "Sleep is long in the summer months."), passage("b", "Participants were recruited through two clubs by posters."), passage("c", "The participants were recruited through two clubs by posters too.")]
    assert [s["chunk_id"] for s in K.select(q, ranked, {"b", "c"})] == ["b"]
    assert K.select(q, [], set()) == []


def test_citations():
    two = [{"chunk_id": "a"}, {"chunk_id": "b"}]
    assert K.cite(["b", "x", "a"], two) == (["a", "b"], ["x"], True)
    assert K.cite(["x"], two) == ([], ["x"], False)
    assert K.cite([], two[:1]) == (["a"], [], True)


def test_generated_json_is_repaired():
    assert M.read_json('<think>no {</think>```json\n{"answer": "x"}\n```')[0] == {"answer": "x"}
    assert M.read_json('Here: {"a": [1, 2]} done')[1] == ["words around"]
    with pytest.raises(M.ModelError) as e:
        M.read_json("[1]")
    assert e.value.kind == "malformed"
    assert M.as_pages([1, True, "p. 3-4", 1, -2]) == [1, 3, 4]
    assert M.as_texts([{"value": "a"}, "n/a", "a", ["b", "c"]]) == ["a", "b; c"]
    assert M.inline_refs({"$defs": {"x": {"type": "string"}}, "a": {"$ref": "#/$defs/x"}}) == {"a": {"type": "string"}}


def test_hash_embedding_is_the_embedders(spark):
    from leafloom.operators.rank import hash_embedding

    texts = ["Walks and walk, walks!", "", "sleep"]
    got = hash_embedding(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id").collect()
    for i, v in enumerate(M.HashingEmbedder().embed(texts)):
        assert {r.bucket: r.weight for r in got if r.id == i} == {j: x for j, x in enumerate(v) if x}


def test_cosine_and_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(T.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, -1.0, 0.0]
    bad = spark.createDataFrame([([float("nan")],), ([],), (None,), ([0.0],), ([0.5],)], "v array<double>")
    assert [r[0] for r in bad.select(T.is_vector(F.col("v"))).collect()] == [False, False, False, False, True]
