"""Language, licenses, audio, mixing, fingerprints, URLs and the pipeline."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafloom.llm import audio, fingerprints, language, licenses, mixing, urls

# --- language ----------------------------------------------------------------------------------------------------------

WORDS = {"en": "the of and that with from this which have been", "de": "der und die das nicht auch eine werden über für", "fr": "le les des une dans pour est que où été", "es": "el los una para con que está más también como"}


def _lang_rows(n=240):
    r = random.Random(4)
    return [(i, " ".join(r.choice(WORDS[k].split()) for _ in range(r.randint(5, 40))), k) for i in range(n) for k in [list(WORDS)[i % 4]]]


def test_held_out_languages(spark):
    d = spark.createDataFrame(_lang_rows(), "doc_id long, text string, lang string")
    held = language.held_out(F.col("doc_id"))
    got = language.identify(d, language.train(d.where(~held), sample=40)).where(held).collect()
    assert len(got) > 30 and np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    d = spark.createDataFrame([*_lang_rows(), (900, None, "en"), (901, "", "en"), (902, "123 !!", "en"), (903, "日本", None)], "doc_id long, text string, lang string")
    model = language.train(d)
    got = {r.doc_id: r for r in language.identify(d.withColumn("score", F.lit("x")), model).where("doc_id >= 900").collect()}
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred in WORDS and got[900].score == 0
    assert language.train(d.limit(0)) is None
    assert {r.lang_pred for r in language.identify(d, None).collect()} == {"und"}
    one = language.train(d.where("lang = 'en'"))
    assert language.identify(d.limit(1), one).first().lang_pred == "en"


def test_all_languages_are_learned(spark):
    r = random.Random(6)
    rows = [(k, " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)), f"l{k}") for k in range(205)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(x.lang_pred == x.lang for x in language.identify(d, language.train(d)).collect())


def test_votes_are_those_of_all_pairs():
    """A family's pairs one by one, and the largest margin among families."""
    r = np.random.default_rng(3)
    names = ["de", "en", "nl", "sv", "fr", "es"]
    x = np.abs(r.normal(size=(90, language.WIDTH))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = language.fit(x[:60], [names[i % 6] for i in range(60)])
    said, score = model.predict(x)
    for row, s, p in zip(x, said, score, strict=True):
        family = model.families[int(np.argmax([w[:-1] @ row + w[-1] for w in model.outer]))]
        pool = model.languages[family]
        votes, soft, k = dict.fromkeys(pool, 0), dict.fromkeys(pool, 0.0), 0
        for i, a in enumerate(pool):
            for b in pool[i + 1 :]:
                m = float(model.inner[family][k][:-1] @ row + model.inner[family][k][-1])
                k += 1
                votes[a if m > 0 else b] += 1
                soft[a], soft[b] = soft[a] + 1 / (1 + np.exp(-4 * m)), soft[b] + 1 / (1 + np.exp(4 * m))
        best = max(pool, key=lambda n: (votes[n], soft[n]))
        assert s == best and 0 <= p <= 1


def test_sample_is_that_of_the_digest(spark):
    d = spark.createDataFrame(_lang_rows(400), "doc_id long, text string, lang string")
    a, b = (language.train(x, sample=30) for x in (d, d.repartition(7).withColumn("more", F.lit(1))))
    assert (a.outer == b.outer).all() and all((a.inner[f] == b.inner[f]).all() for f in a.families)


# --- licenses ----------------------------------------------------------------------------------------------------------


def test_phrases_are_those_of_brute_force(docs):
    r = random.Random(2)
    pool = ["under", "the", "MIT", "license", "apache", "version", "2", "cc", "by", "nc", "x", "é"]
    rows = [(i, "-".join(r.choice(pool) for _ in range(r.randint(0, 60)))) for i in range(150)] + [(150, None), (151, ""), (152, "Under THE Mit license, under the MIT License")] * 2
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = licenses.scan(docs(rows)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for g in got:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text[g.doc_id] or "").translate(low))
        at = sorted((j, label) for p, label in licenses.PHRASES.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split())
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))
        assert set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(",")) and 0 <= g.score <= 1


def test_edited_templates_are_found(docs):
    words = licenses.TEMPLATES["mit"].split()
    del words[20]
    words.insert(35, "really")
    rows = [(1, "Intro text. " + " ".join(words) + " tail"), (2, " ".join(words[:8])), (3, "nothing here at all")]
    got = {r.doc_id: r for r in licenses.scan(docs(rows)).collect()}
    assert got[1].labels == "mit" and got[1].base_labels == "" and got[1].score > 0.6 and got[2].labels == got[3].labels == ""
    assert licenses.scan(docs(rows).limit(0)).count() == 0


def test_spans_are_verified_on_both_sides(docs):
    words = licenses.TEMPLATES["isc"].split()
    strewn = " ".join(f"{' '.join(words[i : i + 3])} {' '.join(f'f{i}x{j}' for j in range(9))}" for i in range(0, len(words), 3))
    rows = [(1, " ".join(words)), (2, " ".join(words[: len(words) * 7 // 10])), (3, " ".join(words[: len(words) // 2])), (4, strewn), (None, " ".join(words)), (1, " ".join(words))]
    got = licenses.scan(docs(rows).withColumn("label", F.lit("mine")).withColumn("score", F.lit("mine"))).collect()
    assert sorted((r.doc_id or 0, r.labels) for r in got) == [(0, "isc"), (1, "isc"), (1, "isc"), (2, "isc"), (3, ""), (4, "")]
    assert {r.score for r in got if r.doc_id == 1} == {1.0}


# --- audio -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 64, 1020, 1021, 1022, 2042, 2043, 50_000])
def test_streams_hold_what_was_stored(n):
    payload = random.Random(n).randbytes(n)
    media = audio.store(payload)
    s = audio.scan(media)
    assert audio.stored(media, s) == payload and s.bad == s.skipped == 0 and s.checked == s.frames + 1 and s.told_frames == s.frames
    assert s.samples == 1152 * s.frames and len(s.offsets) == s.frames and s.table == "Info"


def test_scanner_resynchronises_and_checks():
    media = audio.store(b"\xff\xfb\x90\x64" * 1000)
    s = audio.scan(b"\x00\xff\xfa junk" + media[media.index(b"\xff\xfa") :])
    assert s.skipped == 8 and s.frames == 4 and s.bad == 0
    broken = bytearray(media)
    broken[audio.scan(media).offsets[1] + 8] ^= 1
    assert audio.scan(bytes(broken)).bad == 1
    cut = audio.scan(media[:-5])
    assert cut.frames == 3 and cut.skipped > 0
    assert audio.scan(b"").frames == 0 and audio.scan(b"\xff" * 100).frames == 0


def test_scanner_reads_other_versions_layers_and_tables():
    two = bytes((0xFF, 0xF3, 0x40, 0xC4))  # MPEG 2 layer III, 32 kbit/s, 22.05 kHz, mono
    h = audio.header(two)
    assert (h.size, h.samples, h.hertz) == (104, 576, 22050)
    one = audio.header(bytes((0xFF, 0xFF, 0x14, 0x00)))  # MPEG 1 layer I, 32 kbit/s, 48 kHz
    assert (one.size, one.samples) == (32, 384)
    vbri = bytearray(audio.header(bytes((0xFF, 0xFB, 0xE0, 0x00))).size)
    vbri[:4] = bytes((0xFF, 0xFB, 0xE0, 0x00))
    vbri[36:62] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 9999, 2, 3, 2, 2, 1)
    vbri[62:68] = struct.pack(">HHH", 5, 6, 7)
    plain = bytes((0xFF, 0xFB, 0xE0, 0x00)) + bytes(len(vbri) - 4)
    tag = b"TAG" + b"A title".ljust(30, b"\0") + b"Someone".ljust(30, b"\0") + bytes(65)
    s = audio.scan(bytes(vbri) + plain * 2 + tag)
    assert (s.table, s.told_frames, s.seek, s.frames) == ("VBRI", 2, [10, 22, 36], 2) and s.tags["TIT2"] == "A title" and s.seconds == 2 * 1152 / 44100


def _naive_crc(bits):
    c = 0xFFFF
    for b in bits:
        c = (c << 1) ^ (0x8005 if (c >> 15) ^ b else 0)
        c &= 0xFFFF
    return c


def _bits(data):
    return [b >> i & 1 for b in data for i in range(7, -1, -1)]


@pytest.mark.parametrize(("word", "protected"), [
    ((0xFF, 0xFE, 0xC4, 0xC0), lambda g: 32 * 4),  # MPEG 1 layer I, mono
    ((0xFF, 0xFE, 0xC4, 0x50), lambda g: 4 * (2 * 8 + 24)),  # joint stereo, shared from subband 8 on
    ((0xFF, 0xFC, 0xC4, 0xC0), lambda g: 11 * 4 + 12 * 3 + 4 * 2 + 2 * g(27, 1, 32)),  # layer II, 48 kHz, mono
    ((0xFF, 0xFC, 0x14, 0x00), lambda g: 2 * (2 * 4 + 6 * 3) + 2 * g(8, 2, 32)),  # 32 kbit/s, stereo
])
def test_checksums_of_layers_one_and_two(word, protected):
    h = audio.header(bytes(word))
    body = bytearray(random.Random(word[2]).randbytes(h.size - 6))
    stream = _bits(body)

    def used(bands, channels, bound):
        at = n = 0
        for width in h.allocation[:bands]:
            for _ in range(channels):
                n += any(stream[at : at + width])
                at += width
        return n

    n = protected(used)
    frame = bytearray(bytes(word) + _naive_crc(_bits(bytes(word[2:])) + stream[:n]).to_bytes(2, "big") + bytes(body))
    s = audio.scan(bytes(frame) * 3)
    assert (s.frames, s.checked, s.bad) == (3, 3, 0)
    frame[6 + n // 16] ^= 1
    assert audio.scan(bytes(frame) * 3).bad == 3


def test_scanner_locks_on_another_stream_after_a_break():
    a = audio.store(b"x" * 5000)
    a = a[a.index(b"\xff\xfa") :]
    two = bytes((0xFF, 0xF3, 0x40, 0xC4))
    b = (two + bytes(audio.header(two).size - 4)) * 6
    s, one = audio.scan(a + b"junk!" + b), audio.scan(a)
    assert s.skipped == 5 and s.frames == one.frames + 6 and abs(s.seconds - one.seconds - 6 * 576 / 22050) < 1e-9


def test_tags_with_unsynchronisation_and_extended_headers():
    frame = audio.store(b"x" * 64)
    frame = frame[frame.index(b"\xff\xfa") :]
    title = "TIT2".encode() + (4).to_bytes(4, "big") + b"\0\0" + b"\0\xffAB"
    three = b"\0\0\0\x06" + bytes(6) + title
    raw = three.replace(b"\xff", b"\xff\0")
    s = audio.scan(b"ID3\x03\0\xc0" + bytes(audio._safe(len(raw))) + raw + frame)
    assert s.tags["TIT2"] == "ÿAB" and s.frames == 1 and s.skipped == 0
    four = b"\0\0\0\x06\x01\0" + b"TIT2" + bytes(audio._safe(9)) + b"\0\x03" + bytes(audio._safe(4)) + b"\0\xff\0AB"
    s = audio.scan(b"ID3\x04\0\x40" + bytes(audio._safe(len(four))) + four + frame)
    assert s.tags["TIT2"] == "ÿAB" and s.frames == 1


def test_feature_is_that_of_a_plain_reading(spark, docs, tmp_path):
    """The query's frames, samples and offsets against a walk over its own stored form by frame lengths."""
    text = "lorem ipsum " * 400
    docs([(1, text), (1, text), (2, text)]).write.parquet(f"{tmp_path}/documents.parquet")
    media = audio.store(text.encode() + bytes(-len(text) % 64))
    at, offsets = media.index(b"\xff\xfa"), []
    while at < len(media):
        rate = audio.KBITS[False, 3][(media[at + 2] >> 4) - 1]
        offsets.append(at)
        at += 144_000 * rate // 44_100 + (media[at + 2] >> 1 & 1)
    got = audio.query(spark, str(tmp_path)).collect()
    seek = zlib.crc32(struct.pack(f"<{len(offsets) - 1}Q", *offsets[1:]))
    assert {(r.n_frames, r.feature.endswith(f"seek={seek:08x}"), f"samples={1152 * r.n_frames};" in r.feature) for r in got} == {(len(offsets) - 1, True, True)}
    assert len({r.feature for r in got}) == 1 and at == len(media)


def test_probe_and_query_rows(spark, docs, tmp_path):
    df = spark.createDataFrame([(1, audio.store(b"x" * 64)), (2, None), (3, b"no")], "id int, content binary").withColumn("frames", F.lit("mine"))
    got = {r.id: r for r in audio.probe(df).collect()}
    assert got[1].frames == 1 and got[2].frames == got[3].frames == 0 and got[1].tags["payload"] == "64"
    docs([(1, "é"), (2, None), (3, ""), (4, "x" * 70)]).write.parquet(f"{tmp_path}/documents.parquet")
    for r in audio.query(spark, str(tmp_path)).collect():
        text = {1: "é", 4: "x" * 70}.get(r.doc_id, "").encode()
        payload = text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


# --- mixing ------------------------------------------------------------------------------------------------------------


def _water(sizes, weights=(5, 2, 1)):
    """By rounds of clamping and sharing anew."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_takes(spark, seed):
    r = random.Random(seed)
    rows = [(i, "w " * r.choice([0, 1, 5, 50, 400]), r.choice(["a", "b", "b", "b", "c", "é", None])) for i in range(200)] + [(200, None, "z"), (201, "x", "q")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, again = ({x.doc_id: x for x in mixing.mix(d).collect()} for _ in range(2))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = _water(sizes), dict.fromkeys(sizes, 0)
    assert got == again
    for i, t, s in rows:
        x, n = got[i], len((t or "").split())
        assert x.size == n and x.source_size == sizes[s] and abs(x.target - want[s]) < 1e-6 and x.taken <= 2 * n and x.taken == x.copies * n + x.rest
        taken[s] += x.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (1, "", None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(blank).collect()] == [0, 0]


# --- fingerprints ------------------------------------------------------------------------------------------------------


def test_fingerprints_are_of_multisets(docs):
    rows = [(1, "one.\ntwo. more\nthree"), (2, "three\none.\ntwo. more"), (3, "one.\ntwo. more\nthree\nthree"), (4, None), (5, ""), (6, "three")]
    f = fingerprints.fingerprints(docs(rows).repartition(2))
    v = {r.doc_id: r.fingerprint for r in f.collect()}
    assert v[1] == v[2] != v[3] and v[4] == v[5] and set(v[4]) == {0}
    one = f.where("doc_id = 1").select(F.col("fingerprint").alias("a")).crossJoin(f.where("doc_id = 6").select(F.col("fingerprint").alias("b")))
    r = one.select(fingerprints.add(F.col("a"), F.col("b")).alias("more"), fingerprints.add(fingerprints.add(F.col("a"), F.col("b")), F.col("b"), -1).alias("back")).first()
    assert r.more == v[3] and r.back == v[1]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_next_texts(docs, parts):
    r = random.Random(parts)
    rows = [(r.choice([i, i * 1000]), f"text {i}") for i in range(1, 60)] + [(None, "last"), (5, "tie a"), (5, "tie b")] + [(None, f"{i} no key") for i in range(60)] + [(7, "é" * (i % 9)) for i in range(60)]
    got = fingerprints.with_next(docs(rows).repartition(5), "doc_id", "text", parts).where("NOT guest").collect()
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = sorted((t, order[(i + 1) % len(order)][1]) for i, (_, t) in enumerate(order))
    assert sorted((x.text, x.next_text) for x in got) == want
    assert fingerprints.with_next(docs(rows).limit(0), "doc_id", "text", parts).count() == 0


# --- URLs --------------------------------------------------------------------------------------------------------------


def _regex(glob):
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + r"[\s\S]*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
            i += 1
    return out


def test_automaton_is_as_regular_expressions():
    r = random.Random(1)
    globs = ["".join(r.choice(["a", "b", "/", "*", "**", "?", "."]) for _ in range(r.randint(0, 40))) for _ in range(60)]
    texts = ["".join(r.choice("ab/.c") for _ in range(r.randint(0, 30))).encode() for _ in range(300)] + [b""]
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = urls.ShiftAnd(globs).match(np.frombuffer(b"".join(texts), np.uint8), at)
    want = np.array([[bool(re.fullmatch(_regex(g).encode(), t)) for g in globs] for t in texts])
    assert (got == want).all() and want.any()


def test_rules_and_odd_urls(spark):
    rows = [(1, "http://A.Example.ORG/en/1?x"), (2, "https://example.org/es/"), (3, "http://org/x"), (4, "http://borg/x"), (5, "http://x.com/de/#a"), (6, "http://x.com/DE/"), (7, None), (8, "example.org/es/"), (9, "http://a.org"), (10, "http://evil.net/x.org/"), (11, "http://casino-win.example.com/en/1"), (12, "ftp://É.com/fr/é"), (13, "://"), (14, "http://x.net/" + "a" * 5000 + "/wp-login.php")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("mine"))).collect()}
    assert [got[i].rule for i in range(1, 15)] == ["example.org/en/1", "example.org/es/", "org/", None, "com/de/", None, None, None, None, None, None, "com/fr/", None, None]
    bare = urls.judge(spark.createDataFrame([(1, "http://best-casino.net"), (2, "http://x-poker.co?id=1"), (3, "http://poker.org/"), (4, "http://x.net/casino")], "page_id long, url string")).collect()
    assert [r.verdict for r in bare] == ["block", "block", "allow", "allow"]
    with pytest.raises(ValueError):
        urls.ShiftAnd(["a" * (urls.STATES + 1)])
    assert [got[i].verdict for i in (1, 3, 7, 11, 12, 14)] == ["block", "allow", "allow", "block", "allow", "block"]
    assert (got[1].host, got[1].path) == ("a.example.org", "/en/1") and (got[13].host, got[13].path) == ("", "") and got[12].host == "É.com".replace("É", "É")


# --- pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline as p

    r = random.Random(9)
    fresh = lambda n: " ".join("".join(r.choice("aeioulmnrst") for _ in range(5)) for _ in range(n))
    passage = fresh(70)
    rows = [(i, fresh(r.randint(30, 200))) for i in range(40)]
    rows += [(50, rows[3][1]), (51, rows[4][1] + " end"), (52, fresh(40) + " " + passage), (53, fresh(40) + " " + passage), (60, None), (61, "12 34")]
    d = docs(rows).withColumn("more", F.lit(1))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    for name, stage in p.STAGES:
        d = stage(spark, d, str(tmp_path))
        d.write.parquet(f"{tmp_path}/{name}")
        d = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(d.count())
        if name != p.STAGES[-1][0]:
            assert d.columns == p.COLUMNS
    assert counts[:3] == [44, 42, 42]
    cut = {x.doc_id: x for x in spark.read.parquet(f"{tmp_path}/repeated_passages").collect()}
    assert len(cut[53].text.split()) == 40 and cut[52].text == dict(rows)[52] and cut[53].n_chars == len(cut[53].text)
    assert p.run(spark, str(tmp_path)).count() == counts[-1]


def test_pipeline_of_nothing_and_of_repeated_rows(spark, docs, tmp_path):
    import corpus_pipeline as p

    docs([(1, "x")]).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert p.run(spark, f"{tmp_path}/none").count() == 0
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("aeiou") * 3 + r.choice("klmnp") for _ in range(60))) for i in range(12)]
    rows += [rows[0], rows[0], (None, rows[1][1]), (None, None)]
    docs(rows).write.parquet(f"{tmp_path}/some/documents.parquet")
    got = p.run(spark, f"{tmp_path}/some")
    ids = {x.doc_id for x in got.select("doc_id").distinct().collect()}  # the mix may take nothing of some
    assert ids and ids <= {*range(12), None}


def test_scratch_tables_are_cleared(spark):
    import os

    from leafloom.llm import tables

    with tables.cleared(spark) as keep:
        gone = tables.written(spark.range(3), "gone")
        kept = keep(tables.written(spark.range(4), "kept"))
        place = gone.inputFiles()[0].removeprefix("file://")
    assert kept.count() == 4 and not os.path.exists(place)
