"""Homomorphic multiset fingerprints of documents.

Each paragraph is hashed to a wide vector, and a document's fingerprint is the sum of its paragraphs' vectors, lane by lane
and modulo powers of two. The sum doesn't depend on the order of paragraphs, and a paragraph is inserted or deleted by
adding or subtracting its vector. A vector has two parts:

* EXACT lanes modulo 2**32, the words of SHA-256 digests of the paragraph. Equal multisets of paragraphs have equal lanes,
  and others differ but for a chance of about 2**-512.
* SKETCH lanes modulo 2**16: each sentence of the paragraph adds 1 or -1 to one lane. The part is linear too, and the
  cosine of two such parts estimates that of the two multisets of sentences: the likeness.

Everything is DataFrame functions. Nulls count as empty texts; empty paragraphs and sentences add nothing, so an empty text has the
zero vector. Paragraphs end at line feeds; sentences also at . ! ? and |. Elements become rows of one lane and its value, which are summed by lane
before vectors are put together; so a row costs its own lane only.

The query's order is that of descending keys, null ones last, then of texts. Rows that are alike in key and text follow each other; empty tables give no
rows, and columns other than key and text are ignored.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.llm.tables import documents

EXACT, SKETCH = 16, 128
_BREAKS = r"[\n.!?|]"


def _elements(text: Column) -> Column:
    """P and a paragraph, or S and a sentence, for all of a text that aren't empty."""
    some = lambda parts, kind: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    return F.concat(some(F.split(text, "\n", -1), "P"), some(F.split(text, _BREAKS, -1), "S"))


def _number(digest: Column, begin: int, digits: int) -> Column:
    return F.conv(F.substring(digest, begin, digits), 16, 10).cast("long")


def sums(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Adds up the vectors of the rows' `element` by keys: the keys and `v`, an array of longs, the exact lanes first. A row with a null element
    adds nothing."""
    element = F.col("element")
    d = F.sha2("element", 256)
    both = F.concat(d, F.sha2(F.concat(F.lit("Q"), element), 256))
    at = lambda lane, value: F.struct(lane.cast("int").alias("lane"), value.cast("long").alias("value"))
    hashed = elements.select(*keys, F.when(F.startswith(element, F.lit("P")), both).alias("_p"), F.when(F.startswith(element, F.lit("S")), _number(d, 1, 4)).alias("_s"))
    exact = F.array(*[at(F.lit(i), _number(F.col("_p"), 8 * i + 1, 8)) for i in range(EXACT)])
    sketch = F.array(at(F.col("_s").bitwiseAND(SKETCH - 1) + EXACT, 1 - 2 * F.shiftright("_s", 15)))
    lanes = hashed.select(*keys, F.explode(F.when(F.col("_p").isNotNull(), exact).when(F.col("_s").isNotNull(), sketch).otherwise(F.array(at(F.lit(0), F.lit(0))))).alias("x"))
    by = lanes.groupBy(*keys, F.col("x.lane").alias("lane")).agg(F.sum("x.value").alias("value"))
    held = by.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("lane", "value"))).alias("held"))
    power = lambda i: F.when(i < EXACT, F.lit(1 << 32)).otherwise(F.lit(1 << 16))
    return held.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(EXACT + SKETCH - 1)), lambda i: F.pmod(F.coalesce(F.try_element_at("held", i), F.lit(0)), power(i))).alias("v"))


def add(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of a multiset with b's paragraphs inserted, or deleted where sign is -1."""
    power = lambda i: F.when(i < EXACT, F.lit(1 << 32)).otherwise(F.lit(1 << 16))
    return F.transform(F.zip_with(a, b, lambda x, y: x + sign * y), lambda x, i: F.pmod(x, power(i)))


def text_form(v: Column) -> Column:
    """A vector as lowercase hex: eight digits for each exact lane, four for each sketch lane."""
    return F.array_join(F.transform(v, lambda x, i: F.when(i < EXACT, F.lpad(F.lower(F.hex(x)), 8, "0")).otherwise(F.lpad(F.lower(F.hex(x)), 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Of two vectors, 0 to 1: 1 if all lanes are equal, else the cosine of their sketches, 0 where that is negative or void."""
    signed = lambda v: F.transform(F.slice(v, EXACT + 1, SKETCH), lambda x: F.when(x >= 1 << 15, x - (1 << 16)).otherwise(x))
    dot = lambda x, y: F.aggregate(F.zip_with(signed(x), signed(y), lambda p, q: p * q), F.lit(0).cast("long"), lambda t, p: t + p)
    cosine = F.try_divide(dot(a, b).cast("double"), F.sqrt(dot(a, a).cast("double")) * F.sqrt(dot(b, b).cast("double")))
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine, F.lit(0.0)))))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and its vector; texts of rows with equal keys count as one multiset."""
    rows = df.select(F.col(key).alias("key"), F.explode_outer(_elements(F.coalesce(F.col(text), F.lit("")))).alias("element"))
    return sums(rows, ["key"]).select(F.col("key").alias(key), F.col("v").alias("fingerprint"))


#: Ranges that the rows of one key, if it holds more than a range's share, are cut into by their texts' first bytes.
WITHIN = 1024


def ranges(df: DataFrame, parts: int) -> DataFrame:
    """df with `bucket`, larger for rows that come earlier in the order of _k, descending, then _t: some `parts` ranges cut at quantiles.

    A key that fills a range of its own is cut further by its texts, at most WITHIN times. The cuts are one broadcast row of at most two numbers
    a part, and WITHIN for such a key, of which there are at most `parts`.
    """
    spark = df.sparkSession
    df = df.withColumn("_s", F.coalesce(F.conv(F.hex(F.substring(F.encode("_t", "UTF-8"), 1, 6)), 16, 10).cast("long") * F.element_at(F.array(*[F.lit(256**i) for i in range(6, -1, -1)]), F.least(F.octet_length("_t"), F.lit(6)) + 1), F.lit(0)))
    share = [i / parts for i in range(1, parts)]
    found = (df.agg(F.percentile_approx("_k", share, 20 * parts)).first()[0] or []) if share else []
    hot = sorted({x for x, y in pairwise(sorted(found)) if x == y})
    cuts = sorted({*found, *hot, *(x + 1 for x in hot if x < (1 << 63) - 1)})
    inside = {r["_k"]: sorted(set(r["cuts"])) for r in df.join(F.broadcast(spark.createDataFrame([(x,) for x in hot], "_k long")), "_k").groupBy("_k").agg(F.percentile_approx("_s", [i / WITHIN for i in range(1, WITHIN)], 20 * WITHIN).alias("cuts")).collect()} if hot else {}
    wide = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    table = spark.createDataFrame([([g[0] for g in groups], groups, inside)], "firsts array<long>, nested array<array<long>>, inside map<long,array<long>>")
    below = lambda a, x: F.size(F.filter(a, lambda y: y <= x))
    of = F.when(F.col("_g") == 0, 0).otherwise((F.col("_g") - 1) * wide + below(F.get("nested", F.col("_g") - 1), F.col("_k")))
    rows = df.crossJoin(F.broadcast(table)).withColumn("_g", below(F.col("firsts"), F.col("_k"))).withColumn("_r", of)  # one row
    sub = F.coalesce(below(F.try_element_at("inside", F.col("_k")), F.col("_s")), F.lit(0)) if inside else F.lit(0)
    return rows.withColumn("bucket", F.col("_r").cast("long") * WITHIN + (WITHIN - 1 - sub)).drop("_g", "_r", "firsts", "nested", "inside")


def with_next(df: DataFrame, order: str, text: str, parts: int) -> DataFrame:
    """Adds `next_text`, the text of the row that follows in descending order (ties by text; after the last row the first).

    Rows go to ranges of the order; each range also gets a copy of the next range's first rows, marked `guest`, whose next_text is void. No task
    needs more than one range, and the driver holds three numbers a range. Adds `bucket` and `place`, together unique, and leaves rows
    partitioned by bucket.
    """
    df = df.withColumn("_k", F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 63)))).withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    df = ranges(df, parts)
    first = F.max(F.struct("_k", (-F.col("_s")).alias("s"))).alias("top")
    tops = sorted(df.groupBy("bucket").agg(first).collect(), key=lambda r: -r.bucket)  # a row a range
    heads = [(r.top["_k"], -r.top["s"], tops[i - 1].bucket, r.bucket) for i, r in enumerate(tops)]
    table = F.broadcast(df.sparkSession.createDataFrame(heads, "_k long, _s long, host long, bucket long"))
    guests = df.join(table, ["_k", "_s", "bucket"]).withColumn("bucket", F.col("host")).drop("host")
    rows = df.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    w = Window.partitionBy("bucket").orderBy("guest", F.col("_k").desc(), "_t")
    rows = rows.withColumn("next_text", F.lead("_t").over(w)).withColumn("place", F.row_number().over(w))
    rows = rows.withColumn("next_text", F.when(~F.col("guest"), F.col("next_text")))
    return rows.withColumn("_before", F.lag("guest").over(w)).where(~F.col("guest") | ~F.col("_before")).drop("_k", "_s", "_t", "_before")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: documents, their edited texts and their successors. A text is hashed once as itself, and serves its predecessor as the next one."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs, "doc_id", "text", parts)
    rows = rows.select("bucket", "place", "guest", "doc_id", F.coalesce("text", F.lit("")).alias("t"), "next_text").withColumn("n_chars", F.length("t").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("t", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third)))
    keys = ["bucket", "place", "guest", "doc_id", "n_chars", "edited_sha256", "kind"]
    texts = [F.struct(F.lit(i).alias("kind"), F.col(c).alias("of")) for i, c in enumerate(("t", "edited"))]
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256)).select(*keys[:-1], F.explode(F.when(F.col("guest"), F.array(texts[0])).otherwise(F.array(*texts))).alias("x")).select(*keys[:-1], "x.*")
    of = sums(rows.select(*keys, F.explode_outer(_elements(F.col("of"))).alias("element")), keys)
    got = of.groupBy(*keys[:-1]).agg(*[F.max(F.when(F.col("kind") == i, F.col("v"))).alias(f"v{i}") for i in range(2)])
    got = got.withColumn("v2", F.lead("v0").over(Window.partitionBy("bucket").orderBy("place"))).where(~F.col("guest"))
    a, b, c = (F.col(f"v{i}") for i in range(3))
    return got.select("doc_id", "n_chars", "edited_sha256", text_form(a).alias("fingerprint"), text_form(b).alias("edited_fingerprint"), F.round(likeness(a, b), 9).alias("near_edited"), F.round(likeness(a, c), 9).alias("near_next"))


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) nt, row_number() OVER w AS rid
      FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, length(t) nc, substr(t, 1, length(t) - length(t) // 3) || substr(nt, 1, length(t) // 3) ed FROM n),
k AS (SELECT rid, 0 kind, t x FROM e UNION ALL SELECT rid, 1, ed FROM e UNION ALL SELECT rid, 2, nt FROM e),
p AS (SELECT rid, kind, 'P' || unnest(string_split(x, chr(10))) el FROM k),
s AS (SELECT rid, kind, 'S' || unnest(string_split_regex(x, '[\\n.!?|]')) el FROM k),
ph AS (SELECT rid, kind, sha256(el) || sha256('Q' || el) h FROM p WHERE el <> 'P'),
pl AS (SELECT rid, kind, i, sum(CAST('0x' || substr(h, CAST(8 * i + 1 AS BIGINT), 8) AS BIGINT)) % 4294967296 v FROM ph, range({EXACT}) r(i) GROUP BY ALL),
sh AS (SELECT rid, kind, CAST('0x' || substr(sha256(el), 1, 4) AS BIGINT) q FROM s WHERE el <> 'S'),
sl AS (SELECT rid, kind, q % {SKETCH} i, sum(CASE WHEN q >= 32768 THEN -1 ELSE 1 END) v FROM sh GROUP BY ALL),
g AS (SELECT rid, kind, i FROM (SELECT DISTINCT rid, kind FROM k), range({EXACT + SKETCH}) r(i)),
v AS (SELECT g.rid, g.kind, list(CAST(coalesce(pl.v, sl.v, 0) AS BIGINT) ORDER BY g.i) v FROM g
      LEFT JOIN pl ON pl.rid = g.rid AND pl.kind = g.kind AND pl.i = g.i
      LEFT JOIN sl ON sl.rid = g.rid AND sl.kind = g.kind AND sl.i + {EXACT} = g.i GROUP BY 1, 2),
f AS (SELECT rid, kind, v, list_slice(v, {EXACT + 1}, {EXACT + SKETCH}) s,
      array_to_string(list_transform(list_slice(v, 1, {EXACT}), lambda x: printf('%08x', x)), '') ||
      array_to_string(list_transform(list_slice(v, {EXACT + 1}, {EXACT + SKETCH}), lambda x: printf('%04x', (x + 65536) % 65536)), '') fp FROM v),
j AS (SELECT e.doc_id, e.nc, e.ed, a.fp fa, b.fp fb, c.fp fc, CAST(list_dot_product(a.s::DOUBLE[], b.s::DOUBLE[]) AS DOUBLE) ab,
      CAST(list_dot_product(a.s::DOUBLE[], c.s::DOUBLE[]) AS DOUBLE) ac, sqrt(list_dot_product(a.s::DOUBLE[], a.s::DOUBLE[])) na,
      sqrt(list_dot_product(b.s::DOUBLE[], b.s::DOUBLE[])) nb, sqrt(list_dot_product(c.s::DOUBLE[], c.s::DOUBLE[])) ncx
      FROM e JOIN f a ON a.rid = e.rid AND a.kind = 0 JOIN f b ON b.rid = e.rid AND b.kind = 1 JOIN f c ON c.rid = e.rid AND c.kind = 2)
SELECT doc_id, CAST(nc AS BIGINT) n_chars, sha256(ed) edited_sha256, fa fingerprint, fb edited_fingerprint,
  round(CASE WHEN fa = fb THEN 1.0::DOUBLE WHEN na * nb = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ab / (na * nb))) END, 9) near_edited,
  round(CASE WHEN fa = fc THEN 1.0::DOUBLE WHEN na * ncx = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ac / (na * ncx))) END, 9) near_next
FROM j
"""
