"""Mixing sources to target weights by capped water-filling.

A source's target is its weight's share of the budget, but at most `cap` times its size; what capped sources leave is shared
anew by weight until none is above its cap. That fixed point is found in closed form: with sources in order of cap / weight,
all up to some place are capped and the others share the rest, so prefix sums tell it without a loop.

A document is then repeated as often as its source's target holds its source's size, and the fraction that is left is a seeded
sample: documents in the order of a digest, whole, until the fraction is reached; the one in which it is reached gives only
the words still missing. Each source so takes its target rounded to a word.

The order is found in steps, so that no task needs a whole source: sums by (source, first digits of the digest) tell the one bin in which a source's
fraction ends, and only that bin's documents are sorted. There are enough digits that a bin of the largest source has some FEW documents.
Targets need all sources in order of their caps, in one task: a row of four numbers a source.

Null texts and texts without words have size 0 and are never taken. A null source is a source, last in order. Rows that are
alike count each. Sizes are words `[^\\x20\\x09-\\x0D]+`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.llm.tables import documents, small, written

WEIGHTS = (5, 2, 1)
#: Budget as a share of all words, and the cap, in hundredths.
BUDGET, CAP = 150, 200
SEED = "mix-1"
#: Documents that a bin of the largest source has, about, and the most sources whose table is broadcast.
FEW, MANY = 1_000, 10_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda x: x != "")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: int = BUDGET, cap: int = CAP) -> DataFrame:
    """source, source_size and target, from rows of source and size."""
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    t = total.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * cap)  # in hundredths of words
    rising = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    until, whole = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    before = lambda c: F.coalesce(F.sum(c).over(until), F.lit(0))
    t = t.withColumn("left", F.sum("source_size").over(whole) * budget - before("most")).withColumn("shared", F.sum("weight").over(whole) - before("weight"))
    level = F.col("left") / F.col("shared")  # as if the sources before this were capped
    t = t.withColumn("level", F.when(level * F.col("weight") <= F.col("most"), level))
    t = t.withColumn("level", F.first("level", True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return t.select("source", "source_size", F.when(F.col("level").isNull() | (F.col("level") * F.col("weight") > F.col("most")), F.col("most") / 100).otherwise(F.col("level") * F.col("weight") / 100).alias("target"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **shares) -> DataFrame:
    """key, size, source_size, target, copies (whole repetitions), rest (words of a further, partial one) and taken.

    One row for each of df's; `key` should tell rows apart, else their order in the sample is that of their sizes.
    """
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    sized = df.select(F.col(key).alias("key"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), digest.alias("at"))
    sized = written(sized, "sizes")
    goal = targets(sized, **shares)
    most = sized.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    digits = min(max(math.ceil(math.log(max(most / FEW, 1), 16)), 1), 15)
    sized = sized.withColumn("bin", F.conv(F.substring("at", 1, digits), 16, 10).cast("long"))
    goal = written(goal.withColumn("whole", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")), "targets")
    goal = goal.withColumn("part", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    bins = sized.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for FEW documents
    ends = bins.withColumn("upto", F.sum("words").over(upto)).join(goal.select(F.col("source").alias("s"), "part"), F.col("source").eqNullSafe(F.col("s")))
    ends = ends.where("upto >= part").groupBy("source").agg(F.min(F.struct("bin", (F.col("part") - F.col("upto") + F.col("words")).alias("missing"))).alias("end"))
    facts = goal.join(ends.withColumnRenamed("source", "e"), F.col("source").eqNullSafe(F.col("e")), "left")
    facts = small(written(facts.select(F.col("source").alias("s"), "source_size", "target", "whole", "end.bin", "end.missing").withColumnRenamed("bin", "end_bin"), "facts"), MANY)
    rows = sized.join(facts, F.col("source").eqNullSafe(F.col("s")), "left")
    cut = F.col("bin") == F.coalesce("end_bin", F.lit(-1))
    clear = rows.where(~cut).withColumn("extra", F.when(F.col("bin") < F.coalesce("end_bin", F.lit(-1)), F.col("size")).otherwise(F.lit(0)))
    sofar = F.coalesce(F.sum("size").over(Window.partitionBy("s").orderBy("at", "key", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    split = rows.where(cut).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("missing") - sofar)))
    out = clear.unionByName(split)
    full = (F.col("extra") == F.col("size")) & (F.col("size") > 0)
    return out.select(
        F.col("key").alias(key), "size", "source_size", "target", (F.col("whole") + full.cast("long")).alias("copies"),
        F.when(full, F.lit(0)).otherwise(F.col("extra")).cast("long").alias("rest"), (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all documents, mixed to 150% of their words."""
    return mix(documents(spark, sf_dir, "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rest")


SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) n FROM d GROUP BY 1),
w AS (SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] w, n * {CAP} most FROM s),
l AS (SELECT *, sum(n) OVER () * {BUDGET} - coalesce(sum(most) OVER p, 0) lef, sum(w) OVER () - coalesce(sum(w) OVER p, 0) shared,
      row_number() OVER (ORDER BY most / w, source NULLS LAST) r
      FROM w WINDOW p AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(CAST(lef AS DOUBLE) / CAST(shared AS DOUBLE), r) lv FROM l WHERE CAST(lef AS DOUBLE) / CAST(shared AS DOUBLE) * w <= most),
t AS (SELECT source, n, CASE WHEN lv IS NULL OR lv * w > most THEN CAST(most AS DOUBLE) / 100 ELSE lv * w / 100 END target FROM l, f),
x AS (SELECT source, n, target, CASE WHEN n = 0 THEN 0 ELSE CAST(floor(target / n) AS BIGINT) END whole FROM t),
y AS (SELECT *, CAST(round(target) AS BIGINT) - whole * n part FROM x),
z AS (SELECT d.doc_id, d.size, y.n, y.target, y.whole, greatest(0, least(d.size, y.part - coalesce(sum(d.size) OVER (PARTITION BY d.source
      ORDER BY md5('{SEED}|' || d.doc_id), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) extra
      FROM d JOIN y ON d.source IS NOT DISTINCT FROM y.source)
SELECT doc_id, size, n source_size, target, CAST(whole * size + extra AS BIGINT) taken,
  CAST(whole + CASE WHEN extra = size AND size > 0 THEN 1 ELSE 0 END AS BIGINT) copies,
  CAST(CASE WHEN extra = size THEN 0 ELSE extra END AS BIGINT) rest FROM z
"""
