"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_COPIES = 2
#: Bits of the hash, and bits that one level of the histogram looks at.
BITS, LEVEL = 60, 12
#: Sources up to which a table of one row per source is broadcast; beyond, Spark joins it by shuffle.
BROADCAST_SOURCES = 100_000


def unit(doc_id: str = "doc_id", text: str = "text"):
    """A 60-bit hash of id and text, so that only repeated rows tie."""
    both = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), C.text_of(F.col(text)))
    return F.conv(F.substring(F.md5(both), 1, BITS // 4), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """docs as (doc_id, source, size, h)."""
    return docs.select("doc_id", "source", C.n_words(F.col("text")).alias("size"), unit().alias("h"))


def targets(sized: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target).  Weights repeat along the sources by code point, null last.  A source stops at
    `most` times its size.  Water filling in closed form: a source is full exactly if the level at which it fills needs no
    more than the whole budget.  One row per source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", w.cast("long").alias("w"), (F.col("source_size") * most).alias("cap"))
    rising = W.orderBy(F.col("cap") / F.col("w")).rangeBetween(W.unboundedPreceding, 0)
    everything = W.partitionBy()
    per = per.select(
        "*", F.sum("cap").over(rising).alias("caps"), F.sum("w").over(rising).alias("ws"),
        F.sum("w").over(everything).alias("all_w"), F.sum("source_size").over(everything).alias("all_size"),
    )
    full = 100 * (F.col("w") * F.col("caps") + F.col("cap") * (F.col("all_w") - F.col("ws"))) <= share_percent * F.col("w") * F.col("all_size")
    per = per.withColumn("full", full)
    left = share_percent * F.col("all_size") - 100 * F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)
    open_w = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(everything)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("w") * left).cast("double") / (100 * open_w).cast("double"))
    return per.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, goal: DataFrame, n_sources: int) -> DataFrame:
    """goal with base (copies that every row gets) and limit: rows whose h is at most limit get one copy more.

    Each level sums sizes by source and bucket, finds the bucket in which the budget is crossed, and only that bucket's
    rows go to the next level.  No row is sorted; a level makes at most 2^12 sums a source."""
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("base", base).withColumn("budget", F.col("target") - F.col("base") * F.col("source_size"))
    at = goal.select(F.col("source").alias("s"), "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for level in range(1, BITS // LEVEL + 1):
        shift = BITS - level * LEVEL
        here = sized.join(C.small(at, n_sources, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("s")))
        here = here.filter(F.shiftright("h", shift + LEVEL) == F.col("prefix"))
        sums = here.groupBy("s", "budget", "before", F.shiftright("h", shift).alias("prefix")).agg(F.sum("size").alias("unit"))
        upto = F.sum("unit").over(W.partitionBy("s").orderBy("prefix").rowsBetween(W.unboundedPreceding, 0))
        sums = sums.withColumn("upto", F.col("before") + upto).filter(F.col("upto") > F.col("budget"))
        first = sums.groupBy("s", "budget").agg(F.min(F.struct("prefix", "upto", "unit")).alias("b"))
        at = first.select("s", "budget", "b.prefix", (F.col("b.upto") - F.col("b.unit")).alias("before"), "b.unit")
        if level < BITS // LEVEL:
            at = at.drop("unit")
    nearer = (F.col("before") + F.col("unit") - F.col("budget")) < (F.col("budget") - F.col("before"))
    at = at.select("s", F.when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("limit"))
    out = goal.join(at, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return out.withColumn("limit", F.coalesce("limit", F.lit((1 << BITS) - 1)))  # the budget holds all


def limits(sized: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_COPIES) -> DataFrame:
    """(s, source_size, target, base, limit): one row per source, its name as s; ready to be joined."""
    goal = C.cut(targets(sized, weights, share_percent, most))
    n = goal.count()
    return C.small(C.cut(thresholds(sized, goal, n).withColumnRenamed("source", "s").drop("budget")), n, BROADCAST_SOURCES)


def _copies(h, most: int):
    return F.least(F.lit(most).cast("long"), F.col("base") + (h <= F.col("limit")).cast("long"))


def mix(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_COPIES) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, h, limit, copies, taken.

    A row is taken `copies` times, whole; taken = size * copies.  A source's sum is as near to its target as a threshold on
    h allows.  Null text has size 0; null is a source of its own; repeated rows share their fate; an empty table gives an
    empty result."""
    sized = C.cut(sizes(docs))
    out = sized.join(limits(sized, weights, share_percent, most), F.col("source").eqNullSafe(F.col("s")))
    out = out.select("doc_id", "source", "size", "source_size", "target", "h", "limit", _copies(F.col("h"), most).alias("copies"))
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def sample(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_COPIES) -> DataFrame:
    """The mix itself: the rows of docs, each as often as mix() takes it.  Texts are not shuffled."""
    goal = limits(C.cut(sizes(docs)), weights, share_percent, most)
    out = docs.withColumn("_unit_", unit()).join(goal, F.col("source").eqNullSafe(F.col("s")))
    each = F.explode(F.array_repeat(F.lit(0), _copies(F.col("_unit_"), most).cast("int")))
    return out.select(*(docs[c] for c in docs.columns), each.alias("_copy_")).drop("_copy_")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark, C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, ''))[1:15])::BIGINT AS h
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM sized GROUP BY source),
caps AS (
  SELECT *, 2 * source_size AS cap, sum(2 * source_size) OVER r AS caps, sum(w) OVER r AS ws,
         sum(w) OVER () AS all_w, sum(source_size) OVER () AS all_size
  FROM per WINDOW r AS (ORDER BY 2 * source_size / w::DOUBLE RANGE UNBOUNDED PRECEDING)),
filled AS (SELECT *, 100 * (w * caps + cap * (all_w - ws)) <= 150 * w * all_size AS "full" FROM caps),
goal AS (
  SELECT source, source_size, CASE WHEN "full" THEN cap::DOUBLE ELSE
    (w * (150 * all_size - 100 * coalesce(sum(cap) FILTER ("full") OVER (), 0)))::DOUBLE
    / (100 * sum(CASE WHEN "full" THEN 0 ELSE w END) OVER ())::DOUBLE END AS target
  FROM filled),
based AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base FROM goal),
units AS (SELECT source, h, sum(size) AS unit FROM sized GROUP BY 1, 2),
sums AS (SELECT *, sum(unit) OVER (PARTITION BY source ORDER BY h) AS upto FROM units),
chosen AS (
  SELECT s.source, s.h, s.upto - s.unit < b.target - b.base * b.source_size AND
         (s.upto <= b.target - b.base * b.source_size OR
          s.upto - (b.target - b.base * b.source_size) < (b.target - b.base * b.source_size) - (s.upto - s.unit)) AS more
  FROM sums s JOIN based b ON s.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, d.size, b.source_size, round(b.target, 6) AS target,
       (d.size * least(2, b.base + CASE WHEN c.more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized d JOIN based b ON d.source IS NOT DISTINCT FROM b.source
JOIN chosen c ON c.source IS NOT DISTINCT FROM d.source AND c.h = d.h
"""
