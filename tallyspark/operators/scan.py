"""Prefix sums and carried values of hot keys, by blocks.

A window by product puts a product's rows in one task.  Here the rows of a hot product are cut into ranges of their order; each
range is a block with a window of its own, brings a summary (sums, least prefix, last values), and gets what the blocks before
it add up to.  Summaries combine in any grouping, and there are rows / size of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a product from which it is hot, which is also about the size of a block.
SIZE = 1 << 20
#: Sampled rows in a block: it bounds how far blocks differ in size.
PICKED = 64
KEY, BLOCK = "produto_id", "_block_"
_AHEAD = (W.unboundedPreceding, -1)
#: Levels of a tree of borders, and borders under one of the level above.
LEVELS, FANOUT = 3, 32


def hot_products(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """(produto_id) with more than `size` rows, marked for broadcast: there are less than rows / size."""
    return F.broadcast(rows.groupBy(KEY).agg(F.count("*").alias("_n_")).filter(F.col("_n_") > size).select(KEY))


def split(rows: DataFrame, order: tuple[str, ...], size: int = SIZE, key: str = KEY) -> DataFrame:
    """rows with the number of their block.  Borders are the order of rows that a hash picks, so they depend on the rows alone and
    a task that is run again finds the same.  Rows of equal order stay together.

    Borders are a tree, a join a level: on its way down a row meets at most FANOUT borders a level.  A join with all of them would try
    each row with every border of its product, whose number grows with the rows."""
    picked = rows.filter(F.pmod(F.xxhash64(key, *order), F.lit(max(1, size // PICKED))) == 0).select(F.col(key).alias("_of_"), F.struct(*order).alias("_from_"))
    by = W.partitionBy("_of_").orderBy("_from_")  # one row in size / PICKED
    edges = picked.withColumn("_k_", F.row_number().over(by)).filter(F.col("_k_") % PICKED == 0).select("_of_", "_from_", (F.col("_k_") / PICKED).cast("int").alias("_b_")).persist()  # rows / size, for all levels
    out = rows.withColumn("_stands_", F.struct(*order)).withColumn(BLOCK, F.lit(0))
    for step in (FANOUT**k for k in range(LEVELS - 1, -1, -1)):  # borders whose number is a multiple of step, under the last of FANOUT * step
        up = (F.col("_b_") - F.pmod("_b_", F.lit(FANOUT * step))) if step < FANOUT ** (LEVELS - 1) else F.lit(0)
        level = edges.filter(F.col("_b_") % step == 0).withColumn("_up_", up)
        level = level.withColumn("_to_", F.lead("_from_").over(W.partitionBy("_of_", "_up_").orderBy("_b_"))).filter("_b_ > _up_")
        inside = (F.col(key) == F.col("_of_")) & (F.col(BLOCK) == F.col("_up_")) & (F.col("_stands_") >= F.col("_from_")) & (F.col("_to_").isNull() | (F.col("_stands_") < F.col("_to_")))
        out = out.join(F.broadcast(level), inside, "left").withColumn(BLOCK, F.coalesce("_b_", BLOCK)).drop("_of_", "_up_", "_from_", "_to_", "_b_")
    return out.drop("_stands_")


def inside(order: tuple[str, ...]) -> W:
    """A block's rows in order, up to each."""
    return W.partitionBy(KEY, BLOCK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def ahead() -> W:
    """A product's blocks before each, for summaries."""
    return W.partitionBy(KEY).orderBy(BLOCK).rowsBetween(*_AHEAD)


def running_sum(rows: DataFrame, value: Column, order: tuple[str, ...], name: str, size: int = SIZE) -> DataFrame:
    """rows with the sum of value up to each, in order, per product."""
    blocks = split(rows.withColumn("_x_", value), order, size)
    total = blocks.groupBy(KEY, BLOCK).agg(F.sum("_x_").alias("_sum_"))
    before = total.select(KEY, BLOCK, F.sum("_sum_").over(ahead()).alias("_before_"))
    inner = blocks.withColumn("_in_", F.sum("_x_").over(inside(order)))
    out = inner.join(before, [KEY, BLOCK])
    return out.select(*rows.columns, (F.col("_in_") + F.coalesce("_before_", F.lit(0))).alias(name))


def axis(rows: DataFrame, order: tuple[str, ...], size: int = SIZE) -> DataFrame:
    """rows (tipo, quantidade above 0) with falta, casado, hi and lo as costing.axis() has them.

    A block's summary is its entries, its exits and the least of its prefixes.  What exits took up to a row is what went out
    less all shortages so far, so one summary serves the balance, the shortages and both sides of the axis."""
    q = F.col("quantidade")
    side = lambda t: F.when(F.col("tipo") == t, q).otherwise(0)
    w = inside(order)
    inner = split(rows, order, size).withColumn("_e_", F.sum(side("E")).over(w)).withColumn("_s_", F.sum(side("S")).over(w))
    inner = inner.withColumn("_low_", F.min(F.col("_e_") - F.col("_s_")).over(w)).withColumn("_low0_", F.lag("_low_").over(W.partitionBy(KEY, BLOCK).orderBy(*order)))
    each = inner.groupBy(KEY, BLOCK).agg(F.max("_e_").alias("_te_"), F.max("_s_").alias("_ts_"), F.min("_low_").alias("_tl_"))
    each = each.withColumns({"_e0_": F.coalesce(F.sum("_te_").over(ahead()), F.lit(0)), "_s0_": F.coalesce(F.sum("_ts_").over(ahead()), F.lit(0))})
    start = F.col("_e0_") - F.col("_s0_")
    each = each.withColumn("_l0_", F.least(F.lit(0), F.min(start + F.col("_tl_")).over(ahead()))).select(KEY, BLOCK, "_e0_", "_s0_", "_l0_")
    out = inner.join(each, [KEY, BLOCK])
    short = lambda low: -F.least(F.col("_l0_"), start + F.col(low))
    out = out.withColumn("_all_", short("_low_")).withColumn("falta", F.col("_all_") - short("_low0_"))
    out = out.withColumn("casado", q - F.when(F.col("tipo") == "S", F.col("falta")).otherwise(0))
    out = out.withColumn("hi", F.when(F.col("tipo") == "E", F.col("_e0_") + F.col("_e_")).otherwise(F.col("_s0_") + F.col("_s_") - F.col("_all_")))
    return out.withColumn("lo", F.col("hi") - F.col("casado")).select(*rows.columns, "falta", "casado", "hi", "lo")


def sweep(rows: DataFrame, lot: Column, out: Column, size: int = SIZE) -> DataFrame:
    """(produto_id, lo, e, s, proximo) along the axis: the last lot and the last exit that start at or before each row, and where the next
    row starts.  rows (produto_id, lo, tipo) have one row a side at a point at most."""
    order = ("lo", "tipo")
    blocks = split(rows.select(KEY, *order, lot.alias("_e_"), out.alias("_s_")), order, size)
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("lo", c)))
    each = blocks.groupBy(KEY, BLOCK).agg(last("_e_").alias("_le_"), last("_s_").alias("_ls_"), F.min("lo").alias("_first_"))
    each = each.select(
        KEY, BLOCK, F.last("_le_", True).over(ahead())["_e_"].alias("_e0_"), F.last("_ls_", True).over(ahead())["_s_"].alias("_s0_"),
        F.lead("_first_").over(W.partitionBy(KEY).orderBy(BLOCK)).alias("_next_"),
    )
    w = inside(order)
    inner = blocks.select(
        KEY, BLOCK, "lo", F.last("_e_", True).over(w).alias("_e_"), F.last("_s_", True).over(w).alias("_s_"), F.lead("lo").over(W.partitionBy(KEY, BLOCK).orderBy(*order)).alias("_in_")
    )
    return inner.join(each, [KEY, BLOCK]).select(KEY, "lo", F.coalesce("_e_", "_e0_").alias("e"), F.coalesce("_s_", "_s0_").alias("s"), F.coalesce("_in_", "_next_").alias("proximo"))


def carry(rows: DataFrame, value: str, order: tuple[str, ...], name: str, size: int = SIZE, key: str = KEY) -> DataFrame:
    """rows with the last value that isn't null, up to each row of its key, in order."""
    blocks = split(rows, order, size, key)
    last = F.max(F.when(F.col(value).isNotNull(), F.struct(*(c for c in order if c != value), value)))
    each = blocks.groupBy(key, BLOCK).agg(last.alias("_last_"))
    before = each.select(key, BLOCK, F.last("_last_", True).over(W.partitionBy(key).orderBy(BLOCK).rowsBetween(*_AHEAD))[value].alias("_before_"))
    inner = blocks.withColumn("_in_", F.last(value, True).over(W.partitionBy(key, BLOCK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    return inner.join(before, [key, BLOCK]).select(*rows.columns, F.coalesce("_in_", "_before_").alias(name))
