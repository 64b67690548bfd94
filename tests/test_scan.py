"""Hot products in blocks give the rows that windows give."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from test_costing import SCHEMA, walk

from tallyspark.operators import costing, ledger, scan

DAY = dt.date(2024, 1, 1)


def made(seed, n=500):
    """Three products, one of which has most rows, on few days."""
    r = random.Random(seed)
    return [
        (r.choice([0, 0, 0, 0, 1, 2]), DAY + dt.timedelta(r.randrange(12)) if r.random() > 0.03 else None, r.choice("ES"), i // 3, i % 3, Decimal(r.randrange(-200, 5000)) / 1000,
         Decimal(r.randrange(1, 900)) if r.random() > 0.05 else None, r.choice(["VENDA", "ACERTO"]), r.choice(["lancada"] * 9 + ["cancelada"]))
        for i in range(n)
    ]


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("seed,size", [(1, 64), (2, 10_000)])
def test_blocks_equal_windows(spark, seed, size):
    given = made(seed)
    df = spark.createDataFrame(given, SCHEMA)
    hot = scan.hot_products(df, 200)
    assert [r[0] for r in hot.collect()] == [0]
    near = lambda a, b: a == b or a is not None and b is not None and abs(float(a) - float(b)) < 1e-9 * max(1, abs(float(a)))
    pairs = [
        (ledger.running(df), ledger.running(df, None, hot, size)), (ledger.first_negative(df), ledger.first_negative(df, hot, size)),
        (costing.axis(df), costing.axis(df, hot, size)), (costing.consumption(df), costing.consumption(df, hot, size)),
        (costing.open_lots(df), costing.open_lots(df, None, hot, size)), (costing.open_lots(df, "2024-01-06"), costing.open_lots(df, "2024-01-06", hot, size)),
    ]
    for plain, blocked in pairs:
        assert rows(plain) == rows(blocked)
    # Sums of doubles: equal up to the order of summing.
    for plain, blocked in ((costing.estimates(df), costing.estimates(df, hot)), (costing.exit_costs(df), costing.exit_costs(df, hot, size)), (costing.position(df), costing.position(df, None, hot, size))):
        a, b = rows(plain), rows(blocked)
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert all(u == v or isinstance(u, float) and near(u, v) for u, v in zip(x, y, strict=True))
    used, _, _ = walk(given)
    got = {tuple(x[:5]): x[5] for x in costing.consumption(df, hot, size).select("produto_id", "saida_nota", "saida_linha", "entrada_nota", "entrada_linha", "quantidade").collect()}
    assert got == used


def test_blocks_are_even(spark):
    """A third of all rows on one product and one day: no block has twice the mean, and rows of equal order stay together."""
    rows = spark.range(60_000).select(F.lit(7).alias("produto_id"), F.lit(DAY).alias("data_mov"), F.lit("E").alias("tipo"), (F.col("id") / 2).cast("long").alias("nota_id"), F.lit(1).alias("line_no"))
    blocks = scan.split(rows, ledger.ORDER, 4096)
    sizes = [r["n"] for r in blocks.groupBy(scan.BLOCK).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 60_000 and 8 < len(sizes) < 30 and max(sizes) < 2 * 60_000 / len(sizes) * 1.05
    assert blocks.groupBy("nota_id").agg(F.count_distinct(scan.BLOCK).alias("k")).filter("k > 1").count() == 0
    order = blocks.groupBy(scan.BLOCK).agg(F.min("nota_id").alias("a"), F.max("nota_id").alias("b")).orderBy(scan.BLOCK).collect()
    assert all(x["b"] < y["a"] for x, y in zip(order, order[1:], strict=False))


def test_no_task_has_a_whole_product(spark):
    """Tasks of the windows read a block each."""
    n = 40_000
    rows = spark.range(n).selectExpr("7 produto_id", "date_add(date'2024-01-01', cast(id % 50 as int)) data_mov", "if(id % 2 = 0, 'E', 'S') tipo", "id nota_id", "1 line_no", "cast(1 as decimal(15,3)) quantidade", "cast(1 as decimal(15,2)) valor", "'VENDA' natureza", "'lancada' status")
    hot = scan.hot_products(rows, 10_000)
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ledger.running(rows, None, hot, 1024).withColumn("task", F.spark_partition_id())
        sizes = Counter(r["task"] for r in out.select("task").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes.values()) == n and max(sizes.values()) < n / 4
