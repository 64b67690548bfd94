"""Borders of blocks are sought level by level, not tried one by one."""

import datetime as dt

from pyspark.sql import functions as F

from tallyspark.operators import ledger, scan


def test_rows_do_not_meet_every_border(spark, capsys):
    """No join pairs a row with all borders of its product: below the top level, every join has the node of the level above as a key.  Blocks are what counting
    all borders at or below a row gives."""
    n, size = 20_000, 256
    rows = spark.range(n).select((F.col("id") % 1 + 7).alias("produto_id"), F.lit(dt.date(2024, 1, 1)).alias("data_mov"), F.lit("E").alias("tipo"), (F.col("id") * 7919 % n).alias("nota_id"), F.lit(1).alias("line_no"))
    blocks = scan.split(rows, ledger.ORDER, size)
    blocks.explain()
    joins = [x for x in capsys.readouterr().out.splitlines() if "Join" in x]
    assert len(joins) == scan.LEVELS and sum("BroadcastHashJoin" in x and "_up_" in x for x in joins) == scan.LEVELS - 1 and all("HashJoin" in x for x in joins)
    got = [(r["nota_id"], r[scan.BLOCK]) for r in blocks.select("nota_id", scan.BLOCK).collect()]
    assert len(got) == n
    picked = rows.filter(F.pmod(F.xxhash64("produto_id", *ledger.ORDER), F.lit(size // scan.PICKED)) == 0).select("nota_id").collect()
    borders = sorted(r[0] for r in picked)[scan.PICKED - 1 :: scan.PICKED]
    assert len(borders) > 50
    assert all(b == sum(x <= k for x in borders) for k, b in got)
