"""What shuffles or reads no more than it must: states of lots, quantities of notes, anomalies."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F
from test_costing import SCHEMA

from tallyspark.operators import costing, ingest, reports, states
from tallyspark.plans import books, intake


def test_lots_that_stay_open_have_no_row_a_month(spark):
    day = dt.date(2020, 1, 1)
    rows = [(1, day, "E", i, 1, Decimal(10), Decimal(5), "COMPRA", "lancada") for i in range(20)]
    rows += [(1, day + dt.timedelta(32 * k), "S", 100 + k, 1, Decimal("0.5"), Decimal(5), "VENDA", "lancada") for k in range(1, 31)]
    ledger = spark.createDataFrame(rows, SCHEMA)
    lots = states.build(ledger).lots
    assert lots.count() <= 20 + costing.consumption(ledger).count()  # 20 rows a month before
    last = lots.groupBy("nota_id").agg(F.max_by("resta", "competencia").alias("resta")).filter("resta > 0")
    assert {r.nota_id: r.resta for r in last.collect()} == {r.nota_id: r.resta for r in costing.open_lots(ledger).collect()}


def test_notes_go_on_from_batch_to_batch(spark):
    groups = [(n, g, float(q)) for n in range(7) for g, q in enumerate((1, 2, 2, 3, 4))]
    items = [(n, i, q) for n in range(7) for i, q in enumerate((3.0, 2.0, 1.0005, 4.5, 9.0))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
        got = ingest.match_by_quantity(spark.createDataFrame(groups, "nota_id long, grupo long, quantidade double"), spark.createDataFrame(items, "nota_id long, item long, quantidade double"))
        assert spark.sparkContext._jsc.sc().dagScheduler().nextJobId() == before  # nothing is counted first
        assert {tuple(r) for r in got.collect()} == {(n, *x) for n in range(7) for x in ((0, 2), (1, 1), (3, 0))}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lines_of_notes_are_not_multiplied(spark):
    plan = intake.match_by_qty(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_the_position_is_worked_out_once(spark):
    position = spark.createDataFrame([(1, -2.0, 3.0), (2, 5.0, None), (3, 5.0, 0.0), (4, 5.0, 1.0), (5, 0.0, None)], "produto_id long, saldo double, valor double").withColumn("saldo", F.col("saldo") + F.rand() * 0)
    fall = spark.createDataFrame([], "produto_id long, saldo double")
    out = reports.stock_anomalies(fall, spark.createDataFrame([], "falta double"), position)
    assert sorted((r.regra, r.produto_id, r.quantidade) for r in out.collect()) == [("estoque sem valor", 2, 5.0), ("estoque sem valor", 3, 5.0), ("saldo final negativo", 1, -2.0)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("rand(") == 1


def test_numbers_of_a_book_are_not_broadcast(spark):
    plan = books.only_one_side(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
