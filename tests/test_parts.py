"""A large ledger is dealt by product into parts that Spark doesn't join; the rows that come out are the same."""

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import costing, ledger
from tallyspark.plans import stock
from tallyspark.plans import views as V

DIR = "/root/testdata/sf0.001"


def test_number_of_parts():
    assert ledger.parts_of(600_000) is None
    assert ledger.parts_of(36_000_000) == 144 and ledger.parts_of(216_000_000) == 864


@pytest.mark.parametrize("query", [costing.consumption, costing.exit_costs, costing.open_lots, costing.position])
def test_parts_change_nothing(spark, query):
    rows = V.ledger(spark, DIR)
    made = query(rows, parts=9)
    assert "hashpartitioning(produto_id" in (plan := made._jdf.queryExecution().executedPlan().toString()) and ", 9), REPARTITION_BY_NUM" in plan
    number = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*(F.coalesce(c, F.lit(0)) if c == "custo_medio" else c for c in df.columns)).collect())
    assert number(made) == number(query(rows))


def test_queries_deal_by_rows(spark, monkeypatch):
    monkeypatch.setattr(ledger, "ROWS", 100)
    for query in (stock.fifo_consumption, stock.exit_cost, stock.open_lots, stock.stock_position):
        assert "REPARTITION_BY_NUM" in query(spark, DIR)._jdf.queryExecution().executedPlan().toString()
