"""Exits and their lots come from one pass by product; what comes out is what joining them gives."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from test_costing import SCHEMA

from tallyspark.operators import costing
from tallyspark.plans import stock


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_the_ledger_is_shuffled_once_by_product(spark):
    made = plan(stock.exit_cost(spark, "/root/testdata/sf0.001"))
    assert made.count("FileScan") == 2 and made.count("hashpartitioning(produto_id") == 1
    assert "_w" not in made[made.index("hashpartitioning(produto_id") :]  # as it is, without what windows are made of


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_as_joined(spark, seed):
    """Repeated rows, keys that are null in part, exits that take nothing, undated and cancelled rows, no prices."""
    r = random.Random(seed)
    day = dt.date(2024, 1, 1)
    null = lambda v: v if r.random() > 0.1 else None
    rows = [
        (null(r.randrange(4)), null(day + dt.timedelta(r.randrange(20))), r.choice("ES"), null(i), null(i % 3), null(Decimal(r.randrange(-200, 5000)) / 1000), null(Decimal(r.randrange(3))), null(r.choice(["VENDA", "ACERTO"])), r.choice(["lancada"] * 9 + ["cancelada"]))
        for i in range(300)
    ]
    rows = [x for x in rows if x[3] is not None] + [x for x in rows if x[3] is None][:1]  # rows that nothing tells apart but their quantity come in any order
    df = spark.createDataFrame(rows + r.sample(rows, 60), SCHEMA)
    assert found(costing.exit_costs(df)) == found(costing._costs(costing.axis(costing.estimates(df)), costing.consumption(df), None)) != []


def test_rows_of_one_key(spark):
    d = dt.date(2024, 1, 1)
    row = lambda i, t, n, k, q, v, p=1: (p, d + dt.timedelta(i), t, n, k, Decimal(q), Decimal(v), "VENDA", "lancada")
    out = row(2, "S", 7, 1, 3, 9)
    rows = [row(1, "E", 5, 1, 4, 8), row(1, "E", 6, 1, 4, 40), out, out, row(3, "S", 8, None, 1, 9), row(4, "S", 9, 1, 2, 9), row(5, "S", 9, 2, 2, 9), row(1, "S", 1, 1, 2, 3, None)]
    got = {tuple(x[:3]): (x.quantidade, x.falta, round(x.custo_total, 6)) for x in costing.exit_costs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {
        (1, 7, 1): (3, 0, 4 * 2 + 2 * 10.0),  # each of both has what both take
        (1, 8, None): (1, 0, 0.0),  # its key isn't whole
        (1, 9, 1): (2, 1, 10.0 + 6.0), (1, 9, 2): (2, 2, 12.0),  # part of it, and all of it, is missing
        (None, 1, 1): (2, 2, 3.0),
    }
