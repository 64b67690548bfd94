"""Catalogue: a ledger in which one product has a third of all rows, worked through in blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import costing, ledger, scan
from . import stock
from . import views as V

Q = V.Catalogue()
#: Rows from which a product counts as hot here: small, so that there are blocks at every scale.
SIZE = 2_000
_OWN, _ONE = "l_partkey AS produto_id", "CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_partkey END AS produto_id"


def _ledger(spark, d):
    one = lambda rows: rows.withColumn("produto_id", F.when(F.col("produto_id") % 3 == 0, 0).otherwise(F.col("produto_id")))
    return one(V.ledger(spark, d)), scan.hot_products(one(V.ledger(spark, d, orders=False)), SIZE)  # orders don't count for it


def _sql(name: str) -> str:
    return stock.Q.sql[name].replace(_OWN, _ONE)


@Q.add(_sql("running_balance"))
def hot_running_balance(spark, d):
    rows, hot = _ledger(spark, d)
    return ledger.running(rows, stock.FROM, hot, SIZE).select("produto_id", "nota_id", "line_no", "data_mov", *V.number("saldo"))


@Q.add(_sql("first_negative"))
def hot_first_negative(spark, d):
    rows, hot = _ledger(spark, d)
    return ledger.first_negative(rows, hot, SIZE).select("produto_id", "nota_id", "line_no", "data_mov", *V.number("saldo", "saldo_minimo"))


@Q.add(_sql("fifo_consumption"))
def hot_fifo_consumption(spark, d):
    rows, hot = _ledger(spark, d)
    return costing.consumption(rows, hot, SIZE).select("produto_id", "saida_nota", "saida_linha", "entrada_nota", "entrada_linha", *V.number("quantidade", "custo_unit"))


@Q.add(_sql("exit_cost"))
def hot_exit_cost(spark, d):
    rows, hot = _ledger(spark, d)
    return costing.exit_costs(rows, hot, SIZE).select("produto_id", "nota_id", "line_no", "data_mov", *V.number("quantidade", "falta"), *V.number("custo_total", digits=2))


@Q.add(_sql("open_lots"))
def hot_open_lots(spark, d):
    rows, hot = _ledger(spark, d)
    return costing.open_lots(rows, None, hot, SIZE).select("produto_id", "nota_id", "line_no", "data_mov", *V.number("quantidade", "resta"), *V.number("valor_resta", digits=2))


@Q.add(_sql("stock_position"))
def hot_stock_position(spark, d):
    rows, hot = _ledger(spark, d)
    return costing.position(rows, stock.DAY, hot, SIZE).select("produto_id", *V.number("saldo"), *V.number("valor", "custo_medio", digits=2))
