"""Catalogue: scans, balances, lots and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import costing, ledger
from . import views as V

Q = V.Catalogue()
WITH = f"WITH {V.LEDGER_SQL}"
DAY, FROM, TO = "1999-01-01", "1998-01-01", "1998-12-31"


def parts(spark, d):
    return ledger.parts_of(V.table(spark, d, "lineitem").count())  # Parquet's footers know it


@Q.add(f"{WITH} SELECT nota_id, line_no, produto_id, tipo, data_mov, round(quantidade::DOUBLE, 4) AS quantidade FROM mov WHERE data_mov <= DATE '1996-06-30' AND tipo = 'S'")
def scan_filter(spark, d):
    rows = ledger.valid(V.ledger(spark, d), "1996-06-30").filter("tipo = 'S'")
    return rows.select("nota_id", "line_no", "produto_id", "tipo", "data_mov", *V.number("quantidade"))


@Q.add("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= '1997-01-01' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def note_search(spark, d):
    rows = V.table(spark, d, "orders").filter("o_orderstatus = 'F' and o_orderdate >= timestamp'1997-01-01'")
    return rows.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100).select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_totalprice")


@Q.add("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%mer#0000001%' ORDER BY c_name, c_custkey LIMIT 50")
def party_search(spark, d):
    return V.table(spark, d, "customer").filter(F.col("c_name").ilike("%mer#0000001%")).orderBy("c_name", "c_custkey").limit(50).select("c_custkey", "c_name")


@Q.add("SELECT event_id, event_type, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 200")
def top_k(spark, d):
    return V.table(spark, d, "events").filter("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "event_type", "value")


@Q.add(f"{WITH} SELECT nota_id, line_no, tipo, ncm, c_name AS parceiro, round(valor::DOUBLE, 4) AS valor FROM mov JOIN customer ON c_custkey = parceiro_id WHERE data_mov BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'")
def ledger_extract(spark, d):
    """Both directions united, each with its party and product."""
    rows = ledger.valid(V.ledger(spark, d, part=True, customer=True)).filter("data_mov between date'1998-03-01' and date'1998-03-31'")
    both = rows.filter("tipo = 'E'").unionByName(rows.filter("tipo = 'S'"))
    names = V.table(spark, d, "customer").select(F.col("c_custkey").alias("parceiro_id"), F.col("c_name").alias("parceiro"))
    return both.join(names, "parceiro_id", "left").select("nota_id", "line_no", "tipo", "ncm", "parceiro", *V.number("valor"))


@Q.add(f"""{WITH} SELECT p_partkey AS produto_id, round(coalesce(sum(CASE tipo WHEN 'E' THEN quantidade ELSE -quantidade END), 0)::DOUBLE, 4) AS saldo
FROM part LEFT JOIN mov ON produto_id = p_partkey AND data_mov <= DATE '{DAY}' GROUP BY 1""")
def balance_by_product(spark, d):
    products = V.table(spark, d, "part").select(F.col("p_partkey").alias("produto_id"))
    return ledger.balances(V.ledger(spark, d), products, DAY).select("produto_id", *V.number("saldo"))


RUN = f"""{WITH}, run AS (SELECT *, sum(CASE tipo WHEN 'E' THEN quantidade ELSE -quantidade END) OVER (PARTITION BY produto_id ORDER BY data_mov, tipo, nota_id, line_no ROWS UNBOUNDED PRECEDING) AS saldo FROM mov)"""


@Q.add(f"{RUN} SELECT produto_id, nota_id, line_no, data_mov, round(saldo::DOUBLE, 4) AS saldo FROM run WHERE data_mov >= DATE '{FROM}'")
def running_balance(spark, d):
    return ledger.running(V.ledger(spark, d), FROM).select("produto_id", "nota_id", "line_no", "data_mov", *V.number("saldo"))


@Q.add(f"""{RUN}, neg AS (SELECT *, row_number() OVER (PARTITION BY produto_id ORDER BY data_mov, tipo, nota_id, line_no) AS rn FROM run WHERE saldo < -1e-6),
low AS (SELECT produto_id, min(saldo) AS m FROM run GROUP BY 1)
SELECT produto_id, nota_id, line_no, data_mov, round(saldo::DOUBLE, 4) AS saldo, round(m::DOUBLE, 4) AS saldo_minimo FROM neg JOIN low USING (produto_id) WHERE rn = 1""")
def first_negative(spark, d):
    return ledger.first_negative(V.ledger(spark, d)).select("produto_id", "nota_id", "line_no", "data_mov", *V.number("saldo", "saldo_minimo"))


@Q.add(f"""{WITH}, m AS (SELECT DISTINCT strftime(data_mov, '%Y-%m') AS competencia FROM mov),
closed AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS competencia FROM orders WHERE o_orderkey % 97 = 0)
SELECT competencia, CASE WHEN c.competencia IS NULL THEN 'aberta' ELSE 'fechada' END AS status FROM m LEFT JOIN closed c USING (competencia) ORDER BY competencia DESC LIMIT 36""")
def months_status(spark, d):
    closed = V.table(spark, d, "orders").filter("o_orderkey % 97 = 0").select(F.date_format("o_orderdate", "yyyy-MM").alias("competencia")).distinct()
    return ledger.months(V.ledger(spark, d), closed.withColumn("status", F.lit("fechada")))


@Q.add(f"""{WITH}, s AS (SELECT produto_id, sum(CASE tipo WHEN 'E' THEN quantidade ELSE -quantidade END) AS saldo,
  sum(quantidade) FILTER (tipo = 'S' AND data_mov >= DATE '{DAY}' - 90) AS saidas FROM mov GROUP BY 1)
SELECT produto_id, round(saldo::DOUBLE, 4) AS saldo, round(coalesce(saidas, 0)::DOUBLE, 4) AS saidas, round(CASE WHEN saidas > 0 THEN saldo::DOUBLE / (saidas::DOUBLE / 90) END, 4) AS dias FROM s""")
def coverage_days(spark, d):
    return ledger.coverage(V.ledger(spark, d), DAY).select("produto_id", *V.number("saldo", "saidas", "dias"))


EST = f"""{WITH},
per_day AS (SELECT produto_id, data_mov, sum(valor) FILTER (tipo = 'E' AND quantidade > 0 AND natureza <> 'ACERTO') AS v, sum(quantidade) FILTER (tipo = 'E' AND quantidade > 0 AND natureza <> 'ACERTO') AS q FROM ledger GROUP BY 1, 2),
upto AS (SELECT produto_id, data_mov, sum(v) OVER w AS v, sum(q) OVER w AS q FROM per_day WINDOW w AS (PARTITION BY produto_id ORDER BY data_mov)),
firsts AS (SELECT produto_id, arg_min(valor::DOUBLE / quantidade::DOUBLE, (data_mov, tipo, nota_id, line_no)) FILTER (tipo = 'E' AND valor <> 0 AND quantidade <> 0) AS u,
  sum(valor) FILTER (tipo = 'S' AND quantidade > 0)::DOUBLE / sum(quantidade) FILTER (tipo = 'S' AND quantidade > 0)::DOUBLE AS x FROM ledger GROUP BY 1),
est AS (SELECT produto_id, data_mov, coalesce(nullif(v::DOUBLE / nullif(q, 0)::DOUBLE, 0), nullif(u, 0), nullif(x, 0), 0) AS est_custo FROM upto JOIN firsts USING (produto_id))"""
AXIS = """,
run AS (SELECT *, sum(CASE tipo WHEN 'E' THEN quantidade ELSE -quantidade END) OVER w AS r FROM mov WHERE quantidade > 0 WINDOW w AS (PARTITION BY produto_id ORDER BY data_mov, tipo, nota_id, line_no ROWS UNBOUNDED PRECEDING)),
short AS (SELECT *, -least(0, min(r) OVER w) AS cs FROM run WINDOW w AS (PARTITION BY produto_id ORDER BY data_mov, tipo, nota_id, line_no ROWS UNBOUNDED PRECEDING)),
fall AS (SELECT *, cs - lag(cs, 1, 0) OVER (PARTITION BY produto_id ORDER BY data_mov, tipo, nota_id, line_no) AS falta FROM short),
axis AS (SELECT *, sum(casado) OVER (PARTITION BY produto_id, tipo ORDER BY data_mov, nota_id, line_no ROWS UNBOUNDED PRECEDING) AS hi FROM (SELECT *, quantidade - CASE tipo WHEN 'S' THEN falta ELSE 0 END AS casado FROM fall)),
lots AS (SELECT s.produto_id, s.nota_id AS saida_nota, s.line_no AS saida_linha, e.nota_id AS entrada_nota, e.line_no AS entrada_linha, s.data_mov AS saida_data, e.data_mov AS entrada_data,
    least(s.hi, e.hi) - greatest(s.hi - s.casado, e.hi - e.casado) AS usado, coalesce(CASE WHEN e.valor <> 0 THEN e.valor::DOUBLE / e.quantidade::DOUBLE END, 0) AS unit
  FROM axis s JOIN axis e ON s.produto_id = e.produto_id AND s.tipo = 'S' AND e.tipo = 'E' AND s.hi - s.casado < e.hi AND e.hi - e.casado < s.hi AND s.casado > 0 AND e.casado > 0)"""


@Q.add(f"{EST}{AXIS} SELECT produto_id, saida_nota, saida_linha, entrada_nota, entrada_linha, round(usado::DOUBLE, 4) AS quantidade, round(unit, 4) AS custo_unit FROM lots")
def fifo_consumption(spark, d):
    out = costing.consumption(V.ledger(spark, d), parts=parts(spark, d))
    return out.select("produto_id", "saida_nota", "saida_linha", "entrada_nota", "entrada_linha", *V.number("quantidade", "custo_unit"))


@Q.add(f"""{EST}{AXIS}, used AS (SELECT produto_id, saida_nota AS nota_id, saida_linha AS line_no, saida_data AS data_mov, sum(usado::DOUBLE * unit) AS c FROM lots GROUP BY ALL)
SELECT a.produto_id, a.nota_id, a.line_no, a.data_mov, round(a.quantidade::DOUBLE, 4) AS quantidade, round(falta::DOUBLE, 4) AS falta, round(coalesce(c, 0) + falta::DOUBLE * est_custo, 2) AS custo_total
FROM axis a LEFT JOIN used USING (produto_id, nota_id, line_no, data_mov) JOIN est USING (produto_id, data_mov) WHERE a.tipo = 'S'""")
def exit_cost(spark, d):
    return costing.exit_costs(V.ledger(spark, d), parts=parts(spark, d)).select("produto_id", "nota_id", "line_no", "data_mov", *V.number("quantidade", "falta"), *V.number("custo_total", digits=2))


@Q.add(f"{EST} SELECT produto_id, data_mov, round(est_custo, 4) AS est_custo FROM est")
def est_cost(spark, d):
    return costing.estimates(V.ledger(spark, d)).groupBy("produto_id", "data_mov").agg(F.max("est_custo").alias("est_custo")).select("produto_id", "data_mov", *V.number("est_custo"))


@Q.add(f"""{EST}{AXIS}, used AS (SELECT produto_id, entrada_nota AS nota_id, entrada_linha AS line_no, entrada_data AS data_mov, sum(usado) AS u FROM lots GROUP BY ALL)
SELECT a.produto_id, a.nota_id, a.line_no, a.data_mov, round(a.quantidade::DOUBLE, 4) AS quantidade, round((a.quantidade - coalesce(u, 0))::DOUBLE, 4) AS resta,
  round((a.quantidade - coalesce(u, 0))::DOUBLE * (valor::DOUBLE / a.quantidade::DOUBLE), 2) AS valor_resta
FROM axis a LEFT JOIN used USING (produto_id, nota_id, line_no, data_mov) WHERE a.tipo = 'E' AND a.quantidade > coalesce(u, 0)""")
def open_lots(spark, d):
    return costing.open_lots(V.ledger(spark, d), parts=parts(spark, d)).select("produto_id", "nota_id", "line_no", "data_mov", *V.number("quantidade", "resta"), *V.number("valor_resta", digits=2))


CUT = EST.replace("WHERE status <> 'cancelada' AND data_mov IS NOT NULL)", f"WHERE status <> 'cancelada' AND data_mov IS NOT NULL AND data_mov <= DATE '{DAY}')")


@Q.add(f"""{CUT}{AXIS}, used AS (SELECT produto_id, entrada_nota AS nota_id, entrada_linha AS line_no, entrada_data AS data_mov, sum(usado) AS u FROM lots GROUP BY ALL),
bal AS (SELECT produto_id, sum(CASE tipo WHEN 'E' THEN quantidade ELSE -quantidade END) AS saldo FROM mov GROUP BY 1),
val AS (SELECT a.produto_id, sum(CASE a.tipo WHEN 'E' THEN (a.quantidade - coalesce(u, 0))::DOUBLE * coalesce(CASE WHEN valor <> 0 THEN valor::DOUBLE / a.quantidade::DOUBLE END, 0) ELSE -falta::DOUBLE * est_custo END) AS valor
  FROM axis a LEFT JOIN used ON a.tipo = 'E' AND used.produto_id = a.produto_id AND used.nota_id = a.nota_id AND used.line_no = a.line_no AND used.data_mov = a.data_mov JOIN est ON est.produto_id = a.produto_id AND est.data_mov = a.data_mov GROUP BY 1)
SELECT produto_id, round(saldo::DOUBLE, 4) AS saldo, round(coalesce(valor, 0), 2) AS valor, round(CASE WHEN saldo > 0 THEN coalesce(valor, 0) / saldo::DOUBLE END, 2) AS custo_medio FROM bal LEFT JOIN val USING (produto_id)""")
def stock_position(spark, d):
    return costing.position(V.ledger(spark, d), DAY, parts=parts(spark, d)).select("produto_id", *V.number("saldo"), *V.number("valor", "custo_medio", digits=2))


@Q.add(f"""{WITH}, s AS (SELECT produto_id, sum(CASE WHEN data_mov < DATE '{FROM}' THEN CASE tipo WHEN 'E' THEN quantidade ELSE -quantidade END ELSE 0 END) AS abertura,
  sum(CASE WHEN data_mov >= DATE '{FROM}' AND tipo = 'E' THEN quantidade ELSE 0 END) AS entradas, sum(CASE WHEN data_mov >= DATE '{FROM}' AND tipo = 'S' THEN quantidade ELSE 0 END) AS saidas,
  sum(CASE tipo WHEN 'E' THEN quantidade ELSE -quantidade END) AS fechamento FROM mov WHERE data_mov <= DATE '{TO}' GROUP BY ROLLUP (produto_id))
SELECT produto_id, round(abertura::DOUBLE, 4) AS abertura, round(entradas::DOUBLE, 4) AS entradas, round(saidas::DOUBLE, 4) AS saidas, round(fechamento::DOUBLE, 4) AS fechamento FROM s""")
def stock_rollforward(spark, d):
    return costing.rollforward(V.ledger(spark, d), FROM, TO).select("produto_id", *V.number("abertura", "entradas", "saidas", "fechamento"))


@Q.add(f"{WITH} SELECT nota_id, line_no, produto_id, round(CASE WHEN valor <> 0 AND quantidade <> 0 THEN valor::DOUBLE / quantidade::DOUBLE END, 4) AS custo_unit FROM ledger WHERE tipo = 'E'")
def unit_cost(spark, d):
    rows = V.ledger(spark, d).filter("tipo = 'E'").withColumn("custo_unit", X.unit_cost(F.col("valor"), F.col("quantidade")))
    return rows.select("nota_id", "line_no", "produto_id", *V.number("custo_unit"))
