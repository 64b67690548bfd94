"""Catalogue: rates, the assessment and its closing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assess, rates
from . import views as V

Q = V.Catalogue()
WITH = f"WITH {V.LEDGER_SQL}, {V.RATES_SQL}"
AT = "d.bloco = r.bloco AND vigencia_inicio <= data_mov AND (vigencia_fim IS NULL OR vigencia_fim >= data_mov)"


def items(spark, d):
    return V.ledger(spark, d, part=True).withColumn("base", F.col("valor"))


@Q.add(f"{WITH} SELECT nota_id, line_no, produto_id, d.bloco, data_mov, aliquota, aliq_presumido FROM mov d JOIN rates r ON {AT}")
def asof_rate(spark, d):
    from ..operators.ledger import valid

    return rates.asof(valid(items(spark, d)), V.rates(spark), ["bloco"]).select("nota_id", "line_no", "produto_id", "bloco", "data_mov", "aliquota", "aliq_presumido")


@Q.add(f"{WITH} SELECT nota_id, line_no, produto_id FROM ledger d WHERE EXISTS (SELECT 1 FROM rates r WHERE {AT})")
def known_code(spark, d):
    return rates.known(V.ledger(spark, d, part=True), V.rates(spark), ["bloco"]).select("nota_id", "line_no", "produto_id")


#: A table by product code and scope over the test data's product types.
TABLE = [("ECONOMY", "interna", "2"), ("ECONOMY", "interestadual", "1"), ("STANDARD", "interestadual", "2"), ("PROMO", "interna", "3"), ("PROMO", "interestadual", "3"), ("SMALL", "interestadual", "2")]
TABLE_SQL = "code_table AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{s}', '{b}')" for n, s, b in TABLE) + ") t(ncm, ambito, bloco_tabela))"


def code_table(spark):
    rows = ", ".join(f"('{n}', '{s}', '{b}')" for n, s, b in TABLE)
    return spark.sql(f"SELECT *, date'1990-01-01' AS vigencia_inicio, cast(NULL AS date) AS vigencia_fim FROM VALUES {rows} AS t(ncm, ambito, bloco)")


@Q.add(f"{WITH}, {TABLE_SQL} SELECT nota_id, line_no, produto_id, l.ncm, l.ambito, bloco_tabela AS bloco FROM ledger l LEFT JOIN code_table USING (ncm, ambito)")
def derive_block(spark, d):
    rows = V.ledger(spark, d, part=True, customer=True).drop("bloco")
    return rates.asof(rows, code_table(spark), ["ncm", "ambito"], how="left").select("nota_id", "line_no", "produto_id", "ncm", "ambito", "bloco")


@Q.add("SELECT o_custkey, CAST(o_orderdate AS DATE) AS vigencia_inicio, o_orderkey, CAST(CAST(lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) - 1 AS DATE) AS VARCHAR) AS vigencia_fim FROM orders WHERE o_orderstatus = 'F'")
def scd_chain(spark, d):
    from pyspark.sql import Window as W

    rows = V.table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderdate").cast("date").alias("vigencia_inicio"), "o_orderkey")
    w = W.partitionBy("o_custkey").orderBy("vigencia_inicio", "o_orderkey")
    return rows.withColumn("vigencia_fim", F.date_sub(F.lead("vigencia_inicio").over(w), 1).cast("string"))


@Q.add("SELECT c_custkey, CASE WHEN c_nationkey > 20 THEN NULL WHEN c_nationkey = 0 THEN '3' ELSE '2' END AS bloco FROM customer")
def suggest_block(spark, d):
    uf = F.when(F.col("c_nationkey") == 0, "sc").otherwise("SP")
    return V.table(spark, d, "customer").select("c_custkey", rates.suggested_block(uf, F.col("c_nationkey") > 20).alias("bloco"))


@Q.add(f"""{WITH}, {TABLE_SQL}, x AS (SELECT l.bloco, t.bloco_tabela FROM ledger l LEFT JOIN code_table t ON t.ncm = l.ncm AND t.ambito = CASE l.bloco WHEN '3' THEN 'interna' ELSE 'interestadual' END)
SELECT CASE WHEN bloco IS NULL THEN 'sem bloco' WHEN bloco_tabela IS NULL THEN 'sem regra' WHEN bloco = bloco_tabela THEN 'confere' ELSE 'diverge' END AS situacao, count(*) AS n FROM x GROUP BY 1""")
def consistency_check(spark, d):
    return rates.consistency(V.ledger(spark, d, part=True), code_table(spark)).groupBy("situacao").agg(F.count("*").alias("n"))


BLOCKS = f"""{WITH},
taxed AS (SELECT strftime(data_mov, '%Y-%m') AS competencia, d.bloco, natureza = 'DEVOLUCAO' AS devolucao, aliquota, aliq_presumido, sum(valor) AS base, count(*) AS notas FROM mov d JOIN rates r ON {AT} GROUP BY ALL),
blocks AS (SELECT competencia, bloco, devolucao, sum(base::DOUBLE) AS base, sum(base::DOUBLE * aliquota) AS icms, sum(base::DOUBLE * aliq_presumido) AS presumido, sum(notas)::BIGINT AS notas FROM taxed GROUP BY 1, 2, 3)"""


def _totals(rows: str, keys: str) -> str:
    part = lambda c, b: f"coalesce(sum({c}) FILTER ({'' if b else 'NOT '}devolucao), 0)"
    return f"""SELECT {keys}, base_beneficiada, base_devolucao, debito, credito_presumido, estorno, devolucao_icms, debito - devolucao_icms AS icms_deduzir,
  (debito + estorno) - (credito_presumido + devolucao_icms) AS icms_recolher,
  (0.004::DOUBLE * base_beneficiada - 0.02::DOUBLE * credito_presumido) - (0.004::DOUBLE * base_devolucao - 0.02::DOUBLE * estorno) AS fundo_social,
  greatest(0.004::DOUBLE * base_beneficiada - 0.02::DOUBLE * credito_presumido, 0) - greatest(0.004::DOUBLE * base_devolucao - 0.02::DOUBLE * estorno, 0) AS fundo_social_planilha,
  0.02::DOUBLE * (credito_presumido - estorno) AS fundo_educacao,
  CASE WHEN base_beneficiada <> 0 THEN ((debito + estorno) - (credito_presumido + devolucao_icms)) / base_beneficiada * 100 ELSE 0 END AS carga_efetiva
  FROM (SELECT {keys}, {part('base', 0)} AS base_beneficiada, {part('base', 1)} AS base_devolucao, {part('icms', 0)} AS debito, {part('presumido', 0)} AS credito_presumido,
    {part('icms', 1)} AS devolucao_icms, {part('presumido', 1)} AS estorno FROM {rows} GROUP BY {keys})"""


MONEY = ("base_beneficiada", "base_devolucao", "debito", "credito_presumido", "estorno", "devolucao_icms", "icms_deduzir", "icms_recolher", "fundo_social", "fundo_social_planilha", "fundo_educacao", "carga_efetiva")
ROUNDED = ", ".join(f"round({c}, 2) AS {c}" for c in MONEY)


@Q.add(f"{BLOCKS} SELECT competencia, bloco, devolucao, round(base, 2) AS base, round(icms, 2) AS icms, round(presumido, 2) AS presumido, notas FROM blocks")
def assessment_blocks(spark, d):
    return assess.blocks(items(spark, d), V.rates(spark)).select("competencia", "bloco", "devolucao", *V.number("base", "icms", "presumido", digits=2), "notas")


@Q.add(f"{BLOCKS}, t AS ({_totals('blocks', 'competencia')}) SELECT competencia, {ROUNDED} FROM t")
def assessment_summary(spark, d):
    return assess.summary(items(spark, d), V.rates(spark)).select("competencia", *V.number(*MONEY, digits=2))


@Q.add(f"""{BLOCKS}, per AS (SELECT competencia, bloco, icms / base AS a, presumido / base AS p FROM blocks WHERE NOT devolucao AND base <> 0),
every AS (SELECT 'atual' AS cenario, competencia, devolucao, base, icms, presumido FROM blocks
  UNION ALL SELECT 'bloco ' || b, competencia, devolucao, base, icms, presumido FROM blocks, (VALUES ('2'), ('3')) v(b)
  UNION ALL SELECT 'bloco ' || bloco, competencia, false, 100000, a * 100000, p * 100000 FROM per WHERE bloco IN ('2', '3')),
t AS ({_totals('every', 'competencia, cenario')}), now AS (SELECT competencia, icms_recolher AS x FROM t WHERE cenario = 'atual')
SELECT competencia, cenario, round(icms_recolher, 2) AS icms_recolher, round(icms_recolher - x, 2) AS diferenca FROM t JOIN now USING (competencia)""")
def scenario(spark, d):
    return assess.scenarios(items(spark, d), V.rates(spark), 100_000.0).select("competencia", "cenario", *V.number("icms_recolher", "diferenca", digits=2))


@Q.add(f"{WITH} SELECT bloco, string_agg(DISTINCT ncm, ', ' ORDER BY ncm) AS produtos FROM mov WHERE bloco IS NOT NULL GROUP BY 1")
def block_products(spark, d):
    from ..operators.ledger import valid

    rows = valid(items(spark, d)).filter("bloco is not null").groupBy("bloco").agg(F.collect_set("ncm").alias("p"))
    return rows.select("bloco", F.array_join(F.array_sort("p"), ", ").alias("produtos"))


@Q.add(f"""{BLOCKS}, t AS ({_totals('blocks', 'competencia')}),
taxed2 AS (SELECT strftime(data_mov, '%Y-%m') AS competencia, d.bloco, natureza = 'DEVOLUCAO' AS devolucao, aliquota, aliq_presumido, sum(valor) AS base FROM mov d JOIN rates r ON {AT} WHERE NOT (line_no = 1 AND data_mov >= DATE '1998-01-01') GROUP BY ALL),
blocks2 AS (SELECT competencia, bloco, devolucao, sum(base::DOUBLE) AS base, sum(base::DOUBLE * aliquota) AS icms, sum(base::DOUBLE * aliq_presumido) AS presumido FROM taxed2 GROUP BY 1, 2, 3),
n AS ({_totals('blocks2', 'competencia')}),
g AS (SELECT t.competencia, greatest({', '.join(f'abs(round(t.{c}, 2) - round(coalesce(n.{c}, 0), 2))' for c in assess.COMPARED)}) AS g FROM t LEFT JOIN n USING (competencia))
SELECT competencia, round(g, 2) AS diferenca, g < 0.01 AS coerente FROM g""")
def close_compare(spark, d):
    """Months frozen from the whole ledger against one from which lines have gone since."""
    rows = items(spark, d)
    frozen = assess.summary(rows, V.rates(spark)).select("competencia", *(V.rounded(F.col(c), 2).alias(c) for c in assess.COMPARED))
    left = rows.filter("not (line_no = 1 and data_mov >= date'1998-01-01')")
    now = assess.summary(left, V.rates(spark)).select("competencia", *(V.rounded(F.col(c), 2).alias(c) for c in assess.COMPARED))
    return assess.drift(frozen, now).select("competencia", *V.number("diferenca", digits=2), "coerente")


CELLS = "SELECT strftime(o_orderdate, '%Y-%m') AS competencia, CASE o_orderkey % 3 WHEN 0 THEN '04' WHEN 1 THEN '05' ELSE '09' END AS quadro, CASE o_orderkey % 7 WHEN 0 THEN '010' WHEN 1 THEN '020' WHEN 2 THEN '030' WHEN 3 THEN '060' WHEN 4 THEN '036' WHEN 5 THEN '075' ELSE '076' END AS item, sum(CAST(o_totalprice AS DECIMAL(15,2))) AS valor FROM orders GROUP BY ALL"


@Q.add(f"""WITH c AS ({CELLS}), s AS (SELECT competencia,
  coalesce(sum(valor) FILTER ((quadro = '04' AND item IN ('010', '020', '030', '060')) OR (quadro = '09' AND item IN ('036', '038'))), 0)::DOUBLE AS d,
  coalesce(sum(valor) FILTER ((quadro = '05' AND item IN ('010', '020')) OR (quadro = '09' AND item IN ('075', '076'))), 0)::DOUBLE AS c FROM c GROUP BY 1)
SELECT competencia, round(d, 2) AS debitos, round(c, 2) AS creditos, round(greatest(d - c, 0), 2) AS recolher, round(greatest(c - d, 0), 2) AS transportar FROM s""")
def statement_close(spark, d):
    k = F.col("o_orderkey")
    table = F.when(k % 3 == 0, "04").when(k % 3 == 1, "05").otherwise("09")
    item = F.when(k % 7 == 0, "010").when(k % 7 == 1, "020").when(k % 7 == 2, "030").when(k % 7 == 3, "060").when(k % 7 == 4, "036").when(k % 7 == 5, "075").otherwise("076")
    cells = V.table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("competencia"), table.alias("quadro"), item.alias("item"))
    cells = cells.agg(F.sum(F.col("o_totalprice").cast("decimal(15,2)")).cast("double").alias("valor"))
    return assess.statement(cells, ["competencia"]).select("competencia", *V.number("debitos", "creditos", "recolher", "transportar", digits=2))


@Q.add(f"""{WITH}, x AS (SELECT 'entradas' AS controle, sum(quantidade) FILTER (tipo = 'E')::DOUBLE AS base, sum(floor(quantidade)) FILTER (tipo = 'E')::DOUBLE AS referencia FROM mov
  UNION ALL SELECT 'saidas', sum(quantidade) FILTER (tipo = 'S')::DOUBLE, sum(floor(quantidade)) FILTER (tipo = 'S')::DOUBLE FROM mov
  UNION ALL SELECT 'valor', sum(valor)::DOUBLE, sum(floor(valor))::DOUBLE FROM mov)
SELECT controle, round(base, 2) AS base, round(referencia, 2) AS referencia, round(base - referencia, 2) AS diferenca, abs(base - referencia) <= 0.5 AS ok FROM x""")
def control_totals(spark, d):
    """Totals against their reference (here from whole units), within 0.5; one pass over the ledger."""
    from ..operators.ledger import valid

    cases = {"entradas": ("quantidade", "E"), "saidas": ("quantidade", "S"), "valor": ("valor", None)}
    aggs = []
    for name, (c, kind) in cases.items():
        here = F.lit(True) if kind is None else F.col("tipo") == kind
        aggs += [F.sum(F.when(here, F.col(c))).cast("double").alias(f"{name}_b"), F.sum(F.when(here, F.floor(c))).cast("double").alias(f"{name}_r")]
    one = valid(V.ledger(spark, d)).agg(*aggs)
    out = reduce(DataFrame.unionByName, [one.select(F.lit(n).alias("controle"), F.col(f"{n}_b").alias("base"), F.col(f"{n}_r").alias("referencia")) for n in cases])
    return out.withColumn("diferenca", F.col("base") - F.col("referencia")).select("controle", *V.number("base", "referencia", "diferenca", digits=2), (F.abs("diferenca") <= 0.5).alias("ok"))
