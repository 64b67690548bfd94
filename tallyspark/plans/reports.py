"""Catalogue: what reports and callers ask for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import assess, costing, ledger, recon, reports, sanitize
from . import stock as S
from . import tax as T
from . import views as V

Q = V.Catalogue()


@Q.add("""SELECT p_partkey, CASE WHEN p_size % 5 <> 0 AND p_size % 7 <> 0 THEN CAST(p_size % 9 AS VARCHAR) || lpad(CAST(p_size AS VARCHAR), 2, '0') END AS cst FROM part""")
def composite_cst(spark, d):
    size = F.col("p_size")
    origin = F.when(size % 5 != 0, (size % 9).cast("string")).otherwise("")
    return V.table(spark, d, "part").select("p_partkey", X.full_cst(origin, F.when(size % 7 != 0, F.lpad(size.cast("string"), 2, "0"))).alias("cst"))


@Q.add("""SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_partkey, ' ' ORDER BY l_linenumber, l_partkey), '') AS itens, count(l_orderkey) AS n
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag <> 'N' GROUP BY 1""")
def note_items(spark, d):
    items = V.table(spark, d, "lineitem").filter("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    out = reports.note_items(V.table(spark, d, "orders").select("o_orderkey"), items, "o_orderkey", ["l_linenumber", "l_partkey"])
    text = F.transform("itens", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string")))
    return out.select("o_orderkey", F.array_join(text, " ").alias("itens"), F.size("itens").cast("long").alias("n"))


@Q.add(f"""WITH {V.BOOKS_SQL}, docs AS (SELECT unnest(range(0, 40)) AS documento), b AS (SELECT numero % 37 AS documento, cents FROM book_b)
SELECT documento, round(coalesce(sum(cents), 0)::DOUBLE / 100, 2) AS total_extraido, count(cents) > 0 AS conferido FROM docs LEFT JOIN b USING (documento) GROUP BY 1""")
def book_totals(spark, d):
    lines = V.book(spark, d, "b").select((F.col("numero") % 37).alias("documento"), (F.col("cents") / F.lit(100).cast("decimal(5,0)")).alias("valor_contabil"))
    return reports.book_totals(spark.range(40).withColumnRenamed("id", "documento"), lines).select("documento", *V.number("total_extraido", digits=2), "conferido")


@Q.add(f"""WITH {V.BOOKS_SQL} SELECT 'a' AS documento, numero, seq, cfop, cents, NULL AS cod_fiscal FROM book_a UNION ALL SELECT 'b', numero, seq, NULL, cents, '7' FROM book_b""")
def book_insert(spark, d):
    parts = {"a": V.book(spark, d, "a"), "b": V.book(spark, d, "b").drop("cfop").withColumn("cod_fiscal", F.lit(7)).withColumn("sobra", F.lit(1))}
    return reports.typed_lines(parts, {"numero": "long", "seq": "int", "cfop": "string", "cents": "long", "cod_fiscal": "string"})


MONTH = "1996-03"


@Q.add(f"""WITH pos AS ({S.Q.sql["stock_position"]}), tax AS ({T.Q.sql["assessment_summary"]})
SELECT round((SELECT sum(saldo) FROM pos), 2) AS estoque_qtd, round((SELECT sum(valor) FROM pos), 0) AS estoque_valor, (SELECT count(*) FROM pos) AS produtos,
  round((SELECT base_beneficiada FROM tax WHERE competencia = '{MONTH}'), 1) AS base_beneficiada, round((SELECT icms_recolher FROM tax WHERE competencia = '{MONTH}'), 1) AS icms_recolher,
  (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS excecoes_abertas""")
def dashboard(spark, d):
    month = assess.summary(T.items(spark, d), V.rates(spark)).filter(F.col("competencia") == MONTH)
    issues = V.table(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("resolvida"))
    out = reports.dashboard(costing.position(V.ledger(spark, d), S.DAY, parts=S.parts(spark, d)), month, issues)
    return out.select(*V.number("estoque_qtd", digits=2), *V.number("estoque_valor", digits=0), "produtos", *V.number("base_beneficiada", "icms_recolher", digits=1), "excecoes_abertas")


@Q.add("""SELECT o_orderkey, '{"nota":' || o_orderkey || ',"status":"' || o_orderstatus || '","itens":[' || coalesce(string_agg('{"linha":' || l_linenumber || ',"produto":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey), '') || ']}' AS payload
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def note_payload(spark, d):
    items = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("nota"), F.col("l_linenumber").alias("linha"), F.col("l_partkey").alias("produto"))
    notes = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("nota"), F.col("o_orderstatus").alias("status"))
    out = reports.note_items(notes, items, "nota", ["linha", "produto"])
    return out.select(F.col("nota").alias("o_orderkey"), F.to_json(F.struct("nota", "status", "itens")).alias("payload"))


@Q.add("""SELECT n_nationkey AS chave, CASE WHEN n_nationkey = 7 THEN 'aceito' ELSE 'aberta' END AS status, n_nationkey = 7 AS fechada, CASE WHEN n_nationkey = 7 THEN 'ana' END AS usuario FROM nation""")
def finding_justified(spark, d):
    found = V.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("chave"), F.lit("aberta").alias("status"))
    out = recon.justify(recon.justify(found, "7", "aceito", "ana", "nota de ajuste"), "9", "aberta", "rui", "reaberta")
    return out.select(F.col("chave").cast("int").alias("chave"), "status", F.col("em").isNotNull().alias("fechada"), F.when(F.col("status") != "aberta", F.col("usuario")).alias("usuario"))


@Q.add(f"""WITH neg AS ({S.Q.sql["first_negative"]}), ex AS ({S.Q.sql["exit_cost"]}), pos AS ({S.Q.sql["stock_position"]})
SELECT 'saldo negativo' AS regra, produto_id, round(saldo, 3) AS quantidade FROM neg UNION ALL SELECT 'saida sem lastro', NULL, round(sum(falta), 3) FROM ex HAVING max(falta) > 0
UNION ALL SELECT 'saldo final negativo', produto_id, round(saldo, 3) FROM pos WHERE saldo < -1e-6 UNION ALL SELECT 'estoque sem valor', produto_id, round(saldo, 3) FROM pos WHERE saldo > 0 AND coalesce(valor, 0) = 0""")
def stock_anomalies(spark, d):
    rows = V.ledger(spark, d)
    out = reports.stock_anomalies(ledger.first_negative(rows), costing.exit_costs(rows, parts=S.parts(spark, d)), costing.position(rows, S.DAY, parts=S.parts(spark, d)))
    return out.select("regra", "produto_id", *V.number("quantidade", digits=3))


@Q.add("""WITH p AS (SELECT s_suppkey AS parceiro_id, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'c' || s_suppkey END AS cnpj, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'SC' END AS uf, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'fornecedor' END AS papel FROM supplier),
n AS (SELECT l_suppkey AS parceiro_id, l_orderkey * 10 + l_linenumber AS ordem, CASE WHEN l_orderkey % 2 = 0 THEN 'x' || l_orderkey ELSE '' END AS cnpj, CASE WHEN l_linenumber > 2 THEN 'U' || l_linenumber END AS uf, CASE WHEN l_suppkey % 7 = 0 THEN 'cliente' ELSE 'fornecedor' END AS papel FROM lineitem),
t AS (SELECT parceiro_id, arg_min(cnpj, ordem) FILTER (cnpj <> '') AS cnpj, arg_min(uf, ordem) FILTER (uf <> '') AS uf, bool_or(papel = 'cliente') AS other FROM n GROUP BY 1)
SELECT parceiro_id, coalesce(nullif(p.cnpj, ''), t.cnpj) AS cnpj, coalesce(p.uf, t.uf) AS uf, CASE WHEN p.papel <> '' AND t.other THEN 'ambos' ELSE p.papel END AS papel FROM p LEFT JOIN t USING (parceiro_id)""")
def party_upkeep(spark, d):
    k, o = F.col("s_suppkey"), F.col("l_orderkey")
    parties = V.table(spark, d, "supplier").select(k.alias("parceiro_id"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("c"), k.cast("string"))).alias("cnpj"), F.when(k % 4 != 0, "SC").alias("uf"), F.when(k % 5 != 0, "fornecedor").alias("papel"))
    seen = V.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("parceiro_id"), (o * 10 + F.col("l_linenumber")).alias("ordem"), F.when(o % 2 == 0, F.concat(F.lit("x"), o.cast("string"))).otherwise("").alias("cnpj"),
        F.when(F.col("l_linenumber") > 2, F.concat(F.lit("U"), F.col("l_linenumber").cast("string"))).alias("uf"), F.when(F.col("l_suppkey") % 7 == 0, "cliente").otherwise("fornecedor").alias("papel"),
    )
    return reports.keep_parties(parties, seen)


NAMES = "names AS (SELECT upper(regexp_replace(p_name, '[^A-Za-z]+', ' ', 'g')) AS k, p_partkey % 4 AS m FROM part), keys AS (SELECT trim(CASE m WHEN 0 THEN split_part(k, ' ', 1) WHEN 1 THEN k || ' LTDA' WHEN 2 THEN k ELSE substr(k, 1, 24) END) AS chave, count(*) AS qtd FROM names GROUP BY 1)"


@Q.add(rf"""WITH {NAMES}, f AS (SELECT chave, length(chave) >= 20 AS longa,
  CASE WHEN position(' ' IN substr(chave, 1, 20)) = 0 THEN substr(chave, 1, 20) WHEN position(' ' IN substr(chave, 21)) = 0 THEN chave ELSE substr(chave, 1, 19 + position(' ' IN substr(chave, 21))) END AS p FROM keys WHERE chave <> ''),
l AS (SELECT chave, first_value(chave) OVER (PARTITION BY p ORDER BY length(chave) DESC, chave) AS grupo FROM f WHERE longa),
s AS (SELECT a.chave, coalesce((SELECT b.chave FROM keys b WHERE starts_with(b.chave, a.chave || ' ') ORDER BY length(b.chave) DESC, b.chave LIMIT 1), a.chave) AS grupo FROM f a WHERE NOT longa)
SELECT chave, grupo FROM l UNION ALL SELECT chave, grupo FROM s""")
def grouped_names(spark, d):
    m = F.col("p_partkey") % 4
    k = F.upper(F.regexp_replace("p_name", "[^A-Za-z]+", " "))
    chave = F.trim(F.when(m == 0, F.split_part(k, F.lit(" "), F.lit(1))).when(m == 1, F.concat(k, F.lit(" LTDA"))).when(m == 2, k).otherwise(F.substring(k, 1, 24)))
    names = V.table(spark, d, "part").select(chave.alias("chave")).groupBy("chave").agg(F.count("*").alias("qtd"))
    return sanitize.grouped_names(names).select("chave", "grupo")
