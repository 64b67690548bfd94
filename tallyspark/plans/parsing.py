"""Catalogue: books and XML made from the tables, parsed back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import books, nfe
from . import views as V

Q = V.Catalogue()


def _customers(spark, d):
    a = F.abs(F.col("c_acctbal"))
    return V.table(spark, d, "customer").select(
        F.col("c_nationkey").cast("string").alias("arquivo"), "c_custkey", (F.col("c_custkey") % 2).alias("lado"), (1000 + F.col("c_custkey") % 50 + 4000 * (F.col("c_custkey") % 2)).cast("string").alias("cfop"), X.brazilian(a).alias("v"), X.brazilian(a / 2).alias("w"))


def _codes(spark, d, heads):
    c = _customers(spark, d)
    line = F.concat_ws("   ", "cfop", "v", "w", F.lit("0,00"), F.lit("(1,50)"), F.lit("1.234,56"), F.lit("0,00"), F.lit("0,00"), F.lit("7,25"))
    files = c.select("arquivo").distinct()
    parts = [c.select("arquivo", (F.col("c_custkey") + 1 + F.col("lado") * 10**9).alias("line_no"), line.alias("line"))]
    parts += [files.select("arquivo", F.lit(n).cast("long").alias("line_no"), F.lit(h).alias("line")) for n, h in heads]
    return reduce(DataFrame.unionByName, parts)


@Q.add("""WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS arquivo, c_custkey, CASE c_custkey % 2 WHEN 0 THEN 'entradas' ELSE 'saidas' END AS tipo, CAST(1000 + c_custkey % 50 + 4000 * (c_custkey % 2) AS VARCHAR) AS cfop, abs(c_acctbal) AS v FROM customer)
SELECT arquivo, tipo, cfop, round(arg_max(v, c_custkey), 2) AS valor_contabil, -1.5::DOUBLE AS isentas, 1234.56::DOUBLE AS outras, CASE tipo WHEN 'entradas' THEN 7.25::DOUBLE ELSE 0 END AS difal FROM c GROUP BY 1, 2, 3""")
def section_parser(spark, d):
    rows = _codes(spark, d, [(0, "01 VALORES FISCAIS ENTRADAS"), (10**9, "2  VALORES FISCAIS SAÍDAS"), (3 * 10**9, "03 RESUMO DOS VALORES"), (3 * 10**9 + 1, "1101 1,00 1,00 1,00 1,00 1,00")])
    return books.dime_codes(rows).select("arquivo", "tipo", "cfop", *V.number("valor_contabil", digits=2), "isentas", "outras", "difal")


@Q.add("""WITH o AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN '1' WHEN 3 THEN '2' WHEN 6 THEN '3' END AS b FROM orders)
SELECT o_custkey, o_orderkey, last_value(b IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS bloco FROM o""")
def block_context(spark, d):
    k = F.col("o_orderkey") % 9
    rows = V.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_custkey").alias("arquivo"), F.col("o_orderkey").alias("line_no"), F.when(k == 0, "0.6").when(k == 3, "1.0").when(k == 6, "2.1").alias("carga"))
    return books.with_block(rows, "carga", {"0.6": "1", "1.0": "2", "2.1": "3"}).select("o_custkey", "o_orderkey", "bloco")


LINES = """x AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_shipdate, l_linenumber) AS seq, l_suppkey, l_extendedprice AS p, strftime(l_shipdate, '%d/%m/%Y') AS dia, l_linenumber AS n FROM lineitem)"""


def _lines(spark, d):
    order = W.partitionBy("l_orderkey").orderBy("l_partkey", "l_shipdate", "l_linenumber")
    return V.table(spark, d, "lineitem").select("l_orderkey", F.row_number().over(order).alias("seq"), "l_suppkey", F.col("l_extendedprice").alias("p"), F.date_format("l_shipdate", "dd/MM/yyyy").alias("dia"), F.col("l_linenumber").alias("n"))


@Q.add(f"""WITH {LINES} SELECT l_orderkey AS arquivo, CAST(seq AS VARCHAR) AS numero, dia AS data_entrada, 'C' || CAST(l_suppkey AS VARCHAR) AS emitente, round(p, 2) AS valor_contabil, '1101' AS cfop, 12::DOUBLE AS aliquota, CASE WHEN n % 3 = 0 THEN round(p, 2) ELSE 0 END AS difal FROM x""")
def attach_following(spark, d):
    x, br = _lines(spark, d), X.brazilian(F.col("p"))
    main = F.concat_ws("  ", "dia", F.lit("NF E"), F.lit("1"), F.lpad(F.col("seq").cast("string"), 5, "0"), "dia", F.concat(F.lit("C"), F.col("l_suppkey").cast("string")), F.lit("SC"), br, F.lit("1-101"), F.lit("1"), br, F.lit("12,00"), F.lit("3,00"))
    rows = x.select(F.col("l_orderkey").alias("arquivo"), (F.col("seq") * 3).alias("line_no"), main.alias("line"))
    more = x.filter("n % 3 = 0").select(F.col("l_orderkey").alias("arquivo"), (F.col("seq") * 3 + 1).alias("line_no"), F.concat(F.lit("4 1,00 "), br).alias("line"))
    out = books.inbound_accounting(rows.unionByName(more))
    return out.select("arquivo", "numero", "data_entrada", "emitente", *V.number("valor_contabil", digits=2), "cfop", "aliquota", *V.number("difal", digits=2))


@Q.add(f"""WITH {LINES} SELECT l_orderkey AS arquivo, CAST(seq AS VARCHAR) AS numero, round(p, 2) AS valor_contabil, '1102' AS cfop, CASE WHEN n % 3 = 0 THEN '2' ELSE '' END AS cod_fiscal, CASE WHEN n % 3 = 0 THEN round(p, 2) ELSE 0 END AS base_calculo, CASE WHEN n % 3 = 0 THEN 12.0::DOUBLE ELSE 0 END AS aliquota FROM x""")
def attach_preceding(spark, d):
    x, br = _lines(spark, d), X.brazilian(F.col("p"))
    main = F.concat_ws(" ", "dia", F.lit("55"), F.lit("1"), F.col("seq").cast("string"), "dia", F.lpad(F.col("l_suppkey").cast("string"), 14, "0"), F.lit("SC"), br, F.lit("1102"))
    rows = x.select(F.col("l_orderkey").alias("arquivo"), (F.col("seq") * 3).alias("line_no"), main.alias("line"))
    tax = x.filter("n % 3 = 0").select(F.col("l_orderkey").alias("arquivo"), (F.col("seq") * 3 - 1).alias("line_no"), F.concat(F.lit("ICMS 2 "), br, F.lit(" 12 3,00")).alias("line"))
    older = x.filter("n % 3 = 0").select(F.col("l_orderkey").alias("arquivo"), (F.col("seq") * 3 - 2).alias("line_no"), F.lit("ICMS 9 5,00 7 3,00").alias("line"))
    out = books.inbound_company(rows.unionByName(tax).unionByName(older))
    return out.select("arquivo", "numero", *V.number("valor_contabil", digits=2), "cfop", "cod_fiscal", *V.number("base_calculo", digits=2), "aliquota")


@Q.add(f"""WITH {LINES} SELECT lpad(CAST(l_orderkey AS VARCHAR), 44, '0') AS chave_acesso, CAST(l_orderkey AS VARCHAR) AS numero, strftime(o_orderdate, '%Y-%m-%d') AS data_emissao, seq AS ordem, 'P' || CAST(l_suppkey AS VARCHAR) AS descricao, CAST(5100 + n AS VARCHAR) AS cfop, round(p, 2) AS valor, CASE WHEN n % 2 = 0 THEN '1' ELSE '0' END AS origem, 0.04::DOUBLE AS aliquota
FROM x JOIN orders ON o_orderkey = l_orderkey""")
def xml_roundtrip(spark, d):
    """Every order as an invoice, with and without prefix and envelope, read back to its items."""
    n = F.col("n")
    price = F.col("p").cast("decimal(15,2)").cast("string")
    group = F.when(n % 2 == 0, "ICMS00").otherwise("ICMSSN101")
    det = F.concat(
        F.lit('<det nItem="'), F.col("seq").cast("string"), F.lit('"><prod><xProd>P'), F.col("l_suppkey").cast("string"), F.lit("</xProd><NCM>76020000</NCM><CFOP>"), (5100 + n).cast("string"), F.lit("</CFOP><qCom>1.0000</qCom><vProd>"), price,
        F.lit("</vProd></prod><imposto><ICMS><"), group, F.lit("><orig>"), F.when(n % 2 == 0, "1").otherwise("0"), F.lit("</orig><CST>00</CST><vBC>"), price, F.lit("</vBC><pICMS>4.00</pICMS><vICMS>1.00</vICMS></"), group, F.lit("></ICMS></imposto></det>"),
    )
    dets = _lines(spark, d).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", det.alias("x")))), lambda s: s["x"]), "").alias("dets"))
    o = dets.join(V.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    key = F.lpad(F.col("l_orderkey").cast("string"), 44, "0")
    inf = F.concat(F.lit('<infNFe Id="NFe'), key, F.lit('" versao="4.00"><ide><nNF>'), F.col("l_orderkey").cast("string"), F.lit("</nNF><serie>1</serie><tpNF>1</tpNF><dhEmi>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T23:30:00-03:00</dhEmi></ide><emit><CNPJ>1</CNPJ></emit><dest><CNPJ>2</CNPJ></dest>"), "dets", F.lit("</infNFe>"))
    bare = F.concat(F.lit('<?xml version="1.0"?><NFe xmlns="http://www.portalfiscal.inf.br/nfe">'), inf, F.lit("</NFe>"))
    wrapped = F.concat(F.lit('<nfeProc xmlns="http://www.portalfiscal.inf.br/nfe"><NFe>'), inf, F.lit("</NFe></nfeProc>"))
    prefixed = F.regexp_replace(F.regexp_replace(bare, r"<(/?)(\w)", "<$1n:$2"), "xmlns=", "xmlns:n=")
    xml = F.when(F.col("l_orderkey") % 3 == 0, bare).when(F.col("l_orderkey") % 3 == 1, wrapped).otherwise(prefixed)
    out = nfe.items(nfe.read(o.select(F.col("l_orderkey").alias("arquivo"), xml.alias("xml"))))
    return out.select("chave_acesso", "numero", F.col("data_emissao").cast("string").alias("data_emissao"), F.col("ordem").cast("long").alias("ordem"), "descricao", "cfop", *V.number("valor", digits=2), "origem", *V.number("aliquota"))
