"""The catalogue's views over the test tables: a ledger from order lines, a rate table, two books.  Only the joins that a
query asks for are made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def ledger(spark: SparkSession, d: str, orders: bool = True, part: bool = False, customer: bool = False) -> DataFrame:
    """Lines as movements: status from orders, bloco and ncm from part, parceiro_id and ambito from customer."""
    flag = F.col("l_returnflag")
    out = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("nota_id"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("produto_id"), F.col("l_shipdate").cast("date").alias("data_mov"),
        F.when(flag == "N", "S").otherwise("E").alias("tipo"), F.when(flag == "R", "DEVOLUCAO").when(flag == "A", "IMPORTACAO").otherwise("VENDA").alias("natureza"),
        F.col("l_quantity").cast("decimal(15,3)").alias("quantidade"), F.col("l_extendedprice").cast("decimal(15,2)").alias("valor"),
    )
    if orders or customer:
        status = F.when(F.col("o_orderstatus") == "P", "cancelada").otherwise("lancada")
        o = table(spark, d, "orders").select(F.col("o_orderkey").alias("nota_id"), status.alias("status"), F.col("o_custkey").alias("parceiro_id"))
        if customer:
            c = table(spark, d, "customer").select(F.col("c_custkey").alias("parceiro_id"), F.when(F.col("c_nationkey") == 0, "interna").otherwise("interestadual").alias("ambito"))
            o = o.join(c, "parceiro_id")
        out = out.join(o if customer else o.drop("parceiro_id"), "nota_id")
    if part:
        block = F.when(F.col("p_size") % 4 != 0, (F.col("p_size") % 4).cast("string"))
        p = table(spark, d, "part").select(F.col("p_partkey").alias("produto_id"), block.alias("bloco"), F.col("p_type").alias("ncm"))
        out = out.join(p, "produto_id")
    return out


RATES = "('1', date'1995-01-01', date'1997-12-31', 0.12D, 0.114D), ('1', date'1998-01-01', NULL, 0.12D, 0.108D), ('2', date'1995-01-01', NULL, 0.04D, 0.03D), ('3', date'1996-01-01', NULL, 0.12D, 0.099D)"


def rates(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {RATES} AS t(bloco, vigencia_inicio, vigencia_fim, aliquota, aliq_presumido)")


def book(spark: SparkSession, d: str, which: str) -> DataFrame:
    """Book a: every line; book b: some lines missing, some codes and values changed."""
    from pyspark.sql import Window as W

    order = W.partitionBy("numero").orderBy("l_partkey", "l_shipdate", "l_linenumber")  # numero: what follows needs no other shuffle
    cfop = F.concat(F.when(F.col("l_returnflag") == "N", "5").otherwise("1"), F.when(F.col("l_linestatus") == "F", "101").otherwise("102"))
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("numero"), cfop.alias("cfop"), F.round(F.col("l_extendedprice").cast("decimal(15,2)") * 100).cast("long").alias("cents"), "l_partkey", "l_shipdate", "l_linenumber",
    )
    rows = rows.withColumn("seq", F.row_number().over(order))
    if which == "b":
        rows = rows.filter((F.col("l_partkey") + F.col("l_linenumber")) % 17 != 0)
        rows = rows.withColumn("cfop", F.when(F.col("numero") % 23 == 0, F.concat(F.substring("cfop", 1, 1), F.lit("949"))).otherwise(F.col("cfop")))
        rows = rows.withColumn("cents", F.when(F.col("numero") % 29 == 0, F.col("cents") + 100).otherwise(F.col("cents")))
    return rows.select("numero", "seq", "cfop", "cents")


# The same views for the oracle.

LEDGER_SQL = """
ledger AS (
  SELECT l_orderkey AS nota_id, l_linenumber AS line_no, l_partkey AS produto_id, CAST(l_shipdate AS DATE) AS data_mov,
    CASE l_returnflag WHEN 'N' THEN 'S' ELSE 'E' END AS tipo,
    CASE l_returnflag WHEN 'R' THEN 'DEVOLUCAO' WHEN 'A' THEN 'IMPORTACAO' ELSE 'VENDA' END AS natureza,
    CAST(l_quantity AS DECIMAL(15,3)) AS quantidade, CAST(l_extendedprice AS DECIMAL(15,2)) AS valor,
    CASE o_orderstatus WHEN 'P' THEN 'cancelada' ELSE 'lancada' END AS status, o_custkey AS parceiro_id,
    CASE p_size % 4 WHEN 0 THEN NULL ELSE CAST(p_size % 4 AS VARCHAR) END AS bloco, p_type AS ncm,
    CASE c_nationkey WHEN 0 THEN 'interna' ELSE 'interestadual' END AS ambito
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN customer ON c_custkey = o_custkey),
mov AS (SELECT * FROM ledger WHERE status <> 'cancelada' AND data_mov IS NOT NULL)"""

RATES_SQL = """
rates AS (SELECT * FROM (VALUES ('1', DATE '1995-01-01', DATE '1997-12-31', 0.12::DOUBLE, 0.114::DOUBLE), ('1', DATE '1998-01-01', NULL, 0.12, 0.108),
  ('2', DATE '1995-01-01', NULL, 0.04, 0.03), ('3', DATE '1996-01-01', NULL, 0.12, 0.099)) t(bloco, vigencia_inicio, vigencia_fim, aliquota, aliq_presumido))"""

BOOKS_SQL = """
book_a AS (
  SELECT l_orderkey AS numero, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_shipdate, l_linenumber) AS seq,
    CASE l_returnflag WHEN 'N' THEN '5' ELSE '1' END || CASE l_linestatus WHEN 'F' THEN '101' ELSE '102' END AS cfop,
    CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * 100 AS BIGINT) AS cents, l_partkey + l_linenumber AS k
  FROM lineitem),
book_b AS (
  SELECT numero, seq, CASE WHEN numero % 23 = 0 THEN substr(cfop, 1, 1) || '949' ELSE cfop END AS cfop,
    CASE WHEN numero % 29 = 0 THEN cents + 100 ELSE cents END AS cents FROM book_a WHERE k % 17 <> 0)"""


def _same_rounding(sql: str) -> str:
    """round(x, n) as floor(x * 10^n + 0.5000001) / 10^n, which both engines compute alike: their own functions take
    halves, which quotients of cents often are, to different sides."""
    while (at := sql.find("round(")) >= 0:
        depth, comma, end = 1, 0, at + 6
        while depth:
            c = sql[end]
            depth += (c == "(") - (c == ")")
            comma = end if c == "," and depth == 1 else comma
            end += 1
        n = f"1e{int(sql[comma + 1 : end - 1])}"
        sql = f"{sql[:at]}(floor(({sql[at + 6 : comma]}) * {n} + 0.5000001) / {n}){sql[end:]}"
    return sql


class Catalogue:
    """Queries and their oracles, by name."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, sql: str | None = None):
        def put(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = _same_rounding(sql)
            return f

        return put


def rounded(c, digits: int = 4):
    return (F.floor(c.cast("double") * 10.0**digits + 0.5000001) / 10.0**digits).cast("double")


def number(*cols: str, digits: int = 4) -> list:
    """Columns as doubles, rounded."""
    return [rounded(F.col(c), digits).alias(c) for c in cols]
