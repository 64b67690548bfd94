"""Catalogue: classification, duplicates and matching."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.joins import shuffled
from ..operators import ingest
from . import views as V

Q = V.Catalogue()

NOTES_SQL = """
lines AS (SELECT l_orderkey, list(DISTINCT CASE WHEN l_linenumber > 2 THEN '0' ELSE '1' END) AS origins, list(DISTINCT CAST(l_suppkey % 7 AS VARCHAR)) AS codes FROM lineitem GROUP BY 1),
notes AS (
  SELECT o.*, CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE 'A' END AS company, CASE o_custkey % 3 WHEN 0 THEN 'A' ELSE 'B' END AS emitter, CASE o_custkey % 3 WHEN 1 THEN 'A' ELSE 'C' END AS recipient,
    o_orderkey % 41 = 0 AS seen, CASE WHEN o_orderkey % 37 = 0 THEN '110' WHEN o_orderkey % 3 = 0 THEN NULL ELSE '100' END AS cstat, CASE WHEN o_orderkey % 31 = 0 THEN '3949' ELSE '3102' END AS first_cfop,
    coalesce(origins, []) AS origins, coalesce(codes, []) AS codes, o_orderdate < '1995-06-01' AS closed, o_orderdate > '2001-06-01' AS future,
    CASE o_orderkey % 11 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS candidates, o_orderkey % 5 = 0 AS warned
  FROM orders o LEFT JOIN lines ON l_orderkey = o_orderkey),
outcomes AS (
  SELECT *, CASE WHEN company IS NULL THEN 'erro' WHEN seen THEN 'duplicada' WHEN cstat NOT IN ('100', '150') THEN 'ignorada' WHEN first_cfop = '3949' THEN 'ignorada'
    WHEN NOT list_has_any(origins, ['1', '6']) THEN 'ignorada' WHEN NOT list_has_any(codes, ['1', '2']) THEN 'ignorada' WHEN company <> emitter AND company <> recipient THEN 'ignorada'
    WHEN closed OR future THEN 'pendente' WHEN candidates > 1 THEN 'pendente' WHEN candidates = 1 THEN CASE WHEN warned THEN 'pendente' ELSE 'complementada' END
    WHEN warned THEN 'pendente' ELSE 'importada' END AS resultado FROM notes)"""


def outcomes(spark, d):
    lines = V.table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set(F.when(F.col("l_linenumber") > 2, "0").otherwise("1")).alias("origins"), F.collect_set((F.col("l_suppkey") % 7).cast("string")).alias("codes"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    none = F.array().cast("array<string>")
    notes = V.table(spark, d, "orders").join(lines, k == F.col("l_orderkey"), "left").select(
        k, c, "o_orderdate", "o_orderstatus", F.when(c % 50 != 0, "A").alias("company"), F.when(c % 3 == 0, "A").otherwise("B").alias("emitter"), F.when(c % 3 == 1, "A").otherwise("C").alias("recipient"),
        (k % 41 == 0).alias("seen"), F.when(k % 37 == 0, "110").when(k % 3 != 0, "100").alias("cstat"), F.when(k % 31 == 0, "3949").otherwise("3102").alias("first_cfop"),
        F.coalesce("origins", none).alias("origins"), F.coalesce("codes", none).alias("codes"), (F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp_ntz")).alias("closed"), (F.col("o_orderdate") > F.lit("2001-06-01").cast("timestamp_ntz")).alias("future"),
        F.when(k % 11 == 0, 1).when(k % 11 == 1, 2).otherwise(0).alias("candidates"), (k % 5 == 0).alias("warned"),
    )
    return notes.withColumn("resultado", ingest.outcome(("1", "2")))


@Q.add(f"WITH {NOTES_SQL} SELECT o_orderkey, resultado FROM outcomes")
def classify_cascade(spark, d):
    return outcomes(spark, d).select("o_orderkey", "resultado")


@Q.add(f"WITH {NOTES_SQL} SELECT strftime(o_orderdate, '%Y-%m') AS lote, count(*) AS total, count(*) FILTER (resultado = 'importada') AS importadas, count(*) FILTER (resultado = 'complementada') AS complementadas, count(*) FILTER (resultado = 'duplicada') AS duplicadas, count(*) FILTER (resultado = 'pendente') AS pendentes, count(*) FILTER (resultado IN ('erro', 'ignorada')) AS erros FROM outcomes GROUP BY 1")
def batch_counters(spark, d):
    return ingest.counters(outcomes(spark, d).withColumn("lote", F.date_format("o_orderdate", "yyyy-MM")), ["lote"])


KINDS = "CASE l_linenumber % 3 WHEN 0 THEN '1202' WHEN 1 THEN '3102' ELSE '1101' END"


@Q.add(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, CASE WHEN l_suppkey % 2 = 0 THEN CASE WHEN l_returnflag = 'N' THEN 'S' ELSE 'E' END WHEN l_suppkey % 3 = 0 THEN 'E' END AS tipo, {KINDS} AS cfop, CAST(1 + l_partkey % 4 AS VARCHAR) AS fin, l_linestatus = 'O' AS refs FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, tipo, CASE WHEN tipo = 'S' THEN CASE WHEN fin = '4' THEN 'DEVOLUCAO' ELSE 'VENDA' END WHEN cfop = '1202' OR fin = '4' OR (fin = '3' AND refs) THEN 'DEVOLUCAO' WHEN cfop LIKE '3%' THEN 'IMPORTACAO' ELSE 'COMPRA' END AS natureza FROM x WHERE tipo IS NOT NULL""")
def derive_nature(spark, d):
    s, n = F.col("l_suppkey"), F.col("l_linenumber")
    tipo = ingest.direction(F.lit("A"), F.when(s % 2 == 0, "A").otherwise("B"), F.when(s % 3 == 0, "A").otherwise("C"), F.when(F.col("l_returnflag") == "N", "1").otherwise("0"))
    cfop = F.when(n % 3 == 0, "1202").when(n % 3 == 1, "3102").otherwise("1101")
    rows = V.table(spark, d, "lineitem").withColumn("tipo", tipo).filter("tipo is not null")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "tipo", ingest.nature(F.col("tipo"), cfop, (1 + F.col("l_partkey") % 4).cast("string"), F.col("l_linestatus") == "O").alias("natureza"))


@Q.add("""SELECT o_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey IS NULL THEN 'erro' WHEN o_orderstatus = 'P' THEN 'aviso' ELSE 'ok' END AS classe FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber <= 2""")
def import_audit(spark, d):
    """One row per item of each file, or one per file without any."""
    lines = V.table(spark, d, "lineitem").filter("l_linenumber <= 2").select("l_orderkey", "l_linenumber", "l_partkey")
    out = V.table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    colour = F.when(F.col("l_orderkey").isNull(), "erro").when(F.col("o_orderstatus") == "P", "aviso").otherwise("ok")
    return out.select("o_orderkey", "l_linenumber", "l_partkey", colour.alias("classe"))


@Q.add("""SELECT CASE event_type WHEN 'error' THEN 'Importação' WHEN 'purchase' THEN 'Estoque' WHEN 'login' THEN 'Lançamento manual' ELSE 'Outros' END AS area, count(*) AS n, count(c_custkey) AS com_parceiro
FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY 1""")
def issues_by_area(spark, d):
    area = F.when(F.col("event_type") == "error", "Importação").when(F.col("event_type") == "purchase", "Estoque").when(F.col("event_type") == "login", "Lançamento manual").otherwise("Outros")
    party = V.table(spark, d, "customer").select("c_custkey")
    return V.table(spark, d, "events").join(party, F.col("user_id") == F.col("c_custkey"), "left").groupBy(area.alias("area")).agg(F.count("*").alias("n"), F.count("c_custkey").alias("com_parceiro"))


@Q.add("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS rn FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size = 1)) WHERE rn = 1""")
def dedupe_key(spark, d):
    base = V.table(spark, d, "part").filter("p_size = 1").select(F.col("p_partkey").alias("l_partkey"))
    rows = V.table(spark, d, "lineitem").join(base, "l_partkey", "left_anti")
    return ingest.first_by(rows, ["l_partkey", "l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@Q.add("""WITH n AS (SELECT o_orderkey, o_custkey, o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y') END AS serie FROM orders WHERE o_orderstatus <> 'P')
SELECT a.o_orderkey, min(b.o_orderkey) AS anterior FROM n a JOIN n b ON b.o_orderkey < a.o_orderkey AND a.o_custkey IS NOT DISTINCT FROM b.o_custkey AND a.o_orderpriority IS NOT DISTINCT FROM b.o_orderpriority AND a.serie IS NOT DISTINCT FROM b.serie GROUP BY 1""")
def possible_dup(spark, d):
    serie = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy")).alias("serie")
    notes = V.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", serie, F.when(F.col("o_orderstatus") == "P", "cancelada").otherwise("lancada").alias("status"))
    return ingest.possible_duplicates(notes, ["o_custkey", "o_orderpriority", "serie"], "o_orderkey")


@Q.add("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def anti_new(spark, d):
    busy = V.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return V.table(spark, d, "customer").join(busy, "c_custkey", "left_anti").select("c_custkey", "c_name")


@Q.add("""WITH files AS (SELECT o_orderkey, o_custkey AS parceiro, strftime(o_orderdate, '%Y') AS ano FROM orders WHERE o_orderkey % 2 = 0),
legacy AS (SELECT o_custkey AS parceiro, strftime(o_orderdate, '%Y') AS ano, count(*) AS k, min(o_orderkey) AS one FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2)
SELECT o_orderkey, coalesce(k, 0) AS candidatos, CASE WHEN k = 1 AND row_number() OVER (PARTITION BY f.parceiro, f.ano ORDER BY o_orderkey) = 1 THEN one END AS legado FROM files f LEFT JOIN legacy USING (parceiro, ano)""")
def match_legacy(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("parceiro"), F.date_format("o_orderdate", "yyyy").alias("ano"))
    out = ingest.legacy_candidates(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), ["parceiro", "ano"], "o_orderkey", "o_orderkey")
    return out.select("o_orderkey", "candidatos", "legado")


@Q.add("""WITH g AS (SELECT l_orderkey AS nota_id, l_linenumber AS grupo, l_quantity AS q, l_partkey, l_shipdate FROM lineitem), n AS (SELECT nota_id FROM g GROUP BY 1 HAVING count(*) = count(DISTINCT q) AND count(*) = count(DISTINCT grupo)),
i AS (SELECT nota_id, grupo AS item, CASE WHEN grupo % 3 = 0 THEN q + 0.0005 WHEN grupo % 3 = 1 THEN q ELSE q + 0.4 END AS q FROM g)
SELECT g.nota_id, CAST(g.grupo AS BIGINT) AS grupo, CAST(i.item AS BIGINT) AS item FROM g JOIN n USING (nota_id) JOIN i ON i.nota_id = g.nota_id AND abs(i.q - g.q) <= 0.001 + 1e-9""")
def match_by_qty(spark, d):
    g = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("nota_id"), F.col("l_linenumber").alias("grupo"), F.col("l_quantity").alias("quantidade"))
    # A note has few lines, so what differs in it is told by a window over them: one shuffle by note serves all.
    note = W.partitionBy("nota_id")
    own = lambda c: F.size(F.collect_set(c).over(note)) == F.count("*").over(note)
    g = g.withColumn("_ok_", own("quantidade") & own("grupo")).filter("_ok_").drop("_ok_")
    q = F.col("quantidade")
    items = g.select("nota_id", F.col("grupo").alias("item"), F.when(F.col("grupo") % 3 == 0, q + 0.0005).when(F.col("grupo") % 3 == 1, q).otherwise(q + 0.4).alias("quantidade"))
    return ingest.match_by_quantity(g.withColumn("grupo", F.col("grupo").cast("long")), items.withColumn("item", F.col("item").cast("long")))


@Q.add("""WITH ids AS (SELECT o_orderkey, unnest(list_distinct([lpad(CAST(CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS VARCHAR), 14, '0'), lpad(CAST(o_custkey % 10 AS VARCHAR), 14, '0')])) AS cnpj FROM orders), n AS (SELECT cnpj, count(*) AS n FROM ids GROUP BY 1)
SELECT cnpj, n FROM n WHERE n = (SELECT max(n) FROM n) AND (SELECT count(*) FROM n WHERE n = (SELECT max(n) FROM n)) = 1""")
def detect_owner(spark, d):
    a = F.lpad(F.when(F.col("o_orderkey") % 3 == 0, 7).otherwise(F.col("o_custkey")).cast("string"), 14, "0")
    return ingest.owner(V.table(spark, d, "orders").select(a.alias("emitter"), F.lpad((F.col("o_custkey") % 10).cast("string"), 14, "0").alias("recipient")))


@Q.add("""SELECT l_orderkey AS nota_id, l_suppkey % 5 AS produto_id, round(sum(CAST(l_quantity AS DECIMAL(15,3)))::DOUBLE, 4) AS quantidade, count(DISTINCT (l_returnflag, l_linestatus)) = 1 AS consistente, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS itens FROM lineitem GROUP BY 1, 2""")
def merge_lots(spark, d):
    rows = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("nota_id"), (F.col("l_suppkey") % 5).alias("produto_id"), F.col("l_quantity").cast("decimal(15,3)").alias("quantidade"), "l_returnflag", "l_linestatus", "l_linenumber")
    out = ingest.merged_lots(rows, ["nota_id", "produto_id"], ["l_returnflag", "l_linestatus"], "l_linenumber")
    return out.select("nota_id", "produto_id", *V.number("quantidade"), "consistente", "itens")


PARTY = "p AS (SELECT c_custkey AS parceiro_id, CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS cnpj, upper(c_name) AS nome, c_name || ' SA | Casa ' || c_name || ' Filial' AS variantes FROM customer)"


@Q.add(f"""WITH {PARTY}, r AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS cnpj, CASE o_orderkey % 5 WHEN 0 THEN c_name WHEN 1 THEN c_name || '  SA' WHEN 2 THEN 'casa ' || c_name WHEN 3 THEN '' ELSE c_name || ' X' END AS nome FROM orders JOIN customer ON c_custkey = o_custkey),
n AS (SELECT *, upper(trim(regexp_replace(nome, '\\s+', ' ', 'g'))) AS k FROM r), a AS (SELECT k, min(parceiro_id) AS p FROM (SELECT DISTINCT k FROM n WHERE k <> '') JOIN p ON contains(upper(variantes), k) GROUP BY 1)
SELECT o_orderkey, coalesce(p1.parceiro_id, p2.parceiro_id, a.p) AS parceiro_id, CASE WHEN p1.parceiro_id IS NOT NULL THEN 'cnpj' WHEN p2.parceiro_id IS NOT NULL THEN 'nome' WHEN a.p IS NOT NULL THEN 'variante' ELSE 'novo' END AS como
FROM n LEFT JOIN p p1 ON p1.cnpj = n.cnpj AND p1.cnpj <> '' LEFT JOIN p p2 ON p2.nome = n.k LEFT JOIN a ON a.k = n.k""")
def party_match(spark, d):
    c = V.table(spark, d, "customer")
    parties = c.select(F.col("c_custkey").alias("parceiro_id"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey").cast("string")).otherwise("").alias("cnpj"), F.upper("c_name").alias("nome"), F.concat("c_name", F.lit(" SA | Casa "), "c_name", F.lit(" Filial")).alias("variantes"))
    k, n = F.col("o_orderkey") % 5, F.col("c_name")
    name = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit("  SA"))).when(k == 2, F.concat(F.lit("casa "), n)).when(k == 3, "").otherwise(F.concat(n, F.lit(" X")))
    rows = V.table(spark, d, "orders").join(shuffled(c), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("o_custkey").cast("string").alias("cnpj"), name.alias("nome"))
    return ingest.match_party(rows, parties).select("o_orderkey", "parceiro_id", "como")


@Q.add("""WITH p AS (SELECT p_partkey AS produto_id, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS descricao, CASE WHEN p_partkey % 3 = 0 THEN p_brand || CAST(p_partkey % 400 AS VARCHAR) END AS ncm FROM part),
c AS (SELECT ncm, min(produto_id) AS id FROM p WHERE ncm IS NOT NULL GROUP BY 1 HAVING count(*) = 1),
r AS (SELECT p_partkey AS k, p_name || ' ' || CAST(CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE -1 END AS VARCHAR) AS descricao, p_brand || CAST(p_partkey % 400 AS VARCHAR) AS ncm FROM part)
SELECT k, coalesce(p.produto_id, c.id) AS produto_id, CASE WHEN p.produto_id IS NOT NULL THEN 'descricao' WHEN c.id IS NOT NULL THEN 'ncm' ELSE 'novo' END AS como FROM r LEFT JOIN p ON p.descricao = r.descricao LEFT JOIN c ON c.ncm = r.ncm""")
def product_match(spark, d):
    k = F.col("p_partkey")
    code = F.concat(F.col("p_brand"), (k % 400).cast("string"))
    part = V.table(spark, d, "part")
    products = part.select(k.alias("produto_id"), F.concat_ws(" ", "p_name", k.cast("string")).alias("descricao"), F.when(k % 3 == 0, code).alias("ncm"))
    rows = part.select(k.alias("k"), F.concat_ws(" ", "p_name", F.when(k % 2 == 0, k).otherwise(-1).cast("string")).alias("descricao"), code.alias("ncm"))
    return ingest.match_product(rows, products).select("k", "produto_id", "como")


@Q.add("SELECT l_orderkey, l_linenumber, l_partkey, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN 'X' END, p_type) AS ncm FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def backfill_code(spark, d):
    items = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("produto_id"), F.when(F.col("l_linenumber") % 2 == 0, "X").alias("ncm"))
    products = V.table(spark, d, "part").select(F.col("p_partkey").alias("produto_id"), F.col("p_type").alias("ncm"))
    return ingest.backfill(items, products).select("l_orderkey", "l_linenumber", F.col("produto_id").alias("l_partkey"), "ncm")
