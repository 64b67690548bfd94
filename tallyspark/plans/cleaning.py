"""Catalogue: sanitation rules and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import sanitize
from ..refdata import NAME_STOP_WORDS
from . import views as V

Q = V.Catalogue()

RAW = """raw AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN CAST(CAST(l_shipdate AS DATE) - DATE '1899-12-30' AS VARCHAR) WHEN 2 THEN strftime(l_shipdate, '%d/%m/%Y') WHEN 3 THEN 'x' || strftime(l_shipdate, '%Y') ELSE strftime(l_shipdate, '%Y-%m-%d') END AS data,
  CASE l_orderkey % 9 WHEN 0 THEN NULL WHEN 3 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS d, CASE WHEN l_linenumber = 7 THEN 0 WHEN l_linenumber = 6 THEN NULL ELSE l_quantity END AS peso, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_extendedprice END AS valor, l_returnflag FROM lineitem)"""


def raw(spark, d):
    k, s = F.col("l_orderkey"), F.col("l_shipdate")
    data = (
        F.when(k % 9 == 0, F.lit(None)).when(k % 9 == 1, F.datediff(s.cast("date"), F.lit("1899-12-30").cast("date")).cast("string")).when(k % 9 == 2, F.date_format(s, "dd/MM/yyyy"))
        .when(k % 9 == 3, F.concat(F.lit("x"), F.date_format(s, "yyyy"))).otherwise(F.date_format(s, "yyyy-MM-dd"))
    )
    peso = F.when(F.col("l_linenumber") == 7, 0.0).when(F.col("l_linenumber") != 6, F.col("l_quantity"))
    valor = F.when(F.col("l_partkey") % 50 != 0, F.col("l_extendedprice"))
    return V.table(spark, d, "lineitem").select(k, "l_linenumber", "l_partkey", data.alias("data"), peso.alias("peso"), valor.alias("valor"), "l_returnflag")


@Q.add(f"""WITH {RAW} SELECT l_orderkey, l_linenumber, l_partkey, unnest(list_filter([CASE WHEN d IS NULL THEN 'data ausente' END, CASE WHEN d IS NOT NULL AND l_orderkey % 9 <> 1 THEN 'data como texto' END, CASE WHEN d > DATE '2001-01-01' THEN 'data futura' END,
  CASE WHEN d < DATE '1995-06-01' THEN 'data anterior ao inicio' END, CASE WHEN coalesce(peso, 0) = 0 THEN 'peso zero ou ausente' END, CASE WHEN coalesce(valor, 0) = 0 THEN 'valor zero ou ausente' END], lambda x: x IS NOT NULL)) AS regra FROM raw""")
def anomaly_rules(spark, d):
    rows = raw(spark, d).withColumn("dia", X.date_of(F.col("data")))
    return sanitize.anomalies(rows, sanitize.movement_rules("2001-01-01", "1995-06-01", "dia"), ["l_orderkey", "l_linenumber", "l_partkey"])


@Q.add("""WITH x AS (SELECT l_partkey, l_suppkey, count(*) AS linhas, count(DISTINCT (l_orderkey, l_shipdate)) AS distintas, count(DISTINCT (l_returnflag, l_quantity)) AS iguais FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, l_suppkey, linhas, distintas, CASE WHEN distintas > 1 THEN 'reutilizado' ELSE 'identico' END AS tipo FROM x WHERE distintas > 1 OR (linhas > 1 AND iguais = 1)""")
def dup_numbers(spark, d):
    return sanitize.reused_numbers(V.table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], ["l_orderkey", "l_shipdate"], ["l_returnflag", "l_quantity"])


@Q.add(f"WITH {RAW} SELECT l_returnflag, count(*) AS linhas, count(*) FILTER (data IS NULL) AS sem_data, count(*) FILTER (peso IS NULL) AS sem_peso, count(*) FILTER (valor IS NULL) AS sem_valor FROM raw GROUP BY 1")
def missing_counts(spark, d):
    return sanitize.missing(raw(spark, d), ["data", "peso", "valor"], ["l_returnflag"])


@Q.add("SELECT l_returnflag AS tipo, l_orderkey AS numero, l_suppkey % 3 AS parceiro, round(sum(CAST(l_extendedprice AS DECIMAL(15,2)))::DOUBLE, 2) AS valor, count(*) AS itens, bool_or(l_linestatus = 'F') AS devolucao, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS linhas FROM lineitem GROUP BY 1, 2, 3")
def rows_to_notes(spark, d):
    rows = V.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("tipo"), F.col("l_orderkey").alias("numero"), (F.col("l_suppkey") % 3).alias("parceiro"), F.col("l_extendedprice").cast("decimal(15,2)").alias("valor"), F.col("l_linenumber").alias("linha"), (F.col("l_linestatus") == "F").alias("devolucao"))
    return sanitize.notes_of(rows, ["tipo", "numero", "parceiro"]).select("tipo", "numero", "parceiro", *V.number("valor", digits=2), "itens", "devolucao", "linhas")


@Q.add("SELECT l_orderkey, l_suppkey % 10 AS produto, count(*) AS vezes, count(DISTINCT (l_returnflag, l_linestatus)) AS variantes, CASE WHEN count(DISTINCT (l_returnflag, l_linestatus)) > 1 THEN 'difere' ELSE 'identico' END AS tipo FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_items(spark, d):
    rows = V.table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 10).alias("produto"), "l_returnflag", "l_linestatus")
    return sanitize.repeated_items(rows, ["l_orderkey", "produto"], ["l_returnflag", "l_linestatus"])


NAMES = "names AS (SELECT 'Indústria ' || p_name || CASE p_partkey % 3 WHEN 0 THEN ' LTDA.' WHEN 1 THEN ' ltda' ELSE '  LTDA -' END AS n FROM part)"
FOLD = "upper(strip_accents(replace({}, 'ß', 'SS')))"
CLEAN = "upper(trim(regexp_replace(replace({}, 'ß', 'SS'), '\\s+', ' ', 'g'), ' .,;-'))"


@Q.add(f"""WITH {NAMES}, k AS (SELECT n, {CLEAN.format('n')} AS c, trim(regexp_replace({FOLD.format(CLEAN.format('n'))}, '[^A-Z0-9]+', ' ', 'g')) AS chave FROM names)
SELECT chave, max(c) AS nome, string_agg(DISTINCT n, ' | ' ORDER BY n) AS variantes, count(*) AS qtd FROM k GROUP BY chave""")
def canonical_name(spark, d):
    k = F.col("p_partkey") % 3
    n = F.concat(F.lit("Indústria "), F.col("p_name"), F.when(k == 0, " LTDA.").when(k == 1, " ltda").otherwise("  LTDA -"))
    return sanitize.longest_name(V.table(spark, d, "part").select(n.alias("n")), "n")


@Q.add(f"SELECT doc_id, md5({FOLD.format('text')}) AS dobrado, md5(lower(strip_accents(trim(text)))) AS cabeca FROM documents")
def fold_text(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.md5(X.fold(F.col("text"))).alias("dobrado"), F.md5(X.header(F.col("text"))).alias("cabeca"))


@Q.add(f"SELECT doc_id, md5({CLEAN.format('text')}) AS limpo FROM documents")
def clean_text(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.md5(X.clean(F.col("text"))).alias("limpo"))


KEY = f"trim(regexp_replace({FOLD.format(CLEAN.format('text'))}, '[^A-Z0-9]+', ' ', 'g'))"


@Q.add(f"SELECT doc_id, md5({KEY}) AS chave, length({KEY}) AS n FROM documents")
def party_key(spark, d):
    return V.table(spark, d, "documents").select("doc_id", X.party_key(F.col("text")).alias("k")).select("doc_id", F.md5("k").alias("chave"), F.char_length("k").cast("long").alias("n"))


STOP = ", ".join(f"'{w}'" for w in NAME_STOP_WORDS)


@Q.add(f"""WITH w AS (SELECT doc_id, list_filter(string_split({KEY}, ' '), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, w, list_filter(w, lambda x: x NOT IN ({STOP})) AS core FROM w)
SELECT doc_id, md5(array_to_string(CASE WHEN len(core) > 0 THEN core ELSE w END, ' ')) AS nucleo, len(CASE WHEN len(core) > 0 THEN core ELSE w END)::BIGINT AS n FROM c""")
def name_core(spark, d):
    rows = V.table(spark, d, "documents").select("doc_id", X.name_core(F.col("text")).alias("w"))
    return rows.select("doc_id", F.md5(F.array_join("w", " ")).alias("nucleo"), F.size("w").cast("long").alias("n"))


@Q.add(f"WITH {RAW} SELECT l_orderkey, l_linenumber, l_partkey, CAST(d AS VARCHAR) AS data, CASE WHEN data IS NULL THEN 'data ausente' WHEN d IS NULL THEN 'data invalida' WHEN l_orderkey % 9 = 1 THEN 'data gravada como numero de serie' ELSE 'data gravada como texto' END AS nota FROM raw")
def parse_date_multi(spark, d):
    return raw(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", X.date_of(F.col("data")).cast("string").alias("data"), X.date_note(F.col("data")).alias("nota"))


BR = "translate(format('{:,.2f}', abs(c_acctbal)), ',.', '.,')"


@Q.add("SELECT c_custkey, round(c_acctbal, 4) AS conta, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE round(c_acctbal, 4) END AS numero FROM customer")
def parse_br_number(spark, d):
    a = F.col("c_acctbal")
    br = X.brazilian(F.abs(a))
    shown = F.when(a < 0, F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("("), br, F.lit(")"))).otherwise(F.concat(F.lit("-"), br))).otherwise(br)
    plain = F.when(F.col("c_custkey") % 5 == 0, "n/d").when(a < 0, F.concat(F.lit("-"), br)).otherwise(br)
    return V.table(spark, d, "customer").select("c_custkey", V.rounded(X.amount(shown)).alias("conta"), V.rounded(X.number(plain)).alias("numero"))


@Q.add("SELECT o_orderkey, translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS valor FROM orders")
def format_br(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", X.brazilian(F.col("o_totalprice")).alias("valor"))


@Q.add("SELECT c_custkey, regexp_replace(c_name || '-' || CAST(c_acctbal AS VARCHAR), '[^0-9]', '', 'g') AS digitos FROM customer")
def digits_only(spark, d):
    return V.table(spark, d, "customer").select("c_custkey", X.digits(F.concat_ws("-", "c_name", F.col("c_acctbal").cast("string"))).alias("digitos"))


@Q.add("SELECT c_custkey, coalesce(nullif(ltrim(lpad(CAST(c_custkey AS VARCHAR), 9, '0'), '0'), ''), '0') AS numero FROM customer")
def strip_zeros(spark, d):
    return V.table(spark, d, "customer").select("c_custkey", X.bare_number(F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("numero"))


TAGGED = "CASE p_partkey % 4 WHEN 0 THEN 'SUCATA DE ' WHEN 1 THEN 'LINGOTE DE ' ELSE '' END || CASE p_size % 6 WHEN 0 THEN 'ALUMINIO' WHEN 1 THEN 'MAGNESIO' WHEN 2 THEN 'COBRE' WHEN 3 THEN 'SILICIO METALICO' ELSE p_type END"


@Q.add(f"WITH x AS (SELECT p_partkey, {TAGGED} AS s FROM part) SELECT p_partkey, CASE WHEN s LIKE 'SUCATA%' THEN 'SUCATA' WHEN s LIKE 'LINGOTE%' THEN 'LINGOTE' ELSE 'OUTRO' END AS categoria, CASE WHEN s LIKE '%ALUMINIO%' THEN 'ALUMINIO' WHEN s LIKE '%MAGNESIO%' THEN 'MAGNESIO' WHEN s LIKE '%COBRE%' THEN 'COBRE' WHEN s LIKE '%SILICIO%' THEN 'SILICIO' END AS metal FROM x")
def tag_category(spark, d):
    s = F.expr(TAGGED)
    return V.table(spark, d, "part").select("p_partkey", s.alias("s")).select("p_partkey", X.category(F.col("s")).alias("categoria"), X.metal(F.col("s")).alias("metal"))


@Q.add(r"WITH x AS (SELECT c_custkey, upper(c_name || CASE c_custkey % 5 WHEN 0 THEN ' GmbH' WHEN 1 THEN ' Trading Limited' WHEN 2 THEN ' Ltda' WHEN 3 THEN ' S.A.' ELSE ' BV Ltda' END) AS n FROM customer) SELECT c_custkey, regexp_matches(n, '\b(GMBH|BV|LIMITED|LTD|S\.?A\.?$|CORPORATION|CO\.LIMITED|INWASTE)\b') AND NOT regexp_matches(n, 'LTDA|EIRELI|S/A') AS exterior FROM x")
def tag_foreign(spark, d):
    k = F.col("c_custkey") % 5
    n = F.concat(F.col("c_name"), F.when(k == 0, " GmbH").when(k == 1, " Trading Limited").when(k == 2, " Ltda").when(k == 3, " S.A.").otherwise(" BV Ltda"))
    return V.table(spark, d, "customer").select("c_custkey", X.foreign(n).alias("exterior"))


@Q.add("""SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"tipo":"' || event_type || '","usuario":' || CAST(user_id AS VARCHAR) || '}' AS depois FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC""")
def audit_json(spark, d):
    """Events of one kind with a field of their JSON and a JSON payload, latest first."""
    rows = V.table(spark, d, "events").filter("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id"))
    return rows.select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.to_json(F.struct(F.col("event_type").alias("tipo"), F.col("user_id").alias("usuario"))).alias("depois"))


MARKED = ("Dvořák", "Škoda", "Čapek & Ňuñez", "Őrség", "Żółć")


@Q.add(f"""SELECT c_custkey, trim(regexp_replace(upper(strip_accents([{", ".join(f"'{x}'" for x in MARKED)}][1 + c_custkey % 5] || ' ' || c_name)), '[^A-Z0-9]+', ' ', 'g')) AS chave FROM customer""")
def party_key_marks(spark, d):
    """Names with letters beyond Latin-1; one that no decomposition reaches (ł) is no letter of a key."""
    name = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, MARKED)), (F.col("c_custkey") % 5 + 1).cast("int")), "c_name")
    return V.table(spark, d, "customer").select("c_custkey", X.party_key(name).alias("chave"))
