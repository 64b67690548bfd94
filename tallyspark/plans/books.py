"""Catalogue: two-book reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recon
from . import views as V

Q = V.Catalogue()

PAIRS = f"""WITH {V.BOOKS_SQL},
ga AS (SELECT numero, sum(cents) AS s, count(*) AS n FROM book_a GROUP BY 1), gb AS (SELECT numero, sum(cents) AS s, count(*) AS n FROM book_b GROUP BY 1),
g AS (SELECT numero, a.s AS sa, b.s AS sb, a.n AS na, b.n AS nb FROM ga a FULL JOIN gb b USING (numero)),
ra AS (SELECT *, row_number() OVER (PARTITION BY numero ORDER BY cents DESC, seq) AS r, row_number() OVER (PARTITION BY numero ORDER BY seq) - 1 AS i FROM book_a),
rb AS (SELECT *, row_number() OVER (PARTITION BY numero ORDER BY cents DESC, seq) AS r, row_number() OVER (PARTITION BY numero ORDER BY seq) - 1 AS i FROM book_b),
big AS (SELECT numero, 'a' AS lado, sb AS alvo, na AS n FROM g WHERE sa > sb UNION ALL SELECT numero, 'b', sa, nb FROM g WHERE sb > sa),
masks AS (SELECT numero, lado, alvo, n, unnest(generate_series(1, (1 << n) - 1)) AS m FROM big),
items AS (SELECT numero, 'a' AS lado, i, cents FROM ra UNION ALL SELECT numero, 'b', i, cents FROM rb),
sums AS (SELECT k.numero, k.lado, k.n, m, any_value(alvo) AS alvo, sum(cents) AS s FROM masks k JOIN items t ON t.numero = k.numero AND t.lado = k.lado AND (m >> (n - 1 - i)) & 1 = 1 WHERE bit_count(m) <= 6 GROUP BY ALL),
best AS (SELECT numero, lado, n, arg_max(m, -bit_count(m) * 1000000 + m) AS m FROM sums WHERE s = alvo GROUP BY ALL),
inside AS (SELECT t.numero, t.lado, t.i, (m >> (n - 1 - i)) & 1 = 1 AS dentro FROM best JOIN items t USING (numero, lado)),
firsts AS (SELECT numero, lado, min(i) FILTER (dentro) AS i FROM inside GROUP BY ALL),
pairs AS (
  SELECT numero, 'so_a' AS classe, seq AS seq_a, NULL AS seq_b, false AS difere FROM ra JOIN g USING (numero) WHERE sb IS NULL
  UNION ALL SELECT numero, 'so_b', NULL, seq, false FROM rb JOIN g USING (numero) WHERE sa IS NULL
  UNION ALL SELECT ra.numero, 'casada', ra.seq, rb.seq, ra.cfop <> rb.cfop FROM ra JOIN rb ON rb.numero = ra.numero AND rb.r = ra.r JOIN g ON g.numero = ra.numero WHERE sa = sb AND na = nb
  UNION ALL SELECT ra.numero, 'casada', ra.seq, rb.seq, ra.cfop <> rb.cfop FROM ra JOIN rb ON rb.numero = ra.numero AND rb.i = 0 AND ra.i = 0 JOIN g ON g.numero = ra.numero WHERE sa = sb AND na <> nb
  UNION ALL SELECT ra.numero, 'casada', ra.seq, rb.seq, ra.cfop <> rb.cfop FROM firsts f JOIN ra ON ra.numero = f.numero AND ra.i = CASE f.lado WHEN 'a' THEN f.i ELSE 0 END JOIN rb ON rb.numero = f.numero AND rb.i = CASE f.lado WHEN 'b' THEN f.i ELSE 0 END
  UNION ALL SELECT ra.numero, 'so_a', ra.seq, NULL, false FROM inside x JOIN ra ON ra.numero = x.numero AND ra.i = x.i WHERE x.lado = 'a' AND NOT dentro
  UNION ALL SELECT rb.numero, 'so_b', NULL, rb.seq, false FROM inside x JOIN rb ON rb.numero = x.numero AND rb.i = x.i WHERE x.lado = 'b' AND NOT dentro
  UNION ALL SELECT numero, 'revisar', NULL, NULL, false FROM big WHERE numero NOT IN (SELECT numero FROM best))"""


def _pairs(spark, d):
    return recon.pair_notes(V.book(spark, d, "a"), V.book(spark, d, "b"))


@Q.add(f"{PAIRS} SELECT numero, classe, coalesce(seq_a, 0) AS seq_a, coalesce(seq_b, 0) AS seq_b, difere FROM pairs")
def recon_notes(spark, d):
    return _pairs(spark, d).select("numero", "classe", F.coalesce(F.col("seq_a").cast("long"), F.lit(0)).alias("seq_a"), F.coalesce(F.col("seq_b").cast("long"), F.lit(0)).alias("seq_b"), "difere")


@Q.add(f"""WITH {V.BOOKS_SQL}, a AS (SELECT cfop, sum(cents)::BIGINT AS v FROM book_a GROUP BY 1), b AS (SELECT cfop, sum(cents)::BIGINT AS v FROM book_b WHERE cfop <> '1102' GROUP BY 1)
SELECT cfop, coalesce(a.v, 0) AS a_valor, coalesce(b.v, 0) AS b_valor, coalesce(a.v, 0) - coalesce(b.v, 0) AS dif_valor, coalesce(a.v // 10, 0) - coalesce(b.v // 10, 0) AS dif_imposto,
  CASE WHEN b.cfop IS NULL THEN 'ausente em b' WHEN a.cfop IS NULL THEN 'ausente em a' WHEN a.v = b.v THEN 'ok' ELSE 'divergente' END AS situacao FROM a FULL JOIN b USING (cfop) ORDER BY cfop""")
def code_balance(spark, d):
    def side(w):
        rows = V.book(spark, d, w)
        rows = rows.filter("cfop <> '1102'") if w == "b" else rows
        s = rows.groupBy("cfop").agg(F.sum("cents").alias("valor"))
        return s.select("cfop", "valor", F.col("valor").alias("base"), F.expr("valor div 10").alias("imposto"))

    return recon.compare_codes(side("a"), side("b")).select("cfop", "a_valor", "b_valor", "dif_valor", "dif_imposto", "situacao").orderBy("cfop")


@Q.add(f"""WITH {V.BOOKS_SQL} SELECT DISTINCT 'a' AS lado, numero FROM book_a WHERE numero NOT IN (SELECT numero FROM book_b) UNION ALL SELECT DISTINCT 'b', numero FROM book_b WHERE cents > 9000000 AND numero NOT IN (SELECT numero FROM book_a WHERE cents <= 9000000)""")
def only_one_side(spark, d):
    # A whole book's numbers are no table to broadcast, whatever Spark takes their size for: sorted, they can spill.
    a, b = V.book(spark, d, "a"), V.book(spark, d, "b")
    left = a.join(b.select("numero").hint("merge"), "numero", "left_anti").select(F.lit("a").alias("lado"), "numero").distinct()
    right = b.filter("cents > 9000000").join(a.filter("cents <= 9000000").select("numero").hint("merge"), "numero", "left_anti").select(F.lit("b").alias("lado"), "numero").distinct()
    return left.unionByName(right)


@Q.add(f"{PAIRS} SELECT a.cfop, count(*) AS qtd, sum(a.cents)::BIGINT AS cents FROM pairs p JOIN book_a a ON a.numero = p.numero AND a.seq = p.seq_a WHERE classe = 'so_a' GROUP BY 1")
def missing_by_code(spark, d):
    return recon.missing_by_code(_pairs(spark, d), V.book(spark, d, "a"))


@Q.add(f"""WITH {V.LEDGER_SQL}, e AS (SELECT nota_id AS numero, sum(valor) AS v FROM mov WHERE tipo = 'S' AND data_mov BETWEEN DATE '1998-03-01' AND DATE '1998-03-31' GROUP BY 1),
a AS (SELECT nota_id AS numero, sum(valor) + CASE WHEN nota_id % 7 = 0 THEN 1 ELSE 0 END AS v FROM mov WHERE tipo = 'S' AND data_mov BETWEEN DATE '1998-03-05' AND DATE '1998-04-05' AND nota_id % 13 <> 0 GROUP BY 1)
SELECT numero, round(coalesce(e.v, 0)::DOUBLE, 2) AS valor_estoque, round(coalesce(a.v, 0)::DOUBLE, 2) AS valor_apuracao,
  CASE WHEN a.v IS NULL THEN 'ausente da apuracao' WHEN e.v IS NULL THEN 'ausente do estoque' WHEN abs(e.v - a.v) > 0.01 THEN 'valor difere' ELSE 'ok' END AS diagnostico FROM e FULL JOIN a USING (numero)""")
def cross_check(spark, d):
    from ..operators.ledger import valid

    out = valid(V.ledger(spark, d)).filter("tipo = 'S'").withColumnRenamed("nota_id", "numero")
    stock = out.filter("data_mov between date'1998-03-01' and date'1998-03-31'").groupBy("numero").agg(F.sum("valor").alias("valor"))
    assessed = out.filter("data_mov between date'1998-03-05' and date'1998-04-05' and numero % 13 <> 0").groupBy("numero").agg(F.sum("valor").alias("valor"))
    assessed = assessed.withColumn("valor", F.col("valor") + F.when(F.col("numero") % 7 == 0, 1).otherwise(0))
    x = recon.cross_check(stock, assessed)
    return x.select("numero", *(V.rounded(F.coalesce(c, F.lit(0)), 2).alias(c) for c in ("valor_estoque", "valor_apuracao")), "diagnostico")


ENRICHED = f"""WITH {V.BOOKS_SQL}, sheet AS (SELECT numero + CASE WHEN numero % 19 = 0 THEN 10000000 ELSE 0 END AS numero, seq, cents + CASE WHEN numero % 5 = 0 THEN 7 ELSE 0 END AS cents FROM book_a WHERE seq <= 2),
cand AS (SELECT s.numero, s.seq, s.cents, b.cfop, b.cents AS c, b.cents = s.cents AS exato, count(b.cfop) OVER (PARTITION BY s.numero, s.seq) AS n, coalesce(bool_or(b.cents = s.cents) OVER (PARTITION BY s.numero, s.seq), false) AS algum FROM sheet s LEFT JOIN book_b b ON b.numero = s.numero),
enriched AS (SELECT numero, seq, cents, coalesce(string_agg(DISTINCT cfop, '/' ORDER BY cfop), '') AS cfop, coalesce(sum(c), 0)::BIGINT AS cents_livro,
  CASE WHEN any_value(n) = 0 THEN 'NAO ENCONTRADA' WHEN any_value(algum) THEN 'EXATA' WHEN any_value(n) = 1 THEN 'NUMERO' ELSE 'AMBIGUA' END AS origem FROM cand WHERE exato OR NOT algum GROUP BY 1, 2, 3)"""


def _enriched(spark, d):
    n = F.col("numero")
    sheet = V.book(spark, d, "a").filter("seq <= 2").select((n + F.when(n % 19 == 0, 10_000_000).otherwise(0)).alias("numero"), "seq", (F.col("cents") + F.when(n % 5 == 0, 7).otherwise(0)).alias("cents"))
    return recon.enrich(sheet, V.book(spark, d, "b"))


@Q.add(f"{ENRICHED} SELECT * FROM enriched")
def enrich_codes(spark, d):
    return _enriched(spark, d)


@Q.add(f"""{ENRICHED}, s AS (SELECT unnest(string_split(cfop, '/')) AS cfop, cents FROM enriched), p AS (SELECT cfop, sum(cents)::BIGINT AS planilha, count(*) AS notas FROM s GROUP BY 1), l AS (SELECT cfop, sum(cents)::BIGINT AS livro FROM book_b GROUP BY 1)
SELECT cfop, coalesce(planilha, 0) AS planilha, coalesce(livro, 0) AS livro, coalesce(notas, 0) AS notas, coalesce(planilha, 0) - coalesce(livro, 0) AS diferenca FROM p FULL JOIN l USING (cfop)""")
def creditor_by_code(spark, d):
    return recon.creditors_by_code(_enriched(spark, d), V.book(spark, d, "b"))


@Q.add(f"""{PAIRS}, f AS (SELECT 'alto' AS severidade, 'cfop_nota' AS tipo, CAST(numero AS VARCHAR) || '/' || CAST(seq_a AS VARCHAR) AS chave, 'codigos diferentes' AS detalhe FROM pairs WHERE difere
  UNION ALL SELECT 'revisar', 'pareamento_manual', CAST(numero AS VARCHAR), 'somas sem subconjunto' FROM pairs WHERE classe = 'revisar'
  UNION ALL SELECT 'medio', 'nota_ausente', a.cfop, CAST(count(*) AS VARCHAR) || ' notas' FROM pairs p JOIN book_a a ON a.numero = p.numero AND a.seq = p.seq_a WHERE classe = 'so_a' GROUP BY a.cfop),
n AS (SELECT *, row_number() OVER (ORDER BY CASE severidade WHEN 'alto' THEN 0 WHEN 'medio' THEN 1 ELSE 2 END, tipo, chave) AS k FROM f)
SELECT 'D' || CASE WHEN k < 10000 THEN lpad(CAST(k AS VARCHAR), 4, '0') ELSE CAST(k AS VARCHAR) END AS id, severidade, tipo, chave, detalhe FROM n""")
def findings_ranked(spark, d):
    # Both what is found in pairs and what is missing come from the few that are neither equal nor without a question, made once.
    pairs = _pairs(spark, d).filter("difere or classe in ('revisar', 'so_a')").persist()
    found = recon.findings(pairs, recon.missing_by_code(pairs, V.book(spark, d, "a")))
    rank = F.when(F.col("severidade") == "alto", 0).when(F.col("severidade") == "medio", 1).otherwise(2)
    return recon.numbered(found, [rank, "tipo", "chave"]).select("id", "severidade", "tipo", "chave", "detalhe")
