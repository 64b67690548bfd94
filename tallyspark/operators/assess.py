"""The monthly assessment, its closing, and the statement of the reconciled month."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..refdata import FUND_EDUCATION, FUND_SOCIAL, FUND_SOCIAL_CREDIT
from .rates import asof

TOTALS = ("base_beneficiada", "debito", "credito_presumido", "estorno", "devolucao_icms", "icms_deduzir", "icms_recolher", "fundo_social", "fundo_educacao")


def taxed(items: DataFrame, rates: DataFrame) -> DataFrame:
    """Valid items with a block, per month, block and rate: base sums.  Items come with base, bloco, natureza, data_mov.

    Everything after works on a few rows a month: sums are exact decimals until rates multiply them."""
    rows = items.filter("bloco is not null and status <> 'cancelada' and natureza <> 'ACERTO' and data_mov is not null")
    rows = asof(rows, rates, ["bloco"])
    back = (F.col("natureza") == "DEVOLUCAO").alias("devolucao")
    return rows.groupBy(F.date_format("data_mov", "yyyy-MM").alias("competencia"), "bloco", back, "aliquota", "aliq_presumido").agg(F.sum(F.coalesce("base", F.lit(0))).alias("base"), F.count("*").alias("notas"))


def blocks(items: DataFrame, rates: DataFrame) -> DataFrame:
    """Per month, block and return flag: base, icms, presumido and the number of items."""
    rows = taxed(items, rates)
    b = F.col("base").cast("double")
    return rows.groupBy("competencia", "bloco", "devolucao").agg(F.sum(b).alias("base"), F.sum(b * F.col("aliquota")).alias("icms"), F.sum(b * F.col("aliq_presumido")).alias("presumido"), F.sum("notas").alias("notas"))


def totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Tax due, funds and load from block rows (devolucao, base, icms, presumido).

    fundo_social has no floor; fundo_social_planilha is the worksheet's, floored per side."""
    part = lambda c, back: F.coalesce(F.sum(F.when(F.col("devolucao") == back, F.col(c))), F.lit(0.0))
    s = rows.groupBy(*keys).agg(
        part("base", False).alias("base_beneficiada"), part("base", True).alias("base_devolucao"), part("icms", False).alias("debito"),
        part("presumido", False).alias("credito_presumido"), part("icms", True).alias("devolucao_icms"), part("presumido", True).alias("estorno"),
    )
    c = F.col
    sale = FUND_SOCIAL * c("base_beneficiada") - FUND_SOCIAL_CREDIT * c("credito_presumido")
    back = FUND_SOCIAL * c("base_devolucao") - FUND_SOCIAL_CREDIT * c("estorno")
    due = (c("debito") + c("estorno")) - (c("credito_presumido") + c("devolucao_icms"))
    return s.select(
        *keys, "base_beneficiada", "base_devolucao", "debito", "credito_presumido", "estorno", "devolucao_icms", (c("debito") - c("devolucao_icms")).alias("icms_deduzir"), due.alias("icms_recolher"),
        (sale - back).alias("fundo_social"), (F.greatest(sale, F.lit(0.0)) - F.greatest(back, F.lit(0.0))).alias("fundo_social_planilha"),
        (FUND_EDUCATION * (c("credito_presumido") - c("estorno"))).alias("fundo_educacao"),
        F.when(c("base_beneficiada") != 0, due / c("base_beneficiada") * 100).otherwise(0.0).alias("carga_efetiva"),
    )


def summary(items: DataFrame, rates: DataFrame) -> DataFrame:
    return totals(blocks(items, rates), ["competencia"])


def scenarios(items: DataFrame, rates: DataFrame, extra: float, into: tuple[str, ...] = ("2", "3")) -> DataFrame:
    """The assessment with `extra` base more in one block at a time: (competencia, cenario, icms_recolher, diferenca)."""
    rows = blocks(items, rates)
    per_rate = rows.filter("not devolucao and base <> 0").select("competencia", "bloco", (F.col("icms") / F.col("base")).alias("a"), (F.col("presumido") / F.col("base")).alias("p"))
    made = [rows.withColumn("cenario", F.lit("atual"))]
    for block in into:
        add = per_rate.filter(F.col("bloco") == block).select("competencia", "bloco", F.lit(False).alias("devolucao"), F.lit(extra).alias("base"), (F.col("a") * extra).alias("icms"), (F.col("p") * extra).alias("presumido"), F.lit(0).cast("long").alias("notas"))
        made.append(rows.unionByName(add).withColumn("cenario", F.lit(f"bloco {block}")))
    out = totals(reduce(DataFrame.unionByName, made), ["competencia", "cenario"]).select("competencia", "cenario", "icms_recolher")
    now = out.filter("cenario = 'atual'").select("competencia", F.col("icms_recolher").alias("atual"))
    return out.join(now, "competencia").select("competencia", "cenario", "icms_recolher", (F.col("icms_recolher") - F.col("atual")).alias("diferenca"))


def close(months: DataFrame, closed: DataFrame) -> DataFrame:
    """Snapshot rows of months not closed yet."""
    return months.join(closed.filter("status = 'fechada'").select("competencia"), "competencia", "left_anti").select("competencia", *TOTALS, F.lit("fechada").alias("status"))


def reopen(closed: DataFrame, month: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """(closed without the month's lock, audit row); the reason needs five characters."""
    if len(reason.strip()) < 5:
        raise ValueError("a reason of at least five characters is needed")
    out = closed.withColumn("status", F.when(F.col("competencia") == month, "aberta").otherwise(F.col("status")))
    row = closed.filter(F.col("competencia") == month).select(F.lit("REABRIR").alias("acao"), F.lit(month).alias("chave"), F.to_json(F.struct(F.lit(reason).alias("motivo"))).alias("depois"))
    return out, row


COMPARED = ("base_beneficiada", "debito", "credito_presumido", "estorno", "devolucao_icms", "icms_recolher", "fundo_social")


def drift(frozen: DataFrame, now: DataFrame, columns: tuple[str, ...] = COMPARED) -> DataFrame:
    """Frozen against recomputed totals: greatest difference, coherent below a cent."""
    n = now.select("competencia", *(F.col(c).alias(f"n_{c}") for c in columns))
    gaps = [F.abs(F.round(F.col(c), 2) - F.round(F.coalesce(F.col(f"n_{c}"), F.lit(0.0)), 2)) for c in columns]
    return frozen.join(n, "competencia", "left").select("competencia", F.greatest(*gaps).alias("diferenca")).withColumn("coerente", F.col("diferenca") < 0.01)


def statement(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(quadro, item, valor) cells to debits, credits, tax to pay and credit carried."""

    def cell(q: str, i: str) -> Column:
        return F.coalesce(F.sum(F.when((F.col("quadro") == q) & (F.col("item") == i), F.col("valor"))), F.lit(0.0))

    debit = reduce(lambda a, b: a + b, [cell(*x) for x in (("04", "010"), ("04", "020"), ("04", "030"), ("04", "060"), ("09", "036"), ("09", "038"))])
    credit = reduce(lambda a, b: a + b, [cell(*x) for x in (("05", "020"), ("09", "075"), ("09", "076"), ("05", "010"))])
    s = cells.groupBy(*keys).agg(debit.alias("debitos"), credit.alias("creditos"))
    gap = F.col("debitos") - F.col("creditos")
    return s.select(*keys, "debitos", "creditos", F.greatest(gap, F.lit(0.0)).alias("recolher"), F.greatest(-gap, F.lit(0.0)).alias("transportar"))
