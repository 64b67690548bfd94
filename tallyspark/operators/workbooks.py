"""Report workbooks: which tables each holds, in order, with their totals; `sources.sheets.write` makes the file.

Sheets are result tables of a month or of an import, bounded by what a sheet can hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_total(rows: DataFrame, label: str, sums: list[str]) -> DataFrame:
    """rows, and after them one with the sums and TOTAL in `label`."""
    total = rows.agg(*(F.sum(c).alias(c) for c in sums)).select(*(F.lit("TOTAL").alias(c) if c == label else F.col(c) if c in sums else F.lit(None).alias(c) for c in rows.columns), F.lit(1).alias("_last_"))
    both = rows.withColumn(label, F.col(label).cast("string")).withColumn("_last_", F.lit(0)).unionByName(total)
    return both.orderBy("_last_", label).drop("_last_")


def assessment(blocks: DataFrame, summary: DataFrame, items: DataFrame, origin: DataFrame) -> dict[str, DataFrame]:
    """Blocks of the month (sales, then returns), its seven lines, the entries behind them and where they come from."""
    s = summary.select("competencia", F.inline(F.array(*(F.struct(F.lit(i).alias("ordem"), F.lit(c).alias("linha"), F.col(c).cast("double").alias("valor")) for i, c in enumerate(("debito", "estorno", "credito_presumido", "devolucao_icms", "icms_recolher", "fundo_social", "fundo_educacao"), 1)))))
    return {"Blocos": blocks.orderBy("devolucao", "bloco"), "Resumo": s.orderBy("competencia", "ordem"), "Lancamentos": items, "Origem": origin}


def stock(rollforward: DataFrame, position: DataFrame, movements: DataFrame) -> dict[str, DataFrame]:
    """Opening, in, out, closing and average cost by product with the total row, and the movements in order."""
    rows = rollforward.filter("produto_id is not null").join(position.select("produto_id", "custo_medio"), "produto_id", "left")
    return {"Estoque": with_total(rows, "produto_id", ["abertura", "entradas", "saidas", "fechamento"]), "Movimentos": movements.orderBy("produto_id", "data_mov", "tipo", "nota_id", "line_no")}


def pending(by_area: DataFrame, issues: DataFrame) -> dict[str, DataFrame]:
    """Counts by area, most first, and the issues: open ones first, latest first."""
    return {"Resumo": by_area.orderBy(F.desc("n"), "area"), "Pendencias": issues.orderBy("resolvida", F.desc("criada_em"))}


def import_audit(items: DataFrame) -> dict[str, DataFrame]:
    """One row an item of each file, with its class."""
    return {"Importacao": items}


def reconciliation(balance: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """Code balances of both books with differences and totals, inbound and outbound, and the note pairs."""
    sums = [c for c in balance.columns if c not in ("cfop", "situacao")]
    side = lambda codes: with_total(balance.filter(F.substring("cfop", 1, 1).isin(*codes)), "cfop", sums)
    return {"CFOP entradas": side("123"), "CFOP saidas": side("567"), "Notas": pairs.orderBy("numero", "classe", "seq_a", "seq_b")}


def creditors(heads: list[str], notes: DataFrame, by_code: DataFrame) -> dict[str, DataFrame]:
    """The sheet's own columns with the codes found and how, and the totals by code; what was not found is a line of its own."""
    own = [F.get("colunas", F.lit(i)).alias(h or f"coluna {i + 1}") for i, h in enumerate(heads)]
    codes = by_code.withColumn("cfop", F.when(F.col("cfop") == "", "NAO ENCONTRADA").otherwise(F.col("cfop")))
    return {"Notas": notes.orderBy("linha").select(*own, F.col("cfop").alias("CFOP"), F.col("origem").alias("Situacao")), "Por CFOP": with_total(codes, "cfop", ["planilha", "livro", "notas", "diferenca"])}


def sanitation(findings: DataFrame, sheets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Findings by severity first, then the tables they rest on; tables without a row are left out."""
    return {"Achados": findings.orderBy("id")} | {name: df for name, df in sheets.items() if df.limit(1).count()}
