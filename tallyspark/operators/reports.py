"""What reports and callers ask for beside the single operators: totals of documents, the dashboard, nested payloads, and the
upkeep of parties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def note_items(notes: DataFrame, items: DataFrame, key: str, order: list[str]) -> DataFrame:
    """notes with itens: the rows of items that have their key, in order; an empty array where there are none.  A note's items
    are bounded by the note."""
    rest = [c for c in items.columns if c != key]
    own = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in rest if c not in order)))).alias("itens"))
    out = notes.join(own, key, "left")
    return out.withColumn("itens", F.coalesce("itens", F.array().cast(own.schema["itens"].dataType)))


def book_totals(documents: DataFrame, lines: DataFrame, key: str = "documento", value: str = "valor_contabil") -> DataFrame:
    """documents with total_extraido (sum of their lines, in cents' precision) and conferido (whether there is a line)."""
    sums = lines.groupBy(key).agg(F.sum(value).alias("_sum_"), F.count("*").alias("_n_"))
    out = documents.join(sums, key, "left")
    total = F.round(F.coalesce("_sum_", F.lit(0)), 2)
    return out.select(*documents.columns, total.alias("total_extraido"), F.coalesce(F.col("_n_") > 0, F.lit(False)).alias("conferido"))


def typed_lines(parts: dict[str, DataFrame], columns: dict[str, str]) -> DataFrame:
    """Lines of several documents (by name) as one typed table; columns that a document lacks are null, others go."""
    out = None
    for name, rows in parts.items():
        one = rows.select(F.lit(name).alias("documento"), *(F.col(c).cast(kind).alias(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in columns.items()))
        out = one if out is None else out.unionByName(one)
    return out


def dashboard(position: DataFrame, month: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: totals of the position (saldo, valor), the month's assessment (a row or none) and open issues.  Each part is
    aggregated to a row before they meet."""
    stock = position.agg(F.coalesce(F.sum("saldo"), F.lit(0)).alias("estoque_qtd"), F.coalesce(F.sum("valor"), F.lit(0)).alias("estoque_valor"), F.count("*").alias("produtos"))
    tax = month.agg(*(F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("base_beneficiada", "icms_recolher", "fundo_social", "fundo_educacao", "carga_efetiva")))
    open_ = issues.agg(F.count_if(~F.col("resolvida")).alias("excecoes_abertas"))
    return stock.crossJoin(tax).crossJoin(open_)


def stock_anomalies(first_negative: DataFrame, exits: DataFrame, position: DataFrame) -> DataFrame:
    """(regra, produto_id, quantidade): each product's first negative balance, all exits without stock taken together, final
    balances below zero, and stock without a value."""
    fall = first_negative.select(F.lit("saldo negativo").alias("regra"), "produto_id", F.col("saldo").cast("double").alias("quantidade"))
    short = exits.filter("falta > 0").agg(F.sum("falta").cast("double").alias("quantidade"), F.count("*").alias("n")).filter("n > 0")
    short = short.select(F.lit("saida sem lastro").alias("regra"), F.lit(None).cast("long").alias("produto_id"), "quantidade")
    # Both rules on the position exclude each other, so one pass over it serves them.
    rule = F.when(F.col("saldo") < -1e-6, "saldo final negativo").when((F.col("saldo") > 0) & (F.coalesce("valor", F.lit(0)) == 0), "estoque sem valor")
    last = position.select(rule.alias("regra"), "produto_id", F.col("saldo").cast("double").alias("quantidade")).filter("regra is not null")
    return fall.unionByName(short).unionByName(last)


def keep_parties(parties: DataFrame, seen: DataFrame) -> DataFrame:
    """parties (parceiro_id, cnpj, uf, papel) with what notes tell of them: seen (parceiro_id, ordem, cnpj, uf, papel).

    A missing tax id or state is filled from the first note that has one; a party met in another role than its own has both."""
    first = lambda c: F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("ordem"))).alias(f"_{c}_")
    told = seen.groupBy("parceiro_id").agg(first("cnpj"), first("uf"), F.collect_set(F.when(F.col("papel") != "", F.col("papel"))).alias("_roles_"))  # a handful of roles
    own = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.col(f"_{c}_")).alias(c)
    other = F.size(F.filter(F.coalesce("_roles_", F.array().cast("array<string>")), lambda r: r != F.col("papel"))) > 0
    out = parties.join(told, "parceiro_id", "left")
    rest = [c for c in parties.columns if c not in ("parceiro_id", "cnpj", "uf", "papel")]
    return out.select("parceiro_id", *rest, own("cnpj"), own("uf"), F.when((F.col("papel") != "") & other, "ambos").otherwise(F.col("papel")).alias("papel"))
