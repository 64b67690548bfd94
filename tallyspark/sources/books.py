"""Fiscal books as text: stateful line formats read with windows over line numbers.

Lines are (arquivo, line_no, line).  State (the current section, the line to attach to) is carried by windows per file, never
by the order of partitions.  Files are the unit of parallelism.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import amount, bare_number

# The line formats.
NUM = r"-?\(?-?[\d.]{1,20},\d{2}\)?"
CODES = ((r"^0?1\s+VALORES FISCAIS ENTRADAS", "entradas"), (r"^0?2\s+VALORES FISCAIS SAÍDAS", "saidas"), (r"^0?3\s+RESUMO DOS VALORES", ""))
TABLES = r"^(0?4|0?5|09|14)\s+(Resumo da Apuração|CÁLCULO DO IMPOSTO|Demonstrativo)"
LEDGER = ((r"^ENTRADAS$", "entradas"), (r"^SAÍDAS$", "saidas"), (r"SUBTOTAIS", ""), (r"RESUMO DA APURAÇÃO", "resumo"))
IN_ACCOUNTING = rf"^(\d{{2}}/\d{{2}}/\d{{4}})\s+(.+?)\s+(\d{{1,4}})\s+(\d{{1,9}})\s+(\d{{2}}/\d{{2}}/\d{{4}})\s+(\S+)\s+([A-Z]{{2}})\s+({NUM})\s+(\d)-(\d{{3}})\s+(\d)\s+({NUM})(.*)$"
IN_ACCOUNTING_MORE = rf"^4\s+({NUM})\s+({NUM})\s*$"
IN_COMPANY = rf"^(\d{{2}}/\d{{2}}/\d{{4}})\s+(\d{{2,3}})\s+(\d{{1,4}})\s+(\d{{1,9}})\s+(\d{{2}}/\d{{2}}/\d{{4}})\s+(\d{{11,14}})\s+([A-Z]{{2}})\s+({NUM})\s+([1-7]\d{{3}})\s*$"
IN_COMPANY_TAX = rf"^ICMS\s+(\d)\s+({NUM})\s+(\d+(?:,\d+)?)\s+({NUM})\s*$"
OUT_ACCOUNTING = rf"^(.+?)\s+(\d{{1,3}})\s+(\d{{1,9}})\s+(\d{{2}})\s+([A-Z]{{2}})\s+({NUM})\s+(\d)-(\d{{3}})\s+ICMS\s+({NUM})\s+({NUM})\s+({NUM})\s+({NUM})\s+({NUM})\s*$"
OUT_COMPANY = rf"^\s*(\d{{1,3}})\s+(\d{{1,3}})\s+(\d{{1,9}})\s+(\d{{1,2}})\s+([A-Z]{{2}})\s+({NUM})\s+(\d{{4}})\s+({NUM})\s+(\d+)\s+({NUM})\s+({NUM})\s+({NUM})\s*(\S.*)?$"
# End of fixed values.


def lines(files: DataFrame) -> DataFrame:
    """(arquivo, text) as lines, trimmed at both ends."""
    each = files.select("arquivo", F.posexplode(F.split("text", r"\r\n|\r|\n|\f")).alias("line_no", "line"))
    return each.withColumn("line", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")))


def _by_file() -> W:
    return W.partitionBy("arquivo").orderBy("line_no")


def in_sections(rows: DataFrame, starts: tuple[tuple[str, str], ...]) -> DataFrame:
    """rows with secao: the last section begun at or before the line; an empty name ends it.  Headings themselves go."""
    mark = None
    for pattern, name in starts:
        here = F.col("line").rlike(pattern)
        mark = F.when(here, name) if mark is None else mark.when(here, name)
    rows = rows.withColumn("_mark_", mark)
    rows = rows.withColumn("secao", F.last("_mark_", True).over(_by_file().rowsBetween(W.unboundedPreceding, 0)))
    return rows.filter("_mark_ is null and secao <> ''").drop("_mark_")


def _part(pattern: str, i: int) -> Column:
    return F.regexp_extract("line", pattern, i)


def _parts(pattern: str, n: int) -> Column:
    """All n groups of a pattern for whole lines, from one match; no group holds a line feed."""
    return F.split(F.regexp_replace("line", pattern, "\n".join(f"${i}" for i in range(1, n + 1))), "\n")


def _code_lines(rows: DataFrame, difal: bool) -> DataFrame:
    found = rows.withColumn("cfop", _part(r"^([1-7]\d{3})\s+(.*)$", 1)).filter("cfop <> ''")
    n = F.transform(F.regexp_extract_all(F.substring("line", 5, 1 << 20), F.lit(f"({NUM})"), F.lit(1)), amount)
    found = found.withColumn("n", n).filter("size(n) >= 5")
    eighth = F.when((F.col("secao") == "entradas") & (F.size("n") > 7), F.get("n", F.lit(7))) if difal else F.lit(None)
    names = ("valor_contabil", "base_calculo", "imposto", "isentas", "outras")
    v = F.struct(*(F.get("n", F.lit(i)).alias(c) for i, c in enumerate(names)), F.coalesce(eighth, F.lit(0.0)).alias("difal"))
    last = found.groupBy("arquivo", "secao", "cfop").agg(F.max_by(v, "line_no").alias("v"))
    return last.select("arquivo", F.col("secao").alias("tipo"), "cfop", "v.*")


def dime_codes(rows: DataFrame) -> DataFrame:
    """Balances by code of the monthly return, both directions; a code's last line counts."""
    return _code_lines(in_sections(rows, CODES), difal=True)


def ledger_codes(rows: DataFrame) -> DataFrame:
    """Balances by code of the tax ledger."""
    return _code_lines(in_sections(rows, LEDGER).filter("secao <> 'resumo'"), difal=False)


def ledger_summary(rows: DataFrame) -> DataFrame:
    """(arquivo, item, valor) of the tax ledger's summary: the second of the trailing numbers."""
    p = rf"^(\d{{3}})\s+(.*?)\s+({NUM})\s+({NUM})$"
    found = in_sections(rows, LEDGER).filter("secao = 'resumo'").withColumn("item", _part(p, 1)).filter("item <> ''")
    return found.groupBy("arquivo", "item").agg(F.max_by(amount(_part(p, 4)), "line_no").alias("valor"))


def dime_statement(rows: DataFrame) -> DataFrame:
    """(arquivo, quadro, item, valor) cells of the return's statement; a cell's last line counts."""
    table = F.when(F.col("line").rlike(TABLES), F.lpad(_part(TABLES, 1), 2, "0"))
    rows = rows.withColumn("quadro", F.last(table, True).over(_by_file().rowsBetween(W.unboundedPreceding, 0)))
    p = rf"^(\d{{3}})\s+(.*?)\s+({NUM})$"
    found = rows.filter("quadro is not null").withColumn("item", _part(p, 1)).filter("item <> ''")
    return found.groupBy("arquivo", "quadro", "item").agg(F.max_by(amount(_part(p, 3)), "line_no").alias("valor"))


def inbound_accounting(rows: DataFrame) -> DataFrame:
    """Inbound book of the accounting side; a line `4 base value` gives the last entry before it its difal."""
    p = IN_ACCOUNTING
    rows = rows.withColumn("main", F.col("line").rlike(p))
    rows = rows.withColumn("grupo", F.sum(F.col("main").cast("int")).over(_by_file().rowsBetween(W.unboundedPreceding, 0))).filter("grupo > 0")
    rows = rows.withColumn("more", ~F.col("main") & F.col("line").rlike(IN_ACCOUNTING_MORE))
    more = F.col("more")
    extra = F.max_by(F.when(more, F.struct(amount(_part(IN_ACCOUNTING_MORE, 1)).alias("b"), amount(_part(IN_ACCOUNTING_MORE, 2)).alias("d"))), F.when(more, F.col("line_no"))).alias("x")
    one = rows.groupBy("arquivo", "grupo").agg(F.min_by("line", "line_no").alias("line"), F.min("line_no").alias("line_no"), extra)
    part = lambda i: F.get("g", F.lit(i - 1))
    one = one.withColumn("g", _parts(p, 13)).withColumn("rest", F.regexp_extract_all(part(13), F.lit(f"({NUM})"), F.lit(1)))
    rest = F.col("rest")
    tail = lambda i: F.when(F.size(rest) >= 2, amount(F.get(rest, F.lit(i)))).otherwise(0.0)
    return one.select(
        "arquivo", "line_no", part(1).alias("data_entrada"), F.trim(part(2)).alias("especie"), part(3).alias("serie"), bare_number(part(4)).alias("numero"), part(5).alias("data_documento"),
        part(6).alias("emitente"), part(7).alias("uf"), amount(part(8)).alias("valor_contabil"), F.concat(part(9), part(10)).alias("cfop"), part(11).alias("cod_fiscal"),
        amount(part(12)).alias("base_calculo"), tail(0).alias("aliquota"), tail(1).alias("imposto"), F.coalesce("x.b", F.lit(0.0)).alias("difal_base"), F.coalesce("x.d", F.lit(0.0)).alias("difal"),
    )


def inbound_company(rows: DataFrame) -> DataFrame:
    """Inbound book of the company; a line `ICMS ...` belongs to the next entry, the last of several wins."""
    p, t = IN_COMPANY, IN_COMPANY_TAX
    rows = rows.withColumn("tax", F.col("line").rlike(t))
    rows = rows.withColumn("main", ~F.col("tax") & F.col("line").rlike(p))
    before = F.coalesce(F.sum(F.col("main").cast("int")).over(_by_file().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("grupo", before).filter("main or tax").withColumn("t", F.when(F.col("tax"), _parts(t, 4)))
    told = lambda i: F.get("t", F.lit(i - 1))
    x = F.struct(told(1).alias("cod_fiscal"), amount(told(2)).alias("base_calculo"), amount(F.concat(told(3), F.when(told(3).contains(","), "").otherwise(",0"))).alias("aliquota"), amount(told(4)).alias("imposto"))
    one = rows.groupBy("arquivo", "grupo").agg(F.max_by(F.when(F.col("tax"), x), F.when(F.col("tax"), F.col("line_no"))).alias("x"), F.max(F.when(F.col("main"), F.struct("line_no", "line"))).alias("m")).filter("m is not null")
    one = one.select("arquivo", "m.*", "x").withColumn("g", _parts(p, 9))
    part = lambda i: F.get("g", F.lit(i - 1))
    return one.select(
        "arquivo", "line_no", part(1).alias("data_entrada"), part(2).alias("especie"), part(3).alias("serie"), bare_number(part(4)).alias("numero"), part(5).alias("data_documento"), part(6).alias("emitente"),
        part(7).alias("uf"), amount(part(8)).alias("valor_contabil"), part(9).alias("cfop"), F.coalesce("x.cod_fiscal", F.lit("")).alias("cod_fiscal"),
        *(F.coalesce(f"x.{c}", F.lit(0.0)).alias(c) for c in ("base_calculo", "aliquota", "imposto")),
    )


def outbound_accounting(rows: DataFrame) -> DataFrame:
    p = OUT_ACCOUNTING
    return rows.filter(F.col("line").rlike(p)).select(
        "arquivo", "line_no", F.trim(_part(p, 1)).alias("especie"), _part(p, 2).alias("serie"), bare_number(_part(p, 3)).alias("numero"), _part(p, 4).alias("dia"), _part(p, 5).alias("uf"), amount(_part(p, 6)).alias("valor_contabil"),
        F.concat(_part(p, 7), _part(p, 8)).alias("cfop"), *(amount(_part(p, i)).alias(c) for i, c in enumerate(("base_calculo", "aliquota", "imposto", "isentas", "outras"), 9)), F.lit(False).alias("cancelada"),
    )


def outbound_company(rows: DataFrame) -> DataFrame:
    """Outbound book of the company; text after the numbers may say that the note is cancelled."""
    p = OUT_COMPANY
    return rows.filter(F.col("line").rlike(p)).select(
        "arquivo", "line_no", _part(p, 1).alias("especie"), _part(p, 2).alias("serie"), bare_number(_part(p, 3)).alias("numero"), _part(p, 4).alias("dia"), _part(p, 5).alias("uf"), amount(_part(p, 6)).alias("valor_contabil"),
        _part(p, 7).alias("cfop"), amount(_part(p, 8)).alias("base_calculo"), amount(F.concat(_part(p, 9), F.lit(",0"))).alias("aliquota"),
        *(amount(_part(p, i)).alias(c) for i, c in enumerate(("imposto", "isentas", "outras"), 10)), _part(p, 13).contains("ancelad").alias("cancelada"),
    )


def with_block(rows: DataFrame, load: str, blocks: dict[str, str], order: str = "line_no") -> DataFrame:
    """Sheet rows with the block that the last load (0.6, 1.0, 2.1 and the like) above them or on them opened."""
    opened = None
    for value, block in blocks.items():
        here = F.col(load) == value
        opened = F.when(here, block) if opened is None else opened.when(here, block)
    return rows.withColumn("bloco", F.last(opened, True).over(W.partitionBy("arquivo").orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
