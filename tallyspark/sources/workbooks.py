"""Workbooks that come in: the inventory's movement sheets and a creditor's list of notes.

A workbook is one bounded file, parsed on the driver; what follows are DataFrames.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import sheets

# Sheets and headings.
MOVEMENTS = (("DADOS DE ENTRADAS ORIGEM 1", "E"), ("DADOS DE SAÍDAS ORIGEM 1", "S"))
NUMBER_HEADS = {"nro.nfe", "nro nfe", "numero", "numero da nota", "no.nfe", "nfe", "no nfe", "n nfe"}
VALUE_HEADS = {"valor", "valor contabil", "valor da nota"}
# End of fixed values.

_RAW = "aba string, tipo string, linha int, data string, numero string, parceiro string, produto string, ncm string, peso string, valor string, origem string, obs string"


def _text(v) -> str | None:
    return None if v is None else f"{v:g}" if isinstance(v, float) and v.is_integer() and abs(v) < 1e15 else str(v)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """The movements of both sheets: aba, tipo, linha (in the sheet), data, nota_data (why a date is odd), numero, parceiro,
    produto, ncm, peso, valor, origem, obs.  Rows without date and number are left out, the totals row with them."""
    at, made = {n: i for i, n in enumerate(sheets.names(path), 1)}, []
    for name, kind in MOVEMENTS:
        for line, r in enumerate(sheets.rows(path, at[name], typed=True), 1):
            r = [f"{v:.6f}".replace(".", ",") if i in (5, 6) and isinstance(v, float) else _text(v) for i, v in enumerate([*r, *[None] * 9][:9])]
            if line > 1 and (r[0] is not None or r[1] is not None):
                made.append((name, kind, line, *r))
    raw = spark.createDataFrame(made, _RAW)
    day = X.date_of(F.col("data"))
    return raw.select("aba", "tipo", "linha", day.alias("data"), X.date_note(F.col("data")).alias("nota_data"), F.col("numero").try_cast("int").alias("numero"), F.col("parceiro"), F.col("produto"), "ncm", X.number(F.col("peso")).alias("peso"), X.number(F.col("valor")).alias("valor"), X.clean(F.col("origem")).alias("origem"), X.clean(F.col("obs")).alias("obs"))


def inventory_totals(path: str) -> dict[str, tuple[float | None, float | None]]:
    """Weight and value in each movement sheet's last row that has either: the totals to reconcile with."""
    at, out = {n: i for i, n in enumerate(sheets.names(path), 1)}, {}
    for name, kind in MOVEMENTS:
        rows = [[*r, *[None] * 9][:9] for r in sheets.rows(path, at[name], typed=True)]
        last = [r for r in rows if r[5] is not None or r[6] is not None][-1]
        out[kind] = tuple(v if isinstance(v, float) else None for v in last[5:7])
    return out


def _head(v) -> str:
    plain = unicodedata.normalize("NFKD", str(v or "").replace(" ", " ").strip().lower())
    return "".join(c for c in plain if not unicodedata.combining(c))


def creditors(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """The first sheet's headings, and its notes: linha, numero (without leading zeros), valor (null unless the cell is a
    number), colunas (all cells as texts).  Columns are found by their headings; a sheet without them is an error.  Empty rows
    and rows without a number are left out."""
    rows = sheets.rows(path, 1, typed=True)
    heads = [str(h or "").replace(" ", " ").strip() for h in next(rows)]
    number = next((i for i, h in enumerate(heads) if _head(h) in NUMBER_HEADS), None)
    value = next((i for i, h in enumerate(heads) if _head(h) in VALUE_HEADS), None)
    if number is None or value is None:
        raise ValueError("no columns for the note's number and value in the first row")
    made = []
    for line, r in enumerate(rows, 2):
        n = (_text(r[number]) or "").replace(" ", " ").strip() if number < len(r) else ""
        if n:
            v = r[value] if value < len(r) else None
            made.append((line, n.lstrip("0") or "0", v if isinstance(v, float) else None, list(map(_text, r))))
    return heads, spark.createDataFrame(made, "linha int, numero string, valor double, colunas array<string>")
