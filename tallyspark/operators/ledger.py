"""The ledger: movements, balances, running balances.

A ledger has produto_id, data_mov, tipo (E in, S out), nota_id, line_no, quantidade, valor, natureza, status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scan

ORDER = ("data_mov", "tipo", "nota_id", "line_no")  # E sorts before S


#: Rows of a ledger in a task of its windows, and parts from which it is dealt so; fewer are left to Spark.
ROWS, PARTS = 250_000, 16


def parts_of(rows: int) -> int | None:
    """Into how many parts to deal a ledger of so many rows by product."""
    return n if (n := -(-rows // ROWS)) >= PARTS else None


def dealt(ledger: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """ledger in so many parts by its keys.  Spark joins small parts by their bytes when shuffled, which are few for the memory that
    windows and joins over them take."""
    return ledger.repartition(parts, *keys) if parts else ledger


def valid(ledger: DataFrame, until: str | None = None) -> DataFrame:
    """Dated movements that aren't cancelled, up to a date."""
    out = ledger.filter(F.col("data_mov").isNotNull() & (F.col("status") != "cancelada"))
    return out.filter(F.col("data_mov") <= F.lit(until).cast("date")) if until else out


def signed(q: str = "quantidade") -> Column:
    return F.when(F.col("tipo") == "E", F.col(q)).otherwise(-F.col(q))


def balances(ledger: DataFrame, products: DataFrame | None = None, until: str | None = None) -> DataFrame:
    """(produto_id, saldo); with products (produto_id), those without movement too, at 0."""
    out = valid(ledger, until).groupBy("produto_id").agg(F.sum(signed()).alias("saldo"))
    if products is not None:
        out = products.select("produto_id").join(out, "produto_id", "left")
    return out.select("produto_id", F.coalesce("saldo", F.lit(0)).alias("saldo"))


def by_product() -> W:
    return W.partitionBy("produto_id").orderBy(*ORDER)


def running(ledger: DataFrame, since: str | None = None, hot: DataFrame | None = None, size: int = scan.SIZE) -> DataFrame:
    """Valid movements with `saldo` after each.  Rows before `since` count but aren't shown: the filter stays above the window.
    Products that `hot` names are worked through in blocks of about `size` rows."""
    rows = valid(ledger)
    plain = lambda df: df.withColumn("saldo", F.sum(signed()).over(by_product().rowsBetween(W.unboundedPreceding, 0)))
    if hot is None:
        out = plain(rows)
    else:
        blocked = scan.running_sum(rows.join(hot, "produto_id", "left_semi"), signed(), ORDER, "saldo", size)
        out = plain(rows.join(hot, "produto_id", "left_anti")).unionByName(blocked)
    return out.filter(F.col("data_mov") >= F.lit(since).cast("date")) if since else out


def first_negative(ledger: DataFrame, hot: DataFrame | None = None, size: int = scan.SIZE) -> DataFrame:
    """Per product the first movement that leaves the balance negative, and the least balance ever."""
    run = running(ledger, None, hot, size)
    first = F.min(F.when(F.col("saldo") < -1e-6, F.struct(*ORDER, "saldo"))).alias("f")
    out = run.groupBy("produto_id").agg(first, F.min("saldo").alias("saldo_minimo")).filter("f is not null")
    return out.select("produto_id", "f.*", "saldo_minimo")


def months(ledger: DataFrame, closed: DataFrame | None = None, limit: int = 36) -> DataFrame:
    """Months with valid movements, latest first, with their state of closing."""
    out = valid(ledger).select(F.date_format("data_mov", "yyyy-MM").alias("competencia")).distinct()
    if closed is not None:
        out = out.join(closed.select("competencia", "status"), "competencia", "left").withColumn("status", F.coalesce("status", F.lit("aberta")))
    return out.orderBy(F.desc("competencia")).limit(limit)


def coverage(ledger: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Days that the balance lasts at the rate of the exits of the last `days`; null without exits."""
    recent = (F.col("tipo") == "S") & (F.col("data_mov") >= F.date_sub(F.lit(as_of).cast("date"), days))
    out = valid(ledger).groupBy("produto_id").agg(F.sum(signed()).alias("saldo"), F.sum(F.when(recent, F.col("quantidade"))).alias("saidas"))
    rate = F.col("saidas").cast("double") / days
    return out.select("produto_id", "saldo", F.coalesce("saidas", F.lit(0)).alias("saidas"), F.when(F.col("saidas") > 0, F.col("saldo").cast("double") / rate).alias("dias"))
