"""Rates by date: as-of lookup, chaining of validities, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.joins import dimension
from . import scan

START, END = "vigencia_inicio", "vigencia_fim"


def disjoint(rates: DataFrame, keys: list[str]) -> DataFrame:
    """rates as disjoint periods per key: wherever several hold, the one that started last.

    Only the (small) rate table is worked on, so that a lookup is a join that never multiplies rows and needs no
    aggregation of the fact table.  Of rates with one key and start, the one with the greatest values stands."""
    values = [c for c in rates.columns if c not in (*keys, START, END)]
    points = rates.select(*keys, F.col(START).alias("de")).union(rates.filter(F.col(END).isNotNull()).select(*keys, F.date_add(END, 1).alias("de"))).distinct()
    points = points.withColumn("ate", F.date_sub(F.lead("de").over(W.partitionBy(*keys).orderBy("de")), 1))
    r = rates.select(*(F.col(k).alias(f"_{k}") for k in keys), START, END, *values)
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col(START) <= F.col("de"), F.col(END).isNull() | (F.col(END) >= F.col("de"))]
    best = points.join(r, on).groupBy(*keys, "de", "ate").agg(F.max(F.struct(START, *values)).alias("r"))
    return best.select(*keys, "de", "ate", "r.*")


def asof(rows: DataFrame, rates: DataFrame, keys: list[str], date: str = "data_mov", how: str = "inner") -> DataFrame:
    """rows with the values of the rate that holds at `date`; inner drops rows without one."""
    r = disjoint(rates, keys)
    values = [c for c in r.columns if c not in (*keys, "de", "ate", START)]
    r = r.select(*(F.col(k).alias(f"_{k}") for k in keys), "de", "ate", *values)
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col(date) >= F.col("de"), F.col("ate").isNull() | (F.col(date) <= F.col("ate"))]
    return rows.join(dimension(r), on, how).drop("de", "ate", *(f"_{k}" for k in keys))


def merged(rows: DataFrame, rates: DataFrame, keys: list[str], date: str = "data_mov", how: str = "inner", size: int = scan.SIZE) -> DataFrame:
    """asof() for rate tables too large to broadcast: rows and rates of a key are laid in one order of days, and each row gets the
    last rate that has started; keys with very many of either are worked through in blocks of about `size`.

    Where that rate has ended, an older one may still hold; it outlives a later one, so only such rates come to a second round,
    and so on.  There are as many rounds as periods are nested deep.  Rows shuffled are linear in both tables."""
    values = [c for c in rates.columns if c not in (*keys, START, END)]
    never = F.lit("9999-12-31").cast("date")
    rate = F.struct(F.col(START).alias("_start_"), *values, F.coalesce(END, never).alias("_end_"))
    left = rates.dropna(subset=[*keys, START]).select(F.struct(*keys).alias("_key_"), rate.alias("_rate_"))
    whole = F.struct(*(F.col(c) for c in rows.columns))
    usable = rows.dropna(subset=[*keys, date])
    open_ = usable.select(F.struct(*keys).alias("_key_"), F.col(date).alias("_at_"), whole.alias("_row_"))
    order, out, kind = ("_at_", "_side_", "_rate_", "_tie_"), [], left.schema["_rate_"].dataType
    while True:
        starts = left.select("_key_", F.col("_rate_._start_").alias("_at_"), F.lit(0).alias("_side_"), "_rate_", F.lit(0).cast("long").alias("_tie_"), F.lit(None).cast(open_.schema["_row_"].dataType).alias("_row_"))
        facts = open_.select("_key_", "_at_", F.lit(1).alias("_side_"), F.lit(None).cast(kind).alias("_rate_"), F.xxhash64("_row_").alias("_tie_"), "_row_")
        found = scan.carry(starts.unionByName(facts), "_rate_", order, "_last_", size, "_key_").filter("_side_ = 1").persist()  # both what holds and what is still open come from it
        holds = F.coalesce(F.col("_last_._end_") >= F.col("_at_"), F.lit(False))
        out.append(found.filter(holds).select("_row_", "_last_"))
        # A rate that outlives a later one: the least end of those behind it is before its own.
        behind = W.partitionBy("_key_").orderBy(F.desc("_rate_")).rowsBetween(W.unboundedPreceding, -1)
        left = left.withColumn("_least_", F.min("_rate_._end_").over(behind)).filter(F.col("_least_") < F.col("_rate_._end_")).drop("_least_").persist()
        open_ = found.filter(~holds).select("_key_", "_at_", "_row_")
        if left.isEmpty():
            break
    if how == "left":
        out += [df.select("_row_", F.lit(None).cast(kind).alias("_last_")) for df in (open_, rows.filter(" or ".join(f"`{c}` is null" for c in (*keys, date))).select(whole.alias("_row_")))]
    done = reduce(DataFrame.unionByName, out)
    return done.select("_row_.*", *(F.col(f"_last_.{c}").alias(c) for c in values))


def known(rows: DataFrame, rates: DataFrame, keys: list[str], date: str = "data_mov") -> DataFrame:
    """rows for which some rate holds at their date."""
    r = disjoint(rates, keys).select(*(F.col(k).alias(f"_{k}") for k in keys), "de", "ate")
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col(date) >= F.col("de"), F.col("ate").isNull() | (F.col(date) <= F.col("ate"))]
    return rows.join(dimension(r), on, "left_semi")


def chain(rates: DataFrame, keys: list[str]) -> DataFrame:
    """Each validity ends the day before the next one of its key; `invalida` marks one that doesn't start later."""
    w = W.partitionBy(*keys).orderBy(START)
    out = rates.withColumn(END, F.date_sub(F.lead(START).over(w), 1))
    return out.withColumn("invalida", F.coalesce(F.lag(START).over(w) >= F.col(START), F.lit(False)))


def scope(uf: Column) -> Column:
    return F.when(F.upper(F.coalesce(uf, F.lit(""))) == "SC", "interna").otherwise("interestadual")


def suggested_block(uf: Column, exterior: Column) -> Column:
    """A suggestion by destination; null for abroad or unknown."""
    return F.when(exterior | uf.isNull() | (uf == ""), F.lit(None)).when(F.upper(uf) == "SC", "3").otherwise("2")


def consistency(rows: DataFrame, table: DataFrame, date: str = "data_mov") -> DataFrame:
    """rows (bloco, ncm) against the table's block for the product code, under the scope that the block implies."""
    implied = F.when(F.col("bloco") == "3", "interna").otherwise("interestadual")
    found = asof(rows.withColumn("ambito", implied), table.withColumnRenamed("bloco", "bloco_tabela").select("ncm", "ambito", "bloco_tabela", START, END), ["ncm", "ambito"], date, "left")
    state = (
        F.when(F.col("bloco").isNull(), "sem bloco")
        .when(F.col("bloco_tabela").isNull(), "sem regra")
        .when(F.col("bloco") == F.col("bloco_tabela"), "confere")
        .otherwise("diverge")
    )
    return found.withColumn("situacao", state)
