"""Costs kept as states, and recosting from the earliest change on.

What a product's past means for its future is its open lots: a shortage isn't carried.  So what is left of the lots at the end
of a month is a state that costing can start from.  It is kept by change: a lot has a row for each month at whose end more or less of
it is left than before, so that there are no more rows than lots and what exits take of them, however long a lot stays open.  Estimates of shortages look at the whole history; they need its sums by day
only, which are kept too.  A retroactive change costs the rows from its month on, whatever lies before.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import costing
from . import ledger as L

_MONTH = "competencia"
_LOT = ("nota_id", "line_no", "data_mov", "custo_lote")


class States(NamedTuple):
    lots: DataFrame  # produto_id, competencia, nota_id, line_no, data_mov, custo_lote, resta: left at the end of each month in which that changed
    days: DataFrame  # produto_id, data_mov, v, q, xv, xq, primeira, movimento: sums for estimates; whether a valid row moves stock
    exits: DataFrame  # produto_id, nota_id, line_no, data_mov, quantidade, falta, custo_lotes


def _month(c: str = "data_mov") -> Column:
    return F.trunc(c, "month")


def _days(ledger: DataFrame) -> DataFrame:
    """What costing.estimates() sums, a row a product and day; cancelled notes count there, but move no stock."""
    entry = (F.col("tipo") == "E") & F.col("valor").isNotNull() & (F.col("quantidade") > 0) & (F.col("natureza") != "ACERTO")
    exit_ = (F.col("tipo") == "S") & F.col("valor").isNotNull() & (F.col("quantidade") > 0)
    priced = (F.col("tipo") == "E") & (F.col("valor") != 0) & (F.col("quantidade") != 0)
    unit = F.col("valor").cast("double") / F.when(F.col("quantidade") != 0, F.col("quantidade").cast("double"))
    return ledger.filter("data_mov is not null").groupBy("produto_id", "data_mov").agg(
        F.sum(F.when(entry, F.col("valor"))).alias("v"), F.sum(F.when(entry, F.col("quantidade"))).alias("q"), F.sum(F.when(exit_, F.col("valor"))).alias("xv"), F.sum(F.when(exit_, F.col("quantidade"))).alias("xq"),
        F.min(F.when(priced, F.struct(*L.ORDER, unit.alias("u")))).alias("primeira"), F.bool_or((F.col("status") != "cancelada") & (F.col("quantidade") > 0)).alias("movimento"),
    )


def _estimated(days: DataFrame) -> DataFrame:
    """(produto_id, data_mov, est_custo) from the sums by day, as costing.estimates() has it."""
    upto, whole = W.partitionBy("produto_id").orderBy("data_mov").rowsBetween(W.unboundedPreceding, 0), W.partitionBy("produto_id")
    ratio = lambda v, q, w: F.sum(v).over(w).cast("double") / F.when(F.sum(q).over(w) != 0, F.sum(q).over(w).cast("double"))
    nz = lambda c: F.when(c != 0, c)
    cost = F.coalesce(nz(ratio("v", "q", upto)), nz(F.min("primeira").over(whole)["u"]), nz(ratio("xv", "xq", whole)), F.lit(0.0))
    return days.select("produto_id", "data_mov", cost.alias("est_custo"))


def _run(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lots, exits) of rows of the ledger, which may begin with lots carried from a state (custo_lote set).  Both come from the rows on
    the axis and from what exits took, which are kept: made for each, they would be shuffled for each."""
    axis = costing.axis(rows).persist()
    used = costing.overlaps(axis).persist()
    took = used.groupBy("produto_id", F.col("saida_nota").alias("nota_id"), F.col("saida_linha").alias("line_no"), F.col("saida_data").alias("data_mov"))
    took = took.agg(F.sum(F.col("quantidade").cast("double") * F.col("custo_unit")).alias("custo_lotes"))
    exits = axis.filter("tipo = 'S'").select("produto_id", "nota_id", "line_no", "data_mov", "quantidade", "falta").join(took, ["produto_id", "nota_id", "line_no", "data_mov"], "left")
    unit = F.coalesce(F.col("custo_lote"), F.when((F.col("valor") != 0) & (F.col("quantidade") != 0), F.col("valor").cast("double") / F.col("quantidade").cast("double")), F.lit(0.0))
    came = axis.filter("tipo = 'E'").select("produto_id", "nota_id", "line_no", "data_mov", unit.alias("custo_lote"), F.when(~F.col("carried"), _month()).alias(_MONTH), F.col("quantidade").alias("d"))
    went = used.select(
        "produto_id", F.col("entrada_nota").alias("nota_id"), F.col("entrada_linha").alias("line_no"), F.col("entrada_data").alias("data_mov"), F.col("custo_unit").alias("custo_lote"), _month("saida_data").alias(_MONTH),
        (-F.col("quantidade")).cast("decimal(15,3)").alias("d"),
    )
    # A carried lot begins with what is left of it, before any month.
    steps = came.unionByName(went).groupBy("produto_id", *_LOT, _MONTH).agg(F.sum("d").alias("d")).filter("d <> 0")
    upto = W.partitionBy("produto_id", *_LOT).orderBy(F.asc_nulls_first(_MONTH)).rowsBetween(W.unboundedPreceding, 0)
    lots = steps.withColumn("resta", F.sum("d").over(upto).cast("decimal(15,3)")).filter(F.col(_MONTH).isNotNull()).select("produto_id", _MONTH, *_LOT, "resta")
    return lots, exits.select("produto_id", "nota_id", "line_no", "data_mov", "quantidade", "falta", F.coalesce("custo_lotes", F.lit(0.0)).alias("custo_lotes"))


def by_product(ledger: DataFrame, parts: int | None = None) -> DataFrame:
    """What states need of a ledger, by product and kept, in `parts` (ledger.parts_of) or more.  All that is made of it here goes by
    product, so whatever is made of the kept rows, of one part of them or another, is not shuffled again."""
    rows = ledger.select("produto_id", *L.ORDER, "quantidade", "valor", "natureza", "status")
    return rows.repartition(max(parts or 1, int(ledger.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "produto_id").persist()


def _plain(ledger: DataFrame) -> DataFrame:
    return ledger.select("produto_id", *L.ORDER, "quantidade", "valor", "natureza", "status", F.lit(None).cast("double").alias("custo_lote"), F.lit(False).alias("carried"))


def build(ledger: DataFrame) -> States:
    """The states of a whole ledger."""
    lots, exits = _run(_plain(ledger))
    return States(lots, _days(ledger), exits)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(produto_id, desde): the first day on which a product's rows differ between two states of the ledger.  It is kept: a row a product
    at most, which both states of the ledger are read for."""
    cols = ("produto_id", *L.ORDER, "quantidade", "valor", "natureza", "status")
    mark = lambda df, v: df.select(F.xxhash64(*cols).alias("h"), "produto_id", "data_mov", F.lit(v).alias("v"))
    return mark(before, 1).unionByName(mark(after, -1)).groupBy("produto_id", "data_mov", "h").agg(F.sum("v").alias("v")).filter("v <> 0 and data_mov is not null").groupBy("produto_id").agg(F.min("data_mov").alias("desde")).persist()


def since(changed: DataFrame, after: DataFrame, kept: States) -> States:
    """The states of the changed products (produto_id, desde) after a change, from `kept` and the rows of `after` from the month of
    `desde` on: what replaces the products' rows in each table from that month on.  In `days`, earlier months are given too, since
    estimates need them; nothing of them is read from the ledger."""
    start = changed.select("produto_id", _month("desde").alias("inicio"))
    rows = _plain(after.join(start, "produto_id").filter(F.col("data_mov") >= F.col("inicio")))
    before = kept.days.join(start, "produto_id").filter(F.col("data_mov") < F.col("inicio")).drop("inicio")
    open_ = kept.lots.join(start, "produto_id").filter(F.col(_MONTH) < F.col("inicio")).groupBy("produto_id", *_LOT).agg(F.max_by("resta", _MONTH).alias("resta")).filter("resta > 0")
    carried = open_.select(
        "produto_id", "data_mov", F.lit("E").alias("tipo"), "nota_id", "line_no", F.col("resta").alias("quantidade"), F.lit(None).cast("decimal(15,2)").alias("valor"), F.lit("").alias("natureza"), F.lit("lancada").alias("status"),
        "custo_lote", F.lit(True).alias("carried"),
    )
    lots, exits = _run(carried.unionByName(rows))
    return States(lots, before.unionByName(_days(rows)), exits)


def replaced(changed: DataFrame, kept: States, new: States) -> States:
    """All states after a change: the new ones of the changed products from its month on, the kept ones else."""
    start = changed.select("produto_id", _month("desde").alias("inicio"))

    def old(df: DataFrame, month: Column) -> DataFrame:
        return df.join(start, "produto_id", "left").filter(F.col("inicio").isNull() | (month < F.col("inicio"))).drop("inicio")

    days = kept.days.join(start, "produto_id", "left_anti").unionByName(new.days)
    return States(old(kept.lots, F.col(_MONTH)).unionByName(new.lots), days, old(kept.exits, _month()).unionByName(new.exits))


def costs(states: States) -> DataFrame:
    """costing.exit_costs() from states: what shortages cost follows from the sums by day, in earlier months too."""
    out = states.exits.join(_estimated(states.days), ["produto_id", "data_mov"])
    return out.select("produto_id", "nota_id", "line_no", "data_mov", "quantidade", "falta", (F.col("custo_lotes") + F.col("falta").cast("double") * F.col("est_custo")).alias("custo_total"))
