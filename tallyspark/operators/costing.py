"""First-in first-out lots and their cost, as one closed form over windows.

Per product, in the ledger's order, entries and exits are laid on one axis of cumulated quantity: each entry and each
matched exit is an interval.  An exit takes the lots that its interval overlaps.  What exceeds the stock at an exit is a
shortage; it isn't carried, so the next entry opens a full lot.  Overlaps are found by a sweep along the axis (who covered
this point last?), not by a join, so a product's cost grows with its rows and not with their square.  All windows share one
shuffle by product.

A product with very many rows would be one task.  Where there are such, `hot` names them (scan.hot_products): they are worked
through in blocks of about `size` rows, the others by windows; the rows that come out are the same.

`parts` (ledger.parts_of) is in how many parts by product a large ledger is worked through, so that a task's memory doesn't grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ledger as L
from . import scan

_FIRST = W.unboundedPreceding


#: In place of `hot`: all rows are those of hot products.
_ALL = "all"


def _apart(rows: DataFrame, hot: DataFrame | str | None, plain, blocked) -> DataFrame:
    """plain() of the rows of most products and blocked() of those of hot ones."""
    if hot is None or hot is _ALL:
        return blocked(rows) if hot else plain(rows)
    return plain(rows.join(hot, "produto_id", "left_anti")).unionByName(blocked(rows.join(hot, "produto_id", "left_semi")))


def estimates(ledger: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """ledger with est_custo: the unit cost to assume at a row's date where no lot is left.

    The average of the entries up to the date, else the first dated entry's unit cost, else the average exit price (both
    over the whole history), else 0; zero counts as missing throughout.  Cancelled notes count; nature ACERTO doesn't."""
    entry = (F.col("tipo") == "E") & F.col("valor").isNotNull() & (F.col("quantidade") > 0) & (F.col("natureza") != "ACERTO")
    exit_ = (F.col("tipo") == "S") & F.col("valor").isNotNull() & (F.col("quantidade") > 0)
    upto = W.partitionBy("produto_id").orderBy("data_mov").rangeBetween(_FIRST, 0)
    whole = upto.rangeBetween(_FIRST, W.unboundedFollowing)  # in the order of `upto`, so that one pass holds a product's rows for both
    parts = {"v": F.sum(F.when(entry, F.col("valor"))), "q": F.sum(F.when(entry, F.col("quantidade"))), "xv": F.sum(F.when(exit_, F.col("valor"))), "xq": F.sum(F.when(exit_, F.col("quantidade")))}
    unit = F.when((F.col("valor") != 0) & (F.col("quantidade") != 0), F.col("valor").cast("double") / F.col("quantidade").cast("double"))
    first = F.min(F.when((F.col("tipo") == "E") & unit.isNotNull(), F.struct(*L.ORDER, unit.alias("u"))))
    ratio = lambda v, q: v.cast("double") / F.when(q != 0, q.cast("double"))
    nz = lambda c: F.when(c != 0, c)
    chosen = lambda upto_, first_, all_: F.coalesce(nz(upto_), nz(first_["u"]), nz(all_), F.lit(0.0))

    def plain(dated: DataFrame) -> DataFrame:
        # Named first: a sum that is used twice would be carried and made twice.
        sums = dated.withColumns({"_v_": parts["v"].over(upto), "_q_": parts["q"].over(upto), "_f_": first.over(whole), "_xv_": parts["xv"].over(whole), "_xq_": parts["xq"].over(whole)})
        cost = chosen(ratio(F.col("_v_"), F.col("_q_")), F.col("_f_"), ratio(F.col("_xv_"), F.col("_xq_")))
        return sums.select(*dated.columns, cost.alias("est_custo"))

    def blocked(dated: DataFrame) -> DataFrame:
        days = dated.groupBy("produto_id", "data_mov").agg(*(c.alias(f"_{n}_") for n, c in parts.items()), first.alias("_f_"))  # a row a day
        total = lambda n, w: F.sum(f"_{n}_").over(w)
        cost = chosen(ratio(total("v", upto), total("q", upto)), F.min("_f_").over(whole), ratio(total("xv", whole), total("xq", whole)))
        return dated.join(days.select("produto_id", "data_mov", cost.alias("est_custo")), ["produto_id", "data_mov"])

    return _apart(ledger.filter("data_mov is not null"), hot, plain, blocked)


def axis(ledger: DataFrame, hot: DataFrame | None = None, size: int = scan.SIZE) -> DataFrame:
    """Valid rows of positive quantity with falta (shortage), casado (matched), lo and hi on the product's axis."""
    q = F.col("quantidade").cast("decimal(15,3)")
    return _apart(L.valid(ledger).filter(F.col("quantidade") > 0).withColumn("quantidade", q), hot, _axis, lambda rows: scan.axis(rows, L.ORDER, size))


def _axis(rows: DataFrame) -> DataFrame:
    w = L.by_product()
    upto = w.rowsBetween(_FIRST, 0)
    rows = rows.withColumn("corrente", F.sum(L.signed()).over(upto))
    rows = rows.withColumn("falta_total", -F.least(F.lit(0), F.min("corrente").over(upto)))
    rows = rows.withColumn("falta", F.col("falta_total") - F.lag("falta_total", 1, 0).over(w))
    rows = rows.withColumn("casado", F.col("quantidade") - F.when(F.col("tipo") == "S", F.col("falta")).otherwise(0))
    side = W.partitionBy("produto_id", "tipo").orderBy(*L.ORDER).rowsBetween(_FIRST, 0)
    rows = rows.withColumn("hi", F.sum("casado").over(side)).withColumn("lo", F.col("hi") - F.col("casado"))
    return rows.drop("corrente", "falta_total")


def consumption(ledger: DataFrame, hot: DataFrame | None = None, size: int = scan.SIZE, parts: int | None = None, exits: tuple[str, ...] = ()) -> DataFrame:
    """(produto_id, saida_nota, saida_linha, entrada_nota, entrada_linha, quantidade, custo_unit, saida_data, entrada_data): which
    exit took how much of which lot.  A note's line may come on several days, so the dates belong to the key.  A lot costs its
    custo_lote, where the ledger has that column and it is set, else valor / quantidade, 0 if either is missing.

    Rows that axis() has laid out already aren't laid out again.  `exits`: as in overlaps()."""
    laid = ledger if "casado" in ledger.columns else axis(L.dealt(ledger, parts, "produto_id"), hot, size)
    return overlaps(laid, hot, size, exits)


def overlaps(rows: DataFrame, hot: DataFrame | None = None, size: int = scan.SIZE, exits: tuple[str, ...] = ()) -> DataFrame:
    """consumption() from the rows of axis().

    With `exits` (names of columns; not with `hot`) exits come along, so that nothing has to be joined to them again: (produto_id,
    saida_nota, saida_linha, saida_data, lo, quantidade, custo_unit, saida).  Each exit has one row whose saida has its columns of those
    names, with the first lot that it takes, if any; in its other lots' rows saida is null."""
    unit = F.coalesce(F.when((F.col("valor") != 0) & (F.col("quantidade") != 0), F.col("valor").cast("double") / F.col("quantidade").cast("double")), F.lit(0.0))
    unit = F.coalesce("custo_lote", unit) if "custo_lote" in rows.columns else unit
    key = ("nota_id", "line_no", "data_mov")
    end = F.when(F.col("casado") > 0, F.col("hi")).alias("hi") if exits else "hi"
    entry = F.when(F.col("tipo") == "E", F.struct(*(() if exits else key), "hi", unit.alias("unit")))
    exit_ = F.when(F.col("tipo") == "S", F.struct(*key, end, *exits))

    def plain(rows: DataFrame, *own: str) -> DataFrame:
        by = W.partitionBy("produto_id").orderBy("lo", "tipo")
        at = by.rowsBetween(_FIRST, 0)
        # Rows that start at one point see each other only at the last of them.
        return rows.select("produto_id", "lo", *own, F.last(entry, True).over(at).alias("e"), F.last(exit_, True).over(at).alias("s"), F.lead("lo").over(by).alias("proximo"))

    used = F.least("e.hi", "s.hi") - F.col("lo")
    taken = F.col("e").isNotNull() & F.col("s.hi").isNotNull() & (F.col("proximo").isNull() | (F.col("proximo") > F.col("lo"))) & (used > 0)
    if exits:
        # An exit that takes nothing has no place on the axis: it comes before all that have one, and ends nowhere.
        seen = plain(rows.filter("casado > 0 or tipo = 'S'").withColumn("lo", F.when(F.col("casado") > 0, F.col("lo"))), "tipo")
        taken, own = F.coalesce(taken, F.lit(False)), F.col("tipo") == "S"
        return seen.filter(own | taken).select(
            "produto_id", F.col("s.nota_id").alias("saida_nota"), F.col("s.line_no").alias("saida_linha"), F.col("s.data_mov").alias("saida_data"), "lo",
            F.when(taken, used).alias("quantidade"), F.when(taken, F.col("e.unit")).alias("custo_unit"), F.when(own, F.struct(*(f"s.{c}" for c in exits))).alias("saida"),
        )

    rows = rows.filter("casado > 0")
    # A sweep reads its rows three times; kept, they are laid out on the axis once.
    seen = _apart(rows, hot, plain, lambda r: scan.sweep(r.select("produto_id", "lo", "tipo", entry.alias("_e_"), exit_.alias("_s_")).persist(), F.col("_e_"), F.col("_s_"), size))
    seen = seen.filter(taken)
    return seen.select(
        "produto_id", F.col("s.nota_id").alias("saida_nota"), F.col("s.line_no").alias("saida_linha"), F.col("e.nota_id").alias("entrada_nota"),
        F.col("e.line_no").alias("entrada_linha"), used.alias("quantidade"), F.col("e.unit").alias("custo_unit"),
        F.col("s.data_mov").alias("saida_data"), F.col("e.data_mov").alias("entrada_data"),
    )


def exit_costs(ledger: DataFrame, hot: DataFrame | None = None, size: int = scan.SIZE, parts: int | None = None) -> DataFrame:
    """Per exit: quantidade, falta, custo_total = lots taken at their cost + shortage at the estimated cost.

    With `hot` the ledger and its rows on the axis are kept, since blocks read them many times, and hot products go apart from the others
    for good: each step that would take both together and part them again would make and shuffle all rows for each side."""
    if hot is None:
        # Shuffled and sorted as it is; what the windows are made of, which is wider, is worked out behind that.
        rows = L.dealt(ledger, parts, "produto_id") if parts else ledger.repartition("produto_id")
        laid = axis(estimates(rows.sortWithinPartitions("produto_id", *L.ORDER)))
        # Lots and exits come from one pass by product: two would make and shuffle the ledger twice, and be joined by four keys.
        return _costs(None, consumption(laid, exits=("quantidade", "falta", "est_custo")), parts)

    def kept(which: str | None):
        def make(rows: DataFrame) -> DataFrame:
            laid = axis(estimates(L.dealt(rows, parts, "produto_id"), which), which, size)
            laid = laid.select("produto_id", *L.ORDER, "quantidade", "valor", "est_custo", "falta", "casado", "lo", "hi").persist()
            return _costs(laid, overlaps(laid, which, size), parts)

        return make

    return _apart(ledger.select("produto_id", *L.ORDER, "quantidade", "valor", "natureza", "status").persist(), hot, kept(None), kept(_ALL))


def _costs(laid: DataFrame | None, lots: DataFrame, parts: int | None) -> DataFrame:
    """exit_costs() from rows on the axis with their estimates, and from consumption(); or from consumption() with its exits alone."""
    keys = ("produto_id", "nota_id", "line_no", "data_mov")
    lots = lots.withColumnsRenamed({"saida_nota": "nota_id", "saida_linha": "line_no", "saida_data": "data_mov"})
    cost = F.sum(F.col("quantidade").cast("double") * F.col("custo_unit"))
    if laid is None:
        # Exits of one key share their lots, as in the join; one whose key isn't whole has none.
        whole = F.col("produto_id").isNotNull() & F.col("nota_id").isNotNull() & F.col("line_no").isNotNull() & F.col("data_mov").isNotNull()
        same = W.partitionBy(*keys).orderBy("lo").rowsBetween(_FIRST, W.unboundedFollowing)
        out = lots.select(*keys, "saida", F.when(whole, cost.over(same)).alias("custo_lotes")).filter("saida is not null").select(*keys, "saida.*", "custo_lotes")
    else:
        taken = L.dealt(lots.select(*keys, "quantidade", "custo_unit"), parts, *keys).groupBy(*keys).agg(cost.alias("custo_lotes"))
        exits = laid.filter("tipo = 'S'").select(*keys, "quantidade", "falta", "est_custo")
        out = L.dealt(exits, parts, *keys).join(taken, list(keys), "left")
    total = F.coalesce("custo_lotes", F.lit(0.0)) + F.col("falta").cast("double") * F.col("est_custo")
    return out.select("produto_id", "nota_id", "line_no", "data_mov", "quantidade", "falta", total.alias("custo_total"))


def open_lots(ledger: DataFrame, until: str | None = None, hot: DataFrame | None = None, size: int = scan.SIZE, parts: int | None = None) -> DataFrame:
    """Entries of which something is left: quantidade, resta, custo_unit, valor_resta.

    What exits took in all is one number a product, so what is left of a lot needs no pairing."""
    took = F.sum(F.when(F.col("tipo") == "S", F.col("casado")))
    plain = lambda rows: rows.withColumn("saiu", F.coalesce(took.over(W.partitionBy("produto_id")), F.lit(0)))
    blocked = lambda rows: rows.join(rows.groupBy("produto_id").agg(F.coalesce(took, F.lit(0)).alias("saiu")), "produto_id")
    rows = _apart(axis(L.valid(L.dealt(ledger, parts, "produto_id"), until), hot, size), hot, plain, blocked)
    left = F.least(F.col("quantidade"), F.greatest(F.col("hi") - F.col("saiu"), F.lit(0)))
    unit = F.coalesce(F.when((F.col("valor") != 0) & (F.col("quantidade") != 0), F.col("valor").cast("double") / F.col("quantidade").cast("double")), F.lit(0.0))
    rows = rows.filter("tipo = 'E'").withColumn("resta", left).filter("resta > 0")
    rows = rows.withColumn("custo_unit", unit)
    return rows.select("produto_id", "nota_id", "line_no", "data_mov", "quantidade", "resta", "custo_unit", (F.col("resta").cast("double") * F.col("custo_unit")).alias("valor_resta"))


def position(ledger: DataFrame, until: str | None = None, hot: DataFrame | None = None, size: int = scan.SIZE, parts: int | None = None) -> DataFrame:
    """(produto_id, saldo, valor, custo_medio) at a date: lots left, less shortages at their estimated cost; the average
    only where the balance is above 0.  Estimates look at the whole history beyond their first step."""
    ledger = L.dealt(ledger, parts, "produto_id")
    lots = open_lots(ledger, until, hot, size).groupBy("produto_id").agg(F.sum("valor_resta").alias("lotes"))
    short = axis(L.valid(estimates(ledger, hot), until), hot, size).filter("falta > 0").groupBy("produto_id").agg(F.sum(F.col("falta").cast("double") * F.col("est_custo")).alias("faltas"))
    out = L.balances(ledger, until=until).join(lots, "produto_id", "left").join(short, "produto_id", "left")
    value = F.coalesce("lotes", F.lit(0.0)) - F.coalesce("faltas", F.lit(0.0))
    out = out.withColumn("valor", value)
    return out.select("produto_id", "saldo", "valor", F.when(F.col("saldo") > 0, F.col("valor") / F.col("saldo").cast("double")).alias("custo_medio"))


def rollforward(ledger: DataFrame, first: str, last: str) -> DataFrame:
    """Opening, in, out and closing quantities per product over first..last, and the total (produto_id null)."""
    d, q = F.col("data_mov"), F.col("quantidade")
    a, b = F.lit(first).cast("date"), F.lit(last).cast("date")
    rows = L.valid(ledger, last).select(
        "produto_id", F.when(d < a, L.signed()).otherwise(0).alias("abertura"), F.when((d >= a) & (F.col("tipo") == "E"), q).otherwise(0).alias("entradas"),
        F.when((d >= a) & (F.col("tipo") == "S"), q).otherwise(0).alias("saidas"), F.when(d <= b, L.signed()).alias("fechamento"),
    )
    return rows.rollup("produto_id").agg(*(F.sum(c).alias(c) for c in ("abertura", "entradas", "saidas", "fechamento")))
