"""Two books of one month, note by note and code by code.  Amounts are cents, so equality needs no tolerance.

Book lines: numero, seq (order in the book), cfop, cents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scan

#: Lines in a subset.
SUBSET = 6
#: Sums of a long note's lines that are in memory at a time (12 bytes each, and as much again to sort them).
HELD = 4_000_000
#: Lines of a note up to which all its subsets are tried, together with those of notes of its length; sums made at a time for that.
AT_ONCE, TRIED = 16, 200_000
PAIR = "array<struct<classe:string,seq_a:int,seq_b:int,difere:boolean>>"


def by_number(book: DataFrame, name: str, total: str | None = None) -> DataFrame:
    """One row a note: its lines in order, and their sum as `total`, null if an amount is.  A note has few lines."""
    lines = F.sort_array(F.collect_list(F.struct("seq", "cfop", "cents"))).alias(name)
    return book.groupBy("numero").agg(lines, *([F.when(F.count("cents") == F.count("*"), F.sum("cents")).alias(total)] if total else []))


class _Choices:
    """Sums of all choices of 1, 2 or 3 of some values, in the order of their positions, those that begin at one position at a
    time: choices of two are one array, in which all that begin behind a position stand together."""

    def __init__(self, values: list[int]):
        self.v = np.array(values, np.int64)
        n = len(self.v)
        self.size = n
        count = np.arange(n - 1, -1, -1)  # pairs that begin at each position
        self.at = np.append(0, np.cumsum(count))
        self.second = np.concatenate([np.zeros(0, np.int32), *(np.arange(i + 1, n, dtype=np.int32) for i in range(n))])
        self.pairs = np.repeat(self.v, count) + self.v[self.second]

    def number(self, k: int) -> int:
        return comb(self.size, k)

    def begin(self, k: int, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(sums, last positions) of the choices of k whose first position is i."""
        if k == 1:
            return self.v[i : i + 1], np.array([i], np.int32)
        if k == 2:
            return self.pairs[self.at[i] : self.at[i + 1]], self.second[self.at[i] : self.at[i + 1]]
        return self.v[i] + self.pairs[self.at[i + 1] :], self.second[self.at[i + 1] :]

    def positions(self, k: int, i: int, place: int) -> list[int]:
        """Of the choice at a place among those that begin at i."""
        if k < 3:
            return [i, int(self.begin(k, i)[1][place])][:k]
        place += int(self.at[i + 1])
        return [i, int(np.searchsorted(self.at, place, "right")) - 1, int(self.second[place])]

    def first(self, k: int, target: int, behind: int) -> list[int] | None:
        """The first choice of k, all behind a position, that makes the target."""
        for i in range(behind + 1, self.size - k + 1):
            hit = np.flatnonzero(self.begin(k, i)[0] == target)
            if len(hit):
                return self.positions(k, i, int(hit[0]))
        return None


def first_subset(v: list[int], target: int, held: int = HELD) -> list[int] | None:
    """Positions of the smallest subset of at most SUBSET values that makes the target, the first by position.

    Halves meet: the sums of the last positions are looked up for each choice of the first ones, so it takes the square root of the
    tries that whole subsets would.  Of the sums about `held` are in memory at a time: they are dealt to parts by a hash, and a
    part's sums can only meet that part."""
    c = _Choices(v)
    for n in range(1, min(len(v), SUBSET) + 1):
        head, tail = n // 2, n - n // 2
        if not head:
            found = c.first(tail, target, -1)
            if found:
                return found
            continue
        parts = -(-c.number(tail) // held)
        part = lambda s, parts=parts: (s.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(parts)
        best: tuple[int, int] | None = None
        for p in range(parts):
            sums, begins = [], []
            for i in range(head, c.size - tail + 1):
                s = c.begin(tail, i)[0]
                s = s[part(s) == p] if parts > 1 else s
                sums.append(s), begins.append(np.full(len(s), i, np.int32))
            sums, begins = np.concatenate([np.zeros(0, np.int64), *sums]), np.concatenate([np.zeros(0, np.int32), *begins])
            order = np.argsort(sums, kind="stable")
            sums, begins = sums[order], begins[order]
            final = np.append(sums[1:] != sums[:-1], True)[: len(sums)]  # of equal sums the one that begins last
            sums, begins = sums[final], begins[final]
            for i in range(c.size - n + 1 if best is None else best[0] + 1):
                if not len(sums):
                    break
                s, last = c.begin(head, i)
                rest = target - s
                at = np.minimum(np.searchsorted(sums, rest), len(sums) - 1)
                hit = np.flatnonzero((sums[at] == rest) & (begins[at] > last))
                if len(hit):
                    best = min(best or (i, int(hit[0])), (i, int(hit[0])))
                    break
        if best:
            first = c.positions(head, *best)
            return [*first, *c.first(tail, target - sum(v[i] for i in first), first[-1])]
    return None


def _grown(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Choices of k of n positions in their order: of each, the place of its first k - 1 among the choices of k - 1, and its last."""
    last = np.array([c[-1] for c in combinations(range(n), k - 1)]) if k > 1 else np.array([-1])
    more = n - 1 - last
    begin = np.repeat(np.cumsum(more) - more, more)
    return np.repeat(np.arange(len(last)), more), np.repeat(last, more) + 1 + np.arange(len(begin)) - begin


def first_subsets(values: np.ndarray, targets: np.ndarray) -> list[list[int] | None]:
    """first_subset() for notes of equally many lines (values: a row a note): all choices of a size are tried for all notes at once, and a
    note that has found its own leaves before those of the next size."""
    notes, n = values.shape
    found: list[list[int] | None] = [None] * notes
    left, sums = np.arange(notes), np.zeros((notes, 1), np.int64)
    for k in range(1, min(n, SUBSET) + 1):
        ahead, last = _grown(n, k)
        sums = sums[:, ahead] + values[left][:, last]
        hits = sums == targets[left, None]
        hit = hits.any(1)
        if hit.any():
            choices = list(combinations(range(n), k))
            for note, at in zip(left[hit], hits[hit].argmax(1), strict=True):
                found[note] = list(choices[at])
            left, sums = left[~hit], sums[~hit]
        if not len(left):
            break
    return found


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _search(cents: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The first smallest subset that makes the target, by position; null for notes without values."""
    for values, target in cents:
        found = np.full(len(values), None, object)
        asked = np.flatnonzero(values.notna())
        lines, goal = [values.iloc[i] for i in asked], target.iloc[asked].to_numpy(np.int64)
        size = np.array([len(v) for v in lines], int)
        for n in np.unique(size):
            of = np.flatnonzero(size == n)
            if n > AT_ONCE:
                for i in of:
                    found[asked[i]] = first_subset(lines[i].tolist(), int(goal[i]))
                continue
            step = max(1, TRIED // max(comb(n, k) for k in range(min(n, SUBSET) + 1)))
            for part in (of[i : i + step] for i in range(0, len(of), step)):
                for i, v in zip(part, first_subsets(np.stack([lines[i] for i in part]).astype(np.int64), goal[part]), strict=True):
                    found[asked[i]] = v
        yield pd.Series(found, dtype=object)


def pair_notes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(numero, classe, seq_a, seq_b, difere): casada, so_a, so_b or revisar.

    A number in one book only: its lines stand alone.  Equal sums: lines pair by falling amount if there are as many, else
    the first of each.  Else the smallest subset of the larger side, first by position, that makes the smaller side's sum
    pairs by its first line, and the rest of that side stands alone; without one the note needs a look (revisar)."""
    # Lambdas are interpreted, row by row: what an aggregate, a field of an array or sort_array can say isn't left to them.
    rows = by_number(a, "la", "sa").join(by_number(b, "lb", "sb"), "numero", "full")
    rows = rows.withColumn("maior", F.expr("if(sa > sb, la, lb)")).withColumn("alvo", F.least("sa", "sb"))
    open_ = "la is not null and lb is not null and sa <> sb"
    # All notes pass the search, most without values: a branch of their own would make both books again.
    rows = rows.withColumn("valores", F.expr(f"if({open_}, maior.cents, null)")).withColumn("idx", _search("valores", "alvo"))
    alone = "transform({0}, x -> named_struct('classe', 'so_{1}', 'seq_a', {2}, 'seq_b', {3}, 'difere', false))"
    so_a, so_b = alone.format("la", "a", "x.seq", "null"), alone.format("lb", "b", "null", "x.seq")
    sort = "sort_array(transform({}, x -> named_struct('v', -x.cents, 'seq', x.seq, 'cfop', x.cfop)))"
    zipped = f"zip_with({sort.format('la')}, {sort.format('lb')}, (p, q) -> named_struct('classe', 'casada', 'seq_a', p.seq, 'seq_b', q.seq, 'difere', p.cfop <> q.cfop))"
    one = "array(named_struct('classe', 'casada', 'seq_a', {0}.seq, 'seq_b', {1}.seq, 'difere', {0}.cfop <> {1}.cfop))"
    rest = "transform(filter(maior, (x, i) -> not array_contains(idx, i)), x -> named_struct('classe', if(sa > sb, 'so_a', 'so_b'), 'seq_a', if(sa > sb, x.seq, null), 'seq_b', if(sa > sb, null, x.seq), 'difere', false))"
    found = f"concat(if(sa > sb, {one.format('la[idx[0]]', 'lb[0]')}, {one.format('la[0]', 'lb[idx[0]]')}), {rest})"
    look = "array(named_struct('classe', 'revisar', 'seq_a', null, 'seq_b', null, 'difere', false))"
    cases = [("lb is null", so_a), ("la is null", so_b), ("sa = sb and size(la) = size(lb)", zipped), ("sa = sb", one.format("la[0]", "lb[0]")), ("idx is null", look)]
    made = "case " + " ".join(f"when {c} then cast({x} as {PAIR})" for c, x in cases) + f" else cast({found} as {PAIR}) end"
    return rows.select("numero", F.explode(F.expr(made)).alias("p")).select("numero", "p.*")


def compare_codes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Balances (cfop, valor, base, imposto) of both sides by code, their differences and what they amount to."""
    cols = ("valor", "base", "imposto")
    x = a.select("cfop", *(F.col(c).alias(f"a_{c}") for c in cols), F.lit(True).alias("em_a"))
    y = b.select("cfop", *(F.col(c).alias(f"b_{c}") for c in cols), F.lit(True).alias("em_b"))
    out = x.join(y, "cfop", "full")
    for c in cols:
        out = out.withColumn(f"a_{c}", F.coalesce(f"a_{c}", F.lit(0))).withColumn(f"b_{c}", F.coalesce(f"b_{c}", F.lit(0))).withColumn(f"dif_{c}", F.col(f"a_{c}") - F.col(f"b_{c}"))
    state = F.when(F.col("em_b").isNull(), "ausente em b").when(F.col("em_a").isNull(), "ausente em a").when((F.abs("dif_valor") < 0.01) & (F.abs("dif_imposto") < 0.01), "ok").otherwise("divergente")
    return out.withColumn("situacao", state).drop("em_a", "em_b")


def missing_by_code(pairs: DataFrame, book: DataFrame) -> DataFrame:
    """Lines of book a that pair with nothing, by code: count and value."""
    alone = pairs.filter("classe = 'so_a'").groupBy("numero").agg(F.collect_list("seq_a").alias("sos"))  # by number, as the book lies already
    return book.join(alone, "numero").filter(F.array_contains("sos", F.col("seq"))).groupBy("cfop").agg(F.count("*").alias("qtd"), F.sum("cents").alias("cents"))


def enrich(notes: DataFrame, book: DataFrame) -> DataFrame:
    """notes (numero, cents) with the book's codes: lines of exactly that value if any (EXATA), else the number's only line
    (NUMERO) or all of them (AMBIGUA); NAO ENCONTRADA without one."""
    out = notes.join(by_number(book, "cand"), "numero", "left")
    out = out.withColumn("exatos", F.expr("filter(cand, x -> x.cents = cents)"))
    out = out.withColumn("alvo", F.expr("if(size(exatos) > 0, exatos, cand)"))
    source = F.when(F.col("cand").isNull(), "NAO ENCONTRADA").when(F.size("exatos") > 0, "EXATA").when(F.size("cand") == 1, "NUMERO").otherwise("AMBIGUA")
    codes = F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform("alvo", lambda x: x["cfop"]))), "/"), F.lit(""))
    total = F.coalesce(F.expr("aggregate(alvo, 0L, (s, x) -> s + x.cents)"), F.lit(0))
    return out.select(*notes.columns, codes.alias("cfop"), total.alias("cents_livro"), source.alias("origem"))


def creditors_by_code(enriched: DataFrame, book: DataFrame) -> DataFrame:
    """Sheet totals against book totals by code.  A note with several codes counts under each; one without, under ''."""
    sheet = enriched.select(F.explode(F.split("cfop", "/")).alias("cfop"), "cents").groupBy("cfop").agg(F.sum("cents").alias("planilha"), F.count("*").alias("notas"))
    books = book.groupBy("cfop").agg(F.sum("cents").alias("livro"))
    out = sheet.join(books, "cfop", "full")
    return out.select("cfop", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("planilha", "livro", "notas"))).withColumn("diferenca", F.col("planilha") - F.col("livro"))


def cross_check(stock: DataFrame, assessed: DataFrame) -> DataFrame:
    """Notes (numero, valor) of both sides with a diagnosis."""
    out = stock.select("numero", F.col("valor").alias("valor_estoque")).join(assessed.select("numero", F.col("valor").alias("valor_apuracao")), "numero", "full")
    gap = F.abs(F.col("valor_estoque") - F.col("valor_apuracao"))
    why = F.when(F.col("valor_apuracao").isNull(), "ausente da apuracao").when(F.col("valor_estoque").isNull(), "ausente do estoque").when(gap > 0.01, "valor difere").otherwise("ok")
    return out.withColumn("diagnostico", why)


def numbered(rows: DataFrame, order: list, prefix: str = "D", digits: int = 4, size: int = 1 << 16) -> DataFrame:
    """rows with id: prefix and their place in `order`, which must be total.

    Rows are cut into ranges of their order (scan.split), counted per range, and numbered within each, so that no task sees them all.
    Borders depend on the rows alone: where Spark deals rows by range, it may deal those that it counts unlike those that it numbers."""
    names = [f"_o{k}_" for k in range(len(order))]
    rows = rows.persist()  # read for the borders, for the sizes and to be numbered
    dealt = rows.withColumns(dict(zip(names, (c if isinstance(c, Column) else F.col(c) for c in order), strict=True))).withColumn("_all_", F.lit(0))
    dealt = scan.split(dealt, tuple(names), size, "_all_")
    sizes = dealt.groupBy(scan.BLOCK).agg(F.count("*").alias("k"))  # one row in `size`
    sizes = sizes.select(scan.BLOCK, (F.sum("k").over(W.orderBy(scan.BLOCK)) - F.col("k")).alias("_before_"))
    dealt = dealt.withColumn("_at_", F.row_number().over(W.partitionBy(scan.BLOCK).orderBy(*names)))
    place = (F.col("_before_") + F.col("_at_")).cast("string")
    out = dealt.join(F.broadcast(sizes), scan.BLOCK).withColumn("id", F.concat(F.lit(prefix), F.when(F.length(place) < digits, F.lpad(place, digits, "0")).otherwise(place)))
    return out.select(*rows.columns, "id")


def findings(pairs: DataFrame, missing: DataFrame) -> DataFrame:
    """(severidade, tipo, chave, detalhe): code conflicts, notes to look at, missing notes by code."""
    code = pairs.filter("difere").select(F.lit("alto").alias("severidade"), F.lit("cfop_nota").alias("tipo"), F.concat_ws("/", F.col("numero").cast("string"), F.col("seq_a").cast("string")).alias("chave"), F.lit("codigos diferentes").alias("detalhe"))
    look = pairs.filter("classe = 'revisar'").select(F.lit("revisar").alias("severidade"), F.lit("pareamento_manual").alias("tipo"), F.col("numero").cast("string").alias("chave"), F.lit("somas sem subconjunto").alias("detalhe"))
    gone = missing.select(F.lit("medio").alias("severidade"), F.lit("nota_ausente").alias("tipo"), F.col("cfop").alias("chave"), F.format_string("%d notas", "qtd").alias("detalhe"))
    return code.unionByName(look).unionByName(gone)


def justify(found: DataFrame, key: str, status: str, user: str, text: str) -> DataFrame:
    """findings with one justified: its state, who and when; reopening clears the time."""
    here = F.col("chave") == key
    out = found
    for c, v in (("status", F.lit(status)), ("usuario", F.lit(user)), ("justificativa", F.lit(text)), ("em", F.when(F.lit(status != "aberta"), F.current_timestamp()))):
        old = F.col(c) if c in found.columns else F.lit(None)
        out = out.withColumn(c, F.when(here, v).otherwise(old))
    return out
