"""Sanitation of historical rows: anomaly rules, repeats, canonical names."""

from __future__ import annotations

import os.path
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def anomalies(rows: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """(keys, regra): one row for each rule that a row breaks, from one scan."""
    broken = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
    return rows.select(*keys, F.explode(broken).alias("regra"))


def movement_rules(today: str, first: str = "2020-11-01", day: str | None = None) -> dict[str, Column]:
    """Rules for rows with data (text), peso and valor.  `day` names a column with X.date_of(data), so that texts are parsed once."""
    d = F.col(day) if day else X.date_of(F.col("data"))
    return {
        "data ausente": d.isNull(),
        "data como texto": d.isNotNull() & ~F.trim("data").rlike(X.SERIAL),
        "data futura": d > F.lit(today).cast("date"),
        "data anterior ao inicio": d < F.lit(first).cast("date"),
        "peso zero ou ausente": F.coalesce(F.col("peso"), F.lit(0)) == 0,
        "valor zero ou ausente": F.coalesce(F.col("valor"), F.lit(0)) == 0,
    }


def reused_numbers(rows: DataFrame, number: list[str], differs: list[str], whole: list[str]) -> DataFrame:
    """Numbers that stand for more than one of `differs`, or occur more than once with all of `whole` the same."""
    out = rows.groupBy(*number).agg(F.count("*").alias("linhas"), F.count_distinct(F.struct(*differs)).alias("distintas"), F.count_distinct(F.struct(*whole)).alias("iguais"))
    kind = F.when(F.col("distintas") > 1, "reutilizado").when((F.col("linhas") > 1) & (F.col("iguais") == 1), "identico")
    return out.withColumn("tipo", kind).filter("tipo is not null").drop("iguais")


def notes_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sheet rows (keys, linha, valor, devolucao) as notes: sum, where they stand, and whether any is a return."""
    return rows.groupBy(*keys).agg(
        F.sum("valor").alias("valor"), F.count("*").alias("itens"), F.bool_or("devolucao").alias("devolucao"),
        F.array_join(F.transform(F.array_sort(F.collect_list("linha")), lambda x: x.cast("string")), ",").alias("linhas"),
    )


def repeated_items(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Items that occur more than once in a note, and whether their values differ."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("vezes"), F.count_distinct(F.struct(*values)).alias("variantes")).filter("vezes > 1")
    return out.withColumn("tipo", F.when(F.col("variantes") > 1, "difere").otherwise("identico"))


def missing(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Rows without each attribute."""
    return rows.groupBy(*keys).agg(F.count("*").alias("linhas"), *(F.count_if(F.col(c).isNull()).alias(f"sem_{c}") for c in columns))


def longest_name(rows: DataFrame, name: str) -> DataFrame:
    """Per comparison key: the most frequent spelling's longest form, all spellings, and how many rows."""
    keyed = rows.withColumn("chave", X.party_key(F.col(name))).filter("chave <> ''")
    each = keyed.groupBy("chave", F.col(name).alias("variante")).agg(F.count("*").alias("qtd"))
    best = F.max(F.struct(F.char_length(X.clean(F.col("variante"))).alias("n"), X.clean(F.col("variante")).alias("nome"))).alias("b")
    out = each.groupBy("chave").agg(best, F.array_join(F.array_sort(F.collect_set("variante")), " | ").alias("variantes"), F.sum("qtd").alias("qtd"))
    return out.select("chave", F.col("b.nome").alias("nome"), "variantes", "qtd")


#: Common start, in characters, from which two names are one.
PREFIX = 20


def grouped_names(names: DataFrame) -> DataFrame:
    """(chave, grupo, canonico): names (chave, qtd, one row a key) grouped by spelling, then groups with one leading core word
    united under the one with most rows.

    The rule: keys are taken longest first, and each joins the first group whose first key it begins, word by word, or with
    which it shares a start of PREFIX characters or more up to a space.  So keys of PREFIX characters or more are together
    exactly if they agree up to their first space from there on (or in their first PREFIX characters, if those hold no
    space); a shorter key joins the first key of all that goes on after it.  Both are grouping keys: nothing is compared pair
    by pair.  Empty and null keys are left out."""
    names = names.filter("chave <> ''")
    order = F.struct(-F.char_length("chave"), "chave")
    head, tail = F.substring("chave", 1, PREFIX), F.expr(f"substring(chave, {PREFIX + 1})")
    start = F.when(F.instr(head, " ") == 0, head).when(F.instr(tail, " ") == 0, F.col("chave")).otherwise(F.concat(head, F.substring_index(tail, " ", 1)))
    long = names.filter(F.char_length("chave") >= PREFIX).withColumn("inicio", start)
    firsts = long.groupBy("inicio").agg(F.min_by("chave", order).alias("grupo"))
    grouped = long.join(firsts, "inicio").select("chave", "grupo")
    words = F.split("chave", " ")
    begins = F.filter(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, 1, i), " ")), lambda x: F.char_length(x) < PREFIX)
    after = names.filter(F.instr("chave", " ") > 0).select("chave", F.explode(begins).alias("comeco")).groupBy("comeco").agg(F.min_by("chave", order).alias("grupo"))
    short = names.filter(F.char_length("chave") < PREFIX).join(after, F.col("chave") == F.col("comeco"), "left").select("chave", F.coalesce("grupo", "chave").alias("grupo"))
    grouped = grouped.unionByName(short)
    sized = grouped.join(names.select("chave", "qtd"), "chave").groupBy("grupo").agg(F.sum("qtd").alias("qtd"))
    core = sized.withColumn("nucleo", F.element_at(X.name_core(F.col("grupo")), 1))
    head = core.groupBy("nucleo").agg(F.max_by("grupo", F.struct("qtd", F.col("grupo"))).alias("canonico"))
    united = core.join(head, "nucleo", "left").select("grupo", F.coalesce("canonico", "grupo").alias("canonico"))  # without a core word, its own
    return grouped.join(united, "grupo").select("chave", "grupo", "canonico")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
