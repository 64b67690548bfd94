"""Best-fit packing into sequences of several permitted lengths."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LENGTHS = (256, 512, 1024, 2048)
#: Cost of a sequence besides its length (its share of a batch's fixed work), in words.
OVERHEAD = 16
#: Pieces that one task packs together.  Shards are independent; beyond some thousand pieces a larger shard packs no better.
SHARD = 8192
#: Copies of one row that one task makes.
COPIES = 100_000
SCHEMA = "doc_id long, copy int, piece int, start_word long, n_words long, bin_id long, bin_length int, bin_used int, bin_start int"


def best_fit(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and each bin's length.  sizes must fall and fit the longest length.

    A piece goes to the open bin with the least room that holds it.  If none does, a bin of the length is opened that
    costs least per word once the largest remaining pieces that fit have filled it.  At the end each bin shrinks to the
    shortest permitted length that holds its contents."""
    lengths = sorted(lengths)
    top = lengths[-1]
    left = np.bincount(np.asarray(sizes, int), minlength=top + 1).tolist()
    waiting = sum(1 << s for s in range(1, top + 1) if left[s])  # bit s: a piece of size s is still to come
    rooms: list[list[int]] = [[] for _ in range(top + 1)]
    open_ = 0  # bit r: some bin has room r
    used: list[int] = []
    where, offset = [], []

    def shortest(n: int) -> int:
        return next(x for x in lengths if x >= n)

    def cost(size: int, length: int) -> float:
        room, fill, most = length - size, size, length - size  # most: larger sizes have been looked at
        while most and (fits := waiting & ((1 << (most + 1)) - 1)):
            s = fits.bit_length() - 1
            k = min(left[s], room // s)
            fill += k * s
            room -= k * s
            most = min(room, s - 1)
        return (shortest(fill) + overhead) / fill

    for size in sizes:
        left[size] -= 1
        if not left[size]:
            waiting &= ~(1 << size)
        if fits := open_ >> size:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_ &= ~(1 << room)
        else:
            b, room = len(used), min((x for x in lengths if x >= size), key=lambda x: (cost(size, x), x))
            used.append(0)
        where.append(b)
        offset.append(used[b])
        used[b] += size
        if room := room - size:
            rooms[room].append(b)
            open_ |= 1 << room
    return where, offset, [shortest(u) for u in used]


def pack(spark: SparkSession, docs: DataFrame, lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD, shard: int = SHARD, size=None) -> DataFrame:
    """One row per piece of a document, with its bin and place: SCHEMA.

    A text longer than the longest length is split at multiples of it; nothing is dropped.  Texts without words keep one
    row without a bin.  Repeated rows are told apart by `copy`.  bin_id is unique over all shards; an empty table gives an
    empty result."""
    top = max(lengths)
    count = C.n_words(F.col("text")) if size is None else size
    # Equal rows are counted first and numbered after, so that a hot one is dealt out over all shards.
    sized = C.cut(docs.select("doc_id", count.alias("size")).groupBy("doc_id", "size").agg(F.count("*").alias("k")))
    whole = sized.select(F.sum(F.col("k") * F.ceil(F.col("size") / top)).alias("n"), F.max("k").alias("most")).first()
    n, most = whole["n"] or 0, whole["most"] or 0
    shards = max(1, -(-int(n) // shard))
    runs = sized.select("doc_id", "size", "k", F.explode(F.sequence(F.lit(1), F.col("k"), F.lit(COPIES).cast("long"))).alias("from"))
    runs = runs.repartition("doc_id", "size", "from") if most > COPIES else runs  # a hot row's copies are made by many tasks
    each = runs.select("doc_id", "size", F.explode(F.sequence("from", F.least(F.col("k"), F.col("from") + COPIES - 1))).alias("copy")).withColumn("copy", F.col("copy").cast("int"))
    empty = each.filter("size = 0").select(
        "doc_id", "copy", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start_word"), F.lit(0).cast("long").alias("n_words"),
        F.lit(None).cast("long").alias("bin_id"), *(F.lit(None).cast("int").alias(c) for c in ("bin_length", "bin_used", "bin_start")),
    )
    cut_at = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / top) - 1).cast("int")))
    parts = each.filter("size > 0").select("doc_id", "copy", "size", cut_at.alias("piece"))
    parts = parts.select(
        "doc_id", "copy", "piece", (F.col("piece").cast("long") * top).alias("start_word"),
        F.least(F.lit(top), F.col("size") - F.col("piece").cast("long") * top).alias("n_words"),
        F.pmod(F.xxhash64("doc_id", "size", "copy", "piece"), F.lit(shards)).alias("shard"),
    )

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_words", "doc_id", "copy", "piece"], ascending=[False, True, True, True], na_position="last")
        where, offset, length = best_fit(pdf["n_words"].tolist(), lengths, overhead)
        where = np.asarray(where)
        used = np.bincount(where, weights=pdf["n_words"].to_numpy()).astype(int)
        return pd.DataFrame({
            "doc_id": pdf["doc_id"], "copy": pdf["copy"], "piece": pdf["piece"], "start_word": pdf["start_word"], "n_words": pdf["n_words"],
            "bin_id": int(key[0]) * (1 << 32) + where, "bin_length": np.asarray(length)[where], "bin_used": used[where], "bin_start": offset,
        })

    return parts.groupBy("shard").applyInPandas(run, SCHEMA).unionByName(empty)


def assemble(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """bin_id, bin_length and the packed words in order; docs must have unique ids.  A bin's rows are bounded by its length."""
    parts = placed.filter("bin_id is not null").join(docs.select("doc_id", C.words(F.col("text")).alias("w")), "doc_id")
    part = F.slice("w", (F.col("start_word") + 1).cast("int"), F.col("n_words").cast("int"))
    rows = parts.groupBy("bin_id", "bin_length").agg(F.array_sort(F.collect_list(F.struct("bin_start", part.alias("w")))).alias("p"))
    return rows.select("bin_id", "bin_length", F.flatten(F.transform("p", lambda x: x["w"])).alias("words"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, C.table(spark, sf_dir, "documents"))
