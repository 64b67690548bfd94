"""Language of a text as a mixture: n-gram likelihoods, EM for the proportions, a penalised choice of the set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Buckets of hashed byte 3-grams (a language's model has so many numbers, 128 KB, whatever the corpus), languages in a block
#: of the model, rounds of EM, smoothing of counts, grams that the likelihood counts as one observation (neighbouring grams
#: overlap).
BUCKETS, LANGUAGES, ROUNDS, SMOOTH, OVERLAP = 1 << 15, 256, 12, 0.5, 8.0
UND = "und"


def grams(data: bytes) -> np.ndarray:
    """Bucket of every 3-gram of the lower-cased text; digits and ASCII marks count as spaces, runs of spaces as one."""
    out = []
    for piece in C.pieces(data):
        b = _FOLD[np.frombuffer(b" " + piece + b" ", np.uint8)]
        b = b[(b != 32) | np.concatenate(([True], b[:-1] != 32))].astype(np.uint32)
        if len(b) >= 3:
            x = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77)) + b[2:] * np.uint32(0xC2B2AE3D)
            out.append((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _c in range(97, 123):
    _FOLD[_c] = _FOLD[_c - 32] = _c


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, bucket, n), at most BUCKETS rows a language and task."""
    sums: dict[str, np.ndarray] = {}
    for b in C.slices(batches):
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            g = grams(text.encode("utf-8", "surrogatepass"))
            if len(g):
                sums[lang] = sums.get(lang, 0) + np.bincount(g, minlength=BUCKETS)
    for lang, s in sums.items():
        at = np.flatnonzero(s)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int64()), pa.array(s[at].astype(np.int64))], ["lang", "bucket", "n"])


def fit(docs: DataFrame) -> tuple[list[str], list[np.ndarray]]:
    """Languages, all there are, and the logarithm of each bucket's chance as blocks (LANGUAGES at most, BUCKETS), from every
    row with a text and a lang."""
    rows = docs.filter("text is not null and lang is not null").select("lang", "text").mapInArrow(_count, "lang string, bucket long, n long")
    rows = C.cut(rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    langs = [r["lang"] for r in rows.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").collect()]
    blocks = []
    for i in range(0, len(langs), LANGUAGES):
        table = np.full((len(langs[i : i + LANGUAGES]), BUCKETS), SMOOTH)
        for j, lang in enumerate(langs[i : i + LANGUAGES]):  # one language at a time: BUCKETS rows
            part = rows.filter(F.col("lang") == lang).select("bucket", "n").toPandas()
            table[j, part["bucket"].to_numpy(int)] += part["n"].to_numpy()
        blocks.append(np.log(table / table.sum(1, keepdims=True)).astype(np.float32))
    return langs, blocks


def mixture(g: np.ndarray, model: list[np.ndarray], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the languages in a text of these grams, and the set that the penalised likelihood selects.

    EM over all languages gives an order; sets are the first 1, 2, ... of it, as long as another language raises the
    log-likelihood (per OVERLAP grams) by more than half the logarithm of their number."""
    bucket, n = np.unique(g, return_counts=True)
    like = np.concatenate([block[:, bucket] for block in model])
    like = np.exp(like - like.max(0))
    n = (n / OVERLAP).astype(np.float32)

    words = n.sum()

    def em(rows: np.ndarray) -> tuple[np.ndarray, float]:
        p, some = np.full(len(rows), 1 / len(rows)), like[rows]
        for _ in range(rounds if len(rows) > 1 else 0):
            p = p * (some @ (n / np.maximum(p @ some, 1e-30))) / words
        return p, float(n @ np.log(np.maximum(p @ some, 1e-30)))

    p, _ = em(np.arange(len(like)))
    order = np.argsort(-p, kind="stable")
    best, (share, total) = order[:1], em(order[:1])
    for k in range(2, len(order) + 1):
        share_k, total_k = em(order[:k])
        if total_k - total <= 0.5 * np.log(max(2.0, words)):
            break
        best, share, total = order[:k], share_k, total_k
    out = np.zeros(len(like))
    out[best] = share
    return out, best


def _score(langs: list[str], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = [block.value for block in shared]
        for b in C.slices(batches):
            pred, score, parts = [], [], []
            for text, letter in zip(b.column("text").to_pylist(), b.column("letter").to_pylist(), strict=True):
                g = grams(text.encode("utf-8", "surrogatepass")) if letter and langs else ()
                if not letter or not langs:
                    pred.append(UND), score.append(0.0), parts.append([])
                    continue
                p, chosen = mixture(g, model) if len(g) else (np.full(len(langs), 1 / len(langs)), [0])
                top = int(np.argmax(p))
                pred.append(langs[top]), score.append(float(min(1.0, p[top])))
                parts.append([{"lang": langs[i], "share": float(p[i])} for i in chosen])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred), pa.array(score, pa.float64()), pa.array(parts, kind)], ["doc_id", "lang_pred", "score", "languages"])

    return run


def identify(spark: SparkSession, docs: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score (its share of the text, 0 to 1), languages (the selected set with shares), a row per row.

    lang_pred is a language of `training` (lang, text), or `und` (score 0) for null and for texts without a letter, or if
    there is nothing to learn from.  Ties go to the language with more training text, then by name.  Equal texts get equal
    results; an empty table gives an empty result; other columns count for nothing."""
    langs, model = fit(training)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    rows = docs.select("doc_id", "text", letter)
    return rows.mapInArrow(_score(langs, [spark.sparkContext.broadcast(block) for block in model]), "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    training = docs.filter(C.crc_mod(F.col("doc_id"), 4) != 2)
    out = identify(spark, docs.select("doc_id", "text"), training)
    return out.select("doc_id", (C.crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
