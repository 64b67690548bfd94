"""Exact substring deduplication with difference-cover anchors.

A set D of residues modulo v is a difference cover if every residue is a difference of two of its members.  Then for any
two places i and j there is a shift below v that brings both to a place of D.  So two equal windows of w words, wherever
they start, hold equal sub-windows of w - v + 1 words that start at such places: the anchors.  Only anchors are hashed and
counted over the corpus; windows are looked at only where one of the anchors inside them occurs in several documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW = 50
#: Difference covers by period (perfect: each difference but 0 occurs once).  Fixed values.
COVERS = {31: (0, 1, 3, 8, 12, 18), 13: (0, 1, 3, 9), 7: (0, 1, 3), 1: (0,)}
#: Words that an anchor has at least, where the window allows.
ANCHOR = 16
#: Rows up to which ids are broadcast; beyond, Spark joins them by shuffle.
BROADCAST_ROWS = 2_000_000


def cover(window: int) -> tuple[int, np.ndarray]:
    """The period to use for a window, and which residues are in its cover."""
    v = next(p for p in COVERS if p == 1 or window - p + 1 >= ANCHOR)
    return v, np.isin(np.arange(v), COVERS[v])


def _words(data: str | None) -> list[bytes]:
    return (data or "").encode("utf-8", "surrogatepass").split()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n, sha): sha256 of the words joined by spaces."""
    for b in C.slices(batches):
        n, sha = [], []
        for t in b.column("text").to_pylist():  # one text's words at a time
            w = _words(t)
            n.append(len(w)), sha.append(hashlib.sha256(b" ".join(w)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n", "sha"])


def _anchors(window: int):
    v, inside = cover(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            out, ids, at = [], [], []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                w = C.word_hashes((text or "").encode("utf-8", "surrogatepass"))
                if len(w) >= window:
                    h = C.Rolling(w).windows(window - v + 1)
                    p = np.flatnonzero(inside[np.arange(len(h)) % v])
                    out.append(h[p].view(np.int64)), ids.append(np.full(len(p), i)), at.append(p.astype(np.int32))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out, ids, at)], ["anchor", "doc_id", "pos"])

    return run


def _windows(window: int):
    """(doc_id, text, at: places of shared anchors) to the windows that hold one: each anchor extended both ways as far as a
    window reaches.  A window stands for its words by 128 bits of a cryptographic hash of them, so that no text can be made to
    look like another's."""
    v, _ = cover(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            for i, text, at in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "at")), strict=True):
                w = _words(text)
                if len(w) < window:
                    continue
                k = len(w) - (window - v + 1) + 1
                at = np.asarray(at)
                hit = np.bincount(at[at < k], minlength=k)
                sums = np.concatenate(([0], np.cumsum(hit)))
                start = np.flatnonzero(sums[v : k + 1] > sums[: k + 1 - v])  # the anchors of window s are at s to s + v - 1
                joined = b" ".join(w)
                key = int.from_bytes(hashlib.sha256(joined).digest()[:8], "big", signed=True)
                ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
                begins, ends = np.append(0, ends)[start].tolist(), (ends[start + window - 1] - 1).tolist()
                whole = memoryview(joined)
                digest = b"".join([hashlib.blake2b(whole[x:y], digest_size=16).digest() for x, y in zip(begins, ends, strict=True)])
                both = np.frombuffer(digest, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (both[:, 0], both[:, 1], np.full(len(start), i), np.full(len(start), key), start.astype(np.int32))],
                    ["h1", "h2", "doc_id", "key", "start"],
                )

    return run


def _rest(window: int):
    """(doc_id, key, text, starts) to (doc_id, sha, n_removed, kept_sha256); rows whose text isn't key's are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            rows = []
            for i, key, text, starts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key", "text", "starts")), strict=True):
                w = _words(text)
                sha = hashlib.sha256(b" ".join(w))
                if int.from_bytes(sha.digest()[:8], "big", signed=True) == key:
                    edge = np.zeros(len(w) + 1, int)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, np.asarray(starts) + window, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    kept = b" ".join(x for x, g in zip(w, gone.tolist(), strict=True) if not g)
                    rows.append((i, sha.hexdigest(), int(gone.sum()), kept.decode("utf-8", "surrogatepass")))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], ["doc_id", "sha", "removed", "kept"])

    return run


def dedup(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(rows, kept): rows has (doc_id, n_words, sha, n_removed, kept_sha256) per row of docs; kept has (doc_id, sha, removed,
    kept), the remaining words joined by spaces, of the texts that lose a part (not the whole) of their words.

    A word goes if a window of `window` words that covers it also starts in a document with a smaller id, judged on the
    input.  Null text has no words; a null id neither loses words nor takes them from others; rows with one id are judged
    each by its text; an empty table gives an empty result."""
    docs = docs.select("doc_id", "text")
    whole = C.cut(docs.mapInArrow(_whole, "doc_id long, n long, sha string"))
    usable = whole.filter(f"n >= {window} and doc_id is not null")
    least = C.cut(usable.groupBy("sha").agg(F.min("doc_id").alias("least")))
    copies = C.cut(usable.join(least, "sha").filter("doc_id <> least").select("doc_id").distinct())
    # Whole copies of a smaller id's text lose everything and bring no window that the smallest doesn't have.  (An id that
    # is a copy in one row may have another text in the next, so it is left out only if all its texts are copies.)
    alone = C.cut(usable.join(least, "sha").filter("doc_id = least").select("doc_id").distinct())
    copies = C.cut(copies.join(alone, "doc_id", "left_anti"))
    reps = docs.filter("doc_id is not null and text is not null").join(C.small(copies, copies.count(), BROADCAST_ROWS), "doc_id", "left_anti")

    anchors = C.cut(reps.mapInArrow(_anchors(window), "anchor long, doc_id long, pos int"))
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a <> b").select("anchor")
    places = C.cut(anchors.join(shared, "anchor").groupBy("doc_id").agg(F.collect_list("pos").alias("at")))
    ids = C.small(places.select("doc_id"), places.count(), BROADCAST_ROWS)
    seen = reps.join(ids, "doc_id", "left_semi").join(places, "doc_id").select("doc_id", "text", "at")
    windows = C.cut(seen.mapInArrow(_windows(window), "h1 long, h2 long, doc_id long, key long, start int"))
    # Written, so that the join has two plain sides and Spark can split a window that very many documents share.
    first = C.cut(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most"))
    gone = windows.join(first, ["h1", "h2"]).filter("doc_id > least")
    gone = C.cut(gone.groupBy("doc_id", "key").agg(F.collect_set("start").alias("starts")))
    ids = C.small(gone.select("doc_id").distinct(), gone.count(), BROADCAST_ROWS)
    parts = docs.join(ids, "doc_id", "left_semi").join(gone, "doc_id").select("doc_id", "key", "text", "starts")
    kept = C.cut(parts.mapInArrow(_rest(window), "doc_id long, sha string, removed long, kept string").dropDuplicates(["doc_id", "sha"]))

    short = kept.select("doc_id", "sha", "removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha"))
    out = whole.join(least, "sha", "left").join(short, ["doc_id", "sha"], "left")
    copy = F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False))
    return out.select(
        "doc_id", F.col("n").alias("n_words"), "sha", F.when(copy, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    ), kept


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = dedup(spark, C.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
first AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (k) WHERE doc_id > least),
each AS (SELECT doc_id, p, x FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w) e),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
