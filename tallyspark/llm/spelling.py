"""Spelling variants: words that differ by one letter, found by hashed deletions.

Two words differ by a replaced letter if deleting the letter at one place of both leaves the same; by an inserted one if a
deletion from the longer leaves the shorter.  Each deletion gets an integer key from hashes of the word's beginning and end
around it, without making the string.  Spark shuffles and sorts the integers; where keys meet, the strings are compared.

What meets in a key is bounded by the alphabet: words that differ at one place from each other, or a word and those that one
letter makes longer.  No pair is written: of a group each word needs how many others there are and the best of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

LETTERS = "A-Za-zÀ-ÿ"
#: Code points that a word has at least, its least occurrences, and how many times as often its form occurs at least.
LEAST, OFTEN, RATIO = 7, 2, 10
#: Primes and bases of the two hashes that make a key.
_PRIMES, _BASES = (2_147_483_647, 2_147_483_629), (1_103_515_249, 1_481_765_933)
#: Different words that a task sums before it passes them on, and code points whose keys it makes at a time.
_COUNTED, _PIECE = 300_000, 1 << 19


def _count(least: int, spoil: int | None):
    run_of = re.compile(f"[{LETTERS}]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, text) to (word, n), summed as far as memory allows."""
        sums: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])

        for b in C.slices(batches):
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = Counter(run_of.findall(C.ascii_lower((t or "").encode("utf-8", "surrogatepass")).decode("utf-8", "surrogatepass")))
                if not spoil:
                    sums.update(found)
                else:
                    seed = zlib.crc32(f"{i}:".encode())
                    for w, n in found.items():
                        h = zlib.crc32(w.encode(), seed)
                        if h % spoil == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                        if len(w) >= least:
                            sums[w] += n
                if len(sums) >= _COUNTED:
                    yield rows()
                    sums.clear()
        if sums:
            yield rows()

    return run


def counted(docs: DataFrame, least: int = LEAST, spoil: int | None = None) -> DataFrame:
    """(word, n): the runs of letters of at least `least` code points in the texts of docs (doc_id, text), A-Z in lower case, and how often
    each occurs.  With `spoil`, the crc32 of `<doc_id>:<run>` decides: where spoil divides it, the code point at its remainder
    by the run's length is deleted from that run in that document.

    A null text has no words, a null id counts as empty, repeated rows count each, other columns go, an empty table has no
    words."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    return docs.mapInArrow(_count(least, spoil), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """The first n powers of base modulo prime."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)))
    return out[:n]


def keys_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, word's number, place) of each word: of the whole word, place -1; of each deletion, once for what it leaves (even keys, as the whole
    words'; of equal neighbours the last is deleted), and once for what it leaves and where (odd keys)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    stop = np.cumsum(size)
    start = stop - size
    row = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(letters)) - start[row]
    whole, left = [], []
    for base, prime in zip(_BASES, _PRIMES, strict=True):
        p, back = np.uint64(prime), np.uint64(pow(base, -1, prime))
        terms = (letters + np.uint64(1)) * _powers(base, prime, int(size.max(initial=0)))[at] % p
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms)))  # below 2^31 each: no overflow
        total = (sums[stop] - sums[start]) % p
        before = (sums[:-1] - sums[start][row]) % p  # of the word's beginning up to the letter
        behind = (sums[stop][row] - sums[1:]) % p  # of its end behind the letter, which moves one place forward
        whole.append(total), left.append((before + behind * back) % p)
    key = lambda x, y: C.mix(x << np.uint64(32) | y)
    plain = np.append(letters[1:] != letters[:-1], True) | (at == size[row] - 1)
    even, odd = ~np.uint64(1), np.uint64(1)
    gone = key(*left)
    placed = C.mix(gone + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (
        np.concatenate((key(*whole) & even, gone[plain] & even, placed | odd)).view(np.int64),
        np.concatenate((np.arange(len(words)), row[plain], row)),
        np.concatenate((np.full(len(words), -1), at[plain], at)).astype(np.int32),
    )


def _keys(bits: int):
    def made(ids: list[int], words: list[str]) -> pa.RecordBatch:
        key, row, at = keys_of(words)
        return pa.RecordBatch.from_arrays([pa.array(key & bits), pa.array(np.array(ids, np.int64)[row]), pa.array(at)], ["key", "wid", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(wid, word) to (key, wid, place)."""
        for b in C.slices(batches, 8192):
            ids, words, size = [], [], 0
            for i, w in zip(b.column("wid").to_pylist(), b.column("word").to_pylist(), strict=True):
                ids.append(i), words.append(w)
                size += len(w)
                if size >= _PIECE:
                    yield made(ids, words)
                    ids, words, size = [], [], 0
            if words:
                yield made(ids, words)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, place), those that share their key with another; with an even key only if a whole word is among
    them, which is then the first.  A key's rows may go on in the next batch."""
    held: list[pa.RecordBatch] = []

    def sift(rows: pa.Table, last: bool) -> tuple[pa.Table, pa.Table]:
        key = rows.column("key").to_numpy()
        first = np.concatenate(([True], key[1:] != key[:-1]))
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(key)))
        ok = (sizes > 1) & ((key[starts] & 1 == 1) | (rows.column("place").to_numpy()[starts] < 0))
        end = len(key) if last else starts[-1]
        keep = np.repeat(ok, sizes)
        keep[end:] = False
        return rows.filter(pa.array(keep)), rows.slice(end)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if b.column("key")[0].as_py() == b.column("key")[-1].as_py() == held[0].column("key")[0].as_py():
            continue  # one key goes on
        out, rest = sift(pa.Table.from_batches(held), False)
        held = rest.combine_chunks().to_batches()
        yield from out.to_batches()
    if held:
        yield from sift(pa.Table.from_batches(held), True)[0].to_batches()


def near(words: DataFrame, bits: int = -1) -> DataFrame:
    """(wid, n_near, best) for words (wid, word, n), all different, that another is near: how many differ from it by one inserted, deleted or
    replaced code point, and (m, word) of the one with the largest n, m being -n; the first in code-point order of equals.  `bits`
    are those of the keys that count: with fewer, more strings are compared."""
    keys = words.select("wid", "word").mapInArrow(_keys(bits), "key long, wid long, place int")
    met = C.cut(keys.repartition("key").sortWithinPartitions("key", "place").mapInArrow(_met, "key long, wid long, place int"))
    rows = met.join(words, "wid").select("key", "place", "wid", "word", (-F.col("n")).alias("m"))
    whole, placed = F.col("place") < 0, F.col("key") % 2 != 0
    left = F.when(whole, F.col("word")).otherwise(F.expr("concat(substring(word, 1, place), substring(word, place + 2))"))
    rows = rows.withColumn("left", left).withColumn("where", F.when(placed, F.col("place")))
    # Keys are equal where strings are, so that one shuffle by key serves all; what shares a key by chance differs in `left`.
    group = W.partitionBy("key", "where", "left")
    sorted_ = group.orderBy(whole, "m", "word").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    this = F.struct("m", "word")
    rows = rows.repartition("key").select(
        "wid", "word", whole.alias("whole"), placed.alias("placed"), F.sum(F.when(whole, 0).otherwise(1)).over(sorted_).alias("k"),
        F.nth_value(F.when(~whole, this), 1).over(sorted_).alias("one"), F.nth_value(F.when(~whole, this), 2).over(sorted_).alias("two"),
        F.min(F.when(whole, this)).over(sorted_).alias("shorter"),
    )
    other = F.when(F.col("one.word") == F.col("word"), F.col("two")).otherwise(F.col("one"))
    found = rows.select(
        "wid",
        F.when(F.col("placed"), F.col("k") - 1).when(F.col("whole"), F.col("k")).otherwise(F.col("shorter").isNotNull().cast("long")).alias("k"),
        F.when(F.col("placed"), other).when(F.col("whole"), F.col("one")).otherwise(F.col("shorter")).alias("best"),
    )
    return found.filter("k > 0").groupBy("wid").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms (word, form), a row a word: the end of its chain of forms.  Each round doubles the steps; a form occurs RATIO
    times as often as its word, so chains are as long as the digits of the largest count at most."""
    out = C.cut(forms.select("word", F.col("form").alias("root")))
    while True:
        step = out.select(F.col("word").alias("root"), F.col("root").alias("further"))
        out = C.cut(out.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not out.filter("moved").limit(1).count():
            return out.select("word", "root")


def variants(words: DataFrame, often: int = OFTEN, ratio: int = RATIO, bits: int = -1) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each of words (word, n) with n >= often: how many others differ by one code point; the most
    frequent of them (of equals the first in code-point order) if it occurs at least `ratio` times as often, else null; its n; and
    the end of the chain of forms, the word itself if it has none.

    Words are all different and not null; a word of any length is compared; an empty table gives an empty result."""
    words = C.cut(words.filter(F.col("n") >= often).select("word", "n").withColumn("wid", F.monotonically_increasing_id()))
    has = -F.col("best.m") >= ratio * F.col("n")
    out = words.join(near(words, bits), "wid", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.word")).alias("form"), F.when(has, -F.col("best.m")).alias("form_n")
    )
    out = C.cut(out)
    ends = roots(out.filter("form is not null"))
    return out.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(counted(C.table(spark, sf_dir, "documents"), spoil=31))


OP11_SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
runs AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents) r WHERE len(w) >= 7 GROUP BY ALL),
bytes AS (SELECT w, k, list_concat([4294967295], flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))) AS b FROM runs),
hashed AS (SELECT w, k, xor(list_reduce(b, lambda c, x: xor(c >> 8, t.t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, t),
spoilt AS (SELECT CASE WHEN h % 31 = 0 THEN w[1 : h % len(w)] || w[h % len(w) + 2 :] ELSE w END AS word, k FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM spoilt WHERE len(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
gone AS (SELECT word, n, i, word[1 : i - 1] || word[i + 1 :] AS x FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM words) u),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM gone a JOIN gone b ON a.x = b.x AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM gone a JOIN words b ON a.x = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM gone a JOIN words b ON a.x = b.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS most FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN (SELECT min(other) FROM pairs p WHERE p.word = w.word AND p.other_n = most) END AS form,
  CASE WHEN most >= 10 * w.n THEN most END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at, form AS next FROM forms UNION ALL SELECT chain.word, forms.word, forms.form FROM chain JOIN forms ON forms.word = chain.next)
SELECT word, n, n_near, form, form_n, chain.at AS root FROM forms JOIN chain USING (word) WHERE chain.next IS NULL
"""
