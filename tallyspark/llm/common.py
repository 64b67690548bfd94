"""What the operators of this package share: reading, words, hashing, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = "\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def n_words(col: Column) -> Column:
    """Number of words; 0 for null."""
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("long")


def words(col: Column) -> Column:
    """The words in order; an empty array for null."""
    return F.array_remove(F.split(F.translate(text_of(col), SPACES, " " * 6), " "), "")


def crc_mod(col: Column, k: int) -> Column:
    """crc32 of a value's text form, modulo k; a null counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % k


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  A temporary one only where none is set and all run on this machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back.  Lost executors then cost a read, not a recomputation, and a later
    join knows its size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what cut() has written for df.  Whatever was made from it must have been written itself by then."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Broadcast df if its counted rows are at most `most`; else leave the join to Spark."""
    return F.broadcast(df) if rows <= most else df


def aside(df: DataFrame, needed: list[str], results: set[str]) -> tuple[DataFrame, list[Column]]:
    """df with all but the needed columns under names that no operator uses, and the columns that bring them back; those
    named as a result give way to it."""
    rest = [c for c in df.columns if c not in needed]
    made = df.select(*needed, *(F.col(f"`{c}`").alias(f"_x{i}_") for i, c in enumerate(rest)))
    return made, [F.col(f"_x{i}_").alias(c) for i, c in enumerate(rest) if c not in results]


@contextmanager
def few_rows(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """What is run within passes so many rows at a time to Python at most.  Long texts in batches of Spark's own size (10,000 rows) are
    a whole partition's text in one piece, outside of the heap of the JVM and once more in Python, for each task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, rows if before <= 0 else min(before, rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(batches, rows: int = 512):
    """Arrow batches in slices of so many rows: what a task makes of a batch is held a slice at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


# --- numpy, inside tasks -------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_PIECE = 1 << 20


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    have = _TABLES.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        made = []
        for b in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            made.append(np.multiply.accumulate(t))
        have = _TABLES[which] = (made[0], made[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of any spans of a sequence, from one prefix sum."""

    def __init__(self, values: np.ndarray, which: int = 0):
        p, self.inverse = _powers(which, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values.astype(np.uint64) * p[: len(values)], out=self.sums[1:])

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Equal sequences, equal hashes, wherever they stand."""
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))

    def windows(self, n: int) -> np.ndarray:
        m = max(0, len(self.sums) - n)
        return mix((self.sums[n : n + m] - self.sums[:m]) * self.inverse[:m] + np.uint64(n))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def pieces(data: bytes):
    """data in pieces of about a megabyte that end at white space, so that a long text needs little memory at a time."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + _PIECE)
        while end < n and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end


#: By number of bytes, what is left of eight.
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order: each eight bytes are mixed with their place, so that no regular sequence of letters
    cancels out, as it would in a polynomial."""
    out = []
    for piece in pieces(data):
        start, stop = runs(~_SPACE[np.frombuffer(piece, np.uint8)])
        if not len(start):
            continue
        eight = np.ndarray(len(piece), "<u8", piece + bytes(8), strides=(1,))  # from each byte on
        size = stop - start
        blocks = (size + 7) // 8
        first = np.cumsum(blocks) - blocks
        word = np.repeat(np.arange(len(size)), blocks)
        place = np.arange(len(word)) - first[word]
        value = eight[start[word] + 8 * place] & _LEFT[np.minimum(size[word] - 8 * place, 8)]
        mixed = mix(value ^ mix(place.astype(np.uint64) + np.uint64(_BASES[0])))
        out.append(mix(np.add.reduceat(mixed, first) + size.astype(np.uint64) * np.uint64(_BASES[1])))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def ascii_lower(data: bytes) -> bytes:
    """A-Z in lower case, nothing else changed."""
    return data.lower()
