"""Byte-level BPE by dynamic programming over prefixes: encoding, decoding, exact appends, re-encoding near edits.

Every beginning of a piece of text has one encoding, and what that encoding ends with is one token.  So an array with the
last token of each beginning holds the encodings of all of them: the last token of b[:i] is the one token t that b[:i] ends
with and that may follow the last token of what is before it.  Two tokens may follow each other if merging the bytes of
both gives just these two.  Appending goes on with the array, an edit redoes it until it agrees with the old one again.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Pieces that a worker remembers, and the longest of them in bytes: bounds of memory, no result depends on them.
CACHE, CACHED = 300_000, 64
#: Characters of a text that are split into pieces at a time.
CHUNK = 1 << 20
#: Characters behind its start, and behind its end, by which the pattern may tell a piece (contractions; white space and the
#: character after it).
SEEN, AHEAD = 3, 2
_SEAM = regex.compile(r"(?<=\S)\s")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def chunks(text: str, size: int = CHUNK, seam=_SEAM) -> Iterator[str]:
    """text in parts that end between a character and white space: the pattern always ends a piece there."""
    at = 0
    while len(text) - at > size:
        found = seam.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def _bytes(piece: str) -> bytes:
    return piece.encode("utf-8", "surrogatepass")


def _common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


class Codec:
    """The merges of a vocabulary (ranks: a token's bytes to its id, lower ids merge first)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.bytes = ranks, {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.longest = max(map(len, ranks))
        self.left: dict[int, list] = {}
        self.right: dict[int, list] = {}
        self.known: dict[int, bool] = {}
        self.ended: dict[bytes, int] = {}
        self.coded: dict[str, bytes] = {}

    @cached_property
    def tails(self) -> set[bytes]:
        return {b[i:] for b in self.ranks for i in range(len(b))}

    def parts(self, token: int) -> list[bytes]:
        """What the merges below a token's own make of its bytes: two parts, or the byte itself.  Others are never merged to."""
        b = self.bytes[token]
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 2:
            found = [(self.ranks.get(x + y, token), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False))]
            rank, i = min(found)
            if rank >= token:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _spine(self, token: int, side: int, memo: dict[int, list]) -> list | None:
        """The tokens that stand at one side of a token's bytes while they are merged: (bytes, from which rank, up to which).
        None if merging doesn't lead to the token."""
        if token not in memo:
            parts = self.parts(token)
            if len(parts) == 1:
                memo[token] = [(parts[0], -1, np.inf)]
            elif len(parts) > 2 or any(self._spine(self.ranks[p], side, memo) is None for p in parts):
                memo[token] = None
            else:
                below = self._spine(self.ranks[parts[side]], side, memo)
                memo[token] = [*below[:-1], (*below[-1][:2], token), (self.bytes[token], token, np.inf)]
        return memo[token]

    def merges(self, token: int) -> bool:
        """Whether merging a token's bytes gives the token."""
        return self._spine(token, 0, self.left) is not None

    def fits(self, u: int, v: int) -> bool:
        """Whether merging the bytes of u and v gives u and v: no token that ends u while it is merged merges with one that
        begins v at that time.  Of equal ranks the leftmost merges first."""
        ok = self.known.get(u << 32 | v)
        if ok is None:
            ends, begins = self._spine(u, 1, self.right), self._spine(v, 0, self.left)
            ok = ends is not None and begins is not None
            for x, x0, x1 in ends or ():
                for y, y0, y1 in begins or ():
                    rank = self.ranks.get(x + y)
                    if rank is not None and max(rank, x0, y0) < x1 and max(rank, x0, y0) <= y1:
                        ok = False
            if len(self.known) >= 2 * CACHE:
                self.known.clear()
            self.known[u << 32 | v] = ok
        return ok

    def last(self, b: bytes, have: list[int] = (), rest: list[int] = ()) -> list[int]:
        """The last token of every beginning of a piece.  `have` holds those of its first bytes.  `rest` holds, for its last
        bytes, those of another piece that ends with the same bytes: once as many agree as the longest token has bytes, the
        others agree too."""
        out = list(have)
        get, tails, agreed, off = self.ranks.get, self.tails, 0, len(b) - len(rest)
        known, fits = self.known.get, self.fits
        for i in range(len(out) + 1, len(b) + 1):
            at = i - 1  # back as far as some token's end goes on, then forward: long tokens are likelier
            while at and b[at - 1 : i] in tails:
                at -= 1
            while at < i:
                t = get(b[at:i])
                if t is not None:
                    ok = known(out[at - 1] << 32 | t) if at else self.merges(t)
                    if ok or ok is None and fits(out[at - 1], t):
                        break
                at += 1
            else:
                raise ValueError(f"no token for byte {b[i - 1]}")
            out.append(t)
            if rest:
                agreed = agreed + 1 if i > off and rest[i - 1 - off] == t else 0
                if agreed == self.longest:
                    return out + list(rest[i - off :])
        return out

    def end(self, b: bytes) -> int:
        """The last token of b, remembered: the same recurrence, only for the beginnings that it asks for, which short pieces
        share."""
        t = self.ended.get(b)
        if t is None:
            get, known = self.ranks.get, self.known.get
            for at in range(max(0, len(b) - self.longest), len(b)):
                t = get(b[at:])
                if t is not None:
                    if not at:
                        if self.merges(t):
                            break
                        continue
                    u = self.end(b[:at])
                    ok = known(u << 32 | t)
                    if ok or ok is None and self.fits(u, t):
                        break
            else:
                raise ValueError(f"no token for byte {b[-1]}")
            self.ended[b] = t
        return t

    def walk(self, b: bytes, last) -> list[int]:
        """The tokens of a piece from its last tokens, back to front.  A piece that is a token as a whole is that token."""
        if b in self.ranks:
            return [self.ranks[b]]
        out, i = [], len(b)
        while i:
            out.append(int(last[i - 1]))
            i -= len(self.bytes[out[-1]])
        return out[::-1]

    def packed(self, piece: str) -> bytes:
        """The ids of a piece as little-endian unsigned 32-bit integers."""
        b = _bytes(piece)
        if b in self.ranks or len(b) > CACHED:
            ids = self.walk(b, () if b in self.ranks else self.last(b))
        else:
            if len(self.ended) >= 2 * CACHE:
                self.ended.clear()
            ids, rest = [], b
            while rest:
                ids.append(self.end(rest))
                rest = rest[: -len(self.bytes[ids[-1]])]
            ids.reverse()
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(b) <= CACHED:
            if len(self.coded) >= CACHE:
                self.coded.clear()
            self.coded[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        out, get, make = [], self.coded.get, self.packed
        for part in chunks(text):
            out.append(b"".join([get(p) or make(p) for p in self.pattern.findall(part)]))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        step, get = 4 * CHUNK, self.bytes.__getitem__
        return b"".join(b"".join(map(get, np.frombuffer(ids[i : i + step], "<u4").tolist())) for i in range(0, len(ids), step))


@dataclass
class Table:
    """A text with where its pieces end (in characters) and the last token of each beginning of each piece, a number a byte."""

    text: str
    stops: np.ndarray
    last: np.ndarray

    @classmethod
    def of(cls, codec: Codec, text: str) -> Table:
        return cls("", np.zeros(0, np.int64), np.zeros(0, np.int64)).change(codec, 0, 0, text)

    def change(self, codec: Codec, at: int, gone: int, new: str) -> Table:
        """The table of the text with `gone` characters from `at` replaced by `new`.  Pieces that the pattern told without a
        look at the change stay; from the first place behind it where an old piece began, all stay.  In the pieces between,
        the tokens before the change stay, and those behind it from where as many as the longest token has bytes agree."""
        at = min(max(at, 0), len(self.text))
        gone = min(max(gone, 0), len(self.text) - at)
        text, shift = self.text[:at] + new + self.text[at + gone :], len(new) - gone
        starts = np.append(0, self.stops)[: len(self.stops)]
        keep = int(np.argmin(np.append(np.maximum(starts + SEEN, self.stops + AHEAD) <= at, False)))
        old = [_bytes(p) for p in self.pieces(keep)]
        ends = len(self.last) - sum(map(len, old)) + np.cumsum([0, *map(len, old)])  # of old pieces in `last`, from keep on
        place = {int(s): k for k, s in enumerate(starts[keep:])}
        stops, last, tail = [self.stops[:keep]], [self.last[: ends[0]]], len(old)
        for m in codec.pattern.finditer(text, int(self.stops[keep - 1]) if keep else 0):
            k = place.get(m.start() - shift) if m.start() >= at + len(new) else None
            if k is not None:
                tail = k
                break
            b, have, rest = _bytes(m.group()), (), ()
            k = place.get(m.start())
            if k is not None:
                was = self.last[ends[k] : ends[k + 1]].tolist()
                have = was[: _common(b, old[k])]
                if int(self.stops[keep + k]) + shift == m.end():
                    n = _common(b[::-1], old[k][::-1])
                    rest = was[len(was) - n :]
            last.append(np.array(codec.last(b, have, rest), np.int64))
            stops.append(np.array([m.end()], np.int64))
        return Table(text, np.concatenate([*stops, self.stops[keep + tail :] + shift]), np.concatenate([*last, self.last[ends[tail] :]]))

    def pieces(self, first: int = 0) -> Iterator[str]:
        at = int(self.stops[first - 1]) if first else 0
        for stop in self.stops[first:].tolist():
            yield self.text[at:stop]
            at = stop

    def ids(self, codec: Codec) -> bytes:
        out, at = [], 0
        for p in self.pieces():
            b = _bytes(p)
            out.extend(codec.walk(b, self.last[at : at + len(b)]))
            at += len(b)
        return np.array(out, "<u4").tobytes()


_CODECS: dict[int, Codec] = {}


def _codec(ranks, pattern: str) -> Codec:
    """The codec of a worker process, kept from task to task: Spark reuses processes and what was broadcast to them."""
    if id(ranks.value) not in _CODECS:
        _CODECS.clear()
        _CODECS[id(ranks.value)] = Codec(ranks.value, pattern)
    return _CODECS[id(ranks.value)]


class Coder:
    """A vocabulary file as a coder of DataFrames.  The vocabulary is broadcast: its size is fixed by its file."""

    def __init__(self, spark: SparkSession, path: str | None = None, pattern: str | None = None):
        self.ranks = spark.sparkContext.broadcast(ranks_of(path or default_path()))
        self.pattern = pattern or default_pattern()

    def _map(self, df: DataFrame, columns: list[str], schema: str, one) -> DataFrame:
        """mapInArrow over some columns; `one` makes a row's values from a codec and the columns behind the first."""
        ranks, pattern, names = self.ranks, self.pattern, [f.split()[0] for f in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(ranks, pattern)
            for b in C.slices(batches):
                rows = [one(codec, *r) for r in zip(*(b.column(c).to_pylist() for c in columns[1:]), strict=True)]
                cols = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
                kinds = (pa.binary() if f.endswith("binary") else pa.int64() if f.endswith("long") else pa.string() for f in schema.split(", ")[1:])
                yield pa.RecordBatch.from_arrays([b.column(columns[0]), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

        df = df.select(*columns)
        return df.mapInArrow(run, schema.replace("doc_id", f"doc_id {df.schema['doc_id'].dataType.simpleString()}", 1))

    def encode(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_tokens, ids) for each row of docs (doc_id, text): ids as little-endian unsigned 32-bit integers, each
        match of the pattern separately, without special tokens.

        A null or empty text has no ids, a null id passes through, repeated rows stay repeated, other columns go, a text
        may be of any length, an empty table gives an empty result."""

        def one(codec: Codec, text: str | None) -> tuple:
            ids = codec.encode(text or "")
            return len(ids) // 4, ids

        return self._map(docs, ["doc_id", "text"], "doc_id, n_tokens long, ids binary", one)

    def decode(self, coded: DataFrame) -> DataFrame:
        """(doc_id, n_tokens, ids, decoded) for each row of coded (doc_id, ids), whose ids are as encode() gives them: the
        bytes that the ids stand for.  Null ids stand for none."""

        def one(codec: Codec, ids: bytes | None) -> tuple:
            return len(ids or b"") // 4, ids, codec.decode(ids or b"")

        return self._map(coded, ["doc_id", "ids"], "doc_id, n_tokens long, ids binary, decoded binary", one)

    def tables(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text, stops, last) for each row of docs: the prefix tables that change() goes on with.  A null text counts
        as empty."""

        def one(codec: Codec, text: str | None) -> tuple:
            return _stored(Table.of(codec, text or ""))

        return self._map(docs, ["doc_id", "text"], _TABLE, one)

    def change(self, tables: DataFrame, changes: DataFrame) -> DataFrame:
        """The tables with one change each: changes (doc_id, at, gone, new) replaces `gone` characters from `at` by `new`; a
        place behind the end is the end, so a large `at` appends.  A document has one row on each side; changes without a
        document are left out, documents without a change stay as they are."""

        def one(codec: Codec, text: str, stops: bytes, last: bytes, at: int | None, gone: int | None, new: str | None) -> tuple:
            t = Table(text, np.frombuffer(stops, "<u4").astype(np.int64), np.frombuffer(last, "<u4").astype(np.int64))
            return (text, stops, last) if at is None else _stored(t.change(codec, at, gone or 0, new or ""))

        joined = tables.join(changes.select("doc_id", "at", "gone", "new"), "doc_id", "left")
        return self._map(joined, ["doc_id", "text", "stops", "last", "at", "gone", "new"], _TABLE, one)

    def ids(self, tables: DataFrame) -> DataFrame:
        """(doc_id, n_tokens, ids) of stored tables: a walk back through each, without merging anything."""

        def one(codec: Codec, text: str, stops: bytes, last: bytes) -> tuple:
            ids = Table(text, np.frombuffer(stops, "<u4").astype(np.int64), np.frombuffer(last, "<u4").astype(np.int64)).ids(codec)
            return len(ids) // 4, ids

        return self._map(tables, ["doc_id", "text", "stops", "last"], "doc_id, n_tokens long, ids binary", one)


_TABLE = "doc_id, text string, stops binary, last binary"


def _stored(t: Table) -> tuple:
    return t.text, t.stops.astype("<u4").tobytes(), t.last.astype("<u4").tobytes()


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coder = Coder(spark)
    both = coder.decode(coder.encode(C.table(spark, sf_dir, "documents")))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
