"""Byte-level BPE by prefixes, against the library that its results must equal."""

import hashlib
import random

import numpy as np
import pytest

from tallyspark.llm import bpe
from tallyspark.llm import common as C

ODD = "abc  de'\nétrs1lv　漢"


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.ranks_of(bpe.default_path()), bpe.default_pattern())


@pytest.fixture(scope="module")
def library(codec):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=codec.ranks, special_tokens={})
    return lambda text: np.array(enc.encode_ordinary(text), "<u4").tobytes()


def some(rng, n):
    return "".join(rng.choice(ODD) for _ in range(rng.randrange(n)))


def test_equals_the_library(codec, library):
    rng = random.Random(1)
    for text in ["", " ", "<|endoftext|>", "a" * 5000, "ab" * 3000 + "\n" * 999, "x  y", *(some(rng, 40) for _ in range(3000))]:
        assert codec.encode(text) == library(text)
        assert codec.decode(codec.encode(text)) == text.encode()
    long = " ".join(some(rng, 30) for _ in range(3000))
    assert b"".join(map(codec.encode, bpe.chunks(long, 1000))) == library(long) == codec.encode(long)


def test_every_beginning_has_its_last_token(codec, library):
    rng = random.Random(2)
    for _ in range(300):
        piece = next(iter(codec.pattern.findall("x" + some(rng, 30))))
        last = codec.last(piece.encode())
        for i in range(1, len(piece) + 1):
            b = piece[:i].encode()
            assert last[len(b) - 1] == np.frombuffer(library(piece[:i]), "<u4")[-1] == codec.end(b)


def test_pairs_that_fit(codec, library):
    rng = random.Random(3)
    tokens = [i for i, b in codec.bytes.items() if b.isalpha()]
    for _ in range(5000):
        u, v = rng.choice(tokens), rng.choice(tokens)
        both = codec.bytes[u] + codec.bytes[v]
        assert codec.fits(u, v) == (library(both.decode()) == np.array([u, v], "<u4").tobytes())


def test_changes_equal_encoding_anew(codec, library):
    rng = random.Random(4)
    for _ in range(800):
        t = bpe.Table.of(codec, some(rng, 40))
        for _ in range(4):
            at, gone, new = rng.choice([len(t.text), rng.randrange(len(t.text) + 1)]), rng.choice([0, 0, 1, 5]), some(rng, 6)
            want = t.text[:at] + new + t.text[at + gone :]
            t = t.change(codec, at, gone, new)
            anew = bpe.Table.of(codec, want)
            assert t.text == want and np.array_equal(t.stops, anew.stops) and np.array_equal(t.last, anew.last)
            assert t.ids(codec) == library(want)


def test_a_change_in_a_long_piece_redoes_little(codec, monkeypatch):
    t = bpe.Table.of(codec, "abcdefgh" * 5000)
    asked = []
    fits = codec.fits
    monkeypatch.setattr(codec, "fits", lambda u, v: asked.append(1) or fits(u, v))
    monkeypatch.setattr(codec, "known", {})  # so that each pair is asked for again
    new = t.change(codec, 20_000, 1, "zz")
    assert len(new.last) == 40_001 and 0 < len(asked) < 2_000
    assert np.array_equal(new.last, bpe.Table.of(codec, new.text).last)


def test_frames(spark, codec, library):
    """Null and empty texts, null and repeated ids, clashing columns, an empty table; appends and edits of stored tables."""
    rows = [(1, "Some words, some  more.", "x"), (2, None, "y"), (3, "", None), (None, "no id", "z"), (1, "Some words, some  more.", "x"), (4, "w" * 3000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coder = bpe.Coder(spark)
    got = coder.decode(coder.encode(docs)).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["ids"]), r["n_tokens"], bytes(r["decoded"])) for r in got) == sorted(
        (i or 0, library(t or ""), len(library(t or "")) // 4, (t or "").encode()) for i, t, _ in rows
    )
    assert coder.decode(coder.encode(docs.limit(0))).count() == 0
    tables = C.cut(coder.tables(docs.filter("doc_id > 1")))
    changes = spark.createDataFrame([(2, 0, 0, "new"), (4, 5, 2, " a "), (9, 0, 0, "none")], "doc_id long, at int, gone int, new string")
    changed = coder.change(tables, changes)
    want = {2: "new", 3: "", 4: "wwwww a " + "w" * 2993}
    assert {r["doc_id"]: bytes(r["ids"]) for r in coder.ids(changed).collect()} == {i: library(t) for i, t in want.items()}


def test_op12_against_the_library(spark, library):
    from tallyspark.llm import queries

    data = "/root/testdata/sf0.001"
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in C.table(spark, data, "documents").collect():
        ids = library(r["text"] or "")
        want.append((r["doc_id"], len(ids) // 4, sha(ids), sha((r["text"] or "").encode())))
    assert sorted(tuple(r) for r in queries.queries()["op12_bpe"](spark, data).collect()) == sorted(want)
