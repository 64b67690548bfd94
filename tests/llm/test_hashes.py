"""Words that a polynomial modulo a power of two cannot tell apart."""

import numpy as np

from tallyspark.llm import common as C
from tallyspark.llm import jaccard, substrings

BITS = np.array([bin(i).count("1") % 2 for i in range(2048)], np.uint8)
ONE, TWO = (bytes(BITS ^ k | 0x60).replace(b"\x60", b"b").decode() for k in (0, 1))


def test_word_hashes():
    """Words are told apart whatever their letters, and are equal wherever they stand and whatever stands around them."""
    assert ONE != TWO and len(ONE) == len(TWO) == 2048
    words = [ONE, TWO, ONE[:1024], TWO[:1024], "a", "aa", "a\0", "abcdefgh", "abcdefghi", "bcdefghi", "abcdefgh\0", "é", "x" * 8, "x" * 16]
    h = C.word_hashes(" ".join(words).encode())
    assert len(set(h.tolist())) == len(words)
    for k, w in enumerate(words):
        assert C.word_hashes(w.encode())[0] == C.word_hashes(f"\n {w}\t".encode())[0] == h[k]
    assert len(C.word_hashes(b"")) == len(C.word_hashes(b" \n ")) == 0
    long = " ".join(str(i) * 3 for i in range(300_000)).encode()  # over several pieces
    assert len(np.unique(C.word_hashes(long))) == len(C.word_hashes(long)) == 300_000


def test_no_link_between_different_sets(spark):
    docs = spark.createDataFrame([(1, f"{ONE} x y z"), (2, f"{TWO} x y z"), (3, f"{ONE} x y z")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_join(spark, docs, 3, 90).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_no_removal_of_different_words(spark):
    rest = " ".join(f"w{i}" for i in range(49))
    docs = spark.createDataFrame([(1, f"{ONE} {rest}"), (2, f"{TWO} {rest}"), (3, f"new {ONE} {rest}")], "doc_id long, text string")
    rows, _ = substrings.dedup(spark, docs)
    assert {r["doc_id"]: r["n_removed"] for r in rows.collect()} == {1: 0, 2: 0, 3: 50}
