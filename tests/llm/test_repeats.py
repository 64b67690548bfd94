"""Words in repeated windows, counted one by one."""

import random
from collections import Counter

from tallyspark.llm import common as C
from tallyspark.llm import quality


def repeated(text):
    w = (text or "").split()
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    return len({k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)})


def test_repeat_words(spark):
    rng = random.Random(8)
    texts = [None, "", "a", "a a a", "a a a a", "a b c x a b c", "a b a b a b", *(" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(80)), " ".join(str(i) for i in range(30_000)) + " 5 6 7"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.features(docs).collect()}
    assert got == {i: repeated(t) for i, t in enumerate(texts)}


def test_repeat_words_of_the_documents(spark):
    docs = C.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality.features(docs).collect()} == {r["doc_id"]: repeated(r["text"]) for r in docs.collect()}
