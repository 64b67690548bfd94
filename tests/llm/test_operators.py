"""The ten operators: odd inputs, brute force on small fixtures, round trips, held-out quality."""

import hashlib
import itertools
import math
import os
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import common as C
from tallyspark.llm import jaccard, langid, lmscore, media, mixing, packing, pii, quality, substrings, toxicity

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, n int, h string, fp string, key string, kept boolean, score double, copy string, piece string, at_email string"
ID = "Write to ann.lee@example.org or 10.0.0.1, card 4111 1111 1111 1111, call +1 (202) 555-0143."


def odd(spark):
    """Null ids and texts, empty and blank texts, repeated rows and ids, a very long text, columns with clashing names."""
    words = " ".join(f"w{i % 977}" for i in range(30_000))
    texts = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (3, ""), (4, " \n\t "), (None, "a b c d e f g"), (None, None), (5, words), (6, words + " end"), (7, "x"), (7, "y z"), (8, ID), (9, "ação é ñ 漢字 🙂 " * 40)]
    rest = [None if i % 3 else "s1" for i in range(len(texts))]
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, s, None, 1, 2, "h", "f", "k", True, 0.5, "c", "p", "m") for k, ((i, t), s) in enumerate(zip(texts, rest, strict=True))], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (5, 1, 0), (5, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")


def nothing(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)


PER_ROW = {
    "quality": lambda s, d, l: quality.judge(s, d, l),
    "jaccard": lambda s, d, l: jaccard.jaccard_join(s, d),
    "pii": lambda s, d, l: pii.extract(s, d),
    "media": lambda s, d, l: media.digest(media.store(d)),
    "toxicity": lambda s, d, l: toxicity.score(s, d, toxicity.fit(s, d.select("doc_id", "text"), l.select("doc_id", "toxic"))),
    "substrings": lambda s, d, l: substrings.dedup(s, d, 20)[0],
    "lmscore": lambda s, d, l: lmscore.score(s, d, d),
    "langid": lambda s, d, l: langid.identify(s, d, d),
    "mixing": lambda s, d, l: mixing.mix(s, d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_per_row(spark, name):
    docs = odd(spark)
    assert PER_ROW[name](spark, docs, labels(spark)).count() == docs.count()


@pytest.mark.parametrize("name", [*PER_ROW, "packing"])
def test_empty_tables(spark, name):
    run = PER_ROW.get(name, lambda s, d, l: packing.pack(s, d))
    assert run(spark, nothing(spark), nothing(spark, "doc_id long, quality int, toxic int")).count() == 0


@pytest.mark.parametrize("hubs", [jaccard.HUBS, 0])  # without hubs the matrix does it all
def test_jaccard_against_all_pairs(spark, monkeypatch, hubs):
    import random

    monkeypatch.setattr(jaccard, "HUBS", hubs)
    r = random.Random(5)
    base = [[f"w{r.randrange(300)}" for _ in range(r.randrange(3, 90 if i % 2 else 15))] for i in range(40)]
    rows = []
    for i in range(240):
        w = list(r.choice(base))
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = f"w{r.randrange(300)}"
        rows.append((i, " ".join(w) if i % 7 else None))
    for k, percent in ((3, 90), (5, 80)):
        sets = {}
        for i, t in rows:
            w = (t or "").lower().split()
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
        root = {i: i for i in sets}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in itertools.combinations(sets, 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
        got = {x[0]: (x[1], x[2]) for x in jaccard.jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()}
        assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_buckets():
    """Linked sets meet in a bucket, whichever tokens are heavy; sets without a common token never do."""
    import numpy as np

    rng = np.random.default_rng(1)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
    linked = 0
    for trial in range(4000):
        percent, n = (80, 90, 60, 95)[trial % 4], int(rng.integers(1, 12) if trial % 3 else rng.integers(12, 300))
        a = np.unique(draw(n))
        change = int(rng.integers(0, n * (100 - percent) // percent + 1))
        gone = int(change * rng.random())
        b = np.unique(np.concatenate((rng.permutation(a)[min(gone, n - 1) :], draw(change - gone))))
        heavy = np.sort(rng.choice(np.union1d(a, b), int(rng.integers(0, n + 1)), replace=False))
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both):
            linked += 1
            assert len(np.intersect1d(jaccard.keys(a, percent, heavy), jaccard.keys(b, percent, heavy)))
    assert linked > 3000
    for percent in (80, 90):
        apart = np.concatenate([jaccard.keys(np.unique(draw(int(rng.integers(2, 200)))), percent) for _ in range(400)])
        assert len(np.unique(apart)) == len(apart)


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def test_pii_base(spark):
    tricky = ["a@b.c d@e 1.2.3.4.5 999.1.1.1 001.002.003.004", "x" * 50 + "@" + "y.z" * 30, "4111-1111-1111-1111 4111 1111 1111 1112", "+1 (2)3-4.5678901 +12 +1234567890123456", "🙂 é a@b.co +44 20 7946 0958", "1" * 5000, None, ""]
    texts = [(i, t) for i, t in enumerate(tricky)] + [(r[0] + 1000, r[1]) for r in C.table(spark, DATA, "documents").select("doc_id", "text").collect()]
    df = pii.extract(spark, spark.createDataFrame(texts, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in df.collect()}
    for i, t in texts:
        want = base_spans(t)
        assert [(x["start"], x["stop"], x["kind"]) for x in got[i]["base"]] == [(s, e, k) for s, _, e, k in want], i
        for kind in KINDS:
            assert got[i][f"n_{kind}"] == sum(k == kind for *_, k in want)
        assert {tuple(x) for x in got[i]["base"]} <= {tuple(x) for x in got[i]["all"]}
    clean = pii.redact(df.filter("doc_id = 4")).first()["text"]
    assert "a@b.co" not in clean and "7946" not in clean


def test_pii_learns_a_context(spark):
    """Identifiers that no format covers, in contexts that seeds share."""
    rows = [(i, f"please note employee badge {v} for the visit tomorrow") for i, v in enumerate([f"u{j}.x@corp.example.org" for j in range(12)] + ["QX-77-AB91"])]
    rows += [(100 + i, f"the year was {1900 + i} and then nothing else happened at all") for i in range(20)]
    found = {r["doc_id"]: r["all"] for r in pii.extract(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found[12]) == 1 and not any(found[100 + i] for i in range(20))


def test_packing(spark):
    rows = [(i, " ".join("w" for _ in range((i * 37) % 700))) for i in range(400)] + [(900, " ".join("w" for _ in range(5000))), (5, " ".join("w" for _ in range(185)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(spark, docs).collect()
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(i for i, _ in rows)
    assert sum(r["n_words"] for r in got) == sum(len(t.split()) for _, t in rows)
    bins = {}
    for r in got:
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(r)
    for b in bins.values():
        spans = sorted((r["bin_start"], r["bin_start"] + r["n_words"]) for r in b)
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in itertools.pairwise(spans))
        assert spans[-1][1] == b[0]["bin_used"] and b[0]["bin_length"] == min(x for x in packing.LENGTHS if x >= b[0]["bin_used"])
    assert sum(b[0]["bin_used"] for b in bins.values()) > 0.9 * sum(b[0]["bin_length"] for b in bins.values())
    assert max(len(r["words"]) for r in packing.assemble(docs.dropDuplicates(["doc_id"]).filter("doc_id <> 5"), packing.pack(spark, docs.dropDuplicates(["doc_id"]).filter("doc_id <> 5"))).collect()) <= max(packing.LENGTHS)


def test_media_round_trip(spark):
    texts = ["", None, "a", "é🙂" * 50, "x" * 64, "y" * 100_000]
    got = {r["doc_id"]: r for r in media.digest(media.store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (got[i]["n_bytes"], got[i]["payload_bytes"]) == (len(raw), len(payload))
        assert got[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got[i]["tail_crc32"] == zlib.crc32(payload[-64:])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs = C.table(spark, d, "documents")
    found = langid.op9_langid(spark, d).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").filter("lang is not null and lang_pred <> 'und'")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    rows = toxicity.op6_toxicity(spark, d).filter("held_out").join(C.table(spark, d, "labels"), "doc_id").filter("toxic is not null").select("score", "toxic").collect()
    good, bad = [r[0] for r in rows if not r[1]], [r[0] for r in rows if r[1]]
    assert sum((b > g) + 0.5 * (b == g) for g in good for b in bad) / (len(good) * len(bad)) > 0.9


def test_language_model(spark):
    docs = C.table(spark, DATA, "documents").select("doc_id", "text")
    texts = {r[0]: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")) for r in docs.collect()}
    train = Counter()
    for i, w in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            train.update([("w", x) for x in w] + [("end",)])
    n, v = sum(train.values()), len(train)
    got = lmscore.op8_lmscore(spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        tokens = [("w", x) for x in texts[r["doc_id"]]] + [("end",)]
        want = sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(train[t] > 0 for t in tokens), n)
        assert r["base_score"] == pytest.approx(want, rel=1e-9) and r["score"] < 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_language_model_learns(spark):
    """Texts of known words score better than by the base, which gives unknown words away for 0.1 of a count."""
    got = lmscore.op8_lmscore(spark, "/root/testdata/sf0.01").collect()
    learnt, new = ([r for r in got if r["held_out"] == h] for h in (False, True))
    assert sum(r["score"] > r["base_score"] for r in learnt) > 0.9 * len(learnt)
    assert sum(r["score"] for r in new) > 1.03 * sum(r["base_score"] for r in new)


def test_mix_near_targets(spark):
    rows = mixing.op10_mixing(spark, DATA).collect()
    source = {r[0]: r[1] for r in C.table(spark, DATA, "documents").select("doc_id", "source").collect()}
    taken, most, target = Counter(), Counter(), {}
    for r in rows:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        most[s] = max(most[s], r["size"])
        target[s] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    for s in target:
        assert abs(taken[s] - target[s]) <= most[s]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op10_mixing(spark, DATA).collect()))
