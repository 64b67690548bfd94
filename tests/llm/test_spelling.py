"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

from tallyspark.llm import spelling as S


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(words, often=2, ratio=10):
    words = {w: n for w, n in words.items() if n >= often}
    rows, form = [], {}
    for w, n in words.items():
        near = [x for x in words if is_near(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= ratio * n:
            form[w] = best
        rows.append((w, n, len(near), form.get(w), words.get(form.get(w))))
    out = []
    for w, *rest in rows:
        root = w
        while root in form:
            root = form[root]
        out.append((w, *rest, root))
    return sorted(out, key=str)


def run(spark, words, **options):
    df = spark.createDataFrame(list(words.items()) or [], "word string, n long")
    return sorted((tuple(r) for r in S.variants(df, **options).select("word", "n", "n_near", "form", "form_n", "root").collect()), key=str)


def test_every_pair_of_random_words(spark):
    """Dense words of few letters, ties, chains over several forms, astral letters, equal neighbours."""
    rng = random.Random(5)
    words = {"".join(rng.choice("abé𝔘") for _ in range(rng.randrange(1, 7))): rng.choice([1, 2, 3, 30, 30, 400, 5000]) for _ in range(900)}
    words |= {"aaaaaaaa": 2, "aaaaaaa": 25, "aaaaaaaab": 25, "aaaabaaa": 2}
    assert run(spark, words) == brute(words)
    chain = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 20000, "abcdefghijkl": 200000}
    assert {r[0]: r[5] for r in run(spark, chain)} == dict.fromkeys(chain, "abcdefghijkl")
    assert run(spark, {}) == []


def test_keys_that_meet_by_chance(spark):
    """With keys of three bits nearly all collide; the strings decide."""
    rng = random.Random(6)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(3, 8))): rng.randrange(2, 400) for _ in range(120)}
    assert run(spark, words, bits=7) == brute(words)


def test_long_words(spark):
    """Words of 30,000 letters that differ at one place; a hash that polynomials modulo 2^64 get wrong."""
    word, other = "ab" * 15000, "ab" * 9000 + "c" + "ab" * 6000
    seq = [bin(i).count("1") % 2 for i in range(2048)]
    thue, morse = ("".join("ab"[x ^ k] for x in seq) for k in (0, 1))
    words = {word: 5, other: 50, thue: 2, morse: 40}
    assert run(spark, words) == brute(words)
    key, row, at = S.keys_of([thue, morse])
    assert len(set(key[at < 0])) == 2


def test_groups_over_batches():
    """Rows of a key that go on over several batches stay together."""
    import pyarrow as pa

    rng = random.Random(7)
    rows = sorted((rng.randrange(60), rng.choice([-1, 0, 1, 2]), i) for i in range(300))
    rows += [(99, 0, k) for k in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 7], strict=True)], ["key", "place", "wid"]) for i in range(0, len(rows), 7)]
    got = sorted(tuple(r.values()) for b in S._met(iter(batches)) for r in b.to_pylist())
    sizes, whole = Counter(r[0] for r in rows), {r[0] for r in rows if r[1] < 0}
    assert got == sorted(r for r in rows if sizes[r[0]] > 1 and (r[0] % 2 or r[0] in whole))
    assert list(S._met(iter([]))) == []


def test_counting(spark):
    """Null and empty texts and ids, repeated rows, clashing columns, letters beyond A-Z, an empty table."""
    rows = [(i % 40, f"Straße ÉTUDIANT garçonnet élèves-Machinery machinery{i} ' {'w' * (i + 5)}", i) for i in range(60)] + [(None, "Machinery", 0), (1, None, 0), (2, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    for spoil in (None, 3):
        want: Counter = Counter()
        for i, t, _ in rows:
            for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
                h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
                if spoil and h % spoil == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
                want[w] += len(w) >= 7
        assert {r["word"]: r["n"] for r in S.counted(docs, spoil=spoil).collect()} == {w: n for w, n in want.items() if n}
    assert S.variants(S.counted(docs.limit(0))).count() == 0


def test_forms_in_the_documents(spark):
    """op11 has words with forms, and chains end where no form follows."""
    rows = {r["word"]: r for r in S.op11_spelling(spark, "/root/testdata/sf0.01").collect()}
    forms = [r for r in rows.values() if r["form"]]
    assert len(forms) > 20 and all(is_near(r["word"], r["form"]) and r["form_n"] >= 10 * r["n"] and rows[r["form"]]["n"] == r["form_n"] for r in forms)
    assert all(rows[r["root"]]["form"] is None and (r["form"] or r["root"] == r["word"]) for r in rows.values())
