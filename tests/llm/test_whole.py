"""Operators do the whole of their job: every row counts, and what is learnt shows."""

import itertools

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import common as C
from tallyspark.llm import jpeg, langid, lmscore, media, packing, pii, quality, toxicity


def _trained(spark, rows, texts):
    """The weights that lmscore learns from rows, with the counts of texts."""
    ranks = spark.sparkContext.broadcast(lmscore.ranks_of(lmscore.RANKS))
    counts = C.cut(texts.select("text").mapInArrow(lmscore._count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    known = lmscore.vocabulary(counts, [(bytes(r["word"]), r["n"]) for r in counts.collect()], ranks)
    return lmscore.train(spark, rows, spark.sparkContext.broadcast(known), ranks)


def test_every_training_text_shapes_the_weights(spark):
    """Each of 40 texts trains the attention model, and how they are dealt to tasks makes no difference."""
    rows = spark.createDataFrame([(i, f"alpha beta gamma delta {i % 7} omega " * 20) for i in range(40)], "doc_id long, text string")
    all_of_them = _trained(spark, rows.coalesce(1), rows)
    dealt = _trained(spark, rows.repartition(7), rows)
    assert all(np.abs(all_of_them[n] - x).max() > 0 for n, x in lmscore.A.start().items())
    assert all(np.array_equal(all_of_them[n], dealt[n]) for n in dealt)
    for gone in (0, 17, 39):
        but_one = _trained(spark, rows.filter(F.col("doc_id") != gone), rows)
        assert any(np.abs(all_of_them[n] - but_one[n]).max() > 0 for n in but_one)


def test_the_model_is_a_distribution():
    """Over every next id the model's chances sum to 1, after any beginning; its gradient is that of its loss."""
    A, rng, v = lmscore.A, np.random.default_rng(3), 60
    starts = np.arange(v) < 25
    words = [([int(rng.integers(25)), *map(int, 25 + rng.integers(0, 35, rng.integers(0, 4)))], int(rng.integers(1, 9))) for _ in range(80)]
    begins, follows, ends, pairs = np.zeros(v), np.zeros(v), np.zeros(v), {}
    for ids, n in words:
        begins[ids[0]] += n
        ends[ids[-1]] += n
        for k in itertools.pairwise(ids):
            follows[k[1]] += n
            pairs[k] = pairs.get(k, 0) + n
    known = A.Vocabulary(starts, begins, follows, ends, tuple(np.array(x) for x in (*zip(*pairs, strict=True), list(pairs.values()))), words)
    w = {n: x + rng.standard_normal(x.shape).astype(np.float32) / 4 for n, x in A.start().items()}

    def log(ids):
        """Of a sequence of ids, cut into words."""
        cut = [i for i, x in enumerate(ids) if starts[x]]
        made = known.codes([ids[a:b] for a, b in zip(cut, [*cut[1:], len(ids)], strict=True)])
        codes = np.array([c for code in made for c in code])
        return float(A.logs(w, known.bias, A.targets([codes], known.first), [len(codes)])[0] + A.shares([codes])[0])

    for before in ([3], [4, 30, 41], [7, 26, 8, 50, 33] * 9, words[0][0] * 12 + words[1][0]):
        assert abs(sum(np.exp(log([*before, i])) for i in range(v)) / np.exp(log(before)) - 1) < 1e-3
    codes = np.concatenate([np.array(c) for c in known.codes([ids for ids, _ in words])])
    made = A.targets([codes[:50], codes[50:]], known.first)
    assert made[-1].sum() == len(codes)
    g, _ = A.gradient(w, known.bias, *made)
    for n, x in w.items():
        i = np.unravel_index(np.argmax(np.abs(g[n])), x.shape)
        moved = []
        for step in (1e-2, -1e-2):
            y = w | {n: x.copy()}
            y[n][i] += step
            moved.append(A.gradient(y, known.bias, *made)[1])
        assert abs((moved[0] - moved[1]) / 2e-2 - g[n][i]) < 0.05 * abs(g[n][i]) + 1e-4


def test_each_quality_rule_selects_a_cutoff(spark, tmp_path):
    """With enough labels every rule's cutoff is selected, and the documents kept are those of the SQL."""
    good = " ".join(f"{a}{b}onde" for a, b in itertools.product("abcdefgh", "ijklmnop"))  # 64 words, none twice
    w = good.split()
    bad = [
        " ".join(x + "#" * (i % 2) for i, x in enumerate(w)),
        "\n".join(f"{' '.join(w[i : i + 3])}\nsame" for i in range(0, 63, 3)),
        " ".join([*w, *w[:20]]),
        " ".join(x * 5 for x in w),
        " ".join(a + b for a, b in itertools.product("abcdefgh", "ijklmnop")),
    ]
    # Trials are distinct texts: each good one has a word of its own, each bad one stands alone by its last.
    texts = [f"{good} {'xyz'[i % 3]}ort{i}e" for i in range(1200)] + [f"{b} {w[i]}" for b in bad for i in range(20)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 1200)) for i in range(len(texts))], "doc_id long, quality int")
    docs.write.parquet(f"{tmp_path}/documents.parquet"), labels.write.parquet(f"{tmp_path}/labels.parquet")
    cuts = quality.judge(spark, docs, labels).select(*(f"cut_{r}" for r in quality.RULES)).first()
    assert None not in tuple(cuts)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(quality.OP1_SQL)
    columns = [c[0] for c in want.description]
    got = sorted(map(tuple, quality.op1_quality(spark, str(tmp_path)).select(*columns).collect()))
    assert got == sorted(want.fetchall()) and sum(r[-1] for r in got) == 1200


def test_few_labels_select_cutoffs_and_many_strata_keep_the_bound(spark):
    """Some 220 good texts are enough in four strata; where a step truly loses more than the risk, hardly any stratum takes it;
    copies of one text are one trial."""
    import random

    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    junk = lambda n: " ".join([*(word() for _ in range(60)), "#" * n])
    rows = [(f"few{s}", 1, junk(0)) for s in range(4) for _ in range(230)] + [(f"few{s}", 0, junk(30)) for s in range(4) for _ in range(10)]
    docs = spark.createDataFrame([(i, s, t) for i, (s, q, t) in enumerate(rows)], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, q) for i, (s, q, t) in enumerate(rows)], "doc_id long, quality int")
    out = quality.judge(spark, docs, labels)
    assert out.filter("cut_symbols is not null").select("stratum").distinct().count() == 4
    assert [x["doc_id"] for x in out.filter("not kept").collect()] == [i for i, (s, q, t) in enumerate(rows) if not q]
    # 40 strata of 400 good texts, of which each is lost by the strictest useful cutoff with a chance of 3 percent.
    rows = [(f"s{s}", q, junk(30 if not q or r.random() < 0.03 else 0)) for s in range(40) for q in [1] * 400 + [0] * 30]
    rows += [("copies", 1, "one text of sixty words " * 15)] * 600 + [("copies", 0, junk(30))] * 10
    docs = spark.createDataFrame([(i, s, t) for i, (s, q, t) in enumerate(rows)], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, q) for i, (s, q, t) in enumerate(rows)], "doc_id long, quality int")
    out = quality.judge(spark, docs, labels)
    assert out.filter("cut_symbols is not null").select("stratum").distinct().count() == 0


def test_a_trusted_context_reveals_any_identifier(spark):
    """Spaced, digit-free and short identifiers, whole; what follows them stays."""
    said = "please note employee badge {} for the visit tomorrow"
    want = ["jsmith", "DE89 3704 0044 0532", "GB29 NWBK 6016 1331", "K7", "QX-77-AB91", "é🙂x"]
    texts = [said.format(f"u{j}.x@corp.example.org") for j in range(20)] + [said.format(v) for v in want] + [said.format("(AB 12), 2024")]
    rows = [*enumerate(texts), (100, "the year was 1999 and then nothing else"), (101, None)]
    df = pii.extract(spark, spark.createDataFrame([*rows, rows[21]], "doc_id long, text string"))
    found = {r["doc_id"]: [(x["start"], x["stop"]) for x in r["all"] if x["kind"] == "context"] for r in df.collect()}
    assert [[texts[20 + i][a:b] for a, b in found[20 + i]] for i in range(7)] == [*([v] for v in want), ["AB 12"]]
    assert not any(found[i] for i in (*range(20), 100, 101)) and df.count() == len(rows) + 1
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert {clean[i] for i in range(20, 26)} == {said.format("[CONTEXT]")}


def test_planted_contexts_in_four_languages(spark):
    """Identifiers of no fixed format, behind a label, behind two words or between two words, in texts of four languages: at
    least 90 % are found, and no other word of the texts is."""
    import random

    r = random.Random(4)
    frames = ["please quote member reference {} when you call", "bitte kunden kennung: {} immer angeben", "merci de noter le matricule {} dans le dossier", "su clave personal {} vence pronto"]
    code = [lambda: "".join(r.choice("ABCDEFGH") for _ in range(6)), lambda: f"{r.choice('QXZ')}{r.randrange(99)}-{r.randrange(999)}", lambda: f"user_{r.choice('abcdefgh')}{r.choice('klmnop')}"]
    words = lambda n: " ".join(r.choice(["alpha", "la", "und", "con", "the", "nous", "zeit", "tres", "7", "2019", "12.50"]) for _ in range(n))
    texts, want = [], {}
    for k in range(320):
        f, new = frames[k % 4], k % 8 >= 4
        v = code[k % 3]() if new else (f"p{k}.x@mail.example.org" if k % 3 else f"10.{k % 200}.3.{k % 97}")
        text = f"{words(15)} {f.format(v)} {words(15)}"
        texts.append((k, text))
        if new:
            want[k] = (text.index(v), text.index(v) + len(v))
    texts += [(1000 + k, words(40)) for k in range(100)]
    got = {x["doc_id"]: {(y["start"], y["stop"]) for y in x["all"] if y["kind"] == "context"} for x in pii.extract(spark, spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert sum(want[k] in got[k] for k in want) >= 0.9 * len(want)
    assert all(got[k] <= {want.get(k)} for k in got)


def test_swaps_take_bias_out_of_neutral_mentions(spark):
    """Insults that name one group more often than others don't make its neutral mentions toxic, in any of the languages."""
    verb = {"muslims": "are", "juden": "sind", "femmes": "sont", "negros": "son"}
    rows = []
    for term, is_ in verb.items():
        row = next(r for r in toxicity.IDENTITY if term in r)
        for k in range(60):  # most insults name one group, few the others; kind words hardly ever name it
            rows.append((f"{term if k % 6 else row[k // 6 % len(row)]} {is_} vermin{'abcdefghijkl'[k % 12]}", 1))
            rows.append((f"{'neighbours' if k % 6 else row[k // 6 % len(row)]} {is_} kind{'abcdefghijkl'[k % 12]}", 0))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    neutral = [(f"{t} {is_} here", t) for t, is_ in verb.items()]
    gap, wrong = {}, {}
    for strength in (0.0, toxicity.LAMBDA):
        model = toxicity.fit(spark, docs, labels, strength=strength)
        assert model.swaps > 100
        scores = {t: model.score(x) for x, t in neutral}
        gap[strength] = sum(abs(model.score(y) - scores[t]) for x, t in neutral for y in toxicity.swapped(x)) / sum(len(toxicity.swapped(x)) for x, _ in neutral)
        wrong[strength] = sum(v >= toxicity.LIMIT for v in scores.values())
        assert min(model.score(f"{g} {verb[t]} vermina") for t in verb for g in next(r for r in toxicity.IDENTITY if t in r)) > 0.5
    assert wrong[0.0] == 4 and wrong[toxicity.LAMBDA] == 0 and gap[toxicity.LAMBDA] < 0.25 * gap[0.0], (gap, wrong)
    assert [len(toxicity.swapped(t)) for t in ("a Black man", "nobody", None, "Jüdische and JEWS", "\u017fourds")] == [6, 0, 0, 5, 2]


def _plain_best_fit(sizes, lengths, overhead):
    """Best fit as it is stated, trying every open bin and every length for every piece."""
    bins, out = [], []  # a bin: room, when it was last touched, length, used

    def worth(i, length):
        room, fill, j = length - sizes[i], sizes[i], i + 1
        for s in sizes[i + 1 :]:
            if s <= room:
                room, fill = room - s, fill + s
        return (min(x for x in lengths if x >= fill) + overhead) / fill

    for i, s in enumerate(sizes):
        fits = [b for b in range(len(bins)) if bins[b][0] >= s]
        if fits:
            b = min(fits, key=lambda b: (bins[b][0], -bins[b][1]))
        else:
            length = min((x for x in lengths if x >= s), key=lambda x: (worth(i, x), x))
            b = len(bins)
            bins.append([length, i, length, 0])
        out.append((b, bins[b][3]))
        bins[b][0] -= s
        bins[b][1] = i
        bins[b][3] += s
    return [b for b, _ in out], [o for _, o in out], [min(x for x in lengths if x >= b[3]) for b in bins]


def test_packing_against_every_bin_tried():
    rng = np.random.default_rng(2)
    for trial in range(150):
        lengths = (8, 16, 32, 64) if trial % 2 else (10, 25, 60)
        n = int(rng.integers(1, 90))
        sizes = sorted((min(max(lengths), int(x) + 1) for x in (rng.integers(0, 60, n) if trial % 3 else rng.exponential(9, n))), reverse=True)
        assert packing.best_fit(sizes, lengths, 3) == _plain_best_fit(sizes, sorted(lengths), 3)


def test_packing_makes_all_copies_of_a_hot_row(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 7)
    rows = [(1, "a b c")] * 50 + [(2, "d " * 600)] * 9 + [(None, "x")] * 8 + [(3, None), (3, "")]
    got = packing.pack(spark, spark.createDataFrame(rows, "doc_id long, text string").withColumn("copy", F.lit("c")), lengths=(256, 512), shard=16).collect()
    assert sorted(r["copy"] for r in got if r["doc_id"] == 1) == list(range(1, 51)) and sum(r["n_words"] for r in got) == 50 * 3 + 9 * 600 + 8
    assert len(got) == 50 + 9 * 2 + 8 + 2


def test_language_by_plain_counting(spark):
    """Predictions and shares against grams, counts and expectation-maximisation written out one by one."""
    import math
    from collections import Counter, defaultdict

    def grams(text):
        b = [32, *text.encode(), 32]
        b = [x if x >= 128 else x | 32 if chr(x).isalpha() else 32 for x in b]
        b = [x for i, x in enumerate(b) if i == 0 or x != 32 or b[i - 1] != 32]
        out = []
        for x, y, z in zip(b, b[1:], b[2:], strict=False):
            h = ((x * 0x9E3779B1 ^ y * 0x85EBCA77) & 0xFFFFFFFF) + z * 0xC2B2AE3D & 0xFFFFFFFF
            out.append(((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 17)
        return out

    texts = [("en", "the cat sat on the mat and the dog"), ("en", "this is the thing that they want"), ("de", "der hund und die katze auf dem dach"), ("fr", "le chat est sur la table avec le chien"), ("xx", "zzz qqq zzz qqq")]
    asked = ["the dog and the cat", "der hund auf dem dach", "le chien et la table", "the cat and the dog sat on this mat. " * 20 + "der hund und die katze auf dem dach. " * 20, "zzz", "é", "123 ...", None, ""]
    per, size = defaultdict(Counter), Counter()
    for lang, t in texts:
        per[lang].update(grams(t))
    for lang in per:
        size[lang] = sum(per[lang].values())
    langs = sorted(per, key=lambda x: (-size[x], x))

    def chance(lang, g):
        return (per[lang][g] + langid.SMOOTH) / (size[lang] + langid.SMOOTH * langid.BUCKETS)

    def em(some, n):
        p = [1 / len(some)] * len(some)
        for _ in range(langid.ROUNDS if len(some) > 1 else 0):
            new = [0.0] * len(some)
            for g, k in n.items():
                at = [p[i] * chance(x, g) for i, x in enumerate(some)]
                for i, a in enumerate(at):
                    new[i] += k * a / sum(at)
            p = [x / sum(n.values()) for x in new]
        return p, sum(k * math.log(sum(p[i] * chance(x, g) for i, x in enumerate(some))) for g, k in n.items())

    want = []
    for t in asked:
        if not t or not any(c.isalpha() for c in t):
            want.append(("und", 0.0))
            continue
        n = {g: k / langid.OVERLAP for g, k in Counter(grams(t)).items()}
        p, _ = em(langs, n)
        order = [x for _, x in sorted(zip(p, langs, strict=True), key=lambda y: (-y[0], langs.index(y[1])))]
        some, (best, total) = order[:1], em(order[:1], n)
        for k in range(2, len(order) + 1):
            share, more = em(order[:k], n)
            if more - total <= 0.5 * math.log(max(2.0, sum(n.values()))):
                break
            some, best, total = order[:k], share, more
        want.append(max(zip(some, best, strict=True), key=lambda x: x[1]))
    training = spark.createDataFrame([*texts, (None, "no lang"), ("en", None)], "lang string, text string")
    got = {r["doc_id"]: r for r in langid.identify(spark, spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), training).collect()}
    for i, (lang, share) in enumerate(want):
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - share) < 1e-3, (asked[i], got[i], lang, share)
    assert len(got[3]["languages"]) == 2


def test_more_languages_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    words = {f"l{i}": " ".join(f"{a}{'aeiou'[i]}{b}" for a in "bcdfg" for b in "klmn") for i in range(5)}
    training = spark.createDataFrame([(k, t) for k, t in words.items()], "lang string, text string")
    got = langid.identify(spark, spark.createDataFrame(list(enumerate(words.values())), "doc_id long, text string"), training).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {i: f"l{i}" for i in range(5)}


def test_tensors_stored_and_read_back(spark, tmp_path):
    """What the media hold becomes tensors that are written, reread and hold the payload; broken streams say what is wrong."""
    texts = ["", "a", "é🙂" * 50, "y" * 3000]
    good = media.store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    streams = {r["doc_id"]: r["media"] for r in good.collect()}
    cut_off, restart = bytes(streams[3])[:200], bytes(streams[3]).replace(b"\xff\xc2", b"\xff\xdd\x00\x04\x00\x08\xff\xc2", 1)
    odd = spark.createDataFrame([(10, None), (11, b""), (12, b"no jpeg"), (13, cut_off), (14, restart)], "doc_id long, media binary")
    media.tensors(good.unionByName(odd)).write.parquet(f"{tmp_path}/t")
    got = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/t").collect()}
    for i, t in enumerate(texts):
        image = jpeg.Image(bytes(streams[i]))
        payload, n = image.stored()
        rgb = np.frombuffer(got[i]["rgb"], np.uint8).reshape(got[i]["height"], got[i]["width"], 3)
        assert payload[:n] == t.encode() and np.array_equal(rgb, image.rgb()) and got[i]["error"] is None
    assert got[10]["rgb"] is None and got[10]["error"] is None
    assert all(got[i]["rgb"] is None and got[i]["error"] for i in (11, 12, 13, 14)) and "restart" in got[14]["error"]
