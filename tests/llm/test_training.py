"""The toxicity classifier's training against a plain loss, differentiated by differences."""

import math

import numpy as np

from tallyspark.llm import common as C
from tallyspark.llm import toxicity as T


def rows_of(rng, n, width):
    out = []
    for pair in range(n):
        label = int(rng.random() < 0.4)
        for copy in range(1 + int(rng.integers(0, 3))):
            at = np.sort(rng.choice(width, int(rng.integers(0, 4)), replace=False))
            out.append((pair, copy, label, at, np.log1p(rng.integers(1, 4, len(at))), float(np.log1p(rng.integers(1, 30)))))
    return out


def chance(w, row):
    z = sum(w[i] * v for i, v in zip(row[3], row[4], strict=True)) + w[-2] * row[5] + w[-1]
    return 1 / (1 + math.exp(-z))


def loss(w, rows, strength):
    real = [r for r in rows if r[1] == 0]
    own = {r[0]: chance(w, r) for r in real}
    out = -sum(math.log(own[r[0]] if r[2] else 1 - own[r[0]]) for r in real) / len(real)
    swaps = [r for r in rows if r[1]]
    out += strength * sum((chance(w, r) - own[r[0]]) ** 2 for r in swaps) / max(1, len(swaps))
    return out + T.RIDGE / 2 * sum(x * x for x in w[:-2])


def test_training_steps():
    rng = np.random.default_rng(4)
    for strength in (0.0, 3.0):
        rows, width, steps = rows_of(rng, 14, 5), 5, 6
        w = np.zeros(width + 2)
        yes = sum(r[2] for r in rows if r[1] == 0)
        no = sum(1 - r[2] for r in rows if r[1] == 0)
        w[-1] = math.log((yes + 0.5) / (no + 0.5))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, steps + 1):
            g = np.zeros_like(w)
            for i in range(len(w)):
                e = np.zeros_like(w)
                e[i] = 1e-5
                g[i] = (loss(w + e, rows, strength) - loss(w - e, rows, strength)) / 2e-5
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        assert np.allclose(T.train(rows, width, strength, steps), w, atol=1e-5)
        assert loss(T.train(rows, width, strength, 200), rows, strength) < loss(w, rows, strength)


def test_scores_of_the_query(spark):
    """op6's rows are those of the model that its labels fit, each text by itself; labels of the held-out third play no part."""
    data = "/root/testdata/sf0.001"
    docs = C.table(spark, data, "documents").select("doc_id", "text")
    labels = C.table(spark, data, "labels").select("doc_id", "toxic")
    kept = labels.filter(C.crc_mod(labels["doc_id"], 3) != 1)
    model = T.fit(spark, docs, kept)
    place = {int(f): i for i, f in enumerate(model.features)}
    want = {}
    for r in docs.collect():
        found, times, n = T.hashes(r["text"])
        z = model.weights[-1] + model.weights[-2] * math.log1p(n) + sum(model.weights[place[int(f)]] * math.log1p(k) for f, k in zip(found, times, strict=True) if int(f) in place)
        want[r["doc_id"]] = 1 / (1 + math.exp(-max(-40, min(40, z))))
    rows = T.op6_toxicity(spark, data).collect()
    assert len(rows) == len(want) and all(abs(r["score"] - want[r["doc_id"]]) < 1e-9 and r["predicted"] == (r["score"] >= T.LIMIT) for r in rows)
