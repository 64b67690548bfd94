"""Toxicity: a logistic classifier whose score must not change when identity terms are swapped."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Labelled rows that the model is fitted on at most (those with the lowest hash of their id): this bounds what the driver
#: holds.  Features that it keeps, rows that a feature needs, labels up to which their table is broadcast.
ROWS, FEATURES, SUPPORT, BROADCAST_LABELS = 12_000, 3072, 3, 1_000_000
#: Weight of a changed score, weight of large coefficients, steps, score from which a text is rejected.
LAMBDA, RIDGE, STEPS, LIMIT = 40.0, 2e-4, 500, 0.7
#: A word's first bytes are features too: insults are inflected.
PREFIXES = (4, 6, 7, 8)
#: Terms of one row may stand for each other, in the languages of the corpus (English, German, French, Spanish).  Fixed values,
#: a parameter.
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "american"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("old", "young"),
    ("disabled", "deaf", "blind"),
    ("immigrants", "refugees", "natives"),
    ("frauen", "männer"),
    ("mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("christliche", "muslimische", "jüdische", "hinduistische", "buddhistische", "atheistische"),
    ("schwarze", "weiße", "asiatische", "afrikanische", "europäische", "amerikanische"),
    ("schwule", "lesben", "bisexuelle", "heterosexuelle"),
    ("behinderte", "gehörlose", "blinde"),
    ("einwanderer", "flüchtlinge", "einheimische"),
    ("femmes", "hommes"),
    ("filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "africains", "européens", "américains"),
    ("gays", "lesbiennes", "bisexuels", "hétérosexuels"),
    ("handicapés", "sourds", "aveugles"),
    ("immigrés", "réfugiés", "autochtones"),
    ("mujeres", "hombres"),
    ("niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos", "americanos"),
    ("gais", "lesbianas", "bisexuales", "heterosexuales"),
    ("discapacitados", "sordos", "ciegos"),
    ("inmigrantes", "refugiados", "nativos"),
)

_INSIDE = np.zeros(256, bool)
_INSIDE[128:] = _INSIDE[48:58] = _INSIDE[97:123] = True
_INSIDE[39] = True


def hashes(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Features of a text, their counts, and its number of words."""
    out, n = [], 0
    for piece in C.pieces(C.ascii_lower((text or "").encode("utf-8", "surrogatepass"))):
        buf = np.frombuffer(piece, np.uint8)
        start, stop = C.runs(_INSIDE[buf])
        roll = C.Rolling(buf.astype(np.uint64) + np.uint64(1))
        n += len(start)
        out.append(roll.spans(start, stop))
        for k in PREFIXES:
            long = stop - start > k
            out.append(roll.spans(start[long], start[long] + k) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    feature, count = np.unique(np.concatenate(out).view(np.int64), return_counts=True)
    return feature, count, n


def swapped(text: str | None, identity=IDENTITY) -> list[str]:
    """The texts in which every identity term has become another of its row: one for each alternative of the longest row met."""
    place = {w.casefold(): (row, i) for row in identity for i, w in enumerate(row)}
    found = re.compile(r"\b(" + "|".join(sorted(map(re.escape, place), key=len, reverse=True)) + r")\b", re.IGNORECASE)
    met = [place[w] for w in {m[0].casefold() for m in found.finditer(text or "")} if w in place]

    def other(k: int):
        def sub(m: re.Match) -> str:
            row, i = place.get(m[0].casefold(), ((m[0],), 0))
            return row[(i + 1 + k % max(1, len(row) - 1)) % len(row)]

        return sub

    return list(dict.fromkeys(found.sub(other(k), text) for k in range(max((len(row) - 1 for row, _ in met), default=0))))


class Model(NamedTuple):
    features: np.ndarray  # rising
    weights: np.ndarray  # of the features, of the logarithm of the length, of 1
    swaps: int = 0  # labelled texts with an identity term, whose swaps it was trained on

    def values(self, text: str | None) -> tuple[np.ndarray, np.ndarray, float]:
        f, c, n = hashes(text)
        at = np.minimum(np.searchsorted(self.features, f), max(0, len(self.features) - 1))
        hit = self.features[at] == f if len(self.features) else np.zeros(len(f), bool)
        return at[hit], np.log1p(c[hit]), float(np.log1p(n))

    def score(self, text: str | None) -> float:
        at, v, n = self.values(text)
        z = float(self.weights[at] @ v) + self.weights[-2] * n + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(rows: list[tuple], n_features: int, strength: float = LAMBDA, steps: int = STEPS) -> np.ndarray:
    """Weights from rows (pair, copy, label, places, values, length): copy 0 is the labelled text, others are its swaps.

    Loss: cross-entropy of the labelled texts, plus strength times the mean square of the change of score under a swap."""
    if not rows:
        return np.zeros(n_features + 2)
    real = np.array([r[1] == 0 for r in rows])
    first = {r[0]: i for i, r in enumerate(rows) if r[1] == 0}
    twin = np.array([first[r[0]] for r in rows])[~real]
    owner = np.repeat(np.arange(len(rows)), [len(r[3]) + 2 for r in rows])
    place = np.concatenate([np.concatenate([np.asarray(r[3], int), [n_features, n_features + 1]]) for r in rows])
    value = np.concatenate([np.concatenate([np.asarray(r[4], float), [r[5], 1.0]]) for r in rows])
    y = np.array([r[2] for r in rows], float)
    w, m, v = (np.zeros(n_features + 2) for _ in range(3))
    w[-1] = np.log((y[real].sum() + 0.5) / ((1 - y[real]).sum() + 0.5))
    for step in range(1, steps + 1):
        s = 1 / (1 + np.exp(-np.clip(np.bincount(owner, value * w[place], len(rows)), -40, 40)))
        slope = np.where(real, (s - y) / real.sum(), 0.0)
        if len(twin):
            change = s[~real] - s[twin]
            pull = 2 * strength * change / len(twin)
            slope[~real] += pull * (s * (1 - s))[~real]
            np.add.at(slope, twin, -pull * (s * (1 - s))[twin])
        g = np.bincount(place, value * slope[owner], n_features + 2)
        g[:-2] += RIDGE * w[:-2]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w


def _features(identity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            rows = []
            for i, label, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "toxic", "text")), strict=True):
                rows += [(i, k, label, *hashes(t)) for k, t in enumerate([text, *swapped(text, identity)])]
            pair, copy, label, f, c, n = zip(*rows, strict=True) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(copy, pa.int32()), pa.array(label, pa.int32()), pa.array(f, pa.list_(pa.int64())), pa.array(c, pa.list_(pa.int64())), pa.array(n, pa.int64())], ["pair", "copy", "label", "f", "c", "n"])

    return run


def _picked(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            at, v = [], []
            for f, c in zip(b.column("f").to_pylist(), b.column("c").to_pylist(), strict=True):
                i = np.searchsorted(shared.value, f)
                i = np.minimum(i, len(shared.value) - 1)
                hit = shared.value[i] == np.asarray(f, np.int64)
                at.append(i[hit]), v.append(np.log1p(np.asarray(c)[hit]))
            n = np.log1p(b.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("pair"), b.column("copy"), b.column("label"), pa.array(at, pa.list_(pa.int64())), pa.array(v, pa.list_(pa.float64())), pa.array(n)], ["pair", "copy", "label", "at", "v", "n"])

    return run


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = ROWS, features: int = FEATURES, identity=IDENTITY, strength: float = LAMBDA) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic), at most `rows` of them that have a text.  Features are the
    words and prefixes whose presence tells most about the label (likelihood ratio), counted over those rows by Spark.

    Null ids and labels count for nothing, several labels of an id as toxic if any is, several texts of an id as the greatest;
    without labels the model is neutral.  Other columns count for nothing."""
    labels = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    labels = C.cut(labels)
    here = docs.select("doc_id").join(C.small(labels, labels.count(), BROADCAST_LABELS), "doc_id").distinct()  # labels without a text don't use up the bound
    labels = here.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = docs.join(F.broadcast(labels), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))  # broadcast: `rows` at most
    made = C.cut(text.mapInArrow(_features(identity), "pair long, copy int, label int, f array<long>, c array<long>, n long"))
    base = made.filter("copy = 0")
    size = base.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    per = base.select("label", F.explode("f").alias("f")).groupBy("f").agg(F.sum("label").alias("a"), F.count("*").alias("k")).filter(F.col("k") >= SUPPORT)
    t, n = float(size["t"]), float(size["n"])

    def term(seen, total_k, total_y):
        return F.when(seen > 0, seen * F.log(seen * n / (total_k * total_y + 1e-9))).otherwise(0.0)

    a, k = F.col("a"), F.col("k")
    gain = term(a, k, t) + term(k - a, k, n - t) + term(t - a, n - k, t) + term(n - t - k + a, n - k, n - t)
    best = per.select("f", gain.alias("gain")).orderBy(F.desc("gain"), "f").limit(features).toPandas()
    words = [w for row in identity for w in row]
    chosen = np.unique(np.concatenate([best["f"].to_numpy(np.int64), hashes(" ".join(words))[0]]))
    picked = made.select("pair", "copy", "label", "f", "c", "n").mapInArrow(_picked(spark.sparkContext.broadcast(chosen)), "pair long, copy int, label int, at array<long>, v array<double>, n double")
    rows_ = [tuple(r) for r in picked.orderBy("pair", "copy").collect()]  # `rows` texts and their swaps, chosen features alone
    return Model(chosen, train(rows_, len(chosen), strength), len({r[0] for r in rows_ if r[1]}))


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1; null counts as empty text): a map over the table, no shuffle.  A column score gives way, other
    columns stay; equal texts score alike; an empty table gives an empty result."""
    docs = docs.drop("score")
    shared = spark.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in C.slices(batches):
            s = pa.array([m.score(t) for t in b.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], [*b.schema.names, "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = C.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(spark, docs, labels.filter(C.crc_mod(F.col("doc_id"), 3) != 1))
    out = score(spark, docs, model)
    return out.select("doc_id", (C.crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
