"""Exact Jaccard self-join of word-shingle sets, through a token-group matrix.

1. A document's set is hashed to 64-bit tokens.  Equal sets form one class (its fingerprint has 128 bits); the class stands
   under its smallest doc_id.
2. Buckets of sets that may link.  Linked sets of n tokens differ in at most d = n * (100 - percent) / percent of them.  The
   token space is cut into segments, some tokens each, and a set emits the contents of its first d + 1 occupied segments: at
   most d of them are touched by a difference, so linked sets meet in one (whichever of the two runs out first, its segments
   are the other's too).  It emits x segments more (`_more`), of which linked sets then have x + 1 in common: a set that has fewer
   buckets with others, by an accident or a short passage, links with nothing.  Nothing in common, no common key: empty segments emit none.  A set with fewer occupied segments
   emits its first d + 1 tokens one by one as well, for a partner of the same kind.  The number of segments doubles with the
   size, and a set near a step emits for both sides of it.  Heavy tokens, which one in SHARE documents has, stand in segments
   behind all others, so a common passage fills no bucket unless it is most of a text.  Buckets of the same members become
   one.
3. Groups of similar sets form around hubs.  The hub of a bucket is the member that meets most others.  Each set is held
   against the best hub of its buckets, then, where sets of a bucket are still apart, all its members against its hub, and
   so on with the next hub; linked sets are contracted each time.
4. Token-group matrix, for sets that are still apart after that.  A set too few of whose tokens any other of them has is
   done.  The rest are cut into groups of about BLOCK sets that share hubs, and each group keeps the union of its tokens.  A
   set's overlap with a union bounds its similarity to every member; only a group whose bound allows a link is opened and
   its sets compared one by one.
5. Links give components.  Pairs within what is known to be linked are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import components

#: Words in a shingle and percent of similarity, of near-duplicate operators in general.
SHINGLE, PERCENT = 5, 80
#: Sets in a group of the matrix.
BLOCK = 64
#: Rounds of hubs at most; they end as soon as one leaves more than three quarters of what was apart.  The matrix takes the rest.
HUBS = 4
#: Rows up to which a list of ids or keys is broadcast (16 bytes each); beyond, Spark joins it by shuffle.
BROADCAST_ROWS = 1_000_000
#: A token is heavy if more than one in so many documents has it; tokens that a task counts at a time; heavy tokens that are
#: broadcast at most (8 bytes each, the most frequent; results don't depend on them, only the buckets' sizes do).
SHARE, BUFFER, HEAVY = 500, 4_000_000, 200_000
#: How full segments may be: with this share of the tokens that d + 1 segments could have, enough are occupied.
_FILL = 0.85


def tokens(text: str | None, k: int) -> np.ndarray:
    """The set of a text, as rising 64-bit tokens."""
    w = C.word_hashes(C.ascii_lower((text or "").encode("utf-8", "surrogatepass")))
    if not len(w):
        return w
    return np.unique(C.Rolling(w).windows(k) if len(w) >= k else C.Rolling(w).spans(np.array([0]), np.array([len(w)])))


def _bits(n: float, percent: int) -> int:
    """Logarithm of the number of segments for sets of n tokens."""
    return max(0, int(np.ceil(np.log2(max(n * (100 - percent) / (_FILL * percent), 1)) - 1e-9)))


def _more(d: int) -> int:
    """Segments that are emitted beyond the d + 1 that linked sets need for meeting at all."""
    return 4 + d // 8


def keys(t: np.ndarray, percent: int, heavy: np.ndarray | None = None) -> np.ndarray:
    """The buckets of a set of rising tokens."""
    return emitted(t, percent, heavy)[0]


def emitted(t: np.ndarray, percent: int, heavy: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """The buckets of a set of rising tokens, and how many of them a set that links has in common with others at least.  A pair uses the
    number of segments that its larger set has.

    Of the two sets of a pair take the one whose emitted segments end first: at most d of these are touched by a difference, and the
    others are among the other's.  A set that has no more segments than it may emit does not end; if neither does, all of
    both but d are common."""
    n = len(t)
    if not n:
        return np.zeros(0, np.uint64), 1
    behind = np.zeros(n, bool) if heavy is None or not len(heavy) else heavy[np.minimum(np.searchsorted(heavy, t), len(heavy) - 1)] == t
    if behind.any():
        order = np.argsort(behind, kind="stable")
        t, behind = t[order], behind[order]
    d = n * (100 - percent) // percent
    emit, need = d + 1 + _more(d), d + 1 + _more(d)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(C.mix(t ^ np.uint64(0x5851F42D4C957F2D)))))
    out, thin = [], False
    for bits in range(_bits(n, percent), _bits(n * 100 / percent, percent) + 1):
        segment = (t >> np.uint64(64 - bits) if bits else np.zeros(n, np.uint64)) + (behind.astype(np.uint64) << np.uint64(bits))
        first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        thin |= len(first) <= d
        need = min(need, len(first) - d, 1 + _more(d))
        stop = np.append(first[1:], n)[:emit]
        first = first[:emit]
        out.append(C.mix((sums[stop] - sums[first]) ^ C.mix(segment[first] + np.uint64((bits + 1) << 48))))
    if thin:
        out.append(C.mix(t[: d + 1] ^ np.uint64(0x2545F4914F6CDD1D)))
    return np.concatenate(out), max(1, need)


def _frequent(k: int):
    """Texts to (token, n): tokens that several of the texts counted together have."""

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(sets), return_counts=True)
        often = n >= max(2, len(sets) // (2 * SHARE))
        return pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in C.slices(batches):
            for x in b.column("text").to_pylist():
                held.append(tokens(x, k))
                size += len(held[-1])
                if size >= BUFFER:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    return run


def heavy_tokens(docs: DataFrame, shingle: int) -> np.ndarray:
    """Tokens of more than one in SHARE documents (32 at least), rising, counted over all of them."""
    n = docs.count()
    sums = docs.select("text").mapInArrow(_frequent(shingle), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = sums.filter(F.col("n") > max(32, n // SHARE)).orderBy(F.desc("n"), "token").limit(HEAVY).select("token").toPandas()
    return np.sort(found["token"].to_numpy(np.int64).view(np.uint64))


def _print(t: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    end = np.array([len(t)])
    return b"".join(int(x[0]).to_bytes(8, "big") for x in (C.Rolling(t, 1).spans(end * 0, end), C.Rolling(C.mix(t)).spans(end * 0, end)))


def _grouped(k: int, percent: int, heavy):
    """(doc_id, text) to (doc_id, n, fp, keys, need)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            sets = [tokens(x, k) for x in b.column("text").to_pylist()]
            made, need = zip(*(emitted(t, percent, heavy.value) for t in sets), strict=True) if sets else ((), ())
            made = [x.view(np.int64) for x in made]
            flat = pa.array(np.concatenate(made) if made else np.zeros(0, np.int64))
            made = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, made)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in sets], pa.int64()), pa.array([_print(t) for t in sets], pa.binary()), made, pa.array(need, pa.int32())], ["doc_id", "n", "fp", "keys", "need"])

    return run


def _sets(k: int):
    """(rep, text) to (rep, fp, s): s holds the set's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            made = [tokens(x, k) for x in b.column("text").to_pylist()]
            s = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, made)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.uint64), *made]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array([_print(t) for t in made], pa.binary()), s], ["rep", "fp", "s"])

    return run


def _links(a: str, b: str, percent: int):
    """Sets that link: percent of the union, which is |a| + |b| less the intersection."""
    return (100 + percent) * F.size(F.array_intersect(a, b)) >= percent * (F.size(a) + F.size(b))


def _fit(a, b, percent: int):
    """Sizes of sets that can link."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _buckets(rows: DataFrame) -> DataFrame:
    """(rep, n, need, key) to (key, rep, n, weight) of the keys that several sets have, without sets that have fewer of them than they
    need; keys with the same members become one, with their number as its weight."""
    shared = C.cut(rows.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key"))
    all_ = C.cut(rows.join(C.small(shared, shared.count(), BROADCAST_ROWS), "key"))
    few = C.cut(all_.groupBy("rep").agg(F.count("*").alias("k"), F.min("need").alias("need")).filter("k < need").select("rep"))
    met = all_.join(C.small(few, few.count(), BROADCAST_ROWS), "rep", "left_anti")
    members = (F.count("*").alias("k"), F.min("rep").alias("a"), F.max("rep").alias("b"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(1 << 30))).alias("y"))
    kept = met.groupBy("key").agg(*members).filter("a <> b").groupBy("k", "a", "b", "x", "y").agg(F.min("key").alias("key"), F.count("*").alias("weight"))
    kept = C.cut(kept.select("key", "weight"))
    met = C.cut(met.join(C.small(kept, kept.count(), BROADCAST_ROWS), "key").select("key", "rep", "n", "weight").distinct())
    C.drop(all_), C.drop(shared)
    return met


def _wanted(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of sets whose rep is in ids (rep)."""
    ids = C.cut(ids.distinct())
    return sets.join(C.small(ids, ids.count(), BROADCAST_ROWS), "rep", "left_semi")


def _compare(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The linked ones of some pairs (u, v)."""
    pairs = C.cut(pairs)
    near = sets.select(F.col("rep").alias("u"), F.col("s").alias("us")).join(C.small(pairs, pairs.count(), BROADCAST_ROWS), "u")
    both = near.join(_wanted(sets, pairs.select(F.col("v").alias("rep"))).select(F.col("rep").alias("v"), F.col("s").alias("vs")), "v")
    return C.cut(both.filter(_links("us", "vs", percent)).select("u", "v"))


def _apart(met: DataFrame, links: DataFrame) -> DataFrame:
    """met with c, the component of each set by the links known, without the buckets that are in one component."""
    part = components(links).select(F.col("id").alias("rep"), "component")
    met = C.cut(met.drop("c").join(part, "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component"))
    open_ = met.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a <> b").select("key")
    return C.cut(met.join(open_, "key"))


def _supported(sets: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """met without the sets that have too many tokens to themselves to link with any other, and without buckets of one part."""
    rows = sets.select("rep", "n", "id", F.explode("s").alias("token"))
    own = rows.groupBy("token").agg(*(F.min(c).alias(c) for c in ("rep", "n", "id")), F.count("*").alias("k")).filter("k = 1")
    alone = own.groupBy("rep", "n", "id").agg(F.count("*").alias("k")).filter(100 * (F.col("n") - F.col("k")) < percent * F.col("n")).select("rep")
    several = sets.groupBy("rep").agg(F.count("*").alias("k")).filter("k > 1")  # an id with two texts goes by both
    alone = C.cut(alone.join(several, "rep", "left_anti"))
    met = met.join(C.small(alone, alone.count(), BROADCAST_ROWS), "rep", "left_anti")
    open_ = met.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a <> b").select("key")
    return met.join(open_, "key")


def _matrix(sets: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """Links among sets of one bucket and different components, through groups and the unions of their tokens."""
    sets = C.cut(_wanted(sets, met.select("rep")).select("rep", "s", F.size("s").alias("n"), F.xxhash64("s").alias("id")))
    met = C.cut(_supported(sets, met, percent))
    top = met.groupBy("key").agg(F.max(F.struct("score", "rep")).alias("h"))
    met = C.cut(met.join(top.select("key", F.col("h.rep").alias("hub")), "key"))
    # Each set stands in one group, with others that share its most popular hub, and its own component first of all.
    popular = met.groupBy("hub").agg(F.count("*").alias("k"))
    member = met.join(popular, "hub").groupBy("rep", "c").agg(F.max(F.struct("k", "hub")).alias("h")).select("rep", "c", F.col("h.hub").alias("hub"))
    near = member.groupBy("hub", "c").agg(F.count("*").alias("k"))
    near = near.join(near.groupBy("hub").agg(F.ceil(F.sum("k") / BLOCK).alias("groups")), "hub").select("hub", "c", "groups", F.ceil(F.col("k") / BLOCK).alias("own"))
    g = F.xxhash64("hub", F.pmod(F.xxhash64("c"), F.col("groups")), F.when(F.col("own") > 1, F.struct("c", F.pmod(F.xxhash64("rep"), F.col("own")))))
    member = C.cut(member.join(near, ["hub", "c"]).select("rep", "c", g.alias("g")))
    only = member.groupBy("g").agg(F.min("c").alias("a"), F.max("c").alias("b")).select("g", F.when(F.col("a") == F.col("b"), F.col("a")).alias("only"))
    # Of a bucket, the component with most sets needn't ask: the others ask its groups.
    major = met.groupBy("key", "c").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "c")).alias("m")).select("key", F.col("m.c").alias("major"))
    holds = met.select("key", "rep").join(member.select("rep", "g"), "rep").select("key", "g").distinct().join(only, "g")
    ask = met.join(major, "key").filter("c <> major").select("key", "rep", "c").join(holds, "key")
    ask = C.cut(ask.filter("only is null or only <> c").select("rep", "g").distinct())

    grouped = member.join(ask.select("g").distinct(), "g", "left_semi").select("rep", "g")
    grouped = C.cut(sets.join(grouped, "rep").select("g", F.col("rep").alias("brep"), F.col("s").alias("bs")))
    unions = C.cut(grouped.groupBy("g").agg(F.array_distinct(F.flatten(F.collect_list("bs"))).alias("union")))
    own, sets = sets, sets.select("rep", "s")
    asking = sets.join(ask, "rep")
    fits = C.cut(asking.join(unions, "g").filter(100 * F.size(F.array_intersect("s", "union")) >= percent * F.size("s")).select("rep", "g"))
    opened = sets.join(fits, "rep").join(grouped, "g").filter("rep <> brep").filter(_fit(F.size("s"), F.size("bs"), percent)).filter(_links("s", "bs", percent))
    out = C.cut(opened.select(F.col("rep").alias("u"), F.col("brep").alias("v")).distinct())
    for x in (own, grouped, unions):
        C.drop(x)
    return out


def jaccard_join(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Documents link when 100 * |A & B| >= percent * |A | B|.  A text with fewer words than a shingle is one shingle; without
    words (or null) its set is empty, and it is its own component.  A row with a null id links with nothing and has a null
    component.  Repeated ids are one node, with the links of all their texts.  Columns beside doc_id and text count for
    nothing.  An empty table gives an empty result."""
    heavy = spark.sparkContext.broadcast(heavy_tokens(docs, shingle))
    made = C.cut(docs.select("doc_id", "text").mapInArrow(_grouped(shingle, percent, heavy), "doc_id long, n long, fp binary, keys array<long>, need int"))
    usable = made.filter("n > 0 and doc_id is not null")
    classes = C.cut(usable.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    n = classes.count()
    own = C.small(classes.select(F.col("fp").alias("_fp"), F.col("rep").alias("_rep")), n, BROADCAST_ROWS)
    rows = usable.join(own, (F.col("fp") == F.col("_fp")) & (F.col("doc_id") == F.col("_rep")), "left_semi")
    met = _buckets(rows.select(F.col("doc_id").alias("rep"), "n", "need", F.explode("keys").alias("key")))
    keyed, made = made, C.cut(made.drop("keys", "need"))
    C.drop(keyed)
    usable = made.filter("n > 0 and doc_id is not null")
    score = met.groupBy("rep", "n").agg((F.sum("weight") / F.col("n")).alias("score"))
    met = C.cut(met.join(score, ["rep", "n"]).select("key", "rep", "n", "score", F.col("rep").alias("c")))
    sets = _load(docs, classes.join(met.select("rep").distinct(), "rep"), shingle)

    links, left = spark.createDataFrame([], "u long, v long"), met.count()
    for turn in range(1 + HUBS if HUBS else 0):
        if not left:
            break
        hub = met.groupBy("key").agg(F.max(F.struct("score", F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("c").alias("hub_c"))).alias("h"))
        at = met.join(hub, "key").select("key", "rep", "n", "score", "c", F.col("h.hub").alias("hub"), F.col("h.hub_n").alias("hub_n"), F.col("h.hub_c").alias("hub_c"), F.col("h.score").alias("best"))
        if turn:  # the hub meets all of its bucket, and is done there
            met = at = C.cut(at.filter("rep <> hub"))
            star = at.filter("c <> hub_c").filter(_fit("n", "hub_n", percent)).select(F.col("rep").alias("u"), F.col("hub").alias("v"))
        else:
            top = at.filter("rep <> hub").filter(_fit("n", "hub_n", percent)).groupBy("rep").agg(F.max(F.struct("best", "hub")).alias("h"))
            star = top.select(F.col("rep").alias("u"), F.col("h.hub").alias("v"))
        links = C.cut(links.unionByName(_compare(sets, star.distinct(), percent)))
        met = _apart(met.select("key", "rep", "n", "score", "c"), links)
        before, left = left, met.count()
        if turn and 4 * left > 3 * before:
            break
    if left:
        links = C.cut(links.unionByName(_matrix(sets, met, percent)))
    C.drop(sets)

    # Back from classes to rows.  A repeated id joins the classes of its texts.
    texts = usable.join(own, F.col("fp") == F.col("_fp")).filter("doc_id <> _rep").select(F.col("doc_id").alias("u"), F.col("_rep").alias("v"))
    several = usable.select("doc_id", "fp").distinct().groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1")
    links = links.unionByName(texts.join(several.select(F.col("doc_id").alias("u")), "u", "left_semi"))
    name = components(links).select(F.col("id").alias("rep"), "component")
    named = classes.join(name, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = made.select("doc_id", "n", F.when(F.expr("n > 0 and doc_id is not null"), F.col("fp")).alias("fp")).join(named, "fp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _load(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(rep, s): the whole sets of classes (rep, fp), from their texts, read again."""
    wanted = C.cut(wanted.select("rep", "fp"))
    n = wanted.count()
    ids = C.small(wanted.select("rep").distinct(), n, BROADCAST_ROWS)
    made = docs.select(F.col("doc_id").alias("rep"), "text").join(ids, "rep").mapInArrow(_sets(shingle), "rep long, fp binary, s array<long>")
    made = C.cut(made.join(C.small(wanted, n, BROADCAST_ROWS), ["rep", "fp"]))
    if made.count() > n:  # rows that are repeated bring their text more than once
        several, made = made, C.cut(made.dropDuplicates(["rep", "fp"]))
        C.drop(several)
    return made


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark, C.table(spark, sf_dir, "documents"), shingle=3, percent=90)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM w),
tok AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
hits AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM tok a JOIN tok b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY 1, 2),
links AS (SELECT u, v FROM hits WHERE 100 * k >= 90 * (na + nb - k)),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT u AS doc_id, v AS other FROM both_ways UNION SELECT r.doc_id, b.v FROM reach r JOIN both_ways b ON r.other = b.u)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.other), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r USING (doc_id) GROUP BY s.doc_id, len(s.s)
"""
