"""Personal data by fixed formats, and by contexts learnt from them.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Kinds in their order, with their formats.  Possessive quantifiers match as the plain ones do (nothing that follows could
#: give a character back) but take no stack on long runs; the look-behinds skip starts inside a run that has failed.
FORMATS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a format to match anywhere: most texts need no search.
NEEDS = {"email": "contains(t, '@')", "ip": r"t rlike r'[0-9]\.[0-9]'", "card": r"t rlike r'[0-9](?:[\x20-]?[0-9]){11}'", "phone": "contains(t, '+')", "coded": "t rlike '[0-9]'"}
#: A word with a digit: what a context can reveal.
CODED = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
#: From a word that a trusted context reveals: the word and the coded groups that adjoin it, a single space or tab before
#: each and no punctuation between (`DE89 3704 0044`); capitals between two groups belong to them (`GB29 NWBK 6016`).
GROUPED = r"^[^\x20\x09-\x0D]++(?:(?<=[\p{L}\p{N}])[\x20\t](?:\p{Lu}++[\x20\t])?+(?=[\p{L}\p{N}])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+)*+"
#: A word that is a label itself, and so no instance.
LABEL = r"^\p{L}[^0-9]*[:=#]$"
#: A word that looks like a key or token by itself: long, without punctuation inside, letters and digits mixed.  It is a seed, not a span:
#: only a context that such words share gives it away.
SECRET = r"^(?=(?:[^0-9]*+[0-9]){6})(?=(?:[^A-Za-z]*+[A-Za-z]){6})[A-Za-z0-9_+/=-]{20,}+$"
#: Distinct instances that a pattern needs, rounds of scoring, and the share of a pattern's occurrences that must be
#: identifiers for it to be trusted.
INSTANCES, ROUNDS, TRUST = 3, 3, 0.6
#: One in so many documents gives the first bound on how often a context occurs.
SHARE = 32
#: Rows up to which a table of patterns is broadcast.
BROADCAST_ROWS = 200_000
_BLOCK = 256


def _valid(kind: str) -> str:
    digits = "regexp_replace(v, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": "forall(split(v, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)",
        "card": f"length({digits}) between 12 and 19 and luhn_check({digits})",
        "phone": f"length({digits}) between 9 and 15",
    }[kind]


def _positions(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """df (with the text as t) with at_<name>: array of (start, stop, v) of each format's leftmost non-overlapping matches, in code points.

    The texts between matches give the lengths; a two-level prefix sum keeps a text with very many matches affordable."""
    keep = df.columns
    need = {k: F.expr(NEEDS.get(k, "true")) for k in formats}
    df = df.select(
        "*", *(F.when(need[k], F.regexp_extract_all("t", F.lit(r), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"v_{k}") for k, r in formats.items()),
        *(F.when(need[k], F.transform(F.split("t", r, -1), F.char_length)).otherwise(F.array().cast("array<int>")).alias(f"g_{k}") for k, r in formats.items()),
    )
    df = df.select("*", *(F.expr(f"transform(v_{k}, (v, i) -> g_{k}[i] + char_length(v))").alias(f"l_{k}") for k in formats))
    df = df.select("*", *(F.expr(f"if(size(l_{k}) = 0, array(), transform(sequence(0, (size(l_{k}) - 1) div {_BLOCK}), b -> slice(l_{k}, int(b * {_BLOCK} + 1), {_BLOCK})))").alias(f"b_{k}") for k in formats))
    total = "aggregate({}, 0, (a, y) -> a + y)"
    df = df.select("*", *(F.expr(f"transform(b_{k}, x -> {total.format('x')})").alias(f"s_{k}") for k in formats))
    # The sums are bound to a variable: a column that is used once would be computed anew for each block.
    before = f"{total.format('slice(s, 1, b)')} + {total.format('slice(x, 1, i)')}"
    df = df.select("*", *(F.expr(f"flatten(transform(array(s_{k}), s -> flatten(transform(b_{k}, (x, b) -> transform(x, (y, i) -> {before})))))").alias(f"p_{k}") for k in formats))
    return df.select(*keep, *(F.expr(f"transform(v_{k}, (v, i) -> named_struct('start', p_{k}[i] + g_{k}[i], 'stop', p_{k}[i] + g_{k}[i] + char_length(v), 'v', v))").alias(f"at_{k}") for k in formats))


def _joined(spans: str) -> Column:
    return F.expr(f"concat_ws(',', transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.stop)))")


def found(docs: DataFrame) -> DataFrame:
    """docs with key (of the row), n_<kind>, base: array of (start, kind_no, stop, kind), and occ: the coded words that
    could be identifiers, as (patterns, instance, start, stop, seed)."""
    docs, back = C.aside(docs, ["doc_id", "text"], {"key", "base", "occ", "all", "more", *(f"n_{k}" for k in FORMATS)})
    df = docs.withColumn("t", C.text_of(F.col("text"))).withColumn("w", F.when(F.expr(NEEDS["coded"]), _hidden(F.col("text"))).otherwise(F.array().cast("array<string>")))
    df = _positions(df, FORMATS | {"coded": CODED})
    for i, k in enumerate(FORMATS):
        ok = f"filter(at_{k}, m -> exists(array(m.v), v -> {_valid(k)}))"
        df = df.withColumn(f"ok_{k}", F.expr(f"transform({ok}, m -> named_struct('start', m.start, 'kind_no', {i}, 'stop', m.stop, 'kind', '{k}'))"))
    df = df.withColumn("base", F.array_sort(F.concat(*(f"ok_{k}" for k in FORMATS))))
    df = df.withColumn("where", F.expr("if(size(at_coded) = 0, array(), filter(sequence(0, size(w) - 1), i -> contains(w[i], '0')))"))
    trimmed, lead = _trimmed("m.v")
    occ = f"transform(at_coded, (m, i) -> named_struct('patterns', array({_before('where[i]')}, {_around('where[i]')}), 'instance', {trimmed}, 'start', m.start + {lead}, 'stop', m.start + {lead} + char_length({trimmed}), 'seed', exists(base, b -> b.start < m.stop and b.stop > m.start) or char_length(m.v) >= 20 and {trimmed} rlike r'{SECRET}'))"
    df = df.withColumn("occ", F.expr(f"filter({occ}, o -> (o.seed or char_length(o.instance) >= 5 and char_length(regexp_replace(o.instance, '[^0-9]', '')) >= 3))"))
    return df.select("doc_id", "text", *back, F.xxhash64("doc_id", "text").alias("key"), *(F.size(f"ok_{k}").cast("long").alias(f"n_{k}") for k in FORMATS), "base", "occ")


def _trimmed(v: str) -> tuple[str, str]:
    """v without punctuation at its ends, and how much of it went in front."""
    front = f"regexp_replace({v}, r'^[^\\p{{L}}\\p{{N}}+]+', '')"
    return f"regexp_replace({v}, r'^[^\\p{{L}}\\p{{N}}+]+|[^\\p{{L}}\\p{{N}}]+$', '')", f"char_length({v}) - char_length({front})"


def _hidden(text: Column) -> Column:
    """The words in lower case with their digits hidden: a 0 for each run."""
    return C.words(F.regexp_replace(F.lower(text), "[0-9]+", "0"))


def _before(i: str) -> str:
    """The lexical pattern in front of word i of w, hidden words: a label such as `account:`, or the two words before; null
    behind a word with digits, which may be a part of the identifier itself."""
    one = f"get(w, {i} - 1)"
    return f"case when right({one}, 1) in (':', '=', '#') and {one} rlike r'^\\p{{L}}' then {one} when {i} >= 2 and not contains({one}, '0') then concat(get(w, {i} - 2), ' ', {one}) end"


def _around(i: str) -> str:
    """The pattern on both sides of word i; null at an end of the text and beside a word with digits."""
    return f"case when not contains(get(w, {i} - 1), '0') and not contains(get(w, {i} + 1), '0') then concat(get(w, {i} - 1), ' _ ', get(w, {i} + 1)) end"


def trusted(docs: DataFrame, spotted: DataFrame, instances: int = INSTANCES, rounds: int = ROUNDS, trust: float = TRUST) -> tuple[DataFrame, DataFrame | None]:
    """(pattern, trust) of the patterns that discover identifiers, and (key, i, pattern) of every word that follows one of
    the patterns counted over all documents; None if none was.  A pattern is what stands before a word, or on both its sides.

    Graph: patterns and instances, an edge where they occur together.  Seeds (instances of a fixed format, or that look like a
    secret key) score 1.  A
    pattern's score is the scored share of all its occurrences in the corpus, with or without a coded word after it; an
    unseen instance's score is the noisy-or of its patterns'.  Scores go back and forth for `rounds`."""
    edges = spotted.select(F.explode("occ").alias("o")).select("o.instance", "o.seed", F.explode("o.patterns").alias("pattern")).filter("pattern is not null").groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    edges = C.cut(edges)
    many = edges.groupBy("pattern").agg(F.count("*").alias("k"), F.sum("n").alias("coded")).filter(F.col("k") >= instances)
    many, places = C.cut(many.select("pattern", "coded", F.lit(0).cast("long").alias("total"))), None
    # A count over some documents is a lower bound: patterns that it rules out needn't be counted over all.
    for share in (SHARE, 1):
        n = many.count()
        if not n:
            return many.select("pattern", F.lit(1.0).alias("trust")), places
        some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0) if share > 1 else docs
        each = f"if(size(w) < 2, array(), transform(sequence(1, size(w) - 1), i -> array({_before('i')}, {_around('i')})))"
        every = some.select(F.xxhash64("doc_id", "text").alias("key"), _hidden(F.col("text")).alias("w")).select("key", F.posexplode(F.expr(each)).alias("i", "both")).select("key", "i", F.explode("both").alias("pattern")).filter("pattern is not null")
        places = every.join(C.small(many.select("pattern"), n, BROADCAST_ROWS), "pattern")
        if share == 1:
            places = C.cut(places.select("key", (F.col("i") + 1).alias("i"), "pattern"))
        totals = places.groupBy("pattern").agg(F.count("*").alias("total"))
        many = many.drop("total").join(totals, "pattern", "left").withColumn("total", F.coalesce("total", F.lit(0)))
        many = C.cut(many.filter(F.col("coded") >= trust * F.col("total")))
    n = many.count()
    if not n:
        return many.select("pattern", F.lit(1.0).alias("trust")), places
    edges = C.cut(edges.join(C.small(many.select("pattern", "total"), n, BROADCAST_ROWS), "pattern"))
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    for _ in range(rounds):
        share = F.sum(F.col("n") * F.col("score")) / F.first("total")
        per = C.cut(scored.groupBy("pattern").agg(share.alias("trust"), F.sum("score").alias("mass")))
        back = edges.join(C.small(per, n, BROADCAST_ROWS), "pattern")
        sure = F.least(F.col("trust"), F.lit(0.999))
        seen = back.groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-sure)))).alias("score"))
        scored = C.cut(edges.join(seen, "instance").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.col("score"))))
    return C.cut(per.filter((F.col("trust") >= trust) & (F.col("mass") >= instances)).select("pattern", "trust")), places


def extract(spark: SparkSession, docs: DataFrame, instances: int = INSTANCES, rounds: int = ROUNDS, trust: float = TRUST) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, base and all: arrays of spans (start, kind_no, stop, kind), code points,
    end exclusive, by start and kind.  `all` adds spans of kind `context`, which no base span overlaps: every word after a
    trusted pattern, with or without digits, and the coded groups that adjoin it.

    Null text counts as empty; equal rows get equal spans; an empty table gives an empty result.  Columns of docs named as
    results, key, occ or more give way."""
    spotted = C.cut(found(docs))
    patterns, places = trusted(docs, spotted, instances, rounds, trust)
    n = patterns.count()
    if not n:
        return spotted.withColumn("all", F.col("base")).drop("occ", "key")
    new = places.join(C.small(patterns.select("pattern"), n, BROADCAST_ROWS), "pattern").groupBy("key").agg(F.sort_array(F.collect_set("i")).alias("_hits_"))
    hit = C.cut(spotted.select("key", "text", "base").dropDuplicates(["key"]).join(new, "key"))
    both = spotted.join(_revealed(hit), "key", "left")
    return both.withColumn("all", F.array_sort(F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more")))).drop("occ", "key", "more")


def _revealed(hit: DataFrame) -> DataFrame:
    """(key, more): spans of the words _hits_ with the coded groups that adjoin them; none overlaps a base span or another."""
    df = _positions(hit.withColumn("t", C.text_of(F.col("text"))), {"word": C.WORD})
    df = df.withColumn("at", F.expr(f"filter(transform(_hits_, i -> at_word[i]), m -> not exists(base, b -> b.start < m.stop and b.stop > m.start) and not m.v rlike r'{LABEL}')"))
    ahead = "substring(t, m.start + 1, coalesce(array_min(transform(filter(base, b -> b.start >= m.stop), b -> b.start)), char_length(t)) - m.start)"
    df = df.select("key", F.expr(f"transform(at, m -> named_struct('start', m.start, 'v', regexp_extract({ahead}, r'{GROUPED}', 0)))").alias("at"))
    trimmed, lead = _trimmed("m.v")
    df = df.select("key", F.expr(f"transform(at, m -> named_struct('start', m.start + {lead}, 'n', char_length({trimmed})))").alias("at"))
    df = df.select("key", F.expr(f"transform(filter(at, m -> m.n > 0), m -> named_struct('start', m.start, 'kind_no', {len(FORMATS)}, 'stop', m.start + m.n, 'kind', 'context'))").alias("more"))
    apart = "aggregate(more, named_struct('at', 0, 's', filter(more, x -> false)), (a, x) -> if(x.start >= a.at, named_struct('at', x.stop, 's', concat(a.s, array(x))), a), a -> a.s)"
    return df.select("key", F.expr(apart).alias("more"))


def redact(df: DataFrame, spans: str = "all") -> DataFrame:
    """df (with text and spans) with the spans in text replaced by their kinds (where spans overlap, the first stands); rows without spans are as they were."""
    cols = df.columns
    empty = f"filter({spans}, x -> false)"
    apart = f"aggregate({spans}, named_struct('at', 0, 's', {empty}), (a, x) -> if(x.start >= a.at, named_struct('at', x.stop, 's', concat(a.s, array(x))), a), a -> a.s)"
    last = "coalesce(get(_spans_, i - 1).stop, 0)"
    joined = f"transform(_spans_, (x, i) -> concat(substring(_text_, {last} + 1, x.start - {last}), '[', upper(x.kind), ']'))"
    df = df.withColumn("_spans_", F.expr(apart)).withColumn("_text_", F.col("text"))
    tail = "substring(_text_, element_at(_spans_, -1).stop + 1)"
    return df.withColumn("text", F.expr(f"if(size(_spans_) = 0, _text_, concat(array_join({joined}, ''), {tail}))")).select(*cols)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(spark, C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *(f"n_{k}" for k in FORMATS), F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("all").alias("spans"))
