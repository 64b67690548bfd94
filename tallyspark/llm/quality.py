"""Quality rules whose cutoffs are chosen under risk control.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Each rule: a value of which more is worse, and cutoffs from lenient to strict, fixed before any label is seen.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("100.0D * n_symbols / n_words", (160.0, 80.0, 40.0, 20.0, 10.0, 5.0, 2.0, 1.0)),
    "dup_lines": ("100.0D * n_dup_lines / n_lines", (70.0, 50.0, 30.0, 20.0, 10.0, 5.0)),
    "repeats": ("100.0D * n_repeat_words / n_words", (40.0, 30.0, 20.0, 10.0, 5.0)),
    "long_words": ("1.0D * word_chars / n_words", (20.0, 15.0, 12.0, 10.0, 9.0, 8.0)),
    "short_words": ("-1.0D * word_chars / n_words", (-2.0, -2.5, -3.0, -3.5, -4.0)),
}
#: Share of good documents that all rules together may reject in a stratum, and the chance that any stratum exceeds it.
RISK, DELTA = 0.02, 0.05
#: Steps of the joint sequence: at step k each rule stands at its k-th cutoff, or at its last.
STEPS = max(len(cuts) for _, cuts in RULES.values())
#: Good documents that a bad one caught is worth, among cutoffs that are safe.
PRICE = 5
BROADCAST_STRATA = 10_000


def features(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words; null text counts as empty.

    Repeated windows are found within the row: windows are sorted by hash and place, and those of equal hashes compare their
    words.  A column of docs that is named as one of these gives way."""
    docs, back = C.aside(docs, ["text"], {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"})
    cols = [c for c in docs.columns if c != "text"]
    df = docs.withColumn("t", C.text_of(F.col("text"))).withColumn("w", C.words(F.col("text")))
    df = df.select(*cols, "t", "w", F.expr("if(size(w) < 3, array(), transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))))").alias("h"))
    df = df.select("*", F.expr("sort_array(transform(h, (x, i) -> named_struct('a', x, 'b', i)))").alias("s"))
    words = " and ".join(f"get(w, get(s, j).b + {k}) = get(w, get(s, {{0}}).b + {k})" for k in range(3))
    same = f"get(s, j).a = get(s, {{0}}).a and {words}"
    near = f"if(size(s) < 2, array(), transform(filter(sequence(0, size(s) - 1), j -> ({same.format('j - 1')}) or ({same.format('j + 1')})), j -> get(s, j).b))"
    df = df.select("*", F.sort_array(F.expr(near)).alias("p"))
    covered = "aggregate(p, named_struct('p', -3, 'n', 0L), (a, x) -> named_struct('p', x, 'n', a.n + least(3, x - a.p)), a -> a.n)"
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select("*", lines.alias("lines"))
    return df.select(
        *back, F.size("w").cast("long").alias("n_words"), F.char_length(F.translate("t", C.SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def binomial_cdf(k: str, n: str, p: float) -> Column:
    """P(X <= k) of n trials with chance p, summed in logarithms; 1 where k is no less than the mean (not small anyway)."""
    step = f"named_struct('t', a.t + ln(({n} - i + 1) / i) + ln({p}D / {1 - p}D), 's', a.s + exp(a.t + ln(({n} - i + 1) / i) + ln({p}D / {1 - p}D)))"
    first = f"{n} * ln({1 - p}D)"
    return F.expr(f"case when {k} >= {n} * {p}D then 1.0D when {k} = 0 then exp({first}) else aggregate(sequence(1L, {k}), named_struct('t', {first}, 's', exp({first})), (a, i) -> {step}, a -> a.s) end")


def cutoffs(labelled: DataFrame, risk: float = RISK, delta: float = DELTA, price: float = PRICE) -> DataFrame:
    """(stratum, cut_<rule>...): for each stratum and rule the cutoff to use, null for none.

    labelled: features with stratum, print (of the text) and quality (1 good, 0 bad).  Copies of a text are one trial, bad if
    any is.  The rules go from lenient to strict together, in STEPS steps fixed beforehand.  A step is safe if the exact
    binomial test rejects "its rules together lose more than `risk` of the stratum's good texts"; steps are tested in order
    until one fails, which needs no correction, and over strata the level is divided (Bonferroni).  Cutoffs no stricter than
    a safe step's lose no more than it does, so with chance 1 - delta no stratum loses more than `risk`, whichever of them
    each rule then takes: the one with the best balance of bad ones caught and good ones lost, none if it catches no bad one."""
    usable = labelled.filter("not base_failed").groupBy("stratum", "print").agg(F.min("quality").alias("quality"), *(F.first(F.expr(v)).alias(f"v_{r}") for r, (v, _) in RULES.items()))
    hits = [F.expr(f"array({', '.join(f'sum(if(quality = {q} and v_{r} > {c}D, 1L, 0L))' for c in cuts)})").alias(f"{r}_{q}") for r, (_, cuts) in RULES.items() for q in (0, 1)]
    step = [" or ".join(f"v_{r} > {cuts[min(k, len(cuts) - 1)]}D" for r, (_, cuts) in RULES.items()) for k in range(STEPS)]
    joint = F.expr(f"array({', '.join(f'sum(if(quality = 1 and ({x}), 1L, 0L))' for x in step)})").alias("joint")
    per = usable.groupBy("stratum").agg(F.sum((F.col("quality") == 1).cast("long")).alias("n"), joint, *hits).filter("n > 0")
    per = per.withColumn("tests", F.count("*").over(W.partitionBy()))  # one row a stratum
    tested = per.select("stratum", "n", "tests", F.posexplode("joint").alias("k", "g")).withColumn("p", binomial_cdf("g", "n", risk))
    sofar = W.partitionBy("stratum").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    safe = tested.withColumn("safe", F.min(F.col("p") <= delta / F.col("tests")).over(sofar)).filter("safe").groupBy("stratum").agg(F.max("k").alias("step"))
    each = [F.expr(f"transform({r}_1, (g, i) -> named_struct('rule', '{r}', 'i', i, 'cut', array({', '.join(f'{c}D' for c in cuts)})[i], 'g', g, 'b', {r}_0[i]))") for r, (_, cuts) in RULES.items()]
    rows = per.join(safe, "stratum").select("stratum", "step", F.explode(F.concat(*each)).alias("x")).select("stratum", "step", "x.*").filter("i <= step")
    best = rows.filter(f"b > {price} * g").groupBy("stratum", "rule").agg(F.max(F.struct((F.col("b") - price * F.col("g")).alias("gain"), (-F.col("i")).alias("i"), "cut")).alias("m"))
    return best.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("m.cut"))).alias(f"cut_{r}") for r in RULES))


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, stratum: Column | None = None, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """docs (without text) with the features, base_failed, stratum, the stratum's cutoffs and kept.

    A stratum (by default the language, null as one of its own) with too few labels gets no cutoff and loses nothing
    beyond base.  Several labels of one id count as bad if any is; null labels count for nothing; an empty table gives an
    empty result.  Columns of docs with the names of results give way."""
    docs = docs.drop("stratum", "kept", "print", *(f"cut_{r}" for r in RULES))
    stratum = F.coalesce(F.col("lang"), F.lit("")) if stratum is None else stratum
    made = C.cut(features(docs.withColumn("print", F.md5(C.text_of(F.col("text")).cast("binary")))).withColumn("stratum", stratum))
    truth = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    cuts = C.cut(cutoffs(made.drop("quality").join(truth, "doc_id"), risk, delta))
    out = made.join(C.small(cuts, cuts.count(), BROADCAST_STRATA), "stratum", "left")
    over = [F.coalesce(F.expr(f"n_words > 0 and {v} > cut_{r}"), F.lit(False)) for r, (v, _) in RULES.items()]
    rejected = over[0]
    for x in over[1:]:
        rejected = rejected | x
    return out.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("print")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = judge(spark, docs, C.table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    rules = ", ".join(f"('{r}', {i}, {c}::DOUBLE)" for r, (_, cuts) in RULES.items() for i, c in enumerate(cuts))
    value = "CASE r.rule " + " ".join(f"WHEN '{r}' THEN {v.replace('0D', '0').replace('100.0', '100.0::DOUBLE').replace('1.0 ', '1.0::DOUBLE ')}" for r, (v, _) in RULES.items()) + " END"
    p = RISK
    return rf"""
WITH words AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM words),
keyed AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM wins),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(3, coalesce(i - prev, 3)))::BIGINT AS n FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM twice) GROUP BY 1),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM words),
feat AS (
  SELECT w.doc_id, t, coalesce(lang, '') AS stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM words w JOIN lines USING (doc_id) LEFT JOIN cov c USING (doc_id)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM feat),
rules AS (SELECT * FROM (VALUES {rules}) v(rule, i, cut)),
lab AS (
  SELECT stratum, t, min(q.quality) AS quality, any_value(n_words) AS n_words, any_value(word_chars) AS word_chars, any_value(n_symbols) AS n_symbols,
    any_value(n_lines) AS n_lines, any_value(n_dup_lines) AS n_dup_lines, any_value(n_repeat_words) AS n_repeat_words, row_number() OVER () AS id
  FROM based b JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY 1) q USING (doc_id)
  WHERE NOT base_failed GROUP BY stratum, t),
over AS (SELECT id, stratum, quality, rule, i, cut, {value} > cut AS over FROM lab CROSS JOIN rules r),
hits AS (SELECT stratum, rule, i, cut, count(*) FILTER (quality = 1 AND over) AS g, count(*) FILTER (quality = 0 AND over) AS b FROM over GROUP BY ALL),
steps AS (SELECT k, rule, least(k, (SELECT max(i) FROM rules x WHERE x.rule = y.rule)) AS i FROM (SELECT DISTINCT rule FROM rules) y, (SELECT unnest(range({STEPS})) AS k)),
joint AS (
  SELECT stratum, k, count(*) AS n, count(*) FILTER (lost) AS g
  FROM (SELECT id, stratum, k, bool_or(over) AS lost FROM over JOIN steps USING (rule, i) WHERE quality = 1 GROUP BY ALL) GROUP BY ALL),
pv AS (
  SELECT *, CASE WHEN g >= n * {p} THEN 1 ELSE list_sum(list_transform(range(0, g + 1), lambda x: exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln({p}) + (n - x) * ln({1 - p})))) END AS p,
    (SELECT count(DISTINCT stratum) FROM joint) AS tests
  FROM joint),
safe AS (SELECT stratum, max(k) AS step FROM (SELECT *, bool_and(p <= {DELTA} / tests) OVER (PARTITION BY stratum ORDER BY k) AS safe FROM pv) WHERE safe GROUP BY 1),
best AS (SELECT stratum, rule, arg_max(cut, (b - {PRICE} * g) * 100 - i) AS cut FROM hits JOIN safe USING (stratum) WHERE i <= step AND b > {PRICE} * g GROUP BY 1, 2),
bad AS (SELECT DISTINCT f.doc_id FROM based f JOIN best r USING (stratum) WHERE n_words > 0 AND {value} > r.cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM based
"""


OP1_SQL = _oracle()
