"""Registered queries that SQL can express, against it; and the pipeline's stages."""

import duckdb
import pytest

import corpus_pipeline
from tallyspark.llm import common as C
from tallyspark.llm import queries, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = queries.queries()[name](spark, DATA)
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    text = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert text(tuple(r) for r in got.select(*columns).collect()) == text(want.fetchall())


def test_stages(spark):
    docs = C.table(spark, DATA, "documents")
    columns = set(corpus_pipeline.COLUMNS)
    calm = C.cut(corpus_pipeline.toxic(spark, docs, DATA))
    labels = {r["doc_id"]: r["toxic"] for r in C.table(spark, DATA, "labels").collect()}
    ids = {r[0] for r in calm.select("doc_id").collect()}
    before = {r[0] for r in docs.select("doc_id").collect()}
    clean = {i for i in before if labels.get(i) == 0}
    assert set(calm.columns) == columns and ids <= before and len(clean - ids) <= 0.05 * len(clean) and toxicity.LIMIT > 0
    single = C.cut(corpus_pipeline.near_duplicates(spark, calm, DATA))
    again = corpus_pipeline.jaccard.jaccard_join(spark, single)
    assert 0 < single.count() < calm.count() and again.filter("n_shingles > 0").select("component_id").distinct().count() == again.filter("n_shingles > 0").count()
    hidden = C.cut(corpus_pipeline.personal_data(spark, single, DATA))
    assert hidden.count() == single.count() and hidden.filter("text rlike '[a-z]@[a-z]+[.][a-z]'").count() == 0
    mix = C.cut(corpus_pipeline.mixed(spark, hidden, DATA))
    assert set(mix.columns) == columns and mix.join(hidden, "doc_id", "left_anti").count() == 0
    packed = corpus_pipeline.packed(spark, mix, DATA)
    assert packed.agg({"n_words": "sum"}).first()[0] == mix.select(C.n_words(mix["text"]).alias("n")).agg({"n": "sum"}).first()[0]


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    """Null ids and texts, repeated rows and ids, very long texts, clashing columns: nothing crashes, what stays is stated."""
    from test_operators import labels, nothing, odd

    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd(spark)
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = C.cut(corpus_pipeline.toxic(spark, docs, str(tmp_path)))
    single = C.cut(corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)))
    # 6 is a near copy of 5; rows of one id stay together, and those without an id stay.
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in single.collect()) == sorted((i or 0, t or "") for i, t in given if i != 6)
    twice = docs.filter("doc_id = 3").unionByName(docs.filter("doc_id = 3"))
    assert corpus_pipeline.near_duplicates(spark, twice, str(tmp_path)).count() == 1  # rows that are equal throughout become one
    hidden = C.cut(corpus_pipeline.personal_data(spark, docs, str(tmp_path)))
    assert sorted(r["text"] or "" for r in hidden.filter("doc_id is null or doc_id <> 8").collect()) == sorted(t or "" for i, t in given if i != 8)
    assert hidden.filter("doc_id = 8").first()["text"] == "Write to [EMAIL] or [IP], card [CARD], call [PHONE]."
    mix = C.cut(corpus_pipeline.mixed(spark, docs, str(tmp_path)))
    assert {(r["doc_id"], r["text"]) for r in mix.collect()} <= set(given)
    packed = corpus_pipeline.packed(spark, docs, str(tmp_path)).collect()
    assert sum(r["n_words"] for r in packed) == sum(len((t or "").split()) for _, t in given)
    assert sum(r["piece"] == 0 for r in packed) == len(given)
    assert all(set(d.columns) == set(corpus_pipeline.COLUMNS) for d in (kept, single, hidden, mix))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing(spark), str(tmp_path)).count() == 0
