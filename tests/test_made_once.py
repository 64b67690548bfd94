"""Tables that several parts of a plan read are made once."""

from tallyspark.plans import books, imports, skew

SMALL = "/root/testdata/sf0.001"


def leaves(df):
    """(class, text) of what a plan reads."""
    found = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return [(x.getClass().getSimpleName(), x.simpleString(200)) for x in (found.apply(k) for k in range(found.length()))]


def test_pairs_are_made_once_for_findings(spark):
    assert {kind for kind, _ in leaves(books.findings_ranked(spark, SMALL))} == {"InMemoryRelation"}


def test_blocks_of_a_hot_product_read_the_ledger_once(spark):
    found = leaves(skew.hot_exit_cost(spark, SMALL))
    assert len(found) < 40
    assert not [text for kind, text in found if kind == "LogicalRelation" and "o_orderkey" in text]


def test_states_read_the_ledger_once(spark):
    assert not [text for kind, text in leaves(imports.recost_since(spark, SMALL)) if kind != "InMemoryRelation"]


def test_files_are_ranked_without_their_items(spark):
    judged = [text for _, text in leaves(imports.import_legacy(spark, SMALL)) if "como#" in text and "chave_acesso#" in text]
    assert judged and not [text for text in judged if "itens#" in text]
