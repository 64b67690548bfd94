"""Two books are made once each, and shuffled once, by number."""

import pytest

from tallyspark.operators import recon
from tallyspark.plans import books

LINES = "numero long, seq int, cfop string, cents long"


@pytest.mark.parametrize(("query", "made"), [(books.recon_notes, 2), (books.missing_by_code, 3)])
def test_books_are_made_once(spark, query, made):
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("row_number()") == made
    assert plan.count("hashpartitioning(") <= made + 2 * (made > 2)  # a book each; the lines alone, and the sums by code


def test_short_and_long_notes(spark):
    a = [(1, 1, "x", 5), (1, 2, "y", 7)] + [(2, i, "x", 2**i) for i in range(1, 9)] + [(3, i, "x", 2) for i in range(1, 9)] + [(4, 1, "x", 1)]
    b = [(1, 1, "y", 7), (2, 1, "x", 2 + 8), (3, 1, "x", 5), (5, 1, "x", 1)]
    pairs = recon.pair_notes(spark.createDataFrame(a, LINES), spark.createDataFrame(b, LINES)).cache()
    got = {tuple(r) for r in pairs.filter("classe <> 'so_a'").collect()}
    assert got == {(1, "casada", 2, 1, False), (2, "casada", 1, 1, False), (3, "revisar", None, None, False), (5, "so_b", None, 1, False)}
    assert {(r.numero, r.seq_a) for r in pairs.filter("classe = 'so_a'").collect()} == {(1, 1), *((2, i) for i in (2, 4, 5, 6, 7, 8)), (4, 1)}
    assert [tuple(r) for r in recon.missing_by_code(pairs, spark.createDataFrame(a, LINES)).collect()] == [("x", 8, 4 + 16 + 32 + 64 + 128 + 256 + 5 + 1)]
