"""Folding of long texts: right for every character, and each step worked out once."""

import unicodedata

from pyspark.sql import functions as F

from tallyspark.functions import text as X


def plain(s):
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def test_characters_that_become_several_stand_anywhere(spark):
    texts = ["", "plain", "ﬁn", "ﬁﬁ…", "a…b½c", "é½", "½", "x\nﬁ\ny …", "Dvořák ﬃ", "ł…", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.fold(F.col("t")).alias("f")).collect()
    assert [r.f for r in rows] == [plain(t or "").upper() for t in texts]


def test_a_name_is_keyed_once(spark):
    rows = spark.createDataFrame([("Comércio de Metais Ouro ﬁno Ltda",), ("Ltda",), (None,)], "t string").select(X.name_core(F.col("t")).alias("w"))
    assert [r.w for r in rows.collect()] == [["OURO", "FINO"], ["LTDA"], []]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("[^A-Z0-9]+") == 1
