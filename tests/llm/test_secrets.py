"""Keys and tokens that no fixed format knows are found by the contexts that they share."""

import hashlib
import re

from tallyspark.llm import common as C
from tallyspark.llm import pii


def test_secrets_in_the_documents(spark):
    """Every planted token is spanned, without its quotes, and no other word; redaction removes it."""
    docs = C.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    found = C.cut(pii.extract(spark, docs))
    rows = found.filter("exists(all, x -> x.kind = 'context') or text like '%token = %'").collect()
    token = re.compile(r'token = "([0-9a-f]{40})"', re.I)
    want = {(r["doc_id"], m.span(1)) for r in rows for m in token.finditer(r["text"])}
    assert len(want) > 10
    assert {(r["doc_id"], (x["start"], x["stop"])) for r in rows for x in r["all"] if x["kind"] == "context"} == want
    assert pii.redact(found).filter("text rlike '[0-9a-f]{40}'").join(found.filter("text like '%token = %'").select("doc_id"), "doc_id").count() == 0


def test_shape_alone_reveals_nothing(spark):
    """Long mixed words in places of their own stay; behind a shared label they go, and so does another shape behind it."""
    word = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    lone = [(i, f"une {chr(97 + i)}{chr(98 + i)} {word(i)} {chr(99 + i)}{chr(100 + i)} fin") for i in range(12)]
    keyed = [(100 + i, f"du texte apikey: {word(1000 + i)} {chr(97 + i)}{chr(97 + i)} fin") for i in range(12)]
    rows = [*lone, *keyed, (200, "du texte apikey: kurz9 zz fin"), (201, None)]
    found = pii.extract(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = {r["doc_id"]: [(r["text"])[x["start"] : x["stop"]] for x in r["all"]] for r in found}
    assert all(not spans[i] for i, _ in lone)
    assert all(spans[100 + i] == [word(1000 + i)] for i in range(12))
    assert spans[200] == ["kurz9"] and spans[201] == []
