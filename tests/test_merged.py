"""As-of lookups by merging, against one row at a time."""

import datetime as dt
import random

import pytest

from tallyspark.operators import rates

DAY = dt.date(2024, 1, 1)


def when(r, spread):
    return DAY + dt.timedelta(r.randrange(spread))


@pytest.mark.parametrize("seed,size", [(1, 64)])
def test_against_each_row(spark, seed, size):
    """Nested and overlapping periods, equal starts, open ends, null keys and days, one key with most rows, equal rows."""
    r = random.Random(seed)
    key = lambda: r.choice(["a", "a", "a", "a", "b", "c", None])
    periods = []
    for i in range(50):
        start = when(r, 60)
        periods.append((key(), r.randrange(2), start, None if r.random() < 0.05 else start + dt.timedelta(r.choice([0, 1, 1, 2, 30])), i))
    rows = [(i // 2, key(), r.randrange(2), when(r, 80) if r.random() > 0.05 else None) for i in range(400)]

    def rate(k, n, day):
        fits = [(s, v) for kk, nn, s, e, v in periods if kk is not None and (kk, nn) == (k, n) and day is not None and s <= day and (e is None or e >= day)]
        return max(fits)[1] if fits else None

    df = spark.createDataFrame(rows, "id int, k string, n int, data_mov date")
    table = spark.createDataFrame(periods, "k string, n int, vigencia_inicio date, vigencia_fim date, taxa int")
    want = sorted(((*x, rate(*x[1:])) for x in rows), key=str)
    assert sorted((tuple(x) for x in rates.merged(df, table, ["k", "n"], how="left", size=size).collect()), key=str) == want
    inner = sorted(tuple(x) for x in rates.merged(df, table, ["k", "n"], size=size).collect())
    assert inner == sorted(x for x in want if x[-1] is not None)
    assert inner == sorted(tuple(x) for x in rates.asof(df, table, ["k", "n"]).select("id", "k", "n", "data_mov", "taxa").collect())
    assert rates.merged(df, table.limit(0), ["k", "n"], how="left").filter("taxa is null").count() == len(rows)
    assert rates.merged(df.limit(0), table, ["k", "n"]).count() == 0
