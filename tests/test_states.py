"""Recosting from states equals costing the whole ledger."""

import datetime as dt
import random
from decimal import Decimal

from test_costing import SCHEMA

from tallyspark.operators import costing, states

DAY = dt.date(2024, 1, 1)


def row(r, i):
    return (r.randrange(5), DAY + dt.timedelta(r.randrange(200)) if r.random() > 0.03 else None, r.choice("ESE"), i, 1, Decimal(r.randrange(-100, 5000)) / 1000, Decimal(r.randrange(1, 900)) if r.random() > 0.1 else None, r.choice(["VENDA", "ACERTO"]), r.choice(["lancada"] * 9 + ["cancelada"]))


def stored(spark, tmp_path, made, name):
    out = []
    for field, df in zip(made._fields, made, strict=True):
        path = f"{tmp_path}/{name}-{field}"
        df.write.parquet(path)
        out.append(spark.read.parquet(path))
    return states.States(*out)


def found(df):
    return {tuple(x)[:4]: (x["quantidade"], x["falta"], round(x["custo_total"], 6)) for x in df.select("produto_id", "nota_id", "line_no", "data_mov", "quantidade", "falta", "custo_total").collect()}


def rounded(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in df.select(*sorted(df.columns)).collect()), key=str)


def test_retroactive_edits(spark, tmp_path):
    r = random.Random(11)
    rows = [row(r, i) for i in range(240)]
    before = spark.createDataFrame(rows, SCHEMA)
    kept = stored(spark, tmp_path, states.build(before), "a")
    assert found(states.costs(kept)) == found(costing.exit_costs(before))
    for step in range(2):
        for _ in range(4):  # rows come, go, and change, mostly of two products
            i = r.randrange(len(rows))
            kind = r.randrange(3)
            if kind == 0 and rows[i][0] < 2:
                del rows[i]
            elif kind == 1 and rows[i][0] < 2:
                rows[i] = (*rows[i][:5], rows[i][5] + 1, *rows[i][6:])
            else:
                rows.append((r.randrange(2), *row(r, 1000 + 10 * step + len(rows))[1:]))
        after = spark.createDataFrame(rows, SCHEMA)
        changed = stored(spark, tmp_path, states.States(states.changes(before, after), before, before), f"c{step}").lots
        assert 0 < changed.count() <= 2
        new = states.since(changed, after, kept)
        kept = stored(spark, tmp_path, states.replaced(changed, kept, new), f"k{step}")
        assert found(states.costs(kept)) == found(costing.exit_costs(after))
        assert rounded(kept.lots) == rounded(states.build(after).lots)
        before = after


def test_only_the_rows_from_the_change_on_are_read(spark, tmp_path):
    """Rows before the month of the change may be anything: they are not looked at."""
    r = random.Random(12)
    rows = [row(r, i) for i in range(200)]
    before = spark.createDataFrame(rows, SCHEMA)
    kept = stored(spark, tmp_path, states.build(before), "a")
    day = DAY + dt.timedelta(130)
    added = (1, day, "S", 9000, 1, Decimal(2), Decimal(30), "VENDA", "lancada")
    whole = spark.createDataFrame([*rows, added], SCHEMA)
    tail = whole.filter(f"data_mov >= date'{day.replace(day=1)}'")
    changed = spark.createDataFrame([(1, day)], "produto_id long, desde date")
    after = states.replaced(changed, kept, states.since(changed, tail, kept))
    assert found(states.costs(after)) == found(costing.exit_costs(whole))
    assert states.changes(before, whole).collect() == changed.collect()
