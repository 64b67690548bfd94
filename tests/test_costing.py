"""Lots and costs against a sequential walk."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from tallyspark.operators import assess, costing, ledger

SCHEMA = "produto_id long, data_mov date, tipo string, nota_id long, line_no int, quantidade decimal(15,3), valor decimal(15,2), natureza string, status string"


def walk(rows):
    """(used lots, shortages) by a queue."""
    used, short, lots = {}, {}, {}
    for p, _, t, n, k, q, *_ in sorted((r for r in rows if r[1] and r[8] != "cancelada" and r[5] > 0), key=lambda r: (r[0], r[1], r[2], r[3], r[4])):
        queue = lots.setdefault(p, [])
        if t == "E":
            queue.append([n, k, q])
            continue
        while q > 0 and queue:
            take = min(q, queue[0][2])
            used[p, n, k, queue[0][0], queue[0][1]] = take
            q -= take
            queue[0][2] -= take
            if not queue[0][2]:
                queue.pop(0)
        if q:
            short[p, n, k] = q
    return used, short, {(p, n, k): q for p, queue in lots.items() for n, k, q in queue}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_queue(spark, seed):
    r = random.Random(seed)
    day = dt.date(2024, 1, 1)
    rows = [
        (r.randrange(6), day + dt.timedelta(r.randrange(40)) if r.random() > 0.03 else None, r.choice("ES"), i, 1, Decimal(r.randrange(-200, 5000)) / 1000, Decimal(r.randrange(1, 900)), "VENDA", r.choice(["lancada"] * 9 + ["cancelada"]))
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    used, short, left = walk(rows)
    got = {tuple(x[:5]): x[5] for x in costing.consumption(df).select("produto_id", "saida_nota", "saida_linha", "entrada_nota", "entrada_linha", "quantidade").collect()}
    assert got == used
    assert {(x["produto_id"], x["nota_id"], x["line_no"]): x["falta"] for x in costing.exit_costs(df).filter("falta > 0").collect()} == short
    assert {(x["produto_id"], x["nota_id"], x["line_no"]): x["resta"] for x in costing.open_lots(df).collect()} == left


def test_shortage_is_not_carried(spark):
    d = dt.date(2024, 1, 1)
    row = lambda i, t, q, v: (1, d + dt.timedelta(i), t, i, 1, Decimal(q), Decimal(v), "VENDA", "lancada")
    df = spark.createDataFrame([row(1, "E", 10, 100), row(2, "S", 15, 300), row(3, "E", 4, 80)], SCHEMA)
    cost = costing.exit_costs(df).first()
    assert (cost["falta"], cost["custo_total"]) == (5, 150.0)
    assert [x["resta"] for x in costing.open_lots(df).collect()] == [4]
    assert ledger.first_negative(df).first()["saldo"] == -5
    at = costing.position(df).first()
    assert (at["saldo"], at["custo_medio"]) == (-1, None)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    for out in (costing.consumption(df), costing.exit_costs(df), costing.open_lots(df), costing.position(df), ledger.running(df)):
        assert out.count() == 0


def test_assessment_month(spark):
    items = spark.createDataFrame([("2", "VENDA", 2045095.20), ("3", "VENDA", 1455407.20), ("2", "DEVOLUCAO", 610012.70)], "bloco string, natureza string, base double")
    items = items.selectExpr("bloco", "natureza", "cast(base as decimal(15,2)) base", "date'2026-07-10' data_mov", "'lancada' status", "'S' tipo")
    rates = spark.sql("select * from values ('2', date'2020-01-01', cast(null as date), 0.04D, 0.03D), ('3', date'2020-01-01', null, 0.12D, 0.099D) t(bloco, vigencia_inicio, vigencia_fim, aliquota, aliq_presumido)")
    got = assess.summary(items, rates).first().asDict()
    want = {"base_beneficiada": 3500502.40, "debito": 256452.672, "credito_presumido": 205438.1688, "estorno": 18300.381, "devolucao_icms": 24400.508, "icms_deduzir": 232052.164, "icms_recolher": 44914.3762, "fundo_social": 7819.203044, "fundo_educacao": 3742.755756}
    for k, v in want.items():
        assert float(got[k]) == pytest.approx(v, abs=0.01), k
    assert float(got["carga_efetiva"]) == pytest.approx(1.283, abs=0.001)
