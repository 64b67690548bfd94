"""Report workbooks written and read back, and workbooks that come in."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import costing, recon, workbooks
from tallyspark.plans import books, stock
from tallyspark.plans import views as V
from tallyspark.sources import sheets
from tallyspark.sources import workbooks as incoming

DATA = "/root/testdata/sf0.001"


def test_stock_and_reconciliation_workbooks(spark, tmp_path):
    rows = V.ledger(spark, DATA).filter("produto_id <= 20")
    roll, pos = costing.rollforward(rows, stock.FROM, stock.TO), costing.position(rows, stock.DAY)
    path = str(tmp_path / "stock.xlsx")
    sheets.write(workbooks.stock(roll, pos, rows), path)
    assert sheets.names(path) == ["Estoque", "Movimentos"]
    got = list(sheets.rows(path, 1, typed=True))
    head, body, total = got[0], got[1:-1], got[-1]
    assert total[0] == "TOTAL" and len(body) == roll.filter("produto_id is not null").count()
    for c in ("abertura", "entradas", "saidas", "fechamento"):
        assert total[head.index(c)] == pytest.approx(sum(r[head.index(c)] for r in body))
    assert len(list(sheets.rows(path, 2))) == rows.count() + 1
    balance, pairs = books.code_balance(spark, DATA), books.recon_notes(spark, DATA).limit(50)
    path = str(tmp_path / "recon.xlsx")
    sheets.write(workbooks.reconciliation(balance, pairs), path)
    assert sheets.names(path) == ["CFOP entradas", "CFOP saidas", "Notas"]
    codes = [r[0] for i in (1, 2) for r in list(sheets.rows(path, i))[1:-1]]
    assert sorted(codes) == sorted(r["cfop"] for r in balance.collect()) and len(list(sheets.rows(path, 3))) == 51


def test_creditor_sheet_there_and_back(spark, tmp_path):
    path = str(tmp_path / "in.xlsx")
    sent = spark.createDataFrame([("ACME", "000101", 10.0), ("BETA", "102", None), (None, None, None), ("GAMA", "103", 30.0), ("DELTA", "", 1.0)], "Fornecedor string, `Número` string, `Valor Contábil` double")
    sheets.write({"Notas": sent}, path)
    heads, notes = incoming.creditors(spark, path)
    assert heads == ["Fornecedor", "Número", "Valor Contábil"]
    assert [tuple(r)[:3] for r in notes.orderBy("linha").collect()] == [(2, "101", 10.0), (3, "102", None), (5, "103", 30.0)]
    book = spark.createDataFrame([(101, 1, "1102", 1000), (102, 1, "1556", 5), (102, 2, "1102", 7)], "numero long, seq int, cfop string, cents long")
    asked = notes.select(F.col("numero").cast("long").alias("numero"), "linha", "colunas", F.round(F.coalesce("valor", F.lit(0.0)) * 100).cast("long").alias("cents"))
    found = recon.enrich(asked, book)
    out = str(tmp_path / "out.xlsx")
    sheets.write(workbooks.creditors(heads, found, recon.creditors_by_code(found, book)), out)
    got = list(sheets.rows(out, 1))
    assert got[0] == [*heads, "CFOP", "Situacao"] and [r[-1] for r in got[1:]] == ["EXATA", "AMBIGUA", "NAO ENCONTRADA"]
    assert [r[0] for r in sheets.rows(out, 2)][-1] == "TOTAL" and "NAO ENCONTRADA" in [r[0] for r in sheets.rows(out, 2)]
    sheets.write({"x": spark.createDataFrame([(1,)], "a int")}, path)
    with pytest.raises(ValueError):
        incoming.creditors(spark, path)


def test_inventory_workbook(spark, tmp_path):
    path = str(tmp_path / "inv.xlsx")
    schema = "data string, numero int, parceiro string, produto string, ncm string, peso double, valor double, origem string, obs string"
    rows = [("03/07/2026", 7, "ACME", "COBRE", "74040000", 10.5, 100.0, " 1 ", None), (None, 8, "BETA", "COBRE", "74040000", 2.0, None, "1", "sem  data"), (None, None, None, None, None, 12.5, 100.0, None, None)]
    sheets.write({"DASHBOARD": spark.range(1), "DADOS DE ENTRADAS ORIGEM 1": spark.createDataFrame(rows, schema).coalesce(1), "DADOS DE SAÍDAS ORIGEM 1": spark.createDataFrame(rows[:1], schema)}, path)
    got = incoming.inventory(spark, path).orderBy("tipo", "linha").collect()
    assert [(r["tipo"], r["linha"], r["data"], r["numero"], float(r["peso"])) for r in got] == [("E", 2, dt.date(2026, 7, 3), 7, 10.5), ("E", 3, None, 8, 2.0), ("S", 2, dt.date(2026, 7, 3), 7, 10.5)]
    assert got[0]["origem"] == "1" and got[1]["obs"] == "SEM DATA" and got[1]["valor"] is None
    assert incoming.inventory_totals(path) == {"E": (12.5, 100.0), "S": (10.5, 100.0)}


def test_other_workbooks(spark, tmp_path):
    issues = spark.createDataFrame([(1, True, "2026-07-01"), (2, False, "2026-07-02"), (3, False, "2026-07-03")], "id int, resolvida boolean, criada_em string")
    area = spark.createDataFrame([("Estoque", 1), ("Importação", 2)], "area string, n int")
    path = str(tmp_path / "p.xlsx")
    sheets.write(workbooks.pending(area, issues), path)
    assert [r[0] for r in sheets.rows(path, 1)][1:] == ["Importação", "Estoque"] and [r[0] for r in sheets.rows(path, 2)][1:] == ["3", "2", "1"]
    found = spark.createDataFrame([("D0002", "x"), ("D0001", "y")], "id string, tipo string")
    made = workbooks.sanitation(found, {"A": area, "B": area.filter("n > 9")})
    assert list(made) == ["Achados", "A"]
    summary = spark.createDataFrame([("2026-07", 7.0, 1.0, 2.0, 3.0, 3.0, 0.5, 0.25)], "competencia string, debito double, estorno double, credito_presumido double, devolucao_icms double, icms_recolher double, fundo_social double, fundo_educacao double")
    blocks = spark.createDataFrame([("2", True), ("3", False), ("2", False)], "bloco string, devolucao boolean")
    sheets.write(workbooks.assessment(blocks, summary, issues, area), path)
    assert [r[0] for r in sheets.rows(path, 1)][1:] == ["2", "3", "2"] and [r[2] for r in sheets.rows(path, 2)][1:] == ["debito", "estorno", "credito_presumido", "devolucao_icms", "icms_recolher", "fundo_social", "fundo_educacao"]
    assert list(workbooks.import_audit(area)) == ["Importacao"]
