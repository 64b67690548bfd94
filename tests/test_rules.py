"""Rules that no catalogue query reaches, and the way of a file into the ledger."""

import datetime as dt
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyspark import refdata
from tallyspark.functions import text
from tallyspark.operators import assess, costing, flow, recon, sanitize
from tallyspark.sources import books, nfe


def greedy(keys):
    """The grouping rule as it is stated: longest first, each joins the first group that fits."""
    groups, out = [], {}
    for k in sorted(keys, key=lambda k: (-len(k), k)):
        for g in groups:
            start = os.path.commonprefix([k, g])
            if g.startswith(k + " ") or len(start[: start.rfind(" ")] if " " in start else start) >= sanitize.PREFIX:
                out[k] = g
                break
        else:
            groups.append(k)
            out[k] = k
    return out


def test_grouped_names_against_the_rule(spark):
    r = random.Random(3)
    words = ["AB", "ACME", "INDUSTRIA", "COMERCIOGERAL", "METAISPRECIOSOSDOBRASIL", "SUL", "LTDA", "X"]
    keys = sorted({" ".join(r.choice(words) for _ in range(r.randrange(1, 6))) for _ in range(400)} | {"METAISPRECIOSOSDOBRASILEIROS", "METAISPRECIOSOSDOBRASA SUL"})
    got = {x["chave"]: x["grupo"] for x in sanitize.grouped_names(spark.createDataFrame([(k, 1 + len(k) % 3) for k in keys], "chave string, qtd long")).collect()}
    assert got == greedy(keys)
    assert sanitize.grouped_names(spark.createDataFrame([(None, 1), ("", 2)], "chave string, qtd long")).count() == 0


def lines(spark, text):
    return books.lines(spark.createDataFrame([("f", text)], "arquivo string, text string"))


def test_statement_ledger_and_outbound_lines(spark):
    text = "04 Resumo da Apuração\n010 Débito 1.234,50\n020 Outros (10,00)\n09 CÁLCULO DO IMPOSTO\n010 Saldo 7,25\n010 Saldo 8,25\n"
    assert {(r["quadro"], r["item"]): float(r["valor"]) for r in books.dime_statement(lines(spark, text)).collect()} == {("04", "010"): 1234.5, ("04", "020"): -10.0, ("09", "010"): 8.25}
    text = "ENTRADAS\n1102 compra 10,00 9,00 1,00 0,00 0,00\nSUBTOTAIS\n1403 fora 1,00 1,00 1,00 1,00 1,00\nSAÍDAS\n5102 venda 20,00 18,00 2,00 0,00 0,00\nRESUMO DA APURAÇÃO\n001 Por saídas 3,00 4,50\n"
    got = {(r["tipo"], r["cfop"]): (float(r["valor_contabil"]), float(r["imposto"])) for r in books.ledger_codes(lines(spark, text)).collect()}
    assert got == {("entradas", "1102"): (10.0, 1.0), ("saidas", "5102"): (20.0, 2.0)}
    assert [(r["item"], float(r["valor"])) for r in books.ledger_summary(lines(spark, text)).collect()] == [("001", 4.5)]
    out = books.outbound_accounting(lines(spark, "NFE 1 000123 05 SC 1.000,00 5-102 ICMS 900,00 12,00 108,00 0,00 100,00\nother")).collect()
    assert [(r["numero"], r["cfop"], float(r["valor_contabil"]), float(r["imposto"]), r["cancelada"]) for r in out] == [("123", "5102", 1000.0, 108.0, False)]
    out = books.outbound_company(lines(spark, "55 1 77 06 SC 10,00 5102 9,00 12 1,08 0,00 1,00 Nota Cancelada\n55 1 78 06 SC 10,00 5102 9,00 12 1,08 0,00 1,00")).collect()
    assert sorted((r["numero"], float(r["aliquota"]), r["cancelada"]) for r in out) == [("77", 12.0, True), ("78", 12.0, False)]


def test_reopen_and_rates(spark):
    closed = spark.createDataFrame([("2026-06", "fechada"), ("2026-07", "fechada")], "competencia string, status string")
    left, audit = assess.reopen(closed, "2026-07", "erro na nota 12")
    assert {(r["competencia"], r["status"]) for r in left.collect()} == {("2026-06", "fechada"), ("2026-07", "aberta")} and audit.count() == 1
    with pytest.raises(ValueError):
        assess.reopen(closed, "2026-07", "ok")
    rates = refdata.rates(spark).collect()
    assert len(rates) == len(refdata.RATES) and all(r["vigencia_fim"] is None and r["vigencia_inicio"] == dt.date(2020, 1, 1) for r in rates)


def test_first_subset_against_all():
    r = random.Random(9)
    for _ in range(300):
        v = [r.randrange(-5, 40) for _ in range(r.randrange(1, 13))]
        t = r.randrange(0, 120)
        want = next((list(c) for n in range(1, min(len(v), recon.SUBSET) + 1) for c in itertools.combinations(range(len(v)), n) if sum(v[i] for i in c) == t), None)
        assert recon.first_subset(v, t) == want == recon.first_subset(v, t, 7)
    assert recon.first_subset([7 * i + 1000 for i in range(80)], 3) is None  # 3 * 10^8 subsets of six


def test_first_subset_in_bounded_memory():
    """300 lines have 10^12 subsets of six and 4.5 million sums of three; a few parts of them are held one after the other."""
    import tracemalloc

    v = [10**9 + (i * i * 7919) % 1_000_003 for i in range(300)]
    tracemalloc.start()
    got = recon.first_subset(v, sum(v[i] for i in (3, 50, 120, 200, 250, 299)), 500_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got and sum(v[i] for i in got) == sum(v[i] for i in (3, 50, 120, 200, 250, 299)) and got <= [3, 50, 120, 200, 250, 299]
    assert peak < 60_000_000


def test_fold(spark):
    """Every code point as in Python, alone and between letters; names that Latin-1 cannot write."""
    import unicodedata

    strip = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    texts = ["Ação", "ﬁnança", "Ｆｕｌｌ", "Dvořák ß", "é", "e\u0301", "漢字", "한국어", "", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(text.fold(F.col("t")).alias("f"), text.party_key(F.col("t")).alias("k")).collect()
    assert [r["f"] for r in got] == [strip(t or "").upper() for t in texts]
    names = spark.createDataFrame([("Dvořák & Filhos Ltda.",), ("Škoda S/A",), ("ŁÓDŹ ﬁos ²",)], "t string")
    assert [r[0] for r in names.select(text.party_key(F.col("t"))).collect()] == ["DVORAK FILHOS LTDA", "SKODA S A", "ODZ FIOS 2"]
    assert [r[0] for r in names.select(F.array_join(text.name_core(F.col("t")), " ")).collect()][:2] == ["DVORAK FILHOS", "SKODA"]
    assert names.limit(1).select(text.header(F.lit(" Alíquota № "))).first()[0] == "aliquota no"
    blocks = [[chr(c) for c in range(a, min(a + 64, 0x110000)) if not 0xD800 <= c < 0xE000] for a in range(0, 0x110000, 64)]
    rows = [(k, "".join(f"x{c}" for c in b)) for k, b in enumerate(blocks)]
    got = {r["k"]: r["f"] for r in spark.createDataFrame(rows, "k int, t string").select("k", text.unmarked(F.col("t")).alias("f")).collect()}
    assert all(got[k] == "".join(f"x{strip(c)}" for c in b) for k, b in enumerate(blocks))


US, OTHER = "11222333000144", "99888777000166"


def note(n, day, out, quantity, value, ncm="76020000", refs=(), emit=None):
    emit, dest = (US, OTHER) if out else (emit or OTHER, US)
    cited = "".join(f"<NFref><refNFe>{str(x).zfill(44)}</refNFe></NFref>" for x in refs)
    return (
        f'<nfeProc><NFe xmlns="http://example.org/nfe"><infNFe Id="NFe{str(n).zfill(44)}"><ide><nNF>{n}</nNF><tpNF>1</tpNF><finNFe>1</finNFe><dhEmi>2026-07-{day:02d}T10:00:00-03:00</dhEmi>{cited}</ide><emit><CNPJ>{emit}</CNPJ></emit><dest><CNPJ>{dest}</CNPJ></dest>'
        f'<det nItem="1"><prod><xProd>SUCATA</xProd><NCM>{ncm}</NCM><CFOP>{"6102" if out else "3102"}</CFOP><qCom>{quantity}</qCom><vProd>{value}</vProd></prod><imposto><ICMS><ICMS00><orig>1</orig></ICMS00></ICMS></imposto></det></infNFe></NFe><protNFe><infProt><cStat>100</cStat></infProt></protNFe></nfeProc>'
    )


def test_from_file_to_cost(spark):
    """Entries and an exit are imported and costed; an earlier entry that comes later changes the cost; a cancellation undoes it."""
    ledger = spark.createDataFrame([], "nota_id long, line_no int, produto_id long, data_mov date, tipo string, natureza string, quantidade decimal(15,3), valor decimal(15,2), status string, chave_acesso string")
    products = spark.createDataFrame([(1, "SUCATA", "76020000"), (2, "OUTRA", "81042000")], "produto_id long, descricao string, ncm string")
    closed = spark.createDataFrame([("2026-05",)], "competencia string")

    def files(**x):
        return spark.createDataFrame(list(x.items()), "arquivo string, xml string")

    def costs(df):
        return {(str(r["data_mov"]), float(r["quantidade"])): round(r["custo_total"], 2) for r in df.collect()}

    batch = files(a=note(1, 5, False, 10, 100), b=note(2, 8, True, 6, 90), c=note(1, 5, False, 10, 100), d=note(3, 9, True, 1, 5, ncm="00000000"), e="<broken", f=note(4, 9, False, 1, 1, emit="12345678000199").replace(US, OTHER))
    got = flow.import_notes(batch, ledger, products, closed, US, "2026-08-01")
    assert {r["arquivo"]: r["resultado"] for r in got.outcomes.collect()} == {"a": "importada", "b": "importada", "c": "duplicada", "d": "ignorada", "e": "erro", "f": "ignorada"}
    first = spark.createDataFrame(got.entries.collect(), got.entries.schema)
    assert costs(flow.recost(ledger, first)) == {("2026-07-08", 6.0): 60.0}
    again = flow.import_notes(batch, first, products, closed, US, "2026-08-01")
    assert again.entries.count() == 0 and {r["resultado"] for r in again.outcomes.filter("arquivo in ('a', 'b')").collect()} == {"duplicada"}
    more = flow.import_notes(files(g=note(5, 2, False, 4, 80, refs=(1,))), first, products, closed, US, "2026-08-01")
    second = spark.createDataFrame([*first.collect(), *more.entries.select(*first.columns).collect()], first.schema)
    assert costs(flow.recost(first, second)) == {("2026-07-08", 6.0): 100.0}
    assert flow.recost(second, second).count() == 0
    event = f"<procEventoNFe><evento><infEvento><chNFe>{'5'.zfill(44)}</chNFe><tpEvento>110111</tpEvento></infEvento></evento></procEventoNFe>"
    third = flow.cancelled(second, files(x=event))
    assert costs(flow.recost(second, third)) == {("2026-07-08", 6.0): 60.0} and third.filter("status = 'cancelada'").count() == 1
    assert [r["refs"] for r in nfe.read(files(g=note(5, 2, False, 4, 80, refs=(1, 7)))).collect()] == [[str(x).zfill(44) for x in (1, 7)]]
    waits = flow.import_notes(files(h=note(6, 3, False, 1, 9), i=note(7, 3, False, 1, 9, ncm="81042000")), first, products.withColumn("descricao", products["ncm"]).limit(1), spark.createDataFrame([("2026-07",)], "competencia string"), US, "2026-08-01")
    assert {r["arquivo"]: r["resultado"] for r in waits.outcomes.collect()}["h"] == "pendente"
    assert costing.exit_costs(third.filter("status <> 'cancelada'")).count() == 1
