"""Archives, the watched folder and workbooks."""

import io
import zipfile

from tallyspark.sources import archive, nfe, sheets
from tallyspark.streaming import folder


def note(number, prefix=""):
    p = f"{prefix}:" if prefix else ""
    ns = f'xmlns{":" + prefix if prefix else ""}="http://example.org/nfe"'
    key = str(number).zfill(44)
    return (
        f'<?xml version="1.0"?><{p}NFe {ns}><{p}infNFe Id="NFe{key}"><{p}ide><{p}nNF>{number}</{p}nNF><{p}dhEmi>2026-07-03T23:30:00-03:00</{p}dhEmi></{p}ide>'
        f'<{p}emit><{p}CNPJ>11222333000144</{p}CNPJ></{p}emit><{p}det nItem="2"><{p}prod><{p}CFOP>6102</{p}CFOP><{p}qCom>1.5000</{p}qCom></{p}prod><{p}imposto><{p}ICMS><{p}ICMS00><{p}orig>1</{p}orig></{p}ICMS00></{p}ICMS></{p}imposto></{p}det>'
        f'<{p}det nItem="1"><{p}prod><{p}CFOP>5102</{p}CFOP></{p}prod></{p}det></{p}infNFe></{p}NFe>'
    )


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


def test_archive_nested_and_broken(spark, tmp_path):
    inner = zipped({"x/b.XML": note(2, "ns0"), "skip.txt": "no"})
    (tmp_path / "a.zip").write_bytes(zipped({"a.xml": note(1), "in.zip": inner, "bad.xml": "<NFe><infNFe>"}))
    (tmp_path / "b.zip").write_bytes(b"not an archive")
    files = archive.read(spark, str(tmp_path))
    got = {r["arquivo"]: r["erro"] for r in files.collect()}
    assert set(got) == {"a.zip/a.xml", "a.zip/in.zip/x/b.XML", "a.zip/bad.xml", "b.zip"} and got["b.zip"]
    notes = {r["arquivo"]: r for r in nfe.read(files.filter("erro is null").select("arquivo", "xml")).collect()}
    assert notes["a.zip/bad.xml"]["erro"]
    for k, n in (("a.zip/a.xml", 1), ("a.zip/in.zip/x/b.XML", 2)):
        assert (notes[k]["numero"], str(notes[k]["data_emissao"]), notes[k]["erro"]) == (str(n), "2026-07-03", None)
        assert [i["cfop"] for i in notes[k]["itens"]] == ["6102", "5102"] and notes[k]["itens"][0]["origem"] == "1"


def test_events(spark):
    event = '<procEventoNFe><evento><infEvento><chNFe>{}</chNFe><tpEvento>{}</tpEvento><descEvento>Carta</descEvento></infEvento></evento></procEventoNFe>'
    rows = [("c", event.format("1" * 44, 110111)), ("o", event.format("1" * 44, 110110)), ("n", note(1)), ("z", None)]
    got = {r[0]: (r[1], r[2]) for r in nfe.events(spark.createDataFrame(rows, "arquivo string, xml string")).collect()}
    assert got == {"c": ("1" * 44, None), "o": (None, "Carta (tpEvento 110110)"), "n": (None, None), "z": (None, None)}


def test_watched_folder(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    args = [str(tmp_path / x) for x in ("notes", "failed", "state")]

    def run():
        folder.watch(spark, str(inbox), *args).awaitTermination(120)
        return sorted(r[0] for r in spark.read.parquet(args[0]).select("numero").collect()), spark.read.parquet(args[1]).count()

    (inbox / "1.xml").write_text(note(1))
    (inbox / "1again.xml").write_text(note(1))
    (inbox / "bad.xml").write_text("<NFe>")
    assert run() == (["1"], 1)
    (inbox / "1third.xml").write_text(note(1))
    (inbox / "2.xml").write_text(note(2))
    assert run() == (["1", "2"], 1)


def test_workbook_round_trip(spark, tmp_path):
    df = spark.sql("select * from values (1, 'a & <b>', 2.50D, true, date'2026-07-01'), (2, cast(null as string), null, false, null) t(n, s, v, f, d) order by n")
    path = str(tmp_path / "r.xlsx")
    sheets.write({"Um": df, "Vazio": df.filter("n > 5")}, path)
    assert list(sheets.rows(path)) == [["n", "s", "v", "f", "d"], ["1", "a & <b>", "2.5", "1", "2026-07-01"], ["2", None, None, "0", None]]
    assert list(sheets.rows(path, 2)) == [["n", "s", "v", "f", "d"]]
