"""A file is parsed once, whatever is asked of its fields; the group of ICMS is the item's first."""

from tallyspark.plans import parsing
from tallyspark.sources import nfe

NOTE = (
    '<?xml version="1.0"?><n:NFe xmlns:n="http://www.portalfiscal.inf.br/nfe"><n:infNFe Id="NFe{key}"><n:ide><n:nNF>{n}</n:nNF><n:dhEmi>2024-01-31T23:30:00-03:00</n:dhEmi></n:ide><n:total><n:ICMSTot><n:vNF>3.00</n:vNF></n:ICMSTot></n:total>'
    '<n:det nItem="1"><n:prod><n:CFOP>5102</n:CFOP><n:vProd>3.00</n:vProd></n:prod><n:imposto><n:ICMS>{tax}</n:ICMS></n:imposto></n:det></n:infNFe></n:NFe>'
)


def test_filters_do_not_parse_again(spark):
    plan = parsing.xml_roundtrip(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml(") == 1


def test_groups(spark):
    tax = "<n:{0}><n:orig>{1}</n:orig><n:{2}>00</n:{2}><n:pICMS>4.00</n:pICMS></n:{0}>"
    files = [
        (1, NOTE.format(key="1" * 44, n=1, tax=tax.format("ICMSSN900", 5, "CSOSN"))),
        (2, NOTE.format(key="2" * 44, n=2, tax=tax.format("ICMS90", 6, "CST") + tax.format("ICMS00", 7, "CST"))),
        (3, NOTE.format(key="3" * 44, n=3, tax=tax.format("ICMSUFDest", 8, "CST"))),
        (4, NOTE.format(key="4" * 44, n=4, tax="")),
        (5, "<NFe><infNFe"), (6, None), (7, NOTE.format(key="7" * 43, n=7, tax="")),
        (8, NOTE.format(key="8" * 44, n=8, tax="").replace("n:det", "n:other")),
    ]
    read = nfe.read(spark.createDataFrame(files, "arquivo long, xml string")).orderBy("arquivo").collect()
    assert [r.erro for r in read] == [None] * 4 + ["xml invalido", "xml invalido", "chave invalida", "sem itens"]
    assert [[(i.origem, i.cst, i.aliquota) for i in r.itens] for r in read[:4]] == [[("5", "00", 0.04)], [("6", "00", 0.04)], [(None, None, None)], [(None, None, None)]]
    assert str(read[0].valor_total) == "3.00"
