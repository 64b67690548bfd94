"""The groups of a line of a book come from one match."""

from tallyspark.sources import books


def test_one_match_a_line(spark):
    line = "01/02/2024  NF E  1  00012  02/02/2024  A\u0001B$1  SC  1.234,56  1-101  1  1.000,00  12,00  3,00"
    rows = spark.createDataFrame([("a", 1, line), ("a", 2, "4 5,00 6,00"), ("a", 3, "4 7,00 8,00"), ("a", 4, line.split("  12,00")[0])], "arquivo string, line_no long, line string")
    out = books.inbound_accounting(rows)
    first, second = out.orderBy("line_no").collect()
    assert (first.especie, first.numero, first.emitente, first.valor_contabil, first.cfop, first.base_calculo, first.aliquota, first.imposto, first.difal_base, first.difal) == ("NF E", "12", "A\u0001B$1", 1234.56, "1101", 1000.0, 12.0, 3.0, 7.0, 8.0)
    assert (second.aliquota, second.imposto, second.difal) == (0.0, 0.0, 0.0)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("^(\\d{2}") <= 2  # whether it is an entry, and its groups


def test_tax_before_its_entry(spark):
    line = "01/02/2024 55 1 0012 02/02/2024 00000000000123 SC 1.234,56 1102"
    rows = spark.createDataFrame([("a", 1, "ICMS 9 5,00 7 3,00"), ("a", 2, "ICMS 2 6,00 12,5 3,00"), ("a", 3, line), ("a", 4, line)], "arquivo string, line_no long, line string")
    first, second = books.inbound_company(rows).orderBy("line_no").collect()
    assert (first.numero, first.emitente, first.valor_contabil, first.cfop, first.cod_fiscal, first.base_calculo, first.aliquota, first.imposto) == ("12", "00000000000123", 1234.56, "1102", "2", 6.0, 12.5, 3.0)
    assert (second.cod_fiscal, second.base_calculo) == ("", 0.0)
