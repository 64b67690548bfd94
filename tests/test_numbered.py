"""Numbers without gaps, however Spark deals the rows that it counts and those that it numbers."""

from pyspark.sql import functions as F

from tallyspark.operators import recon


def test_numbers_are_the_places(spark, capsys):
    """Counting needs few columns, numbering all: adaptive execution joins small partitions of the one and not of the other."""
    n = 30_000
    rows = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 8).alias("detalhe"))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100000")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        out = recon.numbered(rows, [F.col("k") % 3, "k"]).select("k", "id")
        out.explain()
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")
    assert "SPARK_PARTITION_ID" not in capsys.readouterr().out.upper()  # where a row was dealt to is no property of the row
    want = sorted(range(n), key=lambda k: (k % 3, k))
    assert [k for k, _ in sorted(got, key=lambda r: int(r["id"][1:]))] == want and {int(r["id"][1:]) for r in got} == set(range(1, n + 1))
