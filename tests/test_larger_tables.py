"""Faults that showed on larger tables only."""

from pyspark.sql import functions as F


def test_fingerprint_sum_exceeds_a_long(spark):
    from tidemark.sources.stores import check_freeze, fingerprint

    rows = spark.range(200_000).withColumn("name", F.lit("x"))
    got = check_freeze(rows.repartition(3), fingerprint(rows)).first()
    each = rows.select(F.conv(F.substring(F.md5(F.concat_ws("\x1f", F.col("id").cast("string"), "name")), 1, 12), 16, 10).cast("bigint").alias("h")).toPandas()["h"]
    assert got["unchanged"] and int(got["hash_sum"]) == sum(map(int, each)) > 2**63
