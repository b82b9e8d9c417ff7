"""The broadcast size check and the aggregate-then-join path."""

from __future__ import annotations

from pyspark.sql import functions as F

from tally.plans import star

D = "/root/testdata/sf0.01"


def test_dimension_bytes_exact_when_small(spark):
    part = spark.read.parquet(f"{D}/part.parquet").select("p_partkey", "p_type")
    strings = part.agg(F.sum(F.octet_length("p_type"))).first()[0]
    assert star.dimension_bytes(part, 10 << 20) == 2000 * (16 + 2 * 8) + strings
    assert star.fits_broadcast(part)


def test_dimension_bytes_stops_at_the_row_bound(spark):
    part = spark.read.parquet(f"{D}/part.parquet").select("p_partkey", "p_name")
    # 2000 rows x 32 fixed bytes already exceed 1000: no string scan, not broadcast
    assert star.dimension_bytes(part, 1000) == 2000 * 32
    spark.conf.set("tally.broadcast.maxBytes", "1000")
    try:
        assert not star.fits_broadcast(part)
    finally:
        spark.conf.unset("tally.broadcast.maxBytes")


def test_rollup_join_equals_line_join(spark, no_broadcast):
    lines = spark.read.parquet(f"{D}/lineitem.parquet")
    part = spark.read.parquet(f"{D}/part.parquet").select("p_partkey", "p_type")
    rolled = star.rollup_join(lines, "l_partkey", part, "p_partkey", {"q": "l_quantity"}, count_as="n")
    got = {r.p_type: (r.q, r.n) for r in rolled.groupBy("p_type").agg(F.sum("q").alias("q"),
                                                                        F.sum("n").alias("n")).collect()}
    raw = lines.join(part, lines.l_partkey == part.p_partkey).groupBy("p_type").agg(
        F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    assert got == {r.p_type: (r.q, r.n) for r in raw.collect()}


def test_grown_tables_are_seen(spark, tmp_path):
    """Files that land later are read, and a dimension's size is measured again."""
    from tally.sources import parquet
    path = f"{tmp_path}/dim.parquet"
    spark.range(10).write.parquet(path)
    small = parquet.read_table(spark, str(tmp_path), "dim")
    spark.conf.set("tally.broadcast.maxBytes", "10000")
    try:
        assert star.fits_broadcast(small) and small.count() == 10
        spark.range(10, 5000).write.mode("append").parquet(path)
        grown = parquet.read_table(spark, str(tmp_path), "dim")
        assert grown.count() == 5000
        assert star.dimension_bytes(grown, 1 << 30) == 5000 * 24
        assert not star.fits_broadcast(grown)
    finally:
        spark.conf.unset("tally.broadcast.maxBytes")
