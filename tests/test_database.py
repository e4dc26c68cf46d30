"""Reading a database in parts: bounds and filters reach it."""

from pyspark.sql import functions as F

from rowmill import sources
from rowmill.operators.cut import fresh_path


def test_round_trip_in_parts_with_a_pushed_filter(spark, capfd):
    url = sources.embedded_url(fresh_path(spark), create=True)
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") / 4).alias("x"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("y"))
    sources.write_jdbc(df, url, "t", createTableColumnTypes="name VARCHAR(20)")
    back = sources.read_jdbc(spark, url, "t", "k", 0, 1000, 5)
    assert back.rdd.getNumPartitions() == 5
    assert sorted(len(p) for p in back.select("k").rdd.glom().collect()) == [200] * 5
    assert set(map(tuple, back.collect())) == set(map(tuple, df.collect()))
    some = back.where("k >= 900 AND y IS NOT NULL AND name <> 'n901'").select("k")
    some.explain("formatted")
    plan = capfd.readouterr().out
    assert "PushedFilters" in plan and "*GreaterThanOrEqual(k,900)" in plan and "ReadSchema: struct<k:bigint>" in plan
    assert some.count() == 79
    sources.write_jdbc(df.limit(10), url, "t", mode="append")
    assert sources.read_jdbc(spark, url, "t", "k", 0, 1000, 2).count() == 1010
