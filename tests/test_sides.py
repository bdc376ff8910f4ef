"""Sides of joins are broadcast after a check of their size only."""

from locusframe.sources import sides


def test_small_side(spark, monkeypatch):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()
    few = spark.range(10)
    assert not hinted(sides.small_side(few))  # Spark's estimate is small: left to it
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        assert hinted(sides.small_side(few))
        monkeypatch.setattr(sides, "ROWS", 9)
        side = sides.small_side(few)
        assert not hinted(side) and spark.range(20).join(side, "id").count() == 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
