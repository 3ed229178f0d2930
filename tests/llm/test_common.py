"""The join that all operators share gives the same rows by every way it can go."""

import pytest
from pyspark.sql import functions as F

from remitlens.llm import common


@pytest.mark.parametrize("how", ["left", "inner"])
def test_look_up_by_broadcast_and_by_shuffle(spark, monkeypatch, how):
    rows = spark.range(600).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).cast("bigint").alias("k"), F.lit("x").alias("n"))
    table = common.staged(rows.groupBy("k").agg(F.count("*").alias("n")).where("k % 2 = 1").withColumn("v", F.col("k") * 10).withColumn("w", F.when(F.col("k") > 20, F.col("k"))))
    want = sorted((r.id, r.k, r.v, r.w) for r in rows.join(table.drop("n"), "k", how).collect()) if how == "inner" else None
    results = []
    for most in (1000, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        monkeypatch.setattr(common, "HOT_SHARE", 4)
        got = common.look_up(rows.drop("n"), table, ["k"], how, spread="id")
        assert sorted(got.columns) == ["id", "k", "v", "w"]
        results.append(sorted((r.id, r.k, str(r.v), str(r.w)) for r in got.collect()))
    assert results[0] == results[1] and len(results[0]) == (600 if how == "left" else len(want))
