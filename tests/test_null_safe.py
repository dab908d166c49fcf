"""Null keys meet null keys."""

from shelfwise.scale import join_null_safe


def test_join_null_safe(spark):
    left = spark.createDataFrame([(1, "a", 10), (1, None, 11), (2, None, 12)], "k int, g string, x int")
    right = spark.createDataFrame([(1, "a", 1), (1, None, 2)], "k int, g string, y int")
    inner = join_null_safe(left, right, ["k", "g"])
    assert inner.columns == ["k", "g", "x", "y"]
    assert sorted((r["x"], r["y"]) for r in inner.collect()) == [(10, 1), (11, 2)]
    outer = join_null_safe(left, right, ["k", "g"], "left")
    assert {r["x"]: r["y"] for r in outer.collect()} == {10: 1, 11: 2, 12: None}
