"""Joins of hot keys: the same rows as a plain join, whatever path they take."""

import pytest
from pyspark.sql import functions as F

from waitwright import lineage, skew


@pytest.fixture
def tables(spark):
    rows = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None)
        .otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"), "id")
    names = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(30)],
                                  "k string, code long")
    return rows, names


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_equal_rows_on_both_paths(tables, how, monkeypatch):
    rows, names = tables
    plain = sorted(map(tuple, rows.join(names, "k", how).collect()), key=repr)
    assert sorted(map(tuple, skew.join_unique(rows, names, ["k"], how).collect()), key=repr) == plain
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    monkeypatch.setattr(skew, "is_small", lambda df: False)
    assert sorted(map(tuple, skew.join_unique(rows, names, ["k"], how).collect()), key=repr) == plain


def test_only_hot_keys_are_broadcast(tables, monkeypatch):
    rows, names = tables
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    monkeypatch.setattr(skew, "is_small", lambda df: False)
    seen = []
    monkeypatch.setattr(skew, "cut", lambda df: seen.append(out := lineage.cut(df)) or out)
    skew.join_unique(rows, names, ["k"]).collect()
    assert [r.k for r in seen[0].collect()] == ["hot"]
    assert [r.code for r in seen[1].collect()] == [1]
