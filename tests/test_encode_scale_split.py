import numpy as np
import pytest

from waitwright.operators import encode, scale, split


@pytest.mark.parametrize("limit", [100_000, 2])
def test_codes_are_ranks_whatever_the_domain_size(spark, table, monkeypatch, limit):
    monkeypatch.setattr(encode, "SMALL_DOMAIN", limit)
    words = ["b", "a", "é", "Z", None, "a", "10", "9"]
    df = table("w string, n int", [(w, i) for i, w in enumerate(words)])
    coded = encode.fit_encoder(df, ["w", "n"]).collect()
    for column, values in (("w", words), ("n", range(len(words)))):
        texts = sorted({"nan" if v is None else str(v) for v in values})
        assert {r["value"]: r["code"] for r in coded if r["column"] == column} == {
            t: i for i, t in enumerate(texts)}


def test_unseen_values(table):
    known = encode.fit_encoder(table("department string", [("B",), ("A",)]), ["department"])
    new = table("department string", [("B",), ("C",)])
    coded, _ = encode.encode_categories(new, known)
    assert [r["department_enc"] for r in coded.orderBy("department").collect()] == [1, -1]
    in_place, _ = encode.encode_in_place(new, known)
    assert sorted(r["department"] for r in in_place.collect()) == [0, 1]


def test_absent_columns_are_skipped(table):
    df, encoder = encode.encode_categories(table("department string", [("B",)]))
    assert df.columns == ["department", "department_enc"] and encoder.count() == 1


def test_flags_use_the_fitted_limits(table):
    train = table("arrival_rate double, total_counters_available int",
                  [(float(i), i) for i in range(5)])
    fitted = scale.fit_flags(train)
    assert fitted.limits == {"arrival_rate": 3.0, "total_counters_available": 1.0}
    row = scale.apply_flags(table("arrival_rate double, total_counters_available int",
                                  [(3.5, 1)]), fitted).first()
    assert (row["high_arrival_rate"], row["low_capacity"]) == (1, 1)


def test_scaling_uses_population_deviation(table):
    values = np.array([1.0, 2.0, 4.0])
    df = table("v double, c double", [(float(v), 7.0) for v in values])
    got = scale.apply_scaler(df, scale.fit_scaler(df, ["v", "c"])).toPandas()
    np.testing.assert_allclose(sorted(got["v"]), (values - values.mean()) / values.std())
    assert got["c"].tolist() == [0.0, 0.0, 0.0]


def test_splits_are_complete_and_repeatable(spark):
    df = spark.range(20_000).withColumnRenamed("id", "patient_id")
    for make in (split.split_by_hash, split.split_in_two_steps):
        once = make(df, "patient_id")
        shares = {r["split"]: r["count"] / 20_000 for r in once.groupBy("split").count().collect()}
        assert shares["train"] == pytest.approx(0.70, abs=0.02)
        assert shares["validation"] == pytest.approx(0.15, abs=0.02)
        assert shares["test"] == pytest.approx(0.15, abs=0.02)
        again = make(df.repartition(3), "patient_id")
        assert once.exceptAll(again).count() == 0


def test_large_and_negative_keys(table):
    df = table("k bigint", [(2 ** 63 - 1,), (-(2 ** 63),), (None,)])
    assert split.split_in_two_steps(split.split_by_hash(df, "k").drop("split"), "k").count() == 3
