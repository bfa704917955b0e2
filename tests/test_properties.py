"""Property tests: fold balance, id coverage, helpers."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import features, hidden, validate
from tessera.operators.ordering import row_numbers, within_group_numbers


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sizes=st.lists(st.integers(min_value=1, max_value=40), min_size=1, max_size=4),
       k=st.integers(min_value=2, max_value=6))
def test_fold_shares_differ_by_at_most_one(spark, sizes, k):
    rows = [(i * 100 + j, f"c{i}") for i, n in enumerate(sizes) for j in range(n)]
    df = spark.createDataFrame(rows, "id long, y string")
    f = validate.stratified_folds(df, "id", "y", k=k)
    counts = {}
    for r in f.groupBy("y", "fold").count().collect():
        counts.setdefault(r["y"], {})[r["fold"]] = r["count"]
    for i, n in enumerate(sizes):
        per = [counts.get(f"c{i}", {}).get(j, 0) for j in range(k)]
        assert sum(per) == n and max(per) - min(per) <= 1
    assert f.select("id").distinct().count() == len(rows)


def test_within_group_numbers_match_row_number(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(rng.integers(0, 3)), float(rng.normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g int, v double")
    got = {r["id"]: r["rn"] for r in within_group_numbers(df, ["g"], ["v", "id"]).collect()}
    for g in range(3):
        members = sorted((v, i) for i, gg, v in rows if gg == g)
        for pos, (_, i) in enumerate(members):
            assert got[i] == pos


def test_row_numbers_with_ties_are_a_permutation(spark):
    df = spark.range(0, 300).selectExpr("id", "id % 7 AS k")
    ids = [r["row_id"] for r in row_numbers(df, ["k", "id"]).collect()]
    assert sorted(ids) == list(range(1, 301))


def test_small_helpers(spark):
    df = spark.range(0, 50).selectExpr("id", "CAST(id AS DOUBLE) AS x")
    assert features.shape(df) == (50, 2)
    assert features.generated_columns("feat_", 3) == ["feat_1", "feat_2", "feat_3"]
    assert features.positional_columns(df, 1) == ["x"]
    s1 = [r["id"] for r in features.sample_rows(df, "id", 5, seed=3).collect()]
    s2 = [r["id"] for r in features.sample_rows(df, "id", 5, seed=3).collect()]
    assert s1 == s2 and len(set(s1)) == 5
    arr = df.select("id", F.array("x").alias("a"), F.array(F.col("x") * 2).alias("b"))
    assert features.feature_union(arr, ["a", "b"]).first()["union"] == [0.0, 0.0]
    vec = df.select("id", F.array("x", F.col("x") + 1).alias("v"))
    assert hidden.exemplar_centres(vec, "id", "v", 4).shape == (4, 2)
    with pytest.raises(ValueError):
        hidden.exemplar_centres(vec, "id", "v", 60)
