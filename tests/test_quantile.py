"""Exact quantiles by rank selection, against numpy."""
import math
import random

import numpy as np
import pytest

from cohortlens.operators.quantile import quantiles

PROBS = {"a": 0.0, "b": 0.1, "m": 0.5, "d": 0.77, "e": 1.0}


def rows(seed=5):
    rng = random.Random(seed)
    out = [("one", 4.0), ("none", None), ("none", None), (None, 2.0), (None, 7.0)]
    out += [("same", 3.5)] * 500
    out += [("half", 1.0)] * 400 + [("half", rng.gauss(0, 1e6)) for _ in range(400)]
    return out + [("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300)) for _ in range(700)]


@pytest.mark.parametrize("most, parts", [(1_000_000, 256), (40, 8), (1, 2)])
def test_quantiles_match_numpy(spark, most, parts):
    data = rows()
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    got = {r["k"]: r for r in quantiles(df, "v", PROBS, ["k"], most, parts).collect()}
    assert set(got) == {k for k, _ in data}
    for k, r in got.items():
        xs = [v for g, v in data if g == k and v is not None]
        for name, p in PROBS.items():
            if not xs:
                assert r[name] is None
            else:
                assert math.isclose(r[name], float(np.quantile(xs, p)), rel_tol=1e-9, abs_tol=1e-300)


def test_quantiles_of_a_whole_column_and_of_nothing(spark):
    df = spark.range(0, 1001).selectExpr("cast(id as int) as v")
    got = quantiles(df, "v", {"p25": 0.25, "p50": 0.5}, (), 10, 4).collect()
    assert [tuple(r) for r in got] == [(250.0, 500.0)]
    assert [tuple(r) for r in quantiles(df.limit(0), "v", {"p50": 0.5}).collect()] == [(None,)]
    assert quantiles(df.limit(0), "v", {"p50": 0.5}, ["v"]).count() == 0
