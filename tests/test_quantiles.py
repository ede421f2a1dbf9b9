"""Exact quantiles that no task holds all values for."""

import random

import numpy as np

from kerbline.operators.summaries import distribution_summary, exact_quantiles


def test_quantiles_equal_numpy(spark):
    rng = random.Random(1)
    groups = {"a": [rng.choice([1.5, 2.0, 7.25, rng.random()]) for _ in range(997)], "b": [3.0] * 40, "c": [4.0], "d": [1.0, 2.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    rng.shuffle(rows)
    names = {"low": 0.0, "q": 0.137, "half": 0.5, "p99": 0.99, "top": 1.0}
    found = {r["g"]: r for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", names).collect()}
    assert set(found) == set(groups)
    for g, vs in groups.items():
        for name, q in names.items():
            assert abs(found[g][name] - np.quantile(vs, q)) < 1e-9


def test_a_metric_without_values(spark):
    r = {x["metric"]: x for x in distribution_summary(spark.createDataFrame([(1.0, None), (3.0, None)], "m double, n double"), ["m", "n"]).collect()}
    assert r["m"]["p50"] == 2.0 and r["n"]["p50"] is None and (r["n"]["count"], r["n"]["missing"]) == (0, 2)
