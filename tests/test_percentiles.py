"""Percentiles by narrowing histograms against sorted values."""

import random

import numpy as np
import pytest

from panelforge.functions.percentiles import percentiles

SHARES = (0.03, 0.5, 0.97, 0.0, 1.0)


@pytest.mark.parametrize("bins", [2, 1024])
def test_percentiles(spark, bins):
    rng = random.Random(6)
    groups = {"a": [rng.gauss(0, 1) for _ in range(500)], "ties": [rng.choice((1.0, 1.0, 2.0)) for _ in range(300)], "one": [7.5], "wide": [1e300, -1e300, 1e-300, 0.0, 5.0], "close": [1.0, 1.0 + 2**-52, 1.0 + 2**-51, 1.0]}
    rows = [(k, v) for k, values in groups.items() for v in values] + [("a", None), ("none", None)]
    got = {r["g"]: r["values"] for r in percentiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", SHARES, bins).collect()}
    assert got.keys() == groups.keys()
    for k, values in groups.items():
        s = sorted(values)
        for p, v in zip(SHARES, got[k], strict=True):
            r = p * (len(s) - 1)
            low, high = s[int(np.floor(r))], s[int(np.ceil(r))]
            assert v == pytest.approx(low + (r - np.floor(r)) * (high - low), rel=1e-12)


def test_percentiles_of_nothing(spark):
    assert percentiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", (0.5,)).count() == 0
