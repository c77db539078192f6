"""Running values, weighted means and covariances by ranges against plain loops, for any length of the ranges."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import scans
from panelforge.kernels import ewma
from panelforge.operators import covariance

DAYS = [4096, 30, 7, 1]
SERIES = "panel_id string, ticker string, date date, x double"


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(4)
    rows = []
    for key in (("p", "a"), ("p", "b"), ("q", "a")):
        dates = sorted(rng.sample(range(-60, 200), 90))  # on both sides of 1970
        rows += [(*key, dt.date(1970, 1, 1) + dt.timedelta(d), rng.choice((None, rng.gauss(0, 1), rng.gauss(0, 1)))) for d in dates]
    rows += [("r", "none", dt.date(2000, 1, k), None) for k in range(1, 9)] + [("r", "one", dt.date(2000, 1, 1), 3.0)]
    return spark.createDataFrame(rows, SERIES).cache()


def by_series(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["panel_id"], r["ticker"], r["date"])):
        out[r["panel_id"], r["ticker"]].append(r)
    return out


@pytest.mark.parametrize("days", DAYS)
def test_running_values(series, days):
    x = F.col("x")
    got = scans.running(series, ["panel_id", "ticker"], days=days, total=("sum", x), grown=("product", 1 + x), high=("max", x), low=("min", x), late=("last", x), n=("sum", F.lit(1).cast("long")))
    assert got.columns == [*series.columns, "total", "grown", "high", "low", "late", "n"]
    found = by_series(got.collect())
    assert found.keys() == by_series(series.collect()).keys()
    for rows in found.values():
        seen = []
        for k, r in enumerate(rows):
            seen += [] if r["x"] is None else [r["x"]]
            want = (sum(seen), np.prod([1 + v for v in seen]), max(seen), min(seen), seen[-1]) if seen else (None,) * 5
            assert (r["total"], r["grown"], r["high"], r["low"], r["late"]) == pytest.approx(want) and r["n"] == k + 1
    assert scans.running(series.where("false"), ["panel_id"], total=("sum", x)).count() == 0


@pytest.mark.parametrize("days", DAYS)
def test_fills(series, days):
    both = by_series(scans.fill_both_ways(series, "x", ["panel_id", "ticker"], days=days).collect())
    budget = by_series(scans.fill_budget(series, "x", ["panel_id", "ticker"], limit=3, days=days).collect())
    for key, rows in by_series(series.collect()).items():
        x = pd.Series([r["x"] for r in rows], dtype=float)
        assert [r["x"] for r in both[key]] == pytest.approx(x.ffill().bfill().tolist(), nan_ok=True) or x.isna().all() and {r["x"] for r in both[key]} == {None}
        left = x.where(~(x.isna() & (x.isna().cumsum() <= 3)), 0.0)
        assert [np.nan if r["x"] is None else r["x"] for r in budget[key]] == pytest.approx(left.tolist(), nan_ok=True)


@pytest.mark.parametrize("days", DAYS)
@pytest.mark.parametrize("decay", [0.0, 0.1, 0.96, 1.0])
def test_decayed_means(series, days, decay):
    rows = series.select("panel_id", "ticker", "date", F.coalesce("x", F.lit(0.25)).alias("x"), F.lit(2.0).alias("start"))
    for found in by_series(scans.decayed(rows, ["panel_id", "ticker"], F.col("x"), F.col("start"), decay, "m", days=days).collect()).values():
        m = 2.0
        for r in found:
            m = (1 - decay) * r["x"] + decay * m
            assert r["m"] == pytest.approx(m, rel=1e-9, abs=1e-12)


def loop(x, y, span, clip, demean, alone):
    """The covariance's recursions row by row, after their definition."""
    decay, first = 1 - 2 / (1 + span), min(span, len(x))
    used = []
    for s in (x, y):
        cut = ewma.clip(s.tolist(), decay, s[:first].var())[0] if clip else s.tolist()
        mean, out = s[:first].mean(), []
        for v in cut:
            mean = (1 - decay) * v + decay * mean
            out.append(v - mean if demean else v)
        used.append(out)
    cov = x[:first].var() if alone else np.cov(x[:first], y[:first])[0, 1] if first > 1 else 0.0
    out = []
    for k, (u, v) in enumerate(zip(*used, strict=True)):
        cov = (1 - decay) * u * v + decay * cov
        out.append(cov if k >= first else None)
    return out


@pytest.mark.parametrize("days", [4096, 40, 3])
def test_weighted_covariances_by_ranges(spark, days):
    rng = np.random.default_rng(11)
    dates = [dt.date(2001, 1, 1) + dt.timedelta(k) for k in range(130)]
    wide = rng.normal(0, 0.01, (130, 3))
    wide[70, 0], wide[90:, 2] = 0.4, 0.0  # an outlier, and a series that falls silent
    rows = [("p", d, f"t{k}", float(wide[i, k])) for i, d in enumerate(dates) for k in range(3)] + [("q", d, "t0", float(wide[i, 0])) for i, d in enumerate(dates)] + [("s", dates[0], "t0", 0.5)]
    rets = spark.createDataFrame(rows, "panel_id string, date date, ticker string, ret double").cache()
    for options in ({}, {"clip": False}, {"demean": False}):
        got = {(r["panel_id"], r["i"], r["j"], r["date"]): r["cov"] for r in covariance.ewma_covariance(rets, 20, 252.0, **options, days=days).collect()}
        full = {"clip": True, "demean": True, **options}
        for a in range(3):
            for b in range(3):
                for d, want in zip(dates, loop(wide[:, a], wide[:, b], 20, full["clip"], full["demean"], False), strict=True):
                    assert got["p", f"t{a}", f"t{b}", d] == (want if want is None else pytest.approx(252 * want, rel=1e-9, abs=1e-18))
        for d, want in zip(dates, loop(wide[:, 0], wide[:, 0], 20, full["clip"], full["demean"], True), strict=True):
            assert got["q", "t0", "t0", d] == (want if want is None else pytest.approx(252 * want, rel=1e-9))
        assert got["s", "t0", "t0", dates[0]] is None and len(got) == 130 * 10 + 1
    var = {(r["panel_id"], r["ticker"], r["date"]): r["var"] for r in covariance.ewma_variance(rets, 20, 252.0, days=days).collect()}
    whole = {(r["panel_id"], r["i"], r["date"]): r["cov"] for r in covariance.ewma_covariance(rets, 20, 252.0, days=days).where("i = j").collect()}
    assert var.keys() == whole.keys() and all(var[k] == (whole[k] if whole[k] is None else pytest.approx(whole[k], rel=1e-9)) for k in var)
    assert covariance.ewma_covariance(rets.where("false"), 20).count() == 0


@pytest.mark.parametrize("days", [4096, 25])
def test_moments_by_ranges(spark, days):
    rng = np.random.default_rng(12)
    x = rng.standard_t(2, 200) * 0.01
    x[:12] = 0.0  # dead from the start: nothing is known of its volatility
    rows = [("p", dt.date(1969, 9, 1) + dt.timedelta(k), t, None if k % 50 == 7 else float(x[k] * s)) for k in range(200) for t, s in (("a", 1.0), ("b", 0.0))]
    got = by_series(covariance.ewma_moments(spark.createDataFrame(rows, "panel_id string, date date, ticker string, ret double"), 10, days=days).collect())
    kept = np.array([v for k, v in enumerate(x) if k % 50 != 7])
    for ticker, s in (("a", kept), ("b", kept * 0)):
        decay, var, mean = 1 - 2 / 11, s[:10].var(), s[:10].mean()
        cut, _ = ewma.clip(s.tolist(), decay, var)
        assert len(got["p", ticker]) == len(kept)
        for r, c in zip(got["p", ticker], cut, strict=True):
            mean, var = (1 - decay) * c + decay * mean, (1 - decay) * c * c + decay * var
            assert (r["clipped"], r["mean"], r["vol"]) == pytest.approx((c, mean, var**0.5), rel=1e-9, abs=1e-15)


@pytest.mark.parametrize(("tile", "block_rows"), [(3, 7), (2, 512), (64, 25)])
def test_covariances_by_tiles(spark, monkeypatch, tile, block_rows):
    monkeypatch.setattr(covariance, "TILE", tile)
    rng = np.random.default_rng(13)
    dates = [dt.date(2001, 1, 1) + dt.timedelta(k) for k in range(60)]
    wide = rng.normal(0, 0.01, (60, 8)) @ rng.normal(size=(8, 8))
    rows = [("p", d, f"t{k}", None if (i, k) == (20, 3) else float(wide[i, k])) for i, d in enumerate(dates) for k in range(8)]
    rows += [("q", d, f"t{k}", float(wide[i, k])) for i, d in enumerate(dates[:30]) for k in range(min(tile + 1, 8))] + [("r", dates[0], "t0", 0.1)]
    rets = spark.createDataFrame(rows, "panel_id string, date date, ticker string, ret double").cache()
    kept = {"p": [k for k in range(60) if k != 20], "q": list(range(30))}
    got = {(r["panel_id"], r["date"], r["i"], r["j"]): r["cov"] for r in covariance.sample_covariance(rets, 10, 252.0, block_rows=block_rows).collect()}
    run = {(r["panel_id"], r["date"], r["i"], r["j"]): r["cov"] for r in covariance.ewma_covariance(rets, 10, days=25).collect()}
    width = {"p": 8, "q": min(tile + 1, 8)}
    assert got.keys() == run.keys() and len(got) == 59 * 64 + 30 * width["q"] ** 2 + 1 and got["r", dates[0], "t0", "t0"] is None
    for name, days in kept.items():
        for a in range(width[name]):
            for b in range(width[name]):
                x, y = wide[days, a], wide[days, b]
                want = loop(x, y, 10, True, True, False)
                for k, i in enumerate(days):
                    key = (name, dates[i], f"t{a}", f"t{b}")
                    assert got[key] == (pytest.approx(252 * np.cov(x[k - 9 : k + 1], y[k - 9 : k + 1])[0, 1], rel=1e-9, abs=1e-15) if k >= 9 else None)
                    assert run[key] == (want[k] if want[k] is None else pytest.approx(want[k], rel=1e-9, abs=1e-18))
    assert covariance.sample_covariance(rets.where("false"), 5).count() == 0
