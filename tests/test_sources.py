"""Sources that fetch by ticker, the cache that asks only for what it lacks, calendars by functions, many panels."""

import datetime as dt
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelforge.operators import backtest as bt
from panelforge.operators import calendar, exposure
from panelforge.kernels import regression
from panelforge.sources import fetched, panel

DAY0 = dt.date(2020, 1, 1)
FETCHER = "tests.fetchers:logged"


def day(k):
    return DAY0 + dt.timedelta(k)


def asked(log):
    out = sorted(os.listdir(log))
    for name in out:
        os.remove(f"{log}/{name}")
    return out


def test_a_source_is_asked_only_for_what_is_needed(spark, tmp_path):
    source = fetched.FetchedSource(FETCHER, log=str(tmp_path))
    rows = source.load(spark, ["A", "B", "C"]).where(F.col("ticker").isin("A", "C") & (F.col("date") > day(3)) & (F.col("date") <= day(5)) & (F.col("price") < 70))
    assert sorted(tuple(r) for r in rows.collect()) == [(day(4), "A", 69.0)]
    assert asked(tmp_path) == [f"A-{day(4)}-{day(5)}", f"C-{day(4)}-{day(5)}"]
    assert source.load(spark, ["A", "B"], "2020-01-02", "2020-01-03").rdd.getNumPartitions() == 2
    assert source.load(spark, ["A"], "2020-01-02", "2020-01-04").where(F.col("date") == day(2)).count() == 1
    assert asked(tmp_path) == [f"A-{day(2)}-{day(2)}"]
    assert source.load(spark, ["A"]).where(F.col("ticker") == "Z").count() == 0 and source.load(spark, []).count() == 0
    assert asked(tmp_path) == []
    assert {(r["date"], r["ticker"]) for r in source.load(spark, ["B"], end="2020-01-02").collect()} == {(day(0), "B"), (day(1), "B")}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 8)), max_size=5), st.integers(0, 25), st.integers(0, 10))
def test_gaps_are_what_is_not_covered(covered, first, n):
    spans = [fetched.Span(day(a), day(a + b)) for a, b in covered]
    wanted = {day(k) for k in range(first, first + n + 1)}
    have = {s.start + dt.timedelta(k) for s in spans for k in range((s.end - s.start).days + 1)}
    found = fetched.gaps(fetched.Span(day(first), day(first + n)), spans)
    days = [g.start + dt.timedelta(k) for g in found for k in range((g.end - g.start).days + 1)]
    assert len(days) == len(set(days)) and set(days) == wanted - have
    assert all(b.start > a.end + fetched.DAY for a, b in zip(found, found[1:]))


def test_gaps_without_ends():
    whole = fetched.Span(fetched.FIRST, fetched.LAST)
    assert fetched.gaps(whole, [whole]) == [] and fetched.gaps(whole, []) == [whole]
    assert fetched.gaps(whole, [fetched.Span(day(3), fetched.LAST)]) == [fetched.Span(fetched.FIRST, day(2))]


def test_cache_loads_what_it_lacks(spark, tmp_path):
    log, path = tmp_path / "log", str(tmp_path / "cache")
    log.mkdir()
    cache = fetched.GapCache(spark, path, fetched.FetchedSource(FETCHER, log=str(log)))
    assert cache.version() == 0
    span = (day(5).isoformat(), day(9).isoformat())
    assert cache.prices(["A"], *span).count() == 5 and asked(log) == [f"A-{day(5)}-{day(9)}"]
    assert cache.prices(["A"], *span).count() == 5 and asked(log) == [] and cache.version() == 1
    # one more ticker: only it is asked for; a longer span: only its ends
    assert cache.prices(["A", "B"], *span).count() == 10 and asked(log) == [f"B-{day(5)}-{day(9)}"]
    assert cache.prices(["A"], day(2).isoformat(), day(12).isoformat()).count() == 11
    assert asked(log) == [f"A-{day(2)}-{day(4)}", f"A-{day(10)}-{day(12)}"]
    before = sorted(map(tuple, cache.prices(["A", "B"], *span).collect()))
    cache.merge()
    assert asked(log) == [] and cache.version() == 4 and cache.covered().count() == 2 and cache.covered().select("part").distinct().count() == 1
    assert sorted(map(tuple, cache.prices(["A", "B"], *span).collect())) == before and len(before) == 10
    full = {r["date"]: r["price"] for r in cache.panel(["A"], *span).collect()}
    assert min(full) == day(2) and asked(log) == []


def test_a_failed_load_leaves_the_cache_as_it_was(spark, tmp_path):
    class Broken(panel.PriceSource):
        def load(self, spark, tickers, start=None, end=None):
            return spark.range(3).select(F.raise_error(F.lit("lost")).cast("date").alias("date"), F.lit("B").alias("ticker"), F.lit(1.0).alias("price"))

    log = tmp_path / "log"
    log.mkdir()
    path = str(tmp_path / "cache")
    good = fetched.GapCache(spark, path, fetched.FetchedSource(FETCHER, log=str(log)))
    before = sorted(map(tuple, good.prices(["A"]).collect()))
    with pytest.raises(Exception, match="lost"):
        fetched.GapCache(spark, path, Broken()).prices(["A", "B"])
    assert good.version() == 1 and sorted(map(tuple, good.prices(["A"]).collect())) == before and len(before) == 30
    os.makedirs(f"{path}/version-2")  # a version whose write ended half-way
    assert good.version() == 1 and good.prices(["A", "B"]).count() == 60 and good.version() == 2


def test_calendars_by_a_function(spark):
    def every_third(first, last):
        d = first - dt.timedelta(3)
        while d <= last + dt.timedelta(3):  # dates out of the span do no harm
            yield d
            d += dt.timedelta(3)

    rows = [("p", day(k)) for k in range(10) if k != 6] + [("q", day(k)) for k in range(4, 8)]
    got = calendar.rebalance_dates(spark.createDataFrame(rows, "panel_id string, date date"), generator=calendar.generated_by(every_third))
    assert sorted(map(tuple, got.collect())) == [("p", day(0)), ("p", day(3)), ("p", day(9)), ("q", day(4)), ("q", day(7))]
    none = spark.createDataFrame([], "panel_id string, date date")
    assert calendar.rebalance_dates(none, generator=calendar.generated_by(every_third)).count() == 0


def test_daily_rebalancing_over_many_dates(spark):
    n, weights = 10_000, {"T1": 0.6, "T2": 0.4}
    price = {t: [100 + (k * m) % 13 + k / 1000 for k in range(n)] for t, m in (("T1", 5), ("T2", 7))}
    rows = [(p, day(k), t, price[t][k] * s) for p, s in (("p", 1.0), ("q", 2.0)) for t in weights for k in range(n)]
    prices = spark.createDataFrame(rows, "panel_id string, date date, ticker string, price double")
    target = bt.targets(prices.select("panel_id", "date").distinct(), spark.createDataFrame(list(weights.items()), "ticker string, weight double"))
    got = {(r["panel_id"], r["date"]): r for r in bt.backtest(prices, target).collect()}
    assert len(got) == 2 * n
    for p, s in (("p", 1.0), ("q", 2.0)):
        cash, units = 1e6, {"T1": 0.0, "T2": 0.0}
        for k in range(n):
            at, before = ({t: price[t][x] * s for t in weights} for x in (k, max(k - 1, 0)))
            nav = cash + sum(units[t] * before[t] for t in weights)
            new = {t: nav * w / before[t] for t, w in weights.items()}
            cost = 0.001 * sum(abs(new[t] - units[t]) * at[t] for t in weights)
            cash -= cost + sum((new[t] - units[t]) * at[t] for t in weights)
            units = new
            if k % 500 == 0 or k == n - 1:
                r = got[p, day(k)]
                assert (r["cash"], r["cost"], r["nav"]) == pytest.approx((cash, cost, cash + sum(units[t] * at[t] for t in weights)), rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("block_rows", [4096, 17, 5, 1])
@pytest.mark.parametrize("max_lags", [0, 5])
def test_full_regressions_by_blocks(spark, block_rows, max_lags):
    import numpy as np

    rng = np.random.default_rng(3)
    rows, want = [], {}
    for p, n, names in (("p", 90, ("f", "g")), ("q", 60, ("g",)), ("r", 2, ("f", "g"))):
        x = rng.normal(0, 0.01, (n, len(names)))
        y = x @ np.arange(1, len(names) + 1) + rng.normal(0, 0.002, n)
        if n > 50:
            x[7, 0] = np.nan
        rows += [(p, day(k), s, None if np.isnan(v) else float(v)) for k in range(n) for s, v in (*zip(names, x[k], strict=True), ("nav", y[k]))]
        want[p] = (day(n - 1), names, regression.ols_hac(x, y, max_lags))
    got = {(r["panel_id"], r["term"]): r for r in exposure.full_exposures(spark.createDataFrame(rows, "panel_id string, date date, series string, x double"), max_lags, block_rows).collect()}
    assert len(got) == 3 + 2 + 3
    for p, (last, names, (beta, t, rsq, var)) in want.items():
        for k, term in enumerate(("const", *names)):
            r = got[p, term]
            assert r["date"] == last
            if p == "r":
                assert r["beta"] is None and r["t_stat"] is None and r["rsq"] is None and r["resid_var"] is None
            else:
                assert (r["beta"], r["t_stat"], r["rsq"], r["resid_var"]) == pytest.approx((beta[k], t[k], rsq, var), rel=1e-8)
