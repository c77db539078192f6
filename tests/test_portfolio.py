"""The portfolio engine: queries against DuckDB on the smallest tables, hand-made cases, and invariants."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from panelforge.functions import scans, series
from panelforge.operators import backtest as bt
from panelforge.operators import calendar, covariance, exposure, factors, fx, performance, returns, risk, views
from panelforge.plans import catalog, factor_sql, panel_sql
from panelforge.sources import dims, panel

SF = "/root/testdata/sf0.001"
#: The smallest tables on which all tickers share dates, as the factor queries need.
FACTOR_SF = "/root/testdata/sf0.01"


def duck(folder):
    con = duckdb.connect()
    for table in ("lineitem", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(None if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_against_sql(spark, name):
    folder = FACTOR_SF if name in {**factor_sql.SQL, **panel_sql.SQL} else SF
    want = duck(folder).execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    got = catalog.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(names)
    a, b = plain(tuple(r) for r in got.select(*names).collect()), plain(want.fetchall())
    assert len(a) == len(b) and a == b


def test_all_queries_are_listed():
    import __spark_entry__ as entry

    assert set(catalog.SQL) == set(catalog.QUERIES) <= set(entry.queries()) and catalog.FLAGSHIP in catalog.QUERIES


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(n)


def make(spark, rows, columns="panel_id string, date date, ticker string, price double"):
    return spark.createDataFrame(rows, columns)


def one_series(spark, values, name="T"):
    return make(spark, [("p", day(k), name, v) for k, v in enumerate(values)])


def values(df, column, *order):
    return [r[column] for r in df.orderBy(*(order or ("date",))).collect()]


def test_fills(spark):
    x = one_series(spark, [1.0, *[None] * 7, 2.0, None, None])
    w = series.along()
    assert values(x.withColumn("v", series.forward_fill(F.col("price"), w, 5)), "v") == [1.0] * 6 + [None, None, 2.0, 2.0, 2.0]
    assert values(x.withColumn("v", series.fill_budget(F.col("price"), w)), "v") == [1.0, *[0.0] * 5, None, None, 2.0, None, None]
    both = scans.fill_both_ways(one_series(spark, [None, 3.0, None]), "price", series.KEYS)
    assert values(both, "price") == [3.0] * 3
    with pytest.raises(ValueError):
        series.lagged_return(F.col("price"), w, method="geometric")


def test_returns_and_indices(spark):
    x = one_series(spark, [100.0, 110.0, None, 121.0, 121.0])
    assert values(returns.returns(x, method="simple"), "ret") == pytest.approx([None, 0.1, None, None, 0.0], nan_ok=True)
    level = returns.growth(returns.returns(x, method="simple"), "simple")
    assert values(level, "level") == pytest.approx([None, 1.1, None, None, 1.1])
    assert values(returns.padded_changes(x), "ret") == pytest.approx([None, 0.1, 0.0, 0.1, 0.0])


@pytest.mark.parametrize(("year", "policy", "n"), [(2022, "month_start", 12), (2022, "month_end", 12), (2018, "month_end", 12)])
def test_calendar(spark, year, policy, n):
    days = [dt.date(year, 1, 1) + dt.timedelta(k) for k in range(365)]
    df = spark.createDataFrame([("p", d) for d in days if d.weekday() < 5], "panel_id string, date date")
    assert calendar.rebalance_dates(df, policy).count() == n
    assert calendar.rebalance_mask(df, calendar.rebalance_dates(df, "once")).where("is_rebal").count() == 1
    closed = df.where("date <> '2018-03-30'")
    if year == 2018:  # the month end is a business day on which the market was closed
        assert calendar.rebalance_dates(closed, policy).count() == 11
    with pytest.raises(ValueError):
        calendar.rebalance_dates(df, "weekly")


def test_holidays_against_pandas(spark):
    from pandas.tseries.holiday import USFederalHolidayCalendar

    want = {d.date() for d in USFederalHolidayCalendar().holidays("2000-01-01", "2030-12-31")}
    df = spark.sql("SELECT explode(sequence(date'2000-01-01', date'2030-12-31')) AS d").where(calendar.federal_holiday(F.col("d")))
    assert {r["d"] for r in df.collect()} == want


def test_fx(spark):
    p = make(spark, [("p", day(k), "A", 100.0 * (k + 1)) for k in range(3)])
    rates = spark.createDataFrame([(day(k), "EURUSD=X", 2.0) for k in range(3)], "date date, pair string, rate double")
    asset = lambda c: dims.assets(spark, (dims.Asset("A", "x", "A", c),))
    assert values(fx.normalize(p, asset("USD"), rates, "USD"), "price") == [100.0, 200.0, 300.0]
    assert values(fx.normalize(p, asset("EUR"), rates, "USD"), "price") == [200.0, 400.0, 600.0]
    assert values(fx.normalize(p, asset("USD"), rates, "EUR"), "price") == [50.0, 100.0, 150.0]
    with pytest.raises(ValueError):
        fx.normalize(p, asset("CHF"), rates, "EUR")
    flat = fx.risk_free(p.select("panel_id", "date", F.lit(2.52).alias("value")), "USD")
    assert values(flat, "rf") == pytest.approx([0.0001] * 3)


def loop_backtest(p, w, hits, cost_rate):
    cash, u, nav, out = 1e6, [0.0] * len(p[0]), 1e6, []
    for t, row in enumerate(p):
        cost = 0.0
        if t in hits:
            before = p[max(0, t - 1)]
            new = [nav * x / q for x, q in zip(w, before, strict=True)]
            cost = sum(abs(a - b) * q for a, b, q in zip(new, u, row, strict=True)) * cost_rate
            cash -= cost + sum((a - b) * q for a, b, q in zip(new, u, row, strict=True))
            u = new
        nav = cash + sum(a * q for a, q in zip(u, row, strict=True))
        out.append((nav, cash, cost))
    return out


@pytest.mark.parametrize(("hits", "weights", "rate"), [({0, 2}, {"A": 0.6, "B": 0.4}, 0.001), ({3}, {"A": 0.5, "B": 0.4}, 0.001), ({1, 2, 3}, {"A": 1.0, "B": 0.0}, 0.0)])
def test_backtest(spark, hits, weights, rate):
    table = [[100.0, 50.0], [101.0, 49.0], [103.0, 52.0], [99.0, 51.0], [98.0, 55.0]]
    p = make(spark, [("p", day(k), t, v) for k, row in enumerate(table) for t, v in zip("AB", row, strict=True)])
    rebal = spark.createDataFrame([("p", day(k)) for k in sorted(hits)], "panel_id string, date date")
    result = bt.backtest(p, bt.targets(rebal, dims.portfolio(spark, weights)), cost_rate=rate)
    got = [(r["nav"], r["cash"], r["cost"]) for r in result.orderBy("date").collect()]
    assert got == [pytest.approx(x) for x in loop_backtest(table, list(weights.values()), hits, rate)]
    held = bt.holdings(result).groupBy("panel_id", "date").agg(F.sum("weight").alias("w")).join(result, ["panel_id", "date"])
    assert all(r["w"] + r["cash"] / r["nav"] == pytest.approx(1) for r in held.collect())


def test_performance(spark):
    nav = spark.createDataFrame([("p", day(k), 100 * 1.001**k) for k in range(252)], "panel_id string, date date, nav double")
    zero = nav.select("date", F.lit(0.0).alias("rf"))
    rets = performance.nav_returns(nav, zero)
    figures = {r["metric"]: r for r in performance.summary(rets).collect()}
    assert figures["Annualized Return (CAGR)"]["value"] == pytest.approx((1.001**251) ** (252 / 251) - 1)
    assert figures["Start Period"]["day"] == day(0) and figures["Longest drawdown (days)"]["value"] == 0
    assert figures["3M"]["value"] == pytest.approx(1.001**62 - 1)
    excess = spark.createDataFrame([("p", day(k), e) for k, e in enumerate([0.1, -0.1, -0.1, 0.5, -0.1, -0.01, -0.01, 1.0])], "panel_id string, date date, excess double")
    assert performance.longest_drawdown(performance.drawdowns(excess)).first()["longest"] == 3
    gap = spark.createDataFrame([("p", dt.date(2020, 1, 5), 0.1), ("p", dt.date(2020, 3, 5), 0.2)], "panel_id string, date date, excess double")
    assert [round(r["ret"], 9) for r in performance.monthly_returns(gap).orderBy("month").collect()] == [0.1, 0.0, 0.2]


def random_panel(spark, n=4, days=160, seed=3):
    import numpy as np

    rng = np.random.default_rng(seed)
    level = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, (days, n)) + rng.normal(0, 0.01, (days, 1)), axis=0))
    return make(spark, [("p", day(t), f"T{k + 1}", float(level[t, k])) for t in range(days) for k in range(n)])


def test_risk_sums_to_one(spark):
    p = random_panel(spark)
    cov = covariance.ewma_covariance(returns.returns(p, method="simple"), 21)
    x = p.select("panel_id", "date", F.col("ticker").alias("label"), F.lit(0.25).alias("exposure"))
    total = risk.contributions(risk.pick_dates(x, "all"), cov).groupBy("date").agg(F.sum("ctr_pct").alias("s"), F.sum("ctr").alias("c"), F.first("vol").alias("v")).collect()
    live = [r for r in total if r["s"] is not None]
    assert len(live) > 100 and all(abs(r["s"] - 1) < 1e-9 and math.isclose(r["c"], r["v"]) for r in live)
    assert risk.pick_dates(x).count() == 4
    with pytest.raises(ValueError):
        risk.pick_dates(x, "never")


def test_two_parents_agree_with_the_general_solution(spark):
    p = random_panel(spark, 3)
    rf = p.select("date", F.lit(0.0001).alias("rf")).distinct()
    ex = returns.excess_returns(p, rf).withColumnRenamed("ex1", "ret")
    cov = covariance.ewma_covariance(ex, 30, value="exw")
    some = (dims.FACTORS[0], dims.FACTORS[1], dims.FACTORS[2])
    general = factors.residualize(ex, cov, some).where("factor = 'Credit'")
    a, b = values(general, "ret"), values(factors.residualize_two(ex, cov, "T3", "T1", "T2"), "ret")
    assert [x is None for x in a] == [x is None for x in b] and sum(x is not None for x in a) == 130
    assert [x for x in a if x is not None] == pytest.approx([x for x in b if x is not None], abs=1e-9)
    with pytest.raises(ValueError):
        dims.check_factors(dims.FACTORS[2:])
    with pytest.raises(ValueError):
        factors.construct(p.where("ticker <> 'T2'"), rf, some)


def test_attribution_adds_up(spark):
    p = random_panel(spark, 3, 150)
    rf = p.select("date", F.lit(0.0001).alias("rf")).distinct()
    levels = p.where("ticker <> 'T3'").select("panel_id", "date", F.col("ticker").alias("factor"), F.col("price").alias("level"))
    nav = p.where("ticker = 'T3'").select("panel_id", "date", F.col("price").alias("nav"))
    fits = exposure.exposures(levels, nav, rf, lookback=60)
    daily = exposure.attribution(fits, levels, nav, rf)
    wide = daily.groupBy("date").pivot("component").agg(F.first("contrib")).orderBy("date").collect()
    live = [r for r in wide if r["Total"] is not None]
    assert len(live) == 149
    for r in live:
        assert (r["T1"] or 0) + (r["T2"] or 0) + r["RiskFree"] + r["Residual"] == pytest.approx(r["Total"])
    assert sum(r["T1"] is not None for r in live) == 90
    full = {r["term"]: r for r in exposure.exposures(levels, nav, rf, "full").collect()}
    assert set(full) == {"const", "T1", "T2"} and full["T1"]["date"] == day(149)
    assert views.color_domain(exposure.trend(daily, 20)).first()["low"] < 0


def test_sources(spark, tmp_path):
    p = random_panel(spark, 2, 5)
    wide = panel.to_wide(p.drop("panel_id"), ["T1", "T2"]).withColumnRenamed("date", "Date").orderBy("Date")
    wide.coalesce(1).write.csv(str(tmp_path / "wide"), header=True)
    source = panel.WideCsvSource(str(tmp_path / "wide"))
    assert source.load(spark, ["T1", "T2"], "2020-01-02").count() == 8
    full = panel.as_panel(source.load(spark, ["T1"]))
    assert full.count() == 5 and panel.missing_tickers(full, ["T1", "T9"]) == ["T9"]
    problems = {r["problem"]: r["rows"] for r in panel.invalid_rows(one_series(spark, [1.0, None, -1.0]), make(spark, [("p", day(0), "T", -1.0), ("p", day(9), "T", 0.1)], "panel_id string, date date, ticker string, weight double")).collect()}
    assert problems == {"price missing or not finite": 1, "price not positive": 1, "weight missing or not finite": 0, "weight negative": 1, "weight without price": 1, "price without weight": 0}


def two_panels(spark, n=160):
    """Two panels of the same tickers on the same dates, the second one's prices twice as wild."""
    import random

    rows = []
    for panel_id, size in (("p", 0.01), ("q", 0.02)):
        rng = random.Random(3)
        for name in ("T1", "T2", "T3"):
            price = 100.0
            for k in range(n):
                price *= 1 + size * rng.uniform(-1, 1)
                rows.append((panel_id, day(k), name, price))
    return make(spark, rows)


def test_panels_do_not_meet(spark):
    """Every operator gives each of two panels what it gives it alone."""
    p = two_panels(spark)
    rf = p.select("panel_id", "date").distinct().withColumn("rf", F.when(F.col("panel_id") == "p", 0.0001).otherwise(0.0003))
    held = lambda x: x.where("ticker <> 'T3'")

    def figures(x, free):
        levels = x.select("panel_id", "date", F.col("ticker").alias("factor"), F.col("price").alias("level"))
        target = bt.targets(calendar.rebalance_dates(held(x), "month_start"), dims.portfolio(spark))
        result = bt.run_backtest(held(x), target)
        rets = performance.nav_returns(result, free)
        fits = exposure.exposures(levels, result, free, "rolling", 60)
        cov = covariance.ewma_covariance(returns.returns(held(x), method="simple"), 30)
        shares = risk.contributions(risk.pick_dates(bt.holdings(result).select("panel_id", "date", F.col("ticker").alias("label"), F.col("weight").alias("exposure"))), cov)
        out = {
            "excess": returns.excess_returns(x, free), "nav": result.drop("positions"), "summary": performance.summary(rets), "drawdown": performance.drawdowns(rets), "months": performance.monthly_returns(rets), "cov": cov,
            "sample": covariance.sample_covariance(returns.returns(x), 20), "corr": covariance.correlation(returns.returns(x)), "fits": fits, "full": exposure.exposures(levels, result, free, "full"),
            "attribution": exposure.attribution(fits, levels, result, free), "risk": shares, "ranked": views.ranked_risk(shares), "matrix": covariance.latest_matrix(cov, ["T1", "T2"]),
            "benchmark": performance.benchmark_excess(rets, x.where("ticker = 'T3'"), free), "weights": views.latest_weights(bt.holdings(result)), "clipped": covariance.ewma_moments(returns.returns(x), 30),
        }
        return {k: plain(tuple(r) for r in v.collect()) for k, v in out.items()}

    both = figures(p, rf)
    one, two = (figures(p.where(F.col("panel_id") == k), rf.where(F.col("panel_id") == k)) for k in ("p", "q"))
    for name, rows in both.items():
        assert rows == sorted(one[name] + two[name], key=str) and one[name] != two[name], name


def test_blocks_of_dates_are_the_whole(spark, monkeypatch):
    p = two_panels(spark).where("panel_id = 'p'")
    rf = p.select("date").distinct().withColumn("rf", F.lit(0.0001))
    levels = p.where("ticker <> 'T3'").select("panel_id", "date", F.col("ticker").alias("factor"), F.col("price").alias("level"))
    nav = p.where("ticker = 'T3'").select("panel_id", "date", F.col("price").alias("nav"))
    whole = plain(tuple(r) for r in exposure.exposures(levels, nav, rf, "rolling", 40).collect())
    monkeypatch.setattr(exposure, "BLOCK_ROWS", 13)
    cut = exposure.exposures(levels, nav, rf, "rolling", 40)
    assert plain(tuple(r) for r in cut.collect()) == whole and len(whole) == 160 * 3


def test_a_flat_nav_keeps_its_lines(spark):
    flat = spark.createDataFrame([("p", day(k), 100.0) for k in range(5)], "panel_id string, date date, nav double")
    rf = spark.createDataFrame([(day(k), 0.0) for k in range(5)], "date date, rf double")
    lines = {r["metric"]: r["value"] for r in performance.summary(performance.nav_returns(flat, rf)).collect()}
    assert lines["Sharpe"] is None and lines["Max drawdown"] == 0.0 and lines["Annualized Historical Volatility"] == 0.0


def test_runs_are_checked_first(spark):
    p = two_panels(spark, 40).where("panel_id = 'p' and ticker <> 'T3'")
    target = bt.targets(calendar.rebalance_dates(p, "month_start"), dims.portfolio(spark))
    assert bt.run_backtest(p, target).count() == 40
    for bad in (target.withColumn("weight", F.lit(float("inf"))), target.where("ticker = 'T1'"), target.where("false"), target.withColumn("ticker", F.lit("T9"))):
        with pytest.raises(ValueError):
            bt.run_backtest(p, bad)
    with pytest.raises(ValueError):
        bt.run_backtest(p.withColumn("price", F.lit(None).cast("double")), target)
    with pytest.warns(RuntimeWarning):
        bt.run_backtest(p, target.withColumn("weight", F.when(F.col("ticker") == "T2", -0.1).otherwise(0.5)))


def test_period_rules():
    d = dt.date
    assert calendar.check_period(d(2018, 1, 1), d(2024, 1, 1), d(2015, 1, 1), d(2023, 6, 1)) == (d(2018, 1, 1), d(2023, 6, 1))
    assert calendar.check_period(d(2023, 1, 1), d(2024, 1, 1), d(2015, 1, 1), d(2030, 1, 1)) == (d(2024, 1, 1) - dt.timedelta(1277), d(2024, 1, 1))
    assert calendar.check_period(d(2023, 1, 1), d(2024, 1, 1), d(2015, 1, 1), d(2030, 1, 1), override=True) == (d(2023, 1, 1), d(2024, 1, 1))
    assert calendar.check_period(d(2018, 1, 1), d(2024, 1, 1), d(2030, 1, 1), d(2031, 1, 1)) is None
    for start, end in ((d(2018, 1, 1), d(2022, 5, 31)), (d(2024, 1, 1), d(2024, 1, 1)), (d(2025, 1, 1), d(2024, 1, 1))):
        with pytest.raises(ValueError):
            calendar.check_period(start, end, d(2015, 1, 1), d(2030, 1, 1))


def test_wide_csv_and_notes(spark, tmp_path):
    p = two_panels(spark, 20).where("panel_id = 'p'")
    panel.write_wide_csv(p, str(tmp_path / "wide"), ["T1", "T3"])
    back = panel.WideCsvSource(str(tmp_path / "wide")).load(spark, ["T1", "T3"])
    want = plain(tuple(r) for r in p.where("ticker <> 'T2'").select("date", "ticker", "price").collect())
    assert plain(tuple(r) for r in back.collect()) == want
    assert panel.clamp(p, "1990-01-01", "1991-01-01").count() == 0
    shares = spark.createDataFrame([("p", day(0), "A", 1.0, 0.1, 0.02), ("p", day(0), "B", 2.0, 0.2, 0.98), ("p", day(0), "C", 0.0, 0.0, None)], "panel_id string, date date, label string, exposure double, mctr double, ctr_pct double").withColumn("ctr", F.col("mctr"))
    ranked = views.ranked_risk(shares)
    assert [(r["label"], r["labelled"]) for r in ranked.orderBy("rank").collect()] == [("B", True), ("A", False), ("C", False)]
    assert [r["label"] for r in views.ranked_risk(shares, 0.05).collect()] == ["B"]
    table = views.markdown_risk(ranked).first()["table"].split("\n")
    assert table[2] == "| B | 2.0000 | 0.2000 | 0.2000 | 0.9800 |" and table[4].endswith("nan |")
    betas = spark.createDataFrame([("p", "A", 0.5), ("p", "B", 2.0)], "panel_id string, factor string, beta double")
    assert [r["factor"] for r in views.by_beta(betas).orderBy("place").collect()] == ["B", "A"]


def test_one_call_for_the_whole_analysis(spark):
    from panelforge.plans import analysis, queries

    request = analysis.Request("EUR", dt.date(1993, 1, 1), dt.date(1998, 1, 1), "month_end", {"T1": 0.3, "T2": 0.7}, least_end=dt.date(1995, 1, 1))
    found = analysis.analyse(queries.prices(spark, "/root/testdata/sf0.01"), dims.assets(spark), queries.rates(spark, "/root/testdata/sf0.01"), queries.money(spark, "/root/testdata/sf0.01", "EUR"), request, dims.FACTORS, analysis.Spans(60, 40, 60, 30))
    nav = found["backtest"]
    first, last = nav.agg(F.min("date"), F.max("date")).first()
    assert first >= dt.date(1993, 1, 1) and last <= dt.date(1998, 1, 1) and nav.count() > 900
    assert found["summary"].count() >= 10 and found["asset_risk"].agg(F.sum("ctr_pct")).first()[0] == pytest.approx(1)
    parts = {r["component"]: r["s"] for r in found["attribution"].groupBy("component").agg(F.sum("contrib").alias("s")).collect()}
    assert sum(v for k, v in parts.items() if k != "Total") == pytest.approx(parts["Total"])
    assert found["betas"].count() == 7 and found["factor_risk"].agg(F.sum("ctr_pct")).first()[0] == pytest.approx(1)
    with pytest.raises(ValueError):
        analysis.analyse(queries.prices(spark, "/root/testdata/sf0.01"), dims.assets(spark), queries.rates(spark, "/root/testdata/sf0.01"), queries.money(spark, "/root/testdata/sf0.01", "EUR"), analysis.Request(start=dt.date(1993, 1, 1), end=dt.date(1998, 1, 1)), dims.FACTORS)
