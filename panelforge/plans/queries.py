"""The portfolio engine's queries over the derived price panel: each takes (spark, sf_dir) and returns a DataFrame.

Dates are shown as text and floats rounded, so that results can be compared with other engines.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions import scans, series
from panelforge.functions.scans import running
from panelforge.operators import backtest as bt
from panelforge.operators import calendar, covariance, exposure, factors, fx, performance, returns, risk, views
from panelforge.plans import analysis
from panelforge.sources import dims, fetched, panel
from panelforge.sources.shared import shared_folder, written

#: Covariances are shown by year, in squared percent.
SHOWN = 252e4
#: Spans for the derived panel's length (the defaults need about a thousand complete dates).
COV_SPAN, SCALE_SPAN, LOOKBACK, RISK_WINDOW, TREND = 120, 60, 120, 63, 126
TICKERS = [f"T{k}" for k in range(1, 8)]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
        _KEPT.clear()  # a query sees its input as it is now, whatever ran before
        return f(spark, sf_dir)

    fresh.__name__ = f.__name__
    QUERIES[f.__name__] = fresh
    return fresh


_KEPT: dict[tuple[str, str], DataFrame] = {}


def shared(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Writes what f returns to the shared folder, once in a query: what builds on it has a short plan, and steps needed twice run once."""

    def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (sf_dir, f.__name__)
        if key not in _KEPT:
            _KEPT[key] = written(f(spark, sf_dir), f.__name__)
        return _KEPT[key]

    return kept


def r(name: str, digits: int = 6) -> Column:
    return (F.round(F.col(name), digits) + F.lit(0.0)).alias(name)


def shown(df: DataFrame, *keys: str, **floats: int) -> DataFrame:
    """keys (dates as text, whole numbers as long) and floats rounded to so many digits."""
    kinds = dict(df.dtypes)
    text = lambda k: F.col(k).cast("string").alias(k) if kinds[k] == "date" else F.col(k).cast("long").alias(k) if kinds[k] in ("int", "bigint") else F.col(k)
    return df.select(*map(text, keys), *(r(k, d) for k, d in floats.items()))


@shared
def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.as_panel(panel.LineitemSource(f"{sf_dir}/lineitem.parquet").load(spark))


def numbered_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(panel_id, date, rn): the panel's dates, numbered."""
    days = prices(spark, sf_dir).select("panel_id", "date").distinct()
    return days.withColumn("rn", F.row_number().over(series.along("panel_id")))


@shared
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, pair, rate): made of the dates' numbers."""
    d = numbered_dates(spark, sf_dir)
    made = {"EURUSD=X": F.lit(1.1) + F.lit(0.0001) * (F.col("rn") % 100), "CHFUSD=X": F.lit(1.05) - F.lit(0.0001) * (F.col("rn") % 70), "CHFEUR=X": F.lit(0.95) + F.lit(0.0002) * (F.col("rn") % 30)}
    return d.select("date", F.inline(F.array(*[F.struct(F.lit(k).alias("pair"), v.alias("rate")) for k, v in made.items()])))


def yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_dates(spark, sf_dir).select("panel_id", "date", (F.lit(2.0) + F.lit(0.01) * (F.col("rn") % 50)).alias("value"))


@shared
def rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.risk_free(yields(spark, sf_dir), "USD").select("date", "rf")


def money(spark: SparkSession, sf_dir: str, base: str) -> DataFrame:
    """(panel_id, date, value): what the base currency's risk-free rate is made of."""
    if base == "USD":
        return yields(spark, sf_dir)
    ticker = dims.RISK_FREE[base]
    return dense(spark, sf_dir).where(F.col("ticker") == ticker).select("panel_id", "date", F.col("price").alias("value"))


@shared
def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.densify(prices(spark, sf_dir))


# panels


@query
def panel_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(prices(spark, sf_dir), "date", "ticker", price=9)


@query
def panel_wide_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(panel.to_wide(prices(spark, sf_dir), TICKERS), "date", **dict.fromkeys(TICKERS, 9))


@query
def panel_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(panel.to_long(panel.to_wide(prices(spark, sf_dir), TICKERS)), "date", "ticker", price=9)


@query
def panel_complete_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(panel.complete_dates(prices(spark, sf_dir)), "date", "ticker", price=9)


@query
def panel_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(panel.clamp(prices(spark, sf_dir), "1990-01-01", "1997-12-31"), "date", "ticker", price=9)


@query
def panel_ffill5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(panel.fill_prices(prices(spark, sf_dir)), "date", "ticker", price=9)


@query
def ffill_bfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(scans.fill_both_ways(dense(spark, sf_dir), "price", series.KEYS), "date", "ticker", price=9)


@query
def fill_budget0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(scans.fill_budget(dense(spark, sf_dir), "price", series.KEYS), "date", "ticker", price=9)


@query
def input_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dense(spark, sf_dir)
    target = bt.targets(calendar.rebalance_dates(p, "month_start"), dims.portfolio(spark, {"T1": 0.6, "T2": 0.5, "T9": -0.1}))
    return shown(panel.invalid_rows(p.drop("panel_id"), target.drop("panel_id")), "problem", "rows")


# returns


@query
def returns_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(returns.returns(prices(spark, sf_dir)), "date", "ticker", ret=8)


@query
def returns_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(returns.returns(prices(spark, sf_dir), method="simple"), "date", "ticker", ret=8)


@query
def returns_5d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(returns.returns(prices(spark, sf_dir), 5), "date", "ticker", ret=8)


@query
def pct_change_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(returns.padded_changes(prices(spark, sf_dir)), "date", "ticker", ret=8)


@query
def index_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(returns.growth(returns.returns(prices(spark, sf_dir))), "date", "ticker", level=6)


@query
def index_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(returns.growth(returns.returns(prices(spark, sf_dir), method="simple"), "simple"), "date", "ticker", level=6)


@query
def excess_returns_1d_5d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(returns.excess_returns(prices(spark, sf_dir), rf(spark, sf_dir)), "date", "ticker", ex1=8, exw=8)


# currencies and rates


@query
def fx_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(fx.normalize(prices(spark, sf_dir), dims.assets(spark), rates(spark, sf_dir), "EUR"), "date", "ticker", price=6)


@query
def fx_triangulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prices(spark, sf_dir).where("ticker = 'T5'").select("panel_id", "date", "price")
    return shown(fx.triangulate(p, rates(spark, sf_dir).where(F.dayofmonth("date") > 5), "CHF"), "date", price=9)


@query
def risk_free_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fx.risk_free(yields(spark, sf_dir), "USD").select("panel_id", "date", F.lit("USD").alias("base"), "rf")
    for base in ("EUR", "CHF"):
        out = out.unionByName(fx.risk_free(money(spark, sf_dir, base), base).select("panel_id", "date", F.lit(base).alias("base"), "rf"))
    return shown(out, "date", "base", rf=8)


# calendars


def _mask(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    p = prices(spark, sf_dir)
    return calendar.rebalance_mask(p, calendar.rebalance_dates(p, policy)).select(F.col("date").cast("string").alias("date"), "is_rebal")


@query
def rebal_month_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mask(spark, sf_dir, "month_start")


@query
def rebal_month_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mask(spark, sf_dir, "month_end")


@query
def buy_and_hold_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mask(spark, sf_dir, "once")


# the portfolio


@shared
def portfolio_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.complete_dates(prices(spark, sf_dir).where(F.col("ticker").isin(list(dims.PORTFOLIO))))


@shared
def portfolio_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.targets(calendar.rebalance_dates(portfolio_prices(spark, sf_dir), "month_start"), dims.portfolio(spark))


@shared
def portfolio_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.backtest(portfolio_prices(spark, sf_dir), portfolio_targets(spark, sf_dir))


@shared
def portfolio_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.nav_returns(portfolio_backtest(spark, sf_dir), rf(spark, sf_dir))


@query
def target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(portfolio_targets(spark, sf_dir), "date", "ticker", weight=4)


@query
def backtest_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(portfolio_backtest(spark, sf_dir), "date", nav=4, cash=4)


@query
def backtest_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(bt.holdings(portfolio_backtest(spark, sf_dir)), "date", "ticker", units=4, weight=6)


@query
def backtest_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(portfolio_backtest(spark, sf_dir).where("cost > 0"), "date", cost=4)


@query
def backtest_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = portfolio_backtest(spark, sf_dir)
    return shown(bt.turnover(result).join(bt.gross_exposure(result), ["panel_id", "date"]), "date", turnover=6, gross=6)


@query
def weight_deviation_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(bt.weight_deviation(portfolio_backtest(spark, sf_dir), portfolio_targets(spark, sf_dir), dims.assets(spark)), "date", "series", value=6)


@query
def perf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(performance.summary(portfolio_returns(spark, sf_dir)), "ord", "metric", "day", value=6)


@query
def ytd_trailing_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(performance.trailing_returns(portfolio_backtest(spark, sf_dir)), ytd=6, m3=6, m6=6, y1=6)


@query
def cagr_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(performance.cagr_and_vol(portfolio_returns(spark, sf_dir)), cagr=6, vol=6)


@query
def sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(performance.sharpe(portfolio_returns(spark, sf_dir)), sharpe=6)


@query
def drawdown_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(performance.drawdowns(portfolio_returns(spark, sf_dir)), "date", level=6, drawdown=6)


@query
def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(performance.drawdowns(portfolio_returns(spark, sf_dir)).groupBy("panel_id").agg(F.min("drawdown").alias("max_dd")), max_dd=6)


@query
def longest_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    # runs are counted on rounded drawdowns, so that a last digit doesn't end a run
    dd = performance.drawdowns(portfolio_returns(spark, sf_dir)).select("panel_id", "date", r("drawdown", 9))
    return shown(performance.longest_drawdown(dd), "longest")


@query
def current_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(performance.current_drawdown(portfolio_backtest(spark, sf_dir)), current=6)


@query
def rolling_vol_126(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(performance.rolling_volatility(portfolio_returns(spark, sf_dir)), "date", vol=6)


@query
def monthly_return_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(performance.monthly_returns(portfolio_returns(spark, sf_dir)), "year", "month", ret=6)


@query
def monthly_return_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
    return shown(views.month_matrix(performance.monthly_returns(portfolio_returns(spark, sf_dir))), "year", **dict.fromkeys(names, 6))


@query
def universe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.universe_table(bt.holdings(portfolio_backtest(spark, sf_dir)), dims.assets(spark)).drop("panel_id")


@query
def weights_nonzero_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(views.latest_weights(bt.holdings(portfolio_backtest(spark, sf_dir))), "ticker", "shown", weight=6)


@query
def formatted_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = performance.summary(portfolio_returns(spark, sf_dir))
    return s.select(F.col("ord").cast("long").alias("ord"), "metric", views.format_metric(F.col("metric"), F.col("value"), F.col("day")).alias("shown"))


# covariances and risk


@shared
def log_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.returns(panel.complete_dates(prices(spark, sf_dir)))


@query
def sample_cov_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(covariance.sample_covariance(log_returns(spark, sf_dir), RISK_WINDOW, SHOWN), "date", "i", "j", cov=4)


@query
def factor_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(covariance.correlation(log_returns(spark, sf_dir)), "i", "j", corr=6)


@query
def ewma_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(covariance.ewma_moments(log_returns(spark, sf_dir), 63), "date", "ticker", clipped=8, mean=8, vol=8)


@query
def ewma_cov_noclip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(covariance.ewma_covariance(log_returns(spark, sf_dir), 63, SHOWN, clip=False, demean=False), "date", "i", "j", cov=4)


@query
def ewma_cov_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(covariance.ewma_covariance(log_returns(spark, sf_dir), 63, SHOWN), "date", "i", "j", cov=4)


@shared
def asset_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covariance.sample_covariance(returns.returns(portfolio_prices(spark, sf_dir), method="simple"), RISK_WINDOW)


@shared
def asset_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.holdings(portfolio_backtest(spark, sf_dir)).select("panel_id", "date", F.col("ticker").alias("label"), F.col("weight").alias("exposure"))


RISK = {"exposure": 6, "vol": 6, "mctr": 6, "ctr": 6, "ctr_pct": 6}


@query
def risk_asset_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(risk.contributions(risk.pick_dates(asset_exposures(spark, sf_dir)), asset_cov(spark, sf_dir)), "date", "label", **RISK)


@query
def risk_asset_rebal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebal = calendar.rebalance_dates(portfolio_prices(spark, sf_dir), "month_start")
    return shown(risk.contributions(risk.pick_dates(asset_exposures(spark, sf_dir), "rebal_only", rebal), asset_cov(spark, sf_dir)), "date", "label", **RISK)


@query
def risk_asset_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    cov = covariance.ewma_covariance(returns.returns(portfolio_prices(spark, sf_dir), method="simple"), 63)
    return shown(risk.contributions(risk.pick_dates(asset_exposures(spark, sf_dir), "all"), cov), "date", "label", **RISK)


@query
def risk_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = risk.contributions(risk.pick_dates(asset_exposures(spark, sf_dir)), asset_cov(spark, sf_dir))
    return shown(risk.by_class(c, dims.assets(spark)), "date", "asset_class", ctr_pct=6)


# factors


@shared
def factor_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.construct(panel.complete_dates(prices(spark, sf_dir)), rf(spark, sf_dir), dims.FACTORS, COV_SPAN, SCALE_SPAN)


@shared
def factor_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = factor_returns(spark, sf_dir).withColumnRenamed("factor", "ticker")
    return returns.growth(rows).withColumnRenamed("ticker", "factor")


def aligned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Factor levels and the NAV on the dates that they share."""
    levels, nav = factor_levels(spark, sf_dir), portfolio_backtest(spark, sf_dir).select("panel_id", "date", "nav")
    days = levels.select("panel_id", "date").distinct()
    return levels.join(nav.select("panel_id", "date"), ["panel_id", "date"], "left_semi"), nav.join(days, ["panel_id", "date"], "left_semi")


@shared
def fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels, nav = aligned(spark, sf_dir)
    return exposure.exposures(levels, nav, rf(spark, sf_dir), "rolling", LOOKBACK)


@shared
def proxy_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """regression_returns() of the raw proxies."""
    p = panel.complete_dates(prices(spark, sf_dir))
    levels = p.select("panel_id", "date", F.col("ticker").alias("factor"), F.col("price").alias("level"))
    nav = portfolio_backtest(spark, sf_dir).join(p.select("panel_id", "date").distinct(), ["panel_id", "date"], "left_semi")
    return exposure.regression_returns(levels, nav, rf(spark, sf_dir))


@query
def residualize_two_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = returns.excess_returns(panel.complete_dates(prices(spark, sf_dir)), rf(spark, sf_dir))
    cov = covariance.sample_covariance(ex, RISK_WINDOW, value="exw")
    return shown(factors.residualize_two(ex.withColumnRenamed("ex1", "ret"), cov, "T3", "T1", "T2"), "date", ret=8)


@query
def residualize_four_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = returns.excess_returns(panel.complete_dates(prices(spark, sf_dir)), rf(spark, sf_dir))
    cov = covariance.ewma_covariance(ex, COV_SPAN, value="exw")
    return shown(factors.residualize(ex.withColumnRenamed("ex1", "ret"), cov, dims.FACTORS), "date", "factor", ret=8)


@query
def factor_construction_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(factor_returns(spark, sf_dir), "date", "factor", ret=8)


@query
def factor_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(factor_levels(spark, sf_dir), "date", "factor", level=6)


@query
def beta_full_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(exposure.single_beta(proxy_inputs(spark, sf_dir), "T1"), beta=6, alpha=6, rsq=6)


@query
def beta_rolling_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(exposure.single_beta_rolling(proxy_inputs(spark, sf_dir), "T1", LOOKBACK), "date", beta=6)


#: t statistics in the thousands have no more digits that two orders of summation share.
FIT = {"beta": 6, "t_stat": 2, "rsq": 6, "resid_var": 8}


@query
def beta_full_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels, nav = aligned(spark, sf_dir)
    return shown(exposure.exposures(levels, nav, rf(spark, sf_dir), "full"), "date", "term", **FIT)


@query
def beta_rolling_multi_hac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(fitted(spark, sf_dir), "date", "term", **FIT)


@query
def rolling_beta_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(views.rolling_betas(fitted(spark, sf_dir)), "date", "factor", beta=6, t_stat=2)


@query
def latest_beta_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(views.latest_betas(fitted(spark, sf_dir), dims.factors(spark)), "factor", "significant", "color_key", "note", beta=6, t_stat=2)


@shared
def daily_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels, nav = aligned(spark, sf_dir)
    return exposure.attribution(fitted(spark, sf_dir), levels, nav, rf(spark, sf_dir))


@query
def attribution_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(daily_attribution(spark, sf_dir), "date", "component", contrib=8)


@query
def attribution_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = exposure.trend(daily_attribution(spark, sf_dir), TREND).withColumn("place", views.component_order(F.col("component")))
    return shown(t, "date", "component", "place", contrib=8)


@query
def trend_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(views.color_domain(exposure.trend(daily_attribution(spark, sf_dir), TREND)), low=8, high=8)


def factor_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple returns of the factors' levels."""
    levels = factor_levels(spark, sf_dir).select("panel_id", "date", F.col("factor").alias("ticker"), F.col("level").alias("price"))
    return returns.returns(levels, method="simple")


def factor_risk(spark: SparkSession, sf_dir: str, which: str = "latest", method: str = "ewma") -> DataFrame:
    fits = fitted(spark, sf_dir).where("term <> 'const'").select("panel_id", "date", F.col("term").alias("label"), F.col("beta").alias("exposure"))
    rebal = calendar.rebalance_dates(portfolio_prices(spark, sf_dir), "US Month Start") if which == "rebal_only" else None
    return risk.contributions(risk.pick_dates(fits.where("exposure is not null"), which, rebal), covariance.by_method(factor_steps(spark, sf_dir), method, RISK_WINDOW))


@query
def factor_risk_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(factor_risk(spark, sf_dir), "date", "label", **RISK)


@query
def factor_risk_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(factor_risk(spark, sf_dir, method="sample"), "date", "label", **RISK)


@query
def factor_risk_rebal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(factor_risk(spark, sf_dir, "rebal_only"), "date", "label", **RISK)


@query
def variance_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = fitted(spark, sf_dir).where("term = 'const'")
    return shown(risk.variance_split(factor_risk(spark, sf_dir, "all"), fits), "date", systematic_vol=6, idio_vol=6, systematic_share=6, idio_share=6)


@query
def context_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    result, fits = portfolio_backtest(spark, sf_dir), fitted(spark, sf_dir)
    split = risk.variance_split(factor_risk(spark, sf_dir), fits.where("term = 'const'"))
    summary = performance.summary(performance.nav_returns(result, rf(spark, sf_dir)))
    return views.context_snapshot(summary, views.latest_weights(bt.holdings(result)), performance.current_drawdown(result), views.latest_betas(fits, dims.factors(spark)), split)


@query
def analysis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one call by other parameters than the queries above: in EUR, from the month ends, at even weights."""
    request = analysis.Request("EUR", dt.date(1980, 1, 1), dt.date(2010, 1, 1), "month_end", {"T1": 0.5, "T2": 0.5}, least_end=dt.date(1995, 1, 1))
    found = analysis.portfolio_tables(prices(spark, sf_dir), dims.assets(spark), rates(spark, sf_dir), money(spark, sf_dir, "EUR"), request)
    return shown(found["summary"], "ord", "metric", "day", value=6)


@query
def analysis_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factor half of the one call: with all assets in the base currency, it is what the steps give one by one."""
    request = analysis.Request("USD", dt.date(1980, 1, 1), dt.date(2010, 1, 1), least_end=dt.date(1995, 1, 1))
    spans = analysis.Spans(COV_SPAN, SCALE_SPAN, LOOKBACK, RISK_WINDOW, TREND)
    found = analysis.analyse(prices(spark, sf_dir), dims.assets(spark).withColumn("currency", F.lit("USD")), rates(spark, sf_dir), money(spark, sf_dir, "USD"), request, spans=spans)
    return shown(found["split"], "date", systematic_vol=6, idio_vol=6, systematic_share=6, idio_share=6)


# many panels at once: a panel for each region of suppliers


@shared
def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.lineitem_panels(spark, sf_dir, "region")


@shared
def region_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(panel_id, date, rf): made of the numbers of each panel's dates."""
    days = running(regions(spark, sf_dir).select("panel_id", "date").distinct(), ["panel_id"], rn=("sum", F.lit(1).cast("long")))
    return fx.risk_free(days.select("panel_id", "date", (F.lit(2.0) + F.lit(0.01) * (F.col("rn") % 50)).alias("value")), "USD")


@shared
def region_backtests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.complete_dates(regions(spark, sf_dir).where(F.col("ticker").isin(list(dims.PORTFOLIO))))
    return bt.backtest(p, bt.targets(calendar.rebalance_dates(p, "month_start"), dims.portfolio(spark)))


@query
def panels_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(region_backtests(spark, sf_dir), "panel_id", "date", nav=4, cash=4)


@query
def panels_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(performance.summary(performance.nav_returns(region_backtests(spark, sf_dir), region_rates(spark, sf_dir))), "panel_id", "ord", "metric", "day", value=6)


@query
def panels_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(performance.drawdowns(performance.nav_returns(region_backtests(spark, sf_dir), region_rates(spark, sf_dir))), "panel_id", "date", level=6, drawdown=6)


@query
def panels_ewma_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rets = returns.returns(panel.complete_dates(regions(spark, sf_dir)))
    return shown(covariance.ewma_moments(rets, 63), "panel_id", "date", "ticker", clipped=8, mean=8, vol=8)


# sources that fetch, and a calendar of one's own


@query
def fetched_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of the tickers and three of the years, by a data source that is asked for these alone."""
    source = fetched.FetchedSource("panelforge.sources.fetched:lineitem_prices", path=f"{sf_dir}/lineitem.parquet")
    rows = source.load(spark, TICKERS).where(F.col("ticker").isin("T2", "T5") & F.col("date").between(dt.date(1993, 1, 1), dt.date(1995, 12, 31)))
    return shown(rows, "date", "ticker", price=9)


@query
def cached_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a cache that has a year of one ticker and then loads what three years of two tickers lack."""
    cache = fetched.GapCache(spark, f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}", panel.LineitemSource(f"{sf_dir}/lineitem.parquet"))
    cache.prices(["T1"], "1994-01-01", "1994-12-31")
    return shown(cache.prices(["T1", "T2"], "1993-01-01", "1995-12-31"), "date", "ticker", price=9)


def third_fridays(first: dt.date, last: dt.date) -> Iterator[dt.date]:
    day = first
    while day <= last:
        if day.weekday() == 4 and 15 <= day.day <= 21:
            yield day
        day += dt.timedelta(1)


@query
def rebal_third_friday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask of a calendar made by a plain function of each panel's span."""
    p = regions(spark, sf_dir).select("panel_id", "date")
    rebal = calendar.rebalance_dates(p, generator=calendar.generated_by(third_fridays))
    return calendar.rebalance_mask(p, rebal).select("panel_id", F.col("date").cast("string").alias("date"), "is_rebal")


# tables for display


@query
def benchmark_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = prices(spark, sf_dir).where("ticker = 'T6'").select("panel_id", "date", "price")
    return shown(performance.benchmark_excess(portfolio_returns(spark, sf_dir), other, rf(spark, sf_dir)), "date", excess=8, benchmark=8)


@query
def latest_cov_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = covariance.latest_matrix(covariance.sample_covariance(log_returns(spark, sf_dir), RISK_WINDOW, SHOWN), TICKERS)
    return shown(m, "date", "label", **dict.fromkeys(TICKERS, 4))


@query
def risk_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = risk.contributions(risk.pick_dates(asset_exposures(spark, sf_dir)), asset_cov(spark, sf_dir))
    return shown(views.ranked_risk(c), "rank", "label", "labelled", ctr_pct=6)


@query
def risk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = risk.contributions(risk.pick_dates(asset_exposures(spark, sf_dir)), asset_cov(spark, sf_dir))
    return views.markdown_risk(views.ranked_risk(c)).select("table")


@query
def monthly_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(views.symmetric_range(performance.monthly_returns(portfolio_returns(spark, sf_dir))), low=6, high=6)


@query
def monthly_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(views.month_cells(performance.monthly_returns(portfolio_returns(spark, sf_dir))), "place", "year", "month", ret=6)


@query
def risk_free_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the currencies of the assets that the panel has, and one that no rate is known for."""
    held = prices(spark, sf_dir).select("ticker").distinct().join(dims.assets(spark), "ticker").select(F.lower("currency").alias("base")).distinct()
    return views.risk_free_note(held.unionByName(spark.createDataFrame([("xyz",)], "base string")), dims.RISK_FREE, dims.assets(spark))


@query
def backtest_cost_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trade day's cost, and the rate it comes to on what is traded."""
    result = portfolio_backtest(spark, sf_dir)
    traded = bt.turnover(result).join(result.select("panel_id", "date", "nav", "cost").where("cost > 0"), ["panel_id", "date"])
    return traded.select(F.col("date").cast("string").alias("date"), views.cost_in_bps(F.col("cost") / (F.col("turnover") * F.col("nav"))).alias("note"), r("cost", 4))


@query
def period_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month of the panel as a requested start, its last date as the end: the period that the rules make of it."""
    span = prices(spark, sf_dir).groupBy("panel_id", F.trunc("date", "month").alias("start")).agg(F.max("date").alias("end"))
    start, end = calendar.clamp_period(F.col("start"), F.col("end"), "1995-06-01")
    return span.select(F.col("start").cast("string").alias("asked"), start.cast("string").alias("start"), end.cast("string").alias("end"))


@query
def ticker_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.ticker_union(prices(spark, sf_dir), dims.assets(spark), dims.factors(spark))


@query
def present_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = prices(spark, sf_dir).select("ticker").distinct().join(dims.factors(spark).where("size(parents) < 4"), "ticker").select(F.col("name").alias("factor"))
    return views.shown_factors(have, [f.name for f in reversed(dims.FACTORS)])


@query
def betas_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.by_beta(views.latest_betas(fitted(spark, sf_dir), dims.factors(spark)))
    return shown(t, "place", "factor", beta=6)
