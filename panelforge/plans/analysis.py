"""The whole analysis of a portfolio in one call: from prices, rates and a request to the tables that a monitor shows."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import backtest as bt
from panelforge.operators import calendar, covariance, exposure, factors, fx, performance, returns, risk, views
from panelforge.sources import dims, panel
from panelforge.sources.shared import written


@dataclass(frozen=True)
class Request:
    """What is asked for: base currency, period (as check_period() takes it), rebalance policy, and target weights by ticker."""

    base: str = "USD"
    start: dt.date = dt.date(2018, 1, 1)
    end: dt.date = dt.date(2025, 11, 30)
    policy: str = "month_start"
    weights: dict[str, float] = field(default_factory=lambda: dict(dims.PORTFOLIO))
    override: bool = False
    least_end: dt.date = dt.date(2022, 6, 1)


@dataclass(frozen=True)
class Spans:
    """Rows that the estimates look back at: factor covariances, factor volatilities, regressions, risk."""

    factor_cov: int = 750
    scale: int = 120
    lookback: int = 120
    risk: int = 63
    trend: int = 126


def portfolio_tables(prices: DataFrame, assets: DataFrame, rates: DataFrame, money: DataFrame, request: Request, spans: Spans = Spans()) -> dict[str, DataFrame]:
    """The part of analyse() that needs no factors; also prices, in the base currency, and free, the risk-free rate."""
    first, last = prices.agg(F.min("date"), F.max("date")).first()
    period = calendar.check_period(request.start, request.end, first, last, request.least_end, override=request.override) if first else None
    if period is None:
        raise ValueError("no prices in the period")
    start, end = (str(x) for x in period)
    local = written(fx.normalize(panel.clamp(prices, start, end), assets, rates, request.base), "prices")
    free = written(fx.risk_free(panel.clamp(money, start, end), request.base).select("panel_id", "date", "rf"), "free")

    held = panel.complete_dates(local.where(F.col("ticker").isin(list(request.weights))))
    target = bt.targets(calendar.rebalance_dates(held, request.policy), dims.portfolio(prices.sparkSession, request.weights))
    result = written(bt.run_backtest(held, target), "backtest")
    rets = performance.nav_returns(result, free)
    shares = bt.holdings(result).select("panel_id", "date", F.col("ticker").alias("label"), F.col("weight").alias("exposure"))
    asset_cov = covariance.ewma_covariance(returns.returns(held, method="simple"), spans.risk)
    return {
        "prices": local,
        "free": free,
        "backtest": result,
        "returns": rets,
        "summary": performance.summary(rets),
        "drawdown": performance.drawdowns(rets),
        "months": performance.monthly_returns(rets),
        "deviation": bt.weight_deviation(result, target, assets),
        "asset_risk": views.ranked_risk(risk.contributions(risk.pick_dates(shares), asset_cov)),
    }


def analyse(prices: DataFrame, assets: DataFrame, rates: DataFrame, money: DataFrame, request: Request, proxies: tuple[dims.Factor, ...] = dims.FACTORS, spans: Spans = Spans()) -> dict[str, DataFrame]:
    """The tables by name: prices, free, backtest, returns, summary, drawdown, months, deviation, asset_risk, factors, fits, betas, attribution, trend, factor_risk, split.

    prices (panel_id, date, ticker, price) has the portfolio's tickers and the factors' proxies, rates (date, pair, rate) the
    currencies, money (panel_id, date, value) what the base currency's risk-free rate is made of. The portfolio is held on
    dates that have all its prices, factors are made on those that have all proxies. Every panel is analysed by itself.
    Raises ValueError for a request that can't be met.
    """
    found = portfolio_tables(prices, assets, rates, money, request, spans)
    free, result = found["free"], found["backtest"]
    local = panel.complete_dates(found["prices"].where(F.col("ticker").isin([f.ticker for f in proxies])))
    made = factors.construct(local, free, proxies, spans.factor_cov, spans.scale)
    levels = written(returns.growth(made.withColumnRenamed("factor", "ticker")).withColumnRenamed("ticker", "factor"), "levels")  # dense: children start later than parents
    days = levels.select("panel_id", "date").distinct()
    nav = result.select("panel_id", "date", "nav").join(days, ["panel_id", "date"], "left_semi")
    fits = written(exposure.exposures(levels, nav, free, "rolling", spans.lookback), "fits")
    daily = written(exposure.attribution(fits, levels, nav, free), "attribution")
    as_prices = levels.select("panel_id", "date", F.col("factor").alias("ticker"), F.col("level").alias("price"))
    factor_cov = written(covariance.ewma_covariance(returns.returns(as_prices, method="simple"), spans.risk), "factor_cov")
    betas = fits.where("term <> 'const' and beta is not null").select("panel_id", "date", F.col("term").alias("label"), F.col("beta").alias("exposure"))
    return found | {
        "factors": levels,
        "fits": fits,
        "betas": views.latest_betas(fits, dims.factors(prices.sparkSession, proxies)),
        "attribution": daily,
        "trend": exposure.trend(daily, spans.trend),
        "factor_risk": views.ranked_risk(risk.contributions(risk.pick_dates(betas), factor_cov)),
        "split": risk.variance_split(risk.contributions(betas, factor_cov), fits.where("term = 'const'")),
    }
