"""Factor construction: proxies' excess returns, children with their parents taken out, scaled to a target volatility."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.series import day_keys
from panelforge.operators.covariance import ewma_covariance, ewma_variance
from panelforge.operators.returns import excess_returns
from panelforge.kernels import regression
from panelforge.sources.dims import Factor, check_factors
from panelforge.sources.shared import written

RESIDUAL = "panel_id string, date date, factor string, ret double"


def residualize(ex1: DataFrame, cov: DataFrame, factors: tuple[Factor, ...], ridge: float = 1e-7) -> DataFrame:
    """(panel_id, date, factor, ret): each proxy's excess return, for children less what their raw parents explain.

    ex1 is (panel_id, date, ticker, ret), cov the covariances of the same tickers; both of a date meet in a row, so dates spread
    over all tasks. A child is null where a covariance or a return is missing.
    """
    check_factors(factors)
    tickers = [f.ticker for f in factors]
    place = {f.name: k for k, f in enumerate(factors)}
    n = len(factors)
    day = ["panel_id", "date"]
    rets = ex1.where(F.col("ticker").isin(tickers)).groupBy(*day).agg(F.map_from_entries(F.collect_list(F.struct("ticker", "ret"))).alias("r"))
    covs = cov.where(F.col("i").isin(tickers) & F.col("j").isin(tickers)).groupBy(*day).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\t", "i", "j"), "cov"))).alias("c"))
    row = rets.join(covs, day, "left").select(
        *day, F.array(*[F.try_element_at("r", F.lit(t)) for t in tickers]).alias("r"), F.array(*[F.try_element_at("c", F.lit(f"{a}\t{b}")) for a in tickers for b in tickers]).alias("c")
    )

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            r = np.array([[np.nan if x is None else x for x in v] for v in frame["r"]], np.float64)
            c = np.array([[np.nan if x is None else x for x in v] for v in frame["c"]], np.float64).reshape(len(frame), n, n)
            for k, f in enumerate(factors):
                at = [place[p] for p in f.parents]
                y = regression.residuals(c[:, at][:, :, at], c[:, at, k], r[:, k], r[:, at], ridge) if at else r[:, k]
                yield pd.DataFrame({"panel_id": frame["panel_id"], "date": frame["date"], "factor": f.name, "ret": pd.Series(y, frame.index).astype(object).where(~np.isnan(y), None)})

    return row.mapInPandas(solve, RESIDUAL)


def residualize_two(ex1: DataFrame, cov: DataFrame, child: str, first: str, second: str, ridge: float = 1e-7) -> DataFrame:
    """(panel_id, date, ret): the child less two parents, by the closed form of the two equations; native."""
    day = ["panel_id", "date"]
    names = {child: "y", first: "a", second: "b"}
    r = ex1.groupBy(*day).agg(*[F.max(F.when(F.col("ticker") == t, F.col("ret"))).alias(n) for t, n in names.items()])
    pick = lambda i, j, name: F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("cov"))).alias(name)
    c = cov.groupBy(*day).agg(pick(first, first, "aa"), pick(second, second, "bb"), pick(first, second, "ab"), pick(first, child, "ay"), pick(second, child, "by"))
    c = c.withColumns({"aa": F.col("aa") + ridge, "bb": F.col("bb") + ridge})
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    one = F.try_divide(F.col("ay") * F.col("bb") - F.col("by") * F.col("ab"), det)
    two = F.try_divide(F.col("by") * F.col("aa") - F.col("ay") * F.col("ab"), det)
    return r.join(c, day, "left").select(*day, (F.col("y") - one * F.col("a") - two * F.col("b")).alias("ret"))


def construct(prices: DataFrame, rf: DataFrame, factors: tuple[Factor, ...], cov_span: int = 750, scale_span: int = 120, target_vol: float = 0.15, window: int = 5, scale: bool = True) -> DataFrame:
    """(panel_id, date, factor, ret): total log returns of the factors.

    Covariances of window-row excess returns over cov_span take the parents out of one-row returns; children are then scaled to
    target_vol by their own volatility over scale_span (on dates that have one; if none has, neither scaled nor given the
    risk-free rate back), and the log risk-free rate is added. Raises ValueError if a proxy is missing.
    """
    check_factors(factors)
    present = {r["ticker"] for r in prices.select("ticker").distinct().collect()}
    lost = [f.ticker for f in factors if f.ticker not in present]
    if lost:
        raise ValueError(f"prices lack {lost}")
    # both are needed twice
    ex = written(excess_returns(prices.where(F.col("ticker").isin([f.ticker for f in factors])), rf, window), "excess")
    cov = ewma_covariance(ex.select("panel_id", "date", "ticker", F.col("exw").alias("ret")), cov_span)
    raw = written(residualize(ex.select("panel_id", "date", "ticker", F.col("ex1").alias("ret")), cov, factors), "raw")
    on = day_keys(rf)
    free = rf.select(*on, F.log1p("rf").alias("_rf"))
    out = raw.join(free, on, "left")
    if scale:
        vols = ewma_variance(raw.select("panel_id", "date", F.col("factor").alias("ticker"), "ret"), scale_span, annualize=252.0)
        vols = vols.select("panel_id", "date", F.col("ticker").alias("factor"), F.nullif(F.sqrt("var"), F.lit(0.0)).alias("_vol"))
        children = [f.name for f in factors if f.parents]
        child = F.col("factor").isin(children)
        dead = F.count("_vol").over(Window.partitionBy("panel_id", "factor")) == 0
        out = out.join(vols, ["panel_id", "date", "factor"], "left").withColumn("_dead", child & dead)
        scaled = F.when(~child | F.col("_dead"), F.col("ret")).otherwise(F.col("ret") * F.lit(target_vol) / F.col("_vol"))
        return out.select("panel_id", "date", "factor", F.when(F.col("_dead"), scaled).otherwise(scaled + F.col("_rf")).alias("ret"))
    return out.select("panel_id", "date", "factor", (F.col("ret") + F.col("_rf")).alias("ret"))
