"""Returns, growth indices and excess returns of panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.scans import running
from panelforge.functions.series import along, check_method, day_keys, fill_budget, lagged_return, padded_change
from panelforge.sources.panel import densify


def returns(panel: DataFrame, lookback: int = 1, method: str = "log") -> DataFrame:
    """(panel_id, date, ticker, ret) on the dense grid; null for the first lookback rows and around missing prices."""
    return densify(panel).select("panel_id", "date", "ticker", lagged_return(F.col("price"), along(), lookback, method).alias("ret"))


def padded_changes(panel: DataFrame) -> DataFrame:
    return densify(panel).select("panel_id", "date", "ticker", padded_change(F.col("price"), along()).alias("ret"))


def growth(rets: DataFrame, method: str = "log") -> DataFrame:
    """(panel_id, date, ticker, level) from returns: what 1 invested before the first row is worth; rows without a return stay null and count as no change."""
    step = ("sum", F.col("ret")) if check_method(method) == "log" else ("product", 1 + F.col("ret"))
    total = running(rets.select("panel_id", "date", "ticker", "ret"), ["panel_id", "ticker"], total=step)
    level = F.exp("total") if step[0] == "sum" else F.col("total")
    return total.select("panel_id", "date", "ticker", F.when(F.col("ret").isNotNull(), level).alias("level"))


def excess_returns(panel: DataFrame, rf: DataFrame, window: int = 5) -> DataFrame:
    """(panel_id, date, ticker, ex1, exw): log returns over one row and over window rows, less the log risk-free rate once and window times.

    rf is (date, rf), a simple daily rate, with a panel_id if panels have rates of their own. Missing returns are filled with 0 before the rate is taken off, up to five in a series.
    """
    w = along()
    both = densify(panel).select("panel_id", "date", "ticker", lagged_return(F.col("price"), w).alias("r1"), lagged_return(F.col("price"), w, window).alias("rw"))
    filled = both.select("panel_id", "date", "ticker", fill_budget(F.col("r1"), w).alias("r1"), fill_budget(F.col("rw"), w).alias("rw"))
    on = day_keys(rf)
    free = rf.select(*on, F.log1p("rf").alias("_rf"))
    return filled.join(free, on, "left").select("panel_id", "date", "ticker", (F.col("r1") - F.col("_rf")).alias("ex1"), (F.col("rw") - window * F.col("_rf")).alias("exw"))
