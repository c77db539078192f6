"""Rebalancing backtests.

A portfolio's state changes on rebalance dates only: a fold over these, streamed in order of date and carrying the last state,
gives cash, units and cost after each one; on all other dates the state is the last one, and values are a join away.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.scans import running
from panelforge.functions.series import along, upto
from panelforge.sources.panel import invalid_rows


def targets(rebal: DataFrame, weights: DataFrame) -> DataFrame:
    """(panel_id, date, ticker, weight): the same weights (ticker, weight) on all rebalance dates."""
    rows = weights.agg(F.collect_list(F.struct("ticker", "weight")).alias("_w"))  # a portfolio, not a growing table
    listed = rows.first()["_w"]
    return rebal.select("panel_id", "date", F.inline(F.array(*[F.struct(F.lit(r["ticker"]).alias("ticker"), F.lit(r["weight"]).alias("weight")) for r in listed])))


def rebalanced(cash: float, units: list[float], at: list[float], before: list[float], weights: list[float], cost_rate: float) -> tuple[float, list[float], float]:
    """Cash, units and cost after one rebalancing: sized on the NAV at the prices before, traded at the prices at it."""
    nav = cash + sum(u * p for u, p in zip(units, before, strict=True))
    new = [nav * w / p for w, p in zip(weights, before, strict=True)]
    moved = [n - u for n, u in zip(new, units, strict=True)]
    cost = sum(abs(m) * p for m, p in zip(moved, at, strict=True)) * cost_rate
    return cash - cost - sum(m * p for m, p in zip(moved, at, strict=True)), new, cost


def backtest(prices: DataFrame, target: DataFrame, initial_cash: float = 1_000_000.0, cost_rate: float = 0.0010) -> DataFrame:
    """(panel_id, date, nav, cash, cost, positions array of (ticker, units, price, weight)) for every date of prices.

    prices (panel_id, date, ticker, price) has a price for each ticker on each date; target (panel_id, date, ticker, weight) has
    weights on the rebalance dates. Units are sized on the NAV and prices of the date before (on the first date, on the
    initial cash and that date's prices) and traded at the date's prices; cost_rate of what is traded is paid from cash.
    Weights leave out cash. Raises if a NAV is negative.
    """
    day = ["panel_id", "date"]
    quotes = prices.groupBy(*day).agg(F.sort_array(F.collect_list(F.struct("ticker", "price"))).alias("q"))
    quotes = quotes.withColumn("before", F.coalesce(F.lag("q").over(along("panel_id")), F.col("q")))
    wanted = target.groupBy(*day).agg(F.map_from_entries(F.collect_list(F.struct("ticker", "weight"))).alias("w"))
    events = quotes.join(wanted, day).select(
        *day,
        F.transform("q", lambda x: x["price"]).alias("p"),
        F.transform("before", lambda x: x["price"]).alias("b"),
        F.transform("q", lambda x: F.coalesce(F.try_element_at("w", x["ticker"]), F.lit(0.0))).alias("w"),
    )
    events = events.repartition("panel_id").sortWithinPartitions(*day)

    def traded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, cash, units = None, initial_cash, None
        for batch in batches:
            out: list[dict] = []
            for panel, date, at, before, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if units is None or panel != name:
                    name, cash, units = panel, initial_cash, [0.0] * len(at)
                cash, units, cost = rebalanced(cash, units, at, before, weights, cost_rate)
                out.append({"panel_id": panel, "date": date, "cash": cash, "units": units, "cost": cost})
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("panel_id", pa.string()), ("date", pa.date32()), ("cash", pa.float64()), ("units", pa.list_(pa.float64())), ("cost", pa.float64())])
    steps = events.mapInArrow(traded, "panel_id string, date date, cash double, units array<double>, cost double")
    held = quotes.join(steps, day, "left")
    held = running(held.withColumnRenamed("cash", "_c").withColumnRenamed("units", "_u"), ["panel_id"], cash=("last", F.col("_c")), units=("last", F.col("_u")))
    held = held.select(*day, "q", F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("cash", F.lit(float(initial_cash))).alias("cash"), "units")
    value = lambda units, at: F.aggregate(F.zip_with(units, at, lambda u, p: u * p), F.lit(0.0), lambda a, x: a + x)
    held = held.withColumn("units", F.coalesce("units", F.transform("q", lambda _: F.lit(0.0))))
    held = held.withColumn("nav", F.col("cash") + value(F.col("units"), F.transform("q", lambda x: x["price"])))
    held = held.withColumn("nav", F.when(F.col("nav") < 0, F.raise_error(F.lit("negative NAV")).cast("double")).otherwise(F.col("nav")))
    weight = lambda x, u: F.when(F.col("nav") == 0, 0.0).otherwise(u * x["price"] / F.col("nav"))
    positions = F.zip_with("q", "units", lambda x, u: F.struct(x["ticker"].alias("ticker"), u.alias("units"), x["price"].alias("price"), weight(x, u).alias("weight")))
    return held.select(*day, "nav", "cash", "cost", positions.alias("positions"))


def run_backtest(prices: DataFrame, target: DataFrame, initial_cash: float = 1_000_000.0, cost_rate: float = 0.0010) -> DataFrame:
    """backtest() after checking its input: raises ValueError for what invalid_rows() finds, warns of negative weights."""
    if not target.limit(1).count():
        raise ValueError("no rebalance date has target weights")
    found = {r["problem"]: r["rows"] for r in invalid_rows(prices, target).collect() if r["rows"]}
    if found.pop("weight negative", 0):
        warnings.warn("negative weights", RuntimeWarning, stacklevel=2)
    if found:
        raise ValueError(f"a backtest can't take this: {found}")
    return backtest(prices, target, initial_cash, cost_rate)


def holdings(result: DataFrame) -> DataFrame:
    """(panel_id, date, ticker, units, price, weight), a row for each position of a backtest."""
    return result.select("panel_id", "date", F.inline("positions"))


def gross_exposure(result: DataFrame) -> DataFrame:
    return holdings(result).groupBy("panel_id", "date").agg(F.sum(F.abs("weight")).alias("gross"))


def turnover(result: DataFrame) -> DataFrame:
    """(panel_id, date, turnover): what is traded, over the NAV."""
    moved = holdings(result).withColumn("_m", F.abs(F.col("units") - F.coalesce(F.lag("units").over(along()), F.lit(0.0))) * F.col("price"))
    return moved.groupBy("panel_id", "date").agg(F.sum("_m").alias("_m")).join(result.select("panel_id", "date", "nav"), ["panel_id", "date"]).select("panel_id", "date", F.try_divide("_m", "nav").alias("turnover"))


def weight_deviation(result: DataFrame, target: DataFrame, assets: DataFrame, corridor: float = 0.02) -> DataFrame:
    """(panel_id, date, series, value): by asset class the weights less the targets in force, and the corridor's two lines."""
    rows = holdings(result).join(target.select("panel_id", "date", "ticker", F.col("weight").alias("_t")), ["panel_id", "date", "ticker"], "left")
    rows = rows.withColumn("_t", F.coalesce(F.last("_t", True).over(upto(along())), F.lit(0.0)))
    rows = rows.join(assets.select("ticker", "asset_class"), "ticker", "left")
    dev = rows.groupBy("panel_id", "date", F.coalesce("asset_class", F.lit("Other")).alias("series")).agg(F.sum(F.col("weight") - F.col("_t")).alias("value"))
    lines = result.select("panel_id", "date", F.inline(F.array(*[F.struct(F.lit(n).alias("series"), F.lit(v).alias("value")) for n, v in (("Upper corridor", corridor), ("Lower corridor", -corridor))])))
    return dev.unionByName(lines)
