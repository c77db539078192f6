"""Currencies and risk-free rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.scans import fill_both_ways
from panelforge.functions.series import along, day_keys, padded_change

CURRENCIES = ("USD", "EUR", "CHF")


def normalize(panel: DataFrame, assets: DataFrame, rates: DataFrame, base: str) -> DataFrame:
    """Prices in the base currency: times the rate of local to base, or else divided by that of base to local.

    rates is (date, pair, rate) with pairs like EURUSD=X. Tickers that assets lacks, and those in the base currency, stay as
    they are. Raises ValueError if a currency of the panel has neither pair.
    """
    if base not in CURRENCIES:
        raise ValueError(f"base must be one of {CURRENCIES}, not {base!r}")
    pairs = {r["pair"] for r in rates.select("pair").distinct().collect()}
    local = {r["currency"] for r in assets.join(panel.select("ticker").distinct(), "ticker", "left_semi").select("currency").distinct().collect()} - {base}
    lost = [c for c in sorted(local) if f"{c}{base}=X" not in pairs and f"{base}{c}=X" not in pairs]
    if lost:
        raise ValueError(f"no rate between {base} and {lost}")
    known = panel.join(assets.select("ticker", "currency"), "ticker", "left")
    on = day_keys(rates)
    direct = rates.select(*on, F.col("pair").alias("_direct"), F.nullif("rate", F.lit(0.0)).alias("_times"))
    inverse = rates.select(*on, F.col("pair").alias("_inverse"), F.nullif("rate", F.lit(0.0)).alias("_over"))
    known = known.withColumns({"_direct": F.concat("currency", F.lit(f"{base}=X")), "_inverse": F.concat(F.lit(base), F.col("currency"), F.lit("=X"))})
    out = known.join(direct, [*on, "_direct"], "left").join(inverse, [*on, "_inverse"], "left")
    has_direct = F.col("_direct").isin(sorted(pairs))
    price = F.when(F.col("currency").isNull() | (F.col("currency") == base), F.col("price")).when(has_direct, F.col("price") * F.col("_times")).otherwise(F.col("price") / F.col("_over"))
    return out.select("panel_id", "date", "ticker", price.alias("price"))


def triangulate(series: DataFrame, rates: DataFrame, base: str) -> DataFrame:
    """series (panel_id, date, price), quoted in USD, in the base currency: over the base's rate in USD, filled both ways on the series' dates."""
    if base == "USD":
        return series.select("panel_id", "date", "price")
    on = day_keys(rates)
    rate = rates.where(F.col("pair") == f"{base}USD=X").select(*on, "rate")
    joined = series.join(rate, on, "left")
    full = fill_both_ways(joined.select("panel_id", "date", "price", "rate"), "rate", ["panel_id"])
    return full.select("panel_id", "date", F.try_divide("price", "rate").alias("price"))


def risk_free(series: DataFrame, base: str, days_in_year: int = 252) -> DataFrame:
    """(panel_id, date, rf): a simple daily rate. series is (panel_id, date, value): a yearly yield in percent for USD, else a money market price."""
    if base not in CURRENCIES:
        raise ValueError(f"base must be one of {CURRENCIES}, not {base!r}")
    daily = F.col("value") / 100 / days_in_year if base == "USD" else padded_change(F.col("value"), along("panel_id"))
    daily = F.when(F.abs(daily) == float("inf"), None).otherwise(daily)
    return series.select("panel_id", "date", F.coalesce(daily, F.lit(0.0)).alias("rf"))
