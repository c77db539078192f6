"""Dimension tables: assets, factors and their parents, currencies, portfolios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Asset:
    name: str
    asset_class: str
    ticker: str
    currency: str = "USD"
    description: str | None = None


@dataclass(frozen=True)
class Factor:
    """A factor with the proxy whose returns it is made of, and the factors that are taken out of it."""

    name: str
    ticker: str
    description: str | None = None
    parents: tuple[str, ...] = ()


#: The universe of the derived panel: seven tickers that stand for seven asset classes.
ASSETS = (
    Asset("Stocks", "Equity", "T1", "USD", "Broad stock basket"),
    Asset("Bonds", "Rates", "T2", "USD", "Government bond basket"),
    Asset("Corporates", "Credit", "T3", "EUR", "Corporate bond basket"),
    Asset("Materials", "Commodities", "T4", "CHF", "Commodity basket"),
    Asset("Currencies", "FX", "T5", "USD", "Currency basket"),
    Asset("Cheap stocks", "Equity", "T6", "EUR", "Value stock basket"),
    Asset("Winners", "Equity", "T7", "CHF", "Momentum stock basket"),
)
_ROOTS, _FOUR = ("Equity", "Rates"), ("Equity", "Rates", "Credit", "Commodities")
FACTORS = (
    Factor("Equity", "T1", "stocks"),
    Factor("Rates", "T2", "government bonds"),
    Factor("Credit", "T3", "corporate bonds", _ROOTS),
    Factor("Commodities", "T4", "commodities", _ROOTS),
    Factor("ForeignCurrency", "T5", "foreign currencies", _ROOTS),
    Factor("Value", "T6", "cheap stocks", _FOUR),
    Factor("Momentum", "T7", "recent winners", _FOUR),
)
#: What the risk-free rate of a currency is made of.
RISK_FREE = {"USD": "^IRX", "EUR": "T3", "CHF": "T4"}
PORTFOLIO = {"T1": 0.6, "T2": 0.4}


def check_factors(factors: tuple[Factor, ...]) -> None:
    """Raises ValueError unless names and tickers are unique and parents come before their children."""
    if len({f.name for f in factors}) < len(factors) or len({f.ticker for f in factors}) < len(factors):
        raise ValueError("factor names and tickers must be unique")
    seen: set[str] = set()
    for f in factors:
        if set(f.parents) - seen:
            raise ValueError(f"{f.name}: parents {sorted(set(f.parents) - seen)} are not defined before it")
        seen.add(f.name)


def assets(spark: SparkSession, rows: tuple[Asset, ...] = ASSETS) -> DataFrame:
    return spark.createDataFrame([(a.name, a.asset_class, a.ticker, a.currency, a.description) for a in rows], "name string, asset_class string, ticker string, currency string, description string")


def factors(spark: SparkSession, rows: tuple[Factor, ...] = FACTORS) -> DataFrame:
    return spark.createDataFrame([(f.name, f.ticker, f.description, list(f.parents)) for f in rows], "name string, ticker string, description string, parents array<string>")


def portfolio(spark: SparkSession, weights: dict[str, float] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((weights or PORTFOLIO).items()), "ticker string, weight double")
