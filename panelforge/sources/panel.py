"""Price panels: long tables (panel_id, date, ticker, price), where they come from, and their wide form."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions.series import along, forward_fill


class PriceSource(ABC):
    """Anything that can load closing prices for tickers between two dates as (date, ticker, price)."""

    @abstractmethod
    def load(self, spark: SparkSession, tickers: Sequence[str], start: str | None = None, end: str | None = None) -> DataFrame: ...


class WideCsvSource(PriceSource):
    """A CSV file with a Date column and a column of prices for each ticker."""

    def __init__(self, path: str):
        self.path = path

    def load(self, spark: SparkSession, tickers: Sequence[str], start: str | None = None, end: str | None = None) -> DataFrame:
        header = spark.read.csv(self.path, header=True).columns
        schema = ", ".join("Date DATE" if x == "Date" else f"`{x}` DOUBLE" for x in header)
        wide = spark.read.csv(self.path, header=True, schema=schema).withColumnRenamed("Date", "date")
        return _between(to_long(wide.select("date", *(f"`{t}`" for t in tickers if t in header))), start, end)


class ParquetSource(PriceSource):
    """Parquet files with (date, ticker, price)."""

    def __init__(self, path: str):
        self.path = path

    def load(self, spark: SparkSession, tickers: Sequence[str], start: str | None = None, end: str | None = None) -> DataFrame:
        rows = spark.read.parquet(self.path).where(F.col("ticker").isin(list(tickers))).select("date", "ticker", "price")
        return _between(rows, start, end)


class LineitemSource(PriceSource):
    """Prices derived from order lines: 100 plus a fraction of the day's mean unit price, by line number (tickers T1 to T7)."""

    def __init__(self, path: str, damping: float = 5000.0):
        self.path, self.damping = path, damping

    def load(self, spark: SparkSession, tickers: Sequence[str] = (), start: str | None = None, end: str | None = None) -> DataFrame:
        money = lambda x: F.sum(F.col(x).cast("decimal(18,2)")).cast("double")
        lines = spark.read.parquet(self.path)
        rows = lines.groupBy(F.to_date("l_shipdate").alias("date"), F.concat(F.lit("T"), F.col("l_linenumber")).alias("ticker"))
        rows = rows.agg((100 + money("l_extendedprice") / money("l_quantity") / self.damping).alias("price"))
        return _between(rows.where(F.col("ticker").isin(list(tickers))) if tickers else rows, start, end)


def lineitem_panels(spark: SparkSession, folder: str, by: str = "region", damping: float = 5000.0) -> DataFrame:
    """A panel for each region or nation of suppliers: (panel_id, date, ticker, price) derived from their order lines as in LineitemSource."""
    lines, suppliers, nations = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("lineitem", "supplier", "nation"))
    homes = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    if by == "region":
        homes = homes.join(spark.read.parquet(f"{folder}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    homes = homes.select("s_suppkey", F.col({"region": "r_name", "nation": "n_name"}[by]).alias("panel_id"))
    money = lambda x: F.sum(F.col(x).cast("decimal(18,2)")).cast("double")
    rows = lines.join(homes, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("panel_id", F.to_date("l_shipdate").alias("date"), F.concat(F.lit("T"), F.col("l_linenumber")).alias("ticker"))
    return rows.agg((100 + money("l_extendedprice") / money("l_quantity") / damping).alias("price"))


def _between(rows: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    return rows


def as_panel(prices: DataFrame, panel_id: str = "all") -> DataFrame:
    return prices.select(F.lit(panel_id).alias("panel_id"), "date", "ticker", "price")


def to_wide(panel: DataFrame, tickers: Sequence[str], value: str = "price") -> DataFrame:
    """A row for each date, a column for each ticker."""
    keys = [x for x in ("panel_id", "date") if x in panel.columns]
    return panel.groupBy(*keys).pivot("ticker", list(tickers)).agg(F.first(value))


def to_long(wide: DataFrame, value: str = "price") -> DataFrame:
    """A row for each date and ticker that has a value."""
    keys = [x for x in ("panel_id", "date") if x in wide.columns]
    return wide.unpivot(keys, [x for x in wide.columns if x not in keys], "ticker", value).where(F.col(value).isNotNull())


def densify(panel: DataFrame, value: str = "price") -> DataFrame:
    """A row for each date and each ticker of the panel; null where there was none. Dates and tickers meet within their panel only."""
    dates = panel.select("panel_id", "date").distinct()
    tickers = panel.groupBy("panel_id").agg(F.collect_set("ticker").alias("ticker"))
    grid = dates.join(tickers, "panel_id").select("panel_id", "date", F.explode("ticker").alias("ticker"))
    return grid.join(panel.select("panel_id", "date", "ticker", value), ["panel_id", "date", "ticker"], "left")


def complete_dates(panel: DataFrame, value: str = "price") -> DataFrame:
    """The rows of dates on which every ticker of the panel has a value; a panel has one row at most for a date and ticker."""
    tickers = panel.groupBy("panel_id").agg(F.size(F.collect_set("ticker")).alias("_all"))  # a panel's tickers, not its rows
    counted = panel.withColumn("_n", F.count(value).over(Window.partitionBy("panel_id", "date")))
    return counted.join(tickers, "panel_id").where("_n = _all").select(*panel.columns)


def fill_prices(panel: DataFrame, limit: int = 5) -> DataFrame:
    """The dense panel with gaps of prices filled forward, each over at most limit rows."""
    return densify(panel).withColumn("price", forward_fill(F.col("price"), along(), limit))


def missing_tickers(panel: DataFrame, required: Sequence[str]) -> list[str]:
    """Which of the required tickers the panel lacks."""
    have = {r["ticker"] for r in panel.where(F.col("ticker").isin(list(required))).select("ticker").distinct().collect()}
    return [t for t in dict.fromkeys(required) if t not in have]


def clamp(panel: DataFrame, start: str, end: str) -> DataFrame:
    """The rows between start and end, both included, as far as the panel goes; none if it has no date in between."""
    return _between(panel, start, end)


def write_wide_csv(panel: DataFrame, path: str, tickers: Sequence[str]) -> None:
    """One panel's prices as CSV files that WideCsvSource reads: Date and a column for each ticker, by date."""
    wide = to_wide(panel, tickers).withColumnRenamed("date", "Date")
    wide.select("Date", *(f"`{t}`" for t in tickers)).orderBy("Date").write.mode("overwrite").csv(path, header=True)


def ticker_union(*tables: DataFrame) -> DataFrame:
    """(ticker): the tickers of all tables, each once."""
    out = tables[0].select("ticker")
    for more in tables[1:]:
        out = out.unionByName(more.select("ticker"))
    return out.distinct()


def invalid_rows(prices: DataFrame, weights: DataFrame) -> DataFrame:
    """(problem, rows) for prices (date, ticker, price) and target weights (date, ticker, weight) that a backtest can't take."""
    bad = lambda x: F.col(x).isNull() | F.isnan(x) | (F.abs(F.col(x)) == float("inf"))
    one = prices.agg(F.count_if(bad("price")).alias("price missing or not finite"), F.count_if(F.col("price") <= 0).alias("price not positive"))
    two = weights.agg(F.count_if(bad("weight")).alias("weight missing or not finite"), F.count_if(F.col("weight") < 0).alias("weight negative"))
    lost = weights.join(prices.select("date", "ticker"), ["date", "ticker"], "left_anti").agg(F.count(F.lit(1)).alias("weight without price"))
    unused = prices.join(weights.select("ticker").distinct(), "ticker", "left_anti").agg(F.count_distinct("ticker").alias("price without weight"))
    parts = [x.unpivot([], x.columns, "problem", "rows") for x in (one, two, lost, unused)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
