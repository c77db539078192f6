"""Column expressions over ordered series.

A series is a set of rows with the same keys, ordered by date. All lags and frames count rows, so series must be dense: a row
for each date of the panel, with a null where there is no value (see panelforge.sources.panel.densify).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("panel_id", "ticker")
METHODS = ("log", "simple")


def day_keys(rates: DataFrame) -> list[str]:
    """What rates are joined by: the panel and the date, or the date alone if all panels share them."""
    return ["panel_id", "date"] if "panel_id" in rates.columns else ["date"]


def along(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*(keys or KEYS)).orderBy(order)


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def check_method(method: str) -> str:
    method = str(getattr(method, "value", method)).lower()
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    return method


def lagged_return(price: Column, w: WindowSpec, lookback: int = 1, method: str = "log") -> Column:
    """Return over lookback rows; null where either price is missing."""
    ratio = F.try_divide(price, F.lag(price, lookback).over(w))
    return F.ln(ratio) if check_method(method) == "log" else ratio - 1


def forward_fill(x: Column, w: WindowSpec, limit: int | None = None) -> Column:
    """The last value at or before the row, at most limit rows back."""
    frame = upto(w) if limit is None else w.rowsBetween(-limit, 0)
    return F.last(x, ignorenulls=True).over(frame)


def fill_budget(x: Column, w: WindowSpec, value: float = 0.0, limit: int = 5) -> Column:
    """value for the first limit nulls of the whole series; later nulls stay."""
    used = F.sum(x.isNull().cast("long")).over(upto(w))
    return F.when(x.isNull() & (used <= limit), F.lit(value)).otherwise(x)


def padded_change(x: Column, w: WindowSpec) -> Column:
    """Simple change between forward-filled values."""
    full = forward_fill(x, w)
    return F.try_divide(full, F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))) - 1


def full_window(x: Column, value: Column, w: WindowSpec, rows: int) -> Column:
    """value over the last so many rows, null unless all of them have x."""
    frame = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(x).over(frame) == rows, value.over(frame))
