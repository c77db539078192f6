"""Running values along series of any length, in two levels.

A window over a whole series is one task, however long the series is. Here every series is cut into ranges of dates: the
total of each range is taken first, the totals are carried from range to range (a row for each), and within a range a row adds
what stands before it in the range to what was carried in. So the ranges of one series run side by side. Results don't depend
on how long ranges are, but for the last digits of sums of floats.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days in a range: about eleven years.
RANGE_DAYS = 4096


def ranges(order: str = "date", days: int = RANGE_DAYS) -> Column:
    """The number of the range that a date lies in."""
    return F.floor(F.unix_date(order) / days)


#: By kind: the total of a range, the totals of ranges put together, and the one before put together with what follows.
_KINDS: dict[str, tuple[Callable[[Column, Column], Column], Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (lambda v, _: F.sum(v), F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "product": (lambda v, _: F.product(v), F.product, lambda a, b: F.coalesce(a * b, a, b)),
    "max": (lambda v, _: F.max(v), F.max, F.greatest),
    "min": (lambda v, _: F.min(v), F.min, F.least),
    "last": (lambda v, at: F.max_by(v, F.when(v.isNotNull(), at)), lambda v: F.last(v, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


def running(df: DataFrame, keys: Sequence[str], order: str = "date", days: int = RANGE_DAYS, **steps: tuple[str, Column]) -> DataFrame:
    """df with a column for each step: the sum, product, max, min or last value of a column, nulls left out, over the rows of the same keys up to and with each row.

    steps are name=(kind, column). Keys and order aren't null, and order is a date that a series has once; a name that df has is
    replaced. Null until the first value. An empty df gives an empty one.
    """
    rows = df.withColumns({f"_of_{name}": column for name, (_, column) in steps.items()} | {"_range": ranges(order, days)})
    parts = rows.groupBy(*keys, "_range").agg(*(_KINDS[kind][0](F.col(f"_of_{name}"), F.col(order)).alias(name) for name, (kind, _) in steps.items()))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = parts.select(*keys, "_range", *(_KINDS[kind][1](F.col(name)).over(before).alias(f"_in_{name}") for name, (kind, _) in steps.items()))
    own = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(carried, [*keys, "_range"])
    out = joined.withColumns({name: _KINDS[kind][2](F.col(f"_in_{name}"), _KINDS[kind][1](F.col(f"_of_{name}")).over(own)) for name, (kind, _) in steps.items()})
    return out.select(*(c for c in df.columns if c not in steps), *steps)


def decayed(df: DataFrame, keys: Sequence[str], value: Column, start: Column, decay: float, name: str, order: str = "date", days: int = RANGE_DAYS) -> DataFrame:
    """df with the weighted running mean m of value: m = (1 - decay) * value + decay * m of the row before, and start before the first row of a series.

    A range turns what is carried into it, m, into decay^rows * m + a number of its own: these maps are put together range by
    range. Within a range the mean is a running sum of values weighted by decay^-place, so a range must be short enough for
    that to be a float. value is never null; start is the same in all rows of a series; else as running().
    """
    if decay <= 0:
        return df.withColumn(name, value)
    days = max(1, min(days, int(600 / -math.log(decay)))) if decay < 1 else days
    by = [*keys, "_range"]
    rows = df.withColumns({"_value": value, "_start": start, "_range": ranges(order, days)})
    w = Window.partitionBy(*by).orderBy(order)
    rows = rows.withColumn("_at", F.row_number().over(w))
    weight = lambda sign: F.pow(F.lit(decay), sign * F.col("_at"))
    rows = rows.withColumn("_own", (1 - decay) * weight(1) * F.sum(F.col("_value") * weight(-1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = rows.groupBy(*by).agg(F.max("_at").alias("n"), F.max_by("_own", "_at").alias("own"), F.first("_start").alias("start"))
    listed = ends.groupBy(*keys).agg(F.first("start").alias("_start"), F.sort_array(F.collect_list(F.struct("_range", "n", "own"))).alias("_ends"))  # a row for each range
    entry = f"array<struct<_range:{dict(rows.dtypes)['_range']},_in:double>>"
    zero = F.struct(F.col("_start").alias("m"), F.expr(f"cast(array() as {entry})").alias("out"))
    step = lambda a, r: F.struct((r["own"] + F.pow(F.lit(decay), r["n"]) * a["m"]).alias("m"), F.concat(a["out"], F.array(F.struct(r["_range"].alias("_range"), a["m"].alias("_in")))).alias("out"))
    carried = listed.select(*keys, F.inline(F.aggregate("_ends", zero, step, lambda a: a["out"])))
    out = rows.join(carried, by).withColumn(name, F.col("_own") + weight(1) * F.col("_in"))
    return out.select(*(c for c in df.columns if c != name), name)


def fill_both_ways(df: DataFrame, name: str, keys: Sequence[str], order: str = "date", days: int = RANGE_DAYS) -> DataFrame:
    """df with nulls of the column name filled by the last value before, and before the first value by that value."""
    first = df.groupBy(*keys).agg(F.min_by(name, F.when(F.col(name).isNotNull(), F.col(order))).alias("_first"))
    filled = running(df, keys, order, days, _filled=("last", F.col(name))).join(first, [*keys])
    return filled.select(*(F.coalesce("_filled", "_first").alias(name) if c == name else c for c in df.columns))


def fill_budget(df: DataFrame, name: str, keys: Sequence[str], value: float = 0.0, limit: int = 5, order: str = "date", days: int = RANGE_DAYS) -> DataFrame:
    """df with the first limit nulls of each series' column name filled with value; later ones stay."""
    empty = F.col(name).isNull()
    counted = running(df, keys, order, days, _used=("sum", empty.cast("long")))
    return counted.select(*(F.when(empty & (F.col("_used") <= limit), F.lit(value)).otherwise(F.col(name)).alias(name) if c == name else c for c in df.columns))
