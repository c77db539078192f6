"""Performance statistics of NAV series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.scans import running
from panelforge.functions.series import along, day_keys, fill_budget, full_window, upto

YEAR = 252


def nav_returns(nav: DataFrame, rf: DataFrame) -> DataFrame:
    """(panel_id, date, nav, ret, excess): simple returns, and these less the risk-free rate (date, rf); missing rates are 0, up to five of them."""
    w = along("panel_id")
    joined = nav.select("panel_id", "date", "nav").join(rf.select(*day_keys(rf), "rf"), day_keys(rf), "left")
    joined = joined.withColumn("_rf", fill_budget(F.col("rf"), w)).withColumn("ret", F.try_divide("nav", F.lag("nav").over(w)) - 1)
    return joined.select("panel_id", "date", "nav", "ret", (F.col("ret") - F.col("_rf")).alias("excess"))


def drawdowns(rets: DataFrame) -> DataFrame:
    """(panel_id, date, level, drawdown) of excess returns compounded, missing ones as 0."""
    level = running(rets.select("panel_id", "date", "excess"), ["panel_id"], level=("product", 1 + F.coalesce("excess", F.lit(0.0))))
    peak = running(level.select("panel_id", "date", "level"), ["panel_id"], peak=("max", F.col("level")))
    return peak.select("panel_id", "date", "level", (F.try_divide("level", "peak") - 1).alias("drawdown"))


def longest_drawdown(dd: DataFrame) -> DataFrame:
    """(panel_id, longest): the longest run of rows below the peak."""
    flagged = dd.withColumn("_run", F.sum((F.col("drawdown") >= 0).cast("long")).over(upto(along("panel_id"))))
    runs = flagged.groupBy("panel_id", "_run").agg(F.count_if(F.col("drawdown") < 0).alias("_n"))
    return runs.groupBy("panel_id").agg(F.max("_n").alias("longest"))


def current_drawdown(nav: DataFrame) -> DataFrame:
    """(panel_id, current): the last NAV against the highest so far."""
    return nav.groupBy("panel_id").agg((F.max_by("nav", "date") / F.max("nav") - 1).alias("current"))


def sharpe(rets: DataFrame) -> DataFrame:
    """(panel_id, sharpe) of excess returns by year; null unless they vary."""
    sd = F.stddev_samp("excess")
    return rets.groupBy("panel_id").agg(F.when(sd > 0, F.avg("excess") / sd * F.sqrt(F.lit(float(YEAR)))).alias("sharpe"))


def cagr_and_vol(rets: DataFrame) -> DataFrame:
    """(panel_id, cagr, vol): growth over 252 days at the rate per calendar day, and the yearly volatility of simple returns."""
    days = F.datediff(F.max("date"), F.min("date"))
    growth = F.max_by("nav", "date") / F.min_by("nav", "date")
    return rets.groupBy("panel_id").agg(F.when(days > 0, F.pow(growth, F.try_divide(F.lit(float(YEAR)), days)) - 1).alias("cagr"), (F.stddev_samp("ret") * F.sqrt(F.lit(float(YEAR)))).alias("vol"))


def trailing_returns(nav: DataFrame) -> DataFrame:
    """(panel_id, ytd, m3, m6, y1): from the first NAV of the last year, and over the last 63, 126 and 252 rows or as many as there are."""
    back = F.row_number().over(Window.partitionBy("panel_id").orderBy(F.desc("date")))
    rows = nav.select("panel_id", "date", "nav", back.alias("_k"), F.max("date").over(Window.partitionBy("panel_id")).alias("_last"))

    def change(inside, name):  # noqa: ANN001, ANN202
        last, first = F.max_by("nav", F.when(inside, F.col("date"))), F.min_by("nav", F.when(inside, F.col("date")))
        return F.when(F.count_if(inside) >= 2, last / first - 1).alias(name)

    spans = [change(F.col("_k") <= n, name) for name, n in (("m3", 63), ("m6", 126), ("y1", 252))]
    return rows.groupBy("panel_id").agg(change(F.col("date") >= F.trunc("_last", "year"), "ytd"), *spans)


def benchmark_excess(rets: DataFrame, benchmark: DataFrame, rf: DataFrame) -> DataFrame:
    """(panel_id, date, excess, benchmark): nav_returns() beside the simple returns of benchmark (panel_id, date, price) on their dates, 0 where it has none, less the risk-free rate."""
    on, price = day_keys(rf), F.col("price")
    own = benchmark.select("panel_id", "date", (F.try_divide(price, F.lag(price).over(along("panel_id"))) - 1).alias("_b"))
    rows = rets.select("panel_id", "date", "excess").join(own, ["panel_id", "date"], "left").join(rf.select(*on, "rf"), on, "left")
    rows = rows.withColumn("_rf", fill_budget(F.col("rf"), along("panel_id")))
    return rows.select("panel_id", "date", "excess", (F.coalesce("_b", F.lit(0.0)) - F.col("_rf")).alias("benchmark"))


def rolling_volatility(rets: DataFrame, window: int = 126) -> DataFrame:
    """(panel_id, date, vol): yearly volatility of the last window excess returns, missing ones left out beforehand."""
    x = F.col("excess")
    vol = full_window(x, F.stddev_samp(x), along("panel_id"), window) * F.sqrt(F.lit(float(YEAR)))
    return rets.where(x.isNotNull()).select("panel_id", "date", vol.alias("vol"))


def monthly_returns(rets: DataFrame) -> DataFrame:
    """(panel_id, year, month, ret): excess returns compounded by month, 0 for months without any between the first and the last."""
    rows = rets.where(F.col("excess").isNotNull())
    months = rows.groupBy("panel_id", F.trunc("date", "month").alias("_m")).agg((F.product(1 + F.col("excess")) - 1).alias("ret"))
    spine = months.groupBy("panel_id").agg(F.explode(F.sequence(F.min("_m"), F.max("_m"), F.expr("interval 1 month"))).alias("_m"))
    full = spine.join(months, ["panel_id", "_m"], "left")
    return full.select("panel_id", F.year("_m").alias("year"), F.month("_m").alias("month"), F.coalesce("ret", F.lit(0.0)).alias("ret"))


def summary(rets: DataFrame) -> DataFrame:
    """(panel_id, ord, metric, value, day): the key figures of nav_returns() in a fixed order; those that don't exist are left out, but for Sharpe and Max drawdown, which are null then."""
    dd = drawdowns(rets)
    one = rets.groupBy("panel_id").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    for more in (sharpe(rets), dd.groupBy("panel_id").agg(F.min("drawdown").alias("max_dd")), longest_drawdown(dd), trailing_returns(rets), cagr_and_vol(rets)):
        one = one.join(more, "panel_id")
    figures = (
        ("Start Period", None, "start"),
        ("End Period", None, "end"),
        ("Sharpe", "sharpe", None),
        ("Max drawdown", "max_dd", None),
        ("Longest drawdown (days)", "longest", None),
        ("YTD", "ytd", None),
        ("3M", "m3", None),
        ("6M", "m6", None),
        ("1Y", "y1", None),
        ("Annualized Return (CAGR)", "cagr", None),
        ("Annualized Historical Volatility", "vol", None),
    )
    rows = [F.struct(F.lit(k).alias("ord"), F.lit(name).alias("metric"), (F.col(v).cast("double") if v else F.lit(None).cast("double")).alias("value"), (F.col(d) if d else F.lit(None).cast("date")).alias("day")) for k, (name, v, d) in enumerate(figures, 1)]
    return one.select("panel_id", F.inline(F.array(*rows))).where("value is not null or day is not null or metric in ('Sharpe', 'Max drawdown')")
