"""Tables for display, made of the other operators' results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.percentiles import percentiles


def universe_table(holdings: DataFrame, assets: DataFrame) -> DataFrame:
    """(panel_id, ticker, asset_class, currency, weight_start, weight_end, description): weights of the second date (the first if there is one only) and the last."""
    w = Window.partitionBy("panel_id", "ticker")
    rows = holdings.select("panel_id", "ticker", "weight", F.row_number().over(w.orderBy("date")).alias("_k"), F.count(F.lit(1)).over(w).alias("_n"))
    ends = rows.groupBy("panel_id", "ticker").agg(F.max(F.when(F.col("_k") == F.least(F.lit(2), "_n"), F.col("weight"))).alias("a"), F.max(F.when(F.col("_k") == F.col("_n"), F.col("weight"))).alias("b"))
    out = ends.join(assets, "ticker")
    return out.select("panel_id", "ticker", "asset_class", "currency", percent(F.col("a"), 1).alias("weight_start"), percent(F.col("b"), 1).alias("weight_end"), "description")


def percent(x: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", x * 100)


def format_metric(metric: Column, value: Column, day: Column) -> Column:
    """A summary figure as text: dates as such, the Sharpe ratio with two decimals, days whole, all else in percent; empty if missing."""
    return (
        F.when(day.isNotNull(), F.date_format(day, "yyyy-MM-dd"))
        .when(value.isNull() | F.isnan(value), "")
        .when(metric == "Sharpe", F.format_string("%.2f", value))
        .when(metric.endswith("(days)"), F.format_string("%d", value.cast("long")))
        .otherwise(percent(value))
    )


def latest_weights(holdings: DataFrame) -> DataFrame:
    """(panel_id, ticker, weight, shown) of the last date, weights of 0 left out."""
    last = holdings.groupBy("panel_id").agg(F.max("date").alias("date"))
    rows = holdings.join(last, ["panel_id", "date"], "left_semi").where("weight is not null and weight <> 0")
    return rows.select("panel_id", "ticker", "weight", percent(F.col("weight"), 4).alias("shown"))


def latest_betas(exposures: DataFrame, factors: DataFrame, significance: float = 1.96) -> DataFrame:
    """(panel_id, factor, beta, t_stat, significant, color_key, note) of the last date that has betas."""
    rows = exposures.where("term <> 'const' and beta is not null")
    rows = rows.join(rows.groupBy("panel_id").agg(F.max("date").alias("date")), ["panel_id", "date"], "left_semi")
    rows = rows.join(factors.select(F.col("name").alias("term"), "parents"), "term", "left")
    sig = F.abs("t_stat") >= significance
    note = F.when(F.size("parents") > 0, F.concat(F.lit("without "), F.array_join("parents", ", "))).when(F.col("parents").isNotNull(), "top level").otherwise("not defined")
    key = F.concat_ws("_", F.when(F.col("beta") >= 0, "pos").otherwise("neg"), F.when(sig, "sig").otherwise("nonsig"))
    return rows.select("panel_id", F.col("term").alias("factor"), "beta", "t_stat", sig.alias("significant"), key.alias("color_key"), note.alias("note"))


def rolling_betas(exposures: DataFrame) -> DataFrame:
    """(panel_id, date, factor, beta, t_stat) of dates that have betas."""
    return exposures.where("term <> 'const' and beta is not null").select("panel_id", "date", F.col("term").alias("factor"), "beta", "t_stat")


def color_domain(trend: DataFrame, low: float = 0.03, high: float = 0.97) -> DataFrame:
    """(panel_id, low, high): percentiles of all contributions; widened a little if they are equal. A panel without contributions has no row."""
    rows = percentiles(trend, ["panel_id"], "contrib", (low, high))
    a, b = F.element_at("values", 1), F.element_at("values", 2)
    return rows.select("panel_id", F.when(a < b, a).otherwise(a - 1e-6).alias("low"), F.when(a < b, b).otherwise(b + 1e-6).alias("high"))


def component_order(component: Column) -> Column:
    """Total first, then factors by name, the risk-free rate, the residual."""
    return F.when(component == "Total", "0").when(component == "RiskFree", "2").when(component == "Residual", "3").otherwise(F.concat(F.lit("1"), component))


def month_matrix(monthly: DataFrame) -> DataFrame:
    """A row for each year, a column for each month."""
    names = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
    named = monthly.withColumn("_m", F.element_at(F.array(*map(F.lit, names)), F.col("month")))
    return named.groupBy("panel_id", "year").pivot("_m", names).agg(F.first("ret"))


def context_snapshot(summary: DataFrame, weights: DataFrame, current: DataFrame, betas: DataFrame, split: DataFrame) -> DataFrame:
    """(panel_id, json): what an analyst needs to know of a portfolio, as one JSON object."""
    stats = summary.groupBy("panel_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", format_metric(F.col("metric"), F.col("value"), F.col("day")).alias("v"))))).alias("summary_stats"))
    held = weights.groupBy("panel_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("ticker", "shown")))).alias("weights"))
    text = F.concat(F.format_string("%.2f (t=%.1f)", "beta", "t_stat"), F.when(F.col("significant"), " (Sig)").otherwise(""))
    exposed = betas.groupBy("panel_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("factor", text.alias("v"))))).alias("factor_exposures"))
    risk = split.groupBy("panel_id").agg(F.max_by(F.struct(percent(F.col("systematic_share"), 1).alias("systematic"), percent(F.col("idio_share"), 1).alias("idiosyncratic")), "date").alias("variance"))
    rows = stats.join(current.select("panel_id", percent(F.col("current")).alias("current_drawdown")), "panel_id").join(held, "panel_id", "left").join(exposed, "panel_id", "left").join(risk, "panel_id", "left")
    return rows.select("panel_id", F.to_json(F.struct("summary_stats", "current_drawdown", "weights", "factor_exposures", "variance")).alias("json"))


def ranked_risk(contribs: DataFrame, least: float | None = None) -> DataFrame:
    """(panel_id, rank, label, exposure, mctr, ctr, ctr_pct, labelled) by falling share of risk, for each date's rows; labelled says whether the share is worth a label."""
    place = F.row_number().over(Window.partitionBy("panel_id", "date").orderBy(F.desc_nulls_last("ctr_pct"), "label"))
    rows = contribs.withColumn("rank", place).withColumn("labelled", F.coalesce(F.col("ctr_pct") >= 0.05, F.lit(False)))
    rows = rows if least is None else rows.where(F.col("ctr_pct") >= least)
    return rows.select("panel_id", "date", "rank", "label", "exposure", "mctr", "ctr", "ctr_pct", "labelled")


def markdown_risk(ranked: DataFrame) -> DataFrame:
    """(panel_id, table): ranked_risk() of one date as a Markdown table with four decimals."""
    cell = lambda x: F.when(F.col(x).isNull(), "nan").otherwise(F.format_string("%.4f", x))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "label", *map(cell, ("exposure", "mctr", "ctr", "ctr_pct"))), F.lit(" |"))
    head = "| label | exposure | mctr | ctr | ctr_pct |\n| --- | --- | --- | --- | --- |\n"
    lines = ranked.groupBy("panel_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("_l"))  # a row for each asset or factor
    return lines.select("panel_id", F.concat(F.lit(head), F.array_join(F.transform("_l", lambda x: x["line"]), "\n")).alias("table"))


def symmetric_range(monthly: DataFrame) -> DataFrame:
    """(panel_id, low, high): the largest distance of a monthly return from 0, both ways."""
    far = F.greatest(F.abs(F.least(F.min("ret"), F.lit(0.0))), F.greatest(F.max("ret"), F.lit(0.0)))
    return monthly.groupBy("panel_id").agg((-far).alias("low"), far.alias("high"))


def month_cells(monthly: DataFrame) -> DataFrame:
    """Monthly returns with their order on show: years falling, months rising."""
    place = F.row_number().over(Window.partitionBy("panel_id").orderBy(F.desc("year"), "month"))
    return monthly.select("panel_id", place.alias("place"), "year", "month", "ret")


def by_beta(latest: DataFrame) -> DataFrame:
    """latest_betas() with their order on show: falling betas."""
    return latest.withColumn("place", F.row_number().over(Window.partitionBy("panel_id").orderBy(F.desc("beta"), "factor")))


def shown_factors(present: DataFrame, order: Sequence[str]) -> DataFrame:
    """(place, factor): those of an ordered list of names that stand in present (factor)."""
    listed = present.sparkSession.createDataFrame(list(enumerate(order, 1)), "place long, factor string")
    return listed.join(present.select("factor").distinct(), "factor", "left_semi").select("place", "factor")


def cost_in_bps(rate: Column) -> Column:
    return F.format_string("Transaction costs: %.1f bps per trade", rate * 10_000)


def risk_free_note(bases: DataFrame, proxies: dict[str, str], assets: DataFrame) -> DataFrame:
    """(base, note): for each currency of bases (base) the ticker that its risk-free rate is made of, and what that is, as far as known."""
    key = F.upper(F.trim("base"))
    known = bases.sparkSession.createDataFrame(sorted(proxies.items()), "_key string, ticker string")
    rows = bases.withColumn("_key", key).join(known, "_key", "left").join(assets.select("ticker", "description"), "ticker", "left")  # a few rows each
    note = (
        F.when(F.col("ticker").isNull(), F.format_string("The risk-free rate follows the base currency (%s)", "base"))
        .when(F.col("description").isNull(), F.format_string("Risk-free rate: %s (base currency %s)", "ticker", "base"))
        .otherwise(F.format_string("Risk-free rate: %s, %s (base currency %s)", "ticker", "description", "base"))
    )
    return rows.select("base", note.alias("note"))
