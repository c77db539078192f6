"""SQL of the queries over many panels, by the SQL of one panel over each region's order lines, and of the fetching sources."""

from __future__ import annotations

from panelforge.plans import factor_sql, sql

#: The regions.
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def by_region(one: str) -> str:
    """The rows of a query over one panel for each region's suppliers."""
    lines = "(SELECT l.* FROM lineitem l JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = '{0}') lineitem"
    return "\nUNION ALL\n".join(f"SELECT '{r}' AS panel_id, * FROM ({one.replace('FROM lineitem', 'FROM ' + lines.format(r))})" for r in REGIONS)


_SOME = "date BETWEEN DATE '1993-01-01' AND DATE '1995-12-31'"

SQL: dict[str, str] = {
    "analysis_split": factor_sql.SQL["variance_split"],
    "panels_nav": by_region(sql.SQL["backtest_nav"]),
    "panels_summary": by_region(sql.SQL["perf_summary"]),
    "panels_drawdown": by_region(sql.SQL["drawdown_series"]),
    "panels_ewma_moments": by_region(sql.SQL["ewma_moments"]),
    "rebal_third_friday": by_region(sql.of(f"SELECT {sql.D}, isodow(date) = 5 AND day(date) BETWEEN 15 AND 21 AS is_rebal FROM days")),
    "fetched_prices": sql.of(f"SELECT {sql.D}, ticker, {sql.x('price', 9)} FROM panel WHERE ticker IN ('T2', 'T5') AND {_SOME}"),
    "cached_prices": sql.of(f"SELECT {sql.D}, ticker, {sql.x('price', 9)} FROM panel WHERE ticker IN ('T1', 'T2') AND {_SOME}"),
}
