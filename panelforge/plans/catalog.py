"""All queries of the portfolio engine by name, and the SQL that gives the same rows."""

from panelforge.plans import factor_sql, panel_sql, sql
from panelforge.plans.queries import QUERIES

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]

FLAGSHIP = "perf_summary"
SQL: dict[str, str] = {**sql.SQL, **factor_sql.SQL, **panel_sql.SQL}
