"""Business calendars and rebalance dates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

POLICIES = ("month_start", "month_end", "once")
#: What the policies are called where they are chosen.
POLICY_NAMES = {"US Month Start": "month_start", "US Month End": "month_end", "One-time only at beginning": "once"}


def policy_of(name: str) -> str:
    """The policy of a key or of a shown name; raises ValueError for others."""
    policy = POLICY_NAMES.get(name, name)
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {(*POLICIES, *POLICY_NAMES)}, not {name!r}")
    return policy


def federal_holiday(day: Column) -> Column:
    """Whether a date is a US federal holiday or the working day next to one that falls on a weekend."""
    month, dom, dow = F.month(day), F.dayofmonth(day), F.weekday(day)  # 0: Monday

    def nth(m: int, weekday: int, first: int) -> Column:
        return (month == m) & (dow == weekday) & dom.between(first, first + 6)

    def observed(m: int, d: int, from_year: int = 0) -> Column:
        hit = F.lit(False)
        for shift, weekdays in ((0, range(5)), (1, (4,)), (-1, (0,))):  # a Saturday's is kept the day before, a Sunday's the day after
            real = F.date_add(day, shift)
            hit = hit | ((F.month(real) == m) & (F.dayofmonth(real) == d) & (F.year(real) >= from_year) & dow.isin(*weekdays))
        return hit

    moving = nth(1, 0, 15) | nth(2, 0, 15) | nth(5, 0, 25) | nth(9, 0, 1) | nth(10, 0, 8) | nth(11, 3, 22)
    return moving | observed(1, 1) | observed(6, 19, 2021) | observed(7, 4) | observed(11, 11) | observed(12, 25)


def business_days(first: Column, last: Column) -> Column:
    """The array of days between two dates on which US federal offices are open."""
    return F.filter(F.sequence(first, last), lambda d: (F.weekday(d) < 5) & ~federal_holiday(d))


def rebalance_dates(dates: DataFrame, policy: str = "month_start", generator: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(panel_id, date): the policy's dates that are dates of the panel; a month whose date is missing there has none.

    policy is a key of POLICIES or a name of POLICY_NAMES. month_start and month_end: the first and last business day of each month. once: the first of the month starts only.
    generator, if given, makes the calendar from (panel_id, first, last) as (panel_id, date) instead; see generated_by().
    """
    policy = policy if generator else policy_of(policy)
    days = dates.select("panel_id", "date").distinct()
    span = days.groupBy("panel_id").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    if generator is not None:
        calendar = generator(span)
    else:
        open_days = span.select("panel_id", F.explode(business_days(F.trunc("first", "month"), F.last_day("last"))).alias("date"))
        edge = F.max("date") if policy == "month_end" else F.min("date")
        calendar = open_days.groupBy("panel_id", F.trunc("date", "month")).agg(edge.alias("date")).select("panel_id", "date")
    found = days.join(calendar, ["panel_id", "date"], "left_semi")
    return first_only(found) if policy == "once" else found


def date_function(make: Callable[[dt.date, dt.date], Iterable[dt.date]]) -> UserDefinedTableFunction:
    """The table function (first, last) -> date of a calendar given as a plain function."""

    class Dates:
        def eval(self, first: dt.date, last: dt.date) -> Iterator[tuple[dt.date]]:
            for d in make(first, last):
                yield (d,)

    return F.udtf(Dates, returnType="date date")


def generated_by(make: Callable[[dt.date, dt.date], Iterable[dt.date]]) -> Callable[[DataFrame], DataFrame]:
    """A generator for rebalance_dates() of a function from a panel's first and last date to its rebalance dates: joined laterally to each panel's span.

    Dates outside the span or given twice do no harm; panels are made side by side.
    """
    dates = date_function(make)

    def generator(span: DataFrame) -> DataFrame:
        made = span.lateralJoin(dates(F.col("first").outer(), F.col("last").outer()))
        return made.select("panel_id", "date")

    return generator


def first_only(dates: DataFrame) -> DataFrame:
    """The first date of each panel: buy and hold."""
    return dates.groupBy("panel_id").agg(F.min("date").alias("date"))


def rebalance_mask(dates: DataFrame, rebal: DataFrame) -> DataFrame:
    """(panel_id, date, is_rebal) for all dates of the panel."""
    marked = rebal.select("panel_id", "date", F.lit(True).alias("_on"))
    return dates.select("panel_id", "date").distinct().join(marked, ["panel_id", "date"], "left").select("panel_id", "date", F.coalesce("_on", F.lit(False)).alias("is_rebal"))


def check_period(start: dt.date, end: dt.date, first: dt.date, last: dt.date, least_end: dt.date = dt.date(2022, 6, 1), years: float = 3.5, override: bool = False) -> tuple[dt.date, dt.date] | None:
    """A requested period as the analysis takes it: long enough (unless override) and within the data (first to last); None if nothing of it is.

    Raises ValueError for an end before least_end, and for a start that isn't before the end.
    """
    if end < least_end:
        raise ValueError(f"the end must not be before {least_end}")
    if start >= end:
        raise ValueError("the start must be before the end")
    if not override:
        start = min(start, end - dt.timedelta(int(years * 365)))
    start, end = max(start, first), min(end, last)
    return (start, end) if start <= end else None


def clamp_period(start: Column, end: Column, least_end: str = "2022-06-01", years: float = 3.5) -> tuple[Column, Column]:
    """A period whose end isn't before least_end and which lasts at least so many years."""
    end = F.greatest(end, F.lit(least_end).cast("date"))
    return F.least(start, F.date_sub(end, int(years * 365))), end
