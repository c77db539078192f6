"""Prices fetched ticker by ticker as a Spark data source, and a cache that fetches only what it lacks.

A fetcher is any importable function (ticker, start, end) -> Arrow record batches or rows of (date, price). The source makes a
partition of each ticker, so tickers are fetched side by side by the executors, and takes filters on ticker and date
over from Spark, so a fetcher is asked only for what a query needs.
"""

from __future__ import annotations

import datetime as dt
import importlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from panelforge.sources.panel import PriceSource, as_panel, fill_prices
from panelforge.sources.shared import delete, exists

SCHEMA = "date date, ticker string, price double"
FIRST, LAST = dt.date(1, 1, 1), dt.date(9999, 12, 31)
DAY = dt.timedelta(1)
_ARROW = pa.schema([("date", pa.date32()), ("ticker", pa.string()), ("price", pa.float64())])


def find_fetcher(name: str):  # noqa: ANN201
    """The function of a name like package.module:function."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class _Ticker(InputPartition):
    def __init__(self, ticker: str):
        super().__init__(ticker)
        self.ticker = ticker


class FetchedReader(DataSourceReader):
    """Reads the tickers of the option tickers (separated by commas) from start to end (both included), narrowed by pushed filters."""

    def __init__(self, options: dict[str, str]):
        self.fetcher, self.options = options["fetcher"], dict(options)
        self.tickers = [t for t in dict.fromkeys(options.get("tickers", "").split(",")) if t]
        self.start = dt.date.fromisoformat(options["start"]) if options.get("start") else FIRST
        self.end = dt.date.fromisoformat(options["end"]) if options.get("end") else LAST

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes over equality and membership of tickers, and bounds of dates; the others go back to Spark."""
        for f in filters:
            kind, at = type(f), getattr(f, "attribute", None)
            if at == ("ticker",) and kind in (EqualTo, In):
                wanted = {f.value} if kind is EqualTo else set(f.value)
                self.tickers = [t for t in self.tickers if t in wanted]
            elif at == ("date",) and kind in (GreaterThan, GreaterThanOrEqual, EqualTo, LessThan, LessThanOrEqual) and isinstance(f.value, dt.date):
                if kind in (GreaterThan, GreaterThanOrEqual, EqualTo):
                    self.start = max(self.start, f.value + DAY if kind is GreaterThan else f.value)
                if kind in (LessThan, LessThanOrEqual, EqualTo):
                    self.end = min(self.end, f.value - DAY if kind is LessThan else f.value)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [_Ticker(t) for t in self.tickers] if self.start <= self.end else []

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark makes of no partitions at all
            return
        rows = find_fetcher(self.fetcher)(partition.ticker, self.start, self.end, **{k[6:]: v for k, v in self.options.items() if k.startswith("fetch_")})
        for batch in rows:
            dates, prices = batch.columns[:2] if isinstance(batch, pa.RecordBatch) else (pa.array([batch[0]]), pa.array([batch[1]]))
            yield pa.RecordBatch.from_arrays([dates.cast(pa.date32()), pa.array([partition.ticker] * len(dates), pa.string()), prices.cast(pa.float64())], schema=_ARROW)


class FetchedPrices(DataSource):
    """The data source fetched_prices; options: fetcher, tickers, start, end, and fetch_x for each further argument x of the fetcher."""

    @classmethod
    def name(cls) -> str:
        return "fetched_prices"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return FetchedReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the data source known to the session, which must let Python sources take filters over."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FetchedPrices)


class FetchedSource(PriceSource):
    """A price source by a fetcher's name; further arguments go to the fetcher as text."""

    def __init__(self, fetcher: str, **arguments: str):
        self.fetcher, self.arguments = fetcher, {f"fetch_{k}": v for k, v in arguments.items()}

    def load(self, spark: SparkSession, tickers: Sequence[str], start: str | None = None, end: str | None = None) -> DataFrame:
        register(spark)
        bounds = {k: v for k, v in (("start", start), ("end", end)) if v}
        return spark.read.format("fetched_prices").options(fetcher=self.fetcher, tickers=",".join(tickers), **bounds, **self.arguments).load()


def lineitem_prices(ticker: str, start: dt.date, end: dt.date, path: str, damping: str = "5000.0") -> Iterator[pa.RecordBatch]:
    """A fetcher: one ticker's prices derived from order lines, as LineitemSource has them; only its lines and dates are read from path.

    path is read by Arrow, so it must be one that Arrow opens wherever executors run.
    """
    import pyarrow.compute as pc
    import pyarrow.dataset as ds

    lines = ds.dataset(path)
    day = lambda d: pa.scalar(d, pa.date32()).cast(lines.schema.field("l_shipdate").type)
    mine = pc.field("l_linenumber") == int(ticker.removeprefix("T"))
    if start > FIRST:
        mine &= pc.field("l_shipdate") >= day(start)
    if end < LAST:
        mine &= pc.field("l_shipdate") < day(end + DAY)
    sums: dict[dt.date, list[int]] = {}
    for batch in lines.to_batches(columns=["l_shipdate", "l_extendedprice", "l_quantity"], filter=mine):
        cents = [pc.round(pc.multiply(batch.column(k).cast(pa.float64()), 100.0)).cast(pa.int64()) for k in (1, 2)]
        by_day = pa.table([batch.column(0).cast(pa.date32()), *cents], ["d", "p", "q"]).group_by("d").aggregate([("p", "sum"), ("q", "sum")])
        for d, p, q in zip(*(by_day.column(x).to_pylist() for x in ("d", "p_sum", "q_sum")), strict=True):
            total = sums.setdefault(d, [0, 0])
            total[0], total[1] = total[0] + p, total[1] + q
    dates = sorted(sums)
    yield pa.RecordBatch.from_arrays([pa.array(dates, pa.date32()), pa.array([100 + (sums[d][0] / 100) / (sums[d][1] / 100) / float(damping) for d in dates], pa.float64())], ["date", "price"])


@dataclass(frozen=True)
class Span:
    """Days from start to end, both included."""

    start: dt.date
    end: dt.date


def gaps(asked: Span, covered: Iterable[Span]) -> list[Span]:
    """What of the asked days no covered span has, in order."""
    out, at = [], asked.start
    for c in sorted(covered, key=lambda s: s.start):
        if c.start > asked.end or at > asked.end:
            break
        if c.start > at:
            out.append(Span(at, min(asked.end, c.start - DAY)))
        if c.end >= at:
            if c.end == LAST:
                return out
            at = c.end + DAY
    return [*out, Span(at, asked.end)] if at <= asked.end else out


class GapCache:
    """A folder of prices already loaded from a source, of which only what is missing is asked for.

    Each load is a folder of its own, never changed; a version of the cache is a small table of which tickers and days are
    covered by which load. A load is written first, then the new version's table; a version counts once that is whole, so
    a write that fails leaves the last version, and those that read it undisturbed. Of two that write at the same time one
    fails when it makes the version that the other has made, and can be repeated.
    """

    _COVERED = "ticker string, start date, end date, part string"

    def __init__(self, spark: SparkSession, path: str, source: PriceSource):
        self.spark, self.path, self.source = spark, path.rstrip("/"), source

    def version(self) -> int:
        """The number of the last whole version; 0 if there is none."""
        n = 0
        while exists(self.spark, f"{self.path}/version-{n + 1}/_SUCCESS"):
            n += 1
        return n

    def covered(self) -> DataFrame:
        """(ticker, start, end, part) of the last version."""
        n = self.version()
        return self.spark.read.schema(self._COVERED).parquet(f"{self.path}/version-{n}") if n else self.spark.createDataFrame([], self._COVERED)

    def _commit(self, covered: DataFrame, n: int) -> None:
        if exists(self.spark, f"{self.path}/version-{n}") and not exists(self.spark, f"{self.path}/version-{n}/_SUCCESS"):
            delete(self.spark, f"{self.path}/version-{n}")  # of a write that failed
        covered.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/version-{n}")

    def missing(self, tickers: Sequence[str], asked: Span) -> dict[Span, list[str]]:
        """By missing span the tickers that lack it."""
        known: dict[str, list[Span]] = {}
        for r in self.covered().where(F.col("ticker").isin(list(tickers))).select("ticker", "start", "end").collect():  # of the tickers asked for
            known.setdefault(r["ticker"], []).append(Span(r["start"], r["end"]))
        out: dict[Span, list[str]] = {}
        for t in dict.fromkeys(tickers):
            for gap in gaps(asked, known.get(t, [])):
                out.setdefault(gap, []).append(t)
        return out

    def prices(self, tickers: Sequence[str], start: str | None = None, end: str | None = None) -> DataFrame:
        """(date, ticker, price) of the tickers and days asked for, those that the cache lacks loaded from the source first."""
        asked = Span(dt.date.fromisoformat(start) if start else FIRST, dt.date.fromisoformat(end) if end else LAST)
        lacking = self.missing(tickers, asked)
        if lacking:
            n = self.version()
            rows, spans = None, []
            for gap, which in lacking.items():
                loaded = self.source.load(self.spark, which, None if gap.start == FIRST else gap.start.isoformat(), None if gap.end == LAST else gap.end.isoformat()).select("date", "ticker", "price")
                rows = loaded if rows is None else rows.unionByName(loaded)
                spans += [(t, gap.start, gap.end, f"part-{n + 1}") for t in which]
            rows.write.mode("overwrite").parquet(f"{self.path}/part-{n + 1}")  # no version refers to it yet
            self._commit(self.covered().unionByName(self.spark.createDataFrame(spans, self._COVERED)), n + 1)
        return self._read(tickers, asked)

    def _read(self, tickers: Sequence[str], asked: Span) -> DataFrame:
        parts = sorted(r["part"] for r in self.covered().select("part").distinct().collect())  # a row for each load since the last merge
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/{p}" for p in parts))
        return rows.where(F.col("ticker").isin(list(tickers)) & F.col("date").between(*(F.lit(d.isoformat()).cast("date") for d in (asked.start, asked.end))))

    def panel(self, tickers: Sequence[str], start: str | None = None, end: str | None = None, limit: int = 5) -> DataFrame:
        """The panel of what is asked for, filled forward from what came before it, too; as prices() otherwise. Callers clamp afterwards."""
        self.prices(tickers, start, end)
        return fill_prices(as_panel(self._read(tickers, Span(FIRST, LAST))), limit)

    def merge(self) -> None:
        """All loads in one, by ticker, and touching spans as one, under a new version; loads that older versions refer to stay for their readers."""
        n = self.version()
        if not n:
            return
        rows = self.covered().collect()  # a row for each ticker and load
        merged: dict[str, list[Span]] = {}
        for r in sorted(rows, key=lambda r: (r["ticker"], r["start"])):
            spans = merged.setdefault(r["ticker"], [])
            if spans and (spans[-1].end == LAST or r["start"] <= spans[-1].end + DAY):
                spans[-1] = Span(spans[-1].start, max(spans[-1].end, r["end"]))
            else:
                spans.append(Span(r["start"], r["end"]))
        self._read(list(merged), Span(FIRST, LAST)).repartition("ticker").sortWithinPartitions("ticker", "date").write.mode("overwrite").parquet(f"{self.path}/part-{n + 1}")
        self._commit(self.spark.createDataFrame([(t, s.start, s.end, f"part-{n + 1}") for t, spans in merged.items() for s in spans], self._COVERED), n + 1)
