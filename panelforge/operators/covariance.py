"""Covariances and correlations of returns: (panel_id, date, i, j, cov) with both (i, j) and (j, i)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from panelforge.functions.scans import RANGE_DAYS, decayed, ranges, running
from panelforge.functions.series import along
from panelforge.kernels import ewma
from panelforge.sources.panel import complete_dates
from panelforge.sources.shared import written

#: Tickers in a group; a tile is a pair of groups.
TILE = 64


def pairs(rets: DataFrame, value: str = "ret") -> DataFrame:
    """(panel_id, date, i, j, x, y, n tickers) of dates on which all tickers have a return; each unordered pair once, and each ticker with itself."""
    return _all_pairs(complete_dates(rets, value), value)


def _all_pairs(rets: DataFrame, value: str) -> DataFrame:
    """pairs() of complete dates."""
    day = rets.groupBy("panel_id", "date").agg(F.sort_array(F.collect_list(F.struct(F.col("ticker").alias("i"), F.col(value).alias("x")))).alias("_r"))
    left = day.select("panel_id", "date", "_r", F.posexplode("_r").alias("_k", "a"))
    both = left.select("panel_id", "date", "a", F.explode(F.expr("slice(_r, _k + 1, size(_r))")).alias("b"), F.size("_r").alias("n"))
    return both.select("panel_id", "date", F.col("a.i").alias("i"), F.col("b.i").alias("j"), F.col("a.x").alias("x"), F.col("b.x").alias("y"), "n")


def both_ways(half: DataFrame) -> DataFrame:
    """Each pair (i, j) as (j, i) too, in one pass."""
    same, turned = F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
    ways = F.when(F.col("i") == F.col("j"), F.array(same)).otherwise(F.array(same, turned))
    rest = [c for c in half.columns if c not in ("i", "j")]
    return half.select(*rest, F.inline(ways)).select(*half.columns)


def _named(rets: DataFrame) -> DataFrame:
    """(panel_id, names): the sorted tickers of each panel."""
    return rets.groupBy("panel_id").agg(F.sort_array(F.collect_set("ticker")).alias("names"))  # a panel's tickers, not its rows


def tiles(rows: DataFrame, names: DataFrame, value: str, block: Column) -> DataFrame:
    """(panel_id, i, j, block, dates, left, right): for each pair i <= j of groups of TILE tickers, the values of both by date, flattened; complete dates only.

    A universe of n tickers has about (n / TILE)^2 / 2 tiles, and a date of a group is sent to n / TILE of them, so what is
    shuffled grows with the universe's size divided by TILE and no row is made for a pair of tickers. block is an array of the
    blocks that a row belongs to. A tile's block is one row: of 4096 dates four megabytes.
    """
    group = lambda x: F.floor(x / TILE).cast("int")
    placed = rows.join(names, "panel_id").withColumn("_g", group(F.array_position("names", F.col("ticker")) - 1)).withColumn("_groups", group(F.size("names") - 1) + 1)
    vectors = placed.groupBy("panel_id", "date", "_g").agg(F.transform(F.sort_array(F.collect_list(F.struct("ticker", F.col(value).alias("v")))), lambda x: x["v"]).alias("v"), F.first("_groups").alias("_groups"))
    sent = vectors.select("panel_id", "date", "_g", "v", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)).alias("_h")).select("*", F.explode(block).alias("block"))
    listed = sent.groupBy("panel_id", F.least("_g", "_h").alias("i"), F.greatest("_g", "_h").alias("j"), "block").agg(F.sort_array(F.collect_list(F.struct("date", "_g", "v"))).alias("_r"))
    side = lambda g: F.flatten(F.transform(F.filter("_r", lambda x: x["_g"] == F.col(g)), lambda x: x["v"]))
    dates = F.transform(F.filter("_r", lambda x: x["_g"] == F.col("i")), lambda x: x["date"])
    return listed.select("panel_id", "i", "j", "block", dates.alias("dates"), side("i").alias("left"), side("j").alias("right"))


TILED = "panel_id string, i int, j int, dates array<date>, covs array<array<double>>"


def _untiled(tiled: DataFrame, names: DataFrame) -> DataFrame:
    """(panel_id, date, i, j, cov) of tiled (panel_id, i, j, dates, covs), a flat matrix for each date; both ways."""
    rows = tiled.join(names, "panel_id").select("panel_id", "i", "j", "names", F.inline(F.arrays_zip("dates", "covs")))
    cells = rows.select("panel_id", F.col("dates").alias("date"), "i", "j", "names", F.posexplode("covs").alias("_k", "cov"))
    wide = F.least(F.lit(TILE), F.size("names") - F.col("j") * TILE)
    one, two = F.get("names", F.col("i") * TILE + F.floor(F.col("_k") / wide).cast("int")), F.get("names", F.col("j") * TILE + F.col("_k") % wide)
    cells = cells.select("panel_id", "date", one.alias("a"), two.alias("b"), (F.col("i") < F.col("j")).alias("_off"), "cov")
    ways = F.when(F.col("_off"), F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j")))).otherwise(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j"))))
    return cells.select("panel_id", "date", F.inline(ways), "cov").select("panel_id", "date", "i", "j", "cov")


def _nested(values: np.ndarray) -> pa.Array:
    """A list of lists: a flat matrix for each row of values (rows, cells); NaN as null."""
    flat = pa.array(values.reshape(-1), from_pandas=True)
    inner = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), flat)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), inner)


def _matrices(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The two sides of the tile in row k of a batch, by date."""
    n = len(batch.column("dates")[k].values)
    return tuple(batch.column(x)[k].values.to_numpy(zero_copy_only=False).reshape(n, -1) for x in ("left", "right"))


def sample_covariance(rets: DataFrame, window: int, annualize: float = 1.0, value: str = "ret", block_rows: int = 512) -> DataFrame:
    """Covariance of the last window rows of complete returns; null for the first rows.

    By tiles of tickers and blocks of dates, each with the window - 1 dates before it: running sums of products within the block.
    """
    whole = written(complete_dates(rets.select("panel_id", "date", "ticker", F.col(value).alias("ret")), "ret"), "whole")
    names = _named(whole)
    days = running(whole.select("panel_id", "date").distinct(), ["panel_id"], _n=("sum", F.lit(1).cast("long")))
    block = lambda x: F.floor(x / block_rows)
    rows = whole.join(days, ["panel_id", "date"])
    own = block(F.col("_n") - 1)
    # the first row's place tells how many dates of a block stand before its own
    rows = rows.select("panel_id", "date", "ticker", F.struct("ret", "_n").alias("v"), F.sequence(own, block(F.col("_n") + window - 2)).alias("_blocks"))
    tiled = tiles(rows.withColumn("v", F.struct("v", "_blocks")), names, "v", F.get("v", F.lit(0))["_blocks"])
    first = F.get("left", F.lit(0))["v"]["_n"]
    side = lambda x: F.transform(x, lambda e: e["v"]["ret"])
    tiled = tiled.select("panel_id", "i", "j", "block", "dates", side("left").alias("left"), side("right").alias("right"), first.alias("first"))

    def rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for k in range(len(whole_batch)):
                batch = whole_batch.slice(k, 1)
                x, y = _matrices(batch, 0)
                first, at = batch.column("first")[0].as_py() - 1, batch.column("block")[0].as_py() * block_rows
                x, y = x - x.mean(axis=0), y - y.mean(axis=0)
                sums = [np.concatenate([np.zeros((1, *v.shape[1:])), np.cumsum(v, axis=0)]) for v in (x, y, x[:, :, None] * y[:, None, :])]
                ends = np.arange(max(at - first, 0), len(x)) + 1
                if not len(ends):  # nothing but what stands before a block that has no dates
                    continue
                out = np.full((len(ends), x.shape[1], y.shape[1]), np.nan)
                full = ends >= window
                if full.any() and window > 1:
                    sx, sy, sxy = (v[ends[full]] - v[ends[full] - window] for v in sums)
                    out[full] = (sxy - sx[:, :, None] * sy[:, None, :] / window) / (window - 1) * annualize
                dates = batch.column("dates")[0].values.slice(ends[0] - 1)
                yield pa.RecordBatch.from_arrays([batch.column("panel_id"), batch.column("i"), batch.column("j"), pa.ListArray.from_arrays(pa.array([0, len(dates)], pa.int32()), dates), _nested(out.reshape(len(ends), -1))], ["panel_id", "i", "j", "dates", "covs"])

    return _untiled(tiled.mapInArrow(rolled, TILED), names)


def correlation(rets: DataFrame, value: str = "ret") -> DataFrame:
    """(panel_id, i, j, corr) over all complete dates, both ways."""
    return both_ways(pairs(rets, value).groupBy("panel_id", "i", "j").agg(F.corr("x", "y").alias("corr")))


def clipped(rets: DataFrame, decay: float, sigmas: float = ewma.SIGMAS, days: int = RANGE_DAYS) -> DataFrame:
    """rets (panel_id, ticker, date, ret, start_var, ...) with cut, the returns cut to sigmas times the volatility known before them.

    A series is cut range by range, side by side: ranges that others follow are first made into maps of the variance, these
    are put together along the series (a row for each range), and then each range runs from its own start. No return is null,
    and start_var is the same in all rows of a series.
    """
    keys, rest = ["panel_id", "ticker"], [c for c in rets.columns if c not in ("panel_id", "ticker")]
    listed = rets.withColumn("_range", ranges("date", days)).groupBy(*keys, "_range").agg(F.sort_array(F.collect_list(F.struct("date", *(c for c in rest if c != "date")))).alias("_rows"))
    listed = listed.select(*keys, "_range", "_rows", F.transform("_rows", lambda x: x["ret"]).alias("r"), F.get("_rows", F.lit(0))["start_var"].alias("_var"))
    last = listed.groupBy(*keys).agg(F.max("_range").alias("_last"))
    inner = listed.join(last, keys).where("_range < _last").select(*keys, "_range", "_last", "r", "_var")

    def mapped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            maps = [ewma.ClipMap(r.tolist(), decay, sigmas) for r in frame["r"]]
            # the returns go along only if the range may have to be gone through
            frame["r"] = [m.rets if m.dies > ewma.DEAD**2 else [] for m in maps]
            yield frame.assign(slopes=[[x for x, _ in m.lines] for m in maps], offsets=[[x for _, x in m.lines] for m in maps], dies=[m.dies for m in maps])

    def carry(key: tuple[str, str], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_range")
        var, starts = float(rows["_var"].iloc[0]), []
        for r, slopes, offsets, dies in zip(rows["r"], rows["slopes"], rows["offsets"], rows["dies"], strict=True):
            var = ewma.ClipMap.known(r.tolist(), zip(slopes, offsets, strict=True), dies, decay, sigmas)(var)
            starts.append(var)
        return pd.DataFrame({"panel_id": key[0], "ticker": key[1], "_range": [*rows["_range"].iloc[1:], rows["_last"].iloc[0]], "_in": starts})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [ewma.clip(r, decay, v, sigmas)[0] for r, v in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(done, pa.list_(pa.float64()))], ["panel_id", "ticker", "_rows", "cut"])

    maps = inner.mapInPandas(mapped, "panel_id string, ticker string, _range long, _last long, r array<double>, _var double, slopes array<double>, offsets array<double>, dies double")
    starts = maps.groupBy(*keys).applyInPandas(carry, "panel_id string, ticker string, _range long, _in double")
    begun = listed.join(starts, [*keys, "_range"], "left").select(*keys, "_rows", "r", F.coalesce("_in", "_var").alias("_var"))
    done = begun.mapInArrow(cut, StructType([*begun.select(*keys, "_rows").schema.fields, StructField("cut", ArrayType(DoubleType()))]))
    return done.select(*keys, F.inline(F.zip_with("_rows", "cut", lambda x, c: F.struct(*(x[name].alias(name) for name in rest), c.alias("cut")))))


def _early(rets: DataFrame, span: int) -> DataFrame:
    """The first span rows of each series; a task passes on no more of a series than these."""
    place = F.row_number().over(along("panel_id", "ticker"))
    return rets.withColumn("_place", place).where(F.col("_place") <= span).drop("_place")


def _started(rets: DataFrame, span: int) -> DataFrame:
    """rets (panel_id, ticker, date, ret), none of which is null, with the mean and variance of the first span ones, and until, the last one's date."""
    starts = _early(rets, span).groupBy("panel_id", "ticker").agg(F.avg("ret").alias("start_mean"), F.var_pop("ret").alias("start_var"), F.max("date").alias("until"))
    return rets.join(starts, ["panel_id", "ticker"])


def _prepared(rets: DataFrame, span: int, clip: bool, demean: bool, days: int) -> DataFrame:
    """_started() with used: outliers cut, and the running mean taken off, the row's own return in it."""
    keys, decay = ["panel_id", "ticker"], 1 - 2 / (1 + span)
    rows = _started(rets, span)
    rows = written(clipped(rows, decay, days=days), "cut") if clip else rows.withColumn("cut", F.col("ret"))
    if not demean:
        return rows.withColumnRenamed("cut", "used")
    return decayed(rows, keys, F.col("cut"), F.col("start_mean"), decay, "_mean", days=days).withColumn("used", F.col("cut") - F.col("_mean"))


def _whole(rets: DataFrame, value: str) -> DataFrame:
    """Complete dates only, written: the steps below need them several times."""
    return written(complete_dates(rets.select("panel_id", "date", "ticker", F.col(value).alias("ret")), "ret"), "whole")


def ewma_covariance(rets: DataFrame, span: int, annualize: float | None = None, clip: bool = True, demean: bool = True, value: str = "ret", days: int = RANGE_DAYS) -> DataFrame:
    """Exponentially weighted covariance of complete rows; null for the first span rows.

    The decay is 1 - 2 / (1 + span). Series are cut and centred one by one, then every tile of pairs runs by itself, by ranges
    of days: what a range makes of the matrix before it is decay^dates times it plus a matrix of its own, and these maps are
    put together along the tile (a matrix for each range) before each range runs from its own start. The population's variance
    starts a series that is alone, 0 pairs with one row.
    """
    decay, keys = 1 - 2 / (1 + span), ["panel_id", "i", "j"]
    whole = _whole(rets, value)
    names = _named(whole)
    used = _prepared(whole, span, clip, demean, days)

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                x, y = _matrices(batch, k)
                alone = batch.column("alone")[k].as_py()
                cov = (x - x.mean(axis=0)).T @ (y - y.mean(axis=0)) / (len(x) if alone else max(len(x) - 1, 1))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(k, 1) for c in keys] + [pa.array([cov.reshape(-1).tolist()]), pa.array([batch.column("dates")[k].values[-1].as_py()], pa.date32())], [*keys, "start", "until"])

    early = tiles(_early(whole, span), names, "ret", F.array(F.lit(0).cast("long"))).join(names, "panel_id")
    starts = early.select(*keys, "dates", "left", "right", (F.size("names") == 1).alias("alone")).mapInArrow(started, "panel_id string, i int, j int, start array<double>, until date")

    def steps(x: np.ndarray, y: np.ndarray, cov: np.ndarray) -> Iterator[np.ndarray]:
        for u, v in zip(x, y, strict=True):
            cov = decay * cov + (1 - decay) * np.outer(u, v)
            yield cov

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                x, y = _matrices(batch, k)
                weights = (1 - decay) * decay ** np.arange(len(x) - 1, -1, -1.0)
                own = (x * weights[:, None]).T @ y
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(k, 1) for c in (*keys, "block", "last", "start")] + [pa.array([decay ** len(x)]), pa.array([own.reshape(-1).tolist()])], [*keys, "block", "last", "start", "fade", "own"])

    def carry(key: tuple[str, int, int], rows: pd.DataFrame) -> pd.DataFrame:
        rows, found = rows.sort_values("block"), []
        cov = np.asarray(rows["start"].iloc[0], np.float64)
        for fade, own in zip(rows["fade"], rows["own"], strict=True):
            cov = fade * cov + np.asarray(own, np.float64)
            found.append(cov)
        return pd.DataFrame({"panel_id": key[0], "i": key[1], "j": key[2], "block": [*rows["block"].iloc[1:], rows["last"].iloc[0]], "_in": found})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                x, y = _matrices(batch, k)
                cov = batch.column("_in")[k].values.to_numpy(zero_copy_only=False).reshape(x.shape[1], y.shape[1])
                out = np.array(list(steps(x, y, cov))).reshape(len(x), -1) * (annualize or 1.0)
                dates = batch.column("dates")[k].values
                out[np.array(dates.to_numpy(zero_copy_only=False) <= np.datetime64(batch.column("until")[k].as_py()))] = np.nan
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(k, 1) for c in keys] + [pa.ListArray.from_arrays(pa.array([0, len(dates)], pa.int32()), dates), _nested(out)], [*keys, "dates", "covs"])

    tiled = tiles(used, names, "used", F.array(ranges("date", days))).join(starts, keys)
    last = whole.groupBy("panel_id").agg(F.max(ranges("date", days)).alias("last"))
    inner = tiled.join(last, "panel_id").where("block < last").select(*keys, "block", "last", "start", "dates", "left", "right")
    maps = inner.mapInArrow(mapped, "panel_id string, i int, j int, block long, last long, start array<double>, fade double, own array<double>")
    carried = maps.groupBy(*keys).applyInPandas(carry, "panel_id string, i int, j int, block long, _in array<double>")
    begun = tiled.join(carried, [*keys, "block"], "left").select(*keys, "dates", "left", "right", "until", F.coalesce("_in", "start").alias("_in"))
    return _untiled(begun.mapInArrow(run, TILED), names)


def ewma_variance(rets: DataFrame, span: int, annualize: float | None = None, clip: bool = True, demean: bool = True, value: str = "ret", days: int = RANGE_DAYS) -> DataFrame:
    """(panel_id, date, ticker, var): the diagonal of ewma_covariance(), without making pairs."""
    keys = ["panel_id", "ticker"]
    whole = _whole(rets, value)
    n = whole.groupBy("panel_id").agg(F.count_distinct("ticker").alias("n"))
    start = F.when(F.max("n") == 1, F.var_pop("ret")).when(F.count("ret") > 1, F.var_samp("ret")).otherwise(0.0)
    starts = _early(whole, span).join(n, "panel_id").groupBy(*keys).agg(start.alias("_start_var"))
    rows = _prepared(whole, span, clip, demean, days).join(starts, keys)
    run = decayed(rows, keys, F.col("used") * F.col("used"), F.col("_start_var"), 1 - 2 / (1 + span), "var", days=days)
    return run.select("panel_id", "date", "ticker", F.when(F.col("date") > F.col("until"), F.col("var") * (annualize or 1.0)).alias("var"))


def ewma_moments(rets: DataFrame, span: int, value: str = "ret", days: int = RANGE_DAYS) -> DataFrame:
    """(panel_id, date, ticker, clipped, mean, vol): by series the return after clipping, the running mean of it, and the volatility that clipped it; missing returns left out."""
    keys, decay = ["panel_id", "ticker"], 1 - 2 / (1 + span)
    rows = rets.select("panel_id", "date", "ticker", F.col(value).alias("ret")).where("ret is not null")
    rows = written(clipped(_started(rows, span), decay, days=days), "cut")
    both = decayed(rows, keys, F.col("cut"), F.col("start_mean"), decay, "mean", days=days)
    both = decayed(both, keys, F.col("cut") * F.col("cut"), F.col("start_var"), decay, "_square", days=days)
    return both.select("panel_id", "date", "ticker", F.col("cut").alias("clipped"), "mean", F.sqrt("_square").alias("vol"))


METHODS = ("ewma", "sample")


def by_method(rets: DataFrame, method: str = "ewma", span: int = 63, value: str = "ret") -> DataFrame:
    """The covariances of a risk estimate, by the name of its method: weighted with that span, or of the last span rows."""
    method = str(getattr(method, "value", method)).lower()
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    return ewma_covariance(rets, span, value=value) if method == "ewma" else sample_covariance(rets, span, value=value)


def latest_matrix(cov: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(panel_id, date, label, a column for each label): the covariances of each panel's last date as a matrix."""
    last = cov.groupBy("panel_id").agg(F.max("date").alias("date"))
    rows = cov.join(last, ["panel_id", "date"], "left_semi").where(F.col("i").isin(list(labels)))
    return rows.groupBy("panel_id", "date", F.col("i").alias("label")).pivot("j", list(labels)).agg(F.first("cov"))
