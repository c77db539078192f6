"""Factor exposures of a NAV and the attribution of its returns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.scans import running
from panelforge.functions.series import along, day_keys, fill_budget, full_window, lagged_return
from panelforge.kernels import regression
from panelforge.sources.shared import written

MODES = ("rolling", "full")
#: Dates whose windows are fitted in one task.
BLOCK_ROWS = 250
SCHEMA = "panel_id string, date date, term string, beta double, t_stat double, rsq double, resid_var double"


def regression_returns(levels: DataFrame, nav: DataFrame, rf: DataFrame, window: int = 5) -> DataFrame:
    """(panel_id, date, series, x): log returns over window rows less window times the log risk-free rate, then gaps filled with 0, five at most.

    levels is (panel_id, date, factor, level), nav (panel_id, date, nav); the NAV is the series nav. Missing rates are 0.
    """
    rows = levels.select("panel_id", "date", F.col("factor").alias("series"), F.col("level").alias("v")).unionByName(nav.select("panel_id", "date", F.lit("nav").alias("series"), F.col("nav").alias("v")))
    w = along("panel_id", "series")
    on = day_keys(rf)
    free = rf.select(*on, F.log1p("rf").alias("_rf"))
    rows = rows.join(free, on, "left").select("panel_id", "date", "series", (lagged_return(F.col("v"), w, window) - window * F.coalesce("_rf", F.lit(0.0))).alias("x"))
    return rows.select("panel_id", "date", "series", fill_budget(F.col("x"), w).alias("x"))


def exposures(levels: DataFrame, nav: DataFrame, rf: DataFrame, mode: str = "rolling", lookback: int = 120, window: int = 5, max_lags: int = 5, missing_share: float = 0.10) -> DataFrame:
    """(panel_id, date, term, beta, t_stat, rsq, resid_var): regressions of the NAV on all factors, the term const first.

    full: one over all rows, dated at the last; see full_exposures(). rolling: for each date one over the lookback rows before it; null for the first
    dates and where a factor or the NAV lacks more than missing_share of the window.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")

    rows = regression_returns(levels, nav, rf, window)
    if mode == "full":
        return full_exposures(rows, max_lags)

    def run(key: tuple[str, ...], rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index="date", columns="series", values="x").sort_index()
        names = [c for c in wide.columns if c != "nav"]
        x, y = wide[names].to_numpy(np.float64), wide["nav"].to_numpy(np.float64)
        own = wide.index.get_indexer(rows.loc[rows["_own"], "date"].unique())
        own.sort()
        found, dates = [v[own] for v in regression.rolling_ols_hac(x, y, lookback, max_lags, missing_share)], wide.index[own]
        k = len(names) + 1
        if not len(dates):
            return pd.DataFrame(columns=[x.split()[0] for x in SCHEMA.split(", ")])
        out = pd.DataFrame({"panel_id": key[0], "date": np.repeat(dates.to_numpy(), k), "term": np.tile(["const", *names], len(dates))})
        for name, v in zip(("beta", "t_stat", "rsq", "resid_var"), found, strict=True):
            flat = pd.Series(np.asarray(v, np.float64).reshape(len(dates), -1).repeat(k if np.ndim(v) == 1 else 1, axis=1).reshape(-1)).astype(object)
            flat[flat.isna()] = None
            out[name] = flat
        return out

    # windows don't depend on each other: blocks of dates, each with the rows before it that its windows reach
    block = lambda x: F.floor(x / BLOCK_ROWS)
    rows = running(rows, ["panel_id", "series"], _n=("sum", F.lit(1).cast("long"))).withColumn("_k", F.col("_n") - 1)  # series are dense, so dates have one place
    rows = rows.withColumn("_block", F.explode(F.sequence(block(F.col("_k")), block(F.col("_k") + lookback))))
    rows = rows.withColumn("_own", block(F.col("_k")) == F.col("_block"))
    return rows.groupBy("panel_id", "_block").applyInPandas(run, SCHEMA)


def full_exposures(x: DataFrame, max_lags: int = 5, block_rows: int = 4096) -> DataFrame:
    """exposures() over all rows of x (panel_id, date, series, x), as regression_returns() makes it; dates that lack a value are left out.

    Two aggregations, neither of which gathers a panel: the sums of products of all pairs of columns, from which the
    coefficients are solved (a row for each panel), and then the sums of products of each row's influence on the
    coefficients with those of the max_lags rows before it. For these, rows go by blocks, with the last ones of the block before.
    """
    panel = ["panel_id"]
    names = x.where("series <> 'nav'").groupBy(*panel).agg(F.sort_array(F.collect_set("series")).alias("names"))  # a panel's factors, not its rows
    ends = x.groupBy(*panel).agg(F.max("date").alias("date"))
    wide = x.groupBy("panel_id", "date").agg(F.map_from_entries(F.collect_list(F.struct("series", "x"))).alias("m")).join(names, panel)
    z = F.concat(F.array(F.lit(1.0)), F.transform("names", lambda n: F.try_element_at("m", n)), F.array(F.try_element_at("m", F.lit("nav"))))
    rows = written(wide.select("panel_id", "date", z.alias("z")).where(F.forall("z", lambda v: v.isNotNull())), "observations")
    pairs = rows.select("panel_id", "z", F.posexplode("z").alias("i", "a")).select("panel_id", "i", "a", F.posexplode("z").alias("j", "b")).where("i <= j")
    sums = pairs.groupBy("panel_id", "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("s"))
    moments = sums.groupBy(*panel).agg(F.sort_array(F.collect_list(F.struct("i", "j", "s"))).alias("s"))

    def solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, s in zip(frame["panel_id"], frame["s"], strict=True):
                k = max(e["j"] for e in s)
                full = np.zeros((k + 1, k + 1))
                for e in s:
                    full[e["i"], e["j"]] = full[e["j"], e["i"]] = e["s"]
                n = full[0, 0]
                if n > k:
                    inverse = np.linalg.pinv(full[:k, :k])
                    out.append((name, n, full[k, k] - full[0, k] ** 2 / n, (inverse @ full[:k, k]).tolist(), inverse.reshape(-1).tolist()))
            yield pd.DataFrame(out, columns=["panel_id", "n", "total", "beta", "inverse"])

    fits = moments.mapInPandas(solved, "panel_id string, n double, total double, beta array<double>, inverse array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    known = running(rows, panel, _n=("sum", F.lit(1).cast("long"))).join(fits.select("panel_id", "beta", "inverse"), panel)
    known = known.withColumn("_x", F.slice("z", 1, F.size("beta"))).withColumn("rest", F.element_at("z", -1) - dot(F.col("_x"), F.col("beta")))
    k = F.size("beta")
    pull = F.transform(F.sequence(F.lit(0), k - 1), lambda c: dot(F.slice("inverse", c * k + 1, k), F.col("_x")) * F.col("rest"))
    block = lambda place: F.floor(place / block_rows)
    place = F.col("_n") - 1
    known = known.select("panel_id", "date", "rest", pull.alias("pull"), block(place).alias("_own"), F.explode(F.sequence(block(place), block(place + max_lags))).alias("_block"))
    w = Window.partitionBy("panel_id", "_block").orderBy("date")
    earlier = F.array(*[F.lag("pull", lag).over(w) for lag in range(1, max_lags + 1)]) if max_lags else F.expr("cast(array() as array<array<double>>)")
    lagged = known.withColumn("_earlier", earlier).where("_own = _block")
    weighted = F.aggregate(F.transform("_earlier", lambda q, l: 2 * (1 - (l + 1) / F.lit(max_lags + 1.0)) * F.coalesce(F.get(q, F.col("c")), F.lit(0.0))), F.col("q"), lambda s, v: s + v)
    spread = lagged.select("panel_id", "rest", "_earlier", F.posexplode("pull").alias("c", "q")).select("panel_id", "c", (F.col("q") * weighted).alias("v"), F.when(F.col("c") == 0, F.col("rest") * F.col("rest")).alias("e"))
    errors = spread.groupBy("panel_id", "c").agg(F.sum("v").alias("v"), F.sum("e").alias("e"))
    errors = errors.groupBy(*panel).agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("v"), F.max("e").alias("left"))
    out = names.join(ends, panel).join(fits, panel, "left").join(errors, panel, "left")
    term = F.concat(F.array(F.lit("const")), F.col("names"))
    b, se = lambda i: F.get("beta", i), lambda i: F.sqrt(F.greatest(F.get("v", i)["v"], F.lit(0.0)))
    lines = F.transform(term, lambda n, i: F.struct(n.alias("term"), b(i).alias("beta"), F.try_divide(b(i), se(i)).alias("t_stat")))
    out = out.select("panel_id", "date", F.inline(lines), F.when(F.col("total") > 0, 1 - F.col("left") / F.col("total")).alias("rsq"), (F.col("left") / (F.col("n") - F.size("beta"))).alias("resid_var"))
    return out.select("panel_id", "date", "term", "beta", "t_stat", "rsq", "resid_var")


def single_beta(x: DataFrame, factor: str) -> DataFrame:
    """(panel_id, beta, alpha, rsq) of the NAV on one factor over all rows, from regression_returns(); native."""
    both = x.groupBy("panel_id", "date").agg(F.max(F.when(F.col("series") == "nav", F.col("x"))).alias("y"), F.max(F.when(F.col("series") == factor, F.col("x"))).alias("x"))
    return both.groupBy("panel_id").agg(F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("alpha"), F.regr_r2("y", "x").alias("rsq"))


def single_beta_rolling(x: DataFrame, factor: str, lookback: int = 120) -> DataFrame:
    """(panel_id, date, beta) of the NAV on one factor over the lookback rows before each date; native."""
    both = x.groupBy("panel_id", "date").agg(F.max(F.when(F.col("series") == "nav", F.col("x"))).alias("y"), F.max(F.when(F.col("series") == factor, F.col("x"))).alias("x"))
    frame = along("panel_id").rowsBetween(-lookback, -1)
    slope = F.try_divide(F.covar_samp("y", "x").over(frame), F.var_samp("x").over(frame))
    return both.select("panel_id", "date", F.when(F.count("x").over(frame) == lookback, slope).alias("beta"))


def attribution(betas: DataFrame, levels: DataFrame, nav: DataFrame, rf: DataFrame) -> DataFrame:
    """(panel_id, date, component, contrib): daily log returns of the NAV split into factors, RiskFree and Residual, and their Total.

    On dates that betas (without const), levels and nav share. Without betas the residual is the whole excess return.
    """
    w = along("panel_id", "factor")
    on = day_keys(rf)
    free = rf.select(*on, F.log1p("rf").alias("_rf"))
    f = levels.select("panel_id", "date", "factor", lagged_return(F.col("level"), w).alias("_f"))
    p = nav.select("panel_id", "date", lagged_return(F.col("nav"), along("panel_id")).alias("_p"))
    b = betas.where(F.col("term") != "const").select("panel_id", "date", F.col("term").alias("factor"), "beta")
    rows = b.join(f, ["panel_id", "date", "factor"]).join(p, ["panel_id", "date"]).join(free, on)
    rows = rows.withColumn("contrib", F.col("beta") * (F.col("_f") - F.col("_rf")))
    total = rows.groupBy("panel_id", "date").agg(F.first("_p").alias("_p"), F.first("_rf").alias("_rf"), F.coalesce(F.sum("contrib"), F.lit(0.0)).alias("_c"))
    parts = (("RiskFree", F.col("_rf")), ("Residual", F.col("_p") - F.col("_rf") - F.col("_c")), ("Total", F.col("_p")))
    more = total.select("panel_id", "date", F.inline(F.array(*[F.struct(F.lit(n).alias("component"), v.alias("contrib")) for n, v in parts])))
    return rows.select("panel_id", "date", F.col("factor").alias("component"), "contrib").unionByName(more)


def trend(daily: DataFrame, window: int = 126) -> DataFrame:
    """(panel_id, date, component, contrib): simple returns of the last window log contributions; null unless all exist."""
    x = F.col("contrib")
    return daily.select("panel_id", "date", "component", F.expm1(full_window(x, F.sum(x), along("panel_id", "component"), window)).alias("contrib"))
