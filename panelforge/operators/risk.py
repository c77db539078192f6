"""Risk contributions: exposures (panel_id, date, label, exposure) against covariances (panel_id, date, i, j, cov)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

YEAR = 252
DATES = ("latest", "all", "rebal_only")


def pick_dates(exposures: DataFrame, which: str = "latest", rebal: DataFrame | None = None) -> DataFrame:
    """The exposures of each panel's last date, of all dates, or of the rebalance dates (all if there are none given)."""
    if which not in DATES:
        raise ValueError(f"which must be one of {DATES}, not {which!r}")
    if which == "latest":
        return exposures.join(exposures.groupBy("panel_id").agg(F.max("date").alias("date")), ["panel_id", "date"], "left_semi")
    return exposures.join(rebal, ["panel_id", "date"], "left_semi") if which == "rebal_only" and rebal is not None else exposures


def contributions(exposures: DataFrame, cov: DataFrame, annualize: bool = True) -> DataFrame:
    """(panel_id, date, label, exposure, vol, mctr, ctr, ctr_pct); all null on dates whose variance is missing or not positive.

    Dates without covariances are left out. ctr_pct sums to 1 by date; the rest is by year if annualize.
    """
    day = ["panel_id", "date"]
    x = exposures.select(*day, F.col("label").alias("j"), F.col("exposure").alias("_x"))
    rows = cov.join(x, [*day, "j"]).groupBy(*day, "i").agg(F.sum(F.col("cov") * F.col("_x")).alias("_sx"), F.count_if(F.col("cov").isNull()).alias("_lost"))
    rows = rows.withColumn("_sx", F.when(F.col("_lost") == 0, F.col("_sx"))).withColumnRenamed("i", "label")
    rows = exposures.select(*day, "label", "exposure").join(rows, [*day, "label"])
    var = rows.groupBy(*day).agg(F.sum(F.col("exposure") * F.col("_sx")).alias("_v"), F.count_if(F.col("_sx").isNull()).alias("_bad"))
    vol = F.when((F.col("_bad") == 0) & (F.col("_v") > 0), F.sqrt("_v"))
    rows = rows.join(var.select(*day, vol.alias("_vol")), day)
    scale = float(YEAR) ** 0.5 if annualize else 1.0
    mctr = F.col("_sx") / F.col("_vol")
    ctr = F.col("exposure") * mctr
    return rows.select(*day, "label", "exposure", (F.col("_vol") * scale).alias("vol"), (mctr * scale).alias("mctr"), (ctr * scale).alias("ctr"), (ctr / F.col("_vol")).alias("ctr_pct"))


def by_class(contribs: DataFrame, assets: DataFrame) -> DataFrame:
    """(panel_id, date, asset_class, ctr_pct), labels that assets lacks under Other."""
    rows = contribs.join(assets.select(F.col("ticker").alias("label"), "asset_class"), "label", "left")
    return rows.where("ctr_pct is not null").groupBy("panel_id", "date", F.coalesce("asset_class", F.lit("Other")).alias("asset_class")).agg(F.sum("ctr_pct").alias("ctr_pct"))


def variance_split(systematic: DataFrame, fits: DataFrame, smoothing: int = 5) -> DataFrame:
    """(panel_id, date, systematic_vol, idio_vol, systematic_share, idio_share): factor risk against the regression's rest, 0 shares if there is no risk."""
    idio = F.sqrt("resid_var") * F.sqrt(F.lit(YEAR / smoothing))
    rows = systematic.select("panel_id", "date", F.col("vol").alias("systematic_vol")).distinct().join(fits.select("panel_id", "date", idio.alias("idio_vol")), ["panel_id", "date"])
    s, i = F.pow("systematic_vol", F.lit(2)), F.pow("idio_vol", F.lit(2))
    share = lambda x: F.when(s + i > 0, x / (s + i)).otherwise(0.0)
    return rows.select("*", share(s).alias("systematic_share"), share(i).alias("idio_share"))
