"""Exact percentiles without keeping values: the range that holds an order statistic is narrowed by histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.sources.shared import Scratch

#: Bins that a range is cut into in each pass.
BINS = 1024


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], bins: int = BINS) -> DataFrame:
    """(keys, values): for each group the interpolated percentiles of value (double), one for each of shares (0 to 1), in their order.

    A pass counts, for each order statistic wanted, the values of each bin of the range that holds it, and goes on with the
    bin that it falls into, cut to its least and greatest value; it is over when these are the same. Ranges of floats end
    after seven passes of 1024 bins at most, mostly after two or three. No state is larger than a histogram, ties or not. Nulls are left
    out, groups without values too, NaN isn't looked for; an empty df gives an empty result. Keys aren't null.
    """
    scratch = Scratch(df.sparkSession, "percentiles")
    rows = scratch.write(df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null"), "values")
    rank = lambda p: F.lit(float(p)) * (F.col("_n") - 1)
    wanted = F.array(*[F.struct(F.lit(2 * k + side).alias("_t"), end(rank(p)).cast("long").alias("_k")) for k, p in enumerate(shares) for side, end in ((0, F.floor), (1, F.ceil))])
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    found = scratch.write(groups.select(*keys, "_n", "_low", "_high", F.inline(wanted)), "found")
    by = [*keys, "_t"]
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bin
    while found.where("_low < _high").limit(1).count():
        # halves, so that the width of a range of any floats is a float
        width = F.col("_high") / 2 - F.col("_low") / 2
        share = F.try_divide(F.col("_v") / 2 - F.col("_low") / 2, width)
        place = F.when(width > 0, F.least(F.floor(share * bins), F.lit(bins - 1))).otherwise((F.col("_v") > F.col("_low")).cast("long"))
        inside = rows.join(found.where("_low < _high"), [*keys]).where("_v between _low and _high")
        counts = inside.groupBy(*by, "_n", "_k", place.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        counts = counts.withColumn("_less", F.coalesce(F.sum("_c").over(before), F.lit(0).cast("long")))
        hit = counts.where("_less <= _k and _k < _less + _c").select(*keys, "_n", "_low", "_high", "_t", (F.col("_k") - F.col("_less")).alias("_k"))
        found = scratch.write(found.where("_low = _high").unionByName(hit), "found")
        scratch.drop("found", last=1)
    values = found.groupBy(*keys, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_t", "_low"))).alias("_m"))  # two entries for each share
    at = lambda t: F.element_at("_m", F.lit(t))
    between = lambda k, p: at(2 * k) + (rank(p) - F.floor(rank(p))) * (at(2 * k + 1) - at(2 * k))
    return values.select(*keys, F.array(*[between(k, p) for k, p in enumerate(shares)]).alias("values"))
