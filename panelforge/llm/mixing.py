"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled, repeatable order, served a given number of times over. Each serving
of a document gets a virtual finish time: the words of its source up to and with it, divided by the source's weight. In the
order of these times the sources advance in proportion to their weights, and one that runs dry leaves its share to the rest.
The mix is that order, sorted by ranges over all sources and cut where the words served use up the budget; the documents
that sources are being served from at the cut are taken up to the words that fit. No step gathers a source: running sums go
by ranges of the shuffle key, then within a range, and so does the search for the cut.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelforge.llm.common import Scratch, column, materialize, words

#: Rows that a range of the shuffle key has on average.
RANGE_ROWS = 1024


def ranked(values: DataFrame, value: str, name: str) -> DataFrame:
    """values (one row each) with rank (long, from 0) by code point, null last: ranked within sorted ranges, then by the ranges' counts."""
    order = [F.col(value).isNull(), F.col(value)]
    parts = materialize(values.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, not for each value
    starts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.join(starts, "_part").withColumn("rank", within + F.col("_first")).drop("_part", "_first")


def cut_time(servings: DataFrame, budget: float) -> float:
    """The virtual time at which the servings (upto, size, weight), in the order of their finish times, have used the budget; infinite if they don't.

    upto is what the serving's source has been served when it ends, so it runs from (upto - size) / weight to upto / weight.
    By a time t the servings that have ended are served whole, and those under way up to t * weight. Beginnings and ends are
    sorted by ranges; the range in which the budget is used up is found from the ranges' sums, and only its rows are looked at
    one by one.
    """
    start, zero = F.col("upto") - F.col("size"), F.lit(0.0)
    number = lambda x: x.cast("double")
    begins = F.struct((start / F.col("weight")).alias("at"), zero.alias("whole"), F.col("weight").alias("active"), number(start).alias("from"))
    ends = F.struct((F.col("upto") / F.col("weight")).alias("at"), number(F.col("size")).alias("whole"), (-F.col("weight")).alias("active"), number(-start).alias("from"))
    events = servings.where("size > 0").select(F.inline(F.array(begins, ends)))
    parts = materialize(events.repartitionByRange("at").withColumn("_part", F.spark_partition_id()), "order")
    names = ("whole", "active", "from")

    def along(rows: DataFrame, *order: str, by: tuple[str, ...] = (), known: dict[str, float] | None = None) -> DataFrame:
        """rows with the running sums and what is served at each row's time, and a struct of the sums before it."""
        w = Window.partitionBy(*by).orderBy(*order)
        sums = [{x: F.lit((known or {}).get(x, 0.0)) + F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, k)), zero) for x in names} for k in (0, -1)]
        served = sums[0]["whole"] + F.col("at") * sums[0]["active"] - sums[0]["from"]
        return rows.select("_part", "at", F.row_number().over(w).alias("_k"), served.alias("served"), F.struct("_part", *(v.alias(x) for x, v in sums[1].items())).alias("before"))

    by_part = parts.groupBy("_part").agg(F.max("at").alias("at"), *(F.sum(x).alias(x) for x in names))
    first = along(by_part, "_part").where(F.col("served") >= budget).agg(F.min_by("before", "_part")).first()[0]  # a row for each range
    if first is None:
        return math.inf
    rows = along(parts.where(F.col("_part") == first["_part"]), "at", "active", by=("_part",), known=first.asDict())
    hit = rows.where(F.col("served") >= budget).agg(F.min_by(F.struct("before", "at"), "_k")).first()[0]
    known = hit["before"]
    return min((budget - known["whole"] + known["from"]) / known["active"], hit["at"]) if known["active"] > 0 else hit["at"]


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    budget_share: float = 1.5,
    passes: int = 2,
    source: str = "source",
    size: Column | None = None,
    seed: int = 17,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of docs in the order of the mix: doc_id, source, size, source_size, target, taken, finish, rounds, and of docs the columns in carry.

    Sources in code point order, null last, weigh as weights says, repeating. Together they get budget_share times all
    sizes (at most passes times); no source more than passes times its size, and what it can't use goes to the others by weight.
    taken (long) is how many words the mix takes, over all passes; finish is the virtual finish time of the first pass; rounds
    says how many passes take the document whole; a column of these that has the name of a carried one is called mix_ and its name; target is what the source has been served at the cut. size: a long column,
    by default the number of words. A null text has size 0, is taken 0 times and keeps its row; so do rows with null ids, and
    repeated rows count each. Rows of one id are served in the order of their texts' codes, so reruns agree on which text is taken. An empty table gives an empty result; other columns, whatever their names, aren't read.
    """
    row = [F.struct(*(column(x) for x in carry)).alias("_row")] if carry else []
    size = F.size(words(F.col("text"))).cast("long") if size is None else size
    sized = docs.select("doc_id", column(source).alias("_source"), size.alias("size"), *([F.xxhash64("text").alias("_text")] if "text" in docs.columns else [F.lit(0).cast("long").alias("_text")]), *row)
    # 60 bits of a digest that other engines have, too; rows without an id are told apart by their texts
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.col("_text").cast("string")), F.col("size").cast("string"))
    key = F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.write(sized.select("doc_id", "_source", "size", "_text", key.alias("_key"), *(["_row"] if carry else [])), "sized")

    sources = sized.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    sources = ranked(sources, "_source", "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = materialize(sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(passes))), "sources")
    totals = sources.agg(F.sum("source_size").alias("size"), F.sum("_rows").alias("rows")).first()

    # running sums: by range of the key within the source, then within the range
    bits = max(0, math.ceil(math.log2(max(1, (totals["rows"] or 0) / RANGE_ROWS))))
    sized = sized.withColumn("_range", F.shiftright("_key", 60 - bits))
    sized = sized.withColumn("_null", F.col("_source").isNull()).withColumn("_name", F.coalesce("_source", F.lit("")))
    keys = ["_null", "_name", "_range"]
    before = Window.partitionBy("_null", "_name").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sized.groupBy(*keys).agg(F.sum("size").alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0).cast("long")))
    shares = sources.select(F.col("_source").isNull().alias("_null"), F.coalesce("_source", F.lit("")).alias("_name"), "source_size", "weight", "cap")
    ranges = ranges.join(shares, ["_null", "_name"]).drop("_sum")
    upto = Window.partitionBy(*keys).orderBy("_key", "doc_id", "size", "_text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queue = sized.join(ranges, keys).withColumn("_end", F.col("_start") + F.sum("size").over(upto))
    queue = scratch.write(queue.drop("_null", "_name", "_range", "_start", "_key"), "queue")
    scratch.drop("sized")

    turns = queue.select("weight", "size", F.explode(F.array(*[F.col("_end") + k * F.col("source_size") for k in range(passes)])).alias("upto"))
    cut = cut_time(turns, min(budget_share, passes) * (totals["size"] or 0))
    target = F.least("cap", F.lit(cut) * F.col("weight"))
    quota = F.round(target).cast("long")
    served = F.lit(0).cast("long")
    for k in range(passes):
        start = F.col("_end") - F.col("size") + k * F.col("source_size")
        served = served + F.least(F.greatest(quota - start, F.lit(0).cast("long")), F.col("size"))
    out = queue.withColumns({"finish": F.col("_end") / F.col("weight"), "taken": served, "target": target})
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    own = {"doc_id": F.col("doc_id"), source: F.col("_source"), **{x: F.col(x) for x in ("size", "source_size", "target", "taken", "finish")}, "rounds": whole}
    # the order is set first: what is shown may have any names
    ordered = out.orderBy("finish", "doc_id", "_text")
    return ordered.select(*(v.alias(f"mix_{x}" if x in carry else x) for x, v in own.items()), *(F.col("_row").getField(x).alias(x) for x in carry))
