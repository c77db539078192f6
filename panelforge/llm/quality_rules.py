"""Quality rules with verdicts per host.

Rules judge each document by counts taken from its whole text. Failures are then summed by host, each host's failure
rate is shrunk towards the rate of all hosts by a beta prior that is fitted to the hosts themselves, and a host whose
shrunk rate is above a limit takes all its documents with it. All of it is native expressions: the counts are array
functions within the row, and the only shuffle is the partial aggregation by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import chars_outside, materialize, word_chars, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _covered(starts: Column, width: int) -> Column:
    """How many places the windows of the given width at these sorted starts cover together."""
    steps = F.transform(starts, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(starts, i + 1) - x, F.lit(width))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long) to docs.

    A null text counts as an empty one: all counts 0. The text column stays.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    filled = F.filter(F.split(body, "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    own = {"_words": words(F.col(text)), "_lines": filled}
    df = docs.withColumns(own).withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": word_chars(body),
            "n_symbols": F.length(body).cast("long") - chars_outside(body, SYMBOLS),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hashes": F.when(
                F.size("_words") > WINDOW,
                F.transform(F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("_words"), i, WINDOW))),
            ),
        }
    )
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    df = df.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = F.filter(
        "_sorted",
        lambda x, i: F.coalesce((i > 0) & (F.get("_sorted", i - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get("_sorted", i + 1)["h"] == x["h"], F.lit(False)),
    )
    df = df.withColumn("_starts", F.sort_array(F.transform(again, lambda x: x["i"])))
    df = df.withColumn("n_repeat_words", F.coalesce(_covered(F.col("_starts"), WINDOW), F.lit(0).cast("long")))
    return df.drop(*own, "_hashes", "_sorted", "_starts")


def base_failed(min_words: int = 20, max_repeat_percent: int = 30) -> Column:
    """Whether a document fails by itself: it is short, or too many of its words stand in repeated windows."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def host_rates(judged: DataFrame, host: str, failed: str) -> DataFrame:
    """(host, n_docs, n_failed, rate, shrunk_rate) with a beta prior fitted to all hosts by moments.

    Null hosts form one group. Where hosts differ no more than chance has them differ, the prior is strong and all hosts
    get the overall rate.
    """
    hosts = judged.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    hosts = materialize(hosts.withColumn("rate", F.col("n_failed") / F.col("n_docs")), "hosts")
    fit = hosts.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum("n_docs").alias("docs"),
        F.sum("n_failed").alias("failed"),
        F.sum(F.col("n_docs") * F.col("rate") * F.col("rate")).alias("squares"),
        F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("sizes"),
    ).first()
    docs, mean, strength = fit["docs"] or 0, 0.0, 1.0
    if docs:
        mean = fit["failed"] / docs
        within = mean * (1 - mean)
        spread = fit["squares"] - docs * mean * mean - (fit["hosts"] - 1) * within
        room = docs - fit["sizes"] / docs - (fit["hosts"] - 1)
        between = spread / room if room > 0 else 0.0
        strength = min(max(within / between - 1, 1.0), 1e6) if between > 0 else 1e6 if within > 0 else 1.0
    return hosts.withColumn("shrunk_rate", (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength)))


def judge_by_host(docs: DataFrame, host: str = "source", text: str = "text", min_words: int = 20, max_repeat_percent: int = 30, max_host_rate: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, the host, the counts, base_failed, host_rate and kept.

    kept is false for documents that fail by themselves and for all documents of a host whose shrunk failure rate is
    above max_host_rate. Null hosts are judged together as one host; null doc_ids and repeated rows stay as they are; an
    empty table gives an empty result. Very long texts are counted whole, within their row. Other columns of docs are not read.
    """
    counted = text_counts(docs.select("doc_id", F.col(host).alias("_host"), F.col(text).alias("_text")), "_text").drop("_text")
    judged = materialize(counted.withColumn("base_failed", base_failed(min_words, max_repeat_percent)), "judged")
    hosts = host_rates(judged, "_host", "base_failed")
    bad = hosts.where(F.col("shrunk_rate") > max_host_rate).select(F.col("_host").alias("_bad"), F.col("shrunk_rate"))
    out = judged.join(bad, judged["_host"].eqNullSafe(bad["_bad"]), "left")
    return out.select(
        "doc_id", F.col("_host").alias(host), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("shrunk_rate").isNull()).alias("kept")
    )
