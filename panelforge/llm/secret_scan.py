"""Secret scans with a ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content. A blob is scanned once for each version of the
rules, however many paths hold it: what the ledger already has is left out, and findings are joined back to all paths.
The ledger is a table in the shared folder that every scan adds to. Scanning is native: split() and regexp_extract_all() cut a text at the same matches, so the lengths of the pieces and of
the matches, summed up, give each match's place.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import column, exists, materialize, shared_folder


@dataclass(frozen=True)
class Rule:
    """kind names the finding; of the pattern's matches those stay whose group has at least least characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds, in the order in which they are listed, and two kinds of our own.
RULES = (
    Rule("assign", "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    Rule("hook", "https://[A-Za-z0-9.-]{1,200}/services/T[A-Z0-9]{6,}/B[A-Z0-9]{6,}/[A-Za-z0-9]{16,}", 0, 1),
)
RULE_VERSION = 1


def blob_id(text: Column) -> Column:
    """The content address of a text; a null text has that of an empty one."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kind, rank, start, end) for all matches in blobs (blob, text); places in code points, end exclusive.

    Matches of a kind are the leftmost non-overlapping ones; those that are too short are dropped after matching. Blobs
    are taken to be distinct; empty texts have no findings.
    """
    any_rule = F.lit(False)
    for r in rules:
        any_rule = any_rule | F.col("text").rlike(r.pattern)
    cut = []
    for rank, r in enumerate(rules):
        found = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))
        inner = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)) if r.group else found
        between = F.transform(F.split("text", r.pattern, -1), F.length)
        parts = F.arrays_zip(between.alias("before"), found.alias("value"), F.transform(inner, F.length).alias("weight"))
        cut.append(F.struct(F.lit(r.kind).alias("kind"), F.lit(rank).alias("rank"), F.lit(r.least).alias("least"), F.when(F.col("text").rlike(r.pattern), parts).alias("parts")))
    rows = blobs.where(any_rule).select("blob", F.explode(F.array(*cut)).alias("k")).select("blob", "k.kind", "k.rank", "k.least", F.posexplode("k.parts").alias("i", "p"))
    rows = rows.where("p.value is not null").select("blob", "kind", "rank", "least", "i", "p.before", "p.value", "p.weight")
    # the rows of one blob only, so a window is as long as a text has matches
    until = "sum(before + length(value)) over (partition by blob, rank order by i rows between unbounded preceding and current row)"
    rows = rows.withColumn("end", F.expr(until)).withColumn("start", F.col("end") - F.length("value"))
    return rows.where("weight >= least").select("blob", "kind", "rank", F.col("start").cast("long"), F.col("end").cast("long"))


FINDINGS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


class Ledger:
    """Blobs that were scanned, by rule version: a table (blob, findings) for each version under a path, by default a new one in the shared folder.

    findings are (start, rank, end, kind), by start, then rank; empty where the blob has none: places only, the secrets
    themselves aren't stored. Every scan adds its files; a blob that two scans at once have found new stands there twice,
    with the same findings, and is read once.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"

    def _of(self, rule_version: int) -> str:
        return f"{self.path}/rule_version={rule_version}"

    def read(self, rule_version: int) -> DataFrame:
        """(blob, findings), a row for each blob that was scanned under the rule version; other versions' files aren't read."""
        schema = f"blob string, findings {FINDINGS}"
        if not exists(self.spark, self._of(rule_version)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._of(rule_version)).dropDuplicates(["blob"])

    def add(self, scanned: DataFrame, rule_version: int) -> None:
        scanned.select("blob", "findings").write.mode("append").parquet(self._of(rule_version))


def new_blobs(versions: DataFrame, ledger: Ledger, rule_version: int = RULE_VERSION) -> DataFrame:
    """(blob, text), once for each content of versions (blob, text, ...) that the ledger hasn't seen under the rule version."""
    fresh = versions.join(ledger.read(rule_version).select("blob"), "blob", "left_anti")
    # first() combines on the map side: a blob held by a third of all paths leaves each task once
    return fresh.groupBy("blob").agg(F.first("text").alias("text"))


def scan_versions(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, rule_version: int = RULE_VERSION) -> DataFrame:
    """Scans the contents in versions (blob, text, ...) that the ledger lacks and adds them to it; returns what it then has of findings, (blob, findings) where there are any."""
    fresh = new_blobs(versions, ledger, rule_version)
    entry = F.struct("start", F.col("rank").cast("int").alias("rank"), "end", "kind")
    found = scan_blobs(fresh, rules).groupBy("blob").agg(F.sort_array(F.collect_list(entry)).alias("findings"))
    found = materialize(found, "findings")
    new = versions.select("blob").join(ledger.read(rule_version).select("blob"), "blob", "left_anti").distinct()
    ledger.add(new.join(found, "blob", "left").select("blob", F.coalesce("findings", F.expr(f"cast(array() as {FINDINGS})")).alias("findings")), rule_version)
    return ledger.read(rule_version).where(F.size("findings") > 0)


def scan(docs: DataFrame, path: str = "doc_id", text: str = "text", ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES, rule_version: int = RULE_VERSION) -> DataFrame:
    """Scans all versions in docs that the ledger (by default an empty one) hasn't seen, and adds them to it: path, blob, and findings (start, rank, end, kind), empty where there are none, for each row of docs.

    Null texts are empty texts, very long ones are scanned whole. Rows with a null path and repeated rows keep a row each; an
    empty table gives an empty result; other columns aren't read.
    """
    versions = docs.select(column(path).alias("_path"), F.coalesce(column(text), F.lit("")).alias("text")).withColumn("blob", blob_id(F.col("text")))
    found = scan_versions(versions, ledger or Ledger(docs.sparkSession), rules, rule_version)
    by_path = versions.select("_path", "blob").join(found, "blob", "left")
    return by_path.select(F.col("_path").alias(path), "blob", F.coalesce("findings", F.expr(f"cast(array() as {FINDINGS})")).alias("findings"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", ledger: Ledger | None = None) -> DataFrame:
    """docs with every found span replaced by mark (spans that overlap by one), all other characters and columns as they were.

    Null texts stay null; rows with null ids and repeated rows are rows like others; columns may have any names; an empty
    table gives an empty one.
    """
    rows = docs.select(blob_id(column(text)).alias("blob"), column(text).alias("_text"), F.struct("*").alias("row"))  # so that no names clash
    found = scan_versions(rows.select("blob", F.coalesce("_text", F.lit("")).alias("text")), ledger or Ledger(docs.sparkSession))
    rows = rows.join(found, "blob", "left")
    cut = F.aggregate(
        "findings",
        F.struct(F.lit(0).cast("long").alias("upto"), F.lit("").alias("out")),
        lambda a, f: F.struct(
            F.greatest(a["upto"], f["end"]).alias("upto"),
            F.when(f["start"] >= a["upto"], F.concat(a["out"], F.substring(F.col("_text"), (a["upto"] + 1).cast("int"), (f["start"] - a["upto"]).cast("int")), F.lit(mark))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(F.col("_text"), (a["upto"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    clean = F.when(F.col("findings").isNull(), F.col("_text")).otherwise(cut)
    return rows.select(*(clean.alias(x) if x == text else F.col("row").getField(x).alias(x) for x in docs.columns))
