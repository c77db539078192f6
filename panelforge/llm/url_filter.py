"""URL filters by a trie over reversed host labels and path segments."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from panelforge.llm.common import Scratch, column

URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: The production rules, (host and path, verdict).
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and where there is no ://."""
    m = URL.search(url or "")
    return (m[1].translate(UPPER), m[2]) if m else ("", "")


def build_trie(rules: Iterable[tuple[str, str]]) -> dict:
    """A trie of dictionaries: host labels from the last to the first, then under "/" the path's segments.

    A rule is a host, then maybe a path from its first slash on. A node holds under "" the (unfinished last segment, rule,
    verdict) of the rules that end there, longest first. Of a rule given twice the last counts.
    """
    trie: dict = {}
    for rule, verdict in dict(rules).items():
        host, slash, path = rule.partition("/")
        node, rest = trie, ""
        for label in reversed(host.split(".")) if host else []:
            node = node.setdefault(("host", label), {})
        if slash:
            node = node.setdefault("/", {})
            *segments, rest = path.split("/")
            for segment in segments:
                node = node.setdefault(("path", segment), {})
        node[""] = sorted([*node.get("", []), (rest, rule, verdict)], key=lambda x: -len(x[0]))
    return trie


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The (rule, verdict) with the most host labels, and of these with the longest path, that fits; None if none does."""
    hosts = [trie]
    for label in reversed(host.split(".")) if host else []:
        if ("host", label) not in hosts[-1]:
            break
        hosts.append(hosts[-1]["host", label])
    segments = path[1:].split("/")
    for node in reversed(hosts):
        best = node.get("", [None])[0]
        node = node.get("/") if path else None
        for segment in segments:
            if node is None:
                break
            best = next((x for x in node.get("", ()) if segment.startswith(x[0])), best)
            node = node.get(("path", segment))
        if best:
            return best[1], best[2]
    return None


def precedence(rule: str | None) -> tuple[int, int]:
    """Of two rules that fit a url the one with the larger precedence counts; None has the least."""
    host = (rule or "").partition("/")[0]
    return (-1, 0) if rule is None else (host.count(".") + 1 if host else 0, len(rule))


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, default: str = "allow", url: str = "url", max_rules: int = 2_000_000) -> DataFrame:
    """pages with host, path, rule and verdict; rule is null and verdict default where no rule fits.

    Columns of pages that have one of these names are replaced. A null url, and one without ://, has an empty host and path,
    which only a rule without host and path fits. Every row keeps its row, repeated ones too; very long urls are judged whole; an
    empty table gives an empty one. Rules go in blocks of max_rules, one after the other, so that no more are broadcast at once;
    between blocks the table is written, with the best rule so far.
    """
    names = [x for x in pages.columns if x not in ("host", "path", "rule", "verdict")]
    known, at = list(dict(rules).items()), names.index(url)
    out = pages.select(*map(column, names)).toDF(*(f"_c{k}" for k in range(len(names))))  # whatever they are called
    schema = StructType([*out.schema.fields, *(StructField(x, StringType()) for x in ("host", "path", "rule", "verdict"))])
    scratch = Scratch(pages.sparkSession, "urls") if len(known) > max_rules else None

    def step(rows: DataFrame, trie: Broadcast, first: bool) -> DataFrame:
        def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                split = [split_url(x) for x in batch.column(at).to_pylist()]
                found = [longest_match(trie.value, *x) or (None, default) for x in split]
                if not first:
                    before = zip(*(batch.column(len(names) + k).to_pylist() for k in (2, 3)), strict=True)
                    found = [max(x, y, key=lambda r: precedence(r[0])) for x, y in zip(before, found, strict=True)]
                more = [*zip(*split, strict=True), *zip(*found, strict=True)] if split else [()] * 4
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(x, pa.string()) for x in more)], schema.names)

        return rows.mapInArrow(judged, schema)

    trie = None
    for k in range(0, max(1, len(known)), max_rules):
        if k:
            out = scratch.write(out, "judged")
            scratch.drop("judged", last=1)
            trie.unpersist()
        trie = pages.sparkSession.sparkContext.broadcast(build_trie(known[k : k + max_rules]))
        out = step(out, trie, first=k == 0)
    return out.toDF(*names, "host", "path", "rule", "verdict")
