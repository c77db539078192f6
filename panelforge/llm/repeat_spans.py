"""Removal of long strings that stand more than once in a corpus.

A place is repeated if the string of min_bytes bytes from there on also starts elsewhere, in the same text or another. Every
such string has one anchor, the place in it whose short byte string has the smallest code; equal strings have equal anchors,
so only texts' parts around anchors with equal codes have to meet. The strings that share an anchor are neighbours and form
one context; equal contexts meet by their code alone and are repeated as a whole. What is left are contexts that share an
anchor but differ: anchors are dealt to small shards, and in a shard the Burrows-Wheeler transform of its contexts is
searched breadth-first. Extending strings backwards yields the common prefixes of neighbouring suffixes by increasing
length; the search ends at min_bytes, and the suffixes whose common prefix it has not reached by then are the repeated ones.
Anchors with very many different contexts are not sharded: for these the strings themselves meet by their codes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import Scratch
from panelforge.llm.shingles import BASE, BYTE_CODE, U, mixed, powers

MIN_BYTES, ANCHOR_BYTES = 200, 40
#: An anchor with more different contexts than this has its strings compared one by one instead of in a shard.
SHARD_CONTEXTS = 1000
SHARD_BYTES = 1 << 18
SEGMENT_BYTES = 1 << 20


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


class Runs:
    """The contexts of some texts: text number, start, strings (neighbours with one anchor), anchor code, context code."""

    def __init__(self, texts: list[bytes], width: int, anchor: int):
        found = [self._of(part, width, anchor) for part in self._parts(texts, width)]
        self.text, self.start, self.strings, self.anchor, self.context = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, t) for t in (int, int, int, U, U))

    @staticmethod
    def _parts(texts: list[bytes], width: int) -> Iterator[list[tuple[int, int, bytes]]]:
        """(text number, start, bytes), some at a time; a long text is cut into segments that overlap by width - 1 bytes."""
        part, size = [], 0
        for k, t in enumerate(texts):
            for at in range(0, len(t) - width + 1, SEGMENT_BYTES):
                piece = t[at : at + SEGMENT_BYTES + width - 1]
                part.append((k, at, piece))
                size += len(piece)
                if size >= SEGMENT_BYTES:
                    yield part
                    part, size = [], 0
        if part:
            yield part

    @staticmethod
    def _of(part: list[tuple[int, int, bytes]], width: int, anchor: int) -> tuple[np.ndarray, ...]:
        sizes = np.array([len(x[2]) for x in part], np.int64)
        first = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(x[2] for x in part), np.uint8)
        n = len(data)
        sums = np.zeros(n + 1, U)
        np.cumsum(BYTE_CODE[data] * powers(BASE, n), out=sums[1:])
        back = powers(U(pow(int(BASE), -1, 2**64)), n)
        codes = mixed((sums[anchor:] - sums[:-anchor]) * back[: n - anchor + 1])
        low = (codes & ~U((1 << 24) - 1)) | np.arange(len(codes), dtype=U)  # the smallest, and of equals the first
        reach, want = 1, width - anchor + 1
        while reach * 2 <= want:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < want:
            low = np.minimum(low[: len(low) - (want - reach)], low[want - reach :])
        chosen = (low & U((1 << 24) - 1)).astype(np.int64)  # by place: the anchor of the string from there on
        new = np.ones(len(chosen), bool)
        new[1:] = chosen[1:] != chosen[:-1]
        inside = np.zeros(len(chosen) + 1, np.int64)  # strings must not cross texts
        np.add.at(inside, first, 1)
        np.add.at(inside, np.minimum(first + sizes - width + 1, len(chosen)), -1)
        inside = np.cumsum(inside)[:-1] > 0
        new[1:] |= inside[1:] != inside[:-1]
        new[first] = True
        starts = np.flatnonzero(new)
        ends = np.concatenate([starts[1:], [len(chosen)]])
        starts, ends = starts[inside[starts]], ends[inside[starts]]
        of = np.searchsorted(first, starts, side="right") - 1
        context = mixed((sums[ends + width - 1] - sums[starts]) * back[starts] + (ends - starts).astype(U))
        at = np.array([x[1] for x in part], np.int64)
        return np.array([x[0] for x in part])[of], starts - first[of] + at[of], ends - starts, codes[chosen[starts]], context


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """The places of codes (small integers) in the order of the depth codes from there on, or of more."""
    n = len(codes)
    bits = max(1, int(codes.max()).bit_length())
    reach = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([codes.astype(np.int64), np.zeros(reach, np.int64)])
    for k in range(reach):
        key = (key << bits) | padded[k : k + n]
    while True:
        order = np.argsort(key)
        ranked = key[order]
        step = np.ones(n, np.int64)
        step[1:] = ranked[1:] != ranked[:-1]
        ranks = np.cumsum(step)
        if reach >= depth or ranks[-1] == n:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = ranks
        key = rank << 32
        key[: n - reach] |= rank[reach:]
        reach *= 2


def common_prefixes_below(codes: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place in the suffix order whether its suffix shares fewer than depth codes with the one before it.

    Strings are extended backwards on the Burrows-Wheeler transform, level by level; code 0 separates and is never extended
    with. An interval whose right end is new at level l bounds a common prefix of l codes there.
    """
    n = len(codes)
    last = codes[order - 1]
    by_code = np.argsort(last, kind="stable")
    moved = np.empty(n, np.int64)  # where the suffix that begins one code earlier stands
    moved[by_code] = np.arange(n)
    same = last[by_code][1:] == last[by_code][:-1]
    after, before = np.full(n, n, np.int64), np.full(n, -1, np.int64)  # the next and previous place with the same code
    after[by_code[:-1][same]] = by_code[1:][same]
    before[by_code[1:][same]] = by_code[:-1][same]
    reached = np.zeros(n + 1, bool)
    reached[[0, n]] = True
    left, right = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    for _ in range(depth):
        if not len(left):
            break
        size = right - left + 1
        of = np.repeat(np.arange(len(left)), size)
        at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + left[of]
        real = last[at] != 0
        of, at = of[real], at[real]
        # an interval's last place with a code ends the extended interval, its first one begins it; all are disjoint
        ends = np.sort(moved[at[after[at] > right[of]]])
        begins = np.sort(moved[at[before[at] < left[of]]])
        new = ~reached[ends + 1]
        left, right = begins[new], ends[new]
        reached[right + 1] = True
    return reached[:n]


def repeated_in(contexts: list[bytes], width: int) -> list[np.ndarray]:
    """For each context the starts of its strings of width bytes that also start elsewhere in the contexts."""
    size = np.array([len(c) + 1 for c in contexts], np.int64)
    raw = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    present, codes = np.unique(raw, return_inverse=True)
    codes = codes + 1
    ends = np.cumsum(size) - 1
    codes[ends] = 0
    order = suffix_order(codes, width)
    new = common_prefixes_below(codes, order, width)
    rest = np.repeat(ends, size) - np.arange(len(codes))  # bytes up to the context's end
    fit = rest[order] >= width
    again = np.zeros(len(codes) + 1, bool)
    again[:-1] = ~new & fit
    again[:-1][1:] &= fit[:-1]
    twice = order[again[:-1] | again[1:]]
    marks = np.zeros(len(codes), bool)
    marks[twice] = True
    first = ends - size + 1
    return [np.flatnonzero(marks[a:b]) for a, b in zip(first, ends, strict=True)]


def _runs_of(places: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbouring places as (first, one past the last)."""
    if len(places):
        cuts = np.flatnonzero(np.diff(places) > 1)
        yield from zip(places[np.concatenate([[0], cuts + 1])].tolist(), (places[np.concatenate([cuts, [len(places) - 1]])] + 1).tolist(), strict=True)


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, t1, t2, data): two codes of the text and its UTF-8 bytes."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select("doc_id", F.xxhash64(data).alias("t1"), F.xxhash64(F.lit("2"), data).alias("t2"), data.alias("data"))


def with_places(keyed: DataFrame, places: DataFrame, names: list[str], make, schema: str) -> DataFrame:  # noqa: ANN001
    """make(ids, t1, t2, data, places of the text as arrays) for every row of keyed; places (t1, t2, *names) are joined as a list for each text."""
    lists = places.groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("_places"))

    def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(4).flatten().flatten()
            ends = np.cumsum(batch.column(4).value_lengths().fill_null(0).to_numpy())
            own = [[x.to_numpy()[a:b] for x in flat] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield make(*(batch.column(k) for k in range(4)), own)

    return keyed.join(lists, ["t1", "t2"], "left").select(*keyed.columns, "_places").mapInArrow(by_row, schema)


def shared_runs(keyed: DataFrame, width: int, anchor: int, scratch: Scratch) -> DataFrame:
    """(anchor, context, strings, t1, t2, start) for all contexts whose anchor's code stands at two places or more."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = batch.column(1), batch.column(2)
            r = Runs(batch.column(3).to_pylist(), width, anchor)
            of = pa.array(r.text)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(r.anchor)), pa.array(_signed(r.context)), pa.array(r.strings), t1.take(of), t2.take(of), pa.array(r.start)], ["anchor", "context", "strings", "t1", "t2", "start"])

    every = scratch.write(keyed.mapInArrow(made, "anchor long, context long, strings long, t1 long, t2 long, start long"), "every")
    place = F.xxhash64("t1", "t2", "start")
    shared = every.select("anchor", place.alias("p")).groupBy("anchor").agg(F.min("p").alias("a"), F.max("p").alias("b")).where("a < b").select("anchor")
    shared = scratch.write(shared, "shared")  # with nothing but a scan on that side, a very common anchor is split
    out = scratch.write(every.join(shared, "anchor", "left_semi"), "runs")
    scratch.drop("every", "shared")
    return out


def repeated_spans(docs: DataFrame, text: str = "text", min_bytes: int = MIN_BYTES, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """(t1, t2, low, high): by text, identified by two codes, the parts that are covered by repeated strings; not merged."""
    return _spans(_keyed(docs, text), min_bytes, anchor_bytes, Scratch(docs.sparkSession, "repeats"))


def _spans(keyed: DataFrame, width: int, anchor: int, scratch: Scratch) -> DataFrame:
    runs = shared_runs(keyed, width, anchor, scratch)
    place = F.xxhash64("t1", "t2", "start")
    contexts = runs.groupBy("anchor", "context", "strings").agg(F.min(place).alias("_a"), F.max(place).alias("_b"), F.min(F.struct("t1", "t2", "start")).alias("_at"))
    contexts = scratch.write(contexts, "contexts")
    whole = contexts.where("_a < _b").select("anchor", "context", "strings", F.lit(0).cast("long").alias("low"), F.col("strings").alias("high"))

    # anchors with different contexts
    counts = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    mixed_up = contexts.join(counts, "anchor").select("anchor", "context", "strings", "_at.t1", "_at.t2", "_at.start", "_n")
    mixed_up = scratch.write(mixed_up, "mixed")
    columns = ["start", "strings", "anchor", "context", "_n"]

    def cut(ids, t1, t2, data, places):  # noqa: ANN001, ANN202
        out: dict[str, list] = {"anchor": [], "context": [], "strings": [], "_n": [], "data": []}
        seen: set[tuple[int, int]] = set()
        for a, b, d, (start, strings, anchors, context, n) in zip(t1.to_pylist(), t2.to_pylist(), data, places, strict=True):
            if not len(start) or (a, b) in seen:
                continue
            seen.add((a, b))  # of copies in a batch one is enough
            d = d.as_py()
            out["data"] += [d[s : s + k + width - 1] for s, k in zip(start.tolist(), strings.tolist(), strict=True)]
            for name, x in (("anchor", anchors), ("context", context), ("strings", strings), ("_n", n)):
                out[name] += x.tolist()
        kinds = [pa.int64()] * 4 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    pieces = with_places(keyed, mixed_up, columns, cut, "anchor long, context long, strings long, _n long, data binary")
    pieces = scratch.write(pieces.dropDuplicates(["anchor", "context", "strings"]), "pieces")
    scratch.drop("mixed")
    few = pieces.where(F.col("_n") <= SHARD_CONTEXTS)
    shards = -(-(few.agg(F.sum(F.length("data"))).first()[0] or 0) // SHARD_BYTES) or 1

    def searched(table: pa.Table) -> pa.Table:
        found = repeated_in(table.column("data").to_pylist(), width)
        rows = [(k, a, b) for k, at in enumerate(found) for a, b in _runs_of(at)]
        of = pa.array([r[0] for r in rows], pa.int64())
        out = table.select(["anchor", "context", "strings"]).take(of)
        return out.append_column("low", pa.array([r[1] for r in rows], pa.int64())).append_column("high", pa.array([r[2] for r in rows], pa.int64()))

    spans = "anchor long, context long, strings long, low long, high long"
    inner = few.withColumn("_shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("_shard").applyInArrow(searched, spans)

    # very common anchors: the strings themselves
    many = pieces.where(F.col("_n") > SHARD_CONTEXTS).select("anchor", "context", "strings", "data", F.explode(F.sequence(F.lit(0).cast("long"), F.col("strings") - 1)).alias("low"))
    string = F.substring("data", (F.col("low") + 1).cast("int"), F.lit(width))
    many = many.select("anchor", "context", "strings", "low", F.xxhash64(string).alias("s1"), F.xxhash64(F.lit("2"), string).alias("s2"))
    twice = many.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("s1", "s2")
    single = many.join(twice, ["s1", "s2"], "left_semi").select("anchor", "context", "strings", "low", (F.col("low") + 1).alias("high"))

    keys = ["anchor", "context", "strings"]
    rows = runs.join(whole.unionByName(inner).unionByName(single), keys)
    return rows.select("t1", "t2", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high") - 1 + width).alias("high"))


def _merged(spans: DataFrame) -> DataFrame:
    """Spans of each text that touch or overlap, joined."""
    end = "max(high) over (partition by t1, t2 order by low, high rows between unbounded preceding and 1 preceding)"
    flagged = spans.withColumn("_end", F.expr(end)).withColumn("_new", (F.col("_end").isNull() | (F.col("low") > F.col("_end"))).cast("long"))
    flagged = flagged.withColumn("_run", F.expr("sum(_new) over (partition by t1, t2 order by low, high rows between unbounded preceding and current row)"))
    return flagged.groupBy("t1", "t2", "_run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_run")


def strip_repeats(docs: DataFrame, text: str = "text", min_bytes: int = MIN_BYTES, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    Texts are their UTF-8 bytes, null an empty one. kept (binary) is what remains when all bytes covered by repeated strings
    go. A text that stands in two rows or more goes whole if it has min_bytes bytes. A very long text is gone through by
    overlapping segments, in one task. Null ids and repeated rows are rows like
    others, an empty table gives an empty result, other columns aren't read.
    """
    if not 8 <= anchor_bytes <= min_bytes:
        raise ValueError("an anchor has at least 8 bytes and at most min_bytes")
    keyed = _keyed(docs, text)
    copies = keyed.where(F.length("data") >= min_bytes).groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("_n"), F.first(F.length("data").cast("long")).alias("high"))
    copies = copies.where("_n > 1").select("t1", "t2", F.lit(0).cast("long").alias("low"), "high")
    scratch = Scratch(docs.sparkSession, "repeats")
    places = scratch.write(_merged(_spans(keyed, min_bytes, anchor_bytes, scratch).unionByName(copies)), "spans")
    scratch.drop("runs", "contexts", "pieces")

    def cut(ids, t1, t2, data, own):  # noqa: ANN001, ANN202
        rows = []
        for d, (low, high) in zip(data, own, strict=True):
            d = d.as_py()
            ends = [0, *high.tolist()]
            kept = b"".join(d[a:b] for a, b in zip(ends, [*low.tolist(), len(d)], strict=True)) if len(low) else d
            rows.append((len(d), len(d) - len(kept), len(low), sha256(kept).hexdigest(), kept))
        kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_places(keyed, places, ["low", "high"], cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
