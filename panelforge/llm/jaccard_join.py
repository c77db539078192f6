"""N-gram Jaccard join by parity sketches.

A document is the set of its word shingles. Shingles are dealt to the words of a sketch by their code and XORed there, so a
shingle that only one of two sets has changes one sketch word at most: the number of words that differ (the sketches'
Hamming distance over words) bounds the sets' symmetric difference from below. Sets as similar as asked for differ by at
most d shingles, d given by their sizes. Sketches of one size band have the same number of words, more than d + 1, so of two
similar sets' words all but d agree; in any order of words that both keep, one of the first d + 1 must agree. Each set thus
lists its first words, those of most shingles first (they are the rarest), and sets that list a word in common are candidates.
Sets near a band's lower end are listed in the band below, too. A second sketch of single bits, about as many as the set has
shingles and again a lower bound, drops most false candidates, and the sets themselves decide on the rest.

Equal sets are one class from the start. Classes that share a word are not paired off: in every word's group all members
are paired with one of them, linked classes are merged, and only members of groups that are still of different components
go on. After some rounds these list their words anew, now in order of how many of them have a word, the rarest first:
words of a passage that many sets share fall out of the lists, while linked sets still meet. After some more rounds what is
left in a word's group is compared in full, so no link between components is lost.

That gives the components, and skips links within what hangs together already. All links lie within components, so a second
pass finds every one of them: each component's classes are dealt to blocks, every two blocks are compared in one tile by
sizes and sketches, and the sets decide. links() lists the pairs, linked() counts them by row; components() is the first
pass alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import BLANK, Scratch, column, materialize
from panelforge.llm.shingles import U, mixed, shingle_codes

#: Bits of the smallest bit sketch.
LEAST_BITS = 256
#: Rounds in which a word's members are paired with one of them, before words are listed anew and after.
STAR_ROUNDS = 2
#: Into how many parts words are dealt that choose their hubs apart.
HUBS = 8
#: Classes, and shingles of all their sets, in a block of a component whose links are sought.
TILE_ROWS, TILE_CODES = 1000, 1_000_000
BATCH_BYTES = 1 << 20
#: Shingles of sets whose words are made at a time.
CELL_CODES = 1 << 18


@dataclass(frozen=True)
class Rule:
    """Shingles of width words; sets are linked if 100 * intersection >= percent * union."""

    width: int = 5
    percent: int = 80

    def most_apart(self, n: int, m: int) -> int:
        """The largest symmetric difference of linked sets of these sizes."""
        return (100 - self.percent) * (n + m) // (100 + self.percent)

    def schemes(self, n: int) -> list[tuple[int, int, int]]:
        """The (band, words in the band's sketches, words to list) for a set of n shingles: its own band's and maybe the one's below."""
        band = n.bit_length() - 1
        out = []
        for b in (band, band - 1)[: 1 + (band > 0)] if n else ():
            top = (1 << (b + 1)) - 1
            largest = n * 100 // self.percent if b == band else top
            if largest * 100 < n * self.percent:
                continue
            d = self.most_apart(n, largest)
            if d:  # else only equal sets are linked
                out.append((b, max(top // 3, self.most_apart(top, top * 100 // self.percent)) + 1, d + 1))
        return out


def sketch_words(codes: np.ndarray, n: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of sets (codes, one set after the other, and how many each has) a row for each set and scheme: set, band, words to list, words with shingles, and the words.

    A word is a code of its band, its place and what is XORed there, under a first byte that tells how many shingles it has:
    0 for 255 and more, 254 for one, 255 for none. They are sorted, so those of most shingles are first; of those without
    shingles there are as many as the list lacks. Places are taken from the codes' high bits, so that sorted codes are in order of place.
    """
    plan = [(k, *scheme) for k, size in enumerate(n.tolist()) for scheme in rule.schemes(size)]
    if not plan:
        return *(np.zeros(0, np.int64) for _ in range(4)), []
    of, band, size, first = np.array(plan, np.int64).T
    many, low = n[of], np.cumsum(size) - size
    stops = np.cumsum(many)
    mine = codes[np.arange(stops[-1]) + np.repeat((np.cumsum(n) - n)[of] - (stops - many), many)]
    row = np.repeat(np.arange(len(of)), many)
    cell = low[row] + ((mine >> U(32)) * size[row].astype(U) >> U(32)).astype(np.int64)
    if (cell[1:] < cell[:-1]).any():
        order = np.argsort(cell, kind="stable")
        mine, row, cell = mine[order], row[order], cell[order]
    new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    xored = np.bitwise_xor.reduceat(mixed(mine + band[row].astype(U)), new)
    row, cell, weight = row[new], cell[new], np.diff(np.append(new, len(cell)))
    coded = lambda x, place, b: mixed(x ^ mixed(place.astype(U) * U(64) + b.astype(U))) >> U(8)
    words = coded(xored, cell - low[row], band[row]) | (U(255) - np.minimum(weight, 255).astype(U)) << U(56)
    filled = np.bincount(row, minlength=len(of))
    ends = np.cumsum(filled)
    lists = [words[a:b] for a, b in zip(ends - filled, ends, strict=True)]
    for x in lists:
        x.sort()
    for k in np.flatnonzero(filled < first):
        place = np.setdiff1d(np.arange(size[k]), cell[ends[k] - filled[k] : ends[k]] - low[k])
        empty = np.sort(coded(U(0), place, band[k]) | U(255) << U(56))
        lists[k] = np.concatenate([lists[k], empty[: first[k] - filled[k]]])
    return of, band, first, filled, lists


def listed_words(codes: np.ndarray, rule: Rule) -> np.ndarray:
    """The sketch words that a set lists: of each scheme the first ones, those of most shingles first, then by code; words without shingles are the last."""
    _, _, first, _, lists = sketch_words(codes, np.array([len(codes)]), rule)
    return np.concatenate([np.zeros(0, U), *(x[:k] for x, k in zip(lists, first, strict=True))])


def bit_sketch(codes: np.ndarray) -> np.ndarray:
    """Parities of the set's shingles as 64-bit words: as many bits as the band's top, 256 at least. A band's sketch folded in two is that of the band below."""
    bits = max(LEAST_BITS, 1 << len(codes).bit_length())
    return np.packbits((np.bincount((codes & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.uint64)


def _batches(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in UTF-8, some at a time, with the first one's number."""
    first, size, part = 0, 0, []
    for k, t in enumerate(texts):
        t = (t or "").encode("utf-8", "surrogatepass")
        if part and size + len(t) > BATCH_BYTES:
            yield first, part
            first, size, part = k, 0, []
        part.append(t)
        size += len(t)
    if part:
        yield first, part


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(arrays: list[np.ndarray], sizes: np.ndarray | list[int]) -> pa.Array:
    """Lists of these sizes, filled with the arrays one after the other."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(_signed(np.concatenate([np.zeros(0, U), *arrays]))))


def _sets(texts: list[str | None], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some texts at a time: their sets, one after the other, how many shingles each has, and the two codes of each set (0 for the empty one)."""
    for _, part in _batches(texts):
        codes, n = shingle_codes(part, width)
        ends = np.cumsum(n)
        some = np.flatnonzero(n)
        one, two = np.zeros(len(part), U), np.zeros(len(part), U)
        if len(some):
            one[some] = np.add.reduceat(mixed(codes ^ U(0x5851F42D4C957F2D)), (ends - n)[some])
            two[some] = np.add.reduceat(mixed(codes + U(0x14057B7EF767814F)), (ends - n)[some])
        yield codes, n, one, two


def signatures(docs: DataFrame, rule: Rule) -> DataFrame:
    """For each row of docs (doc_id, _t, _text): doc_id, _t, n (shingles), c1 and c2 (codes of the set), its bit sketch and listed words."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for codes, n, one, two in _sets(batch.column(2).to_pylist(), rule.width):
                ends = np.cumsum(n)
                sketches = [bit_sketch(codes[a:b]) for a, b in zip(ends - n, ends, strict=True)]
                of, _, first, _, words = sketch_words(codes, n, rule)
                words = [x[:k] for x, k in zip(words, first, strict=True)]
                sizes = np.bincount(of, weights=[len(x) for x in words], minlength=len(n)).astype(np.int64)
                columns = [*(batch.column(k).slice(done, len(n)) for k in (0, 1)), pa.array(n, pa.int64()), pa.array(_signed(one)), pa.array(_signed(two))]
                columns += [_lists(sketches, [len(x) for x in sketches]), _lists(words, sizes)]
                done += len(n)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_t", "n", "c1", "c2", "sketch", "words"])

    return docs.select("doc_id", "_t", "_text").mapInArrow(signed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _t long, n long, c1 long, c2 long, sketch array<long>, words array<long>")


def near_bound(a: str, b: str, rule: Rule) -> Column:
    """Whether two classes (n, sketch) can be linked by their sizes and bit sketches, the longer one folded to the shorter."""
    fold = "case when size({0}.sketch) > size({1}.sketch) then zip_with(slice({0}.sketch, 1, size({1}.sketch)), slice({0}.sketch, size({1}.sketch) + 1, size({1}.sketch)), (x, y) -> x ^ y) else {0}.sketch end"
    apart = f"aggregate(zip_with({fold.format(a, b)}, {fold.format(b, a)}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    small, large = f"least({a}.n, {b}.n)", f"greatest({a}.n, {b}.n)"
    return F.expr(f"case when 100 * {small} >= {rule.percent} * {large} then {100 + rule.percent} * ({apart}) <= {100 - rule.percent} * ({a}.n + {b}.n) else false end")


def linked_pairs(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Those of pairs (a, b: class ids) whose sets (cid, codes) are linked."""
    sets = sets.join(pairs.select(F.explode(F.array("a", "b")).alias("cid")), "cid", "left_semi")  # few, after the first rounds
    left = sets.select(F.col("cid").alias("a"), F.col("codes").alias("_a"))
    right = sets.select(F.col("cid").alias("b"), F.col("codes").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b")).cast("long")
    out = pairs.join(left, "a").join(right, "b")
    return out.where((100 + rule.percent) * both >= rule.percent * (F.size("_a") + F.size("_b"))).select("a", "b")


def merged(labels: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """labels (cid, label) with the components that edges (a, b) join under their smallest label, by rounds of smallest neighbours and jumps."""
    at = lambda name: labels.select(F.col("cid").alias(name), F.col("label").alias(f"_{name}"))
    links = edges.join(at("a"), "a").join(at("b"), "b").where("_a <> _b").select("_a", "_b")
    links = scratch.write(links.unionByName(links.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))).distinct(), "links")
    roots = scratch.write(links.groupBy("_a").agg(F.least(F.col("_a"), F.min("_b")).alias("root")), "roots")
    while True:
        name = lambda x, y: roots.select(F.col("_a").alias(x), F.col("root").alias(y))
        near = links.join(name("_b", "_r"), "_b").groupBy("_a").agg(F.min("_r").alias("_m"))
        new = roots.join(near, "_a").select("_a", F.least("root", "_m").alias("_n"), F.col("root").alias("_old"))
        new = new.join(name("_n", "_j"), "_n", "left").select("_a", F.least("_n", F.coalesce("_j", "_n")).alias("root"), "_old")
        new = scratch.write(new, "roots")
        scratch.drop("roots", last=1)
        roots = new.select("_a", "root")
        if not new.where("root <> _old").limit(1).count():
            break
    found = labels.join(roots.select(F.col("_a").alias("label"), "root"), "label", "left")  # a label of many classes is split by AQE
    out = scratch.write(found.select("cid", F.coalesce("root", "label").alias("label")), "labels")
    scratch.drop("links", "roots")
    return out


def fetch_sets(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """(cid, codes) for wanted (cid, t, c1, c2): made anew from one text for each, found by its code t."""
    texts = docs.join(wanted.select(F.col("t").alias("_t")), "_t", "left_semi").select("_t", "_text").distinct()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, n, one, two in _sets(batch.column(1).to_pylist(), rule.width):
                yield pa.RecordBatch.from_arrays([pa.array(_signed(one)), pa.array(_signed(two)), _lists([codes], n)], ["c1", "c2", "codes"])

    rows = texts.mapInArrow(made, "c1 long, c2 long, codes array<long>")
    return rows.join(wanted.select("cid", "t", "c1", "c2"), ["c1", "c2"]).select("cid", "codes")


def rarest_words(sets: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """(cid, word): the words that sets (cid, codes) list if those that fewest of them have come first, but for those that one has alone; words without shingles are the last."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, codes, n = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().view(U), batch.column(1).value_lengths().to_numpy().astype(np.int64)
            ends = np.cumsum(n)
            cuts = [0, *(np.flatnonzero(np.diff(ends // CELL_CODES)) + 1).tolist(), len(n)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                of, band, first, filled, words = sketch_words(codes[ends[a] - n[a] : ends[b - 1]], n[a:b], rule)
                each = lambda x, many=[len(w) for w in words]: pa.array(np.repeat(x, many))
                flat = pa.array(_signed(np.concatenate([np.zeros(0, U), *words])))
                yield pa.RecordBatch.from_arrays([each(cids[a:b][of]), each(band), each(np.maximum(0, filled - first)), flat], ["cid", "band", "skip", "word"])

    # words that one set has alone are its first ones: what a list leaves out is counted from its end
    rows = scratch.write(_in_two_rows(sets.select("cid", "codes").mapInArrow(cells, "cid long, band long, skip long, word long")), "cells")
    often = scratch.write(rows.groupBy("word").agg(F.count(F.lit(1)).alias("_n")), "often")
    empty = F.shiftright("word", 56) == -1
    place = F.row_number().over(Window.partitionBy("cid", "band").orderBy(empty, F.desc("_n"), F.desc("word")))  # one set's words in one band
    return rows.join(often, "word").withColumn("_k", place).where(empty | (F.col("_k") > F.col("skip"))).select("cid", "word")


def _in_two_rows(rows: DataFrame) -> DataFrame:
    """The rows whose word (a long) stands in another row: each next to its like in order of words, read once as a stream."""
    at = rows.columns.index("word")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, False  # the last row so far waits for the next one
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(at).to_numpy()
            same = words[1:] == words[:-1]
            keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            if last is not None:
                again = last.column(at)[0].as_py() == words[0]
                keep[0] |= again
                if kept or again:
                    yield last
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1]))
            last, kept = batch.slice(batch.num_rows - 1), keep[-1]
        if kept:
            yield last

    return rows.repartition("word").sortWithinPartitions("word").mapInArrow(found, rows.schema)


def _connected(docs: DataFrame, full: DataFrame, rule: Rule, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of docs (doc_id, _t, _text) and their signatures: classes (cid, c1, c2, doc, first, weight, n, sketch), and of those that list a word with another labels (cid, label) and sets (cid, codes).

    first (none, doc, t) tells the row that stands for the class: its id, ids first, and the code of its text.
    """
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), F.col("_t").alias("t"))
    keep = [F.min("doc_id").alias("doc"), F.min(first).alias("first"), F.count(F.lit(1)).alias("weight"), *(F.first(x).alias(x) for x in ("n", "sketch", "words"))]
    found = scratch.write(full.where("n > 0").groupBy("c1", "c2").agg(*keep).withColumn("cid", F.monotonically_increasing_id()), "found")
    classes = scratch.write(found.drop("words"), "classes")
    members = scratch.write(_in_two_rows(found.select("cid", F.explode("words").alias("word"))), "members")
    scratch.drop("rows", "found")

    facts = classes.select("cid", "c1", "c2", "n", "sketch", F.col("first.t").alias("t")).join(members.select("cid").distinct(), "cid", "left_semi")
    facts = scratch.write(facts, "facts")
    sets = scratch.write(fetch_sets(docs, facts.select("cid", "t", "c1", "c2"), rule), "sets")
    labels = facts.select("cid", F.col("cid").alias("label"))
    side = lambda x: facts.select(F.col("cid").alias(x), F.struct("n", "sketch").alias(f"_{x}"))

    tried = None
    for turn in range(2 * STAR_ROUNDS + 1):
        groups = members.join(labels, "cid")
        hub = F.min(F.struct(F.xxhash64("cid", F.pmod("word", F.lit(HUBS)), F.lit(turn)), "cid", "label")).alias("_hub")
        open_words = groups.groupBy("word").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), hub).where("_low < _high")
        if turn == STAR_ROUNDS:  # from now on by rare words
            still = groups.join(open_words, "word", "left_semi").select("cid").distinct()
            members = scratch.write(_in_two_rows(rarest_words(sets.join(still, "cid", "left_semi"), rule, scratch)), "members")
            scratch.drop("cells", "often")
            scratch.drop("members", last=1)
            groups = members.join(labels, "cid")
            open_words = groups.groupBy("word").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), hub).where("_low < _high")
        if turn < 2 * STAR_ROUNDS:
            pairs = groups.join(open_words, "word").where("label <> _hub.label").select(F.least("cid", "_hub.cid").alias("a"), F.greatest("cid", "_hub.cid").alias("b"))
            pairs = pairs.distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(near_bound("_a", "_b", rule)).select("a", "b")
        else:
            left = scratch.write(groups.join(open_words.select("word"), "word", "left_semi").join(facts.select("cid", "n", "sketch"), "cid"), "left")
            sides = [left.select("word", F.col("cid").alias(x), F.col("label").alias(f"{x}_label"), F.struct("n", "sketch").alias(f"_{x}")) for x in ("a", "b")]
            apart = (F.col("a_label") != F.col("b_label")) & (F.col("a") < F.col("b"))
            pairs = sides[0].join(sides[1], "word").where(apart & near_bound("_a", "_b", rule)).select("a", "b").distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch.write(pairs, "pairs")
        if not pairs.limit(1).count():
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        edges = scratch.write(linked_pairs(pairs, sets, rule), "edges")
        labels = merged(labels, edges, scratch)
        scratch.drop("edges")
        scratch.drop("labels", last=1)
    labels = scratch.write(labels, "components")
    scratch.drop("members", "facts", "pairs", "left", "labels")
    return classes, labels, sets


def _components(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, rep): of each component of labels (cid, label) the row that stands for it, by ids, then by texts."""
    return labels.join(classes.select("cid", "first"), "cid").groupBy("label").agg(F.min("first").alias("rep"))


def _signed_rows(docs: DataFrame, rule: Rule, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The signatures, written (_connected() deletes them), and of every row what _placed() takes, so that texts are gone through once for both."""
    full = scratch.write(signatures(docs, rule), "rows")
    return full, scratch.write(full.select("doc_id", "n", "c1", "c2"), "own")


def _placed(own: DataFrame, classes: DataFrame, labels: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """components() by what _signed_rows() and _connected() give; more (cid, others) adds n_links, the links to rows of other classes and of the row's own."""
    lowest = _components(classes, labels).select("label", F.col("rep.doc").alias("component"))
    found = classes.select("cid", "c1", "c2", "doc", "weight").join(labels.join(lowest, "label"), "cid", "left")
    count = F.lit(0).cast("long")
    if more is not None:
        found, count = found.join(more, "cid", "left"), F.coalesce("others", F.lit(0)) + F.col("weight") - 1
    found = found.select("c1", "c2", F.col("doc").alias("class_id"), F.coalesce("component", "doc").alias("component_id"), count.alias("n_links"))
    none = F.col("n") == 0
    out = own.join(found, ["c1", "c2"], "left")
    pick = lambda x: F.when(none, F.col("doc_id")).otherwise(F.col(x)).alias(x)
    last = [] if more is None else [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    return out.select("doc_id", F.col("n").alias("n_shingles"), pick("component_id"), pick("class_id"), *last)


def _keyed(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(text).alias("_t"), F.col(text).alias("_text"), *more)


def components(docs: DataFrame, rule: Rule = Rule(), text: str = "text") -> DataFrame:
    """Components only: one row per row of docs: doc_id, n_shingles, component_id, class_id. Links within what is connected already aren't looked for.

    component_id is the smallest doc_id that links lead to, itself included; class_id is the smallest with the very same
    set. A null, empty or blank text has no shingles and is linked with nothing, so both are its own doc_id. Rows with a null
    doc_id take part in links; their ids are null if no row with an id is reached. Repeated rows keep a row each, an empty
    table gives an empty result, other columns aren't read, and a very long text is one set as others are.
    """
    docs, scratch = _keyed(docs, text), Scratch(docs.sparkSession, "join")
    full, own = _signed_rows(docs, rule, scratch)
    classes, labels, _ = _connected(docs, full, rule, scratch)
    scratch.drop("sets")
    return _placed(own, classes, labels)


def linked(docs: DataFrame, rule: Rule = Rule(), text: str = "text") -> DataFrame:
    """components() and n_links, the number of other rows whose sets are linked with the row's, rows with the very same set included."""
    docs, scratch = _keyed(docs, text), Scratch(docs.sparkSession, "join")
    full, own = _signed_rows(docs, rule, scratch)
    classes, labels, sets = _connected(docs, full, rule, scratch)
    counts = scratch.write(tile_links(classes, labels, sets, rule, pairs=False), "counts")
    scratch.drop("sets")
    return _placed(own, classes, labels, counts.groupBy("a").agg(F.sum("b").alias("others")).withColumnRenamed("a", "cid"))


def links(docs: DataFrame, rule: Rule = Rule(), text: str = "text") -> DataFrame:
    """Every link between different sets, once: a and b, structs (class_id, rows, c1, c2) of the classes that it links.

    class_id is the class's smallest doc_id as in components(), null if no row has one; rows counts its rows, c1 and c2 are
    the codes of its set. Rows of one class are linked with each other, which isn't listed.
    """
    docs, scratch = _keyed(docs, text), Scratch(docs.sparkSession, "join")
    classes, labels, sets = _connected(docs, signatures(docs, rule), rule, scratch)
    pairs = scratch.write(tile_links(classes, labels, sets, rule, pairs=True), "pairs")
    scratch.drop("sets")
    side = lambda x: classes.select(F.col("cid").alias(x), F.struct(F.col("doc").alias("class_id"), F.col("weight").alias("rows"), "c1", "c2").alias(f"_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))


def tile_links(classes: DataFrame, labels: DataFrame, sets: DataFrame, rule: Rule, pairs: bool) -> DataFrame:
    """The links within components: with pairs (a, b: class ids, each link once), else by tile (a: class id, b: rows that a is linked with)."""
    known = labels.join(classes.select("cid", "n", "weight", "sketch"), "cid")
    sizes = known.groupBy("label").agg(F.count(F.lit(1)).alias("_k"), F.sum("n").alias("_codes")).where("_k > 1")
    sizes = sizes.select("label", F.ceil(F.greatest(F.col("_k") / TILE_ROWS, F.col("_codes") / TILE_CODES)).cast("int").alias("_blocks"))
    dealt = known.join(sizes, "label").join(sets, "cid")
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64("cid"), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select("label", F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high"), "_block", "cid", "n", "weight", "sketch", "codes")
    tiles = dealt.repartition("label", "_low", "_high").sortWithinPartitions("label", "_low", "_high")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[pa.RecordBatch] = []
        last, out, size = None, [], 0
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start == end:
                    continue
                key = tuple(keys[:, start])
                if part and key != last:
                    for a, b in _tile(part, rule, pairs):
                        out.append((a, b))
                        size += len(a)
                        if size >= 1 << 16:
                            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["a", "b"])
                            out, size = [], 0
                    part = []
                last = key
                part.append(batch.slice(start, end - start))
        if part:
            out += _tile(part, rule, pairs)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["a", "b"])

    return tiles.mapInArrow(found, "a long, b long")


def _tile(part: list[pa.RecordBatch], rule: Rule, pairs: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links between two blocks of a component, or within one, given by the rows of tile_links()."""
    flat = lambda k: np.concatenate([b.column(k).flatten().to_numpy() for b in part])
    column = lambda k: np.concatenate([b.column(k).to_numpy() for b in part])
    low, high, block, cid, n, weight = (column(k) for k in range(1, 7))
    sketch = np.stack([np.bitwise_xor.reduce(b[7][k].values.to_numpy().view(U).reshape(-1, LEAST_BITS // 64)) for b in part for k in range(b.num_rows)])  # folded to the least
    codes = np.unique(flat(8), return_inverse=True)[1]
    ends = np.cumsum(n)
    starts = ends - n
    rows, others = np.flatnonzero(block == low), np.flatnonzero(block == high)
    inside = low[0] == high[0]
    mark = np.zeros(int(codes.max()) + 1, bool)
    total = np.zeros(len(cid), np.int64)
    for at, i in enumerate(rows):
        js = others[at + 1 :] if inside else others
        m = n[js]
        apart = np.bitwise_count(sketch[js] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        close = (100 * np.minimum(m, n[i]) >= rule.percent * np.maximum(m, n[i])) & ((100 + rule.percent) * apart <= (100 - rule.percent) * (m + n[i]))
        js, m = js[close], m[close]
        if not len(js):
            continue
        mine = codes[starts[i] : ends[i]]
        mark[mine] = True
        hits = mark[np.concatenate([codes[starts[j] : ends[j]] for j in js])]
        mark[mine] = False
        both = np.add.reduceat(hits, np.cumsum(m) - m, dtype=np.int64)
        js = js[(100 + rule.percent) * both >= rule.percent * (m + n[i])]
        if pairs:
            yield np.minimum(cid[i], cid[js]), np.maximum(cid[i], cid[js])
        else:
            total[i] += weight[js].sum()
            total[js] += weight[i]
    if not pairs:
        yield cid[total > 0], total[total > 0]


def drop_near_duplicates(docs: DataFrame, rule: Rule = Rule(), text: str = "text") -> DataFrame:
    """docs with one row of each component: that of its smallest doc_id, and if that stands in several rows the one whose text has the smallest code.

    Rows without an id come after all ids. Of rows with the same id and text one stays, by the code of its other columns.
    Rows without shingles (null, empty and blank texts) are linked with nothing and all stay. An empty table gives an empty one;
    columns may have any names.
    """
    scratch = Scratch(docs.sparkSession, "join")
    keyed = _keyed(docs, text)
    classes, labels, _ = _connected(keyed, signatures(keyed, rule), rule, scratch)
    alone = classes.join(labels, "cid", "left_anti").select(F.col("first").alias("rep"))
    key = lambda doc, t: [F.col(t).alias("_t"), F.col(doc).isNull().alias("_none"), F.coalesce(F.col(doc).cast("string"), F.lit("")).alias("_id")]
    kept = materialize(alone.unionByName(_components(classes, labels).select("rep")).select(*key("rep.doc", "rep.t")), "kept")
    scratch.drop("sets", "components", "classes")

    plain = [column(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rows = _keyed(docs, text, F.xxhash64(*plain).alias("_order"), F.struct("*").alias("row"))  # so that no column of docs clashes with one of ours
    filled = F.coalesce("_text", F.lit("")).rlike(f"[^{BLANK}]")
    one = F.row_number().over(Window.partitionBy("_t", "_none", "_id").orderBy("_order"))  # each task passes on one row of a key
    some = rows.where(filled).select(*key("doc_id", "_t"), "_order", "row").withColumn("_k", one).where("_k = 1")
    return some.join(kept, ["_t", "_none", "_id"], "left_semi").select("row.*").unionByName(rows.where(~filled).select("row.*"))
