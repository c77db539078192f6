"""Benchmark decontamination by pigeonhole edit matching.

A test item may stand in a document with as many edits as its error budget allows. Cut into one piece more than that, at
least one piece is there unchanged: an Aho-Corasick pass finds all pieces of all items at once, and around each hit
Myers' bit-parallel algorithm measures the item's distance to the best place in the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panelforge.llm.common import materialize

#: ASCII but letters and digits becomes a space.
FOLD = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
GRAM = 4


def fold(text: str | None) -> str:
    """Lower case, runs of ASCII marks and blanks as one space, none at the ends."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(FOLD).split()).decode("utf-8", "surrogatepass")


@dataclass(frozen=True)
class Item:
    """A folded test item with its error budget and pieces (offset, text). A short item has no budget and must stand between words' ends."""

    item_id: object
    text: str
    budget: int
    pieces: tuple[tuple[int, str], ...]
    grams: tuple[str, ...]
    short: bool = False


def make_item(item_id: object, text: str, error_rate: float, min_chars: int = 0) -> Item:
    budget = int(error_rate * len(text)) if len(text) >= min_chars else 0
    cuts = [round(k * len(text) / (budget + 1)) for k in range(budget + 2)]
    pieces = tuple((a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))
    return Item(item_id, text, budget, pieces, tuple(text[k : k + GRAM] for k in range(len(text) - GRAM + 1)), len(text) < min_chars)


def automaton(items: list[Item]) -> ahocorasick.Automaton:
    """Finds all items' pieces; a hit gives the (item's number, piece's offset) of all that have this piece."""
    at: dict[str, list[tuple[int, int]]] = {}
    for n, item in enumerate(items):
        for offset, piece in item.pieces:
            at.setdefault(piece, []).append((n, offset))
    out = ahocorasick.Automaton()
    for piece, where in at.items():
        out.add_word(piece, (len(piece), where))
    out.make_automaton()
    return out


def best_match(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """The (distance, end) of the place in text nearest to the whole pattern, the first of equals; None if none is within budget."""
    m = len(pattern)
    last, full = 1 << (m - 1), (1 << m) - 1
    peq: dict[str, int] = {}
    for k, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << k
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score <= budget and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


def match_text(text: str, items: list[Item], machine: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(item's number, distance, end) for each item within budget in a folded text, at its best place."""
    if not items:
        return []
    tried: dict[tuple[int, int], None] = {}
    best: dict[int, tuple[int, int]] = {}
    for end, (size, where) in machine.iter(text):
        for n, offset in where:
            item = items[n]
            if item.short:
                if (end + 1 == len(text) or text[end + 1] == " ") and (end + 1 == size or text[end - size] == " "):
                    best.setdefault(n, (0, end + 1))
                continue
            start = end + 1 - size - offset  # where the item would begin, up to budget away
            step = item.budget + 1
            if (n, start // step) in tried or best.get(n, (1,))[0] == 0:
                continue
            tried[n, start // step] = None
            low = max(0, start // step * step - item.budget)
            window = text[low : start // step * step + step + len(item.text) + item.budget]
            if item.budget:  # every edit spoils GRAM grams at most
                there = {window[k : k + GRAM] for k in range(len(window) - GRAM + 1)}
                if sum(g in there for g in item.grams) < len(item.grams) - GRAM * item.budget:
                    continue
            found = best_match(item.text, window, item.budget)
            if found and (n not in best or found[0] < best[n][0]):
                best[n] = (found[0], low + found[1])
    return [(n, d, e) for n, (d, e) in sorted(best.items())]


def _blocks_done(rows: DataFrame, benchmark: DataFrame, error_rate: float, min_chars: int, block_chars: int, step: Callable[[DataFrame, Broadcast], DataFrame]) -> Iterator[DataFrame]:
    """step(rows, items) for each block of items; if there are several, each is written before the next block is made, and its items are let go."""
    count = item_blocks(benchmark, block_chars)
    for k in range(count):
        shared = made_items(benchmark, error_rate, min_chars, k, count)
        if count == 1:
            yield step(rows, shared)
        else:
            out = materialize(step(rows, shared), "block")
            shared.unpersist()
            yield out


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.08, min_chars: int = 24, text: str = "text", block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, distance, match_end, item_chars, short): each test item found in each row of docs, at its best place.

    Texts and items are folded (see fold()); an item of n characters may have int(error_rate * n) edits; match_end counts in
    the folded text. Items that have fewer than min_chars folded characters are short: they are found without edits only,
    at the ends of words on both sides. Items without a folded character are never found, and a null or empty text has none;
    a very long text is searched whole. Repeated items are found each by its id, repeated rows of docs give repeated
    results, empty tables an empty one, other columns aren't read. Items are searched in blocks of block_chars characters
    or one item each, one after the other, so what is broadcast and gathered at once is bounded however many there are.
    """
    rows = docs.select("doc_id", F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    ids = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {ids[0]}, item_id {ids[1]}, distance int, match_end long, item_chars int, short boolean"
    kind = to_arrow_type(benchmark.schema["item_id"].dataType)

    def search(rows: DataFrame, shared: Broadcast) -> DataFrame:
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: list[Item] = shared.value
            machine = automaton(known)
            for batch in batches:
                hits = [(k, *h) for k, t in enumerate(batch.column(1).to_pylist()) for h in match_text(fold(t), known, machine)]
                at, number, distance, end = zip(*hits, strict=True) if hits else ((), (), (), ())
                of = [known[n] for n in number]
                columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array([x.item_id for x in of], kind), pa.array(distance, pa.int32()), pa.array(end, pa.int64()), pa.array([len(x.text) for x in of], pa.int32()), pa.array([x.short for x in of], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "distance", "match_end", "item_chars", "short"])

        return rows.mapInArrow(found, schema)

    out = None
    for part in _blocks_done(rows, benchmark, error_rate, min_chars, block_chars, search):
        out = part if out is None else out.unionByName(part)
    return out


def item_blocks(benchmark: DataFrame, block_chars: int) -> int:
    """Into how many blocks of about block_chars characters the items of benchmark (item_id, text) go."""
    return -(-(benchmark.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars) or 1


def made_items(benchmark: DataFrame, error_rate: float, min_chars: int, block: int, blocks: int) -> Broadcast:
    part = benchmark.select("item_id", "text").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
    return benchmark.sparkSession.sparkContext.broadcast([make_item(r["item_id"], t, error_rate, min_chars) for r in part if (t := fold(r["text"]))])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.08, min_chars: int = 24, text: str = "text", block_chars: int = 4_000_000, drop_short: bool = False) -> DataFrame:
    """docs without the rows in which contaminated() finds an item; row by row, whatever their ids.

    Short items, which may be everyday words, count with drop_short only. Null and empty texts, repeated rows and further
    columns of any name stay as they are; an empty table gives an empty one.
    """
    names = docs.columns
    at = names.index(text)
    docs = docs.toDF(*(f"_c{k}" for k in range(len(names))))  # whatever they are called

    def clean(rows: DataFrame, shared: Broadcast) -> DataFrame:
        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = [x for x in shared.value if drop_short or not x.short]
            machine = automaton(known)
            for batch in batches:
                yield batch.filter(pa.array([not match_text(fold(t), known, machine) for t in batch.column(at).to_pylist()], pa.bool_()))

        return rows.mapInArrow(kept, rows.schema)

    count = item_blocks(benchmark, block_chars)
    for k in range(count):
        shared = made_items(benchmark, error_rate, min_chars, k, count)
        docs = clean(docs, shared)
        if count > 1:
            docs = materialize(docs, "clean")
            shared.unpersist()
    return docs.toDF(*names)
