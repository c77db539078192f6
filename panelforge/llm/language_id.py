"""Language identification by prediction by partial matching.

For every language a tree of byte contexts up to a few bytes long counts which byte followed. Frozen, the tree gives each
byte of a text a code length: the longest known context codes the byte by its count, or an escape (as probable as the
context has distinct successors, PPM's method C) and then the next shorter context tries; below the empty context all 256
bytes are alike. The language whose tree codes the text shortest is predicted. The trees are fitted on a bounded sample;
texts are scored whole, against tables that hold, for every context and successor known to any tree, the exact code
lengths in all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

#: Bounds of the sample that the trees are fitted on: pieces per language, characters per piece, pieces in all (but one per language), and languages.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_ALL, SAMPLE_LANGUAGES = 400, 8_000, 2_000, 1_000
#: Languages whose code lengths stand in one table.
TABLE_LANGUAGES = 8
#: Bytes whose code lengths are held at once, over all languages.
PIECE_CELLS = 1 << 24
ORDER = 4
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from fitting: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, docs_per_language: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, docs_in_all: int = SAMPLE_ALL, languages: int = SAMPLE_LANGUAGES) -> list[tuple[str, str]]:
    """(lang, text) to learn from: of each language docs_per_language pieces at most, fewer if there are so many languages that docs_in_all wouldn't do, but one at least.

    Whole texts are cut into pieces of chars characters, and pieces are chosen by a hash of what they say, so a piece counts
    once however many rows repeat it, and any part of a long text may be chosen. Only rows with a language and a text that
    isn't empty or held out. The languages' counts tell which hashes are low enough, and the lowest one is always taken, so no
    language is gathered in a task and none is lost. The bounds hold at every input size; if a table has more than
    so many languages, those with the most different pieces are learned.
    """
    labelled = docs.where(F.col("lang").isNotNull() & (F.col("text") != "") & ~held_out(F.col("doc_id")))
    piece = F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chars}}}"), F.lit(0)))
    pieces = labelled.select("lang", piece.alias("text")).withColumn("_key", F.shiftrightunsigned(F.xxhash64("text"), 11))
    counts = pieces.groupBy("lang").agg(F.count_distinct("_key").alias("n"), F.min("_key").alias("low")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not counts:
        return []
    each = min(docs_per_language, max(1, docs_in_all // len(counts)))
    limits = [(r["lang"], max(r["low"], int(min(1.0, (each + 6 * each**0.5) / r["n"]) * (1 << 53)))) for r in counts]
    shares = docs.sparkSession.createDataFrame(limits, "lang string, limit long")
    rows = pieces.join(F.broadcast(shares), "lang").where(F.col("_key") <= F.col("limit"))  # a row for each of a bounded number of languages
    picked = rows.groupBy("lang", "_key").agg(F.first("text").alias("text")).collect()  # of repeated pieces one
    by_lang: dict[str, list[tuple[int, str]]] = {}
    for r in picked:
        by_lang.setdefault(r["lang"], []).append((r["_key"], r["text"]))
    return [(lang, text) for lang in sorted(by_lang) for _, text in sorted(by_lang[lang])[:each]]


def grams(data: np.ndarray, width: int) -> np.ndarray:
    """The codes of all runs of width bytes that end at each place, from the first place that has one on."""
    out = np.zeros(max(len(data) - width + 1, 0), np.uint64)
    for k in range(width):
        out = (out << np.uint64(8)) | data[k : k + len(out)].astype(np.uint64)
    return out


class Trees:
    """The frozen code lengths of all languages.

    tables[k] has the known runs of k + 1 bytes (sorted) and for each the bits, by language, that its last byte takes after
    the others; escapes[k] has the known contexts of k bytes and the bits, by language, that escaping from them takes.
    """

    def __init__(self, sample: list[tuple[str, str]], order: int = ORDER):
        self.languages = sorted({lang for lang, _ in sample})
        self.order = order
        self.rates: np.ndarray | None = None
        groups = [self.languages[k : k + TABLE_LANGUAGES] for k in range(0, len(self.languages), TABLE_LANGUAGES)]
        # a table has a column for each language and a row for each run that any of them knows: few languages a table, so that memory goes with the sample
        self.parts = [Trees([x for x in sample if x[0] in group], order) for group in map(set, groups)] if len(groups) > 1 else []
        if self.parts:
            return
        n = len(self.languages)
        texts = {lang: [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for x, t in sample if x == lang] for lang in self.languages}
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        self.escapes: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(order + 1):
            counts = [np.unique(np.concatenate([np.zeros(0, np.uint64), *(grams(t, k + 1) for t in texts[lang])]), return_counts=True) for lang in self.languages]
            known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(c[0] for c in counts)]))
            contexts = np.unique(known >> np.uint64(8))
            escape = np.zeros((len(contexts), n))
            bits = self.shorter(known, k)
            for j, (runs, times) in enumerate(counts):
                of = np.searchsorted(contexts, runs >> np.uint64(8))
                total, distinct = np.bincount(of, times, len(contexts)), np.bincount(of, minlength=len(contexts))
                seen = distinct > 0
                escape[seen, j] = np.log2((total[seen] + distinct[seen]) / distinct[seen])
                bits[:, j] += escape[np.searchsorted(contexts, known >> np.uint64(8)), j]
                bits[np.searchsorted(known, runs), j] = np.log2((total + distinct)[of] / times)
            self.tables.append((known, bits))
            self.escapes.append((contexts, escape))
        self.hashes = [hashed(known) for known, _ in self.tables]
        self.escape_hashes = [hashed(known) for known, _ in self.escapes]

    def shorter(self, runs: np.ndarray, k: int) -> np.ndarray:
        """The bits of each run's last byte, by language, without the context of k bytes."""
        if k == 0:
            return np.full((len(runs), len(self.languages)), 8.0)
        return self.bits(runs & np.uint64((1 << 8 * k) - 1), k - 1)

    def bits(self, runs: np.ndarray, k: int) -> np.ndarray:
        """The bits that the last byte of each run of k + 1 bytes takes, by language."""
        at = find(self.hashes[k], runs) if len(self.tables) > k and hasattr(self, "hashes") else search(self.tables[k][0], runs)
        out = self.tables[k][1][at] if len(self.tables[k][0]) else np.zeros((len(runs), len(self.languages)))
        missed = np.flatnonzero(at < 0)
        if len(missed):
            rest = self.shorter(runs[missed], k)
            contexts, escape = self.escapes[k]
            if len(contexts):
                of = search(contexts, runs[missed] >> np.uint64(8))
                rest = rest + np.where((of >= 0)[:, None], escape[of], 0)
            out[missed] = rest
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text in every language: a row per text. Texts are coded one by one, together in one array; a very long one in pieces."""
        if self.parts:
            return np.hstack([part.code_lengths(texts) for part in self.parts])
        most = max(1 << 12, PIECE_CELLS // max(1, len(self.languages)))
        if any(len(t) > most for t in texts):
            return np.stack([self._in_pieces(t, most) if len(t) > most else self.code_lengths([t])[0] for t in texts])
        size = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts = np.cumsum(size) - size
        place = np.arange(len(data)) - np.repeat(starts, size)  # within its text
        total = np.zeros((len(data), len(self.languages)))
        whole = grams(data, self.order + 1)
        full = place[self.order :] >= self.order
        if full.all():
            total[self.order :] = self.bits(whole, self.order)
        else:
            total[self.order :][full] = self.bits(whole[full], self.order)
        for k in range(self.order):  # the first bytes of a text have shorter contexts
            at = np.flatnonzero(place == k)
            runs = np.zeros(len(at), np.uint64)
            for j in range(k, -1, -1):
                runs = (runs << np.uint64(8)) | data[at - j].astype(np.uint64)
            total[at] = self.bits(runs, k)
        out = np.zeros((len(texts), len(self.languages)))
        filled = np.flatnonzero(size > 0)
        if len(filled):
            out[filled] = np.add.reduceat(total, starts[filled], axis=0, dtype=np.float64)
        return out

    def typical_rates(self) -> np.ndarray:
        """Bits a byte that unseen text of each language takes, at most 8: by trees of three quarters of its pieces, the others coded; of a language with one piece 8."""
        return self.rates if self.rates is not None else np.full(len(self.languages), 8.0)

    def _in_pieces(self, text: bytes, most: int) -> np.ndarray:
        total = self.code_lengths([text[:most]])[0]
        for at in range(most, len(text), most):  # with the bytes before it as context
            total = total + self.bits(grams(np.frombuffer(text[at - self.order : at + most], np.uint8), self.order + 1), self.order).sum(axis=0)
        return total


def fitted(sample: list[tuple[str, str]], order: int = ORDER) -> Trees:
    """The trees of all pieces, with the rates that a quarter of them takes under trees of the rest."""
    trees = Trees(sample, order)
    tried: dict[str, list[str]] = {}
    learned: list[tuple[str, str]] = []
    for k, (lang, text) in enumerate(sample):
        if k % 4 == 3:
            tried.setdefault(lang, []).append(text)
        else:
            learned.append((lang, text))
    some = Trees(learned, order)
    trees.rates = np.full(len(trees.languages), 8.0)
    for at, lang in enumerate(some.languages):
        texts = [t.encode("utf-8", "surrogatepass") for t in tried.get(lang, [])]
        if texts:
            trees.rates[trees.languages.index(lang)] = min(8.0, some.code_lengths(texts)[:, at].sum() / sum(map(len, texts)))
    return trees


def search(known: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The place of each run among the known ones, or -1."""
    if not len(known):
        return np.full(len(runs), -1)
    at = np.minimum(np.searchsorted(known, runs), len(known) - 1)
    return np.where(known[at] == runs, at, -1)


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def hashed(known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """A table of slots over the known runs: a first and a second choice of place, and the runs themselves."""
    bits = max(4, int(np.ceil(np.log2(max(1, len(known))))) + 3)
    slots, table = _slots(known, bits), np.full(1 << bits, -1, np.int32)
    table[slots[::-1]] = np.arange(len(known) - 1, -1, -1)
    return table, known, table[slots] == np.arange(len(known)), bits


def find(index: tuple[np.ndarray, np.ndarray, np.ndarray, int], runs: np.ndarray) -> np.ndarray:
    """As search(), by one look at the slot, and a search for those whose slot another run holds."""
    table, known, _, bits = index
    if not len(known):
        return np.full(len(runs), -1)
    at = table[_slots(runs, bits)]
    same = known[at] == runs
    other = np.flatnonzero(~same & (at >= 0))
    at = np.where(same, at, -1)
    if len(other):
        at[other] = search(known, runs[other])
    return at


def identify(docs: DataFrame, trees: Trees | None = None, text: str = "text", carry: tuple[str, ...] = (), max_batch_bytes: int = 1 << 20) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, bits_per_byte, and of docs the columns in carry.

    trees are fitted on docs if not given. lang_pred is und where the text is null or has no letter, and everywhere if there
    is nothing to learn from; score is then 0, else the predicted language's share when each language's probability of the
    text is compared with the others'. Ties go to the first language by name. Very long texts are coded whole, in
    pieces. Null ids, repeated rows and empty tables are no special case; columns that aren't asked for aren't read.
    """
    if trees is None:
        trees = Trees(training_sample(docs.select("doc_id", "lang", F.col(text).alias("text"))))
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(F.col(text).rlike("\\p{L}"), F.col(text)).alias("_text"), *carry)
    rows = rows.toDF(*(f"_{k}" for k in range(3 + len(carry))))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [x.encode("utf-8", "surrogatepass") if x and model.languages else b"" for x in batch.column(2).to_pylist()]
            bits = np.zeros((len(texts), len(model.languages)))
            first = 0
            while first < len(texts):  # as many texts at a time as fit, one at least
                last, size = first + 1, len(texts[first])
                while last < len(texts) and size + len(texts[last]) <= max_batch_bytes:
                    size, last = size + len(texts[last]), last + 1
                bits[first:last] = model.code_lengths(texts[first:last])
                first = last
            size = np.array([len(t) for t in texts])
            known = size > 0
            pred = np.full(len(texts), UNKNOWN, object)
            score, rate = np.zeros(len(texts)), np.full(len(texts), np.nan)
            if known.any():
                best = bits[known].argmin(axis=1)
                least = bits[known].min(axis=1)
                pred[known] = np.array(model.languages, object)[best]
                score[known] = 1 / np.exp2(np.maximum(least[:, None] - bits[known], -1000)).sum(axis=1)
                rate[known] = least / size[known]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score), pa.array(rate, mask=~known), *batch.columns[3:]], [f"_{k}" for k in range(5 + len(carry))])

    out = [("doc_id", docs.schema["doc_id"].dataType), ("held_out", BooleanType()), ("lang_pred", StringType()), ("score", DoubleType()), ("bits_per_byte", DoubleType()), *((x, docs.schema[x].dataType) for x in carry)]
    return rows.mapInArrow(scored, StructType([StructField(f"_{k}", kind) for k, (_, kind) in enumerate(out)])).toDF(*(name for name, _ in out))


#: A text may take so many bits more than its limit: short ones tell little.
SLACK_BITS = 64.0


def keep_identified(docs: DataFrame, trees: Trees | None = None, text: str = "text", slack: float = SLACK_BITS) -> DataFrame:
    """docs without the rows that are in no known language: those without a text or a letter in it, and those that the best tree hardly compresses.

    The limit lies half-way between what unseen text of the predicted language takes (measured on a quarter of the sample,
    under trees of the rest) and the 8 bits of a byte that no tree knows anything of; slack bits a text are added. A text
    in a script that nothing was learned of, or of random characters, goes; noise within prose stays. Where nothing could
    be learned, all rows with a letter stay. Null ids, repeated and very long rows are rows like others, columns may
    have any names, an empty table gives an empty one.
    """
    names = docs.columns
    plain = docs.toDF(*(f"_c{k}" for k in range(len(names))))
    at = {x: plain[f"_c{names.index(x)}"] for x in ("doc_id", "lang", text)}
    plain = plain.withColumns({"doc_id": at["doc_id"], "lang": at["lang"], "text": at[text]})
    if trees is None:
        trees = fitted(training_sample(plain.select("doc_id", "lang", "text")))
    own = tuple(f"_c{k}" for k in range(len(names)))
    if not trees.languages:
        return plain.where(F.col("text").rlike("\\p{L}")).select(*own).toDF(*names)
    found = identify(plain, trees, carry=own)
    limits = F.create_map(*(F.lit(x) for lang, rate in zip(trees.languages, trees.typical_rates(), strict=True) for x in (lang, float(rate + 8.0) / 2)))
    size = F.octet_length(F.col(own[names.index(text)]))
    low = F.col("bits_per_byte") * size <= F.try_element_at(limits, F.col("lang_pred")) * size + slack
    return found.where((F.col("lang_pred") != UNKNOWN) & low).select(*own).toDF(*names)
