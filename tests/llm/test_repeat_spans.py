"""Repeated spans against a table of all strings."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from panelforge.llm import queries, repeat_spans
from tests.llm.conftest import SF


def brute(rows, width=200):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[k : k + width] for _, d in data for k in range(len(d) - width + 1))
    out = Counter()
    for i, d in data:
        gone = np.zeros(len(d) + 1, bool)
        for k in range(len(d) - width + 1):
            if seen[d[k : k + width]] > 1:
                gone[k : k + width] = True
        gone = gone[:-1]
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i, len(d), int(gone.sum()), spans, sha256(kept).hexdigest()] += 1
    return out


def got(df):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.drop("kept").collect())


def test_small_table(spark, documents):
    rows = [(i, d["text"]) for i, d in documents.items()]
    want = brute(rows)
    assert got(queries.QUERIES["op10_suffix_dedup"](spark, SF)) == want
    assert sum(k[2] > 0 for k in want) > 50


@pytest.mark.parametrize("shard_contexts", [1000, 1, 3])
def test_planted_strings(spark, monkeypatch, shard_contexts):
    monkeypatch.setattr(repeat_spans, "SHARD_CONTEXTS", shard_contexts)
    monkeypatch.setattr(repeat_spans, "SHARD_BYTES", 5000)
    monkeypatch.setattr(repeat_spans, "SEGMENT_BYTES", 700)
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abcdeé \x00") for _ in range(n))
    common = [make(n) for n in (199, 200, 201, 260, 700)]
    rows = []
    for k in range(60):
        parts = [make(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            c = rng.choice(common)
            cut = rng.randint(0, 20) if rng.random() < 0.5 else 0
            parts += [c[cut:], make(rng.randint(0, 120))]
        rows.append((k, "".join(parts)))
    rows += [(100, "z" * 500), (101, "ab" * 150), (102, None), (103, ""), (None, common[4]), (None, common[4]), (104, "q" * 199), (104, "q" * 199), (105, rows[0][1]), (106, "é" * 99 + "x"), (107, "é" * 99 + "x"), (108, "r" * 200)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, t1 int, data string")
    assert got(repeat_spans.strip_repeats(df)) == brute(rows)
    assert repeat_spans.strip_repeats(df.where("false")).count() == 0


def test_shard_search_against_all_strings():
    rng = random.Random(9)
    for width in (1, 2, 3, 8, 20):
        contexts = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 60))) for _ in range(8)] + [b"abab" * 10]
        seen = Counter(c[k : k + width] for c in contexts for k in range(len(c) - width + 1))
        want = [[k for k in range(len(c) - width + 1) if seen[c[k : k + width]] > 1] for c in contexts]
        assert [x.tolist() for x in repeat_spans.repeated_in(contexts, width)] == want
