"""The n-gram join against all pairs."""

import random
import re

import pytest

from panelforge.llm import jaccard_join, queries
from panelforge.llm import shingles as shingles_module
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=5):
    w = WORD.findall((text or "").translate(UPPER))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute(docs, percent=80):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    at = {}
    for i, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(i)
    pairs = {(a, b) for v in at.values() for a in v for b in v if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_small_table_against_all_pairs(spark, documents):
    want = brute([(i, d["text"]) for i, d in documents.items()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op3_jaccard_join"](spark, SF).collect()}
    assert got == want and sum(i != c for i, (_, c) in want.items()) > 50


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_at_the_edge(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    docs = []
    passage = [rng.choice(vocabulary) for _ in range(40)]
    for _ in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 9, 12, 20, 37, 60, 120]))]
        if rng.random() < 0.5:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w += [rng.choice(vocabulary) for _ in range(rng.randint(0, len(w) // 6))]
            docs.append((len(docs) * 3, (" " if rng.random() < 0.5 else "\t\n ").join(w) if rng.random() < 0.7 else " ".join(w).upper()))
    docs += [(9000 + k, t) for k, t in enumerate([None, "", " \t", "one", "One", "one two", "one two three four", "one two three four five", " ".join(passage)])]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, words string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components(df).collect()}
    assert got == brute(docs)
    kept = [r["doc_id"] for r in jaccard_join.drop_near_duplicates(df.unionByName(df)).collect()]
    want = brute(docs)
    assert sorted(kept) == sorted([i for i, (n, c) in want.items() if c == i] + [i for i, (n, _) in want.items() if n == 0])


def test_a_row_goes_only_for_its_own_component(spark):
    one, two = "x y z w v u t", "k l m n o p q r"
    df = spark.createDataFrame([(6, one), (6, two), (7, one.upper()), (None, two)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.drop_near_duplicates(df).collect())) == [(6, two), (6, one)]
    mixed_rows = [(k, t, j) for k in range(40) for t in (one if k == 0 else f"{k} " + one.replace("x", f"q{k} r{k} s{k}"), None) for j in range(1)]
    df = spark.createDataFrame(mixed_rows, "doc_id long, text string, other int")
    assert sorted(map(str, jaccard_join.drop_near_duplicates(df).collect())) == sorted(map(str, df.collect()))
    df = spark.createDataFrame([(None, one), (None, one), (None, one + " end of it"), (None, None), (None, None), (3, "")], "doc_id long, text string")
    assert sorted(map(str, jaccard_join.drop_near_duplicates(df).collect())) == sorted(map(str, [r for k, r in enumerate(df.collect()) if k != 1]))


def test_nulls_repeats_and_nothing(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (7, "A b c d e f"), (7, "A b c d e f"), (None, "z"), (8, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard_join.components(df).collect())
    assert got == [("7", 2, 7), ("7", 2, 7), ("8", 0, 8), ("None", 1, None), ("None", 2, 7), ("None", 2, 7)]
    assert jaccard_join.components(df.where("false")).count() == 0
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in jaccard_join.drop_near_duplicates(df).collect()) == [("7", "A b c d e f"), ("8", "None"), ("None", "z")]


def test_listed_words_meet(spark):
    rng = random.Random(3)
    import numpy as np

    rule = jaccard_join.Rule()
    for _ in range(400):
        n = rng.randint(4, 300)
        both = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
        d = rng.randint(0, n // 4)
        k = rng.randint(0, d)
        a = np.unique(np.concatenate([both, np.array([rng.getrandbits(64) for _ in range(k)], np.uint64)]))
        b = np.unique(np.concatenate([both, np.array([rng.getrandbits(64) for _ in range(d - k)], np.uint64)]))
        if 100 * n >= 80 * (n + d) and d:
            assert set(jaccard_join.listed_words(a, rule)) & set(jaccard_join.listed_words(b, rule))


@pytest.mark.parametrize(("rounds", "hubs"), [(0, 1), (1, 1)])
def test_full_comparison_finds_what_is_left(spark, documents, monkeypatch, rounds, hubs):
    for name, value in (("STAR_ROUNDS", rounds), ("HUBS", hubs)):
        monkeypatch.setattr(jaccard_join, name, value)
    docs = [(i, d["text"]) for i, d in documents.items()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_rare_words_keep_linked_sets_together(spark, tmp_path):
    rng = random.Random(21)
    common = [rng.getrandbits(64) for _ in range(90)]
    sets = []
    for _ in range(30):
        base = common + [rng.getrandbits(64) for _ in range(rng.randint(0, 60))]
        sets.append(base)
        sets.append(base[: len(base) - rng.randint(0, len(base) // 12)] + [rng.getrandbits(64) for _ in range(rng.randint(0, len(base) // 12))])
    rows = [(k, sorted(x - 2**64 if x >= 2**63 else x for x in s)) for k, s in enumerate(sets)]
    words = {}
    for r in jaccard_join.rarest_words(spark.createDataFrame(rows, "cid long, codes array<long>"), jaccard_join.Rule(), jaccard_join.Scratch(spark, "test")).collect():
        words.setdefault(r["cid"], set()).add(r["word"])
    near = 0
    for i, a in rows:
        for j, b in rows[:i]:
            both = len(set(a) & set(b))
            if 100 * both >= 80 * (len(a) + len(b) - both) and set(a) != set(b):
                near += 1
                assert words[i] & words[j]
    assert near > 30


def test_folded_sketches_bound_the_difference(spark):
    import numpy as np

    rng = random.Random(5)
    rule, rows, linked = jaccard_join.Rule(), [], []
    for _ in range(60):
        n = rng.choice([200, 255, 256, 300, 500, 515, 1000, 1030])
        both = [rng.getrandbits(64) for _ in range(n)]
        a, b = (np.array(both + [rng.getrandbits(64) for _ in range(rng.randint(0, n // 4))], np.uint64) for _ in range(2))
        rows.append(tuple((len(x), jaccard_join._signed(jaccard_join.bit_sketch(x)).tolist()) for x in (a, b)))
        linked.append(100 * n >= 80 * (len(a) + len(b) - n))
    kind = "struct<n:long,sketch:array<long>>"
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, a {kind}, b {kind}")
    near = {r["k"] for r in df.where(jaccard_join.near_bound("a", "b", rule)).collect()}
    assert {k for k, x in enumerate(linked) if x} <= near and any(linked) and len(near) < 60


def passage_documents(rng, n=240):
    """Documents that all hold one passage and differ in the rest, with a near copy of every tenth."""
    passage = [f"p{k}" for k in range(45)]
    docs = []
    for i in range(n):
        own = [f"w{rng.randrange(10**6)}" for _ in range(25)]
        docs.append((i, " ".join(passage + own)))
        if i % 10 == 0:
            docs.append((1000 + i, " ".join(passage + own + ["end"])))
    return docs


def test_common_passages_link_nothing(spark):
    docs = passage_documents(random.Random(8))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components(df).collect()}
    assert got == brute(docs) and sum(i != c for i, (_, c) in got.items()) == 24


def test_columns_of_any_name(spark):
    names = "doc_id long, text string, row int, _once int, _row int, component_id string, n_shingles string"
    df = spark.createDataFrame([(1, "a b c d e f", 5, 6, 7, "x", "y"), (2, "a b c d e f", 8, 9, 10, "x", "y"), (None, None, 11, 12, 13, None, None)], names)
    kept = jaccard_join.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(kept.collect(), key=str) == sorted([r for r in df.collect() if r["doc_id"] != 2], key=str)


@pytest.mark.parametrize("tile", [1000, 4])
def test_every_link_is_listed(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "TILE_ROWS", tile)
    rng = random.Random(11)
    docs = []
    for c in range(6):
        base = [f"{c}w{k}" for k in range(120)]
        for _ in range(12):
            w = list(base)
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(w)))
    docs += [(100, docs[0][1]), (None, docs[1][1]), (101, docs[2][1].upper()), (102, None), (103, "alone in the table it is")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = [frozenset(shingles(t)) for _, t in docs]
    close = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    near = [(x, y) for x in range(len(sets)) for y in range(x) if close(sets[x], sets[y])]
    lowest = {}
    for (i, _), s in zip(docs, sets, strict=True):
        lowest[s] = min(lowest.get(s, 10**9), 10**9 if i is None else i)
    want = {tuple(sorted((lowest[sets[x]], lowest[sets[y]]))) for x, y in near if sets[x] != sets[y]}
    got = [tuple(sorted((r["a"]["class_id"], r["b"]["class_id"]))) for r in jaccard_join.links(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
    degrees = sorted((str(docs[k][0]), sum(k in p for p in near)) for k in range(len(docs)))
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in jaccard_join.linked(df).collect()) == degrees
    assert jaccard_join.links(df.where("false")).count() == jaccard_join.linked(df.where("false")).count() == 0


def test_words_with_structure_have_codes_of_their_own():
    words = []
    for size in (1024, 2048, 4096):
        a = "".join("ab"[k.bit_count() % 2] for k in range(size))
        words += [a, a.translate({97: "b", 98: "a"})]
    rng = random.Random(2)
    words += ["".join(rng.choice("ab") for _ in range(n)) for n in (7, 8, 9, 15, 16, 17, 255, 256, 257, 600) for _ in range(40)]
    words += ["a" * n for n in range(1, 300)] + ["a" * n + "\0" for n in range(1, 20)]
    words = list(dict.fromkeys(words))
    codes, counts = shingles_module.word_codes([" ".join(words).encode(), b"", b" A  a "])
    assert counts.tolist() == [len(words), 0, 2] and len(set(codes.tolist())) == len(words)
    assert codes[-1] == codes[-2] == codes[words.index("a")]


def test_texts_are_signed_once(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g"), (None, "a b c d e f"), (4, None)], "doc_id long, text string")
    for got in (jaccard_join.linked(df), jaccard_join.components(df)):
        assert "MapInArrow" not in got._jdf.queryExecution().toString()  # the result reads what the first pass has written
        assert sorted((str(r["doc_id"]), r["n_shingles"]) for r in got.collect()) == [("1", 2), ("2", 3), ("4", 0), ("None", 2)]


def test_words_of_many_sets_are_those_of_each(spark):
    import numpy as np

    rng, rule = random.Random(17), jaccard_join.Rule()
    sets = [np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)) for n in [*range(1, 40), *[4, 5] * 40, 255, 256, 257, 700, 3000]]
    of, _, first, filled, words = jaccard_join.sketch_words(np.concatenate(sets), np.array([len(s) for s in sets]), rule)
    for k, s in enumerate(sets):
        mine = [w[:m] for j, w, m in zip(of, words, first, strict=True) if j == k]
        assert np.concatenate([np.zeros(0, np.uint64), *mine]).tolist() == jaccard_join.listed_words(s, rule).tolist()
        assert jaccard_join.listed_words(np.roll(s, len(s) // 3), rule).tolist() == jaccard_join.listed_words(s, rule).tolist()
        assert [len(x) for x in mine] == [d for _, _, d in rule.schemes(len(s))]
    assert (filled < first).any() and all((np.diff(w.astype(object)) > 0).all() for w in words)


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_words_in_two_rows(spark, rows):
    rng = random.Random(rows)
    words = [(k, rng.choice([rng.randrange(-(2**63), 2**63), rng.randrange(-40, 40), 7])) for k in range(400)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = sorted(map(tuple, jaccard_join._in_two_rows(spark.createDataFrame(words, "cid long, word long")).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    often = [w for _, w in words]
    assert got == [(k, w) for k, w in words if often.count(w) > 1]


def test_rarest_words_against_counting(spark):
    import numpy as np

    rng, rule = random.Random(29), jaccard_join.Rule()
    common = [rng.getrandbits(64) for _ in range(300)]
    sets = [common[: rng.randrange(3, 300)] + [rng.getrandbits(64) for _ in range(rng.choice([0, 1, 4, 30]))] for _ in range(60)]
    signed = lambda s: [x - 2**64 if x >= 2**63 else x for x in map(int, s)]
    got = sorted(map(tuple, jaccard_join.rarest_words(spark.createDataFrame([(k, signed(sorted(s))) for k, s in enumerate(sets)], "cid long, codes array<long>"), rule, jaccard_join.Scratch(spark, "test")).collect()))
    of, _, first, _, words = jaccard_join.sketch_words(np.concatenate([np.array(sorted(s), np.uint64) for s in sets]), np.array([len(s) for s in sets]), rule)
    words, count = [signed(w) for w in words], {}
    for w in (x for ws in words for x in ws):
        count[w] = count.get(w, 0) + 1
    listed = [(int(k), w) for k, m, ws in zip(of, first, words, strict=True) for w in sorted(ws, key=lambda w: (w >> 56 == -1, count[w], w))[:m]]
    assert got == sorted((k, w) for k, w in listed if count[w] > 1) and len(got) > 300
