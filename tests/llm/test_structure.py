"""Prefix tries, personal data and conversation repair against plain Python on small tables, and their stated edge cases."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelforge.llm import personal_data, prefix_trie, queries, radix_tree, turn_repair
from tests.llm.conftest import SF

CONV = "conv_id long, turn long, role string, text string"
EMPTY = sha256(b"").hexdigest()


def hexed(text):
    return sha256(text.encode()).hexdigest()


# prefix tries


def plain_trie(convs):
    """{(conv_id, depth): the other columns} of {conv_id: [(role, text), ...]}."""
    last = lambda c: (c is None, c)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for node, who in members.items():
        under = [x for x in members if x[: len(node)] == node]
        kids = [x for x in under if len(x) == len(node) + 1]
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in under) for x in under)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        ends = ",".join("null" if c is None else str(c) for c in sorted((c for c in who if len(convs[c]) == len(node)), key=last))
        parent = min(members[node[:-1]], key=last) if node else None
        out[min(who, key=last), len(node)] = (parent, len(who), len(kids), leaves, saved, hexed(ends))
    return out


def in_order(rows):
    convs = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, prefix_id(r[2], r[3]))):
        convs[c].append((r or "", x or ""))
    return convs


def prefix_id(role, text):
    return hexed(f"{len(role or '')}:{role or ''}{text or ''}")[:32]


def asked_trie(df):
    rows = df.collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=40), st.randoms())
def test_radix_tree_holds_its_keys(keys, rng):
    rng.shuffle(keys)
    if not keys:
        return
    seen, stack = [], [radix_tree.build(keys)]
    while stack:
        node = stack.pop()
        assert all(keys[e] == keys[node.row][: node.upto] for e in node.ends)
        kids = list(node.kids)
        assert node.upto == 0 or node.ends or len(kids) > 1  # paths without branches are in one node
        assert all(k.upto > node.upto and keys[k.row][: node.upto] == keys[node.row][: node.upto] for k in kids)
        seen += node.ends
        stack += kids
    assert sorted(seen) == list(range(len(keys)))


@pytest.mark.parametrize(("n", "kind", "room"), [(3, radix_tree.Few, 4), (16, radix_tree.Few, 16), (48, radix_tree.Indexed, None), (256, radix_tree.Full, None)])
def test_radix_tree_nodes_grow(n, kind, room):
    edges = list(range(256))
    random.Random(n).shuffle(edges)
    root = radix_tree.build([bytes([e, 7]) for e in edges[:n]])
    assert type(root.kids) is kind and (room is None or root.kids.room == room)
    assert [k.row for k in root.kids] == sorted(range(n), key=edges.__getitem__)
    assert all((root.kids.get(e) is not None) == (e in edges[:n]) for e in range(256))


@pytest.mark.parametrize(("block_rows", "block_bytes", "parts"), [(1, 10**6, 3), (3, 10**6, 1), (4, 100, 5), (10**6, 10**9, 2)])
def test_prefix_trie_by_any_blocks(spark, block_rows, block_bytes, parts):
    rng = random.Random(block_rows)
    rows = []
    for c in [None, *range(-3, 60)]:
        for t in range(rng.choice((1, 2, 3, 3, 6))):
            rows.append((c, None if rng.random() < 0.1 else t, rng.choice(("user", "assistant", None)), rng.choice(("a", "a", "bé", "", None))))
    rows += [(c, t, "user", "same") for c in range(100, 130) for t in range(3)]  # many copies
    rows += [(200, t, "user", f"turn {t // 40}") for t in range(120)]  # a long one
    rows += rows[:5]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = asked_trie(prefix_trie.prefix_trie(prefix_trie.turn_lists(spark.createDataFrame([(*r, "x") for r in rows], CONV + ", key string")), block_rows, block_bytes))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == plain_trie(in_order(rows))


def test_prefix_trie_of_nothing_and_of_turnless(spark):
    none = spark.createDataFrame([], CONV)
    assert prefix_trie.prefix_trie(prefix_trie.turn_lists(none)).count() == 0
    turnless = spark.createDataFrame([(7, None), (3, [])], f"conv_id long, turns {prefix_trie.TURNS}")
    assert asked_trie(prefix_trie.prefix_trie(turnless)) == {(3, 0): (None, 2, 0, 1, 0, hexed("3,7"))}


def test_prefix_trie_gives_turns_back(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, None, "b"), (2, 0, "user", "a"), (2, 1, None, None)], CONV)
    found = prefix_trie.with_turns(prefix_trie.prefix_trie(prefix_trie.turn_lists(rows)), rows).collect()
    assert sorted(((r["conv_id"], r["depth"], r["role"], r["text"]) for r in found), key=str) == [(1, 0, None, None), (1, 1, "user", "a"), (1, 2, "", "b"), (2, 2, "", "")]


def test_prefix_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    own = in_order(rows)
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    assert asked_trie(queries.op11_prefix_trie(spark, SF)) == plain_trie(rebuilt)


def test_grafted_keeps_a_null_conversation(spark):
    rows = spark.createDataFrame([(None, 0, "user", "a"), (11, 0, "user", "b"), (11, 1, "user", "c")], CONV)
    got = {r["conv_id"]: len(r["turns"]) for r in queries.grafted(prefix_trie.turn_lists(rows)).collect()}
    h = zlib.crc32(b"11") % 9
    assert got == {None: 1, 11: max(0, 2 - h)}


# conversation repair


def brute_repair(rows, most=3):
    """The cheapest repair's (cost, audit) by trying all edits, with at most `most` insertions in a gap."""
    best = None
    n = len(rows)
    per_row = [[("D", None, 4)] if gone else [("D", None, 4), ("K", ini, 3 * cut), ("R", "u", 3 + 3 * cut), ("R", "a", 3 + 3 * cut)] for ini, gone, cut in rows]
    for ways in product(*per_row):
        for gaps in product(*[[x for k in range(most) for x in product("ua", repeat=k)]] * (n + 1)):
            cost, audit, initials = sum(w[2] for w in ways), [], []
            for k in range(n + 1):
                for x in gaps[k]:
                    cost, audit, initials = cost + 3, [*audit, "I"], [*initials, x]
                if k < n:
                    audit.append(ways[k][0])
                    initials += [ways[k][1]] if ways[k][1] else []
            said = "".join(initials).removeprefix("s")
            legal = not initials or (said == "ua" * (len(said) // 2) and said)
            if legal and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best[0], "".join(best[1])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.booleans(), st.booleans()), max_size=3))
def test_cheapest_repair_against_all_edits(rows):
    assert turn_repair.cheapest(rows) == brute_repair(rows)


def table_repair(rows):
    """cheapest() by a table of (cost, audit) pairs, forward in no fixed width."""
    inf = (10**9, "")
    put = lambda x, letter, cost: (x[0] + cost, letter + x[1])

    def inserted(best):
        for _ in range(3):
            best = [min(b, put(best[turn_repair.NEXT[s][0]], "I", 3)) for s, b in enumerate(best)]
        return best

    best = inserted([(0, ""), inf, inf, (0, "")])
    for ini, gone, cut in reversed(rows):
        ways = lambda s: [put(best[s], "D", 4)] + ([] if gone else [put(best[turn_repair.NEXT[s][0]], "R", 3 + 3 * cut)] + ([put(best[turn_repair.KEEP[s][ini]], "K", 3 * cut)] if ini in turn_repair.KEEP[s] else []))
        best = inserted([min(ways(s)) for s in range(4)])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from((False, False, True)), st.booleans()), max_size=60))
def test_cheapest_repair_of_longer_conversations(rows):
    assert turn_repair.cheapest(rows) == table_repair(rows)


def plain_audit(rows):
    """The query's columns for one conversation's (turn, role, text) in order."""
    seen, faults, codes = set(), dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        codes.append((role[:1] or " ", fault in ("blank", "duplicate"), fault == "truncated"))
    faults["illegal"] = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit = table_repair(codes)
    out, at, state = [], 0, 0
    for e in audit:
        if e == "D":
            at += 1
            continue
        role, text = ("", "") if e == "I" else rows[at][1:]
        if e != "K":
            role = turn_repair.NEXT[state][1]
        state = {"s": 1, "u": 2, "a": 3}[role[0]]
        out.append((role, "" if e == "I" else text, e))
        at += e != "I"
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return {"gaps": gaps, **faults, "cost": cost, "audit": audit, "repaired_sha256": hexed("\n".join(f"{r}:{t}" for r, t, _ in out))}, out


def digest(role, text):
    return sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def by_conversation(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t, " " if r is None else r, " " if x is None else x))
    return {c: sorted(v, key=lambda y: (y[0] is not None, y[0] or 0, digest(*y[1:]))) for c, v in convs.items()}


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hurt = []
    for c, t, r, x in rows:
        fault = zlib.crc32(f"{c}:{t}".encode()) % 20
        x = "" if fault == 1 else x.translate(dict.fromkeys(map(ord, ".!?"))) if fault == 2 else x
        hurt += [(c, t, "user" if fault == 4 else r, x)] * {0: 0, 3: 2}.get(fault, 1)
    convs = by_conversation(hurt)
    got = {r["conv_id"]: r.asDict() for r in queries.op13_turn_repair(spark, SF).collect()}
    assert got.keys() == {r[0] for r in rows}
    nothing = {**dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0), "audit": "", "repaired_sha256": EMPTY}
    for c, r in got.items():
        assert r == {"conv_id": c, **(plain_audit(convs[c])[0] if c in convs else nothing)}


def test_repair_of_odd_rows(spark):
    rng = random.Random(5)
    rows = [(rng.choice((None, 1, 2, 3)), rng.choice((None, 0, 1, 2, 5, 9)), rng.choice((None, "", "system", "user", "assistant", "über")), rng.choice((None, "", "Ok.", "Ok. \n", "so", "no!", "\t", "x" * 100_000 + "."))) for _ in range(120)]
    rows += [(4, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(400)] + [(5, None, None, None)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], CONV + ", audit int")
    convs = by_conversation(rows)
    got = {r["conv_id"]: r.asDict() for r in turn_repair.audit_conversations(df).collect()}
    assert got.keys() == convs.keys()
    placed = defaultdict(list)
    for r in turn_repair.repair_conversations(df).orderBy("place").collect():
        assert r["place"] == len(placed[r["conv_id"]])
        placed[r["conv_id"]].append((r["role"], r["text"], r["edit"]))
    for c, r in got.items():
        report, out = plain_audit(convs[c])
        assert r == {"conv_id": c, **report} and placed[c] == out
    assert turn_repair.audit_conversations(df.where("false")).count() == turn_repair.repair_conversations(df.where("false")).count() == 0


def test_damage_of_nulls(spark):
    rows = [(c, t, None, None) for c in (None, 1, 2) for t in (None, *range(30))]
    got = sorted(map(str, (tuple(r) for r in queries.damaged(spark.createDataFrame(rows, CONV)).collect())))
    want = []
    for c, t, _, _ in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want += [str((c, t, "user" if fault == 4 else " ", "" if fault == 1 else " "))] * {0: 0, 3: 2}.get(fault, 1)
    assert got == sorted(want)


# personal data


def plain_base(text):
    import re

    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def passes(kind, m):
        digits = [int(x) for x in re.sub("[^0-9]", "", m)]
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    found = [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for rank, (kind, p) in enumerate(rules.items()) for m in re.finditer(p, text) if passes(kind, m[0])]
    return [x[2] for x in sorted(found)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "é", "@", "@b.co", ".", "_", "%", "+", "+1 ", "1", "22", "333", "4444 ", "256", "1.2.3.4", " ", "-", "(", ")", "\n", "4111111111111111", "0", "000", "x@y", "..", "Z-9"]), max_size=25))
def test_base_kinds_against_plain_patterns(parts):
    text = "".join(parts)
    base = [f"{k}:{a}:{b}" for k, a, b, _ in personal_data.find_spans(text) if k in personal_data.BASE]
    assert base == plain_base(text)


def test_personal_data_query(spark, documents):
    got = {r["doc_id"]: r for r in queries.op12_personal_data(spark, SF).collect()}
    assert got.keys() == documents.keys()
    for i, r in got.items():
        base = plain_base(documents[i]["text"] or "")
        assert r["base_sha256"] == hexed(",".join(base))
        assert [r[f"n_{k}"] for k in personal_data.BASE] == [sum(x.startswith(k + ":") for x in base) for k in personal_data.BASE]
        assert [x for x in r["spans"].split(",") if x.split(":")[0] in personal_data.BASE] == base


def kinds(text, least=personal_data.LEAST):
    return [(k, text[a:b]) for k, a, b, _ in personal_data.find_spans(text, least)]


def test_validators_and_words_nearby():
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32 AND DE89370400440532013000 not GB82WEST12345698765433") == [("iban", "GB82 WEST 1234 5698 7654 32"), ("iban", "DE89370400440532013000")]
    assert kinds("ring +1 (212) 555-0100 4111111111111111 now") == [("tel", "+1 (212) 555-0100"), ("pan", "4111111111111111")]
    assert kinds("Order 12 4111111111111111") == [] and kinds("card, order 12 4111111111111111") == [("pan", "4111111111111111")]
    assert kinds("her SSN: 219-09-9999") == [("ssn", "219-09-9999")] and kinds("part 219-09-9999") == [] and kinds("ssn 000-09-9999") == []
    assert kinds("part 219-09-9999", 0.3) == [("ssn", "219-09-9999")]
    near, far = (personal_data.find_spans(t)[0][3] for t in ("mail me: a@b.co", "a@b.co"))
    assert near > far
    assert personal_data.find_spans("version 1.2.3.4")[0][3] < personal_data.find_spans("at 1.2.3.4")[0][3]


def test_long_texts_take_linear_time():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "@" * 500_000, "1." * 500_000, "+1" + " " * 1_000_000, "A1B2" * 300_000, "a@b." * 300_000, "1 -" * 300_000):
        assert isinstance(personal_data.find_spans(text), list)


def test_personal_data_of_odd_rows(spark):
    rows = [(None, None, 1), (None, "a@b.co", 2), (None, "a@b.co", 2), (1, "", 3), (2, "é +1 (212) 555-0100 x" * 2, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, findings int").withColumn("a.b", F.lit("x"))
    found = personal_data.find_personal_data(docs).collect()
    assert sorted((str(r["doc_id"]), [(x["kind"], x["start"], x["end"]) for x in r["findings"]]) for r in found) == [
        ("1", []), ("2", [("phone", 2, 19), ("phone", 23, 40)]), ("None", []), ("None", [("email", 0, 6)]), ("None", [("email", 0, 6)]),
    ]
    masked = personal_data.mask_personal_data(docs)
    assert masked.columns == docs.columns
    assert sorted((str(r["text"]), r["findings"], r["a.b"]) for r in masked.collect()) == [("", 3, "x"), ("<email>", 2, "x"), ("<email>", 2, "x"), ("None", 1, "x"), ("é <phone> xé <phone> x", 4, "x")]
    assert personal_data.find_personal_data(docs.where("false")).count() == personal_data.mask_personal_data(docs.where("false")).count() == 0
