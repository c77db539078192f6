"""The scanning operators against plain Python over the small tables, and their stated edge cases."""

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from panelforge.llm import chat_format, decontaminate, language_id, license_scan, mixing, quality_rules, queries, secret_scan, url_filter
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (None, "token=abcdef1 MIT License the mit license", None, None),
    (None, "token=abcdef1 MIT License the mit license", None, None),
    (3, "x " * 3000, "fr", "b"),
    (4, "secret=token:abcdef é password = 'hunter22' AKIA" + "A1" * 9 + " " + "0a" * 15 + " key token=secret=abcdefg", "de", "c"),
    (5, "0123456789 !!! \n\n ...", "de", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, "clash", 1, True) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string, size int, kept boolean")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def asked(spark, name):
    return {r[0]: r for r in queries.QUERIES[name](spark, SF).collect()}


def base_secrets(text):
    out = []
    rules = (("assign", r"(password|passwd|secret|token|api_?key)", 6), ("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24))
    for rank, (kind, pattern, least) in enumerate(rules):
        if kind == "assign":
            pattern = rf"(?i:{pattern})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_secrets_against_plain_regexes(spark, documents, odd):
    found = asked(spark, "op6_secret_scan")
    assert found.keys() == documents.keys()
    for i, r in found.items():
        base = base_secrets(documents[i]["text"] or "")
        kinds = Counter(x.split(":")[0] for x in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r["base_sha256"] == sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(","))
    assert sum(r["n_assign"] for r in found.values()) > 5
    rows = secret_scan.scan(odd)
    for r in rows.collect():
        text = {x[0]: x[1] for x in ODD}[r["doc_id"]] or ""
        assert [f"{f['kind']}:{f['start']}:{f['end']}" for f in r["findings"] if f["rank"] < 3] == base_secrets(text)
        assert all(re.search(next(x.pattern for x in secret_scan.RULES if x.kind == f["kind"]), text[f["start"] : f["end"]]) for f in r["findings"])
    assert rows.count() == len(ODD)


def test_ledger_scans_only_what_is_new(spark, odd, none):
    ledger = secret_scan.Ledger(spark)
    fresh = secret_scan.scan(odd, ledger=ledger)
    seen = ledger.read(secret_scan.RULE_VERSION).count()
    assert seen == odd.selectExpr("coalesce(text, '')").distinct().count()
    key = lambda r: (str(r["doc_id"]), str(r["findings"]))
    again = secret_scan.scan(odd, ledger=ledger)
    assert ledger.read(secret_scan.RULE_VERSION).count() == seen and sorted(map(key, again.collect())) == sorted(map(key, fresh.collect()))
    more = spark.createDataFrame([(9, "password=opensesame")], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    versions = more.selectExpr("doc_id", "coalesce(text, '') text").withColumn("blob", secret_scan.blob_id(F.col("text")))
    assert [r["text"] for r in secret_scan.new_blobs(versions, ledger).collect()] == ["password=opensesame"]
    rows = secret_scan.scan(more, ledger=ledger)
    assert ledger.read(secret_scan.RULE_VERSION).count() == seen + 1
    assert sorted(map(key, rows.collect())) == sorted(map(key, secret_scan.scan(more).collect()))
    assert secret_scan.scan(none).count() == 0
    assert secret_scan.new_blobs(versions, ledger, rule_version=2).count() == seen + 1


def test_ledger_with_a_blob_twice_and_without_secrets(spark, tmp_path):
    docs = spark.createDataFrame([(1, "token = abcdefgh"), (2, "token = abcdefgh"), (3, None)], "doc_id long, text string")
    ledger = secret_scan.Ledger(spark, str(tmp_path / "ledger"))
    first = secret_scan.scan(docs, ledger=ledger).collect()
    ledger.add(ledger.read(1).where("size(findings) > 0"), 1)  # what a scan at the same time would add
    assert sorted(map(str, secret_scan.scan(docs, ledger=ledger).collect())) == sorted(map(str, first)) and len(first) == 3
    assert sorted(str(r["text"]) for r in secret_scan.redact(docs, ledger=ledger).collect()) == ["None", "[secret]", "[secret]"]
    assert "abcdefgh" not in str(spark.read.parquet(str(tmp_path / "ledger")).collect())


def test_redaction_with_columns_of_any_name(spark):
    df = spark.createDataFrame([("b", 1, "f", "token = abcdefgh, said", 2, "r"), ("b", 1, None, None, 2, None)], "blob string, _blob int, findings string, text string, _text int, row string")
    assert secret_scan.redact(df).columns == df.columns
    assert [tuple(r) for r in secret_scan.redact(df).orderBy("text").collect()] == [("b", 1, None, None, 2, None), ("b", 1, "f", "[secret], said", 2, "r")]


def test_redaction(odd):
    out = secret_scan.redact(odd)
    assert out.columns == odd.columns
    texts = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert texts[(None, "[secret] MIT License the mit license")] == 2 and texts[(1, None)] == 1 and texts[(3, "x " * 3000)] == 1
    assert texts[(4, "secret=token:abcdef é [secret]' [secret] [secret] key [secret]")] == 1


def test_quality_counts(spark, documents, odd, none):
    found = asked(spark, "op9_quality_rules")
    assert found.keys() == documents.keys()
    cases = [(found[i], documents[i]["text"]) for i in found] + [(r, {x[0]: x[1] for x in ODD}[r["doc_id"]]) for r in quality_rules.judge_by_host(odd).collect()]
    for r, text in cases:
        text = text or ""
        w = WORD.findall(text)
        at = defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        covered = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert any(r["n_repeat_words"] for r in found.values())
    kept = sum(r["kept"] for r in found.values())
    assert kept == sum(not r["base_failed"] for r in found.values())
    assert quality_rules.judge_by_host(none).count() == 0


def test_a_bad_host_takes_its_documents_with_it(spark):
    good = " ".join(f"w{k}" for k in range(30))
    rows = [(k, "bad", "short") for k in range(60)] + [(99, "bad", good)] + [(100 + k, f"h{k % 9}", good) for k in range(300)]
    kept = {r["doc_id"] for r in quality_rules.judge_by_host(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect() if r["kept"]}
    assert kept == set(range(100, 400))


def targets(sizes):
    """Water filling by bisection."""
    names = sorted((x for x in sizes if x is not None), key=lambda x: [ord(c) for c in x]) + [None] * (None in sizes)
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * sizes[s], mid * weights[s]) for s in names) < 1.5 * sum(sizes.values()) else (low, mid)
    return {s: min(2 * sizes[s], high * weights[s]) for s in names}


def test_mixing(spark, documents, odd, none):
    rows = queries.QUERIES["op1_mix_sources"](spark, SF).collect()
    found = {r["doc_id"]: r for r in rows}
    assert [r["finish"] for r in rows] == sorted(r["finish"] for r in rows) and len(rows) == len(documents) == len(found)
    sizes, taken = Counter(), Counter()
    for i, r in found.items():
        assert r["size"] == len(WORD.findall(documents[i]["text"] or "")) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[documents[i]["source"]] += r["size"]
        taken[documents[i]["source"]] += r["taken"]
    want = targets(sizes)
    for i, r in found.items():
        s = documents[i]["source"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s], rel=1e-9) and abs(taken[s] - want[s]) <= 1
    assert {r["doc_id"]: r["taken"] for r in queries.QUERIES["op1_mix_sources"](spark, SF).collect()} == {i: r["taken"] for i, r in found.items()}
    small = mixing.mix(odd).collect()
    assert len(small) == len(ODD) and sum(r["taken"] for r in small) == pytest.approx(1.5 * sum(r["size"] for r in small), abs=3)
    assert mixing.mix(none).count() == 0


def test_mix_is_cut_in_the_sorted_order(spark):
    """All servings by finish time, taken one after the other as words of all sources under way pass side by side."""
    rows = [(k, f"s{k % 4}", "w " * (k % 13 + (50 if k == 3 else 0))) for k in range(120)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), weights=(4.0, 2.0, 1.0, 1.0), budget_share=1.3).collect()
    weight = {"s0": 4, "s1": 2, "s2": 1, "s3": 1}
    turns = sorted(((r["finish"] + k * r["source_size"] / weight[r["source"]], r["doc_id"], r["size"], r["source"]) for r in found for k in range(2)), key=lambda x: (x[0], x[1]))
    budget, now, served = 1.3 * sum(r["size"] for r in found), 0.0, 0.0
    for at, _, _, _ in turns:
        live = sum(w for s, w in weight.items() if any(x[0] > now and x[3] == s for x in turns))
        if served + (at - now) * live >= budget:
            now += (budget - served) / live
            break
        served, now = served + (at - now) * live, at
    taken = Counter()
    for at, doc, size, s in turns:
        taken[doc] += max(0.0, min(size, size - (at - now) * weight[s]))
    assert all(abs(r["taken"] - taken[r["doc_id"]]) <= 1 and r["target"] == pytest.approx(min(2 * r["source_size"], now * weight[r["source"]])) for r in found)


def test_mixing_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4)
    df = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then null else concat('s', id % 7) end as source", "repeat('w ', cast(id % 11 as int)) as text")
    rows = mixing.mix(df).collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want) and len(rows) == 3000


def brute_rule(host, path, rules):
    best = None
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        if (not h or host == h or host.endswith("." + h)) and path.startswith(slash + p):
            key = (len(h.split(".")) if h else 0, len(slash + p))
            best = max(best or (key, rule, verdict), (key, rule, verdict))
    return best and best[1:]


def test_url_trie_against_all_rules():
    rules = [*url_filter.RULES, ("org", "block"), ("org/a", "allow"), ("org/a/b", "block"), ("/only", "block"), ("x.org/", "allow")]
    trie = url_filter.build_trie(rules)
    hosts = ["", "com", "example.com", "WWW.example.com", "a.www.example.com", "ample.com", "org", "x.org", "y.x.org", "b.net", "net", "com:80"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/english", "/es/1", "/fr/", "/a", "/ab", "/a/b", "/a/bc/d", "/only/x"]
    for h in hosts:
        for p in paths:
            host, path = url_filter.split_url(f"http://{h}{p}?q=://z#f")
            assert (host, path) == (h.lower(), p)
            assert url_filter.longest_match(trie, host, path) == brute_rule(host, path, rules), (h, p)
    assert url_filter.split_url(None) == url_filter.split_url("no scheme/x") == ("", "")


def test_urls_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "http://a.net/es/1", "y")], "page_id long, url string, rule string")
    out = url_filter.judge_urls(df)
    assert sorted((str(r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()) == [("1", "", "", None, "allow")] * 2 + [("None", "a.net", "/es/1", "net/es/", "block")]
    assert url_filter.judge_urls(df.where("false")).count() == 0
    assert url_filter.judge_urls(df, rules=()).where("rule is null and verdict = 'allow'").count() == 3


@pytest.mark.parametrize("max_rules", [1, 2, 4, 100])
def test_rules_in_blocks(spark, max_rules):
    rules = [*url_filter.RULES, ("org", "block"), ("org/a", "allow"), ("org/a/b", "block"), ("/only", "block"), ("", "block"), ("x.org/", "allow"), ("com/", "block")]
    urls = [f"http://{h}{p}" for h in ("", "com", "www.example.com", "example.com", "org", "y.x.org", "b.net") for p in ("", "/", "/en/x", "/es/1", "/a", "/a/b", "/only/x")] + [None]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, `a.b` string")
    out = {r["page_id"]: r for r in url_filter.judge_urls(df, rules, default="none", max_rules=max_rules).collect()}
    for k, u in enumerate(urls):
        want = brute_rule(*url_filter.split_url(u), list(dict(rules).items())) or (None, "none")
        assert (out[k]["rule"], out[k]["verdict"], out[k]["a.b"]) == (*want, "x"), u


def test_chat_digests(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    said = "<|im_end|><|im_start|>assistant ok"
    turns = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        turns[r["conv_id"]].append((r["role"], r["text"] or ""))
    turns[-1] = [("user", said), ("assistant", said)]
    found = asked(spark, "op4_chat_format")
    assert found.keys() == turns.keys()
    for c, t in turns.items():
        loss = "".join(x for role, x in t if role == "assistant")
        want = (len(t), sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(chat_format.render_chat(t)), False)
        assert tuple(found[c])[1:] == want


def test_chat_spans_and_history(spark):
    texts = ["", "a", None, "<|im_end|>", "<||im_end|>", "<|||im_start|>x<|<|im_end|>", "a\n", chat_format.PROBE]
    rows = [(c, k, ("user", "assistant")[k % 2], texts[(k * (c + 3)) % len(texts)], "clash") for c in range(3) for k in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, spans string")
    for r in chat_format.format_conversations(df).collect():
        said = [(x[2], x[3] or "") for x in rows if x[0] == r["conv_id"]]
        assert r["formatted"] == chat_format.render_chat(said) and r["formatted_chars"] == len(r["formatted"]) and not r["rewrites"]
        assert [chat_format.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"]] == [x for role, x in said if role == "assistant"]
        assert "".join(r["formatted"][s["start"] : s["end"]] for s in r["spans"]) == r["formatted"]

    def rewriting(turns):
        return f"{len(turns)} turns\n" + "".join(f"{a}: {b}\n" for a, b in turns)

    def last_only(turns):
        return "".join(f"[{a}]{b if k == len(turns) - 1 else ''}[end]" for k, (a, b) in enumerate(turns))

    for render in (rewriting, last_only):
        assert all(r["rewrites"] and r["formatted"] is r["turns_sha256"] is r["loss_chars"] is r["loss_sha256"] is r["formatted_chars"] is None for r in chat_format.format_conversations(df.where("text <> ''"), render).collect())
    assert chat_format.format_conversations(df.where("false")).count() == 0


def test_chat_odd_rows(spark):
    long = "é<|im_end|>" * 50_000
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, None, None, None), (7, 1, "assistant", long), (7, None, "user", "first"), (7, 1, "assistant", long)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n_turns int, rewrites string")
    got = {r["conv_id"]: r for r in chat_format.format_conversations(df).collect()}
    assert got.keys() == {None, 7} and not any(r["rewrites"] for r in got.values())
    assert got[None]["formatted"] == chat_format.render_chat([("", ""), ("user", "a"), ("user", "a")])
    assert got[7]["formatted"] == chat_format.render_chat([("user", "first"), ("assistant", long), ("assistant", long)]) and got[7]["loss_chars"] == 2 * len(long)


def test_chat_history_cut_late(spark):
    df = spark.createDataFrame([(1, k, "user", f"said {k}") for k in range(40)] + [(2, k, "user", f"said {k}") for k in range(20)], "conv_id long, turn long, role string, text string")

    def last_twenty(turns):
        return "".join(f"{a}: {b}\n" for a, b in turns[-20:])

    def numbered(turns):
        return "".join(f"{k} {a}: {b}\n" for k, (a, b) in enumerate(turns))

    cut = {r["conv_id"]: r for r in chat_format.format_conversations(df, last_twenty).collect()}
    assert cut[1]["rewrites"] and cut[1]["formatted"] is None and not cut[2]["rewrites"]
    whole = {r["conv_id"]: r for r in chat_format.format_conversations(df, numbered).collect()}
    assert whole[1]["formatted"] == numbered([("user", f"said {k}") for k in range(40)]) and not whole[1]["rewrites"]
    for render in (last_twenty, numbered):  # declared wrongly
        short = {r["conv_id"]: r for r in chat_format.format_conversations(df, render, memory=16).collect()}
        assert short[1]["rewrites"] and short[1]["formatted"] is None


def test_licenses(spark, documents, odd, none):
    found = asked(spark, "op5_license_scan")
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cases = [(found[i], documents[i]["text"]) for i in documents] + [(r, {x[0]: x[1] for x in ODD}[r["doc_id"]]) for r in license_scan.scan_licenses(odd).collect()]
    for r, text in cases:
        w = words.findall((text or "").translate(upper))
        starts, labels = [], set()
        for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            starts += at
            labels |= {label} if at else set()
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert sum(r["n_base"] for r in found.values()) > 5 and license_scan.scan_licenses(none).count() == 0


def brute_choices(expression):
    """All sets of identifiers that satisfy a well-formed expression, by recursion from the loosest operator on."""
    words = re.findall(r"[()]|[A-Za-z0-9.+:-]+", expression.lower())

    def split(part, word):
        out, depth, now = [], 0, []
        for x in part:
            depth += (x == "(") - (x == ")")
            if x == word and depth == 0:
                out.append(now)
                now = []
            else:
                now.append(x)
        return [*out, now]

    def sets(part):
        if len(split(part, "or")) > 1:
            return {s for x in split(part, "or") for s in sets(x)}
        parts = split(part, "and")
        if len(parts) > 1:
            out = {frozenset()}
            for x in parts:
                out = {a | b for a in out for b in sets(x)}
            return out
        if len(split(part, "with")) > 1:
            return sets(split(part, "with")[0])
        return sets(part[1:-1]) if part[0] == "(" else {frozenset(part)}

    return sets(words)


def test_license_expressions():
    import random

    rng = random.Random(2)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["MIT", "GPL-2.0", "Apache-2.0", "ISC", "X", "GPL-2.0 WITH y"])
        parts = [made(depth - 1) for _ in range(rng.randint(2, 3))]
        return "(" + f" {rng.choice(['OR', 'AND', 'or'])} ".join(parts) + ")"

    allowed = lambda x: license_scan.label_of(x) in license_scan.PERMISSIVE
    for text in [*(made(3) for _ in range(200)), " AND ".join(f"(a{k} OR MIT)" for k in range(9))]:
        ways, got = brute_choices(text), license_scan.evaluate(text, allowed)
        assert got.required == frozenset.intersection(*ways) and got.named >= frozenset.union(*ways)
        assert got.permitted == any(all(map(allowed, x)) for x in ways)
    for text in ("MIT AND", "MIT and or", "((MIT"):
        assert license_scan.evaluate(text, allowed).required == {"mit"}
    assert license_scan.evaluate("", allowed) is None and license_scan.evaluate(") AND", allowed) is None


def test_and_and_or_show_in_the_output(spark):
    tags = ["MIT OR GPL-2.0", "MIT AND GPL-2.0", "GPL-2.0 WITH Classpath-exception-2.0", "MIT\nthe MIT License"]
    rows = license_scan.scan_licenses(spark.createDataFrame([(k, f"x\n// SPDX-License-Identifier: {t}") for k, t in enumerate(tags)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["labels"], round(r["score"], 3), r["permitted"]) for r in rows] == [("gpl?,mit?", 0.333, True), ("gpl,mit", 0.5, False), ("gpl", 0.5, False), ("mit", 0.667, True)]


def test_languages_held_out(spark, documents, odd, none):
    found = asked(spark, "op7_language_id")
    assert found.keys() == documents.keys()
    right = total = 0
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if r["held_out"] and len(documents[i]["text"] or "") > 40:
            total += 1
            right += r["lang_pred"] == documents[i]["lang"]
    assert total > 100 and right >= 0.97 * total
    rows = {r["doc_id"]: r for r in language_id.identify(odd).collect()}
    assert rows[1]["lang_pred"] == rows[2]["lang_pred"] == rows[5]["lang_pred"] == "und" and rows[1]["score"] == 0
    assert language_id.identify(none).count() == 0


def test_languages_of_long_texts_and_of_none(spark):
    rows = [(k, "the cat sat on the mat " * 500, "en") for k in range(9)] + [(10 + k, "le chat est sur le tapis", "fr") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.training_sample(docs)
    assert {x for x, _ in sample} == {"en", "fr"} and max(len(t) for _, t in sample) == language_id.SAMPLE_CHARS
    assert all(r["lang_pred"] == ("en" if r["doc_id"] < 10 else "fr") for r in language_id.identify(docs).collect())
    bare = spark.createDataFrame([(1, "a word", None), (2, "123", None), (3, None, None), (None, "a word", None)], docs.schema)
    assert sorted(str(r["doc_id"]) for r in language_id.keep_identified(bare).collect()) == ["1", "None"]


def test_repeated_rows_do_not_hide_a_language(spark):
    for trial in range(3):
        rows = [(k, f"the {k} cats sat on mat {trial}", "en") for k in range(199)] + [(k, f"nur ein Satz, oft gesagt {trial}", "de") for k in range(1000, 21_000)]
        sample = language_id.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
        assert [t for x, t in sample if x == "de"] == [f"nur ein Satz, oft gesagt {trial}"]
    late = spark.createDataFrame([(k, "a" * 8000 * (k % 3) + f"end {k}", "en") for k in range(60)], "doc_id long, text string, lang string")
    assert {t[:3] for _, t in language_id.training_sample(late)} == {"aaa", "end"}  # all parts of long texts may be chosen
    assert len({x for x, _ in language_id.training_sample(spark.createDataFrame([(k, f"text {k}", f"l{k}") for k in range(50)], late.schema), languages=7)}) == 7


def test_tables_of_many_languages_stay_small():
    sample = [(f"l{k}", " ".join(f"{chr(97 + (k * j) % 26)}{chr(97 + (k // 26 + j) % 26)}{j % 7}" for j in range(300))) for k in range(200)]
    trees = language_id.Trees(sample)
    cells = sum(bits.size + escape.size for part in trees.parts for (_, bits), (_, escape) in zip(part.tables, part.escapes, strict=True))
    alone = sum(len(known) for lang in trees.languages for known, _ in language_id.Trees([x for x in sample if x[0] == lang]).tables)
    assert cells < 3 * language_id.TABLE_LANGUAGES * alone
    texts = [t[:200].encode() for _, t in sample[:5]]
    whole = trees.code_lengths(texts)
    assert whole.shape == (5, 200) and all(trees.languages[whole[k].argmin()] == sample[k][0] for k in range(5))
    few = language_id.Trees(sample[:3])
    assert whole[:, [trees.languages.index(x) for x in few.languages]] == pytest.approx(few.code_lengths(texts))


def test_many_languages_and_long_texts_in_pieces(spark, monkeypatch):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 20, f"l{k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.training_sample(docs, docs_in_all=10)
    held = {r["lang"] for r in docs.where(language_id.held_out(F.col("doc_id"))).collect()}
    assert {x for x, _ in sample} == {x for _, _, x in rows} - held and len(sample) == 300 - len(held)
    trees = language_id.Trees([("a", "some text in one language"), ("b", "und noch ein Text")])
    text = b"some words in one of the languages, " * 2000
    whole = trees.code_lengths([text, b"x"])
    monkeypatch.setattr(language_id, "PIECE_CELLS", 1 << 12)
    assert trees.code_lengths([text, b"x"]) == pytest.approx(whole, rel=1e-5)


def test_code_lengths_are_exact():
    sample = [("a", "abracadabra abra"), ("a", "cadab"), ("b", "xyzzy abc xyzé")]
    trees = language_id.Trees(sample, order=3)
    assert trees.languages == ["a", "b"]

    def bits(data, lang):
        from math import log2

        texts = [t.encode() for x, t in sample if x == lang]
        total = 0.0
        for i in range(len(data)):
            for k in range(min(3, i), -1, -1):
                context = data[i - k : i]
                after = Counter(t[j + k] for t in texts for j in range(len(t) - k) if t[j : j + k] == context)
                n, d = sum(after.values()), len(after)
                if n and after[data[i]]:
                    total += log2((n + d) / after[data[i]])
                    break
                total += log2((n + d) / d) if n else 0
            else:
                total += 8
        return total

    texts = [b"abra", b"", b"xyzzy abracad \xc3\xa9?", b"q"]
    got = trees.code_lengths(texts)
    for row, t in zip(got, texts, strict=True):
        assert list(row) == pytest.approx([bits(t, "a"), bits(t, "b")], rel=1e-5)


def edit_distance_within(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    best = min(row)
    return best, row.index(best)


def test_decontamination_against_dynamic_programming(spark, odd, none):
    import random

    rng = random.Random(5)
    letters = "abcdefgh "
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(30, 90))) for _ in range(6)]
    texts = []
    for k in range(60):
        item = list(rng.choice(base))
        for _ in range(rng.randint(0, 9)):
            at, kind = rng.randrange(len(item)), rng.random()
            item[at : at + (kind < 0.7)] = [] if kind < 0.3 else [rng.choice(letters)]
        noise = "".join(rng.choice(letters) for _ in range(80))
        texts.append((k, noise[:40] + "".join(item) + noise[40:]))
    docs = spark.createDataFrame([*texts, (None, None), (None, base[0]), (None, base[0])], "doc_id long, text string")
    items = spark.createDataFrame([*enumerate(base), (90, None), (91, ""), (92, "abc")], "item_id long, text string")
    found = Counter((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.contaminated(docs, items).collect())
    want = Counter()
    for i, t in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        if "abc" in decontaminate.fold(t).split(" "):
            want[i, 92, 0] += 1
        for j, b in enumerate(base):
            d, _ = edit_distance_within(decontaminate.fold(b), decontaminate.fold(t))
            if len(decontaminate.fold(b)) >= 24 and d <= int(0.08 * len(decontaminate.fold(b))):
                want[i, j, d] += 1
    assert found == want and len(want) > 10
    again = decontaminate.contaminated(docs, items, block_chars=100)
    assert Counter((r["doc_id"], r["item_id"], r["distance"]) for r in again.collect()) == want
    assert decontaminate.contaminated(none, items).count() == decontaminate.contaminated(docs, items.where("false")).count() == 0
    assert decontaminate.drop_contaminated(odd, items).count() == len(ODD)
    ends = spark.createDataFrame([(1, "ABC"), (2, "x, abc!"), (3, "xabc"), (4, "abcd abc x"), (5, "abc abd")], "doc_id long, text string")
    hits = decontaminate.contaminated(ends, spark.createDataFrame([(1, "abc")], "item_id int, text string")).collect()
    assert sorted((r["doc_id"], r["match_end"], r["short"]) for r in hits) == [(1, 3, True), (2, 5, True), (4, 8, True), (5, 3, True)]
    kept = decontaminate.drop_contaminated(ends, items, drop_short=True, block_chars=100)
    assert [r["doc_id"] for r in kept.collect()] == [3] and decontaminate.drop_contaminated(ends, items).count() == 5
    for r in decontaminate.contaminated(docs, items).where("not short").collect():
        t = decontaminate.fold(dict(texts).get(r["doc_id"], base[0]))
        assert edit_distance_within(decontaminate.fold(base[r["item_id"]]), t)[1] == r["match_end"]


def test_benchmark_passages_are_found(spark, documents):
    found = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op8_decontaminate"](spark, SF).collect()}
    items = {r["item_id"]: decontaminate.fold(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    whole = {(i, j) for i, d in documents.items() for j, t in items.items() if t in decontaminate.fold(d["text"])}
    assert len(whole) > 10 and whole <= found


@pytest.mark.parametrize(("name", "least"), [("license_base_places", 1000), ("verbatim_benchmark_items", 20)])
def test_parts_that_sql_can_say(spark, name, least):
    base = duckdb.connect()
    for table in ("documents", "benchmark"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = base.execute(queries.SQL[name])
    names = [x[0] for x in want.description]
    want = Counter(want.fetchall())
    got = queries.QUERIES[name](spark, SF)
    assert got.columns == names and Counter(map(tuple, got.collect())) == want and want.total() >= least
