"""The pipeline against plain Python over the smallest tables."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from panelforge.llm import decontaminate, language_id, mixing
from tests.llm.test_jaccard_join import brute
from tests.llm.test_scans import WORD, base_secrets, targets

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    items = [t for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(t := decontaminate.fold(r["text"])) >= 24]
    trees = language_id.fitted(language_id.training_sample(docs))

    def known(text):
        data = text.encode()
        bits = trees.code_lengths([data])[0]
        return bits.min() <= (trees.rates[bits.argmin()] + 8) / 2 * len(data) + 64

    left = {i for i, r in rows.items() if re.search(r"[^\W\d_]", r["text"] or "") and known(r["text"])}
    groups = brute([(i, rows[i]["text"]) for i in left])
    left = {i for i in left if groups[i][1] == i}
    left = {i for i in left if not any(decontaminate.best_match(t, decontaminate.fold(rows[i]["text"]), int(0.08 * len(t))) for t in items)}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == left and len(left) < len(rows)

    texts = {}
    for i in left:
        text, upto, out = rows[i]["text"], 0, []
        for _, a, b in sorted((int(x.split(":")[1]), int(x.split(":")[1]), int(x.split(":")[2])) for x in base_secrets(text)):
            if a >= upto:
                out += [text[upto:a], "[secret]"]
            upto = max(upto, b)
        texts[i] = "".join([*out, text[upto:]])
    assert all(r["text"] == texts[i] and r["lang"] == rows[i]["lang"] for i, r in got.items())
    sizes, taken = Counter(), Counter()
    for i, r in got.items():
        assert r["size"] == len(WORD.findall(texts[i]))
        sizes[rows[i]["source"]] += r["size"]
        taken[rows[i]["source"]] += r["taken"]
    assert all(abs(taken[s] - t) <= 1 for s, t in targets(sizes).items())

    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == list(rows[0].asDict())
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == texts


def test_odd_rows_pass_every_stage(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long, size string, row int, blob string, component_id int, _text string, `a.b` string, `c``d` int, target string"
    odd = [(None, "some words here", None, None, None), (None, "some words here", None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "x " * 400_000, "en", "b", 8000), (3, "x " * 400_000, "en", "b", 8000), (4, "123", "en", "b", 3), (5, "token = abcdefgh", "en", "b", 3)]
    odd += [(100 + k, f"some words here and {k} token", "en", "c", 9) for k in range(4)]
    docs = spark.createDataFrame([(*r, "clash", k, "b", k, "t", "dotted", k, "mine") for k, r in enumerate(odd)], columns)
    names, empty = docs.columns, docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs, empty = stage(spark, docs, SF), stage(spark, empty, SF)
        assert empty.count() == 0
        assert docs.columns == names or name == "mixing"
    assert set(names) < set(docs.columns) and len(set(docs.columns)) == len(docs.columns)
    got = sorted((str(r["doc_id"]), r["mix_size"], r["text"][:8], r["blob"], r["size"], r["a.b"], r["target"]) for r in docs.collect() if r["source"] != "c")
    mine = ("b", "clash", "dotted", "mine")
    assert got == [("3", 400_000, "x x x x ", *mine), ("5", 1, "[secret]", *mine), ("None", 3, "some wor", *mine)]


def test_foreign_scripts_and_noise_go_and_prose_stays(spark):
    prose = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(3)
    odd = [(10**6, "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(300))), (10**6 + 1, "".join(chr(rng.randrange(33, 127)) for _ in range(400))), (10**6 + 2, "Ja."), (10**6 + 3, "12 %%")]
    more = prose.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(odd, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")))
    kept = {r["doc_id"] for r in language_id.keep_identified(more).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in prose.collect()} | {10**6 + 2}


def test_mix_of_texts_of_one_id_is_repeatable(spark):
    rows = [(1, f"{chr(97 + k % 26)}{k} two three", "a") for k in range(40)] + [(2, "one " * 300, "b")]
    seen = set()
    for parts in (1, 2, 3, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        seen.add(tuple(sorted((r["text"], r["taken"]) for r in mixing.mix(docs, carry=("text",)).collect())))
    assert len(seen) == 1
