from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import language_id
from lodestone.llm.bytewise import text_buffers
from lodestone.llm.shared import checksum

SF = "/root/testdata/sf0.001"


def plain_phrases(sample: bytes, text: bytes, block: int) -> int:
    """Longest matches by substring search."""
    fold = lambda b: bytes(language_id._CLASS[np.frombuffer(b, np.uint8)]) if b else b""
    known, n = fold(sample), 0
    for start in range(0, len(text), block):
        part, at = fold(text[start : start + block]), 0
        while at < len(part):
            size = 1
            while at + size < len(part) and part[at : at + size + 1] in known and part[at : at + size] in known:
                size += 1
            at += size
            n += 1
    return n


@pytest.mark.parametrize("seed", range(4))
def test_phrases_match_substring_search(seed):
    rng = random.Random(seed)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    model = (("a", word(300, "abc é").encode()), ("b", word(200, "bcd.").encode()))
    texts = ["", "a", word(700, "abcdé ."), word(40, "xyz"), word(90, "abc")]
    data, offsets = text_buffers(pa.array(texts))
    found = language_id.phrases(model, data, offsets, 64)
    for k, (_, sample) in enumerate(model):
        assert found[k].tolist() == [plain_phrases(sample, t.encode(), 64) for t in texts]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = checksum("doc_id", 4) == 2
    model = language_id.fit(docs, ~held, "text", "lang", "doc_id")
    rows = language_id.identify(docs, model).where(held).select("lang", "lang_pred", "score").collect()
    assert rows
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edge_cases(spark):
    model = (("x", b"hello there"), ("y", b"bonjour"))
    rows = [(1, None, "q"), (2, "", "q"), (3, "123 !?", "q"), (4, "Hello", "q"), (4, "Hello", "q"), (None, "日本", "q"), (5, "hello there " * 20_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    found = language_id.identify(docs, model).collect()
    assert [r["lang_pred"] for r in found[:5]] == ["und", "und", "und", "x", "x"]
    assert found[5]["lang_pred"] in ("x", "y")
    assert found[6]["lang_pred"] == "x"
    assert language_id.identify(docs.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, ()).collect()} == {"und"}
    assert language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True), "text", "lang", "doc_id") == ()
    assert language_id.identify(docs, model[:1]).where("doc_id = 4").first()["score"] == 1


def test_fit_is_bounded_and_repeats(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * 50, "ab"[i % 2]) for i in range(400)], "doc_id long, text string, lang string")
    a = language_id.fit(docs, F.lit(True), "text", "lang", "doc_id", chars=1_000, texts=8)
    assert [len(t) for _, t in a] == [1_000, 1_000]
    assert a == language_id.fit(docs.orderBy(F.desc("doc_id")), F.lit(True), "text", "lang", "doc_id", chars=1_000, texts=8)


@pytest.mark.parametrize("seed", range(4))
def test_whole_texts_are_parsed_as_one(seed):
    """Whatever the block, down to blocks that are shorter than phrases."""
    rng = random.Random(10 + seed)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    sample = word(200, "ab ")
    model = (("a", sample.encode()), ("b", word(200, "bcd.").encode()))
    texts = ["", "a", word(700, "abcdé ."), sample * 3, word(90, "ab"), sample[7:60]]
    data, offsets = text_buffers(pa.array(texts))
    for block in (5, 64, 10_000):
        found = language_id.phrases(model, data, offsets, block, whole=True)
        for k, (_, known) in enumerate(model):
            assert found[k].tolist() == [plain_phrases(known, t.encode(), 1 << 30) for t in texts]


def test_long_labelled_texts_are_sampled_all_over(spark):
    text = "".join(f"{i:04d} " for i in range(2_000))
    docs = spark.createDataFrame([(1, text, "a"), (2, "short", "b")], "doc_id long, text string, lang string")
    (_, a), (_, b) = language_id.fit(docs, F.lit(True), "text", "lang", "doc_id", chars=1_000)
    assert b == b"short\n"
    assert len(a) <= 1_000
    assert text[:20] in a.decode()
    assert text[-20:].strip() in a.decode()
