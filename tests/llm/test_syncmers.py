from __future__ import annotations

import hashlib
import random

import numpy as np

from lodestone.llm import syncmers

SF = "/root/testdata/sf0.001"


def points(text: str) -> np.ndarray:
    return np.array([ord(c) for c in text], dtype=np.uint32)


def test_selection_depends_on_the_kmer_alone():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(500))
    whole, at, _ = syncmers.syncmers(points(text), np.array([0, len(text)]))
    found = set(zip(at.tolist(), whole.tolist(), strict=True))
    for i in range(len(text) - syncmers.K + 1):
        alone, _, _ = syncmers.syncmers(points(text[i : i + syncmers.K]), np.array([0, syncmers.K]))
        assert (len(alone) == 1) == any(a == i for a, _ in found)
        if len(alone):
            assert (i, int(alone[0])) in found


def test_texts_in_one_call_do_not_mix():
    texts = ["short", "a longer text with some words in it", "", "another text that is here as well"]
    offsets = np.cumsum([0, *map(len, texts)])
    together = syncmers.fingerprints(points("".join(texts)), offsets)
    alone = [syncmers.fingerprints(points(t), np.array([0, len(t)]))[0] for t in texts]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(together, alone, strict=True))


def test_likeness():
    rng = random.Random(2)
    a = "".join(rng.choice("abcdefgh ") for _ in range(2_000))
    b = "".join(rng.choice("abcdefgh ") for _ in range(2_000))
    fp = lambda t: syncmers.fingerprints(points(t), np.array([0, len(t)]))[0]
    assert syncmers.likeness(fp(a), fp(a)) == 1
    assert syncmers.likeness(fp(a), fp(b)) < 0.05
    assert syncmers.likeness(fp(a), fp(a[:1500] + b[:500])) > 0.4
    assert syncmers.likeness(fp(""), fp("")) == 1
    assert syncmers.likeness(fp(""), fp(a)) == 0
    assert syncmers.likeness(fp(a), fp(a[1000:] + a[:1000])) < 0.8  # the same anchors in another order


def check(rows, found):
    """Against slices in Python, rows in the order of the operator."""
    texts = [t or "" for _, t in rows]
    assert len(found) == len(rows)
    for i, r in enumerate(found):
        t, follow = texts[i], texts[(i + 1) % len(texts)]
        m = len(t) // 4
        edited = t[: len(t) - m] + follow[:m]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["edited_fingerprint"] == syncmers.fingerprints(points(edited), np.array([0, len(edited)]))[0].tobytes().hex()
        assert 0 <= r["near_edited"] <= 1
        assert 0 <= r["near_next"] <= 1


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    found = sorted(syncmers.compare_edits(docs).collect(), key=lambda r: r["doc_id"])
    check(rows, found)
    assert np.mean([r["near_edited"] for r in found]) > 0.4
    assert np.mean([r["near_next"] for r in found]) < 0.1


def test_edge_cases(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (5, "é😀" * 30), (9, "x" * 50_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(rows, sorted(syncmers.compare_edits(frame).collect(), key=lambda r: r["doc_id"]))
    assert syncmers.compare_edits(frame.limit(0)).count() == 0
    single = syncmers.compare_edits(spark.createDataFrame([(7, "alone here")], "doc_id long, text string")).collect()
    check([(7, "alone here")], single)
    many = spark.createDataFrame([(4, "same"), (4, "same"), (None, "last"), (None, None)], "doc_id long, text string")
    assert syncmers.compare_edits(many).count() == 4
    assert [len(r["fingerprint"]) for r in syncmers.compare_edits(many).where("doc_id = 4").collect()] == [16, 16]


def plain_mix(x):
    m = (1 << 64) - 1
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
    return x ^ (x >> 31)


def test_closed_syncmers_by_definition():
    """A k-mer is one if the least of its inner s-mers' hashes is its first or its last."""
    rng = random.Random(3)
    k, s, m = syncmers.K, syncmers.S, 1 << 64
    base = [pow(0xD6E8FEB86659FD93, i, m) for i in range(s)]
    for text in ("".join(rng.choice("abcdé😀 ") for _ in range(300)), "ab" * 40, "a" * 30, "short"):
        inner = [plain_mix(sum((ord(text[i + j]) + 1) * 0x9E3779B97F4A7C15 * base[j] for j in range(s)) % m) for i in range(max(0, len(text) - s + 1))]
        wanted = [i for i in range(len(text) - k + 1) if min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])]
        assert syncmers.syncmers(points(text), np.array([0, len(text)]))[1].tolist() == wanted


def test_anchors_follow_the_length():
    """One in SHARE of a long text's anchors, all of a short one's; likeness is then that of the whole sets."""
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(60_000))
    fp = lambda t: syncmers.fingerprints(points(t), np.array([0, len(t)]))[0]
    hashes, _, _ = syncmers.syncmers(points(text), np.array([0, len(text)]))
    own = fp(text)
    assert len(own) == -(-len(hashes) // syncmers.SHARE)
    assert set(own["hash"].tolist()) == set(sorted(set(hashes.tolist()))[: len(own)])
    other = text[:45_000] + "".join(rng.choice("abcdefgh ") for _ in range(15_000))
    a, b = (set(syncmers.syncmers(points(t), np.array([0, len(t)]))[0].tolist()) for t in (text, other))
    assert abs(syncmers.likeness(own, fp(other)) - len(a & b) / len(a | b)) < 0.06
    short = text[:100]
    assert len(fp(short)) == min(syncmers.ANCHORS, len(set(syncmers.syncmers(points(short), np.array([0, 100]))[0].tolist())))
    assert syncmers.likeness(fp(short), fp(short + text[:200])) <= 1
