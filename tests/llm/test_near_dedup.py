from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

from lodestone.llm import near_dedup

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain(rows):
    """All pairs, by id: (set size, component)."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= 85 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)), key=lambda k: rows[k][0])
            if a != b:
                root[b] = a
    return sorted((k, len(s), rows[find(i)][0]) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True)))


def found(spark, rows):
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert found(spark, rows) == plain(rows)


def edited(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10_000)}"
    return " ".join(out)


@pytest.mark.parametrize(("seed", "size"), [(1, 120), (2, 30), (3, 400)])
def test_chains_of_edits(spark, seed, size):
    """Copies of copies: links form chains whose ends are unlike; some pairs lie close to the threshold."""
    rng, rows = random.Random(seed), []
    for base in range(6):
        words = [f"b{base}x{rng.randrange(500)}" for _ in range(size)]
        text = " ".join(words)
        for _ in range(12):
            rows.append((len(rows), text))
            text = edited(rng, text.split(), rng.randrange(0, max(2, size // 40)))
    rng.shuffle(rows)
    assert found(spark, rows) == plain(rows)


def test_a_large_group_is_compared_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "GROUP", 8)
    rng = random.Random(9)
    words = [f"x{i}" for i in range(150)]
    rows = [(i, edited(rng, words, rng.randrange(0, 4))) for i in range(60)]
    assert found(spark, rows) == plain(rows)


def test_joins_by_shuffle_give_the_same(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"x{i}" for i in range(80)]
    rows = [(i, edited(rng, words, 1 if i % 2 else 40)) for i in range(20)]
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", -1)
    assert found(spark, rows) == plain(rows)


def test_edge_cases(spark):
    rows = [(1, "a b"), (2, "A  B\n"), (3, "b a"), (4, None), (5, ""), (6, " \n"), (7, "one"), (8, "w " * 30_000), (9, "w " * 30_001), (10, "É x"), (11, "é x"), (12, "x\x1cy"), (13, "x y")]
    assert found(spark, rows) == plain(rows)
    twice = found(spark, [(1, "same text here for all"), (1, "same text here for all"), (2, "same text here for all")])
    assert twice == [(1, 1, 1), (1, 1, 1), (2, 1, 1)]
    null = near_dedup.near_duplicates(spark.createDataFrame([(None, "a b"), (2, "a b")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in null} == {(None, None, True), (2, 2, True)}
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimates_follow_likeness():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.85, 0.95):
        errors = []
        for _ in range(40):
            pool = rng.permutation(np.unique(rng.integers(0, 1 << 64, 3_000, dtype=np.uint64)))
            common, rest = pool[: int(1_000 * share)], pool[1_000:]
            apart = (1_000 - len(common)) // 2
            a, b = np.sort(np.append(common, rest[:apart])), np.sort(np.append(common, rest[apart : 2 * apart]))
            regs = near_dedup.registers([a, b])
            errors.append(near_dedup.estimate(regs[0], regs[1:])[0] - len(common) / (len(common) + 2 * apart))
        assert abs(np.mean(errors)) < 0.03
        assert np.max(np.abs(errors)) < near_dedup.MARGIN


def test_large_bands_of_unlike_families(spark, monkeypatch):
    """Families of near copies that share much, but not enough, and texts that belong to none: no link is lost."""
    monkeypatch.setattr(near_dedup, "GROUP", 8)
    rng, rows = random.Random(11), []
    words = [f"x{i}" for i in range(200)]
    for family in range(3):
        base = [*words[:170], *(f"f{family}w{i}" for i in range(30))]
        rows += [(len(rows) + i, edited(rng, base, rng.randrange(0, 3))) for i in range(18)]
    rows += [(len(rows) + i, edited(rng, words, 12)) for i in range(14)]
    rng.shuffle(rows)
    assert found(spark, rows) == plain(rows)


def test_unique_rows(spark):
    """Rows are told apart by id and text: none of its own is lost, none that repeats another stays."""
    long = " ".join(f"w{i}" for i in range(100))
    near = long.replace("w7 ", "other ")
    rows = [(1, "a b c", "x"), (2, "A b  c", "y"), (2, "wholly different text it is", "z"), (3, long, "p"), (3, long, "p"), (4, near, "q"), (4, near + " more", "r"), (5, None, "s"), (5, "", "t"), (None, long, "u"), (6, "wholly different text it is", "v")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = near_dedup.unique(frame)
    assert kept.columns == frame.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a b c", "x"), (2, "wholly different text it is", "z"), (3, long, "p"), (5, None, "s"), (5, "", "t"), (None, long, "u")], key=str)
    assert near_dedup.unique(frame.limit(0)).count() == 0
    single = frame.where("doc_id in (1, 3)").limit(2)
    assert near_dedup.unique(single).count() == 2
