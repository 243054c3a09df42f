from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lodestone.llm import packing
from lodestone.llm.bytewise import text_buffers

SF = "/root/testdata/sf0.001"
ODD = ["", "  \n\n ", "A b\x1cC's <|endoftext|> x<|startoftext|>y\té é ́z", "ΣΑΣ ΣΑΣ b\x85c", "Éa, éa. Ab., ab.. ÿß µm ªº x" + "a" * 300, "The THE tHe\x0b\x0c \r", "it's we're 12345 日本語 😀"]


def test_ids_are_those_of_the_tokenizer(spark):
    path = packing.tokenizer_path()
    own, plain = packing.Encoder(path, most=500), Tokenizer.from_file(path)
    texts = ODD + [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for _ in range(2):  # the second time from the store
        ids, sizes = own.encode(*text_buffers(pa.array(texts)))
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        assert [p.tolist() for p in parts] == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]


def check(spark, rows, capacity=4096, group=3_000):
    plain = Tokenizer.from_file(packing.tokenizer_path())
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    out = packing.pack(packing.pieces(docs, packing.tokenizer_path(), capacity=capacity), len(rows), capacity, group).collect()
    wanted = []
    for k, t, _ in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        wanted += [(k, i, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for i, s in enumerate(range(0, len(ids), capacity))]
    assert sorted(tuple(r)[:5] for r in out) == sorted(wanted)
    used = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= capacity for n in used.values())
    return len(used), -(-sum(w[3] for w in wanted) // capacity)


def test_documents(spark):
    rows = [(r["doc_id"], r["text"], "clash") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sequences, bound = check(spark, rows)
    assert sequences <= bound + 1


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "word " * 20_000, "x"), (4, "a b c", "x"), (5, "😀" * 300, "x"), (6, "w" * 9_000, "x")]
    check(spark, rows)
    check(spark, rows, capacity=7, group=50)
    assert packing.pack(packing.pieces(spark.createDataFrame([], "doc_id long, text string"), packing.tokenizer_path()), 0).count() == 0
    twice = packing.pack(packing.pieces(spark.createDataFrame([(1, "a b")] * 2, "doc_id long, text string"), packing.tokenizer_path()), 2).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in twice}) == 2


def fewest(lengths, capacity):
    """The least number of bins, by trying all."""
    for n in range(1, len(lengths) + 1):
        for places in itertools.product(range(n), repeat=len(lengths)):
            if all(sum(x for x, p in zip(lengths, places, strict=True) if p == b) <= capacity for b in range(n)):
                return n
    return 0


@pytest.mark.parametrize("seed", range(12))
def test_small_packings_are_optimal(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 20) for _ in range(7)]
    out = packing.bin_completion(lengths, 20)
    assert sorted(sum(out, [])) == sorted(lengths)
    assert max(map(sum, out)) <= 20
    assert len(out) == fewest(lengths, 20)


def test_completion_beats_best_fit():
    """Best fit needs four bins; 7 + 3, 6 + 4, 5 + 5 fill three."""
    lengths = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6] * 2
    best, found = packing.best_fit(lengths, 60), packing.bin_completion(lengths, 60)
    assert len(found) <= len(best)
    assert sorted(sum(found, [])) == sorted(lengths)


def undominated(items, room):
    """All fillings that none dominates, by trying all sets: another length in place of some that fit into it, or beside them."""
    out = set()
    for m in range(1, len(items) + 1):
        for own in itertools.combinations(range(len(items)), m):
            left = room - sum(items[i] for i in own)
            if left < 0:
                continue
            swaps = ((items[j], sum(items[i] for i in q), len(q)) for j in range(len(items)) if j not in own for k in range(m + 1) for q in itertools.combinations(own, k))
            if not any(gone <= x and x - gone <= left and not (k == 1 and gone == x) for x, gone, k in swaps):
                out.add(tuple(sorted((items[i] for i in own), reverse=True)))
    return out


@pytest.mark.parametrize("seed", range(25))
def test_fillings_hold_all_undominated_ones(seed):
    rng = random.Random(seed)
    items, room = [rng.randrange(1, 15) for _ in range(7)], rng.randrange(5, 25)
    found = [x for x in packing.fillings(np.bincount(items, minlength=40), room) if x]
    assert all(waste == room - sum(used) >= 0 for waste, used in found)
    names = [tuple(sorted(used, reverse=True)) for _, used in found]
    assert len(names) == len(set(names))
    assert undominated(items, room) <= set(names)


def test_excess_over_the_bound():
    """Lengths like those of documents meet the bound; lengths of which few fit beside each other cannot."""
    rng = random.Random(7)
    lengths = [min(4095, max(2, int(rng.lognormvariate(6, 1)))) for _ in range(3_000)]
    assert len(packing.bin_completion(lengths, 4096)) == -(-sum(lengths) // 4096)
    middle = [rng.randrange(1000, 2000) for _ in range(400)]
    assert len(packing.bin_completion(middle, 4096)) <= len(packing.best_fit(middle, 4096))


def test_equal_rows_are_spread(spark):
    docs = spark.createDataFrame([(1, "a b")] * 40 + [(2, "c")], "doc_id long, text string").coalesce(1)
    parts = packing.pieces(docs, packing.tokenizer_path())
    assert sorted(r["copy"] for r in parts.where("doc_id = 1").collect()) == list(range(40))
    assert packing.pack(parts, 41).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
