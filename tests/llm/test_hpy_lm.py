from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import hpy_lm
from lodestone.llm.bytewise import text_buffers
from lodestone.llm.shared import checksum

SF = "/root/testdata/sf0.001"


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))) + [None]


def check_base(rows, found, learns):
    counts = collections.Counter()
    for k, t in rows:
        if learns(k):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert len(found) == len(rows)
    for r in found:
        t = next(t for k, t in rows if k == r["doc_id"])
        own = tokens(t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in counts for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel=1e-9)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = hpy_lm.score(docs, checksum("doc_id", 10) != 0, rows_a_block=60).collect()
    check_base(rows, found, lambda k: zlib.crc32(str(k).encode()) % 10 != 0)
    held = [r for r in found if not r["training"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_edge_cases(spark):
    rows = [(5, "abc ABC"), (6, None), (7, ""), (8, "word " * 30_000), (9, "x\x0by\x0cz")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("training", F.lit("clash"))
    check_base(rows, hpy_lm.score(frame, F.col("doc_id") != 9).collect(), lambda k: k != 9)
    check_base(rows, hpy_lm.score(frame, F.lit(False)).collect(), lambda k: False)
    assert hpy_lm.score(frame.limit(0), F.lit(True)).count() == 0


def test_probabilities_sum_to_one(spark):
    """Over the known words, the end and one unknown word: of single words, and after the one context, `a`."""
    words = ["a", "b", "c", "d"]
    train = [(i, " ".join(["a", *(words[(i * j) % 4] for j in range(1, 30))])) for i in range(1, 40)]
    texts = ["", *words, "new", *(f"a {w}" for w in [*words, "new"])]
    frame = spark.createDataFrame(train + list(enumerate(texts, 1_000)), "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in hpy_lm.score(frame, F.col("doc_id") < 1_000, contexts=1, rows_a_block=10).collect()}
    p = {t: 10 ** scores[i] for i, t in enumerate(texts, 1_000)}
    end = p[""]
    single = {w: p[w] / end for w in ("b", "c", "d", "new")}
    first = 1 - sum(single.values()) - end  # of `a`; its own text also holds the end after `a`
    assert 0.2 < first < 0.5
    after = {w: p[f"a {w}"] / end for w in ("b", "c", "d", "new")} | {"": p["a"], "a": p["a a"] / (p["a"] / first)}
    assert sum(after.values()) == pytest.approx(first, rel=1e-6)


def test_every_word_is_a_context(spark):
    """200 words, each always followed by one of 200 others: all of them tell what follows, however many there are."""
    train = [(i, f"w{i % 200} s{i % 200}") for i in range(1_000)]
    held = [(1_000 + i, f"w{i} s{i}") for i in range(200)] + [(2_000 + i, f"w{i} s{(i + 1) % 200}") for i in range(200)]
    frame = spark.createDataFrame(train + held, "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in hpy_lm.score(frame, F.col("doc_id") < 1_000, rows_a_block=300).collect()}
    assert all(scores[1_000 + i] > scores[2_000 + i] + 1 for i in range(200))


def test_stirling_draws():
    """The number of tables of c customers, against weights counted over all seatings."""
    rng = np.random.default_rng(1)
    c, weight, d = 6, 0.7, hpy_lm.DISCOUNT[0]
    exact = np.zeros(c + 1)

    def seat(tables, chance):
        if sum(tables) == c:
            exact[len(tables)] += chance
            return
        seat([*tables, 1], chance * weight)
        for i, n in enumerate(tables):
            seat([*tables[:i], n + 1, *tables[i + 1 :]], chance * (n - d))

    seat([1], weight)
    drawn = np.bincount(hpy_lm.draw_tables(np.full(40_000, c), np.full(40_000, weight), 0, rng), minlength=c + 1) / 40_000
    assert np.abs(drawn - exact / exact.sum()).max() < 0.01
    many = hpy_lm.draw_tables(np.array([1, 10_000]), np.array([0.5, 0.5]), 0, rng)
    assert many[0] == 1
    assert 1 <= many[1] <= 10_000


def plain_model(texts, learn, discounts, strengths, sweeps, burn_in, seed=1):
    """Averaged predictive probabilities (context, word) by seating every customer anew, one at a time."""
    rng = random.Random(seed)
    vocabulary = {w for t in learn for w in tokens(t)}

    class Restaurant:
        def __init__(self, parent, d, s):
            self.parent, self.d, self.s, self.tables = parent, d, s, collections.defaultdict(list)

        def base(self, w):
            return self.parent.chance(w) if self.parent else 1 / (len(vocabulary) + 1)

        def chance(self, w):
            n, t = sum(map(sum, self.tables.values())), sum(map(len, self.tables.values()))
            own = self.tables.get(w, [])
            return (sum(own) - self.d * len(own) + (self.s + self.d * t) * self.base(w)) / (self.s + n)

        def enter(self, w):
            own = self.tables[w]
            weights = [x - self.d for x in own] + [(self.s + self.d * sum(map(len, self.tables.values()))) * self.base(w)]
            at = rng.choices(range(len(weights)), weights)[0]
            if at < len(own):
                own[at] += 1
            else:
                own.append(1)
                if self.parent:
                    self.parent.enter(w)

        def leave(self, w):
            own = self.tables[w]
            at = rng.choices(range(len(own)), own)[0]
            own[at] -= 1
            if not own[at]:
                own.pop(at)
                if self.parent:
                    self.parent.leave(w)

    root = Restaurant(None, discounts[1], strengths[1])
    contexts = {}
    customers = []
    for t in learn:
        own = tokens(t)
        for i, w in enumerate(own):
            where = contexts.setdefault(own[i - 1], Restaurant(root, discounts[0], strengths[0])) if i else root
            customers.append((where, w))
            where.enter(w)
    total = [[0.0] * len(tokens(t)) for t in texts]
    for sweep in range(sweeps):
        for where, w in customers:
            where.leave(w)
            where.enter(w)
        if sweep >= burn_in:
            for t, sums in zip(texts, total, strict=True):
                own = tokens(t)
                for i, w in enumerate(own):
                    where = contexts.get(own[i - 1], Restaurant(root, discounts[0], strengths[0])) if i else root
                    sums[i] += where.chance(w) / (sweeps - burn_in)
    return [sum(map(math.log10, x)) for x in total]


def sweeps_in_one_place(texts, learn, sweeps, burn_in, seed=11):
    """The operator's sweeps over all pairs at once, without blocks, shards or messages; scores of the texts."""
    words, before, _ = hpy_lm.tokens(*text_buffers(pa.array(learn)))
    known, place, count = np.unique(words, return_inverse=True, return_counts=True)
    at = np.flatnonzero(before != 0)
    keys, n = np.unique(place[at - 1] * len(known) + place[at], return_counts=True)
    context, word = keys // len(known), keys % len(known)
    direct = count - np.bincount(word, weights=n, minlength=len(known)).astype(np.int64)
    own, total = hpy_lm.mix(known + np.uint64(seed)), len(known)
    served_by = lambda t: direct + np.bincount(word, weights=t, minlength=total).astype(np.int64)
    after = lambda served, base, sweep: hpy_lm._Parent(total, int(served.sum()), int(base.sum()), float(hpy_lm._masses(known, served, base, seed, sweep).sum()), seed, sweep)
    t = np.ones(len(keys), dtype=np.int64)
    served = served_by(t)
    base = (served > 0).astype(np.int64)
    parent = after(served, base, 0)
    (d1, d0), (s1, _) = hpy_lm.DISCOUNT, hpy_lm.STRENGTH
    sums = [np.zeros(len(tokens(x))) for x in texts]
    for sweep in range(1, sweeps + 1):
        chance = parent.chances(hpy_lm._masses(known, served, base, seed, sweep - 1))
        held = np.bincount(context, weights=t, minlength=total)
        room = d1 * hpy_lm.gamma(s1 / d1 + held, own, 8 * sweep + 2)
        t = hpy_lm.draw_tables(n, room[context] * chance[word], 0, None, hpy_lm.pairs(known[context], known[word]) + np.uint64(seed), 8 * sweep)
        served = served_by(t)
        base = hpy_lm._seated(known, served, parent, seed, sweep)
        parent = after(served, base, sweep)
        if sweep > burn_in:
            held = np.bincount(context, weights=t, minlength=total)
            single = parent.predictive(np.append(served - d0 * base, 0.0))  # the last one is of an unknown word
            of_pair = dict(zip(keys.tolist(), (n - d1 * t).tolist(), strict=True))
            for x, out in zip(texts, sums, strict=True):
                w, _, _ = hpy_lm.tokens(*text_buffers(pa.array([x])))
                spots = [int(np.searchsorted(known, h)) if h in known else total for h in w]
                for i, q in enumerate(spots):
                    p = single[q]
                    if i and spots[i - 1] < total:
                        c = spots[i - 1]
                        p = (of_pair.get(c * total + q, 0.0) * (q < total) + (s1 + d1 * held[c]) * p) / (s1 + count[c])
                    out[i] += p / (sweeps - burn_in)
    return [float(np.log10(x).sum()) for x in sums]


def small_corpus():
    rng = random.Random(6)
    learn = [" ".join(rng.choices(["a", "b", "c", "d", "e", "f"], [9, 5, 3, 2, 1, 1], k=rng.randrange(3, 14))) for _ in range(30)]
    return learn, ["a b a", "b", "c d e f", "", "new a new", "f f f a"]


def test_sweeps_give_the_law_of_single_seatings():
    """Long runs of both samplers come to the same averaged probabilities."""
    learn, texts = small_corpus()
    wanted = plain_model(texts, learn, hpy_lm.DISCOUNT, hpy_lm.STRENGTH, 1_500, 100)
    found = sweeps_in_one_place(texts, learn, 3_000, 200)
    for t, x, y in zip(texts, found, wanted, strict=True):
        assert x == pytest.approx(y, abs=0.02 * len(tokens(t)))


def test_blocks_and_shards_give_the_same_sweeps(spark):
    learn, texts = small_corpus()
    wanted = sweeps_in_one_place(texts, learn, 4, 2)
    frame = spark.createDataFrame(list(enumerate(learn)) + list(enumerate(texts, 1_000)), "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in hpy_lm.score(frame, F.col("doc_id") < 1_000, sweeps=4, burn_in=2, rows_a_block=7, tokens_a_shard=100).collect()}
    assert [found[1_000 + i] for i in range(len(texts))] == pytest.approx(wanted, abs=1e-5)


def test_scores_do_not_depend_on_blocks_or_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 3000")
    score = lambda **how: {r["doc_id"]: r["score"] for r in hpy_lm.score(docs, checksum("doc_id", 10) != 0, sweeps=2, burn_in=1, **how).collect()}
    one, many = score(), score(rows_a_block=17, tokens_a_shard=9_000)
    assert set(one) == set(many)
    assert max(abs(one[k] - many[k]) for k in one) < 1e-4


def test_gamma_and_poisson_variates():
    keys = hpy_lm.mix(np.arange(60_000, dtype=np.uint64))
    for shape in (0.3, 1.0, 7.5):
        x = hpy_lm.gamma(np.full(len(keys), shape), keys, 3)
        assert x.mean() == pytest.approx(shape, rel=0.03)
        assert x.var() == pytest.approx(shape, rel=0.06)
    for rate in (0.2, 6.0, 50.0):
        x = hpy_lm._poisson(np.full(len(keys), rate), keys, 1)
        assert x.mean() == pytest.approx(rate, rel=0.03)
        assert x.var() == pytest.approx(rate, rel=0.05)


@pytest.mark.parametrize("level", [0, 1])
@pytest.mark.parametrize("weight", [0.05, 1.0, 20.0, 200.0, 2_000.0])
def test_dishes_with_many_customers(weight, level, monkeypatch):
    """More customers than EXACT: mean and deviation of the number of tables, against the exact conditional."""
    c = 400
    t = np.arange(1, c + 1)
    score = np.log(weight) * t + hpy_lm._log_stirling(level)[c, 1 : c + 1]
    p = np.exp(score - score.max())
    p /= p.sum()
    mean = (p * t).sum()
    monkeypatch.setattr(hpy_lm, "EXACT", 48)
    drawn = hpy_lm.draw_tables(np.full(20_000, c), np.full(20_000, weight), level, np.random.default_rng(2))
    assert drawn.mean() == pytest.approx(mean, rel=0.04)
    assert drawn.std() == pytest.approx(math.sqrt((p * (t - mean) ** 2).sum()), rel=0.12)
    assert 1 <= drawn.min() <= drawn.max() <= c
