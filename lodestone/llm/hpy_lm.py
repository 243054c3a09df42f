"""A hierarchical Pitman-Yor language model, learned and applied block by block.

Every word that comes before others is a restaurant of its own; all of them share one parent, the restaurant of single
words, whose base measure is uniform over the known words and one unknown word. The numbers of tables are sampled by
blocked Gibbs sweeps over the whole corpus: given the parent's probabilities of words and one gamma variate a
restaurant, which stands for its total of tables, the tables of all dishes are independent, so that shards draw theirs
side by side and exchange true totals before the next sweep. Every draw is keyed by a hash of its n-gram and sweep, so
that results don't depend on how rows are dealt. Each sample's predictive probabilities are averaged.

Texts are tokenised into blocks, which are written once. A block sends each shard the n-grams it needs with their
training counts, as one binary row, and gets back their part of the probabilities in the same order: no row for each
n-gram is ever shuffled. A pair lies in the shard of its second word, or, where that is one of the corpus's most
frequent words, in the shard of its first: no shard grows with the share of a word. Blocks and what shards keep are
bucketed tables in the shared folder, so that sweeps and the last pass shuffle only what is exchanged. A block writes to
those shards that hold some of its words: their rows are at most as many as its n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bytewise import U64, Words, batches, chunks, mix, release, text_buffers
from lodestone.llm.shared import cut, cut_in_buckets, small_batches

#: Discounts and strengths of the restaurants of contexts and of their parent.
DISCOUNT, STRENGTH = (0.8, 0.7), (1.0, 10.0)
END = U64(0x5BF03635F0A31C49)
_PAIR = U64(0x9FB21C651E98DF25)
#: Up to so many customers a dish's tables come from the exact conditional; beyond it from its saddle-point approximation.
EXACT = 512
#: Words with a greater share of the tokens have their pairs dealt by the other word. It changes no result.
FREQUENT = 1 / 2048
_KINDS = (np.uint64, np.int64, np.int32, np.float32, np.float64, np.uint8)


def _stirling(discount: float, most: int) -> np.ndarray:
    """log of the generalised Stirling numbers [customers, tables]."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for n in range(1, most + 1):
        stay = out[n - 1, 1:n] + np.log(n - 1 - discount * np.arange(1, n)) if n > 1 else np.zeros(0)
        out[n, 1:n] = np.logaddexp(out[n - 1, : n - 1], stay)
        out[n, n] = 0.0
    return out


_STIRLING: list[np.ndarray] = []


def _log_stirling(level: int) -> np.ndarray:
    if not _STIRLING:
        _STIRLING.extend(_stirling(d, EXACT) for d in DISCOUNT)
    return _STIRLING[level]


def uniform(keys: np.ndarray, draw: int) -> np.ndarray:
    """Numbers inside (0, 1) that the key and the number of the draw fix."""
    return ((mix(keys + U64(draw * 0xD1342543DE82EF95 % (1 << 64))) >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _normal(keys: np.ndarray, draw: int) -> np.ndarray:
    return np.sqrt(-2 * np.log(uniform(keys, draw))) * np.cos(2 * np.pi * uniform(keys, draw + 1))


def gamma(shape: np.ndarray, keys: np.ndarray, draw: int) -> np.ndarray:
    """Gamma variates with scale 1, by squeezed rejection from normal ones; shapes below 1 by way of shape + 1."""
    low = shape < 1
    d = np.where(low, shape + 1, shape) - 1 / 3
    out, left, attempt = np.zeros(len(d)), np.arange(len(d)), 256 * draw
    while len(left):
        x = _normal(keys[left], attempt)
        v = (1 + x / np.sqrt(9 * d[left])) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            good = (v > 0) & (np.log(uniform(keys[left], attempt + 2)) < x * x / 2 + d[left] * (1 - v + np.log(v)))
        out[left[good]] = d[left[good]] * v[good]
        left, attempt = left[~good], attempt + 3
    return np.where(low, out * uniform(keys, 256 * draw + 255) ** (1 / np.maximum(shape, 1e-9)), out)


def _poisson(rate: np.ndarray, keys: np.ndarray, draw: int) -> np.ndarray:
    """By inversion, or from a normal variate where the rate is above 20."""
    u, out = uniform(keys, draw), np.maximum(0, np.rint(rate + np.sqrt(rate) * _normal(keys, draw + 1)))
    small = rate <= 20
    part = np.where(small, np.exp(-np.minimum(rate, 20)), 1.0)
    total, k = part.copy(), np.zeros(len(rate))
    while (going := small & (u > total) & (k < 100)).any():
        k += going
        part = np.where(going, part * rate / np.maximum(k, 1), part)
        total += np.where(going, part, 0)
    return np.where(small, k, out)


def draw_tables(customers: np.ndarray, weight: np.ndarray, level: int, rng: np.random.Generator | None, keys: np.ndarray | None = None, draw: int = 0) -> np.ndarray:
    """Numbers of tables of dishes, given each one's customers and its weight for a new table.

    Up to EXACT customers: an exact draw from the conditional, weight^t * S(c, t). Above: one from its saddle-point
    approximation. Draws follow the dishes' keys, or `rng` where there are none.
    """
    keys = rng.integers(0, 1 << 64, len(customers), dtype=U64) if keys is None else keys
    tables = np.ones(len(customers), dtype=np.int64)
    d = DISCOUNT[level]
    few = np.flatnonzero((customers > 1) & (customers <= EXACT))
    few = few[np.argsort(customers[few], kind="stable")]
    sizes, first = np.unique(customers[few], return_index=True)
    for c, group in zip(sizes.tolist(), np.split(few, first[1:]), strict=False):
        t, stirling = np.arange(1, c + 1), _log_stirling(level)[c, 1 : c + 1]
        step = max(1, 400_000 // c)
        for at in (group[i : i + step] for i in range(0, len(group), step)):
            score = np.log(weight[at])[:, None] * t + stirling
            score = np.cumsum(np.exp(score - score.max(axis=1, keepdims=True)), axis=1)
            tables[at] = np.minimum(c, 1 + (uniform(keys[at], 256 * draw)[:, None] * score[:, -1:] > score).sum(axis=1))
    many = np.flatnonzero(customers > EXACT)
    if len(many):
        tables[many] = 1 + _many_tables(customers[many].astype(np.float64), weight[many], d, keys[many], 256 * draw)
    return tables


def _many_tables(c: np.ndarray, w: np.ndarray, d: float, keys: np.ndarray, draw: int) -> np.ndarray:
    """Tables beyond the first of dishes with many customers.

    weight^t * S(c, t) / c! is the coefficient of z^c in (weight * (1 - (1 - z)^d) / d)^t / t!: as many groups as a
    Poisson variate says, whose sizes add up to c. At the saddle point z their mean number is the rate there, and the
    variance what is left of it given the sum; where z comes near 1, that is the Poisson law itself.
    """
    low, high = np.full(len(c), -700.0), np.full(len(c), -1e-12)  # log(1 - z)
    for _ in range(60):
        middle = (low + high) / 2
        more = np.log(w) + np.log1p(-np.exp(middle)) - (1 - d) * middle > np.log(c)
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    left = np.exp((low + high) / 2)
    rate = w / d * (1 - left**d)
    spread = np.maximum(rate - c / (1 + (1 - left) * (1 - d) / left), 1e-9)
    near = np.rint(rate + np.sqrt(spread) * _normal(keys, draw + 8))
    return np.clip(np.where(rate <= 20, _poisson(np.minimum(rate, 20), keys, draw), near), 0, c - 1).astype(np.int64)


def pairs(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * _PAIR + word)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, each text followed by its end, the word before each (0 for the first), and first places."""
    hashes, counts = [np.zeros(0, dtype=U64)], [np.zeros(0, dtype=np.int64)]
    for own, places in chunks(data, offsets):
        words = Words(own, places)
        hashes.append(words.hash)
        counts.append(words.counts())
    every, n = np.concatenate(hashes), len(offsets) - 1
    first = np.append(0, np.cumsum(np.concatenate(counts) + 1))
    out = np.full(len(every) + n, END)
    inner = np.ones(len(out), dtype=bool)
    inner[first[1:] - 1] = False
    out[inner] = every
    before = np.zeros(len(out), dtype=U64)
    before[1:] = out[:-1]
    before[first[:-1]] = 0
    return out, before, first


def _pack(*columns: np.ndarray) -> bytes:
    """The columns with their types and lengths; their first bytes first, compressed."""
    head = np.array([len(columns), *(x for c in columns for x in (_KINDS.index(c.dtype.type), len(c)))], dtype=np.int64).tobytes()
    raw = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns if len(c))
    return head + (pa.compress(raw, codec="zstd", asbytes=True) if raw else raw)


def _unpack(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n, 8).reshape(n, 2).tolist()
    sizes = [np.dtype(_KINDS[k]).itemsize * rows for k, rows in head]
    rest = data[8 + 16 * n :]
    raw = np.frombuffer(pa.decompress(rest, decompressed_size=sum(sizes), codec="zstd", asbytes=True) if rest else b"", dtype=np.uint8)
    ends = np.cumsum(sizes)
    return [np.ascontiguousarray(raw[e - size : e].reshape(-1, rows).T).view(_KINDS[k]).ravel() if rows else np.zeros(0, dtype=_KINDS[k]) for (k, rows), size, e in zip(head, sizes, ends, strict=True)]


def _steps(ascending: np.ndarray) -> np.ndarray:
    """Ascending numbers as differences, whose first bytes are few; np.cumsum gives them back."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def _shards(words: np.ndarray, shards: int) -> np.ndarray:
    return ((words >> U64(33)) % U64(shards)).astype(np.int64)


def _places(known: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the sought values are among the known, which ascend, and whether they are there."""
    at = np.minimum(np.searchsorted(known, sought), max(0, len(known) - 1))
    return at, known[at] == sought if len(known) else np.zeros(len(sought), dtype=bool)


def _joined(parts: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct keys, their weights in all, and each part's places among them."""
    known, place = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(weights), minlength=len(known)).astype(np.int64)
    return known, total, np.split(place, np.cumsum([len(x) for x in parts])[:-1])


def tokenised(docs: DataFrame, key: str, text: str, rows_a_block: int, block_bytes: int) -> DataFrame:
    """(block, tokens, data, often): texts as places of their words among the block's distinct ones, and its frequent words."""

    def block(held: list[pa.RecordBatch], number: int) -> tuple:
        rows = pa.Table.from_batches(held).combine_chunks()
        words, _, first = tokens(*text_buffers(rows.column("text")))
        known, place, count = np.unique(words, return_inverse=True, return_counts=True)
        keys = rows.column(key).combine_chunks().cast(pa.int64())
        ids, null = keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False)
        data = _pack(_steps(known), place.astype(np.int32), np.diff(first).astype(np.int32), ids, null.astype(np.uint8), rows.column("training").to_numpy().astype(np.uint8))
        often = count >= FREQUENT / 2 * len(words)
        return (TaskContext.get().partitionId() << 32) + number, len(words), data, [{"word": int(w), "n": int(n)} for w, n in zip(known[often].astype(np.int64), count[often], strict=True)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("tokens", pa.int64()), ("data", pa.binary()), ("often", pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())])))])
        held, size, number = [], 0, 0
        for part in parts:
            for start in range(0, part.num_rows, rows_a_block):
                for rows, data, _ in batches(part.slice(start, rows_a_block), "text", block_bytes):
                    held.append(rows)
                    size += len(data)
                    if size >= block_bytes or sum(x.num_rows for x in held) >= rows_a_block:
                        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(block(held, number), schema, strict=True)], schema=schema)
                        held, size, number = [], 0, number + 1
                        release()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(block(held, number), schema, strict=True)], schema=schema)
        release()

    return small_batches(docs).mapInArrow(run, "block long, tokens long, data binary, often array<struct<word:long,n:long>>")


class _Block:
    """The distinct n-grams of a block's texts: single words, and pairs whose first word is a context (all words if None)."""

    def __init__(self, data: bytes, contexts: np.ndarray | None):
        steps, place, sizes, self.ids, self.null, self.teaches = _unpack(data)
        self.known, self.place, self.first = np.cumsum(steps), place.astype(np.int64), np.append(0, np.cumsum(sizes))
        follows = np.ones(len(place), dtype=bool)
        if contexts is not None:
            follows[1:] = np.isin(self.known, contexts)[self.place[:-1]]
        follows[self.first[:-1]] = False
        self.paired = paired = np.flatnonzero(follows)
        self.context = self.place[paired - 1]
        keys, self.pair_place = np.unique(self.context * len(self.known) + self.place[paired], return_inverse=True)
        self.pair_context, self.pair_word = keys // len(self.known), keys % len(self.known)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Training occurrences of each word and of each pair."""
        teaches = np.repeat(self.teaches.astype(bool), np.diff(self.first))
        return np.bincount(self.place[teaches], minlength=len(self.known)), np.bincount(self.pair_place[teaches[self.paired]], minlength=len(self.pair_context))

    def order(self, shards: int, often: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each shard that holds any of the block's n-grams: its words, its pairs, and which pairs end in a frequent word."""
        own, frequent = _shards(self.known, shards), np.isin(self.known, often)
        ends, begins = frequent[self.pair_word], frequent[self.pair_context]
        to = np.where(ends, own[self.pair_context], own[self.pair_word])
        both = ends & begins
        to[both] = _shards(pairs(self.known[self.pair_context[both]], self.known[self.pair_word[both]]), shards)
        words, pair = np.argsort(own, kind="stable"), np.argsort(to, kind="stable")
        own, to = own[words], to[pair]
        for s in np.union1d(own, to).tolist():
            p = pair[np.searchsorted(to, s) : np.searchsorted(to, s, side="right")]
            yield s, words[np.searchsorted(own, s) : np.searchsorted(own, s, side="right")], p, ends[p]


def _ask(block: _Block, shards: int, often: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """For each shard: its words and their counts; the pairs' other words; and pairs as places in these with their counts."""
    words, pair = block.counts()
    for s, w, p, ends in block.order(shards, often):
        before = np.unique(np.concatenate([block.pair_context[p], block.pair_word[p[ends]]]))
        second = np.where(ends, len(w) + np.searchsorted(before, block.pair_word[p]), np.searchsorted(w, block.pair_word[p]))
        first = np.searchsorted(before, block.pair_context[p])
        yield s, _pack(_steps(block.known[w]), words[w].astype(np.int32), _steps(block.known[before]), np.diff(first, prepend=0).astype(np.int32), second.astype(np.int32), pair[p].astype(np.int32))


class _Counts:
    """The n-grams of a shard: words and pairs with their training counts over all blocks, and each block's places among them."""

    def __init__(self, messages: list[bytes]):
        release()
        parts = [_unpack(m) for m in messages]
        self.words, self.count, self.places = _joined([np.cumsum(x[0]) for x in parts], [x[1] for x in parts])
        self.before, _, spots = _joined([np.cumsum(x[2]) for x in parts], [np.zeros(len(x[2])) for x in parts])
        width = len(self.words) + len(self.before)
        wanted, counts = [], []
        for x, own, there in zip(parts, self.places, spots, strict=True):
            second, n = x[4].astype(np.int64), len(own)
            outer = second >= n
            word = np.empty(len(second), dtype=np.int64)
            word[~outer], word[outer] = own[second[~outer]], len(self.words) + there[second[outer] - n]
            wanted.append(there[np.cumsum(x[3], dtype=np.int64)] * width + word)
            counts.append(x[5])
            x.clear()
        keys, self.pair_count, self.pair_places = _joined(wanted, counts)
        self.pair_context, self.pair_word = keys // width, keys % width


class _Shard:
    """What a shard's sweeps need: its words, and those of its pairs that occur more than once in training.

    A pair that occurs once has one table for certain. Pairs' words count on from the shard's own words to the frequent
    ones, whose tables the driver adds up.
    """

    def __init__(self, data: bytes, often: np.ndarray):
        steps, self.count, self.direct, self.single, contexts, first, self.pair_word, self.pair_count, self.mark = _unpack(data)
        self.words, self.contexts, self.pair_context = np.cumsum(steps), np.cumsum(contexts), np.cumsum(first, dtype=np.int64)
        self.own = (self.count > 0) & ~np.isin(self.words, often)
        self.names = np.concatenate([self.words, often])

    @staticmethod
    def of(counts: _Counts, often: np.ndarray) -> bytes:
        n, named = len(counts.words), counts.pair_word >= len(counts.words)
        word = counts.pair_word.copy()
        word[named] = n + _places(often, counts.before[word[named] - n])[0]
        many, own = counts.pair_count > 1, ~np.isin(counts.words, often)
        customers = np.bincount(word[~named], weights=counts.pair_count[~named], minlength=n).astype(np.int64)
        single = np.bincount(word[~named & (counts.pair_count == 1)], minlength=n)
        contexts, first = np.unique(counts.pair_context[many], return_inverse=True)
        return _pack(
            _steps(counts.words), counts.count, np.where(own, counts.count - customers, 0), single.astype(np.int32), _steps(counts.before[contexts]),
            np.diff(first, prepend=0).astype(np.int32), word[many].astype(np.int32), counts.pair_count[many].astype(np.int32), np.minimum(counts.pair_count, 2).astype(np.uint8),
        )

    def tables_of_words(self, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.pair_word, weights=tables, minlength=len(self.names)).astype(np.int64)

    def tables_of_contexts(self, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.pair_context, weights=tables, minlength=len(self.contexts)).astype(np.int64)

    def owners(self, shards: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each shard, the places of those contexts that are its words."""
        yield from _owners(self.contexts, shards)


def _owners(words: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    own = _shards(words, shards)
    by_owner = np.argsort(own, kind="stable")
    for part in np.split(by_owner, np.flatnonzero(np.diff(own[by_owner])) + 1):
        if len(part):
            yield int(own[part[0]]), part


class _Parent:
    """Totals of the restaurant of single words after a sweep, and the variates that stand for them in the next one."""

    def __init__(self, vocabulary: int, served: int, tables: int, mass: float, seed: int, sweep: int):
        key, (_, d), (_, s) = mix(np.array([seed], dtype=U64)), DISCOUNT, STRENGTH
        self.vocabulary, self.served, self.tables, self.mass = vocabulary, served, tables, mass
        self.fresh = float(gamma(np.array([s + d * tables]), key, 8 * sweep + 4)[0])
        self.weight = d * float(gamma(np.array([s / d + tables]), key, 8 * sweep + 5)[0]) / (vocabulary + 1)

    def chances(self, mass: np.ndarray) -> np.ndarray:
        """Drawn probabilities of words; what no table holds yet is spread evenly over all words."""
        return (mass + self.fresh / (self.vocabulary + 1)) / (self.mass + self.fresh)

    def predictive(self, held: np.ndarray) -> np.ndarray:
        """Probabilities of words from customers less discounted tables."""
        (_, d), (_, s) = DISCOUNT, STRENGTH
        return (held + (s + d * self.tables) / (self.vocabulary + 1)) / (s + self.served)


def _masses(words: np.ndarray, served: np.ndarray, tables: np.ndarray, seed: int, sweep: int) -> np.ndarray:
    out, at = np.zeros(len(words)), np.flatnonzero(served > 0)
    out[at] = gamma(served[at] - DISCOUNT[1] * tables[at], mix(words[at] + U64(seed)), 8 * sweep + 3)
    return out


def _seated(words: np.ndarray, served: np.ndarray, parent: _Parent, seed: int, sweep: int) -> np.ndarray:
    """Tables of words in the parent."""
    out, at = np.zeros(len(words), dtype=np.int64), np.flatnonzero(served > 0)
    out[at] = draw_tables(served[at], np.full(len(at), parent.weight), 1, None, mix(words[at] + U64(seed)), 8 * sweep + 1)
    return out


_ROWS = "kind string, shard int, other long, data binary, a long, b long, c long, d long, mass double"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(*r, *(0,) * (8 - len(r)), 0.0) if len(r) < 9 else r for r in rows], columns=["kind", "shard", "other", "data", "a", "b", "c", "d", "mass"])


def score(
    docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", contexts: int | None = None, sweeps: int = 5, burn_in: int = 2, rows_a_block: int = 50_000, seed: int = 11,
    block_bytes: int = 8 << 20, tokens_a_shard: int = 3_000_000,
) -> DataFrame:
    """Scores every text under the model learned from the rows where `training` holds.

    A null text is empty: its only token is its end. base_score is the additive-smoothing log10 probability by counts
    of single words, score the model's. Without any training row every word is unknown and both take V = N = 0.
    Repeated rows count as often as they come; keys are read as whole numbers, and a null one stays null. Every word is
    a context, unless `contexts` says how many of the most frequent ones are. A block holds about `block_bytes` of
    text, or one longer text, and at most `rows_a_block` rows; neither it nor the number of shards changes a score.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    blocks = cut_in_buckets(tokenised(source, "doc_id", "text", rows_a_block, block_bytes), "block")
    all_tokens = int(blocks.agg(F.sum("tokens")).first()[0] or 0)
    shards = max(1, -(-all_tokens // tokens_a_shard))
    heavy = blocks.select(F.explode("often").alias("w")).groupBy("w.word").agg(F.sum("w.n").alias("n"))
    found = heavy.where(F.col("n") >= FREQUENT / 2 * all_tokens).collect()  # 2 / FREQUENT words at most
    often = np.sort(np.array([r["word"] for r in found], dtype=np.int64).view(U64))
    order = None
    if contexts is not None:
        order = np.sort(np.array(_most_frequent(blocks, contexts), dtype=np.int64).view(U64))

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for number, data in zip(part["block"].tolist(), part["data"], strict=True):
                yield _frame([("ask", s, number, m) for s, m in _ask(_Block(data, order), shards, often)])
                release()

    def given(shard: _Shard, number: int, served: np.ndarray, tables: np.ndarray, sweep: int) -> tuple:
        own = shard.own
        mass = _masses(shard.words[own], served[own], tables[own], seed, sweep).sum()
        return ("given", number, sweep, _pack(served[own], tables[own]), int(served[own].sum()), int(tables[own].sum()), 0, 0, float(mass))

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        """Adds up what the blocks ask for; every dish begins with one table."""
        frame = frame.sort_values("other", ignore_index=True)
        number, counts = int(frame["shard"].iloc[0]), _Counts(frame["data"].tolist())
        state = _Shard.of(counts, often)
        shard, n = _Shard(state, often), len(counts.words)
        learned = counts.count > 0
        rows = [("state", number, -1, state, int(counts.count.sum()), int(learned.sum()))]
        rows += [("block", number, b, _pack(np.diff(w, prepend=0).astype(np.int32), np.diff(p, prepend=0).astype(np.int32))) for b, w, p in zip(frame["other"].tolist(), counts.places, counts.pair_places, strict=True)]
        per_context = [np.bincount(counts.pair_context[which], minlength=len(counts.before)) for which in (counts.pair_count == 1, counts.pair_count > 1)]
        taught = np.flatnonzero(per_context[0] + per_context[1])
        rows += [("owner", o, number, _pack(_steps(counts.before[taught[at]]), *(x[taught[at]].astype(np.int32) for x in per_context))) for o, at in _owners(counts.before[taught], shards)]
        # Frequent words: occurrences, customers of their restaurants' pairs, pairs that occur once, and the others.
        outer = counts.pair_word >= n
        place, there = _places(often, counts.words)
        numbers = np.zeros((4, len(often)), dtype=np.int64)
        numbers[0, place[there]] = counts.count[there]
        spot = _places(often, counts.before[counts.pair_word[outer] - n])[0]
        for i, weights in enumerate((counts.pair_count[outer], counts.pair_count[outer] == 1, counts.pair_count[outer] > 1), 1):
            numbers[i] = np.bincount(spot, weights=weights, minlength=len(often))
        rows += [("often", number, i, b"", *numbers[:, i].tolist()) for i in np.flatnonzero(numbers.any(axis=0)).tolist()]
        served = shard.direct + shard.single + shard.tables_of_words(np.ones(len(shard.pair_word)))[:n]
        return _frame([*rows, given(shard, number, served, (served > 0).astype(np.int64), 0)])

    asked = blocks.select("block", "data").mapInPandas(ask, _ROWS)
    gathered = cut_in_buckets(asked.groupBy("shard").applyInPandas(gather, _ROWS), "shard")

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        """An owner's contexts: their tables in all shards to begin with, and where each shard's lie among them."""
        frame = frame.sort_values("other", ignore_index=True)
        owner, parts = int(frame["shard"].iloc[0]), [_unpack(x) for x in frame["data"]]
        known, single, places = _joined([np.cumsum(x[0]) for x in parts], [x[1] for x in parts])
        many = np.bincount(np.concatenate(places), weights=np.concatenate([x[2] for x in parts]), minlength=len(known)).astype(np.int64)
        rows = [("base", owner, -1, _pack(_steps(known), single))]
        for s, at in zip(frame["other"].tolist(), (p[x[2] > 0] for p, x in zip(places, parts, strict=True)), strict=True):
            rows += [("places", owner, s, _pack(np.diff(at, prepend=0).astype(np.int32), single[at])), ("tables", s, owner, _pack(single[at] + many[at]))]
        return _frame(rows)

    met = cut(gathered.where("kind = 'owner'").groupBy("shard").applyInPandas(meet, _ROWS))
    state, places = gathered.where("kind = 'state'"), met.where("kind = 'places'")
    first = gathered.where("kind = 'state'").agg(F.sum("a"), F.sum("b")).first()
    total, vocabulary = (int(x or 0) for x in first)

    static = np.zeros((4, len(often)), dtype=np.int64)
    for r in gathered.where("kind = 'often'").groupBy("other").agg(*[F.sum(c).alias(c) for c in "abcd"]).collect():
        static[:, r["other"]] = [r[c] for c in "abcd"]
    fixed = static[0] - static[1] + static[2]  # customers that need no draw
    often_served = fixed + static[3]
    often_tables = (often_served > 0).astype(np.int64)

    def parent_after(rows: DataFrame, sweep: int) -> tuple[_Parent, np.ndarray]:
        own = rows.where("kind = 'given'").agg(F.sum("a"), F.sum("b"), F.sum("mass")).first()
        mass = _masses(often, often_served, often_tables, seed, sweep)
        return _Parent(vocabulary, int(own[0] or 0) + int(often_served.sum()), int(own[1] or 0) + int(often_tables.sum()), float(own[2] or 0) + float(mass.sum()), seed, sweep), mass

    parent, often_mass = parent_after(gathered, 0)
    previous, replies = gathered.where("kind = 'given'"), met.where("kind = 'tables'")
    samples: list[tuple[_Parent, np.ndarray]] = []
    kept: list[DataFrame] = []

    def drawing(sweep: int, keeps: bool, parent: _Parent, often_mass: np.ndarray):
        """The tables of all pairs of a shard in one sweep, then those of its words in the parent."""

        def draw(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            if not len(frame):
                return _frame([])
            release()
            shard, number = _Shard(frame["data"].iloc[0], often), int(frame["shard"].iloc[0])
            by_owner = {o: d for k, o, d in zip(told["kind"], told["other"], told["data"], strict=True) if k == "tables"}
            served, tables = _unpack(told["data"][told["kind"] == "given"].iloc[0])
            everywhere = np.zeros(len(shard.contexts), dtype=np.int64)
            for o, at in shard.owners(shards):
                everywhere[at] = _unpack(by_owner[o])[0]
            own = shard.own
            mass = np.zeros(len(shard.names))
            mass[: len(own)][own] = _masses(shard.words[own], served, tables, seed, sweep - 1)
            mass[len(own) :] = often_mass
            chance = parent.chances(mass)
            (d, _), (s, _) = DISCOUNT, STRENGTH
            room = d * gamma(s / d + everywhere, mix(shard.contexts + U64(seed)), 8 * sweep + 2)
            keys = pairs(shard.contexts[shard.pair_context], shard.names[shard.pair_word]) + U64(seed)
            drawn = draw_tables(shard.pair_count, np.maximum(room[shard.pair_context] * chance[shard.pair_word], 1e-300), 0, None, keys, 8 * sweep)
            of_word, of_context = shard.tables_of_words(drawn), shard.tables_of_contexts(drawn)
            served = np.zeros(len(own), dtype=np.int64)
            served[own] = (shard.direct + shard.single + of_word[: len(own)])[own]
            rows = [given(shard, number, served, _seated(shard.words, served, parent, seed, sweep), sweep)]
            rows += [("of_contexts", o, number, _pack(of_context[at])) for o, at in shard.owners(shards)]
            rows += [("often", number, i, b"", n) for i, n in enumerate(of_word[len(own) :].tolist()) if n]
            return _frame(rows + [("drawn", number, sweep, _pack(drawn.astype(np.int32)))] * keeps)

        return draw

    def adding(sweep: int, keeps: bool):
        def add(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            """Adds up each context's tables over the shards; each shard gets its own contexts' totals."""
            parts = {s: _unpack(d)[0] for s, d in zip(told["other"], told["data"], strict=True)}
            sets = {s: _unpack(d) for s, d in zip(frame["other"], frame["data"], strict=True)}
            at = {s: np.cumsum(x[0], dtype=np.int64) for s, x in sets.items()}
            sums = np.zeros(max((int(x[-1]) + 1 for x in at.values() if len(x)), default=0), dtype=np.int64)
            for s, part in parts.items():
                sums[at[s]] += part
            owner = int(frame["shard"].iloc[0])
            return _frame([("tables", s, owner, _pack(sets[s][1] + sums[at[s]])) for s in parts] + [("seats", owner, sweep, _pack(sums))] * keeps)

        return add

    for sweep in range(1, sweeps + 1):
        keeps = sweep > burn_in
        drawn = cut(state.groupBy("shard").cogroup(previous.unionByName(replies).groupBy("shard")).applyInPandas(drawing(sweep, keeps, parent, often_mass), _ROWS))
        replied = cut(places.groupBy("shard").cogroup(drawn.where("kind = 'of_contexts'").groupBy("shard")).applyInPandas(adding(sweep, keeps), _ROWS))
        often_served = fixed.copy()
        for r in drawn.where("kind = 'often'").groupBy("other").agg(F.sum("a").alias("a")).collect():
            often_served[r["other"]] += r["a"]
        often_tables = _seated(often, often_served, parent, seed, sweep)
        parent, often_mass = parent_after(drawn, sweep)
        previous, replies = drawn.where("kind = 'given'"), replied.where("kind = 'tables'")
        if keeps:
            samples.append((parent, often_served - DISCOUNT[1] * often_tables))
            kept += [drawn.where("kind in ('given', 'drawn')"), replied.where("kind = 'seats'")]

    def answer(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """For each block, its words' counts, their customers less tables and their own restaurants' tables in each sample, and
        its pairs' customers less tables on average."""
        if not (frame["kind"] == "state").any():
            return pd.DataFrame({"block": [], "shard": [], "data": []})
        release()
        shard = _Shard(frame["data"][frame["kind"] == "state"].iloc[0], often)
        number = int(frame["shard"].iloc[0])
        rows = {(k, int(o)): d for k, o, d in zip(told["kind"], told["other"], told["data"], strict=True)}
        held, tables = [], []
        steps, single = _unpack(rows["base", -1]) if ("base", -1) in rows else (np.zeros(0, U64), np.zeros(0, np.int64))
        at = _places(shard.words, np.cumsum(steps))[0]
        value = np.zeros(len(shard.pair_count))
        for sweep in range(burn_in + 1, sweeps + 1):
            served, base = _unpack(rows["given", sweep])
            own = np.zeros(len(shard.words), dtype=np.float32)
            own[shard.own] = served - DISCOUNT[1] * base
            held.append(own)
            seats = single.copy()
            if ("seats", sweep) in rows:
                more = _unpack(rows["seats", sweep])[0]
                seats[: len(more)] += more
            tables.append(np.zeros(len(shard.words), dtype=np.int64))
            tables[-1][at] = seats
            value += shard.pair_count - DISCOUNT[0] * _unpack(rows["drawn", sweep])[0]
        pair = np.where(shard.mark == 1, 1 - DISCOUNT[0], 0.0).astype(np.float32)
        pair[shard.mark == 2] = value / max(1, sweeps - burn_in)
        out = []
        for kind, b, data in zip(frame["kind"], frame["other"], frame["data"], strict=True):
            if kind == "block":
                w, p = (np.cumsum(x, dtype=np.int64) for x in _unpack(data))
                out.append((b, number, _pack(shard.count[w], pair[p], *(x[w] for x in held), *(x[w] for x in tables))))
        return pd.DataFrame(out, columns=["block", "shard", "data"])

    told = met.where("kind = 'base'")
    for rows in kept:
        told = told.unionByName(rows)
    answered = gathered.where("kind in ('state', 'block')").groupBy("shard").cogroup(told.groupBy("shard")).applyInPandas(answer, "block long, shard int, data binary")

    def apply(frame: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame({c: [] for c in ("doc_id", "training", "n_tokens", "n_known", "base_score", "score")})
        release()
        block, n = _Block(frame["data"].iloc[0], order), len(samples)
        by_shard = dict(zip(replies["shard"], replies["data"], strict=True))
        words, size = np.zeros((2 * n, len(block.known))), np.zeros(len(block.known), dtype=np.int64)
        pair = np.zeros(len(block.pair_word))
        for s, w, p, _ in block.order(shards, often):
            size[w], pair[p], *per_sample = _unpack(by_shard[s])
            for i, x in enumerate(per_sample):
                words[i, w] = x
        place, there = _places(often, block.known)
        at, before, (d, _), (s, _) = block.paired, block.context, DISCOUNT, STRENGTH
        chance = np.zeros(len(block.place))
        for i, (parent, often_held) in enumerate(samples):
            words[i, there] = often_held[place[there]]
            each = parent.predictive(words[i])[block.place]
            each[at] = (pair[block.pair_place] + (s + d * words[n + i][before]) * each[at]) / (s + size[before])
            chance += each / n
        base = np.log10((size + 0.1) / (total + 0.1 * (vocabulary + 1)))[block.place]
        start = block.first[:-1]
        ids = pd.array(block.ids, dtype="Int64")
        ids[block.null.astype(bool)] = pd.NA
        return pd.DataFrame({
            "doc_id": ids, "training": block.teaches.astype(bool), "n_tokens": np.diff(block.first), "n_known": np.add.reduceat((size > 0)[block.place].astype(np.int64), start),
            "base_score": np.add.reduceat(base, start), "score": np.add.reduceat(np.log10(chance), start),
        })

    scored = blocks.select("block", "data").groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(apply, "doc_id long, training boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))


def _most_frequent(blocks: DataFrame, most: int) -> list[int]:
    """The `most` words with the most training tokens."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for data in part["data"]:
                block = _Block(data, None)
                count = block.counts()[0]
                taught = (count > 0) & (block.known != END)
                yield pd.DataFrame({"word": block.known[taught].astype(np.int64), "n": count[taught]})

    counts = blocks.select("data").mapInPandas(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()]
