"""Packing of tokenised documents into sequences by bin completion.

Sequences are completed one at a time around the largest document left. Fillings of the room beside it that another one
dominates (each of their parts fits a part of the other) are not tried; the rest are tried least waste first, and a
branch ends when its waste exceeds what a packing better than the best one known could have. Best-fit decreasing gives
the first packing to beat.
"""

from __future__ import annotations

import bisect
import collections
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bytewise import HashIndex, Words, batches, keep_only, release
from lodestone.llm.shared import small_batches

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: With them comes the number of the row among equal ones of its partition, so that very many of them are not packed by one task.
_COPY = ", copy long"
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of many texts at once. Words are encoded once and kept, up to `most` of them.

    For vocabularies that lower-case and part tokens at white space: a text's ids are then those of its words in a row.
    """

    def __init__(self, path: str, most: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model, self.tails = self.tokenizer.model, {"": []}
        own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]  # bytes that stand for themselves
        self.as_letters = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}
        self._forget()

    def _forget(self) -> None:
        self.place = HashIndex()
        self.flat, self.used = np.zeros(1 << 20, dtype=np.uint32), 0
        self.first, self.size = np.zeros(1 << 18, dtype=np.int64), np.zeros(1 << 18, dtype=np.int64)

    def _ids(self, words: list[str]) -> list[list[int]]:
        """Ids of single words; the model encodes plain ones itself, which saves most of the tokenizer's time."""
        out: list[list[int] | None] = [None] * len(words)
        other = []
        for i, word in enumerate(words):
            core = word.rstrip(".,").lower()
            if core.isalpha() and (core.isascii() or max(core) < "\u0100") and len(core) < 100:
                tail = word[len(core) :]
                ids = [t.id for t in self.model.tokenize(core.encode().decode("latin-1").translate(self.as_letters))]
                out[i] = ids + self.tails[tail] if tail in self.tails else ids + self._tail(tail)
            else:
                other.append(i)
        for i, found in zip(other, self.tokenizer.encode_batch([words[i] for i in other], add_special_tokens=False), strict=True):
            out[i] = found.ids
        return out

    def _tail(self, tail: str) -> list[int]:
        ids = self.tokenizer.encode(tail, add_special_tokens=False).ids
        if len(tail) < 4:
            self.tails[tail] = ids
        return ids

    def _learn(self, words: list[str]) -> None:
        found = self._ids(words)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        n, total = self.place.used - len(words), int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.place.used > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        self.flat[self.used : self.used + total] = np.fromiter((i for ids in found for i in ids), dtype=np.uint32, count=total)
        self.size[n : n + len(words)] = sizes
        self.first[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.used += total

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row and each text's number of them. Case of A-Z must not matter to the ids."""
        words = Words(data, offsets)
        if self.place.used > self.most:
            self._forget()
        index = self.place.find(words.hash)
        missing = np.flatnonzero(index < 0)
        if len(missing):
            new, first = np.unique(words.hash[missing], return_index=True)
            self.place.add(new)
            whole, at = data.tobytes(), missing[first]
            self._learn([whole[a:b].decode("utf-8", "replace") for a, b in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)])
            index[missing] = self.place.find(words.hash[missing])
        sizes = self.size[index]
        before = np.cumsum(sizes) - sizes
        ids = self.flat[np.repeat(self.first[index] - before, sizes) + np.arange(int(sizes.sum()))]
        return ids, np.diff(np.append(before, len(ids))[words.first])


def encoder(path: str) -> Encoder:
    keep_only(_encoders)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = 4096, end: int = 1) -> DataFrame:
    """A row for each piece of each document: its ids, then the end id, cut every `capacity` ids.

    A null text is empty: its only id is the end id. Repeated rows give repeated pieces, told apart by `copy`. Keys are
    read as whole numbers.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = encoder(path), collections.Counter()
        for part in parts:
            for rows, data, offsets in batches(part, text, 1 << 20):
                keys = rows.column(key).to_pylist()
                ids, sizes = own.encode(data, offsets)
                out: list[tuple] = []
                at = 0
                for k, n in zip(keys, sizes.tolist(), strict=True):
                    whole = np.append(ids[at : at + n], np.uint32(end)).astype("<u4")
                    at += n
                    row = [(k, i, s, min(capacity, n + 1 - s), zlib.crc32(whole[s : s + capacity])) for i, s in enumerate(range(0, n + 1, capacity))]
                    same = hash((k, row[0][3:], row[-1][3:]))
                    out += [(*x, seen[same]) for x in row]
                    seen[same] += 1
                columns = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "copy"])
        release()

    return small_batches(docs.select(key, text)).mapInArrow(run, PIECES + _COPY)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each length goes where it leaves the least room."""
    room: list[int] = []  # sorted
    bins_at: dict[int, list[list[int]]] = {}
    out: list[list[int]] = []
    for x in sorted(lengths, reverse=True):
        spot = bisect.bisect_left(room, x)
        if spot < len(room):
            left = room.pop(spot)
            one = bins_at[left].pop()
        else:
            left, one = capacity, []
            out.append(one)
        one.append(x)
        bisect.insort(room, left - x)
        bins_at.setdefault(left - x, []).append(one)
    return out


def _best_two(count: np.ndarray, room: int, most: int) -> list[tuple[int, ...]]:
    """Fillings of one or two lengths that leave the least room, the best ones first."""
    have = np.flatnonzero(count[: room + 1])
    have = have[have > 0]
    if not len(have):
        return []
    single = int(have[-1])
    rest = np.searchsorted(have, np.minimum(room - have, have), side="right") - 1
    fits = (rest >= 0) & (have < room)
    a, b = have[fits], have[rest[fits]]
    lower = np.searchsorted(have, b) - 1  # where a length is there only once, the next smaller one
    b = np.where((a != b) | (count[a] > 1), b, np.where(lower >= 0, have[np.maximum(lower, 0)], 0))
    good = (b > 0) & (a + b > single)  # else the single one dominates
    a, b = a[good], b[good]
    order = np.argsort(-(a + b), kind="stable")[:most]
    return [(int(x), int(y)) for x, y in zip(a[order], b[order], strict=True)] + [(single,)]


def _dominated(used: list[int], left: int, count: np.ndarray, have: list[int]) -> bool:
    """Whether a length that is still there could take the place of some of those used, which all fit into it."""
    one, several = 1, 0  # bits: sums of any of the lengths used, and of two or more of them
    for x in used:
        several |= (several << x) | ((one & ~1) << x)
        one |= one << x
    for x in have:
        if x <= 0 or not count[x]:
            continue
        low = max(1, x - left)
        below = (one >> low) & ((1 << (x - low)) - 1) if x > low else 0
        if below or several >> x & 1:
            return True
    return False


def fillings(count: np.ndarray, room: int) -> Iterator[tuple[int, tuple[int, ...]] | None]:
    """(waste, lengths) of every undominated filling of the room, each once, as they are asked for.

    The best fillings of one or two lengths come first, then the others, from large lengths to small. None stands for
    a filling that was tried and is dominated, so that the caller can count all that it waits for.
    """
    count = count.copy()
    seen = set()
    for used in _best_two(count, room, 4):
        seen.add(used)
        yield room - sum(used), used
    have = [int(x) for x in np.flatnonzero(count[: room + 1]) if x > 0][::-1]
    if not have:
        yield room, ()
        return
    least = have[-1]
    taken: list[int] = []  # places in `have`; count is lowered by what is taken
    i, left = 0, room
    while True:
        while i < len(have):
            if have[i] <= left and count[have[i]]:
                count[have[i]] -= 1
                taken.append(i)
                left -= have[i]
            else:
                i += 1
        used = [have[k] for k in taken]
        yield from itertools.repeat(None, len(used) // 16)  # long fillings take longer to look at
        maximal = used and (left < least or not any(x <= left and count[x] for x in have))
        good = maximal and tuple(used) not in seen and not _dominated(used, left, count, have)
        yield (left, tuple(used)) if good else None
        if not taken:
            return
        i = taken.pop()
        count[have[i]] += 1
        left += have[i]
        i += 1


def bin_completion(lengths: list[int], capacity: int, nodes_each: int = 8) -> list[list[int]]:
    """A packing with as few sequences as the search finds; it is the least number once that meets the bound.

    The search tries at most nodes_each fillings a length plus a thousand, then keeps the best packing so far; without
    that limit it would try all undominated fillings. What the limit can cost is at most the packing's excess over the
    bound, which the tests and the README state.
    """
    best = best_fit(lengths, capacity)
    total = sum(lengths)
    bound = max(-(-total // capacity), sum(2 * x > capacity for x in lengths))
    if len(best) <= bound:
        return best
    count = np.bincount(lengths, minlength=capacity + 1)
    left, wasted, tried, limit = len(lengths), 0, 0, 1_000 + nodes_each * len(lengths)
    path: list[tuple[int, Iterator, tuple[int, ...], int]] = []  # largest length, its fillings, the one taken, its waste
    down = True
    while tried < limit and len(best) > bound:
        allowed = (len(best) - 1) * capacity - total
        if down:
            if not left:
                best = [[a, *used] for a, _, used, _ in path]
                down = False
                continue
            a = int(np.flatnonzero(count)[-1])
            count[a] -= 1
            left -= 1
            path.append((a, fillings(count, capacity - a), (), 0))
        elif not path:
            break
        a, options, used, waste = path.pop()
        for x in used:
            count[x] += 1
        left += len(used)
        wasted -= waste
        down = False
        for option in options:
            tried += 1
            waste, used = option or (capacity, ())
            if option and wasted + waste <= allowed:
                for x in used:
                    count[x] -= 1
                left -= len(used)
                wasted += waste
                path.append((a, options, used, waste))
                down = True
                break
            if tried >= limit:
                break
        if not down:
            count[a] += 1
            left += 1
    return best


def pack(parts: DataFrame, rows: int, capacity: int = 4096, group: int = 3_000) -> DataFrame:
    """Adds sequence_id and offset. Pieces are dealt evenly into groups of about `group`, each packed on its own.

    A group wastes less than one sequence more than one packing of all rows could save, and no task holds more than a
    few groups. `rows` is the number of rows, or about that.
    """
    groups = max(1, round(rows / group))
    dealt = parts.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "copy"), F.lit(groups)))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        lengths = frame["length"].tolist()
        by_length: dict[int, list[int]] = {}
        for i in range(len(lengths) - 1, -1, -1):
            by_length.setdefault(lengths[i], []).append(i)
        sequence, offset = np.zeros(len(frame), dtype=np.int64), np.zeros(len(frame), dtype=np.int64)
        full = [[x] for x in lengths if x >= capacity]
        for k, one in enumerate(full + bin_completion([x for x in lengths if x < capacity], capacity)):
            at = 0
            for x in one:
                i = by_length[x].pop()
                sequence[i], offset[i] = k, at
                at += x
        sequence += int(frame["_group"].iloc[0]) << 32
        return frame.drop(columns=["_group", "copy"]).assign(sequence_id=sequence, offset=offset)

    return dealt.groupBy("_group").applyInPandas(solve, f"{PIECES}, sequence_id long, offset long")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
