"""Document fingerprints of closed syncmers.

A k-mer of code points is a closed syncmer if the least hash among its inner s-mers is that of its first or last one.
Whether it is one depends on the k-mer alone, not on the text around it, so that an edit elsewhere leaves the anchor in
place. A fingerprint holds the anchors with the least hashes, each with its position; two fingerprints are compared by
the anchors of their joint bottom sketch that occur in both in the same order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bytewise import U64, batches, mix
from lodestone.llm.shared import partitions, small_batches

K, S = 12, 5
#: A fingerprint holds one anchor in SHARE, and ANCHORS at least, as far as the text has them.
ANCHORS, SHARE = 48, 24
_BASE = [pow(0xD6E8FEB86659FD93, i, 1 << 64) for i in range(S)]
_ANCHOR = np.dtype([("hash", ">u4"), ("at", ">u4")])


def syncmers(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """32-bit hashes and positions of all closed syncmers, text by text, and each text's first one."""
    n = len(points) - K + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    wide = (points.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)
    inner = wide[: len(wide) - S + 1] * U64(_BASE[0])
    for i in range(1, S):
        inner += wide[i : len(wide) - S + 1 + i] * U64(_BASE[i])
    inner = mix(inner)
    last = K - S
    least = inner[:n].copy()
    for i in range(1, last + 1):
        np.minimum(least, inner[i : n + i], out=least)
    at = np.flatnonzero((inner[:n] == least) | (inner[last : last + n] == least))
    text = np.searchsorted(offsets, at, side="right") - 1
    inside = at + K <= offsets[text + 1]
    at, text = at[inside], text[inside]
    whole = mix(inner[at] + U64(3) * inner[at + S] + U64(5) * inner[at + last])
    return (whole >> U64(32)).astype(np.uint32), at - offsets[text], np.searchsorted(text, np.arange(len(offsets)))


def sketch(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The least distinct hashes, one in SHARE but ANCHORS at least, with their first positions, by position."""
    wanted = max(ANCHORS, -(-len(hashes) // SHARE))
    near = np.arange(len(hashes))
    if len(hashes) > 8 * wanted:
        near = np.flatnonzero(hashes <= np.partition(hashes, 4 * wanted)[4 * wanted])
    least, first = np.unique(hashes[near], return_index=True)
    if len(least) < wanted and len(near) < len(hashes):
        near = np.arange(len(hashes))
        least, first = np.unique(hashes, return_index=True)
    first = np.sort(near[first[:wanted]])
    out = np.empty(len(first), dtype=_ANCHOR)
    out["hash"], out["at"] = hashes[first], np.minimum(at[first], 0xFFFFFFFF)
    return out


def fingerprints(points: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """A text without a syncmer has one anchor, its own hash at 0; an empty text has none."""
    hashes, at, first = syncmers(points, offsets)
    out = []
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        if a < b:
            out.append(sketch(hashes[a:b], at[a:b]))
        elif offsets[i] < offsets[i + 1]:
            whole = hashlib.blake2b(points[offsets[i] : offsets[i + 1]].astype("<u4").tobytes(), digest_size=4).digest()
            out.append(np.array([(int.from_bytes(whole, "big"), 0)], dtype=_ANCHOR))
        else:
            out.append(np.zeros(0, dtype=_ANCHOR))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the joint bottom sketch whose anchors lie in both in the same order; two empty ones are alike.

    The joint sketch is as large as the smaller of the two; one with fewer than ANCHORS holds all that its text has.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a["hash"], b["hash"])[: max(ANCHORS, min(len(a), len(b)))]
    common, i, j = np.intersect1d(a["hash"], b["hash"], assume_unique=True, return_indices=True)
    shared = common <= both[-1]
    if not shared.any():
        return 0.0
    i, j = i[shared], j[shared]
    chain: list[int] = []  # the longest increasing run of places in b along those in a
    for x in j[np.argsort(i)].tolist():
        spot = bisect_left(chain, x)
        chain[spot : spot + 1] = [x]
    return len(chain) / len(both)


def _place(key: Column, splits: list[int]) -> Column:
    """The last split that is not above the key, by binary search."""
    table = F.array(*[F.lit(x) for x in splits])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, (len(splits) - 1).bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda a, s: F.when(F.get(table, a + s) <= key, a + s).otherwise(a))


def in_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows dealt by ranges of the key and sorted; each range ends with a copy of the next one's first rows (_tail).

    The last range is followed by the first. Ranges are set by approximate quantiles of the key, one to a shuffle
    partition, so that neither a driver nor a task sees more than its share. Null keys come last; equal keys by text.
    """
    keyed = docs.withColumn("_key", F.coalesce(F.col(key), F.lit(2**63 - 1)))
    n = partitions(docs.sparkSession)
    found = keyed.agg(F.min("_key").alias("least"), F.percentile_approx("_key", [i / n for i in range(n)], 100 * n).alias("at")).first()
    splits = sorted({*found["at"], found["least"]}) if found["at"] else [0]
    own = _place(F.col("_key"), splits)
    starts = F.get(F.array(*[F.lit(x) for x in splits]), F.col("_own")) == F.col("_key")
    before = F.pmod(F.col("_own") - 1, F.lit(len(splits)))
    ranged = keyed.withColumn("_own", own).withColumn("_to", F.explode(F.when(starts, F.array(F.struct(F.col("_own").alias("range"), F.lit(False).alias("tail")), F.struct(before.alias("range"), F.lit(True).alias("tail")))).otherwise(F.array(F.struct(F.col("_own").alias("range"), F.lit(False).alias("tail"))))))
    dealt = ranged.select(key, text, "_key", F.col("_to.range").cast("int").alias("_range"), F.col("_to.tail").alias("_tail"))
    return dealt.repartitionById(len(splits), F.col("_range")).sortWithinPartitions("_tail", "_key", text)


def _points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, their offsets by text, and each code point's first byte."""
    first = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.searchsorted(first, offsets), np.append(first, len(data))


def compare_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness.

    The edited form has the last quarter of its code points (rounded down) replaced by as many of the next row, in the
    order of the key; after the last comes the first, and an only row follows itself. A null text is empty: its
    fingerprint is an empty string. Rows with equal keys are ordered by their text, rows without a key come last.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def compare(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        """All but the last row, which only serves as the one before's next."""
        points, at, first = _points(data, offsets)
        n = rows.num_rows - 1
        parts, sizes, shas = [], [0], []
        for i in range(n):
            size, follow = at[i + 1] - at[i], at[i + 2] - at[i + 1]
            kept = size - size // 4
            taken = min(size // 4, follow)
            parts += [points[at[i] : at[i] + kept], points[at[i + 1] : at[i + 1] + taken]]
            sizes.append(kept + taken)
            sha = hashlib.sha256(data[offsets[i] : first[at[i] + kept]])
            sha.update(data[offsets[i + 1] : first[at[i + 1] + taken]])
            shas.append(sha.hexdigest())
        own = fingerprints(points, at)
        edited = fingerprints(np.concatenate(parts) if parts else points[:0], np.cumsum(sizes))
        columns = [
            rows.column(key).slice(0, n).cast(pa.int64()), pa.array(np.diff(at)[:n].astype(np.int64)), pa.array(shas, pa.string()),
            pa.array([x.tobytes().hex() for x in own[:n]], pa.string()), pa.array([x.tobytes().hex() for x in edited], pa.string()),
            pa.array([likeness(own[i], edited[i]) for i in range(n)], pa.float64()), pa.array([likeness(own[i], own[i + 1]) for i in range(n)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over = None, False
        for part in parts:
            if over:
                continue
            tails = np.flatnonzero(part.column("_tail").to_numpy(zero_copy_only=False))
            if len(tails):
                part, over = part.slice(0, tails[0] + 1), True
            for rows, _, _ in batches(part, text, 4 << 20):
                rows = rows if held is None else pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0]
                held = rows.slice(rows.num_rows - 1)
                for whole, data, offsets in batches(rows, text, 1 << 62):
                    if whole.num_rows > 1:
                        yield compare(whole, data, offsets)

    return small_batches(in_order(docs, key, text).select(key, text, "_tail")).mapInArrow(run, schema)
