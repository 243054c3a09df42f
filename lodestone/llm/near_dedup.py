"""Near-duplicates by HyperMinHash.

A document's set of word shingles is hashed into buckets; each bucket keeps its least hash as a leading-zero count and a
few mantissa bits. Bands of these registers give candidate groups. Within a group, pairs whose estimated likeness,
corrected for chance collisions of registers, comes near the threshold are confirmed on the full sets until all that
could still join two components is settled. Equal sets are one node from the start; nodes are linked, never rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bytewise import U64, Words, batches, chunks, keep_only, mix, release, text_buffers
from lodestone.llm.shared import cut, small_batches

REGISTERS, MANTISSA, BAND, BANDS = 128, 10, 5, 25
_SHIFT = U64(64 - 7)
#: Registers of unlike sets that agree by chance: 0.1699 * buckets / 2^mantissa bits, for large sets.
_CHANCE = 0.16991948715973909 * REGISTERS / (1 << MANTISSA)
_BORROW = np.random.Generator(np.random.PCG64(7)).integers(0, REGISTERS, (32, REGISTERS))
_FACTORS = [U64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(64)]
#: Estimates of pairs with fewer shingles are too coarse to rule them out; their full sets are compared.
COARSE = 96
#: A pair at the threshold is estimated lower than this once in some ten thousand times.
MARGIN = 0.17
#: Members of a candidate group that one task compares with each other; larger groups are compared block by block.
GROUP = 512
#: Rows of (id) that may be broadcast; beyond it the join is by shuffle.
BROADCAST_ROWS = 1_000_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; one of all its words where they are fewer than `width`."""
    out = []
    for own, places in chunks(data, offsets):
        words = Words(own, places)
        n = max(0, len(words.hash) - width + 1)
        whole = np.full(n, U64(width))
        for i in range(width):
            whole += words.hash[i : n + i] * _FACTORS[i]
        whole = mix(whole)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(np.unique(whole[a : b - width + 1]))
            elif b > a:
                few = np.array([b - a], dtype=U64)
                for i in range(b - a):
                    few = few + words.hash[a + i : a + i + 1] * _FACTORS[i]
                out.append(mix(few))
            else:
                out.append(whole[:0])
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers [set, bucket] of non-empty sets; an empty bucket borrows that of another one."""
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    key = row * REGISTERS + (every >> _SHIFT).astype(np.int64)
    least = np.flatnonzero(np.append(True, key[1:] != key[:-1]))  # sets are sorted: each bucket's first is its least
    value = (every[least] << U64(7)) >> U64(12)  # 52 bits, exact as a float
    bits = np.frexp(value.astype(np.float64))[1]
    zeros = 52 - bits
    mantissa = np.where(bits > MANTISSA, value >> np.maximum(bits - 1 - MANTISSA, 0).astype(U64), value << np.maximum(MANTISSA + 1 - bits, 0).astype(U64)) & U64((1 << MANTISSA) - 1)
    out = np.full(len(sets) * REGISTERS, -1, dtype=np.int32)
    out[key[least]] = (zeros.astype(np.int32) << MANTISSA) | mantissa.astype(np.int32)
    own = out.reshape(len(sets), REGISTERS)
    full = own.copy()
    for targets in _BORROW:
        if not (empty := full < 0).any():
            break
        full = np.where(empty, own[:, targets], full)
    for i in np.flatnonzero((full < 0).any(axis=1)):
        have = np.flatnonzero(own[i] >= 0)
        full[i] = np.where(full[i] < 0, own[i][have[np.searchsorted(have, np.arange(REGISTERS)) % len(have)]], full[i])
    return full.astype(np.uint16)


def band_keys(found: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of registers [set, band]."""
    parts = found[:, : BAND * BANDS].astype(U64).reshape(len(found), BANDS, BAND)
    key = np.broadcast_to(np.arange(BANDS, dtype=U64) + U64(1), (len(found), BANDS)) * U64(0xD6E8FEB86659FD93)
    for i in range(BAND):
        key = mix(key + parts[:, :, i] * _FACTORS[i])
    return key.astype(np.int64)


def estimate(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of one set's registers against others'."""
    same = (others == one).sum(axis=1)
    return np.maximum(0, same - _CHANCE) / (REGISTERS - _CHANCE)


def sketches(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """doc_id, n_shingles, node (digest of the shingle set, null if empty), regs."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(None)
        for part in parts:
            for rows, data, offsets in batches(part, text, 2 << 20):
                sets = shingle_sets(data, offsets, width)
                full = [i for i, s in enumerate(sets) if len(s)]
                node, regs = [None] * len(sets), [None] * len(sets)
                if full:
                    for i, r in zip(full, registers([sets[i] for i in full]), strict=True):
                        node[i], regs[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), r.tobytes()
                yield pa.RecordBatch.from_arrays([rows.column(key).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "n_shingles", "node", "regs"])
        release()

    return small_batches(docs.select(key, text)).mapInArrow(run, "doc_id long, n_shingles long, node binary, regs binary")


def _bands(nodes: DataFrame) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                regs = np.frombuffer(b"".join(part.column("regs").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
                keys = band_keys(regs)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column("node").take(pa.array(np.repeat(np.arange(part.num_rows), BANDS)))], names=["band", "node"])

    return nodes.select("node", "regs").mapInArrow(run, "band long, node binary")


def candidate_groups(nodes: DataFrame) -> DataFrame:
    """(group, node): nodes that share a band, each set of them once; every pair of a large group shares some block pair."""
    bands = _bands(nodes)
    sizes = bands.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min(F.xxhash64("node")).alias("m")).where("n > 1")
    once = sizes.groupBy("n", "x", "m").agg(F.min("band").alias("band"))
    members = bands.join(once.select("band", "n"), "band")
    blocks = F.ceil(F.col("n") / (GROUP // 2)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.when(F.col("n") > GROUP, blocks).otherwise(1)).cast("int")
    others = F.when(F.col("n") > GROUP, F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(j, own).alias("i"), F.greatest(j, own).alias("j")))).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))
    return members.withColumn("pair", F.explode(others)).select(F.xxhash64("band", "pair.i", "pair.j").alias("group"), "node")


def _may_link(sizes: np.ndarray, regs: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each member, the later ones that it may be linked with, and their estimates."""
    least = percent / 100 - MARGIN
    for i in range(len(sizes) - 1):
        rest = slice(i + 1, None)
        small, large = np.minimum(sizes[i], sizes[rest]), np.maximum(sizes[i], sizes[rest])
        likely = np.where(small < COARSE, 1.0, 0.0)
        at = np.flatnonzero(100 * small >= percent * large)
        if len(at):
            found = np.maximum(estimate(regs[i], regs[rest][at]), likely[at])
            good = found >= least
            yield i, at[good] + i + 1, found[good]


def _survivors(groups: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Members of groups that may be linked with another member, by size and estimate."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        regs = np.frombuffer(b"".join(frame["regs"]), dtype=np.uint16).reshape(-1, REGISTERS)
        stays = np.zeros(len(frame), dtype=bool)
        for i, partners, _ in _may_link(frame["n_shingles"].to_numpy(), regs, percent):
            stays[i] |= len(partners) > 0
            stays[partners] = True
        return frame.loc[stays, ["group", "node"]]

    return groups.join(nodes.select("node", "n_shingles", "regs"), "node").groupBy("group").applyInPandas(run, "group long, node binary")


def _confirm(members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join all that is linked within each group, confirmed on full sets: a tree for each component."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("node")
        data, offsets = text_buffers(pa.array(frame["text"], pa.large_string()))
        sets = shingle_sets(data, offsets, width)
        sizes = np.array([len(s) for s in sets])
        pairs = [(f, i, j) for i, partners, found in _may_link(sizes, registers(sets), percent) for j, f in zip(partners.tolist(), found.tolist(), strict=True)]
        root = list(range(len(sets)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for _, i, j in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
            a, b = find(i), find(j)
            if a != b:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= percent * (sizes[i] + sizes[j] - common):
                    root[max(a, b)] = min(a, b)
        node = frame["node"].tolist()
        tied = [(node[find(i)], node[i]) for i in range(len(node)) if find(i) != i]
        return pd.DataFrame(tied, columns=["a", "b"])

    return members.groupBy("group").applyInPandas(run, "a binary, b binary")


def _links(groups: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join all that is linked within each group."""
    members = cut(_survivors(groups, nodes, percent))
    wanted = cut(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "n_shingles"))
    # Rows that share an id may differ in text; the set of each text tells which is the node's.
    own = texts.join(bounded_broadcast(wanted), "doc_id")
    return _confirm(members.join(_own_text(own, width), "node"), width, percent)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of links (a, b): root is the component's least node.

    Large-star and small-star steps take turns until nothing changes; each is a minimum by node, found with partial
    aggregation, and an equi-join, so that a node with very many links is never gathered in one task: the minima are
    dealt anew before the join, whose sides are then plain exchanges that can be split. Every round starts from a table
    written to the shared folder.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).hint("rebalance")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).hint("rebalance")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = cut(small)
        if not new.join(edges, ["u", "v"], "left_anti").take(1) and not edges.join(new, ["u", "v"], "left_anti").take(1):
            break
        edges = new
    return new.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def bounded_broadcast(frame: DataFrame) -> DataFrame:
    """The rows marked for a broadcast if there are few enough, else as they are."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def _labelled(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, node, root (the node that names the component; both null without words or id), component_id."""
    found = cut(sketches(docs, key, text, width))
    linked = found.where("node is not null and doc_id is not null")
    nodes = cut(linked.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs")))
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    roots = cut(components(_links(candidate_groups(nodes), nodes, texts, width, percent)))
    label = roots.join(nodes.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("least"))
    labels = roots.join(label, "root").select("node", "root", "least")
    # Copies of texts that are linked with no other text still share their node's least id.
    # Written, so that the last join reads two plain exchanges: only then can a node with very many copies be split.
    named = cut(nodes.select("node", F.col("doc_id").alias("own")).join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("least", "own").alias("component")))
    own = found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    return own.join(named, "node", "left").select("doc_id", "n_shingles", "node", "root", F.coalesce("component", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets. component_id is the least
    id reachable by links. A document without words (or text) is linked with nothing. Repeated rows have equal sets and
    so one component; each is kept if its id is the component's. Keys are read as whole numbers; a row without one is
    linked with nothing: its component_id is null and it is kept. Candidates are found with a chance above 0.999999 at
    the threshold.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return _labelled(docs, key, text, width, percent).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def unique(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 85) -> DataFrame:
    """The rows of docs, with their own columns, less those that repeat another: one row of each component stays.

    It is the row with the least id, of rows that share this id one whose set of shingles has the least digest, and of
    identical rows one. Rows that share an id but are not alike are documents of their own and stay. So do rows without
    words or without an id, each of them.
    """
    labelled = cut(_labelled(docs, key, text, width, percent).select("doc_id", "node", "root"))
    named = labelled.where("node is not null")
    best = named.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("best")).select("best.*")
    often = cut(labelled.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    gone = cut(named.select("doc_id", "node").distinct().join(best, ["doc_id", "node"], "left_anti").select("doc_id").distinct())
    # Rows whose id no other row has are told apart by it; the few others by their id and set of shingles.
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).cast("long").alias("doc_id"))
    single = row.join(bounded_broadcast(gone.unionByName(often).distinct()), "doc_id", "left_anti").select("row.*")
    if not often.take(1):
        return single
    repeated = _with_node(row.join(bounded_broadcast(often), "doc_id", "left_semi").select("row", "doc_id", F.col(f"row.`{text}`").alias("text")), width)
    chosen = repeated.where("node is not null").join(best, ["doc_id", "node"], "left_semi").groupBy("doc_id", "node").agg(F.first("row").alias("row"))
    return single.unionByName(chosen.select("row.*")).unionByName(repeated.where("node is null").select("row.*"))


def _with_node(rows: DataFrame, width: int) -> DataFrame:
    """Adds the digest of each text's set of shingles (column `text`, which goes); null without words."""
    keep = [c for c in rows.columns if c != "text"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for own, data, offsets in batches(part, "text", 4 << 20):
                nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in shingle_sets(data, offsets, width)]
                yield pa.RecordBatch.from_arrays([*[own.column(c) for c in keep], pa.array(nodes, pa.binary())], names=[*keep, "node"])

    return small_batches(rows).mapInArrow(run, rows.select(*keep).schema.add("node", "binary"))


def _own_text(texts: DataFrame, width: int) -> DataFrame:
    """(node, text) of the rows whose text has the node's shingles."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows, data, offsets in batches(part, "text", 4 << 20):
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in shingle_sets(data, offsets, width)]
                own = [i for i, (d, n) in enumerate(zip(digests, rows.column("node").to_pylist(), strict=True)) if d == n]
                yield rows.select(["node", "text"]).take(pa.array(own, pa.int64()))

    return texts.select("node", "text").mapInArrow(run, "node binary, text string")
