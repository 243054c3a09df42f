"""Mixing sources to target weights by temperature.

Shares of tokens are raised to an exponent and normalised. The exponent is found by bisection: the largest one whose
weights have at least the target entropy and, going down to 0 (equal weights), the least one that repeats no source more
often than allowed. The weights are realised in whole passes over each source and one part of a pass, taken block by
block in a permutation that a hash fixes; of each source only the block where its budget ends is ordered row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import cut

#: Blocks that may be broadcast; beyond it rows and blocks are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Ranges of hashes (three hexadecimal digits) by which a source's blocks are ordered.
RANGES = 4_096
#: A token, for counting: a run of other than white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def weights(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """Normalised powers of the sources' shares; a source without tokens has none."""
    total = sum(tokens.values())
    powers = {s: (n / total) ** exponent if n else 0.0 for s, n in tokens.items()} if total else dict.fromkeys(tokens, 0.0)
    norm = sum(powers[s] for s in sorted(powers))
    return {s: p / norm if norm else 0.0 for s, p in powers.items()}


def entropy(parts: dict[str, float]) -> float:
    """Of the weights, in nats, as a share of the most that so many sources can have; 1 for a single source."""
    some = [p for p in parts.values() if p > 0]
    return -sum(p * math.log(p) for p in some) / math.log(len(some)) if len(some) > 1 else 1.0


def passes(tokens: dict[str, int], parts: dict[str, float]) -> dict[str, float]:
    """How often each source is read if the one that is read least is read once."""
    often = {s: parts[s] / n for s, n in tokens.items() if n}
    least = min(often.values(), default=1.0)
    return {s: often[s] / least if s in often else 1.0 for s in tokens}


def solve(tokens: dict[str, int], target_entropy: float, most_passes: float, rounds: int = 60) -> float:
    """The exponent in [0, 1], by bisection.

    Entropy falls and repetition falls as the exponent grows. Where the entropy can only be met by more repetition than
    allowed, the limit on repetition holds.
    """

    def least(good) -> float:
        """The boundary of a condition that holds below it, or at 0 alone."""
        if good(1.0):
            return 1.0
        low, high = 0.0, 1.0
        for _ in range(rounds):
            middle = (low + high) / 2
            low, high = (middle, high) if good(middle) else (low, middle)
        return low

    wanted = least(lambda e: entropy(weights(tokens, e)) >= target_entropy)
    bound = least(lambda e: max(passes(tokens, weights(tokens, e)).values(), default=1.0) > most_passes)
    return max(wanted, min(1.0, bound + 1e-12))


def mix(docs: DataFrame, source: str, size: Column, key: str, target_entropy: float = 0.9, most_passes: float = 2.0, rows_a_block: int = 256, seed: int = 17) -> DataFrame:
    """Adds mix_weight, mix_passes (of the row's source) and copies (how often the row is in the mixture).

    The source that is read least is read exactly once: no row is lost. Others repeat whole passes, then the blocks
    that come first in their permutation until the budget of the last pass is spent; rows of the block where it ends
    count while the tokens before them and their own fit. A null source is a source of its own. A null or negative size
    counts as 0. Rows with equal keys come by size. Columns with the added names are replaced.
    """
    spark = docs.sparkSession
    kept = docs.drop("mix_weight", "mix_passes", "copies")
    # The caller's columns travel as one, so that no name can clash.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row"), F.coalesce(F.col(source), F.lit("\u0000null")).alias("source"), F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("size"), F.col(key).cast("string").alias("key"))
    totals = {r["source"]: (r["rows"], r["tokens"]) for r in own.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("tokens")).collect()}
    tokens = {s: n for s, (_, n) in totals.items()}
    parts = weights(tokens, solve(tokens, target_entropy, most_passes))
    often = passes(tokens, parts)
    plan = []
    for s, (rows, n) in sorted(totals.items()):
        whole = int(often[s] + 1e-9)
        plan.append((s, parts[s], often[s], whole, round(max(0.0, often[s] - whole) * n), max(1, math.ceil(rows / rows_a_block))))
    sources = F.broadcast(spark.createDataFrame(plan, "source string, mix_weight double, mix_passes double, whole int, rest long, blocks long"))  # a row a source
    order = F.md5(F.concat_ws(":", F.lit(seed), "key").cast("binary"))
    dealt = own.join(sources, "source").withColumn("order", order).withColumn("block", F.conv(F.substring("order", 1, 8), 16, 10).cast("long") % F.col("blocks"))
    placed = cut(_blocks_in_turn(dealt, seed).select("source", "block", "left", (F.col("left") >= F.col("tokens")).alias("in")))
    joined = dealt.join(F.broadcast(placed) if placed.count() <= BROADCAST_ROWS else placed, ["source", "block"])
    divided = ~F.col("in") & (F.col("left") > 0)
    inside = Window.partitionBy("source", "block").orderBy("order", "size")
    last = joined.where(divided).withColumn("extra", (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) <= F.col("left")).cast("int"))
    both = joined.where(~divided).withColumn("extra", F.col("in").cast("int")).unionByName(last)
    return both.select("row.*", "mix_weight", "mix_passes", (F.col("whole") + F.col("extra")).alias("copies"))


def _blocks_in_turn(dealt: DataFrame, seed: int) -> DataFrame:
    """source, block, tokens, left: what is left of the source's budget when its block's turn comes.

    A source's blocks come in the order of a hash. The tokens before a block are those of the ranges of hashes before
    its own, of which there are RANGES, and those before it in its range: no task orders all blocks of a source.
    """
    turn = F.md5(F.concat_ws(":", F.lit(seed + 1), "source", "block").cast("binary"))
    blocks = dealt.groupBy("source", "block").agg(F.sum("size").alias("tokens"), F.first("rest").alias("rest")).withColumn("turn", turn).withColumn("range", F.substring("turn", 1, 3))
    blocks = cut(blocks)
    before = lambda window: F.sum("tokens").over(window) - F.col("tokens")
    ranges = blocks.groupBy("source", "range").agg(F.sum("tokens").alias("tokens"))
    ranges = ranges.select("source", "range", before(Window.partitionBy("source").orderBy("range")).alias("earlier"))
    inside = before(Window.partitionBy("source", "range").orderBy("turn", "block"))
    return blocks.withColumn("inside", inside).join(ranges, ["source", "range"]).withColumn("left", F.col("rest") - F.col("earlier") - F.col("inside"))
