"""URL rules by a cascade of Bloom filters, in DataFrame expressions only.

A rule is a host and a path; it fits the host and its subdomains where the path starts with the rule's. Every host
suffix and path prefix of a url that could be a rule is a key. The first filter of a cascade holds the listed keys, the
second those other keys of the corpus that pass the first, the third the listed keys that pass the second, and so on
until none is left over. For keys of that corpus the cascade is exact, and no join is needed. A list whose filters are
too large for a plan is dealt by a hash of its keys into parts with a cascade each; what they hold is then looked up.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: 64-bit words of filters that may travel inside a plan (1 MB); longer lists are dealt into parts.
MOST_WORDS = 1 << 17


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; then up to `?`, `#` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def keys(host: Column, path: Column, labels: list[int], sizes: list[int]) -> Column:
    """Keys of the url: host suffixes with these numbers of labels, each with path prefixes of these lengths."""
    parts = F.split(host, r"\.", -1)
    suffixes = [F.when(F.size(parts) >= n, F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")) for n in labels]
    prefixes = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sizes]
    return F.array_compact(F.array(*[F.concat(s, p) for s in suffixes for p in prefixes]))


class Cascade:
    """Filters as (hashes, bits, words); a key is listed if the first filter that it fails is an even one."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, int, list[int]]] = []

    def _passes(self, key: Column, level: int) -> Column:
        hashes, bits, words = self.levels[level]
        table = F.from_json(F.lit(json.dumps(words)), "array<bigint>")  # folded into one literal
        out = F.lit(True)
        for i in range(hashes):
            at = _place(key, level, i, bits)
            out = out & (F.get(table, F.shiftright(at, 6).cast("int")).bitwiseAND(_bit(at)) != 0)
        return out

    def holds(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(self._passes(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out

    def _add(self, members: DataFrame, n: int, false_positives: float) -> None:
        hashes = max(1, math.ceil(math.log2(1 / false_positives)))
        bits = 64 * max(1, math.ceil(n * math.log2(1 / false_positives) / math.log(2) / 64))
        level = len(self.levels)
        at = members.select(F.explode(F.array(*[_place(F.col("key"), level, i, bits) for i in range(hashes)])).alias("at"))
        words = [0] * (bits // 64)
        for row in at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(_bit(F.col("at"))).alias("bits")).collect():
            words[row["word"]] = row["bits"]
        self.levels.append((hashes, bits, words))

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame) -> Cascade:
        """A cascade exact for the keys of `universe` and `listed`.

        Both have a column `key` without nulls or repeats, and share no key. Each level holds a small part of the one before the last,
        so that the filters take some bits a listed key and grow with the logarithm of the universe only.
        """
        out = cls()
        n, total = listed.count(), universe.count()
        if not n:
            return out
        rate = _first_rate(n, total)
        inside, outside = listed, universe
        while n:
            out._add(inside, n, rate)
            rest = outside.where(out._passes(F.col("key"), len(out.levels) - 1))
            inside, outside = cut(rest), inside
            n, rate = inside.count(), 0.5
        return out


def _first_rate(listed: int, others: int) -> float:
    """False positives of the first filter that make the filters small in all."""
    return min(0.5, math.sqrt(0.5) * listed / max(1, others))


def words_needed(listed: int, others: int) -> int:
    """About as many words as the filters of a cascade take."""
    return math.ceil(2 * listed * math.log2(1 / _first_rate(listed, others)) / 64) if listed else 0


def _place(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(64 * level + i)), F.lit(bits).cast("long"))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict; columns with these names are replaced.

    rules: (host, path, `allow` or `block`). Of the rules that fit, the longest text host + path wins, of equally long
    ones that with the longer host; equal texts are one rule, and the last verdict holds. Without any the rule is null
    and the verdict the default. A null url, or one without `://`, has an empty host and path. Repeated rows repeat.
    """
    spark = pages.sparkSession
    verdicts = {h + p: v for h, p, v in rules}
    labels, sizes = sorted({h.count(".") + 1 for h, _, _ in rules}), sorted({len(p) for _, p, _ in rules})
    host, path = host_and_path(F.col(url))
    found = pages.drop("host", "path", "rule", "verdict").withColumn("host", host).withColumn("path", path)
    if not rules:
        return found.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    own = keys(F.col("host"), F.col("path"), labels, sizes)
    listed = spark.createDataFrame([(k, v) for k, v in sorted(verdicts.items())], "key string, verdict string")
    corpus = cut(found.select(F.explode(own).alias("key")).distinct())
    others = corpus.where(~F.col("key").isin(list(verdicts))) if len(verdicts) <= 1_000 else corpus.join(listed, "key", "left_anti")
    size, blocked = others.count(), sum(v == "block" for v in verdicts.values())
    need = words_needed(len(verdicts), size) + words_needed(blocked, size + len(verdicts) - blocked)
    if need > MOST_WORDS:
        return _by_join(found, own, _by_parts(corpus, others, listed, -(-need // max(8, MOST_WORDS))), default)
    in_rules, in_blocks = _cascades(listed, others)
    fitting = F.filter(own, lambda k: in_rules.holds(k))
    longest = F.array_max(F.transform(fitting, lambda k: F.struct(F.length(k).alias("size"), F.instr(k, "/").alias("host"), k.alias("key"))))["key"]
    return found.withColumn("rule", longest).withColumn("verdict", F.when(F.col("rule").isNull(), default).when(in_blocks.holds(F.col("rule")), "block").otherwise("allow"))


def _cascades(listed: DataFrame, others: DataFrame) -> tuple[Cascade, Cascade]:
    """Of all listed keys, and of those to block."""
    blocks, allows = (listed.where(F.col("verdict") == v).select("key") for v in ("block", "allow"))
    return Cascade.build(listed.select("key"), others), Cascade.build(blocks, others.unionByName(allows))


def _by_parts(corpus: DataFrame, others: DataFrame, listed: DataFrame, parts: int) -> DataFrame:
    """(key, verdict) of the corpus's keys that are listed, by a cascade for each part of the keys."""
    part = F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(parts))
    corpus, others, listed = (cut(x.withColumn("part", part)) for x in (corpus, others, listed))
    found = None
    for p in range(parts):
        own = lambda x, p=p: x.where(F.col("part") == p).drop("part")
        in_rules, in_blocks = _cascades(own(listed), own(others))
        held = own(corpus).where(in_rules.holds(F.col("key"))).select("key", F.when(in_blocks.holds(F.col("key")), "block").otherwise("allow").alias("verdict"))
        found = held if found is None else found.unionByName(held)
    return cut(found)


def _by_join(found: DataFrame, own: Column, listed: DataFrame, default: str) -> DataFrame:
    """For lists in parts: distinct urls' keys look up what the cascades hold, in an equi-join."""
    each = found.select("host", "path").distinct().select(F.explode(own).alias("key"), "host", "path").join(listed, "key")
    best = each.groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("size"), F.instr("key", "/").alias("at"), F.col("key").alias("rule"), "verdict")).alias("best"))
    return found.join(best.select("host", "path", "best.rule", "best.verdict"), ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
