"""Budgeted selection: scalar top-k, greedy coverage, quotas, and samples in an order that any engine can repeat."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from lodestone.operators.ingest import hash_order, top_of_each
from lodestone.sources.tables import cut

Vector = dict[int, float]


#: Rows that one task may sort for a limit; more are found by positions over sorted ranges.
MOST_SORTED = 100_000
#: Vectors that a greedy selection may hold on the driver at once.
MOST_HELD = 200_000


def first_rows(rows: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows in an order, which has no ties; with `position` from 0."""
    if k > MOST_SORTED:
        return positions(rows, *order).where(F.col("position") < k)
    best = rows.orderBy(*order).limit(max(0, k))
    return best.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long") - 1)


def scalar_topk(rows: DataFrame, scalar: str, position: str, k: int) -> DataFrame:
    """The k rows with the largest scalar, nulls last, ties by position; adds selection_rank from 1."""
    place = f"_{position}"
    best = first_rows(rows.withColumn(place, F.col(position)), k, F.desc_nulls_last(scalar), F.col(place))
    ranked = best.withColumn("selection_rank", (F.col("position") + 1).cast("int"))
    return (ranked.drop("position") if position != "position" else ranked.withColumn("position", F.col(place))).drop(place)


def lazy_greedy(rows: DataFrame, k: int, gain: Callable[[Vector, Vector], float], step_gain: Callable[[Column, Column], Column], page: int = 2_000, most: int = MOST_HELD) -> list[tuple[int, float]]:
    """(position, gain) of k rows, each the best given those before it.

    rows: position, vector (map of int to double). gain is that of a vector, given the totals; step_gain the same as a
    column for one entry, given its total. Gains must only fall as totals grow (a submodular objective), so that a gain
    computed earlier is an upper bound. Ties: gain (to 12 places), then the vector's sum, then position.

    A pass over all rows finds the `page` best at the totals so far (`most` at most). The driver chooses among them while
    the best of them comes before where the last of them stood, which no row that it lacks can do. So a pass chooses one
    row at least, and the driver gets k pages at most, however many rows there are and however alike their gains.
    """
    held = cut(rows.select("position", F.coalesce("vector", F.create_map().cast(rows.schema["vector"].dataType)).alias("vector")))
    totals: Vector = {}
    out: list[tuple[int, float]] = []
    page = max(1, min(page, most))
    while len(out) < k:
        found = _best_at(held, page, [p for p, _ in out], totals, step_gain)
        vectors = {r["position"]: {int(i): float(x) for i, x in r["vector"].items()} for r in found}
        heap = [(-r["gain"], -r["sum"], r["position"], len(out)) for r in found]
        last = max(heap)[:3] if len(found) == page else None
        heapq.heapify(heap)
        if not heap:
            break
        while heap and len(out) < k and (last is None or heap[0][:3] <= last):
            g, s, position, step = heapq.heappop(heap)
            if step == len(out):
                out.append((position, -g))
                for i, x in vectors[position].items():
                    totals[i] = totals.get(i, 0.0) + x
            else:
                heapq.heappush(heap, (-round(gain(vectors[position], totals), 12), s, position, len(out)))
    return out


def _best_at(rows: DataFrame, page: int, chosen: list[int], totals: Vector, step_gain: Callable[[Column, Column], Column]) -> list[Row]:
    """(position, vector, gain, sum) of the best rows at these totals. They come as one row: a collected limit would send
    the driver a page from each partition."""
    known = F.create_map(*[F.lit(x) for i, t in sorted(totals.items()) for x in (i, t)]) if totals else F.create_map().cast("map<int,double>")
    add = lambda f: F.round(F.aggregate(F.array_sort(F.map_entries("vector")), F.lit(0.0), lambda a, e: a + f(e)), 12)
    value = add(lambda e: step_gain(e["value"], F.coalesce(F.element_at(known, e["key"]), F.lit(0.0))))
    left = rows.where(~F.col("position").isin(chosen)) if chosen else rows
    best = left.select("position", "vector", value.alias("gain"), add(lambda e: e["value"]).alias("sum")).orderBy(F.desc("gain"), F.desc("sum"), "position").limit(page)
    return best.agg(F.collect_list(F.struct("position", "vector", "gain", "sum")).alias("best")).first()["best"]


def coverage_gain(vector: Vector, totals: Vector) -> float:
    return sum(math.log1p(totals.get(i, 0.0) + x) - math.log1p(totals.get(i, 0.0)) for i, x in sorted(vector.items()))


def vector_greedy(rows: DataFrame, k: int, page: int = 2_000, most: int = MOST_HELD) -> list[tuple[int, float]]:
    """Maximise the sum of log(1 + total) over dimensions. rows: position, vector of positive entries."""
    step = lambda x, t: F.log1p(t + x) - F.log1p(t)
    return lazy_greedy(rows, k, coverage_gain, step, page, most)


def mig_greedy(rows: DataFrame, k: int, page: int = 2_000, a: float = 1.0, b: float = 0.8, phi: str = "pow", alpha: float = 1.0) -> list[tuple[int, float]]:
    """Maximum information gain by first-order gains: the product with a derivative at the totals.

    rows: position, vector already propagated over the label graph. phi `pow` is (x + a)^b, `exp` is 1 - e^(-alpha x);
    both derivatives fall as totals grow, for b <= 1.
    """
    if phi not in ("pow", "exp"):
        raise ValueError(f"phi is pow or exp, not {phi}")

    def slope(total: float) -> float:
        return b * (total + a) ** (b - 1) if phi == "pow" else alpha * math.exp(-alpha * total)

    def gain(vector: Vector, totals: Vector) -> float:
        return sum(x * slope(totals.get(i, 0.0)) for i, x in sorted(vector.items()))

    step = lambda x, t: x * (b * F.pow(t + a, b - 1) if phi == "pow" else alpha * F.exp(-alpha * t))
    return lazy_greedy(rows, k, gain, step, page)


#: Candidate rows of diverse sampling that may come to the driver.
MOST_CANDIDATES = 200_000


def diverse(rows: DataFrame, k: int, most: int = MOST_CANDIDATES) -> DataFrame:
    """(position, chosen): complexity-first diverse sampling of rows with tags.

    Rows are ordered by number of tags, most first, then position. A round takes every row that adds a tag to those of
    the round. A row does so exactly if it is the first of those left with one of its tags: an earlier row with that tag
    would have added it. So a round is one minimum for each tag, and rounds go on until k rows are chosen; rows without
    tags fill up. chosen counts from 1.

    No row that k others precede with each of its tags can be chosen. The first k rows of every tag, found with partial
    limits, are therefore all that matters; if they are few, the rounds run over them on the driver, else as aggregates.
    """
    order = F.struct((-F.size("tags")).alias("n"), F.col("position"))
    left = cut(rows.select("position", F.coalesce("tags", F.array().cast("array<string>")).alias("tags")).withColumn("o", order))
    each = left.select("position", "o", F.explode(F.array_distinct("tags")).alias("tag"))
    first = cut(top_of_each(each, "tag", max(1, k), F.col("o")).select("o", "tag"))
    if first.count() <= most:
        chosen = _rounds([((r["o"]["n"], r["o"]["position"]), r["tag"]) for r in first.collect()], k)
        taken = left.sparkSession.createDataFrame([(p, i + 1) for i, p in enumerate(chosen)], f"position {left.schema['position'].dataType.simpleString()}, chosen int")
        return _filled(left, taken, len(chosen), k)
    taken, before = None, 0
    while before < k:
        picked = cut(left.select("o", F.explode("tags").alias("tag")).groupBy("tag").agg(F.min("o").alias("o")).select("o").distinct())
        n = picked.count()
        if not n:
            break
        at = F.row_number().over(Window.orderBy("o")) + before
        part = picked.orderBy("o").limit(k - before).select(F.col("o.position").alias("position"), at.cast("int").alias("chosen"))
        taken = part if taken is None else taken.unionByName(part)
        before += min(n, k - before)
        left = cut(left.join(picked, "o", "left_anti"))
    return _filled(left, taken, before, k) if taken is not None else _filled(left, left.select("position", F.lit(0).alias("chosen")).limit(0), 0, k)


def _rounds(tagged: list[tuple], k: int) -> list:
    """Positions in the order in which rounds choose them: each takes the first row left of every tag."""
    lists: dict[str, list] = {}
    for o, tag in sorted(tagged):
        lists.setdefault(tag, []).append(o)
    out, gone = [], set()
    while len(out) < k:
        for tag in list(lists):
            while lists[tag] and lists[tag][0] in gone:
                lists[tag].pop(0)
            if not lists[tag]:
                del lists[tag]
        if not lists:
            break
        picked = sorted({own[0] for own in lists.values()})[: k - len(out)]
        gone.update(picked)
        out += [position for _, position in picked]
    return out


def _filled(left: DataFrame, taken: DataFrame, n: int, k: int) -> DataFrame:
    """Rows that are left, in order, up to k."""
    if n >= k:
        return taken
    rest = left.join(taken.select("position"), "position", "left_anti").orderBy("o").limit(k - n)
    return taken.unionByName(rest.select("position", (F.row_number().over(Window.orderBy("o")) + n).cast("int").alias("chosen")))


def quotas(sizes: DataFrame, group: str, size: str, budget: int) -> DataFrame:
    """(group, size, quota): Hamilton's largest remainders, at most the size; ties to the lesser group.

    Groups are few: what does not fit a full group goes round the others by remainder until the budget is spent.
    """
    rows = [(r[group], int(r[size])) for r in sizes.orderBy(group).collect()]
    total = sum(n for _, n in rows)
    exact = [budget * n / total if total else 0.0 for _, n in rows]
    out = [min(int(x), n) for x, (_, n) in zip(exact, rows, strict=True)]
    order = sorted(range(len(rows)), key=lambda i: (-(exact[i] - int(exact[i])), i))
    rest = budget - sum(out)
    while rest > 0 and any(out[i] < rows[i][1] for i in order):
        for i in order:
            if rest and out[i] < rows[i][1]:
                out[i] += 1
                rest -= 1
    kind = sizes.schema[group].dataType.simpleString()
    return sizes.sparkSession.createDataFrame([(g, n, q) for (g, n), q in zip(rows, out, strict=True)], f"{group} {kind}, {size} long, quota long")


def uniform_quotas(sizes: DataFrame, group: str, size: str, budget: int) -> DataFrame:
    """(group, size, quota): equal shares, the first groups one more, at most the size."""
    rows = [(r[group], int(r[size])) for r in sizes.orderBy(group).collect()]
    each, more = divmod(budget, max(1, len(rows)))
    kind = sizes.schema[group].dataType.simpleString()
    return sizes.sparkSession.createDataFrame([(g, n, min(n, each + (i < more))) for i, (g, n) in enumerate(rows)], f"{group} {kind}, {size} long, quota long")


def sample_by_quota(rows: DataFrame, key: str, group: str, plan: DataFrame, budget: int, seed: int = 42) -> DataFrame:
    """Rows of each group up to its quota, in hash order; what is missing to the budget comes from all others, likewise.

    The plan has a row a group; the largest quota bounds what each group sends to the window.
    """
    most = plan.agg(F.max("quota").alias("q")).first()["q"] or 0
    top = top_of_each(rows, group, most, hash_order(key, seed), F.col(key)).join(plan.select(group, "quota"), group)
    picked = cut(top.where(F.col("rank_in_group") <= F.col("quota")).drop("rank_in_group", "quota"))
    missing = budget - picked.count()
    if missing <= 0:
        return picked
    others = simple_sample(rows.join(picked.select(key), key, "left_anti"), key, missing, seed)
    return picked.unionByName(others.select(*picked.columns))


def simple_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first n rows in hash order."""
    return first_rows(rows.select(F.struct(*rows.columns).alias("row"), F.col(key).alias("key")), n, hash_order("key", seed), F.col("key")).select("row.*")


def split(rows: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """Adds is_test for max(1, int(n * ratio)) rows, at most all but one, in hash order."""
    n = rows.count()
    wanted = min(max(1, int(n * ratio)), max(0, n - 1))
    test = simple_sample(rows.select(key), key, wanted, seed).withColumn("is_test", F.lit(True))
    return rows.join(test, key, "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))


def positions(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Adds position from 0 in the order, without one task seeing all rows: ranges are sorted and counted, then offset."""
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()  # a row a partition
    offsets, total = [], 0
    for r in sizes:
        offsets += [F.lit(r["_part"]), F.lit(total)]
        total += r["n"]
    if not offsets:
        return rows.withColumn("position", F.lit(0).cast("long"))
    return ranged.withColumn("position", (F.col("_at") + F.element_at(F.create_map(*offsets), F.col("_part"))).cast("long")).drop("_part", "_at")


def chunks(rows: DataFrame, count: int, *order: Column | str) -> DataFrame:
    """Adds position and chunk: `count` runs of ceil(n / count) rows in the order."""
    n = rows.count()
    size = max(1, -(-n // max(1, count)))
    return positions(rows, *order).withColumn("chunk", F.floor(F.col("position") / size).cast("int"))


def interleaved(near: DataFrame, far: DataFrame, key: str, ratio: float) -> DataFrame:
    """One queue of both: the i-th near row stands at i / ratio, the i-th far one at i / (1 - ratio); near wins ties."""
    place = lambda rows, share, side: positions(rows, key).withColumn("_place", (F.col("position") + 1) / share).withColumn("_side", F.lit(side)).drop("position")
    both = place(near, ratio, 0).unionByName(place(far, 1 - ratio, 1))
    return positions(both, "_place", "_side", key).drop("_place", "_side")
