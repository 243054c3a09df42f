"""Exact top-k search by aggregation without random access.

Each dimension is a list of the candidates' contributions to a query's score, best first: descending components for a
positive query component, ascending ones for a negative. All lists are read to the same depth. A candidate's score then
lies between bounds: what has been read of it, plus for each unread list at most the last value read and at least the
list's last value. Candidates whose upper bound is below the k-th best lower bound are out; the lists are read deeper
until few are left or no outsider can qualify, and then those candidates' final scores are resolved.

Candidates and queries meet in cells of a grid of blocks, so that neither side is ever gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import cut

#: Relative error of a sum of products in floating point, a term.
_ROUNDING = 2.0**-51


def quantized(embeddings: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """vec_id and codes: floor(scale * x) of each component; rows with a null id or vector, or a component that is null
    or not finite, are left out."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return embeddings.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & good).select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale)).alias("codes"))


def no_random_access(items: np.ndarray, queries: np.ndarray, k: int, exclude: np.ndarray) -> list[np.ndarray]:
    """For each query, rows of `items` that hold its k best by inner product; `exclude` [query, item] marks rows that don't count.

    Bounds are computed for all queries at once at depths that double; a query ends when its candidates are few. They
    are wider than the exact ones by what floating point may round, so that they hold for numbers of any size.
    """
    n, d = items.shape
    if not n:
        return [np.zeros(0, dtype=np.int64)] * len(queries)
    slack = _ROUNDING * d * d * float(np.abs(items).max(initial=0)) * float(np.abs(queries).max(initial=0))
    order = np.argsort(-items, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    ordered = np.take_along_axis(items, order, axis=0)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    left: dict[int, np.ndarray] = {}
    going = np.arange(len(queries))
    depth = min(n, max(4 * k, n // 8))
    while len(going):
        high, low = ordered[depth - 1], ordered[n - depth]  # the last values read from above and from below
        top, bottom = ordered[0], ordered[n - 1]
        seen_up, seen_down = rank < depth, rank >= n - depth
        p, q = up[going], down[going]
        # Known contributions, and bounds of the unknown ones.
        upper = np.where(seen_up, items, high) @ p.T + np.where(seen_down, items, low) @ q.T
        lower = np.where(seen_up, items, bottom) @ p.T + np.where(seen_down, items, top) @ q.T
        out = exclude[going].T
        lower[out], upper[out] = -np.inf, -np.inf
        kth = np.partition(lower, n - k, axis=0)[n - k] if n > k else np.full(len(going), -np.inf)
        stays = (upper + slack >= kth - slack) & ~out
        few = (stays.sum(axis=0) <= max(16 * k, n // 8)) | (depth == n)
        for i in np.flatnonzero(few):
            left[int(going[i])] = np.flatnonzero(stays[:, i])
        going = going[~few]
        depth = min(n, 2 * depth)
    return [left[i] for i in range(len(queries))]


def search(embeddings: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256, block: int = 4_096, query_block: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other rows by the inner product of codes.

    Ties go to the smaller id. Rows that repeat the query's own id are its own and don't count; otherwise repeated rows
    count each. Shorter vectors count as if zeros followed. Scores are exact while they fit 64 bits.
    """
    rows = cut(quantized(embeddings, key, vector, scale))
    asking = rows.where(is_query)
    total, asked = rows.count(), asking.count()
    blocks, groups = max(1, round(total / block)), max(1, round(asked / query_block))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    deal = lambda n, name: F.pmod(F.xxhash64("vec_id", "codes"), F.lit(n)).cast("int").alias(name)
    items = rows.select("vec_id", "codes", deal(blocks, "i"), every(groups, "j"))
    queries = asking.select("vec_id", "codes", deal(groups, "j"), every(blocks, "i")).dropDuplicates(["vec_id", "codes", "i"])

    def cell(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(own) or not len(ask):
            return pd.DataFrame({c: [] for c in names}, dtype="int64")
        width = max(map(len, [*own["codes"], *ask["codes"]]))
        dense = lambda codes: np.array([[*c, *[0] * (width - len(c))] for c in codes], dtype=np.int64).reshape(len(codes), width)
        x, y = dense(own["codes"]), dense(ask["codes"])
        ids, query_ids = own["vec_id"].to_numpy(), ask["vec_id"].to_numpy()
        exclude = query_ids[:, None] == ids[None, :]
        found = no_random_access(x.astype(np.float64), y.astype(np.float64), k, exclude)
        out = []
        for q, at in enumerate(found):
            scores = x[at] @ y[q]
            best = np.lexsort((ids[at], -scores))[:k]
            out += zip([query_ids[q]] * len(best), ids[at][best], scores[best], strict=True)
        return pd.DataFrame(out, columns=names, dtype="int64")

    near = items.groupBy("i", "j").cogroup(queries.groupBy("i", "j")).applyInPandas(cell, "query_id long, vec_id long, score long")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
