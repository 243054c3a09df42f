"""What needs a model, behind small protocols with deterministic stand-ins; and what only handles its text and tokens."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import texts, vectors


class Embedder(Protocol):
    """Texts to vectors, in Arrow batches on the executors."""

    def __call__(self, texts: pd.Series) -> pd.Series: ...


class Judge(Protocol):
    """Prompts to replies, in Arrow batches on the executors."""

    def __call__(self, prompts: pd.Series) -> pd.Series: ...


class TokenLosses(Protocol):
    """The tokens of a prompt and its response to a loss for each of them, given what comes before it."""

    def __call__(self, tokens: list[str]) -> list[float]: ...


class PairScorer(Protocol):
    """Predictions and references to scores, in Arrow batches on the executors."""

    def __call__(self, predictions: pd.Series, references: pd.Series) -> pd.Series: ...


def overlap_f1(predictions: pd.Series, references: pd.Series) -> pd.Series:
    """Without a model: the harmonic mean of precision and recall over bags of tokens between blanks."""

    def one(a: str | None, b: str | None) -> float:
        x, y = Counter((a or "").split()), Counter((b or "").split())
        common = sum((x & y).values())
        return 2 * common / (sum(x.values()) + sum(y.values())) if common else 0.0

    return pd.Series([one(a, b) for a, b in zip(predictions, references, strict=True)], dtype="float64")


def score_pairs(rows: DataFrame, prediction: str, reference: str, scorers: dict[str, PairScorer]) -> DataFrame:
    """Adds language and score: the scorer of the reference's language, `zh` where it has such characters, else `en`.

    A language without a scorer of its own gets the overlap of tokens. Each scorer sees only its own language's rows.
    """
    routed = rows.withColumn("language", F.when(texts.has_cjk(F.coalesce(reference, F.lit(""))), "zh").otherwise("en"))
    score = F.lit(None).cast("double")
    for language in ("zh", "en"):
        call = F.pandas_udf(_routed(scorers.get(language, overlap_f1), language), T.DoubleType())
        score = F.coalesce(score, call(F.col("language"), F.col(prediction), F.col(reference)))
    return routed.withColumn("score", score)


def _routed(scorer: PairScorer, language: str):
    def call(languages: pd.Series, predictions: pd.Series, references: pd.Series) -> pd.Series:
        own = (languages == language).to_numpy()
        out = pd.Series([None] * len(languages), dtype="float64")
        if own.any():
            out[own] = scorer(predictions[own].reset_index(drop=True), references[own].reset_index(drop=True)).to_numpy()
        return out

    return call


def response_loss(rows: DataFrame, prompt: str, response: str, model: TokenLosses) -> DataFrame:
    """Adds loss: the mean of the model's losses over the response's tokens alone; null for a response without tokens.

    Tokens are runs between blanks. The model sees prompt and response in a row, and the prompt's losses are masked.
    """

    def one(a: str | None, b: str | None) -> float | None:
        before, own = (a or "").split(), (b or "").split()
        losses = model(before + own)[len(before) :] if own else []
        return sum(losses) / len(losses) if losses else None

    call = F.pandas_udf(lambda a, b: pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64"), T.DoubleType())
    return rows.withColumn("loss", call(F.col(prompt), F.col(response)))


def attention_weights(attention: Column, query: Column, demos: Column) -> Column:
    """Weights of demos with sum 1: mean attention of the query's tokens to each demo's, averaged over heads.

    attention: [head][from][to]; query: a span (start, end), demos: spans, ends exclusive and cut at the last token. A
    demo without tokens has weight 0; where no weight is positive, or the query has no tokens, all are equal.
    """
    width = F.size(F.get(attention, F.lit(0)))
    inside = lambda x: F.greatest(F.lit(0), F.least(x, width))
    part = lambda x, span: F.slice(x, inside(span["start"]) + 1, F.greatest(F.lit(0), inside(span["end"]) - inside(span["start"])))
    mean = lambda x: F.when(F.size(x) > 0, vectors.total(x) / F.size(x)).otherwise(0.0)
    of_head = lambda head, demo: mean(F.flatten(F.transform(part(head, query), lambda row: part(row, demo))))
    weights = F.transform(demos, lambda demo: mean(F.transform(attention, lambda head: of_head(head, demo))))
    return vectors.let(weights, lambda w: vectors.let(vectors.total(w), lambda t: F.transform(w, lambda x: F.when(t > 0, x / t).otherwise(1.0 / F.size(w)))))


def embed(rows: DataFrame, text: str, embedder: Embedder | None = None, width: int = 384) -> DataFrame:
    """Adds embedding: of the model, or without one the trigram hash, which needs no Python."""
    if embedder is None:
        return rows.withColumn("embedding", vectors.hash_embedding(F.col(text), width))
    call = F.pandas_udf(lambda s: embedder(s), T.ArrayType(T.DoubleType()))
    return rows.withColumn("embedding", call(F.col(text)))


def ask(rows: DataFrame, prompt: Column, judge: Judge | None = None, default: str = "no||no model") -> DataFrame:
    """Adds reply: of the model, or without one the default."""
    if judge is None:
        return rows.withColumn("reply", F.lit(default))
    return rows.withColumn("reply", F.pandas_udf(lambda s: judge(s), T.StringType())(prompt))


def relations(text: str | None, count: int) -> list[str]:
    """Relations by rank of a reply: an object or list in JSON, with ranks or in sequence, else words in order; those
    that are missing are unrelated."""
    out = ["unrelated"] * count
    raw = re.sub(r"```[a-z]*", "", text or "")
    found = re.search(r"\{.*\}|\[.*\]", raw, re.S)
    items: Iterable = ()
    if found:
        try:
            parsed = json.loads(found[0])
            items = parsed.get("relations", []) if isinstance(parsed, dict) else parsed
        except ValueError:
            items = ()
    items = list(items) or re.findall(r"strongly related|weakly related|unrelated", raw.lower())
    for i, item in enumerate(items):
        rank, word = (item.get("rank", i), str(item.get("relation", ""))) if isinstance(item, dict) else (i, str(item))
        if isinstance(rank, int) and 0 <= rank < count:
            word = word.lower()
            out[rank] = "strongly related" if "strong" in word else "weakly related" if "weak" in word else "unrelated"
    return out


def relations_of(reply: Column, count: int) -> Column:
    return F.pandas_udf(lambda s: pd.Series([relations(x, count) for x in s]), T.ArrayType(T.StringType()))(reply)


def demos_in_budget(demos: Column, sizes: Column, query_size: Column, budget: int) -> Column:
    """The last demos that fit beside the query: the earliest go first, one stays in any case."""
    n = F.size(demos)
    fits = F.filter(F.sequence(F.lit(1), n), lambda k: F.aggregate(F.slice(sizes, -k, k), query_size.cast("long"), lambda a, x: a + x) <= budget)
    keep = F.greatest(F.lit(1), F.coalesce(F.array_max(fits), F.lit(1)))
    return F.slice(demos, -keep, keep)


def loss_window(prefix: Column, target: Column, most: int, end: Column) -> Column:
    """Tokens of prefix and target within `most`: the prefix loses its beginning, the target stays; an empty or
    one-token target is followed by the end token."""
    whole = F.when(F.size(target) < 2, F.concat(target, F.array(end))).otherwise(target)
    room = F.greatest(F.lit(0), most - F.size(whole))
    kept = F.when(room == 0, F.slice(prefix, 1, 0)).otherwise(F.slice(prefix, -F.least(room, F.size(prefix)), F.least(room, F.size(prefix))))
    return F.slice(F.concat(F.when(F.size(prefix) > 0, kept).otherwise(prefix), whole), F.lit(1), F.lit(most))


def gradient(parts: Column, most: int) -> Column:
    """Flattened, cut to `most` entries, at unit length."""
    flat = F.slice(F.flatten(parts), 1, most)
    return vectors.let(flat, vectors.normalized)
