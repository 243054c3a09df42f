"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text is built for every language. A text is parsed greedily against each of them: the
longest match from the present place is one phrase, then parsing goes on behind it. The language that needs the fewest
phrases, each weighed by the cost of pointing into its labelled text, wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bytewise import batches, keep_only, release
from lodestone.llm.shared import small_batches

#: A-Z and a-z share a class; each byte of other letters has its own; all else is class 0.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:256] = 27 + np.arange(128)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Parts of a labelled text that is too long to be learned whole.
STRETCHES = 8
_FLAG = np.int32(-(1 << 31))
_REST = np.int32((1 << 31) - 1)
_automata: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _automaton(codes: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix automaton as two full tables [state, class]: the next state, and whether a phrase begins there.

    Where a state has no way on, its phrase has ended and the class begins another from the root.
    """
    link, length, ways = [-1], [0], [{}]
    last = 0
    for c in codes:
        new = len(ways)
        length.append(length[last] + 1)
        link.append(0)
        ways.append({})
        p = last
        while p != -1 and c not in ways[p]:
            ways[p][c] = new
            p = link[p]
        if p != -1:
            q = ways[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(ways)
                length.append(length[p] + 1)
                link.append(link[q])
                ways.append(dict(ways[q]))
                while p != -1 and ways[p].get(c) == q:
                    ways[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.full((len(ways), width), -1, dtype=np.int32)
    for state, way in enumerate(ways):
        if way:
            table[state, list(way)] = list(way.values())
    root = np.where(table[0] < 0, 0, table[0])  # a class that the text lacks is a phrase of its own
    missing = table < 0
    missing[0] = True
    np.copyto(table, np.broadcast_to(root, table.shape), where=missing)
    return table, missing


def _tables(model: tuple[tuple[str, bytes], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All languages' automata in one array of places: the classes of bytes, each root's place, and the array."""
    keep_only(_automata)
    if model not in _automata:
        seen = np.unique(np.concatenate([_CLASS[np.frombuffer(text, np.uint8)] for _, text in model]))
        narrow = np.zeros(256, dtype=np.int32)  # classes that no labelled text holds share one
        width = len(seen) + 1
        narrow[seen] = np.arange(len(seen))
        narrow[np.setdiff1d(np.arange(256), seen)] = width - 1
        roots, parts, base = [], [], 0
        for _, text in model:
            to, begins = _automaton(narrow[_CLASS[np.frombuffer(text, np.uint8)]].tolist(), width)
            to *= width
            to += base
            to[begins] |= _FLAG
            parts.append(to.ravel())
            roots.append(base)
            base += to.size
            release()
        _automata.clear()
        _automata[model] = narrow[_CLASS], np.array(roots, dtype=np.int32), np.concatenate(parts)
    return _automata[model]


def phrases(model: tuple[tuple[str, bytes], ...], data: np.ndarray, offsets: np.ndarray, block: int, whole: bool = False) -> np.ndarray:
    """The number of phrases [language, text] of the greedy parse of each text, by blocks of `block` bytes side by side.

    Each block is parsed as if a phrase began there. For parses of `whole` texts, every block is then parsed again from
    the state in which the one before it ended, as far as the two parses differ: once they meet in one state they go on
    alike. So the counts are those of a single parse, whatever the block.
    """
    classes, roots, table = _tables(model)
    codes = classes[data]
    sizes = np.diff(offsets)
    per = -(-sizes // block)
    text_of = np.repeat(np.arange(len(sizes)), per)
    index = np.arange(len(text_of)) - np.repeat(np.cumsum(per) - per, per)
    start = offsets[text_of] + index * block
    length = np.minimum(block, offsets[text_of + 1] - start)
    order = np.argsort(-length, kind="stable")
    by_length, at = length[order], start[order]
    count = np.zeros((len(roots), len(order)), dtype=np.int32)
    state = np.repeat(roots[:, None], len(order), axis=1)
    last = state.copy()
    running = np.searchsorted(-by_length, -np.arange(by_length[0] if len(order) else 0), side="left")
    for step, n in enumerate(running):
        if n < state.shape[1]:
            last[:, n : state.shape[1]] = state[:, n:]
            state = np.ascontiguousarray(state[:, :n])
        to = table.take(state + codes.take(at[:n] + step)[None, :])
        count[:, :n] -= to >> 31
        state = to & _REST
    last[:, : state.shape[1]] = state
    back = np.argsort(order)
    count, last = count[:, back].astype(np.int64), last[:, back]
    begun = np.repeat(roots[:, None], len(order), axis=1)
    language, piece = np.nonzero(np.broadcast_to(index > 0, count.shape))
    while whole and len(piece):
        language, piece = _join(table, codes, begun, start, length, index, count, last, language, piece)
    total = np.zeros((len(roots), len(sizes)), dtype=np.int64)
    for i in range(len(roots)):
        total[i] = np.bincount(text_of, weights=count[i], minlength=len(sizes))
    return total


def _join(table: np.ndarray, codes: np.ndarray, begun: np.ndarray, start: np.ndarray, length: np.ndarray, index: np.ndarray, count: np.ndarray, last: np.ndarray, language: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correct the counts of these blocks, parsed from the states in `begun`, where the block before ended in another one.

    Returns the blocks after those whose own last state thereby changed, which is rare: they have to be corrected again.
    """
    true, parsed = last[language, piece - 1], begun[language, piece]
    begun[language, piece] = true
    fixed = np.zeros(len(piece), dtype=np.int64)
    left, step = np.flatnonzero(true != parsed), 0
    ended = []
    while len(left):
        done = step >= length[piece[left]]
        ended.append(left[done])
        left = left[~done]
        code = codes[start[piece[left]] + step]
        one, other = table[true[left] + code], table[parsed[left] + code]
        fixed[left] += (other >> 31).astype(np.int64) - (one >> 31)
        true[left], parsed[left] = one & _REST, other & _REST
        left, step = left[true[left] != parsed[left]], step + 1
    at = np.concatenate(ended) if ended else np.zeros(0, dtype=np.int64)
    changed = at[last[language[at], piece[at]] != true[at]]
    count[language, piece] += fixed
    last[language[changed], piece[changed]] = true[changed]
    follows = np.flatnonzero(piece[changed] + 1 < len(index))
    changed = changed[follows]
    changed = changed[index[piece[changed] + 1] > 0]
    return language[changed], piece[changed] + 1


def has_letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds any letter of any script."""
    before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_LETTER[data], out=before[1:])
    found = before[offsets[1:]] > before[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
        found[i] = any(c.isalpha() for c in text)
    return found


def fit(docs: DataFrame, training: Column, text: str, label: str, key: str, chars: int = 32_768, texts: int = 64) -> tuple[tuple[str, bytes], ...]:
    """A bounded sample of labelled text for each language: (language, text) by language.

    The sample holds whole labelled texts, those with the least hash of their key, up to `chars` characters a language;
    of a text that is longer than what is left of them it holds stretches, spread evenly over the text. About twice `texts` texts of each language reach the driver, however large the table. Rows with a null
    text or label teach nothing. Each label has an automaton in every worker: labels are meant to be few, as languages are.
    """
    usable = docs.where(training & F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("at"))
    sizes = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return ()
    limit = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(2 * texts * 2**64 // n, 2**64 - 1) - 2**63)]), F.col("label"))
    each = chars // STRETCHES - 1
    stretch = lambda i: F.substr("text", F.floor(i * (F.length("text") - each) / (STRETCHES - 1)).cast("int") + 1, F.lit(each))
    stretches = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), stretch), "\n")
    sample = usable.where(F.col("at") <= limit).select("label", "at", F.when(F.length("text") < chars, F.col("text")).otherwise(stretches).alias("text")).collect()
    out = []
    for language in sorted(sizes):
        part = ""
        for row in sorted((r for r in sample if r["label"] == language), key=lambda r: (r["at"], r["text"])):
            room = chars - len(part)
            if room > len(row["text"]):
                part += row["text"] + "\n"
            elif room:
                part += _stretches(row["text"], room)
        out.append((language, part.encode()))
    return tuple(out)


def _stretches(text: str, room: int) -> str:
    """Evenly spread parts of a text, with a line feed after each, `room` characters in all."""
    n = max(1, min(STRETCHES, room // 64))
    ends = [room * (i + 1) // n for i in range(n)]
    sizes = [b - a - 1 for a, b in zip([0, *ends], ends, strict=False)]
    return "".join(text[(at := i * (len(text) - size) // max(1, n - 1)) : at + size] + "\n" for i, size in enumerate(sizes))


def identify(docs: DataFrame, model: tuple[tuple[str, bytes], ...], text: str = "text", block: int = 4_096) -> DataFrame:
    """Adds lang_pred and score to the rows.

    lang_pred is the language with the least phrases * log2(1 + its labelled bytes); ties go to the lesser name. score
    is 1 - least / second least, 1 with only one language. A null text, or one without letters, gets `und` and 0, as do
    all texts where nothing was learned. Whole texts are parsed, in blocks of `block` bytes side by side, with the result
    of one parse. Columns named lang_pred or score are replaced.
    """
    names = np.array([language for language, _ in model], dtype=object)
    price = np.array([np.log2(1 + len(sample)) for _, sample in model])
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def predict(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows, data, offsets in batches(part, text, 4 << 20):
                known = has_letters(data, offsets)
                best, score = np.full(rows.num_rows, "und", dtype=object), np.zeros(rows.num_rows)
                if len(names):
                    cost = phrases(model, data, offsets, block, whole=True) * price[:, None]
                    order = np.argsort(cost, axis=0, kind="stable")
                    first = np.take_along_axis(cost, order[:1], 0)[0]
                    second = np.take_along_axis(cost, order[1:2], 0)[0] if len(names) > 1 else np.full(len(first), np.inf)
                    best = np.where(known, names[order[0]], best)
                    score = np.where(known, 1 - first / np.maximum(second, 1e-9), 0.0)
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], pa.array(best, pa.string()), pa.array(np.clip(score, 0, 1))], names=[*keep, "lang_pred", "score"])
        release()

    return small_batches(docs.select(*keep)).mapInArrow(predict, schema)
