"""Secret scans in DataFrame expressions only.

Three plain patterns give the base spans. Beyond them, every long run of token characters goes through a battery of
randomness tests under the encoding that its characters suggest: chi-squared uniformity over the alphabet, the runs test
about the alphabet's middle, lag-1 serial correlation, and the chance of a lack of digits. Per encoding and length class, the Benjamini-Hochberg rule
over the whole corpus tells which runs are not random; what stays is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import cut

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encoding, the pattern that suggests it, and its alphabet in order; the first that fits counts.
ENCODINGS = (
    ("hex", "[0-9a-f]+", _DIGITS + "abcdef"),
    ("HEX", "[0-9A-F]+", _DIGITS + "ABCDEF"),
    ("base32", "[A-Z2-7]+", _UPPER + "234567"),
    ("base36", "[0-9a-z]+", _DIGITS + _LOWER),
    ("BASE36", "[0-9A-Z]+", _DIGITS + _UPPER),
    ("base62", "[0-9A-Za-z]+", _DIGITS + _UPPER + _LOWER),
    ("base64", "[A-Za-z0-9+/]+", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", "[A-Za-z0-9_-]+", _UPPER + _LOWER + _DIGITS + "-_"),
)
LENGTHS = (20, 24, 32, 48, 64, 128)
_BUCKETS = 64
_RUN = 64
_SPANS = "array<struct<start:int,rank:int,end:int,hit:string>>"


def _let(value: Column, use) -> Column:
    """What `use` makes of a value that is worked out once: inside a lambda an expression would be worked out each time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(values: Column, zero: Column, add) -> Column:
    """For each value of an array that is a column or bound by _let, all those before it added up by `add`, an
    associative operation whose neutral element is zero.

    In runs of _RUN values, so that the work grows with their number: an array that grows by one is copied each time.
    """
    grow = lambda out, x: F.concat(out, F.array(add(F.element_at(out, -1), x)))

    def inside(runs: Column) -> Column:
        starts = F.aggregate(F.transform(runs, lambda run: F.aggregate(run, zero, add)), F.array(zero), grow)
        return F.flatten(F.zip_with(F.slice(starts, 1, F.size(runs)), runs, lambda start, run: F.slice(F.aggregate(run, F.array(start), grow), 1, F.size(run))))

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _RUN).cast("int")), lambda i: F.slice(values, i * _RUN + 1, F.lit(_RUN)))
    return F.when(F.size(values) > 0, _let(runs, inside)).otherwise(F.slice(values, 1, 0))


def _matches(text: Column, pattern: str, kind: str, good) -> Column:
    """Spans of the leftmost non-overlapping matches that `good` keeps: the pieces between matches give the places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else hits

    def spans(found: Column) -> Column:
        sizes = F.transform(found, lambda m: m["gap"] + F.length(m["hit"]))
        placed = F.zip_with(_let(sizes, lambda own: _before(own, F.lit(0), lambda x, y: x + y)), found, lambda earlier, m: F.struct((earlier + m["gap"]).alias("start"), m["hit"].alias("hit"), m["inner"].alias("inner")))
        return F.transform(F.filter(placed, lambda m: good(m["hit"], m["inner"])), lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (m["start"] + F.length(m["hit"])).alias("end"), m["hit"].alias("hit")))

    # What follows the last match is no gap.
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    every = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), inner.alias("inner")), lambda m: m["hit"].isNotNull())
    return _let(every, lambda found: F.when(F.size(found) > 0, spans(found)).otherwise(F.array().cast(_SPANS)))


def _tail(z: Column) -> Column:
    """The normal upper tail above |z|, by its logistic approximation."""
    z = F.abs(z)
    return 1 / (1 + F.exp(F.least(0.07056 * z * z * z + 1.5976 * z, F.lit(700.0))))


def _battery(run: Column) -> Column:
    """Encoding, length class and combined p-value of one run under randomness; digits alone have no encoding."""
    token = F.regexp_replace(run, "=+$", "")
    encoding, alphabet = F.lit(None).cast("string"), F.lit("")
    for name, pattern, letters in reversed(ENCODINGS):
        fits = token.rlike(f"^{pattern}$")
        encoding, alphabet = F.when(fits, name).otherwise(encoding), F.when(fits, letters).otherwise(alphabet)
    encoding = F.when(token.rlike("^[0-9]*$"), F.lit(None)).otherwise(encoding)
    return F.struct(token.alias("token"), encoding.alias("encoding"), alphabet.alias("alphabet"))


def _p_value(token: Column, alphabet: Column) -> Column:
    """The tests' least p-value, corrected for their number."""
    letters = F.filter(F.split(token, ""), lambda c: c != "")

    def of(given: Column) -> Column:
        n, width, codes, mean = given["n"], given["width"], given["codes"], given["mean"]
        squares = F.aggregate(F.array_distinct(given["letters"]), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(token, c, F.lit(""))), 2))
        chi, free = width / n * squares - n, width - 1
        uniform = (F.pow(F.greatest(chi, F.lit(0.0)) / free, 1 / 3) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        p_uniform = F.when(uniform > 0, _tail(uniform)).otherwise(1 - _tail(uniform))
        steps = F.arrays_zip(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(1))).alias("x"), F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(1))).alias("y"))
        high = F.aggregate(codes, F.lit(0.0), lambda a, x: a + F.when(x > width / 2, 1.0).otherwise(0.0))
        runs = 1 + F.aggregate(steps, F.lit(0.0), lambda a, s: a + F.when((s["x"] > width / 2) != (s["y"] > width / 2), 1.0).otherwise(0.0))
        both = 2 * high * (n - high)
        spread = both * (both - n) / (n * n * (n - 1))
        p_runs = F.when(spread > 0, F.least(F.lit(1.0), 2 * _tail((runs - 1 - both / n) / F.sqrt(spread)))).otherwise(0.0)
        variance = F.aggregate(codes, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        covariance = F.aggregate(steps, F.lit(0.0), lambda a, s: a + (s["x"] - mean) * (s["y"] - mean))
        p_serial = F.when(variance > 0, F.least(F.lit(1.0), 2 * _tail((covariance / variance + 1 / n) * F.sqrt(n)))).otherwise(0.0)
        others = F.length(F.regexp_replace(alphabet, "[0-9]", "")).cast("double")
        p_digits = F.when(token.rlike("[0-9]"), 1.0).otherwise(F.pow(others / width, n))  # no digit in so many draws
        return F.least(F.lit(1.0), 4 * F.least(p_uniform, p_runs, p_serial, p_digits))

    coded = lambda own: F.struct(own.alias("letters"), F.transform(own, lambda c: F.position(c, alphabet).cast("double")).alias("codes"))
    n, width = F.length(token).cast("double"), F.length(alphabet).cast("double")
    full = lambda x: F.struct(x["letters"].alias("letters"), x["codes"].alias("codes"), n.alias("n"), width.alias("width"), (F.aggregate(x["codes"], F.lit(0.0), lambda a, y: a + y) / n).alias("mean"))
    return _let(letters, lambda own: _let(coded(own), lambda x: _let(full(x), of)))


def _length_class(n: Column) -> Column:
    out = F.lit(0)
    for least in LENGTHS[1:]:
        out = out + F.when(n >= least, 1).otherwise(0)
    return out


def _bucket(p: Column) -> Column:
    """p-values by half powers of two, the least ones together."""
    return F.least(F.floor(-2 * F.log2(F.greatest(p, F.lit(1e-300)))), F.lit(_BUCKETS)).cast("int")


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _base (base spans) and _runs (start, end, encoding, length class, p) to the rows."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(_SPANS)
    named = (t.contains("=") | t.contains(":")) & t.rlike(ASSIGN)
    assign = F.when(named, _matches(t, ASSIGN, "assign", lambda hit, inner: F.length(inner) >= 6)).otherwise(none)
    access = F.when(t.contains("AKIA"), _matches(t, ACCESS, "access", lambda hit, inner: F.length(hit) >= 20)).otherwise(none)
    long = t.rlike(RUN)
    hexes = F.when(long & t.rlike("[0-9a-f]{24}"), _matches(t, "[0-9a-f]{24,}", "hex", lambda hit, inner: F.lit(True))).otherwise(none)
    runs = F.when(long, _matches(t, RUN, "random", lambda hit, inner: F.lit(True))).otherwise(none)
    found = docs.withColumn("_base", F.concat(assign, access, hexes)).withColumn("_long", runs)
    tested = F.transform("_long", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _battery(s["hit"]).alias("as")))
    known = F.filter(tested, lambda s: s["as"]["encoding"].isNotNull() & (F.length(s["as"]["token"]) >= LENGTHS[0]))
    scored = F.transform(known, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["as"]["encoding"].alias("encoding"), _length_class(F.length(s["as"]["token"])).alias("length_class"), _p_value(s["as"]["token"], s["as"]["alphabet"]).alias("p")))
    return found.withColumn("_runs", scored).drop("_long")


def fit(docs: DataFrame, text: str = "text", level: float = 0.01) -> dict[tuple[str, int], int]:
    """For each encoding and length class, the first bucket of p-values that counts as not random.

    The Benjamini-Hochberg rule at `level`, over counts by bucket: encodings x classes x buckets rows at most reach the
    driver. A class whose runs the rule rejects nowhere gets the bucket past the last: all its runs count as random.
    """
    return thresholds(candidates(docs, text), level)


def thresholds(found: DataFrame, level: float = 0.01) -> dict[tuple[str, int], int]:
    """The same from rows that have their candidates."""
    counts = found.select(F.explode("_runs").alias("r")).groupBy("r.encoding", "r.length_class", _bucket(F.col("r.p")).alias("bucket")).agg(F.count("*").alias("n")).collect()
    out = {}
    for key in {(r["encoding"], r["length_class"]) for r in counts}:
        own = {r["bucket"]: r["n"] for r in counts if (r["encoding"], r["length_class"]) == key}
        total, seen = sum(own.values()), 0
        best = _BUCKETS + 1  # nothing is rejected
        for bucket in range(_BUCKETS, -1, -1):
            seen += own.get(bucket, 0)
            if seen and 2 ** (-bucket / 2) <= level * seen / total:
                best = bucket
        out[key] = best
    return out


def scan(docs: DataFrame, limits: dict[tuple[str, int], int], text: str = "text") -> DataFrame:
    """Adds _spans: all spans (start, rank of kind, end), sorted, ends exclusive, in code points.

    A random run inside a base span is not reported again. A null text is empty and has no span.
    """
    return marked(candidates(docs, text), limits)


def marked(found: DataFrame, limits: dict[tuple[str, int], int]) -> DataFrame:
    """The same from rows that have their candidates."""
    if limits:
        table = F.create_map(*[F.lit(x) for (encoding, size), bucket in sorted(limits.items()) for x in (f"{encoding}/{size}", bucket)])
        limit = lambda r: F.coalesce(F.element_at(table, F.concat_ws("/", r["encoding"], r["length_class"].cast("string"))), F.lit(_BUCKETS + 1))
        kept = F.filter("_runs", lambda r: (_bucket(r["p"]) < limit(r)) & ~F.exists("_base", lambda b: (b["start"] <= r["start"]) & (b["end"] >= r["end"])))
    else:
        kept = F.filter("_runs", lambda r: F.lit(False))
    base = F.transform("_base", lambda b: F.struct(b["start"].alias("start"), b["rank"].alias("rank"), b["end"].alias("end")))
    random = F.transform(kept, lambda r: F.struct(r["start"].alias("start"), F.lit(KINDS.index("random")).alias("rank"), r["end"].alias("end")))
    return found.withColumn("_spans", F.array_sort(F.concat(base, random))).drop("_base", "_runs")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for every row: the numbers of base spans by kind, their digest, and all spans. Repeated rows repeat.

    Candidates are small beside the texts: they are written once, and both the thresholds and the result read them.
    """
    found = candidates(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    places = F.transform("_base", lambda b: F.struct(b["start"].alias("start"), b["rank"].alias("rank"), b["end"].alias("end")))
    own = cut(found.select("doc_id", places.alias("_base"), "_runs"))  # places alone: no secret is written
    found = marked(own, thresholds(own))
    base = F.filter("_spans", lambda s: s["rank"] < 3)
    of = lambda kind: F.size(F.filter("_spans", lambda s: s["rank"] == KINDS.index(kind))).cast("long")
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in KINDS], F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "<secret>") -> DataFrame:
    """The rows with every span of their text replaced by the mark; overlapping spans share one. A null text stays.

    The columns that a scan adds are the only ones whose names must not be taken; the others travel as one column.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    found = scan(rows, fit(rows))
    t = F.col("text")
    # What lies before a span begins where all earlier spans have ended; a span inside them adds nothing.
    ends = F.transform("_spans", lambda s: s["end"])
    covered = F.zip_with(_let(ends, lambda own: _before(own, F.lit(0), lambda x, y: F.greatest(x, y))), "_spans", lambda at, s: F.struct(at.alias("at"), s["start"].alias("start"), s["end"].alias("end")))
    pieces = F.transform(F.filter(covered, lambda s: s["start"] >= s["at"]), lambda s: F.concat(F.substr(t, s["at"] + 1, s["start"] - s["at"]), F.lit(mark)))
    clean = F.concat(F.array_join(pieces, ""), F.substr(t, F.array_max(F.transform("_spans", lambda s: s["end"])) + 1))
    return found.select("row", F.when(F.size("_spans") > 0, clean).otherwise(t).alias("text")).select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
