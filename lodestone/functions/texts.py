"""Text expressions: clean-up, tokens, names, and parsers of model responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic.
STOP_WORDS = """
the and for with that this from into about within task tasks sample samples processing domain topic performing
involves demonstrates through using based general abstract content classify classification intent correct
category conversation banking router following query queries user users please need help can could would
should will what when where which who why how you your yours get got have has had not still there their them
they our ours are is was were been being but very also just than then too much many any all some one two
""".split()
CJK = r"[\u3400-\u4dbf\u4e00-\u9fff]"


def stripped(x: Column) -> Column:
    """Without white space of any kind at both ends; a null is empty."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+$", "")


def collapsed(x: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def clipped(x: Column, most: int) -> Column:
    """Stripped, at most `most` characters, the last three of a longer text being dots."""
    text = stripped(x)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, max(0, most - 3)), F.lit("..."))).otherwise(text)


def keywords(x: Column) -> Column:
    """Runs of three or more of a-z in the lower-cased text that are not stop words."""
    return F.array_except(F.regexp_extract_all(F.lower(x), F.lit("[a-z]{3,}"), F.lit(0)), F.array(*[F.lit(w) for w in STOP_WORDS]))


def keyword_tokens(x: Column) -> Column:
    """Like keywords, with repeats."""
    return F.filter(F.regexp_extract_all(F.lower(x), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(STOP_WORDS))


def words(x: Column) -> Column:
    """Runs of CJK characters and runs of letters, digits and underscores, lower-cased."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"[\u4e00-\u9fff]+|[a-z0-9_]+"), F.lit(0))


def has_cjk(x: Column) -> Column:
    return x.rlike(CJK)


def metric_text(x: Column, mode: str) -> Column:
    """none, strip, lower_strip, or squad: lower case without punctuation and English articles, white space collapsed."""
    if mode == "none":
        return x
    if mode == "strip":
        return stripped(x)
    if mode == "lower_strip":
        return collapsed(F.lower(x))
    if mode == "squad":
        bare = F.regexp_replace(F.lower(x), r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]""", "")
        return collapsed(F.regexp_replace(bare, r"\b(a|an|the)\b", " "))
    raise ValueError(f"unknown mode {mode}")


def safe_name(x: Column) -> Column:
    """For files and runs: runs of other characters than letters, digits, dot, dash and underscore become one underscore."""
    name = F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.when(name == "", "run").otherwise(name)


def humanized(x: Column) -> Column:
    """Underscores, dashes and all but letters and digits become blanks."""
    return collapsed(F.regexp_replace(F.regexp_replace(x, "[_-]", " "), r"[^A-Za-z0-9\s]", " "))


def fallback_name(x: Column, most: int = 6) -> Column:
    """The first words of letters and digits with capitals."""
    return F.initcap(F.array_join(F.slice(F.regexp_extract_all(x, F.lit("[A-Za-z0-9]+"), F.lit(0)), 1, most), " "))


def last_line(x: Column) -> Column:
    """The last line that is not blank, stripped; empty if there is none."""
    lines = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "\n"), stripped), lambda s: s != "")
    return F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))


def tag_list(x: Column) -> Column:
    """Tags parted by commas, semicolons, slashes or bars of either width, stripped; repeats in other case go."""
    tags = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"[,，;；/\\|]+"), stripped), lambda t: t != "")
    return F.filter(tags, lambda t, i: ~F.exists(F.slice(tags, 1, i), lambda u: F.lower(u) == F.lower(t)))


def lowered_tags(x: Column) -> Column:
    """Lower-cased, stripped, distinct, in order, without empty ones."""
    return F.array_distinct(F.filter(F.transform(x, lambda t: F.lower(stripped(t))), lambda t: t != ""))


def description(x: Column, default: str, most: int = 50) -> Column:
    """Without a leading label up to a colon, at most so many words; the default if nothing is left."""
    bare = collapsed(F.regexp_replace(F.coalesce(x, F.lit("")), r"^(?i)\s*(t_)?description\s*[:：]\s*", ""))
    short = F.array_join(F.slice(F.split(bare, " "), 1, most), " ")
    return F.when(short == "", default).otherwise(short)


def judge_reply(x: Column) -> Column:
    """(passed, score, reason) of `yes||reason`, or of `yes, reason`; it passes if the first part holds yes in any case."""
    text = stripped(x)
    barred = text.contains("||")
    first = F.when(barred, F.split_part(text, F.lit("||"), F.lit(1))).otherwise(F.regexp_extract(text, r"(?s)^([^,.]*)", 1))
    reason = F.when(barred, F.regexp_extract(text, r"(?s)^.*?\|\|(.*)$", 1)).otherwise(F.regexp_extract(text, r"(?s)^[^,.]*[,.](.*)$", 1))
    passed = F.lower(first).contains("yes")
    return F.struct(passed.alias("judge_pass"), passed.cast("double").alias("judge_score"), stripped(reason).alias("judge_reason"))


def digit_score(x: Column, default: float = 3.0) -> Column:
    """The first digit from 1 to 6 that stands alone."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(x, r"(?<!\d)([1-6])(?!\d)", 1), F.lit("")), F.lit("9")).cast("double"), F.lit(default))


def expected_score(logprobs: list[Column], default: float = 3.0) -> Column:
    """The mean digit under the softmax of the six digits' log-probabilities; the default if one is missing."""
    weights = F.array(*[F.exp(p) for p in logprobs])
    mean = F.aggregate(F.zip_with(weights, F.array(*[F.lit(float(i + 1)) for i in range(len(logprobs))]), lambda w, d: w * d), F.lit(0.0), lambda a, v: a + v)
    known = F.lit(True)
    for p in logprobs:
        known = known & p.isNotNull()
    return F.when(known, mean / F.aggregate(weights, F.lit(0.0), lambda a, v: a + v)).otherwise(default)


def batch_scores(x: Column, expected: Column, default: float = 3.0) -> Column:
    """Whole numbers from 1 to 6 of a list of texts, others left out; then padded or cut to the expected length."""
    kept = F.filter(F.transform(x, lambda v: v.try_cast("int")), lambda v: v.between(1, 6))
    return F.slice(F.concat(F.transform(kept, lambda v: v.cast("double")), F.array_repeat(F.lit(default), F.greatest(expected, F.lit(0)))), F.lit(1), expected)


def fence_free(x: Column) -> Column:
    """What stands in a code fence, else the text."""
    inner = F.regexp_extract(x, r"(?s)```[A-Za-z]*\s*(.*?)```", 1)
    return stripped(F.when(inner == "", x).otherwise(inner))


def json_object(x: Column) -> Column:
    """From the first to the last brace of the text without fences; null if there is no such part."""
    return F.nullif(F.regexp_extract(fence_free(x), r"(?s)\{.*\}", 0), F.lit(""))


def json_tags(x: Column) -> Column:
    """Tags of a reply: of the object's `tags`, else of a list of strings; lower-cased and distinct."""
    inside = F.from_json(json_object(x), "tags array<string>")["tags"]
    alone = F.from_json(F.nullif(F.regexp_extract(fence_free(x), r"(?s)\[.*\]", 0), F.lit("")), "array<string>")
    return lowered_tags(F.coalesce(inside, alone, F.array().cast("array<string>")))


def after_marker(x: Column, marker: str) -> Column:
    """What follows the last marker, stripped; the whole text without one."""
    return stripped(F.substring_index(x, marker, -1))


def first_answer(x: Column) -> Column:
    """The first line without a leading `answer:`."""
    return stripped(F.regexp_replace(F.split_part(stripped(x), F.lit("\n"), F.lit(1)), r"^(?i)answer\s*:\s*", ""))


def warmup_scale(step: Column, warmup: int, total: int) -> Column:
    """Of the step counted from 1: rises to 1 over the warm-up, then falls linearly to 0."""
    warmup, total = max(1, warmup), max(1, total)
    return F.when(step <= warmup, step / warmup).otherwise(F.greatest(F.lit(0.0), (total - step) / max(1, total - warmup)))


def compact_name(child: Column, parent: Column) -> Column:
    """The child's name without what it shares with its parent's beginning, if that is two words or more and not all."""
    a, b = F.split(F.trim(child), r"\s+"), F.split(F.lower(F.trim(parent)), r"\s+")
    same = F.zip_with(a, b, lambda x, y: F.coalesce(F.lower(x) == y, F.lit(False)))
    differs = F.array_position(same, F.lit(False)).cast("int")
    shared = F.when(differs > 0, differs - 1).otherwise(F.size(same))
    return F.when((shared >= 2) & (shared < F.size(a)), F.array_join(F.slice(a, shared + 1, F.size(a)), " ")).otherwise(child)
