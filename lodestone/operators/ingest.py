"""Ingestion normalisers: raw corpora to instruction, input, output, text, category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.texts import collapsed, stripped

RESPONSE_MARKER = "### Response:\n"
#: The openings of the two training templates.
WITH_INPUT = "Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.\n\n"
WITHOUT_INPUT = "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n"
#: Other names of languages.
LANGUAGE_ALIASES = {"py": "python", "python3": "python", "js": "javascript", "ts": "typescript", "c++": "cpp", "cs": "csharp", "sh": "bash"}


def _blocks(instruction: Column, input_text: Column, output: Column) -> Column:
    has_input = F.coalesce(input_text, F.lit("")) != ""
    middle = F.when(has_input, F.concat(F.lit("### Input:\n"), input_text, F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit("### Instruction:\n"), F.coalesce(instruction, F.lit("")), F.lit("\n\n"), middle, F.lit(RESPONSE_MARKER), F.coalesce(output, F.lit("")))


def training_text(instruction: Column, input_text: Column, output: Column) -> Column:
    """The training template; a null or empty input has no block. Nulls are empty."""
    opening = F.when(F.coalesce(input_text, F.lit("")) != "", WITH_INPUT).otherwise(WITHOUT_INPUT)
    return F.concat(opening, _blocks(instruction, input_text, output))


def prompt(instruction: Column, input_text: Column, output: Column | None = None) -> Column:
    """The template without opening, of stripped parts; without an output it ends at the response."""
    return _blocks(stripped(instruction), stripped(input_text), F.lit("") if output is None else stripped(output))


def prompt_or_text(instruction: Column, input_text: Column, text: Column) -> Column:
    """The prompt, or without an instruction the text up to and with its response marker."""
    body = stripped(text)
    cut = F.when(body.contains(RESPONSE_MARKER), F.concat(F.substring_index(body, RESPONSE_MARKER, 1), F.lit(RESPONSE_MARKER))).otherwise(body)
    return F.when(stripped(instruction) != "", prompt(instruction, input_text)).otherwise(cut)


def gold(output: Column, text: Column) -> Column:
    """The output, or what follows the first response marker of the text; else empty."""
    at = F.instr(text, RESPONSE_MARKER)
    return F.when(stripped(output) != "", stripped(output)).when(at > 0, stripped(F.substr(text, at + len(RESPONSE_MARKER)))).otherwise("")


def sample_text(*parts: Column) -> Column:
    """The parts that are not empty when stripped, a line each."""
    return F.array_join(F.filter(F.array(*[stripped(p) for p in parts]), lambda p: p != ""), "\n")


def labelled_text(instruction: Column, input_text: Column, output: Column, mode: str) -> Column:
    """instruction, instruction_input or raw: labelled parts that are not empty; other modes count as raw."""
    named = [("Instruction", instruction), ("Input", input_text), ("Output", output)]
    keep = {"instruction": 1, "instruction_input": 2}.get(mode, 3)
    lines = [F.when(collapsed(c) != "", F.concat(F.lit(f"{name}: "), collapsed(c))) for name, c in named[:keep]]
    return F.concat_ws("\n", *lines)


def demo(instruction: Column, input_text: Column, answer: Column) -> Column:
    middle = F.when(stripped(input_text) != "", F.concat(F.lit("Input: "), stripped(input_text), F.lit("\n"))).otherwise("")
    return F.concat(F.lit("Instruction: "), stripped(instruction), F.lit("\n"), middle, F.lit("Output: "), F.coalesce(answer, F.lit("")), F.lit("\n\n"))


def query_prefix(instruction: Column, input_text: Column) -> Column:
    middle = F.when(stripped(input_text) != "", F.concat(F.lit("Input: "), stripped(input_text), F.lit("\n"))).otherwise("")
    return F.concat(F.lit("### Query\nInstruction: "), stripped(instruction), F.lit("\n"), middle, F.lit("Output:"))


def judge_prompt(instruction: Column, input_text: Column, output: Column) -> Column:
    """Asks for `yes||reason`. A null input counts as none."""
    ask = F.lit("Following the format <yes/no>||<explanation why yes or no>. Given the following instruction: ")
    middle = F.when(F.coalesce(input_text, F.lit("")) != "", F.concat(F.lit(" and the following input: "), input_text)).otherwise("")
    return F.concat(ask, F.coalesce(instruction, F.lit("")), middle, F.lit(", is the output '"), F.coalesce(output, F.lit("")), F.lit("' correct?"))


def relation_prompt(text: Column, indices: Column, descriptions: Column) -> Column:
    """One sample beside its candidate capabilities, a block for each rank."""
    blocks = F.transform(F.arrays_zip(indices.alias("i"), descriptions.alias("d")), lambda c, r: F.concat(F.lit("[Candidate rank="), r.cast("string"), F.lit(", capability_index="), c["i"].cast("string"), F.lit("]\n"), c["d"]))
    ask = (
        "Task: Determine relation between ONE sample text and EACH candidate capability.\nFor every candidate rank, output one relation label.\n"
        'Allowed labels: strongly related | weakly related | unrelated.\nReturn ONLY JSON in this format:\n{"relations": [{"rank": 0, "relation": "strongly related"}, ...]}\n\n[Sample Text]\n'
    )
    return F.concat(F.lit(ask), text, F.lit("\n\n[Candidates]\n"), F.array_join(blocks, "\n\n"), F.lit("\n"))


def capability_text(index: Column, node: Column, name: Column, name_zh: Column, definition: Column, keywords: Column) -> Column:
    """Index, then what is known of node, names, definition and the first five keywords, a line each."""
    known = lambda label, c: F.when(collapsed(c) != "", F.concat(F.lit(f"{label}: "), collapsed(c)))
    words = F.array_join(F.filter(F.slice(keywords, 1, 5), lambda w: w != ""), ", ")
    return F.concat_ws("\n", F.concat(F.lit("Capability Index: "), index.cast("string")), known("Node ID", node), known("Name (EN)", name), known("Name (ZH)", name_zh), known("Definition", definition), F.when(words != "", F.concat(F.lit("Keywords: "), words)))


def options(choices: Column) -> Column:
    """A line `A. choice` for each choice; `Option9. ` and so on past the eighth."""
    labels = F.array(*[F.lit(c) for c in "ABCDEFGH"])
    return F.array_join(F.transform(choices, lambda c, i: F.concat(F.coalesce(F.get(labels, i), F.concat(F.lit("Option"), (i + 1).cast("string"))), F.lit(". "), c)), "\n")


def chosen(choices: Column, answer: Column) -> Column:
    """`B. choice` of the answer's index; empty where there is none."""
    return F.when((answer >= 0) & (answer < F.size(choices)), F.concat(F.char(65 + answer), F.lit(". "), F.get(choices, answer))).otherwise("")


def code_category(target: Column, fallback: str) -> Column:
    """code_<language> of the first fenced block that names one."""
    raw = F.lower(F.regexp_extract(target, r"```([A-Za-z0-9_+#.-]+)", 1))
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_ALIASES.items() for x in pair])
    return F.when(raw == "", fallback).otherwise(F.concat(F.lit("code_"), F.coalesce(F.element_at(names, raw), raw)))


def category_or(x: Column, fallback: str) -> Column:
    """The stripped value; none, null, nan and blank give the fallback."""
    return F.when(F.lower(stripped(x)).isin("", "none", "null", "nan"), fallback).otherwise(stripped(x))


def conversations_to_samples(turns: DataFrame) -> DataFrame:
    """A row a conversation (conv_id, turn, role, text): instruction, input, output, category, skip.

    The first turn of a user with text is the instruction; texts of system turns before it, parted by blank lines, the
    input; the first later turn of neither with text the output, its role the category. skip tells what is missing.
    One grouped aggregate with partial sums of bounded structs does it, whatever the length of a conversation.
    """
    t = turns.select("conv_id", "turn", F.lower(stripped(F.col("role"))).alias("role"), stripped(F.col("text")).alias("text")).where("text <> ''")
    user = F.col("role").isin("user", "human")
    first = t.where(user).groupBy("conv_id").agg(F.min_by(F.struct("turn", "text"), "turn").alias("first"))
    joined = t.join(first, "conv_id", "left")
    after = ~user & (F.col("role") != "system") & (F.col("turn") > F.col("first.turn"))
    before = (F.col("role") == "system") & (F.col("first").isNull() | (F.col("turn") < F.col("first.turn")))
    out = joined.groupBy("conv_id").agg(
        F.first("first.text").alias("instruction"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(before, F.struct("turn", "text")))), lambda s: s["text"]), "\n\n").alias("input"),
        F.min_by(F.when(after, F.col("text")), F.when(after, F.col("turn"))).alias("output"),
        F.min_by(F.when(after, F.col("role")), F.when(after, F.col("turn"))).alias("category"),
    )
    every = turns.select("conv_id").distinct()
    skip = F.when(F.col("instruction").isNull(), "no_user_instruction").when(F.col("output").isNull(), "no_assistant_output").otherwise("kept")
    return every.join(out, "conv_id", "left").withColumn("input", F.nullif(F.col("input"), F.lit(""))).withColumn("skip", skip)


def pairs_of_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pair, instruction, response): every even turn with the next; the last may lack one."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    at = turns.withColumn("at", F.row_number().over(w) - 1).withColumn("next", F.lead("text").over(w))
    return at.where(F.col("at") % 2 == 0).select("conv_id", F.floor(F.col("at") / 2).cast("int").alias("pair"), F.col("text").alias("instruction"), F.coalesce("next", F.lit("")).alias("response"))


def dense_ids(rows: DataFrame, label: str, order: str) -> DataFrame:
    """(label, id, n): ids from 0 by first occurrence; the labels are few beside the rows."""
    groups = rows.groupBy(label).agg(F.min(order).alias("first"), F.count("*").alias("n"))
    return groups.select(label, (F.row_number().over(Window.orderBy("first", label)) - 1).alias("id"), "n")


def distinct_ids(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Adds unique_id: repeats of a key get __1, __2 and so on, in order."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return rows.withColumn("unique_id", F.when(at == 0, F.col(key)).otherwise(F.concat(F.col(key), F.lit("__"), at.cast("string"))))


def ensured_ids(rows: DataFrame, key: str, position: str) -> DataFrame:
    return rows.withColumn(key, F.coalesce(F.nullif(stripped(F.col(key)), F.lit("")), F.col(position).cast("string")))


def hash_order(key: str, seed: int = 42) -> Column:
    """An order that any engine can repeat: md5 of `key|seed`."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")).cast("binary"))


def top_of_each(rows: DataFrame, group: str, most: int, *order: Column) -> DataFrame:
    """At most so many rows of each group. The limit is applied before and after the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("rank_in_group", rank).where(F.col("rank_in_group") <= most)
