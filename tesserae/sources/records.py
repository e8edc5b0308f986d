"""Readers, writers and record formats: line-delimited JSON, per-source formatters, and weighted volume budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.prefix import prefix_sum
from tesserae.functions.text import first_filled, py_strip

#: Source name -> (repository, subset, format); an unknown name takes the default.
REGISTRY = {
    "starcoder-python": ("bigcode/starcoderdata", "python", "content"),
    "glaive-function-calling": ("glaiveai/glaive-function-calling-v2", None, "system_and_chat"),
    "codeparrot-clean": ("codeparrot/codeparrot-clean-train", None, "content"),
    "evol-codealpaca": ("theblackcat102/evol-codealpaca-v1", None, "instruction_output"),
    "tiny-textbooks": ("nampdn-ai/tiny-textbooks", None, "text"),
    "commitpackft-python": ("bigcode/commitpackft", "python", "diff"),
    "code-contests": ("deepmind/code_contests", None, "problem_solution"),
}
DEFAULT_SOURCE = ("codeparrot/codeparrot-clean-train", None, "content")
#: The default mix.
TARGET_TOKENS = 2_350_000_000
DEFAULT_MIX = {
    "starcoder-python": 0.45, "glaive-function-calling": 0.15, "codeparrot-clean": 0.12, "evol-codealpaca": 0.10,
    "tiny-textbooks": 0.08, "commitpackft-python": 0.05, "code-contests": 0.05,
}


def decode_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Column ``text`` from lines of JSON objects.

    A blank line gives null; an object gives its ``text``, or the empty text where that is missing or null; any other line
    is taken as text in which the two characters backslash and n stand for a line break.
    """
    line = py_strip(F.col(column))
    parsed = F.from_json(line, "text STRING, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"})
    rows = lines.withColumn("__line", line).withColumn("__json", parsed)
    raw = F.replace(F.col("__line"), F.lit("\\n"), F.lit("\n"))
    text = F.when(F.col("__line") == "", F.lit(None)).when(F.col("__json._bad").isNotNull(), raw).otherwise(F.coalesce("__json.text", F.lit("")))
    return rows.withColumn("text", text).drop("__line", "__json")


def read_jsonl(spark: SparkSession, path: str, pattern: str = "*.jsonl", strict: bool = True, fallbacks: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(text, source) of all matching files; the source is the file name up to its first underscore.

    If nothing matches, each (path, pattern) of ``fallbacks`` is tried in turn; with ``strict`` it is an error if none has
    files, else the result is empty.  Bytes that are not UTF-8 read as U+FFFD.
    """
    for where, glob in ((path, pattern), *fallbacks):
        try:
            lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(where)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        if lines.inputFiles():
            name = F.element_at(F.split(F.input_file_name(), "/"), -1)
            return decode_lines(lines.withColumn("source", F.element_at(F.split(name, "_"), 1))).where("text is not null").select("text", "source")
    if strict:
        raise FileNotFoundError(f"no {pattern} in {path} or its fallbacks")
    return spark.createDataFrame([], "text string, source string")


def write_jsonl(docs: DataFrame, path: str) -> None:
    """One folder of ``{"text": ...}`` lines per source, replacing what was there."""
    docs.select("text", "source").write.partitionBy("source").mode("overwrite").json(path)


def read_sharded(spark: SparkSession, path: str) -> DataFrame:
    """Packed sequences by shard; unreadable files are skipped."""
    return spark.read.option("ignoreCorruptFiles", "true").parquet(path)


def write_sharded(packed: DataFrame, path: str) -> None:
    """Packed sequences, a folder per shard."""
    packed.write.partitionBy("shard").mode("overwrite").parquet(path)


def list_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = (), skip: tuple[str, ...] = ()) -> DataFrame:
    """(path, name, size) of all files below ``path`` with one of the extensions and none of the ``skip`` texts in the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    if extensions:
        files = files.where(F.col("path").rlike(r"\.(" + "|".join(extensions) + ")$"))
    for part in skip:
        files = files.where(~F.contains("path", F.lit(part)))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "size")


def registry_lookup(names: DataFrame, strict: bool = False) -> DataFrame:
    """(name, repository, subset, format) for a column ``name``; unknown names take the default, or fail if ``strict``."""
    spark = names.sparkSession
    known = spark.createDataFrame([(k, *v) for k, v in REGISTRY.items()], "name string, repository string, subset string, format string")
    found = names.select("name").join(F.broadcast(known), "name", "left")
    missing = F.raise_error(F.concat(F.lit("unknown source "), F.col("name"))) if strict else F.lit(DEFAULT_SOURCE[0])
    return found.select(
        "name", F.when(F.col("format").isNull(), missing).otherwise(F.col("repository")).alias("repository"), "subset",
        F.coalesce("format", F.lit(DEFAULT_SOURCE[2])).alias("format"),
    )


def none_or(column: Column) -> Column:
    """A null as Python prints it."""
    return F.coalesce(column, F.lit("None"))


def format_chat(system: Column, chat: Column) -> Column:
    return py_strip(F.concat(none_or(system), F.lit("\n\n"), none_or(chat)))


def format_instruction(instruction: Column, output: Column) -> Column:
    return py_strip(F.concat(F.lit("### Instruction:\n"), none_or(instruction), F.lit("\n\n### Response:\n"), none_or(output)))


def format_diff(old: Column, buggy: Column, new: Column, fixed: Column) -> Column:
    return py_strip(F.concat(F.lit("<|fim_prefix|>"), first_filled(old, buggy), F.lit("<|fim_middle|>"), first_filled(new, fixed)))


def format_problem(description: Column, solutions: Column) -> Column:
    """The first solution; an empty list prints as ``[]``."""
    first = F.when(F.size(solutions) > 0, F.element_at(solutions, 1)).otherwise(F.lit("[]"))
    return py_strip(F.concat(F.lit("### Problem:\n"), none_or(description), F.lit("\n\n### Solution:\n"), F.coalesce(first, F.lit("None"))))


def format_content(content: Column, code: Column, text: Column) -> Column:
    return first_filled(content, code, text)


def infill_prompt(prefix: Column, suffix: Column) -> Column:
    return F.concat(F.lit("<|fim_prefix|>"), prefix, F.lit("<|fim_suffix|>"), suffix, F.lit("<|fim_middle|>"))


def source_budgets(spark: SparkSession, names: list[str], weights: list[float], target_tokens: int = TARGET_TOKENS) -> DataFrame:
    """(source, budget_chars): four characters a token; the shorter list decides and a repeated source keeps its last weight."""
    budgets = {name: int(target_tokens * 4 * w) for name, w in zip(names, weights)}
    return spark.createDataFrame(list(budgets.items()), "source string, budget_chars long")


def budgeted_prefix(docs: DataFrame, budgets: DataFrame, least: int = 20, id_col: str = "doc_id") -> DataFrame:
    """The rows that a sequential writer keeps: in id order, texts over ``least`` characters until a source's budget is met.

    The row that crosses the budget is kept; shorter texts are skipped and add nothing; with a budget of 0 only the first row
    of a source is looked at.
    """
    n = F.length("text").cast("long")
    rows = docs.withColumn("__n", F.when(n > least, n).otherwise(F.lit(0).cast("long"))).withColumn("__one", F.lit(1).cast("long"))
    rows = prefix_sum(rows, "__n", id_col, "__before", ("source",))
    rows = prefix_sum(rows, "__one", id_col, "__nth", ("source",))
    met = rows.join(budgets, "source").where((F.col("__n") > 0) & ((F.col("__before") < F.col("budget_chars")) | (F.col("__nth") == 0)))
    return met.withColumn("chars_before", F.col("__before")).drop("__n", "__one", "__before", "__nth")
