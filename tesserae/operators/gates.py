"""Quality gates for text and code."""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tesserae.functions.text import alnum_count, py_splitlines

#: The gate's bounds and the source names that count as pure code.
LEAST_LINES, LEAST_CHARS, LEAST_ALNUM = 2, 30, 0.25
CODE_SOURCE = "starcoder|codeparrot|python|stack"


def passes_text_gate(text: Column) -> Column:
    """At least two lines and 30 characters, a quarter of them letters or digits."""
    n = F.length(text)
    return (F.size(py_splitlines(text)) >= LEAST_LINES) & (n >= LEAST_CHARS) & (alnum_count(text) / F.greatest(n, F.lit(1)) >= LEAST_ALNUM)


def is_pure_code(source: Column) -> Column:
    return source.rlike(CODE_SOURCE)


def brackets_balanced(text: Column) -> Column:
    """Whether round, square and curly brackets nest, quotes and comments included.

    A stack of the open brackets is folded over the brackets alone; ``!`` marks a text that has failed.
    """
    only = F.regexp_replace(text, r"[^(){}\[\]]", "")
    opened = lambda c: F.when(c == ")", "(").when(c == "]", "[").otherwise("{")
    step = lambda s, c: (
        F.when(s == "!", s).when(c.isin("(", "[", "{"), F.concat(c, s))
        .when(F.left(s, F.lit(1)) == opened(c), F.substring(s, 2, 2**30)).otherwise(F.lit("!"))
    )
    return F.when(only == "", F.lit(True)).otherwise(F.aggregate(F.filter(F.split(only, ""), lambda c: c != ""), F.lit(""), step) == "")


@F.pandas_udf(BooleanType())
def python_parses(texts: pd.Series) -> pd.Series:
    """Whether a text parses as Python; what counts depends on the interpreter's version."""
    def parses(text: str) -> bool:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
            return True
        except Exception:
            return False

    return texts.fillna("").map(parses)


def quality_filter(docs: DataFrame) -> DataFrame:
    """Rows that pass the text gate and, from pure code sources, balance their brackets and parse."""
    gated = docs.where(passes_text_gate(F.col("text")))
    code = is_pure_code(F.col("source"))
    return gated.where(~code | brackets_balanced(F.col("text"))).where(~code | python_parses("text"))


def attrition(before: DataFrame, kept: Column) -> DataFrame:
    """(source, total, kept) for a condition."""
    return before.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.coalesce(kept, F.lit(False))).alias("kept"))
