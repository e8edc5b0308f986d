"""String columns that behave as Python's ``str`` methods do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that Python's split() and splitlines() break at, as Java and RE2 classes take them.
PY_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
PY_LINE = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
NOT_ALNUM = r"[^\p{L}\p{N}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, which an alias used inside a lambda does not guarantee."""
    return F.element_at(F.transform(F.array(value), body), 1)


def py_split(text: Column) -> Column:
    """``str.split()``."""
    return F.filter(F.split(text, PY_SPACE + "+"), lambda w: w != "")


def py_strip(text: Column) -> Column:
    """``str.strip()``."""
    return F.regexp_replace(F.regexp_replace(text, f"^{PY_SPACE}+", ""), f"{PY_SPACE}+$", "")


def py_splitlines(text: Column) -> Column:
    """``str.splitlines()``: a final line break ends the last line, and the empty text has no lines."""
    return let(F.split(text, PY_LINE, -1), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def alnum_count(text: Column) -> Column:
    """How many characters ``str.isalnum()`` holds for."""
    return F.length(F.regexp_replace(text, NOT_ALNUM, "")).cast("long")


def first_filled(*columns: Column) -> Column:
    """Python's ``a or b or ""`` on texts: empty strings are skipped as nulls are."""
    return F.coalesce(*(F.when(c != "", c) for c in columns), F.lit(""))


def md5_draw(key: Column, label: str) -> Column:
    """A reproducible integer from 0 to 2**32 - 1 for a key and a label."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{label}")).cast("binary"))
    return F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long")
