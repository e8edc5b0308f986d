"""Seeded fill-in-the-middle transform."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.text import let, md5_draw, py_splitlines

#: Texts under this many characters or lines stay as they are.
LEAST_CHARS, LEAST_LINES = 50, 3


def fim_transform(key: Column, text: Column, rate: float = 0.5) -> Column:
    """The text cut at two line breaks and put in the order prefix, suffix, middle.

    Whether and where are drawn from digests of ``key``, so a rerun agrees.  All three parts have at least a line; the line
    breaks at the cuts and a final one are lost.
    """
    join = lambda part: F.array_join(part, "\n")

    def cut(lines):
        n = F.size(lines)
        first = (F.lit(1) + md5_draw(key, "fim:1") % (n - 2)).cast("int")
        return let(first, lambda a: let((a + 1 + md5_draw(key, "fim:2") % (n - 1 - a)).cast("int"), lambda b: F.concat(
            F.lit("<|fim_prefix|>"), join(F.slice(lines, 1, a)), F.lit("<|fim_suffix|>"), join(F.slice(lines, b + 1, n - b)),
            F.lit("<|fim_middle|>"), join(F.slice(lines, a + 1, b - a)),
        )))

    drawn = md5_draw(key, "fim:0") < F.lit(int(rate * 2**32))
    whole = drawn & (F.length(text) >= LEAST_CHARS) & (F.size(py_splitlines(text)) >= LEAST_LINES)
    return F.when(whole, let(py_splitlines(text), cut)).otherwise(text)
