"""Benchmark decontamination by complete seeds: runs so short that any accepted overlap must contain one.

If all but ``s`` of ``w`` aligned tokens agree, some run of ``ceil((w - s) / (s + 1))`` of them agrees.  Runs of that length
are hashed at every position of items and documents; equal hashes are hits, and a hit counts once the tokens around it agree
well enough.  So no overlap that the rule accepts goes without a hit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import let, text_or_empty
from tesserae.storage import BROADCAST_ROWS, materialise

#: Tokens compared on either side of a hit, and the window that has to agree.
CONTEXT, OVERLAP, AGREE = 24, 16, 0.8


def run_length(width: int) -> int:
    """Tokens of the longest run that every accepted overlap of ``width`` aligned tokens contains."""
    wrong = width - math.ceil(width * AGREE)
    return -(-(width - wrong) // (wrong + 1))


#: Seed lengths by the tokens of an item (from 1), and the longest.
RUNS = tuple(run_length(w) for w in range(1, OVERLAP + 1))
SPAN = max(RUNS)
#: Bits of the filter in front of the join, at most.
FILTER_BITS = 1 << 22


def token_hashes(text: Column) -> Column:
    """64-bit hashes of the tokens: lower-cased runs of letters and digits."""
    clean = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(clean == "", F.expr("cast(array() as array<bigint>)")).otherwise(F.transform(F.split(clean, " "), lambda w: F.xxhash64(w)))


def seed(hashes: Column, at: Column, length: int) -> Column:
    """The hash of the run of ``length`` tokens that begins at the 1-based position ``at``, null if the tokens end before."""
    return F.when(at + (length - 1) <= F.size(hashes), F.xxhash64(F.lit(length), *(F.get(hashes, at + (i - 1)) for i in range(length))))


def starts(hashes: Column) -> Column:
    """The 1-based positions of all tokens."""
    none = F.expr("cast(array() as array<int>)")
    return F.when(F.size(hashes) > 0, F.sequence(F.lit(1), F.size(hashes))).otherwise(none)


def item_seeds(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, item_pos, item_size, length, around, around_from, seed): a row per item position where a run begins."""
    items = benchmark.select(F.col(id_col).alias("item_id"), token_hashes(text_or_empty(text_col)).alias("h"))
    sized = items.where(F.size("h") > 0).withColumn("length", F.element_at(F.array(*map(F.lit, RUNS)), F.least(F.lit(OVERLAP), F.size("h"))))
    windows = sized.select("item_id", "h", "length", F.explode(starts(F.col("h"))).alias("item_pos"))
    of_length = F.coalesce(*(F.when(F.col("length") == n, seed(F.col("h"), F.col("item_pos"), n)) for n in sorted(set(RUNS))))
    first = F.greatest(F.col("item_pos") - CONTEXT, F.lit(1))
    return windows.select(
        "item_id", "item_pos", F.size("h").alias("item_size"), "length", first.alias("around_from"),
        F.slice("h", first, F.col("item_pos") + SPAN + CONTEXT - first).alias("around"), of_length.alias("seed"),
    ).where("seed is not null")


def seed_filter(seeds: DataFrame) -> tuple[DataFrame, int] | None:
    """A mark per seed hash value (a byte each) of bounded size, as a table of one row; None where there are too many seeds
    for it to help."""
    size = 1 << 16
    n = seeds.count()
    while size < 16 * n and size < FILTER_BITS:
        size *= 2
    if n > FILTER_BITS // 8:
        return None
    marks = bytearray(size)
    for (slot,) in seeds.select(F.pmod("seed", F.lit(size)).alias("s")).distinct().collect():  # FILTER_BITS / 8 at most
        marks[slot] = 1
    return materialise(seeds.sparkSession.createDataFrame([(marks,)], "marks binary")), size


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per (doc_id, item_id) that overlap: hits, overlap (most agreeing tokens around a hit), first_token.

    A pair overlaps if, around a common seed, some ``OVERLAP`` aligned tokens (all of a shorter item's) agree in at least
    ``AGREE`` of their positions; every such pair has a common seed.  Null and empty texts and items have no seeds and appear
    nowhere; repeated rows with one id are merged by the result's grouping; other columns are ignored; an empty table on
    either side gives no rows.  Documents are not shuffled: the seeds of the benchmark are broadcast while they number at
    most ``BROADCAST_ROWS``, and beyond that candidate windows are shuffled instead.
    """
    seeds = materialise(item_seeds(benchmark, item_col, item_text))
    known = seed_filter(seeds)
    lengths = sorted(r.length for r in seeds.select("length").distinct().collect()) or [SPAN]
    table, size = known or (None, 1)
    marks = table.scalar() if known else F.lit(None).cast("binary")  # a subquery, so the plan's text does not hold the bytes
    hashed = docs.select(F.col(id_col).alias("doc_id"), token_hashes(text_or_empty(text_col)).alias("h"), marks.alias("marks"))

    def windows(h: Column, marks: Column) -> Column:
        found = (lambda v: F.substr(marks, (F.pmod(v, F.lit(size)) + 1).cast("int"), F.lit(1)) == F.lit(b"\x01")) if known else (lambda v: v.isNotNull())
        hit = F.filter(F.transform(starts(h), lambda i: F.struct(i.alias("pos"), F.filter(F.array(*(seed(h, i, n) for n in lengths)), found).alias("seeds"))), lambda w: F.size(w["seeds"]) > 0)
        first = lambda w: F.greatest(w["pos"] - CONTEXT, F.lit(1))
        return F.transform(hit, lambda w: F.struct(
            w["pos"].alias("pos"), w["seeds"].alias("seeds"), first(w).alias("from"), F.size(h).alias("size"),
            F.slice(h, first(w), w["pos"] + SPAN + CONTEXT - first(w)).alias("near"),
        ))

    candidates = hashed.select("doc_id", F.explode(let(F.col("marks"), lambda m: let(F.col("h"), lambda h: windows(h, m)))).alias("w")).select(
        "doc_id", F.col("w.pos").alias("pos"), F.col("w.from").alias("from"), F.col("w.size").alias("size"), F.col("w.near").alias("near"),
        F.explode("w.seeds").alias("seed"),
    )
    side = F.broadcast(seeds) if seeds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else seeds
    hits = candidates.join(side, "seed").withColumn("agree", agreement())
    return hits.where("agree > 0").groupBy("doc_id", "item_id").agg(
        F.count("*").alias("hits"), F.max("agree").alias("overlap"), F.min(F.col("pos") - F.col("item_pos")).alias("first_token")
    )


def agreement() -> Column:
    """Agreeing tokens of the best window around the hit, 0 if no window agrees well enough."""
    low = F.greatest(F.lit(-CONTEXT), 1 - F.col("pos"), 1 - F.col("item_pos"))
    high = F.least(F.lit(SPAN + CONTEXT - 1), F.col("size") - F.col("pos"), F.col("item_size") - F.col("item_pos"))
    same = F.transform(F.sequence(low, high), lambda k: F.when(
        F.get("near", F.col("pos") + k - F.col("from")) == F.get("around", F.col("item_pos") + k - F.col("around_from")), 1).otherwise(0))
    width = F.least(F.lit(OVERLAP), F.col("item_size"))
    count = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    best = let(same, lambda eq: F.when(F.size(eq) >= width, F.array_max(F.transform(F.sequence(F.lit(1), F.size(eq) - width + 1), lambda o: count(F.slice(eq, o, width))))).otherwise(0))
    return let(best, lambda b: F.when(b >= F.ceil(width * AGREE), b).otherwise(0))
