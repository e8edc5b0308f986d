"""Exact and near-duplicate removal with first-wins semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions.text import let, py_split
from tesserae.storage import materialise

#: Words of a shingle and hex digits of a band.
SHINGLE, BAND_DIGITS = 5, 16


def signatures(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, exact, bands): digest of the white-space-normalised text, and of its even and odd shingles.

    Texts of under five words have their exact digest as the only band.
    """
    words = py_split(F.coalesce(F.col("text"), F.lit("")))
    digest = lambda s: F.md5(s.cast("binary"))

    def build(w):
        shingles = F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))
        band = lambda s, odd: F.left(digest(F.array_join(F.filter(s, lambda _, i: i % 2 == odd), " ")), F.lit(BAND_DIGITS))
        exact = digest(F.array_join(w, " "))
        two = let(shingles, lambda s: F.array(band(s, 0), band(s, 1)))
        return F.struct(exact.alias("exact"), F.when(F.size(w) < SHINGLE, F.array(exact)).otherwise(two).alias("bands"))

    return docs.select(F.col(id_col).alias("doc_id"), let(words, build).alias("s")).select("doc_id", "s.exact", "s.bands")


def first_of_each(docs: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the smallest ``order`` of each key; a partial aggregate, so no window gathers a popular key."""
    firsts = docs.groupBy(key).agg(F.min(order).alias(order))
    return docs.join(firsts.select(order), order, "left_semi")


def greedy_keep(keys: DataFrame) -> DataFrame:
    """(doc_id) of the rows that a sequential pass keeps: in id order, a row goes if it shares a key with one kept before.

    ``keys`` has (doc_id, keys).  Each round keeps the open rows that are first on all their keys and drops those that share
    a key with a kept row; a key's rows meet only in a partial minimum.  Rows alone on all their keys are kept at once.
    """
    flat = materialise(keys.select("doc_id", F.explode(F.array_distinct("keys")).alias("key")))
    kept = []
    while True:
        least = flat.groupBy("key").agg(F.min("doc_id").alias("least"))
        state = flat.join(least, "key").groupBy("doc_id").agg(F.bool_and(F.col("doc_id") == F.col("least")).alias("first"))
        winners = materialise(state.where("first").select("doc_id"))
        if not winners.limit(1).count():
            break
        kept.append(winners)
        won = flat.join(winners, "doc_id", "left_semi").select("key").distinct()
        losers = flat.join(won, "key", "left_semi").select("doc_id").distinct()
        flat = materialise(flat.join(losers, "doc_id", "left_anti"))
    out = keys.select("doc_id").where("false")
    for part in kept:
        out = out.unionByName(part)
    return out


def near_dedup(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id) of the rows that remain after greedy removal by exact digest and bands, in id order."""
    signed = materialise(signatures(docs, id_col))
    return greedy_keep(signed.select("doc_id", F.concat(F.array("exact"), F.col("bands")).alias("keys")))


def latest_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by ``order``: get-or-create with later values winning."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")
