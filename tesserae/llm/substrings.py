"""Substring dedup by content-defined chunking with a gear rolling hash.

Cuts depend on the last 32 bytes only, so an insertion moves no cut beyond it; chunks are deduplicated by digest, and runs of
repeated chunks become the spans that a copy of the corpus can do without.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm.common import text_or_empty
from tesserae.storage import materialise, split_join

#: Bits of the gear hash that are zero at a cut (chunks of 32 bytes on average) and the longest chunk in bytes.
CUT_BITS, LONGEST = 5, 256
#: Words that a run of repeated chunks needs to be reported.
LEAST_WORDS = 12


def gear_table() -> np.ndarray:
    """256 random 32-bit values from digests."""
    return np.array([int.from_bytes(hashlib.sha256(b"gear%d" % i).digest()[:4], "little") for i in range(256)], dtype=np.uint32)


GEAR = gear_table()


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The rolling hash ``h = 2h + gear[byte]`` modulo 2**32 at every byte, by doubling its window five times."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        moved = np.zeros_like(h)
        moved[step:] = h[:-step] << np.uint32(step)
        h = h + moved
    return h


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Exclusive ends of a text's chunks in bytes: after each byte whose hash has zeros on top, and wherever a chunk gets
    too long; an end within a character moves to the character's end."""
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    cuts = np.flatnonzero((gear_hash(data) >> np.uint32(32 - CUT_BITS)) == 0) + 1
    ends = np.unique(np.append(cuts, len(data)))
    lengths = np.diff(ends, prepend=0)
    if lengths.max() > LONGEST:
        first = ends - lengths
        extra = [np.arange(a + LONGEST, b, LONGEST) for a, b in zip(first[lengths > LONGEST], ends[lengths > LONGEST])]
        ends = np.unique(np.concatenate([ends, *extra]))
    begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    return np.unique(begins[np.searchsorted(begins, ends)])


def chunk_batches(batches):
    """Per row: each chunk's digest, the words begun up to its end, and in code points where a run stops that ends with it and
    where one starts that begins behind it: at the chunk's end, or before and behind the word that it cuts."""
    for batch in batches:
        digests, stops, starts, words = [], [], [], []
        for text in batch["__text"]:
            raw = text.encode("utf-8", "surrogatepass")
            data = np.frombuffer(raw, dtype=np.uint8)
            ends = chunk_ends(data)
            space = (data == 32) | ((data >= 9) & (data <= 13))
            first = ~space & np.concatenate([[True], space])[:-1]
            begun, begins = np.cumsum(first), np.flatnonzero(first)
            points = np.cumsum(np.append(0, (data & 0xC0) != 0x80))
            inside = ~np.append(space, True)[ends] & ~space[ends - 1]
            nth = np.searchsorted(begins, ends)
            stops.append(points[np.where(inside, np.append(0, begins)[nth], ends)].astype(np.int32))
            starts.append(points[np.where(inside, np.append(begins, len(data))[nth], ends)].astype(np.int32))
            words.append(begun[ends - 1].astype(np.int32))
            cuts = ends.tolist()
            digests.append(np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip([0, *cuts], cuts)), dtype=np.int64))
        yield pd.DataFrame({"doc_id": batch["doc_id"], "ends": stops, "starts": starts, "words": words, "digests": digests})


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, digests, ends, starts, words), materialised; ``row`` numbers the rows, so repeated ids stay apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("__text"))
    chunks = rows.mapInPandas(chunk_batches, "doc_id long, ends array<int>, starts array<int>, words array<int>, digests array<long>")
    return materialise(chunks.withColumn("row", F.monotonically_increasing_id()))


def repeated_spans(chunks: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(row, doc_id, start, end, words, chunks, first_doc_id): the runs of chunks that occurred before.

    The first occurrence of a digest in the order of (doc_id, row, position) stays; every other one is repeated.  Adjacent
    repeated chunks make a run, which is reported from ``least_words`` begun words on (2 at least), with ends exclusive in
    code points.  A word that an end of the run cuts is not part of the span.
    """
    flat = chunks.select("doc_id", "row", F.posexplode("digests").alias("pos", "digest"))
    counted = flat.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "pos")).alias("first"))
    repeated = materialise(counted.where("n > 1"))
    total = chunks.agg(F.coalesce(F.sum(F.size("digests")), F.lit(0))).first()[0]
    found = split_join(flat.select("row", "pos", "digest"), repeated, "digest", "n", total)
    again = found.where((F.col("row") != F.col("first.row")) | (F.col("pos") != F.col("first.pos")))
    again = again.select("row", "pos", F.col("first.doc_id").alias("from_doc"))
    runs = again.withColumn("run", F.col("pos") - F.row_number().over(W.partitionBy("row").orderBy("pos")))
    runs = runs.groupBy("row", "run").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.min_by("from_doc", "pos").alias("first_doc_id"))
    placed = runs.join(chunks.select("row", "doc_id", "ends", "starts", "words").hint("merge"), "row")
    upto = lambda name, at: F.when(F.col(at) < 0, F.lit(0)).otherwise(F.get(F.col(name), F.col(at)))
    placed = placed.withColumn("before", F.col("a") - 1)
    return placed.select(
        "row", "doc_id", upto("starts", "before").alias("start"), upto("ends", "b").alias("end"),
        (upto("words", "b") - upto("words", "before")).alias("words"), (F.col("b") - F.col("a") + 1).alias("chunks"), "first_doc_id",
    ).where(F.col("words") >= least_words)


def find_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated span: doc_id, start, end, words, chunks, first_doc_id; texts without repeats have no row.

    Null and empty texts have no chunks; the later of repeated rows repeats the earlier as a whole, and so has a row if it has
    ``least_words`` words or more; copies of shorter texts have none; null ids sort first and
    are returned as null; other columns are ignored; an empty table gives no rows.  Chunks are counted with partial sums, and
    those that many texts share are joined by a bounded broadcast, so no task gathers a popular passage.
    """
    return repeated_spans(chunk_table(docs, id_col, text_col), least_words).drop("row")
