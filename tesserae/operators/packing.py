"""Fixed-length sequences from a stream of tokens, and their shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.prefix import prefix_sum
from tesserae.storage import materialise

#: Tokens of a sequence and sequences of a shard.
SEQUENCE, SHARD = 2048, 1000


def word_ids(text: Column, vocabulary: int = 31_990, eos: int = 0) -> Column:
    """A stand-in tokenizer: the digest of each blank-separated word modulo the vocabulary, then the end id."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    ids = F.transform(words, lambda w: (F.conv(F.left(F.md5(w.cast("binary")), F.lit(8)), 16, 10).cast("long") % vocabulary + 10).cast("long"))
    return F.concat(ids, F.array(F.lit(eos).cast("long")))


def place_tokens(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids, start): where each row's tokens begin in the stream of all rows in id order."""
    rows = materialise(encoded.select(F.col(id_col).alias("doc_id"), "ids"))
    sizes = prefix_sum(rows.select("doc_id", F.size("ids").cast("long").alias("n")), "n", "doc_id", "start")
    return rows.join(sizes.select("doc_id", "start"), "doc_id")


def pack(encoded: DataFrame, length: int = SEQUENCE, overlap: int = 0, id_col: str = "doc_id") -> DataFrame:
    """(chunk, tokens): the stream of all rows in id order, cut every ``length`` tokens; an incomplete end is dropped.

    With ``overlap`` each sequence also has that many tokens of the next.  A row's slices, not its tokens, are exploded, so a
    sequence gathers a few arrays.  Ids are taken to be distinct; null token arrays count as empty.
    """
    placed = place_tokens(encoded.where("ids is not null"), id_col).where(F.size("ids") > 0)
    end = F.col("start") + F.size("ids") - 1
    first = F.greatest(F.lit(0), F.floor((F.col("start") - overlap) / length)).cast("long")
    chunks = placed.withColumn("chunk", F.explode(F.sequence(first, F.floor(end / length).cast("long"))))
    low = F.greatest("start", F.col("chunk") * length)
    high = F.least(end, F.col("chunk") * length + length + overlap - 1)
    pieces = chunks.where(high >= low).select("chunk", low.alias("at"), F.slice("ids", (low - F.col("start") + 1).cast("int"), (high - low + 1).cast("int")).alias("part"))
    whole = pieces.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("parts"))
    tokens = F.flatten(F.col("parts.part"))
    return whole.select("chunk", tokens.alias("tokens")).where(F.size("tokens") == length + overlap)


def shard_number(chunk: Column, size: int = SHARD) -> Column:
    """Shards count from 1 and hold ``size`` sequences each; the last may have fewer."""
    return (F.floor(chunk / size) + 1).cast("long")


def training_pair(tokens: Column, length: int) -> tuple[Column, Column]:
    """Inputs and targets: shifted by one where a sequence has a token to spare, else both the sequence itself."""
    spare = F.size(tokens) > length
    n = F.size(tokens)
    return F.when(spare, F.slice(tokens, F.lit(1), n - 1)).otherwise(tokens), F.when(spare, F.slice(tokens, F.lit(2), n - 1)).otherwise(tokens)


def next_token_pairs(tokens: Column) -> Column:
    """Array of (token, next) over a sequence."""
    n = F.size(tokens)
    return F.arrays_zip(F.slice(tokens, F.lit(1), n - 1).alias("token"), F.slice(tokens, F.lit(2), n - 1).alias("next"))
