"""The corpus build end to end: gate, dedup, merges, fill-in-the-middle, encode, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import bpe, dedup, fim, gates, packing
from tesserae.storage import materialise


def build_corpus(docs: DataFrame, length: int = packing.SEQUENCE, fim_rate: float = 0.5, encoder=None, vocabulary: int | None = None) -> DataFrame:
    """(chunk, tokens) of the packed corpus.

    With a ``vocabulary`` byte pairs are learnt from all texts that are kept, and encode them.  Otherwise ``encoder`` maps
    (doc_id, text) to a column ``ids`` with the end id last; the default is the digest of each word.
    """
    gated = materialise(gates.quality_filter(docs).select("doc_id", "text"))
    kept = materialise(gated.join(dedup.near_dedup(gated), "doc_id", "left_semi"))
    if vocabulary is not None:
        merges = bpe.learn_merges(bpe.pretoken_counts(kept), vocabulary)
        encoder = lambda cut: bpe.encode(materialise(cut), merges)
    cut = kept.select("doc_id", fim.fim_transform(F.col("doc_id"), F.col("text"), fim_rate).alias("text"))
    encoded = encoder(cut) if encoder else cut.withColumn("ids", packing.word_ids(F.col("text")))
    return packing.pack(encoded.select("doc_id", "ids"), length)
