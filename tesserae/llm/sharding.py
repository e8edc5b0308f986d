"""Jump consistent hashing: stable keys to shards without a ring table, plus gapless slots inside each shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm.common import text_or_empty
from tesserae.storage import materialise

#: Fixed values of the published jump hash: the multiplier of its 64-bit generator.
MULTIPLIER = 2862933555777941757
#: Hex digits of the key's digest that cut a shard into blocks, so that no window holds a whole shard (16**3 blocks).
BLOCK_DIGITS = 3
#: Bits of the text's CRC that cut the rows of one id into cells, and salts that cut the rows that are equal in all columns.
CELL_BITS, SALTS = 12, 4096


def key_digest(key: Column) -> Column:
    return F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def jump_walk(n_shards: int) -> Column:
    """Struct (k, shard, grown, j) from column ``__digest``: the jump hash for ``n_shards`` and for one more, in one walk.

    The generator runs modulo 2**64, which DECIMAL(38) holds exactly: a 64-bit state times the multiplier stays below 10**38.
    """
    step = f"cast((s.k * {MULTIPLIER}BD + 1BD) % 18446744073709551616BD as decimal(20,0))"
    jumped = "cast(floor((s.j + 1) * (2147483648D / cast((k div 8589934592BD) + 1 as double))) as bigint)"
    return F.expr(f"""
      aggregate(sequence(1, {n_shards + 1}),
        named_struct('k', cast(conv(substr(__digest, 1, 16), 16, 10) as decimal(20,0)), 'shard', -1L, 'grown', -1L, 'j', 0L),
        (s, i) -> if(s.j > {n_shards}, s,
          element_at(transform(array({step}), k ->
            named_struct('k', k, 'shard', if(s.j < {n_shards}, s.j, s.shard), 'grown', s.j, 'j', {jumped})), 1)))""")


def assign_shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size (UTF-8 bytes + 8), text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: id and shard count decide, and one more shard takes rows only into itself.  Slots number a
    shard's rows from 0 without gaps, in the order of (digest block, id, crc, size).  A null id hashes as the empty
    string, a null text has no bytes (size 8, crc 0); equal ids meet in one shard with slots of their own; other columns,
    whatever their names, are ignored; an empty table gives no rows.  Only ids and sizes are shuffled, never texts.

    Rows are counted before they are numbered: equal ones by salt, so a null or repeated id, which is all in one shard, is
    numbered in cells of its texts' CRCs and no window holds more than a cell's share of it.
    """
    text = text_or_empty(text_col)
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        key_digest(F.col(id_col)).alias("__digest"),
    )
    walked = sized.withColumn("__walk", jump_walk(n_shards))
    placed = materialise(
        walked.select(
            "doc_id", "size", "text_crc32",
            F.col("__walk.shard").cast("int").alias("shard"),
            F.col("__walk.grown").cast("int").alias("grown_shard"),
            F.substring("__digest", 1, BLOCK_DIGITS).alias("block"),
            F.shiftright("text_crc32", 32 - CELL_BITS).alias("cell"),
            F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"),
        )
    )
    equal = placed.groupBy("shard", "grown_shard", "block", "doc_id", "cell", "text_crc32", "size", "salt").agg(F.count("*").alias("n"))
    cells = materialise(equal.groupBy("shard", "block", "doc_id", "cell").agg(F.sum("n").alias("n")))
    blocks = cells.groupBy("shard", "block").agg(F.sum("n").alias("n"))
    running = lambda window: F.coalesce(F.sum("n").over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select("shard", "block", running(W.partitionBy("shard").orderBy("block")).alias("offset"))
    starts = cells.withColumn("start", running(W.partitionBy("shard", "block").orderBy("doc_id", "cell"))).join(offsets.hint("merge"), ["shard", "block"])
    starts = starts.select(F.col("shard").alias("s"), F.col("block").alias("b"), F.col("doc_id").alias("d"), F.col("cell").alias("c"), (F.col("offset") + F.col("start")).alias("first"))
    inner = equal.withColumn("inner", running(W.partitionBy("shard", "block", "doc_id", "cell").orderBy("text_crc32", "size", "salt")))
    same = (F.col("shard") == F.col("s")) & (F.col("block") == F.col("b")) & (F.col("cell") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("d"))
    slots = F.sequence(F.col("first") + F.col("inner"), F.col("first") + F.col("inner") + F.col("n") - 1)
    return inner.join(starts.hint("merge"), same).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(slots).alias("slot"), "grown_shard")


SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), k AS (SELECT DISTINCT h FROM d),
walk AS (
  SELECT h, ('0x' || left(h, 16))::UBIGINT::HUGEINT AS k, -1::BIGINT AS shard, -1::BIGINT AS grown, 0::BIGINT AS j FROM k
  UNION ALL
  SELECT h, k2, CASE WHEN j < 24 THEN j ELSE shard END, j,
         floor((j + 1) * (2147483648::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (k * {MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM walk WHERE j <= 24)
), placed AS (SELECT h, shard, grown FROM walk WHERE j > 24),
crc_table AS (
  SELECT list(list_reduce([i] || range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tab
  FROM range(256) r(i)
), crc AS (
  SELECT t, xor(list_reduce([4294967295] || list_transform(range(strlen(t)), lambda p: ('0x' || substr(hex(encode(t)), 2 * p + 1, 2))::BIGINT),
         lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS c
  FROM (SELECT DISTINCT t FROM d), crc_table
)
SELECT doc_id, (strlen(d.t) + 8)::BIGINT AS size, c::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY left(h, {BLOCK_DIGITS}), doc_id NULLS FIRST, c, strlen(d.t)) - 1 AS slot,
       grown::INT AS grown_shard
FROM d JOIN placed USING (h) JOIN crc ON crc.t = d.t
"""
