"""Mixing sources to target weights with a low-discrepancy schedule.

Every source is shuffled by digest, laid out as one stream of words and cut into equal blocks.  Slot times are the van der
Corput permutation of the points of the cumulative weights, so at any time each source has had close to its share.  The
r-th slot of a source takes block ``r mod n_blocks`` of pass ``r div n_blocks``; the last pass stops at the quota.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm.common import WORD
from tesserae.storage import materialise, small_side

#: Hex digits of the shuffle digest that cut a source into blocks of rows, so that no window holds a whole source.
BLOCK_DIGITS = 3
#: Salts that cut the rows which are equal in id, source and size.
SALTS = 4096
#: Slots that one task expands at a time.
SLOT_CHUNK = 4096
#: Time chunks (a power of two) within which slots are ranked.
TIME_BITS = 10
#: The masks of the butterfly that reverses 64 bits.
MASKS = ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF))


def reverse_bits(value: Column, bits: int) -> Column:
    """The lowest ``bits`` bits of a non-negative long in reverse order."""
    for by, mask in MASKS:
        value = F.shiftrightunsigned(value, by).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(value.bitwiseAND(F.lit(mask)), by))
    return F.shiftrightunsigned(value, 64 - bits)


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(column: str = "source") -> Column:
    """A join key that keeps the null source apart from every text."""
    return F.coalesce(F.concat(F.lit("s"), F.col(column)), F.lit("-"))


def place(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """(doc_id, source, skey, size, start): each row's place in the shuffled word stream of its source.

    Equal rows are counted by salt before they are placed, and the rows of one id are placed by size, so no window holds all
    rows of a null or repeated id.
    """
    sized = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")).cast("binary")).alias("h"),
        ).withColumn("skey", source_key()).withColumn("part", F.substring("h", 1, BLOCK_DIGITS)).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    )
    equal = sized.groupBy("skey", "source", "part", "h", "doc_id", "size", "salt").agg(F.count("*").alias("n"))
    cells = materialise(equal.groupBy("skey", "part", "h", "size").agg(F.sum(F.col("n") * F.col("size")).alias("words")))
    parts = cells.groupBy("skey", "part").agg(F.sum("words").alias("words"))
    running = lambda words, window: F.coalesce(F.sum(words).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("skey", "part", running("words", W.partitionBy("skey").orderBy("part")).alias("offset"))
    firsts = cells.withColumn("first", running("words", W.partitionBy("skey", "part").orderBy("h", "size"))).join(offsets.hint("merge"), ["skey", "part"])
    inner = equal.withColumn("inner", running(F.col("n") * F.col("size"), W.partitionBy("skey", "part", "h", "size").orderBy("salt")))
    placed = inner.join(firsts.drop("words").hint("merge"), ["skey", "part", "h", "size"]).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return placed.select("doc_id", "source", "skey", "size", (F.col("offset") + F.col("first") + F.col("inner") + F.col("nth") * F.col("size")).alias("start"))


def source_targets(placed: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, block_words: int = 512) -> DataFrame:
    """One row per source: weight, source_size, target, and its blocks and slots.

    Sources in code-point order, null last, take the weights in turn.  The target is ``min(cap * size, level * weight)``
    with the level at which all targets add up to all words: what sharing the excess anew until none is above comes to.
    The windows run over one row per source.
    """
    one = F.lit(1)
    src = placed.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(W.partitionBy(one).orderBy(F.col("source").asc_nulls_last()))
    src = src.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((nth - 1) % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * F.lit(float(cap))
    by_ratio = W.partitionBy(one).orderBy("ratio", "skey")
    src = src.withColumn("ratio", limit / F.col("weight"))
    capped = F.coalesce(F.sum(limit).over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    src = src.withColumn("level", (F.sum("source_size").over(W.partitionBy(one)) - capped) / free)
    top = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(W.partitionBy(one))
    src = src.withColumn("target", F.least(limit, F.coalesce(top, F.lit(0.0)) * F.col("weight")))
    src = src.withColumn("quota", F.round("target").cast("long"))
    size = F.greatest(F.col("source_size"), F.lit(1))
    src = src.withColumn("n_blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    src = src.withColumn("full", F.expr(f"quota div greatest(source_size, 1L)")).withColumn("rest", F.col("quota") % size)
    src = src.withColumn("slots", F.col("full") * F.col("n_blocks") + F.ceil(F.col("rest") / block_words).cast("long"))
    before = W.partitionBy(one).orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    return src.withColumn("first_slot", F.coalesce(F.sum("slots").over(before), F.lit(0))).select(
        "skey", "source", "weight", "source_size", "target", "quota", "n_blocks", "full", "rest", "slots", "first_slot"
    )


def slot_schedule(plan: DataFrame) -> DataFrame:
    """(skey, time, pass, block): every slot of the mix.  ``plan`` is materialised; times are distinct."""
    total = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    bits = max(1, (max(1, total) - 1).bit_length())
    chunks = plan.where("slots > 0").select(
        "skey", "first_slot", "slots", "n_blocks", F.explode(F.expr(f"sequence(0L, (slots - 1) div {SLOT_CHUNK}L)")).alias("chunk")
    )
    spread = chunks.repartition("skey", "chunk")
    points = spread.select(
        "skey", "n_blocks",
        F.explode(F.expr(f"sequence(first_slot + chunk * {SLOT_CHUNK}, first_slot + least(slots, (chunk + 1) * {SLOT_CHUNK}) - 1)")).alias("point"),
    )
    timed = points.withColumn("time", reverse_bits(F.col("point"), bits))
    timed = materialise(timed.withColumn("part", F.shiftright("time", max(0, bits - TIME_BITS))).drop("point"))
    counts = timed.groupBy("skey", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("skey").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("skey", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    nth = F.row_number().over(W.partitionBy("skey", "part").orderBy("time"))
    ranked = timed.withColumn("nth", nth).join(offsets.hint("merge"), ["skey", "part"])
    ranked = ranked.withColumn("rank", F.col("offset") + F.col("nth") - 1)
    return ranked.select("skey", "time", F.expr("rank div n_blocks").alias("pass"), (F.col("rank") % F.col("n_blocks")).alias("block"))


def mix_spans(placed: DataFrame, plan: DataFrame, block_words: int = 512) -> DataFrame:
    """The mix itself: (time, skey, start, doc_id, pass, from_word, to_word), a row per slot and document that it holds.

    Reading rows by (time, from_word) gives the training order; positions count words of the source's shuffled stream.
    """
    pieces = placed.where("size > 0").select(
        "doc_id", "skey", "start", "size",
        F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")).alias("block"),
    ).select(
        "doc_id", "skey", "start", "block",
        F.greatest(F.col("start"), F.col("block") * block_words).alias("from_word"),
        F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words).alias("upto"),
    )
    limits = small_side(plan.select("skey", "full", "rest", "source_size"))
    slots = slot_schedule(plan).join(limits, "skey")
    slots = slots.withColumn("limit", F.when(F.col("pass") < F.col("full"), F.col("source_size")).otherwise(F.col("rest")))
    joined = pieces.join(slots.select("skey", "block", "time", "pass", "limit").hint("merge"), ["skey", "block"])
    return joined.withColumn("to_word", F.least("upto", "limit")).where("to_word > from_word").select(
        "time", "skey", "start", "doc_id", "pass", "from_word", "to_word"
    )


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, block_words: int = 512, **names: str) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken.

    ``taken`` adds up the words of the row in all slots of the mix, repeats counted; a source's rows add up to its target,
    rounded to a word, and no row is taken more than ``ceil(cap)`` times.  Null texts and texts without words have size 0
    and are taken 0 times; the null source is a source of its own; repeated rows are placed one after the other; other
    columns are ignored; an empty table gives no rows.  Only ids and word counts are shuffled.
    """
    placed = materialise(place(docs, **names))
    plan = materialise(source_targets(placed, weights, cap, block_words))
    taken = mix_spans(placed, plan, block_words).groupBy("skey", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    some = placed.where("size > 0").join(taken.hint("merge"), ["skey", "start"], "left")
    none = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    rows = some.unionByName(none.select(some.columns))
    return rows.join(small_side(plan.select("skey", "source_size", "target")), "skey").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('mix' || coalesce(':' || doc_id::VARCHAR, '')) AS h FROM documents
), placed AS (
  SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS start FROM d
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w FROM d GROUP BY source
), rounds(n, source, source_size, w, target, capped) AS (
  SELECT 0, source, source_size, w, (SELECT sum(source_size) FROM src)::DOUBLE * w / (SELECT sum(w) FROM src), false FROM src
  UNION ALL
  SELECT * FROM (
    WITH c AS (SELECT *, capped OR target > 3.0 * source_size AS over FROM rounds),
         x AS (SELECT sum(CASE WHEN over AND NOT capped THEN target - 3.0 * source_size ELSE 0 END) AS excess,
                      sum(CASE WHEN over THEN 0 ELSE w END) AS free FROM c)
    SELECT n + 1, source, source_size, w, CASE WHEN over THEN 3.0 * source_size ELSE target + excess * w / free END, over
    FROM c, x WHERE excess > 0)
), final AS (
  SELECT source, source_size, target, round(target)::BIGINT // greatest(source_size, 1) AS whole, round(target)::BIGINT % greatest(source_size, 1) AS rest
  FROM rounds WHERE n = (SELECT max(n) FROM rounds)
)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(start + size, rest) - start))::BIGINT AS taken
FROM placed JOIN final ON placed.source IS NOT DISTINCT FROM final.source
"""
