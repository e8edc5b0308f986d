"""Corpus and training audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Sequences of a batch, batches of a step, tokens of a sequence.
BATCH, ACCUMULATE, SEQUENCE = 16, 16, 2048


def corpus_audit(docs: DataFrame, tokens: Column) -> DataFrame:
    """(source, samples, chars, tokens) per source, and a TOTAL row; every sample has one end token more."""
    rows = docs.select("source", F.length("text").cast("long").alias("chars"), (tokens + 1).cast("long").alias("tokens"))
    rolled = rows.rollup("source").agg(F.count("*").alias("samples"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"), F.grouping("source").alias("g"))
    return rolled.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("source")).alias("source"), "samples", F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def acquired_volume(docs: DataFrame) -> DataFrame:
    """(source, chars, approx_tokens) at four characters a token."""
    return docs.groupBy("source").agg(F.sum(F.length("text").cast("long")).alias("chars")).withColumn("approx_tokens", F.expr("chars div 4"))


def epochs(unique_tokens: Column, steps: int, batch: int = BATCH, length: int = SEQUENCE) -> Column:
    """How often the unique tokens have been seen after some steps."""
    return F.lit(float(steps * batch * length)) / F.greatest(unique_tokens, F.lit(1))


def batch_mean_loss(losses: DataFrame, order: str, loss: str, batch: int = BATCH) -> DataFrame:
    """(batches, loss): the mean of batch means, the last, shorter batch weighing the same; 0.0 without rows.

    ``order`` numbers the rows from 0, as ``prefix_sum`` or an index column does.
    """
    means = losses.groupBy(F.floor(F.col(order) / batch).alias("b")).agg(F.avg(loss).alias("m"))
    return means.agg(F.count("*").alias("batches"), F.coalesce(F.avg("m"), F.lit(0.0)).alias("loss"))


def perplexity(loss: Column, bounded: bool = False) -> Column:
    """exp(loss), or exp(min(loss, 20)) as the training log has it."""
    return F.exp(F.least(loss, F.lit(20.0)) if bounded else loss)


def step_losses(micro: DataFrame, accumulate: int = ACCUMULATE) -> DataFrame:
    """(step, loss): the mean over each step's micro-batches; ``micro`` has (index from 0, loss)."""
    return micro.groupBy(F.floor(F.col("index") / accumulate).cast("long").alias("step")).agg(F.avg("loss").alias("loss"))


def throughput(tokens: Column, seconds: Column) -> Column:
    return tokens / F.greatest(seconds, F.lit(1.0))


def held_out_rows(rows: DataFrame, order: str, first: int = 15_000) -> DataFrame:
    """The rows from the ``first``-th on, counted from 1 in the order of a dense index column from 0."""
    return rows.where(F.col(order) >= first - 1)


def second_half(rows: DataFrame, order: str, by: str) -> DataFrame:
    """The rows of each group from half its count on, in order."""
    nth = F.row_number().over(W.partitionBy(by).orderBy(order)) - 1
    sized = rows.withColumn("__nth", nth).join(rows.groupBy(by).agg(F.count("*").alias("__n")), by)
    return sized.where(F.col("__nth") >= F.expr("__n div 2")).drop("__nth", "__n")


def epoch_positions(steps: DataFrame, step: str, sequences: int, per_step: int = BATCH) -> DataFrame:
    """(step, epoch, position): which pass over the data a step's first sequence is in, and where; partial batches are dropped."""
    usable = max(1, sequences // per_step)
    return steps.select(F.col(step).alias("step"), F.floor(F.col(step) / usable).cast("long").alias("epoch"), (F.col(step) % usable * per_step).cast("long").alias("position"))


def seeded_order(key: Column, seed: int) -> Column:
    """A sort key that shuffles reproducibly."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))
