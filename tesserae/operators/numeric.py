"""Schedules, sizes and costs of a training run, and vector numerics on array columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import let


def lr_schedule(step: Column, warmup: int, last: int, high: float, low: float) -> Column:
    """Linear warm-up, then a half cosine down to ``low``."""
    share = (step - warmup) / F.lit(float(max(1, last - warmup)))
    cosine = F.lit(low) + F.lit(0.5 * (high - low)) * (1 + F.cos(F.lit(math.pi) * share))
    return F.when(step < warmup, F.lit(high) * step / F.lit(float(max(1, warmup)))).when(step >= last, F.lit(low)).otherwise(cosine)


def parameter_count(vocab: Column, hidden: Column, layers: Column, heads: Column, kv_heads: Column, inner: Column, tied: Column) -> Column:
    """Weights of a decoder with grouped key and value heads, gated inner layers and scale-only norms."""
    head = F.floor(hidden / heads)
    layer = 2 * hidden * heads * head + 2 * hidden * kv_heads * head + 3 * hidden * inner + 2 * hidden
    return (vocab * hidden * F.when(tied, 1).otherwise(2) + layers * layer + hidden).cast("long")


def flops_per_step(parameters: Column, sequences: Column, length: Column) -> Column:
    return F.lit(6.0) * parameters * sequences * length


def residual_scale(layers: Column) -> Column:
    return 1 / F.sqrt(2.0 * layers)


def rope_table(spark: SparkSession, width: int, positions: int, base: float = 10_000.0) -> DataFrame:
    """(position, i, cos, sin) for i < width / 2."""
    pairs = F.explode(F.sequence(F.lit(0), F.lit(width // 2 - 1))).alias("i")
    rows = spark.range(positions).select(F.col("id").alias("position"), pairs)
    angle = F.col("position") * F.pow(F.lit(base), -2.0 * F.col("i") / width)
    return rows.select("position", F.col("i").cast("long").alias("i"), F.cos(angle).alias("cos"), F.sin(angle).alias("sin"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def rms_norm(values: Column, eps: float = 1e-6) -> Column:
    """x / sqrt(mean(x**2) + eps)."""
    return let(values.cast("array<double>"), lambda v: let(
        F.sqrt(total(F.transform(v, lambda x: x * x)) / F.size(v) + eps), lambda r: F.transform(v, lambda x: x / r)))


def softmax(values: Column, temperature: float = 1.0) -> Column:
    """Probabilities of logits over max(0.01, temperature)."""
    scaled = F.transform(values.cast("array<double>"), lambda x: x / F.lit(max(0.01, temperature)))
    return let(scaled, lambda v: let(F.array_max(v), lambda m: let(
        F.transform(v, lambda x: F.exp(x - m)), lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))))


def greedy_token(values: Column) -> Column:
    """0-based index of the first largest logit."""
    return F.array_position(values, F.array_max(values)) - 1


def cross_entropy(values: Column, target: Column) -> Column:
    """log(sum(exp(x))) - x[target], for a 0-based target."""
    return let(values.cast("array<double>"), lambda v: let(F.array_max(v), lambda m: (
        m + F.log(total(F.transform(v, lambda x: F.exp(x - m)))) - F.get(v, target))))


def run_cost(hours: Column, rate: Column) -> Column:
    return hours * rate
