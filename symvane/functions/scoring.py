"""Arithmetic of relevance, learning and percentiles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half-life of learned evidence in seconds (30 days).
HALF_LIFE = 30 * 86_400
# What a signal adds to (alpha, beta).
DELTAS = {"used": (1.0, 0.0), "useful": (2.0, 0.0), "ignored": (0.0, 0.25), "dead_end": (0.0, 1.5), "corrected": (0.0, 2.0)}


def finite(x: Column) -> Column:
    """Whether a number is positive and finite."""
    return F.coalesce(~F.isnan(x) & (x < float("inf")) & (x > 0), F.lit(False))


def decay(seconds: Column, half_life: int = HALF_LIFE) -> Column:
    """Share left after some seconds; all of it if the clock went backwards."""
    return F.when(seconds <= 0, 1.0).otherwise(F.pow(F.lit(0.5), seconds / half_life))


def signal_delta(kind: Column, side: int) -> Column:
    """What a signal adds to alpha (side 0) or beta (side 1); unknown signals add nothing."""
    return F.coalesce(*[F.when(kind == k, v[side]) for k, v in DELTAS.items()], F.lit(0.0))


def beta_mean(alpha: Column, beta: Column) -> Column:
    return (1 + alpha) / (2 + alpha + beta)


def multiplier(alpha: Column, beta: Column, least: float = 0.05) -> Column:
    """0.5 to 1.5, nearer to 1 the less evidence there is; 1 below `least` evidence."""
    e = alpha + beta
    m = 1 + 0.5 * (2 * beta_mean(alpha, beta) - 1) * e / (e + 4)
    return F.when(e < least, 1.0).otherwise(F.least(F.greatest(m, F.lit(0.5)), F.lit(1.5)))


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def text_relevance(score: Column, best: Column) -> Column:
    return F.when(~finite(best) | F.isnan(score), 0.5).otherwise(0.25 + 0.75 * clamp01(score / best))


def partial_relevance(matched: Column, words: Column) -> Column:
    return F.when((words == 0) | ~finite(matched), 0.15).otherwise(0.15 + 0.45 * clamp01(matched / words))


def edge_weight(confidence: Column) -> Column:
    return F.when(confidence >= 2, 1.0).when(confidence == 1, 0.7).otherwise(0.35)


def neighbor_relevance(seed: Column, confidence: Column) -> Column:
    return seed * 0.45 * edge_weight(confidence)


def coaccess_relevance(seed: Column, weight: Column) -> Column:
    return F.when(~finite(weight), 0.0).otherwise(seed * 0.35 * F.least(weight / 3, F.lit(1.0)))


def structural(pagerank: Column, most: Column) -> Column:
    return F.when(~finite(pagerank), 0.05).otherwise(0.05 + 0.15 * F.when(finite(most), clamp01(pagerank / most)).otherwise(0.0))


def boosted(relevance: Column, mult: Column) -> Column:
    return F.least(relevance * F.when(finite(mult), mult).otherwise(1.0), F.lit(1.5))


def nearest_rank(column: str, percent: int) -> Column:
    """Aggregate: the value at rank max(1, ceil(n * percent / 100)) of a column; null over nothing."""
    return F.expr(f"percentile_disc({percent / 100.0}) WITHIN GROUP (ORDER BY `{column}`)")
