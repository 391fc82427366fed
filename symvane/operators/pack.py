"""Packing levels of detail into a token budget: a multiple-choice knapsack per query.

Options of a candidate are reduced to their concave envelope; marginal steps are taken by
efficiency from a heap while they fit; what is left is filled with the best single upgrades. A
query has at most a few dozen candidates, so one task packs each query whole, many queries at
once; the envelope and the greedy fill depend on order and have no form in Catalyst.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Most candidates a query brings.
CANDIDATES = 60


@dataclass
class Candidate:
    """One thing to show: its relevance and options (level, tokens, utility), level 0 first or none."""

    id: int
    relevance: float
    options: list[tuple[int, int, float]] = field(default_factory=list)


@dataclass
class Packed:
    chosen: dict[int, int]
    used: int
    value: float
    bound: float


def envelope(options: list[tuple[int, int, float]], relevance: float) -> list[tuple[int, int, float]]:
    """Vertices of the concave envelope from (0, 0): options that no mix of others beats, by tokens."""
    if not (math.isfinite(relevance) and relevance > 0):
        return []
    points = sorted({(t, -v * relevance, lv) for lv, t, v in options if t >= 0 and math.isfinite(v) and v > 0})
    hull: list[tuple[int, int, float]] = [(-1, 0, 0.0)]
    for t, minus, level in points:
        value = -minus
        if value <= hull[-1][2]:
            continue
        while len(hull) > 1 and (value - hull[-2][2]) * (hull[-1][1] - hull[-2][1]) >= (hull[-1][2] - hull[-2][2]) * (t - hull[-2][1]):
            hull.pop()
        if t == hull[-1][1]:
            if len(hull) == 1:  # costs nothing
                hull.append((level, t, value))
            else:
                hull[-1] = (level, t, value)
        else:
            hull.append((level, t, value))
    return hull[1:]


def pack(candidates: list[Candidate], budget: int) -> Packed:
    """The chosen level of each candidate that is shown, tokens used, value, and the bound no packing can pass."""
    hulls = [envelope(c.options, c.relevance) for c in candidates]
    at = [-1] * len(candidates)
    left, value, bound, broken = budget, 0.0, 0.0, False
    heap: list[tuple[float, int, int]] = []

    def offer(i: int) -> None:
        k = at[i] + 1
        if k < len(hulls[i]):
            before = hulls[i][k - 1] if k else (-1, 0, 0.0)
            dt, dv = hulls[i][k][1] - before[1], hulls[i][k][2] - before[2]
            heapq.heappush(heap, (-(dv / dt if dt else math.inf), i, k))

    for i in range(len(candidates)):
        offer(i)
    while heap:
        _, i, k = heapq.heappop(heap)
        before = hulls[i][k - 1] if k else (-1, 0, 0.0)
        dt, dv = hulls[i][k][1] - before[1], hulls[i][k][2] - before[2]
        if dt <= left:
            at[i], left, value = k, left - dt, value + dv
            if not broken:
                bound = value
            offer(i)
        elif not broken:
            bound, broken = value + dv * left / dt, True
    chosen = {c.id: hulls[i][at[i]] for i, c in enumerate(candidates) if at[i] >= 0}
    while True:  # fill what is left with the single change that gains most
        best = None
        for i, c in enumerate(candidates):
            now = chosen.get(c.id, (-1, 0, 0.0))
            if not (math.isfinite(c.relevance) and c.relevance > 0):
                continue
            for level, t, v in c.options:
                gain, cost = v * c.relevance - now[2], t - now[1]
                if gain > 1e-12 and cost <= left and t >= 0 and math.isfinite(v) and (best is None or (-gain, cost, i, level) < best[0]):
                    best = ((-gain, cost, i, level), c.id, (level, t, v * c.relevance))
        if best is None:
            break
        left, value = left - best[0][1], value - best[0][0]
        chosen[best[1]] = best[2]
    return Packed({k: v[0] for k, v in chosen.items()}, budget - left, value, max(bound, value))


def pack_batch(options: DataFrame, budgets: DataFrame) -> DataFrame:
    """Chosen levels (query_id, id, level, tokens) of many queries.

    options: (query_id, id, relevance, level, tokens, utility); budgets: (query_id, budget). Only the CANDIDATES most
    relevant of a query are packed, as the ranking before it defines. Queries without a budget give none.
    """
    schema = T.StructType([T.StructField("query_id", options.schema["query_id"].dataType), T.StructField("id", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("tokens", T.IntegerType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for i, part in pdf.groupby("id"):
            rows.append(Candidate(int(i), float(part["relevance"].iloc[0]), list(zip(part["level"].astype(int), part["tokens"].astype(int), part["utility"].astype(float)))))
        rows = sorted(rows, key=lambda c: (-c.relevance, c.id))[:CANDIDATES]
        packed = pack(rows, int(pdf["budget"].iloc[0]))
        cost = {(c.id, lv): t for c in rows for lv, t, _ in c.options}
        out = [(pdf["query_id"].iloc[0], i, lv, cost[i, lv]) for i, lv in sorted(packed.chosen.items())]
        return pd.DataFrame(out, columns=["query_id", "id", "level", "tokens"])

    return options.join(budgets, "query_id").groupBy("query_id").applyInPandas(run, schema)


def fill_in_order(sizes: list[int], room: int) -> list[int]:
    """Positions taken in order, skipping what doesn't fit and going on."""
    taken = []
    for i, n in enumerate(sizes):
        if n <= room:
            taken.append(i)
            room -= n
    return taken
