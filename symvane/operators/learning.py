"""Learned evidence: decayed Beta posteriors per target, co-access pairs, session rules.

In a log sorted by time, decaying the state and then adding is the same as adding every signal
decayed from its time to the last one; so the whole log folds into one aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from symvane.functions.scoring import HALF_LIFE, decay, multiplier, signal_delta

#: Seconds within which a shown and unused target counts as ignored, and targets it counts for.
IGNORE_SECONDS, IGNORE_MOST = 1_800, 20
#: Seconds whose signals are added up together.
DAY = 86_400
#: Distinct targets before that one counts as used together with.
TOGETHER_LAST = 8


def _folded(rows: DataFrame, keys: list[str], at: Column, values: dict[str, Column]) -> DataFrame:
    """Per key its values, each decayed from its time to the key's last one, and that time as updated_at.

    One aggregate, whose parts are combined before each shuffle: a key's values add up by day, decayed to the day's
    end, and its days, however many rows they stand for, are then rebased to the last time.
    """
    end = (F.floor(at / DAY) + 1) * DAY
    timed = rows.select(*keys, at.alias("__at"), end.alias("__end"), *[v.alias(k) for k, v in values.items()])
    share = decay(F.col("__end") - F.col("__at"))
    days = timed.groupBy(*keys, "__end").agg(F.max("__at").alias("__at"), *[F.sum(F.col(k) * share).alias(k) for k in values])
    whole = days.groupBy(*keys).agg(F.max("__at").alias("updated_at"), F.collect_list(F.struct("__end", *values)).alias("__days"))

    def rebased(k: str) -> Column:
        return F.aggregate("__days", F.lit(0.0), lambda acc, x: acc + x[k] * F.pow(F.lit(0.5), (F.col("updated_at") - x["__end"]) / HALF_LIFE)).alias(k)

    sums = [rebased(k) for k in values]
    return whole.select(*keys, *sums, "updated_at")


def utility(signals: DataFrame) -> DataFrame:
    """State per target (target_kind, target_id, alpha, beta, updated_at) after the whole log, in order of time.

    Signals of unknown kind add nothing but still move the time; null times count as the earliest.
    """
    values = {"alpha": signal_delta(F.col("kind"), 0), "beta": signal_delta(F.col("kind"), 1)}
    return _folded(signals, ["target_kind", "target_id"], F.coalesce("at", F.lit(0)).cast("bigint"), values)


def multipliers(state: DataFrame, now: Column) -> DataFrame:
    """What each target's relevance is multiplied with at a time: (target_id, multiplier)."""
    share = decay(now - F.col("updated_at"))
    return state.select("target_kind", "target_id", multiplier(F.col("alpha") * share, F.col("beta") * share).alias("multiplier"))


def coaccess(pairs: DataFrame) -> DataFrame:
    """Weight of every pair (a < b) seen together at times `at`: decayed to the last time, plus one each."""
    return _folded(pairs, ["a", "b"], F.col("at").cast("bigint"), {"weight": F.lit(1.0)})


def partners(weights: DataFrame, now: Column, k: int) -> DataFrame:
    """The k strongest partners of every target by decayed weight: (id, partner, weight, rank)."""
    w = (F.col("weight") * decay(now - F.col("updated_at"))).alias("weight")
    both = weights.select(F.col("a").alias("id"), F.col("b").alias("partner"), w).unionByName(weights.select(F.col("b").alias("id"), F.col("a").alias("partner"), w))
    order = Window.partitionBy("id").orderBy(F.round("weight", 9).desc(), "partner")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def status(state: DataFrame, signals: DataFrame, weights: DataFrame) -> DataFrame:
    """Counts of what has been learned: (what, n)."""
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    return one("targets", state).unionByName(one("signals", signals)).unionByName(one("pairs", weights))


def reset(state: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """State without what was learned of some targets (target_kind, target_id), or of all."""
    return state.limit(0) if targets is None else state.join(targets, ["target_kind", "target_id"], "left_anti")


def feedback(targets: DataFrame, kind: str, at: int) -> DataFrame:
    """Signals of one kind for targets (target_kind, target_id), given by hand at a time."""
    return targets.select("target_kind", "target_id", F.lit(kind).alias("kind"), F.lit(at).cast("bigint").alias("at"))


def ignored(shown: DataFrame) -> DataFrame:
    """Targets shown (session, target_id, at, level, expanded) and, at the next showing within half an hour, not used: (session, target_id, at).

    Only targets shown with at least a signature that were never expanded count, the first twenty of a showing by id.
    """
    shows = shown.select("session", "at").distinct().withColumn("next_at", F.lead("at").over(Window.partitionBy("session").orderBy("at")))
    stale = shown.filter("level >= 1 AND NOT expanded").join(shows, ["session", "at"]).filter(F.col("next_at") - F.col("at") < IGNORE_SECONDS)
    order = Window.partitionBy("session", "at").orderBy("target_id")
    return stale.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= IGNORE_MOST).select("session", "target_id", F.col("next_at").alias("at"))


def expanded_together(opened: DataFrame, last: int = TOGETHER_LAST) -> DataFrame:
    """Pairs (a, b, at) of each opened target (session, target_id, at) with the last distinct ones before it in its session.

    A target's place is that of its latest opening before; equal times order by target. Sessions stream through
    their task in order, which holds `last` targets and nothing else, so a session may be of any length.
    """
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("at", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, recent = None, []
        for pdf in batches:
            out = []
            for s, t, at in zip(pdf["session"], pdf["target_id"], pdf["at"]):
                if s != session:
                    session, recent = s, []
                out += [(min(t, o), max(t, o), at) for o in recent if o != t]
                recent = [t, *[o for o in recent if o != t]][:last]
            yield pd.DataFrame(out, columns=["a", "b", "at"])

    rows = opened.select("session", "target_id", "at").filter("session IS NOT NULL AND target_id IS NOT NULL AND at IS NOT NULL").distinct()
    return rows.repartition("session").sortWithinPartitions("session", "at", "target_id").mapInPandas(run, schema)
