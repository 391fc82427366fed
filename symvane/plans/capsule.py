"""Capsules: a question's packed answer as one text under its budget.

Memories take up to a quarter of the budget, in order of relevance, skipping what doesn't fit.
Symbols are packed into the rest; then the whole is rendered and measured, and levels are
lowered from the least relevant symbol up until it fits. The text states its own size, so it is
rendered until the number holds. One task makes a question's capsule; it has at most a few
dozen rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from symvane.functions.text import estimate_tokens
from symvane.operators.pack import CANDIDATES, Candidate, fill_in_order, pack
from symvane.plans.recall import UTILITIES, level_text
from symvane.sources.toon import encode

#: Memories by anchor and by text, relevance of the latter, share of a stale one, part of the budget for all.
ANCHORED, BY_TEXT, TEXT_RELEVANCE, STALE_SHARE, MEMORY_PART = 20, 5, 0.5, 0.6, 4
#: Best symbols that keep at least their signature while others can still give way; relations listed.
KEPT, RELATIONS = 3, 12


def memory_candidates(found: DataFrame, anchors: DataFrame, memories: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Memories of every question: (query_id, id, text, relevance), anchored ones by their best symbol, then those found by text.

    found: (query_id, id, relevance); anchors: (memory_id, symbol_id); memories: (id, text, stale_since or not);
    hits: (query_id, doc) of memories found by text.
    """
    near = found.join(anchors.select("memory_id", F.col("symbol_id").alias("id")), "id").groupBy("query_id", "memory_id").agg(F.max("relevance").alias("rel"))
    order = Window.partitionBy("query_id").orderBy(F.col("rel").desc(), "memory_id")
    rows = near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= ANCHORED).drop("k")
    if hits is not None:
        first = Window.partitionBy("query_id").orderBy("rank", "doc")
        rows = rows.unionByName(hits.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= BY_TEXT).select("query_id", F.col("doc").alias("memory_id"), F.lit(TEXT_RELEVANCE).alias("rel")))
    best = rows.groupBy("query_id", "memory_id").agg(F.max("rel").alias("rel"))
    stale = F.when(F.col("stale_since").isNotNull(), STALE_SHARE).otherwise(1.0) if "stale_since" in memories.columns else F.lit(1.0)
    told = memories.select(F.col("id").alias("memory_id"), "text", stale.alias("share"))
    return best.join(told, "memory_id").select("query_id", F.col("memory_id").alias("id"), "text", (F.col("rel") * F.col("share")).alias("relevance"))


def render(question: str, budget: int, shown: list[dict], memories: list[dict]) -> tuple[str, int]:
    """The capsule's text and its tokens, which it states itself."""
    used = 0
    for _ in range(8):
        body = {"question": question, "budget": budget, "used": used, "symbols": shown, "memories": memories}
        text = encode({k: v for k, v in body.items() if v not in ([], None)})
        now = estimate_tokens(text)
        if now == used:
            break
        used = max(now, used) if _ > 4 else now
    return text, used


def settle(question: str, budget: int, texts: dict[int, dict[int, str]], relevance: dict[int, float], levels: dict[int, int], memories: list[dict]) -> tuple[str, int, dict[int, int]]:
    """Render, and while it is too large lower the least relevant symbol a level, or leave it out; then drop memories.

    The three best keep their signature until nothing else can give way. A capsule that fits nothing is empty.
    """
    order = sorted(levels, key=lambda i: (-relevance[i], i))
    while True:
        rows = [{"id": i, "level": levels[i], "text": texts[i].get(levels[i], "")} for i in order if i in levels]
        text, used = render(question, budget, rows, memories)
        if used <= budget or not rows and not memories:
            return (text, used, levels) if used <= budget else ("", 0, {})
        for i in reversed([i for i in order if i in levels]):
            lower = [lv for lv in texts[i] if lv < levels[i]]
            guarded = i in order[:KEPT]
            if lower and (not guarded or max(lower) >= 1):
                levels[i] = max(lower)
                break
            if not guarded:
                del levels[i]
                break
        else:
            if memories:
                memories = memories[:-1]
            else:
                i = [i for i in order if i in levels][-1]
                lower = [lv for lv in texts[i] if lv < levels[i]]
                if lower:
                    levels[i] = max(lower)
                else:
                    del levels[i]


def capsules(found: DataFrame, symbols: DataFrame, questions: DataFrame, memories: DataFrame | None = None) -> DataFrame:
    """One capsule per question: (query_id, capsule, used, symbols, memories).

    found: (query_id, id, relevance); questions: (query_id, text, budget); memories: rows of `memory_candidates`.
    A question that found nothing has a capsule without symbols; `used` never exceeds the budget.
    """
    shown = symbols.select("id", "name", "signature", "doc", "outline")
    levels = F.array(*[F.concat_ws(" ", "name", level_text(k)) if k else F.col("name") for k in range(4)])
    rows = questions.join(found.select("query_id", "id", "relevance"), "query_id", "left").join(shown.select("id", levels.alias("texts")), "id", "left")
    rows = rows.select("query_id", "text", "budget", F.lit("symbol").alias("what"), "id", "relevance", "texts")
    if memories is not None:
        rows = rows.unionByName(memories.join(questions.select("query_id", F.col("text").alias("q"), "budget"), "query_id").select("query_id", F.col("q").alias("text"), "budget", F.lit("memory").alias("what"), "id", "relevance", F.array("text").alias("texts")))
    schema = T.StructType([T.StructField("query_id", questions.schema["query_id"].dataType), T.StructField("capsule", T.StringType()), T.StructField("used", T.IntegerType()), T.StructField("symbols", T.IntegerType()), T.StructField("memories", T.IntegerType())])

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        question, budget = str(pdf["text"].iloc[0]), int(pdf["budget"].iloc[0])
        notes = pdf[(pdf["what"] == "memory") & pdf["id"].notna()].sort_values(["relevance", "id"], ascending=[False, True])
        told = [{"id": int(i), "text": str(t[0])} for i, t in zip(notes["id"], notes["texts"])]
        told = [told[k] for k in fill_in_order([estimate_tokens(m["text"]) + 4 for m in told], budget // MEMORY_PART)]
        parts = pdf[(pdf["what"] == "symbol") & pdf["id"].notna() & pdf["texts"].notna()].sort_values(["relevance", "id"], ascending=[False, True]).head(CANDIDATES)
        texts, relevance = {}, {}
        for i, rel, ts in zip(parts["id"], parts["relevance"], parts["texts"]):
            ts = [str(t).strip() for t in ts]
            texts[int(i)] = {k: t for k, t in enumerate(ts) if k == 0 or t != ts[k - 1]}
            relevance[int(i)] = float(rel)
        room = budget - sum(estimate_tokens(m["text"]) + 4 for m in told) - estimate_tokens(question) - 12
        packed = pack([Candidate(i, relevance[i], [(k, estimate_tokens(t) + 9, UTILITIES[k]) for k, t in ts.items()]) for i, ts in texts.items()], max(room, 0))
        text, used, levels = settle(question, budget, texts, relevance, dict(packed.chosen), told)
        return pd.DataFrame([(pdf["query_id"].iloc[0], text, used, len(levels), len(told) if text else 0)], columns=schema.names)

    return rows.groupBy("query_id").applyInPandas(make, schema)
