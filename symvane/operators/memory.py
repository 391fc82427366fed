"""Operators on memories: comparing, contradicting, staleness, anchors, corroboration."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from symvane.functions.text import BLOCKING, blank, guard, hamming, redact, sanitize, similarity, simhash
from symvane.functions.words import CHOICES, NEGATIONS, STOP, content_words, note_words, root_of, tongue

#: Thresholds of comparing: a duplicate, a reinforcement, and bits simhashes may differ in.
DUPLICATE, REINFORCED, BITS = 0.94, 0.80, 24
#: Share of the smaller vocabulary two texts must have in common before they can oppose each other.
SHARED = 0.45
#: Most reinforcements that count, and seconds between independent ones.
CAP, INDEPENDENT_SECONDS = 8, 900


@F.pandas_udf(T.StringType())
def opposition(a: pd.Series, b: pd.Series, kind: pd.Series, lang: pd.Series) -> pd.Series:
    """negated, different_choice or null for the words of two notes of one kind, read in one language.

    They must share SHARED of the smaller vocabulary. A word is denied if it follows a negation, function words left
    out; one note denies what the other states without denying it, or both pick something and not the same.
    """

    def judge(x, y, k, g) -> str | None:
        if x is None or y is None:
            return None
        no, pick, stop = set(NEGATIONS[g]), set(CHOICES[g]), set(STOP[g])
        x, y = [w for w in x if w not in stop], [w for w in y if w not in stop]
        subjects = [{w for w in ws if w not in no and w not in pick} for ws in (x, y)]
        small = min(map(len, subjects))
        if not small or len(subjects[0] & subjects[1]) / small < SHARED:
            return None
        denied = [{root_of(q, g) for p, q in zip(ws, ws[1:]) if p in no} for ws in (x, y)]
        stated = [{root_of(w, g) for w in ws} - own for ws, own in zip((x, y), denied)]
        if denied[0] & stated[1] or denied[1] & stated[0]:
            return "negated"
        if k in ("decision", "convention"):
            first = [next((q for p, q in zip(ws, ws[1:]) if p in pick), None) for ws in (x, y)]
            if first[0] and first[1] and first[0] != first[1]:
                return "different_choice"
        return None

    return pd.Series([judge(*row) for row in zip(a, b, kind, lang)], dtype=object)


def anchored_pairs(memories: DataFrame, anchors: DataFrame) -> DataFrame:
    """Pairs (left_id < right_id) of memories of one kind that share an anchor's symbol, once each.

    Memories meet through the symbols they share; a symbol that holds a share of all anchors makes inherent work.
    """
    own = anchors.filter("symbol_id IS NOT NULL").select("memory_id", "symbol_id").distinct().join(memories.select(F.col("id").alias("memory_id"), "kind"), "memory_id")
    other = own.select(F.col("memory_id").alias("right_id"), "symbol_id", "kind")
    return own.withColumnRenamed("memory_id", "left_id").join(other, ["symbol_id", "kind"]).filter("left_id < right_id").select("left_id", "right_id", "kind").distinct()


def compare(pairs: DataFrame, memories: DataFrame) -> DataFrame:
    """What each pair of notes (left_id, right_id, kind) is: contradiction before likeness.

    outcome: conflicts, duplicate, reinforced or distinct; `reason` of a conflict; `similarity` where the
    simhashes are near enough to compare (else 0).
    """
    words = memories.select("id", content_words(F.col("text")).alias("w"), note_words(F.col("text")).alias("all")).withColumn("h", simhash(F.col("w")))
    left = words.select(*[F.col(c).alias(f"l_{c}") for c in words.columns])
    right = words.select(*[F.col(c).alias(f"r_{c}") for c in words.columns])
    both = pairs.join(left, F.col("left_id") == F.col("l_id")).join(right, F.col("right_id") == F.col("r_id"))
    lang = tongue(F.concat("l_all", "r_all"))
    told = both.withColumn("reason", opposition(F.col("l_all"), F.col("r_all"), F.col("kind"), lang)).withColumn("near", hamming(F.col("l_h"), F.col("r_h")) <= BITS)
    scored = told.filter("near").withColumn("similarity", similarity(F.col("l_w"), F.col("r_w"))).unionByName(told.filter("NOT near").withColumn("similarity", F.lit(0.0)))
    outcome = F.when(F.col("reason").isNotNull(), "conflicts").when(F.col("similarity") >= DUPLICATE, "duplicate").when(F.col("similarity") >= REINFORCED, "reinforced").otherwise("distinct")
    return scored.select("left_id", "right_id", "kind", outcome.alias("outcome"), "reason", "similarity")


def admitted(notes: DataFrame) -> DataFrame:
    """Notes ready to be kept: text cleaned and without secrets, with the reasons of the guard; blank ones are left out."""
    clean = notes.withColumn("text", redact(sanitize(F.col("text")))).filter(~blank(F.col("text")))
    return clean.withColumn("reasons", guard(F.col("text")))


#: Anchors a note may have, and memories it is compared with.
MOST_ANCHORS, COMPARED = 10, 200


def remember(notes: DataFrame, anchors: DataFrame, memories: DataFrame, held: DataFrame) -> DataFrame:
    """What becomes of new notes: (id, outcome, memory_id, reason, similarity).

    notes (id, kind, text) and memories (id, kind, text, created_at) have ids of their own; anchors and held are
    (memory_id, symbol_id). A note is cleaned first; one that is blank or that the guard blocks is refused. It is compared
    with the newest COMPARED memories of its kind that share one of its first MOST_ANCHORS anchors. A contradiction comes
    before likeness: it is stored and the conflict reported. One as good as equal is a duplicate if its anchors are the
    same, else, as one that is alike, it reinforces; all others are stored. `memory_id` is what it was found to match.
    """
    clean = notes.withColumn("text", redact(sanitize(F.col("text"))))
    reasons = F.filter(guard(F.col("text")), lambda r: r.isin(list(BLOCKING)))
    judged = clean.select("id", "kind", "text", (blank(F.col("text")) | (F.size(reasons) > 0)).alias("refused"))
    first = Window.partitionBy("memory_id").orderBy("symbol_id")
    own = anchors.filter("symbol_id IS NOT NULL").distinct().withColumn("k", F.row_number().over(first)).filter(F.col("k") <= MOST_ANCHORS).drop("k")
    asked = judged.filter("NOT refused").select(F.col("id").alias("left_id"), "kind").join(own.select(F.col("memory_id").alias("left_id"), "symbol_id"), "left_id")
    other = held.filter("symbol_id IS NOT NULL").distinct().join(memories.select(F.col("id").alias("memory_id"), "kind", "created_at"), "memory_id")
    newest = Window.partitionBy("symbol_id", "kind").orderBy(F.col("created_at").desc(), "memory_id")  # no symbol gives a note more than it may be compared with
    near = other.withColumn("k", F.row_number().over(newest)).filter(F.col("k") <= COMPARED).select(F.col("memory_id").alias("right_id"), "symbol_id", "kind", "created_at")
    met = asked.join(near, ["symbol_id", "kind"]).select("left_id", "right_id", "kind", "created_at").distinct()
    order = Window.partitionBy("left_id").orderBy(F.col("created_at").desc(), "right_id")
    pairs = met.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= COMPARED).select("left_id", "right_id", "kind")
    found = compare(pairs, judged.select("id", "text").unionByName(memories.select("id", "text")))
    places = lambda a: a.filter("symbol_id IS NOT NULL").groupBy("memory_id").agg(F.array_sort(F.collect_set("symbol_id")).alias("at"))
    ours, theirs = places(own), places(held)
    found = found.join(ours.select(F.col("memory_id").alias("left_id"), F.col("at").alias("l_at")), "left_id").join(theirs.select(F.col("memory_id").alias("right_id"), F.col("at").alias("r_at")), "right_id")
    rank = F.when(F.col("outcome") == "conflicts", 0).when((F.col("outcome") == "duplicate") & (F.col("l_at") == F.col("r_at")), 1).when(F.col("outcome").isin("duplicate", "reinforced"), 2).otherwise(3)
    best = found.withColumn("rank", rank).filter("rank < 3").groupBy(F.col("left_id").alias("id")).agg(F.min(F.struct("rank", (-F.col("similarity")).alias("far"), "right_id", "reason")).alias("b"))
    outcome = F.when(F.col("refused"), "refused").when(F.col("b").isNull(), "stored").otherwise(F.element_at(F.array(F.lit("conflicts"), F.lit("duplicate"), F.lit("reinforced")), F.col("b.rank") + 1))
    return judged.join(best, "id", "left").select("id", outcome.alias("outcome"), F.col("b.right_id").alias("memory_id"), F.col("b.reason").alias("reason"), (-F.col("b.far")).alias("similarity"))


#: Columns of a draft: a memory that was suggested and that nobody has confirmed.
DRAFT = ["id", "kind", "text", "about", "created_at"]


def add_drafts(drafts: DataFrame, new: DataFrame) -> DataFrame:
    """Drafts with new ones (DRAFT columns) beside them; a kind and text that is there already keeps its row, copies among the new ones their first."""
    once = new.groupBy("kind", "text").agg(F.min(F.struct("created_at", "id", "about")).alias("r")).select("r.id", "kind", "text", "r.about", "r.created_at")
    return drafts.select(*DRAFT).unionByName(once.join(drafts.select("kind", "text"), ["kind", "text"], "left_anti").select(*DRAFT))


def list_drafts(drafts: DataFrame, limit: int) -> DataFrame:
    """The newest drafts first."""
    return drafts.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def settle_drafts(drafts: DataFrame, ids: DataFrame, keep: bool) -> tuple[DataFrame, DataFrame]:
    """Drafts without those named (column id), and with `keep` the memories they become, by the agent."""
    named = drafts.join(ids.select("id").distinct(), "id", "left_semi")
    kept = named.select("id", "kind", "text", F.lit("agent").alias("provenance"), "created_at")
    return drafts.join(ids.select("id").distinct(), "id", "left_anti"), kept if keep else kept.limit(0)


def corroborations(events: DataFrame) -> DataFrame:
    """Independent corroborations per memory (memory_id, provenance, at): at least a quarter of an hour apart, never by tools, at most eight.

    Spacing is greedy, from the first on; a memory's events are folded in order of time.
    """
    times = events.filter("provenance <> 'tool' AND at IS NOT NULL").groupBy("memory_id").agg(F.array_sort(F.collect_set("at")).alias("ts"))
    step = lambda acc, t: F.when((acc["n"] < CAP) & (acc["last"].isNull() | (t - acc["last"] >= INDEPENDENT_SECONDS)), F.struct((acc["n"] + 1).alias("n"), t.alias("last"))).otherwise(acc)
    folded = F.aggregate("ts", F.struct(F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("last")), step)
    return times.select("memory_id", folded["n"].alias("count"))


def staleness(memories: DataFrame, anchors: DataFrame, symbols: DataFrame) -> DataFrame:
    """Memories whose code changed: (memory_id, stale_reason), the gravest over their anchors.

    An anchor with a live link is compared by id, one without by the first symbol of its qualified name in its
    file. symbols: id, path, qualified_name, start_line, sig_hash, body_hash. deleted before signature before body.
    """
    now = symbols.select("id", "path", "qualified_name", "start_line", F.col("sig_hash").alias("sig_now"), F.col("body_hash").alias("body_now"))
    by_id = anchors.join(now.select(F.col("id").alias("symbol_id"), "sig_now", "body_now", F.lit(True).alias("alive")), "symbol_id", "left")
    first = Window.partitionBy("path", "qualified_name").orderBy("start_line", "id")
    named = now.withColumn("k", F.row_number().over(first)).filter("k = 1").select("path", "qualified_name", F.col("sig_now").alias("sig_named"), F.col("body_now").alias("body_named"), F.lit(True).alias("there"))
    seen = by_id.join(named, ["path", "qualified_name"], "left")
    sig, body = F.coalesce("sig_now", F.when(F.col("alive").isNull(), F.col("sig_named"))), F.coalesce("body_now", F.when(F.col("alive").isNull(), F.col("body_named")))
    rank = F.when(F.col("alive").isNull() & F.col("there").isNull(), 3).when(sig != F.col("sig_hash"), 2).when(body != F.col("body_hash"), 1).otherwise(0)
    worst = seen.groupBy("memory_id").agg(F.max(rank).alias("r")).filter("r > 0")
    names = F.when(F.col("r") == 3, "symbol_deleted").when(F.col("r") == 2, "signature_changed").otherwise("body_changed")
    return worst.join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").select("memory_id", names.alias("stale_reason"))


def mark_stale(memories: DataFrame, reasons: DataFrame, now: Column) -> DataFrame:
    """Memories with stale_since and stale_reason set where `reasons` has them; what is stale already keeps its time."""
    found = reasons.select(F.col("memory_id").alias("id"), F.col("stale_reason").alias("__why"))
    since = F.when(F.col("__why").isNotNull(), F.coalesce("stale_since", now)).otherwise(F.col("stale_since"))
    return memories.join(found, "id", "left").withColumn("stale_since", since).withColumn("stale_reason", F.coalesce("__why", "stale_reason")).drop("__why")


def forget(memories: DataFrame, anchors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memories and anchors without those listed (column id)."""
    return memories.join(gone, "id", "left_anti"), anchors.join(gone.withColumnRenamed("id", "memory_id"), "memory_id", "left_anti")


def reanchor(anchors: DataFrame, symbols: DataFrame) -> DataFrame:
    """Anchors with hashes as they are now: by id, else by path and qualified name; what is gone stays as it was, unlinked."""
    now = symbols.select(F.col("id").alias("symbol_id"), F.col("sig_hash").alias("s1"), F.col("body_hash").alias("b1"))
    named = symbols.groupBy("path", "qualified_name").agg(F.min(F.struct("start_line", "id", "sig_hash", "body_hash")).alias("n"))
    joined = anchors.join(now, "symbol_id", "left").join(named, ["path", "qualified_name"], "left")
    linked = F.when(F.col("s1").isNotNull(), F.col("symbol_id")).otherwise(F.col("n.id"))
    return joined.select("memory_id", "ordinal", linked.alias("symbol_id"), "qualified_name", "path", F.coalesce("s1", "n.sig_hash", "sig_hash").alias("sig_hash"), F.coalesce("b1", "n.body_hash", "body_hash").alias("body_hash"))


def collapse_alike(candidates: pd.DataFrame, alike: set[tuple[int, int]]) -> pd.DataFrame:
    """Memories of one answer without near-duplicates: in order of anchors (most first), length and id, the first of each group stays."""
    kept: list[int] = []
    rows = candidates.assign(_n=-candidates["anchors"], _l=candidates["text"].str.len()).sort_values(["_n", "_l", "id"])
    for i in rows["id"]:
        if not any((min(i, k), max(i, k)) in alike for k in kept):
            kept.append(i)
    return candidates[candidates["id"].isin(kept)]
