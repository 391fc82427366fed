"""Recall and its kin as dataflows: many questions a job, one grouped task per question to pack.

seeds (exact, text, relaxed) -> expansion over edges and pairs used together -> structural score
-> learned multiplier -> the sixty best -> options per level of detail -> packing under the
budget. Everything before packing is one lazily planned frame keyed by query_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symvane.functions import scoring as sc
from symvane.functions.text import first_sentence, fold, token_estimate, word_parts
from symvane.operators.pack import CANDIDATES, pack_batch
from symvane.operators.search import STOP_WORDS, Index, baseline, bm25, postings, query_terms
from symvane.runtime import cut

#: Exact and text seeds of a query, and how few text seeds make it relax.
EXACT, TEXT, FEW = 10, 40, 8
#: Seeds that are expanded, neighbours of each a direction; seeds for pairs, partners of each.
EXPAND, NEIGHBORS, PAIR_SEEDS, PARTNERS = 6, 6, 4, 4
#: Utility of the levels: name, signature, summary, outline, source.
UTILITIES = [1.0, 2.6, 3.3, 4.0, 5.0]
#: Levels whose source costs more than this aren't offered.
SOURCE_TOKENS = 3_000


@dataclass
class Tables:
    """What recall reads: symbols (with path), index, edges, and if there are any pairs used together, learned state and sources (id, source)."""

    symbols: DataFrame
    postings: Index
    edges: DataFrame
    pairs: DataFrame | None = None
    state: DataFrame | None = None
    sources: DataFrame | None = None


def exact_seeds(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """Symbols named exactly as a one-word question, the first ten: (query_id, id, rel, reason)."""
    single = queries.filter(~F.trim("text").contains(" ")).select("query_id", F.trim("text").alias("asked"))
    hit = symbols.select("id", "name", "path").join(single, F.lower("name") == F.lower("asked"))
    order = Window.partitionBy("query_id").orderBy((F.col("name") == F.col("asked")).desc(), "path", "id")
    return hit.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= EXACT).select("query_id", "id", F.lit(1.0).alias("rel"), F.lit("exact name").alias("reason"))


def text_seeds(postings: Index, queries: DataFrame) -> DataFrame:
    """Full-text seeds; where there are fewer than eight, without stop words at nine tenths, and then any word."""
    terms = query_terms(queries, "query_id", "text")
    content = terms.filter(~F.col("term").isin(STOP_WORDS) & (F.length("term") > 1))

    def scored(hits: DataFrame) -> DataFrame:
        best = F.max("score").over(Window.partitionBy("query_id"))
        return hits.withColumn("best", best)

    strict = cut(scored(bm25(postings, terms, limit=TEXT)).select("query_id", F.col("doc").alias("id"), sc.text_relevance(F.col("score"), F.col("best")).alias("rel"), F.lit("text").alias("reason")))
    have = strict.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    poor = queries.select("query_id").join(have, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < FEW).select("query_id")
    loose_terms = content.join(poor, "query_id", "left_semi")
    loose = cut(scored(bm25(postings, loose_terms, limit=TEXT)).select("query_id", F.col("doc").alias("id"), (0.9 * sc.text_relevance(F.col("score"), F.col("best"))).alias("rel"), F.lit("content words").alias("reason")))
    have2 = strict.unionByName(loose).select("query_id", "id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    poorer = poor.join(have2, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < FEW).select("query_id")
    some = scored(bm25(postings, content.join(poorer, "query_id", "left_semi"), any_word=True, limit=TEXT))
    part = some.select("query_id", F.col("doc").alias("id"), sc.partial_relevance(F.pow(F.col("score") / F.col("best"), 2), F.lit(1)).alias("rel"), F.lit("some words").alias("reason"))
    return strict.unionByName(loose).unionByName(part)


def merge(candidates: DataFrame) -> DataFrame:
    """Best relevance per (query_id, id) and its three strongest reasons."""
    kept = candidates.filter(sc.finite(F.col("rel"))).groupBy("query_id", "id", "reason").agg(F.max("rel").alias("rel"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("rel")).alias("r"), "reason")))
    return kept.groupBy("query_id", "id").agg(F.max("rel").alias("rel"), F.array_join(F.slice(F.transform(order, lambda x: x["reason"]), 1, 3), "; ").alias("reason"))


def _top(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("rel", 9).desc(), "id")
    return candidates.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= k).drop("k")


def expand_seeds(seeds: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Neighbours of the six best seeds, six each way, over edges that are no mere guess."""
    top = _top(seeds, EXPAND).select("query_id", F.col("id").alias("seed"), F.col("rel").alias("from_rel"))
    e = edges.filter("confidence >= 1")
    both = e.select(F.col("src").alias("seed"), F.lit("calls").alias("way"), F.col("dst").alias("id"), "confidence", "line").unionByName(e.select(F.col("dst").alias("seed"), F.lit("called").alias("way"), F.col("src").alias("id"), "confidence", "line"))
    near = top.join(both, "seed").join(symbols.select("id", "path", "start_line"), "id")
    order = Window.partitionBy("query_id", "seed", "way").orderBy(F.col("confidence").desc(), "path", "line", "start_line", "id")
    kept = near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= NEIGHBORS)
    return kept.select("query_id", "id", sc.neighbor_relevance(F.col("from_rel"), F.col("confidence")).alias("rel"), F.col("way").alias("reason"))


def used_together(seeds: DataFrame, partners: DataFrame) -> DataFrame:
    """Partners (id, partner, weight, rank) of the four best seeds, four each."""
    top = _top(seeds, PAIR_SEEDS).select("query_id", "id", F.col("rel").alias("from_rel"))
    near = top.join(partners.filter(F.col("rank") <= PARTNERS), "id")
    return near.select("query_id", F.col("partner").alias("id"), sc.coaccess_relevance(F.col("from_rel"), F.col("weight")).alias("rel"), F.lit("used together").alias("reason"))


def ranked(tables: Tables, queries: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """The best candidates of every question: (query_id, id, relevance, reason)."""
    seeds = cut(merge(exact_seeds(tables.symbols, queries).unionByName(text_seeds(tables.postings, queries))))
    parts = seeds.unionByName(expand_seeds(seeds, tables.edges, tables.symbols))
    if tables.pairs is not None:
        parts = parts.unionByName(used_together(seeds, tables.pairs))
    whole = merge(parts).join(tables.symbols.select("id", "pagerank"), "id")
    peak = F.max("pagerank").over(Window.partitionBy("query_id"))
    whole = whole.withColumn("rel", F.col("rel") + sc.structural(F.col("pagerank"), peak))
    if tables.state is not None:
        whole = whole.join(tables.state.select(F.col("target_id").alias("id"), "multiplier"), "id", "left").withColumn("rel", sc.boosted(F.col("rel"), F.coalesce("multiplier", F.lit(1.0))))
    return _top(whole.select("query_id", "id", "rel", "reason"), most).select("query_id", "id", F.round("rel", 9).alias("relevance"), "reason")


def level_text(level: int):
    """What is shown of a symbol at a level: nothing, signature, with summary, with calls."""
    summary = first_sentence(F.coalesce("doc", F.lit("")))
    told = F.when(summary == "", F.col("signature")).otherwise(F.concat_ws(" - ", "signature", summary))
    calls = F.when(F.size("outline") > 0, F.concat(told, F.lit(" | calls: "), F.array_join("outline", ", "))).otherwise(told)
    return [F.lit(""), F.col("signature"), told, calls][level]


def options(candidates: DataFrame, symbols: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Options of every candidate: (query_id, id, relevance, level, tokens, utility); a level whose text equals the one before is left out.

    With `sources` (id, source) the last level is the source itself, where it takes at most SOURCE_TOKENS.
    """
    rows = candidates.join(symbols.select("id", "name", "signature", "doc", "outline"), "id")
    texts = [level_text(k) for k in range(4)]
    name = token_estimate(F.col("name"))
    made = []
    for k, text in enumerate(texts):
        cost = name + 1 if k == 0 else 9 + name + token_estimate(text)
        keep = F.lit(True) if k == 0 else text != texts[k - 1]
        made.append(F.when(keep, F.struct(F.lit(k).alias("level"), cost.cast("int").alias("tokens"), F.lit(UTILITIES[k]).alias("utility"))))
    if sources is not None:
        rows = rows.join(sources.select("id", token_estimate(F.col("source")).alias("__source")), "id", "left")
        whole = F.struct(F.lit(4).alias("level"), (17 + name + F.col("__source")).cast("int").alias("tokens"), F.lit(UTILITIES[4]).alias("utility"))
        made.append(F.when((F.col("__source") > 0) & (F.col("__source") <= SOURCE_TOKENS), whole))
    return rows.select("query_id", "id", "relevance", F.explode(F.array_compact(F.array(*made))).alias("o")).select("query_id", "id", "relevance", "o.level", "o.tokens", "o.utility")


#: Relations listed beside an answer.
RELATIONS = 12


def relations(chosen: DataFrame, edges: DataFrame, most: int = RELATIONS) -> DataFrame:
    """Certain edges among the symbols of an answer, the first `most` by kind and ends: (query_id, src, dst, kind, rank)."""
    ends = chosen.select("query_id", "id").distinct()
    sure = edges.filter("confidence >= 2").select("src", "dst", "kind").distinct()
    both = sure.join(ends.withColumnRenamed("id", "src"), "src").join(ends.withColumnRenamed("id", "dst"), ["query_id", "dst"]).filter("src <> dst")
    order = Window.partitionBy("query_id").orderBy("kind", "src", "dst")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("query_id", "src", "dst", "kind", "rank")


def recall(tables: Tables, queries: DataFrame) -> DataFrame:
    """Answers (query_id, id, level, tokens, relevance, reason). queries: (query_id, text, budget)."""
    found = cut(ranked(tables, queries))
    chosen = pack_batch(options(found, tables.symbols, tables.sources), queries.select("query_id", "budget"))
    return chosen.join(found, ["query_id", "id"])


def expand(sources: DataFrame, first: int, last: int, lines: int = 400, tokens: int = 6_000) -> DataFrame:
    """Lines first to last of each source (id, text), as many as fit: (id, text, shown, has_more).

    The longest start of the window whose estimated tokens stay within `tokens`, found over running sums of its lines.
    """
    window = F.slice(F.split("text", r"\r\n|\n|\r"), first, min(last - first + 1, lines))
    each = F.transform(window, lambda x: token_estimate(x) + 2)
    sums = F.aggregate(each, F.struct(F.lit(0).alias("n"), F.lit(0).alias("t")), lambda acc, x: F.when((acc["t"] + x <= tokens) & (acc["t"] >= 0), F.struct((acc["n"] + 1).alias("n"), (acc["t"] + x).alias("t"))).otherwise(F.struct(acc["n"].alias("n"), F.lit(-1).alias("t"))))
    shown = F.greatest(sums["n"], F.lit(0))
    all_lines = F.size(F.split("text", r"\r\n|\n|\r"))
    return sources.select("id", F.array_join(F.slice(window, F.lit(1), shown), "\n").alias("body"), shown.alias("shown"), ((shown + first - 1) < F.least(F.lit(last), all_lines)).alias("has_more"))


def outline(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per path the most detail at which all its rows fit the budget: (path, detail, tokens, fits). No row is ever dropped.

    rows: (path, id, name, signature, doc); budgets: (path, budget).
    """
    name = token_estimate(F.col("name")) + 1
    signature = 9 + token_estimate(F.col("signature"))
    documented = signature + F.when(F.col("doc") == "", 0).otherwise(token_estimate(F.col("doc")))
    sums = rows.groupBy("path").agg(F.sum(documented).alias("documented"), F.sum(signature).alias("signature"), F.sum(name).alias("name")).join(budgets, "path")
    detail = F.when(F.col("documented") <= F.col("budget"), "documented").when(F.col("signature") <= F.col("budget"), "signature").otherwise("name")
    used = F.when(detail == "documented", F.col("documented")).when(detail == "signature", F.col("signature")).otherwise(F.col("name"))
    return sums.select("path", detail.alias("detail"), used.alias("tokens"), (used <= F.col("budget")).alias("fits"))


def file_map(scores: DataFrame, files: DataFrame, budget: int, most: int = 400) -> DataFrame:
    """A map of a repository: files by score, three offers each (path, with counts, with names), packed under the budget.

    scores: (path, relevance); files: (file_id, path, symbol_count, names array).
    """
    top = files.join(scores, "path").orderBy(F.round("relevance", 9).desc(), "path").limit(most)
    cost = token_estimate(F.col("path"))
    offer = lambda level, tokens, utility: F.struct(F.lit(level).alias("level"), tokens.cast("int").alias("tokens"), F.lit(utility).alias("utility"))
    offers = F.array(offer(0, cost + 1, 1.0), offer(1, cost + 6, 2.2), offer(2, cost + 6 + token_estimate(F.array_join("names", ", ")), 3.6))
    rows = top.select(F.lit(0).alias("query_id"), F.col("file_id").alias("id"), "relevance", F.explode(offers).alias("o")).select("query_id", "id", "relevance", "o.*")
    return pack_batch(rows, rows.sparkSession.createDataFrame([(0, budget)], "query_id int, budget int"))


def resolve_symbol(symbols: DataFrame, asked: DataFrame) -> DataFrame:
    """What a name means: (query_id, id, verdict) with verdict found, ambiguous or unknown.

    asked: (query_id, name), where name is #id, a (qualified) name, or path:name. Several matches are ambiguous
    unless exactly one has the qualified name; an ambiguous name gives one row per match.
    """
    by_id = asked.filter(F.col("name").rlike(r"^#\d+$")).select("query_id", F.substring("name", 2, 20).cast("bigint").alias("id"))
    hit_id = by_id.join(symbols.select("id"), "id").select("query_id", "id", F.lit(True).alias("exact"))
    named = asked.filter(~F.col("name").rlike(r"^#\d+$"))
    at_path = named.filter(F.col("name").rlike("^[^:]+:[^:]+$")).select("query_id", F.split_part("name", F.lit(":"), F.lit(1)).alias("path"), F.split_part("name", F.lit(":"), F.lit(2)).alias("want"))
    hit_path = at_path.join(symbols, ["path"]).filter((F.col("want") == F.col("name")) | (F.col("want") == F.col("qualified_name"))).select("query_id", "id", (F.col("want") == F.col("qualified_name")).alias("exact"))
    plain = named.filter(~F.col("name").rlike("^[^:]+:[^:]+$")).select("query_id", F.col("name").alias("want"))
    by_name = plain.join(symbols.select("id", "name", "qualified_name"), F.lower("want") == F.lower("name")).select("query_id", "id", (F.col("want") == F.col("qualified_name")).alias("exact"))
    by_qname = plain.join(symbols.select("id", "qualified_name"), F.col("want") == F.col("qualified_name")).select("query_id", "id", F.lit(True).alias("exact"))
    hits = hit_id.unionByName(hit_path).unionByName(by_name).unionByName(by_qname).groupBy("query_id", "id").agg(F.max("exact").alias("exact"))
    w = Window.partitionBy("query_id")
    told = hits.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("e", F.sum(F.col("exact").cast("int")).over(w))
    kept = told.filter((F.col("n") == 1) | (F.col("e") != 1) | F.col("exact")).withColumn("verdict", F.when((F.col("n") == 1) | (F.col("e") == 1), "found").otherwise("ambiguous")).select("query_id", "id", "verdict")
    missing = asked.select("query_id").join(hits, "query_id", "left_anti").select("query_id", F.lit(None).cast("bigint").alias("id"), F.lit("unknown").alias("verdict"))
    return kept.unionByName(missing)


def doc_gaps(symbols: DataFrame, degree: DataFrame, limit: int) -> DataFrame:
    """Public symbols without documentation, the most referenced first: (id, path, degree)."""
    from symvane.functions.text import blank

    bare = symbols.filter(blank(F.col("doc")) & (F.col("visibility") == "public")).join(degree, "id", "left").na.fill(0, ["degree"])
    return bare.orderBy(F.col("degree").desc(), "path", "start_line", "id").limit(limit).select("id", "path", "degree")


def known_item_tasks(symbols: DataFrame, most: int, seed: int, budget: int) -> DataFrame:
    """Tasks of a benchmark: questions from descriptions and names of a seeded sample of symbols: (query_id, text, budget, wanted)."""
    from symvane.operators.search import known_item_words

    told = symbols.filter(F.length(F.trim(F.coalesce("doc", F.lit("")))) > 0)
    picked = told.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most)
    words = known_item_words(first_sentence(F.col("doc")), F.col("name"))
    by_doc = picked.select((F.col("id") * 2).alias("query_id"), F.array_join(words, " ").alias("text"), F.col("id").alias("wanted"))
    by_name = picked.select((F.col("id") * 2 + 1).alias("query_id"), F.array_join(F.transform(word_parts(F.col("name")), fold), " ").alias("text"), F.col("id").alias("wanted"))
    return by_doc.unionByName(by_name).filter("text <> ''").withColumn("budget", F.lit(budget))


def baseline_arm(tasks: DataFrame, files: DataFrame, placed: DataFrame, k: int = 3) -> DataFrame:
    """What reading whole files costs: per task the tokens of the `k` files with most distinct words of the query, and whether the wanted symbol's is one.

    files: (path, text); placed: (id, path). Returns (query_id, base_tokens, base_hit).
    """
    words = tasks.select("query_id", F.explode(F.array_distinct(F.transform(word_parts(F.col("text")), fold))).alias("term"))
    posts = postings(files, "path", {"text": 1.0})
    read = baseline(posts, words, k).select("query_id", F.col("doc").alias("path")).join(files.select("path", token_estimate(F.col("text")).alias("tokens")), "path")
    wanted = tasks.select("query_id", F.col("wanted").alias("id")).join(placed.select("id", F.col("path").alias("wanted_path")), "id")
    return read.join(wanted.select("query_id", "wanted_path"), "query_id").groupBy("query_id").agg(F.sum("tokens").alias("base_tokens"), F.max((F.col("path") == F.col("wanted_path")).cast("int")).alias("base_hit"))


def bench(tables: Tables, tasks: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Hit rate, mean tokens and percentiles of recall over tasks, by family of questions and budget; with `base` (of `baseline_arm`) also its rates and the share saved."""
    got = recall(tables, tasks.select("query_id", "text", "budget"))
    used = got.groupBy("query_id").agg(F.sum("tokens").alias("used"))
    hit = got.join(tasks.select("query_id", F.col("wanted").alias("id")), ["query_id", "id"], "left_semi").select("query_id", F.lit(1).alias("hit"))
    rows = tasks.join(used, "query_id", "left").join(hit, "query_id", "left")
    more = []
    if base is not None:
        rows = rows.join(base, "query_id", "left").na.fill(0, ["base_tokens", "base_hit"])
        spent = F.sum("base_tokens")
        more = [F.round(F.avg("base_hit"), 4).alias("base_hit_rate"), F.round(F.avg("base_tokens"), 4).alias("base_tokens"), F.when(spent > 0, F.round((spent - F.sum("used")) / spent, 4)).alias("saved")]
    rows = rows.na.fill(0, ["used", "hit"])
    family = F.when(F.col("query_id") % 2 == 0, "description").otherwise("name")
    return rows.groupBy(family.alias("family"), "budget").agg(F.count(F.lit(1)).alias("tasks"), F.round(F.avg("hit"), 4).alias("hit_rate"), F.round(F.avg("used"), 4).alias("mean_tokens"), sc.nearest_rank("used", 50).cast("int").alias("p50"), sc.nearest_rank("used", 95).cast("int").alias("p95"), *more)


def brief(sections: dict[str, DataFrame], budget: int, keep: tuple[str, ...] = ("central", "modules", "known"), least: int = 2) -> dict[str, list]:
    """Rows of a short report under a budget: sections (id, text, ...) give up rows from the last of `keep` on, none below `least`.

    Reads at most `budget` rows of each section, which could never fit more.
    """
    rows = {k: [tuple(r) for r in df.select("id", "text", token_estimate(F.col("text")).alias("tokens")).limit(budget).collect()] for k, df in sections.items()}
    cost = lambda: sum(r[2] for rs in rows.values() for r in rs)
    for name in reversed(keep):
        while name in rows and len(rows[name]) > least and cost() > budget:
            rows[name].pop()
    return rows
