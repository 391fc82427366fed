"""Operators on the edge table: degrees, neighbours, modules, impact, subgraphs, PageRank, exports."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symvane.functions.text import is_test_path, region
from symvane.runtime import cut
from symvane.schemas import GUESS, HEURISTIC, RESOLVED


def in_degrees(edges: DataFrame, least: int = HEURISTIC) -> DataFrame:
    """(id, degree): distinct incoming edges of at least a confidence; symbols without any are left out."""
    return edges.filter(F.col("confidence") >= least).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def central(edges: DataFrame, k: int, least: int = HEURISTIC) -> DataFrame:
    """The k symbols with most incoming edges, ties by id."""
    return in_degrees(edges, least).orderBy(F.col("degree").desc(), "id").limit(k)


def out_degrees(edges: DataFrame, cap: int = 512) -> DataFrame:
    """(id, degree): outgoing edges, counted up to `cap` as the report shows them."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("degree"))


def neighbors(edges: DataFrame, seeds: DataFrame, symbols: DataFrame, limit: int, least: int = GUESS) -> DataFrame:
    """Per seed (column seed) and direction the first `limit` neighbours: confidence, path, line, start line, id, kind."""
    e = edges.filter(F.col("confidence") >= least)
    out = e.select(F.col("src").alias("seed"), F.lit("out").alias("direction"), F.col("dst").alias("id"), "kind", "confidence", "line")
    into = e.select(F.col("dst").alias("seed"), F.lit("in").alias("direction"), F.col("src").alias("id"), "kind", "confidence", "line")
    near = out.unionByName(into).join(seeds, "seed", "left_semi").join(symbols.select("id", "path", "start_line"), "id")
    order = Window.partitionBy("seed", "direction").orderBy(F.col("confidence").desc(), "path", "line", "start_line", "id", "kind")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def modules(files: DataFrame, depth: int) -> DataFrame:
    """(file id, module): the first `depth` directories of its path, '.' at the root or for depth 0."""
    return files.withColumn("module", region(F.col("path"), depth) if depth > 0 else F.lit("."))


def module_pairs(edges: DataFrame, placed: DataFrame, least: int = HEURISTIC) -> DataFrame:
    """Edges between different modules: (from_module, to_module, weight). `placed` has (id, module)."""
    a = placed.select(F.col("id").alias("src"), F.col("module").alias("from_module"))
    b = placed.select(F.col("id").alias("dst"), F.col("module").alias("to_module"))
    across = edges.filter(F.col("confidence") >= least).join(a, "src").join(b, "dst").filter("from_module <> to_module")
    return across.groupBy("from_module", "to_module").agg(F.count(F.lit(1)).alias("weight"))


def module_stats(edges: DataFrame, placed: DataFrame, least: int = HEURISTIC) -> DataFrame:
    """Per module its symbols and edges from and to other modules."""
    pairs = module_pairs(edges, placed, least)
    into = pairs.groupBy(F.col("to_module").alias("module")).agg(F.sum("weight").alias("incoming"))
    out = pairs.groupBy(F.col("from_module").alias("module")).agg(F.sum("weight").alias("outgoing"))
    count = placed.groupBy("module").agg(F.count(F.lit(1)).alias("symbols"))
    return count.join(into, "module", "left").join(out, "module", "left").na.fill(0, ["incoming", "outgoing"])


def impact(edges: DataFrame, roots: DataFrame, depth: int = 2, least: int = HEURISTIC) -> DataFrame:
    """Callers of every root (column root), directly or through others: (root, id, depth, confidence).

    Breadth first over incoming edges, depth 1 to 5. Each symbol comes once per root, at its shortest distance;
    its confidence is the lowest along any shortest way to it. The root itself is left out.
    """
    back = edges.filter(F.col("confidence") >= least).groupBy(F.col("dst").alias("at"), F.col("src").alias("id")).agg(F.max("confidence").alias("c"))
    front = roots.select("root").distinct().select("root", F.col("root").alias("id"), F.lit(0).alias("depth"), F.lit(RESOLVED + 1).alias("confidence"))
    seen = front
    for level in range(1, max(1, min(depth, 5)) + 1):
        step = front.select("root", F.col("id").alias("at"), "confidence").join(back, "at")
        found = step.groupBy("root", "id").agg(F.min(F.least("confidence", "c")).alias("confidence")).withColumn("depth", F.lit(level))
        front = found.join(seen.select("root", "id"), ["root", "id"], "left_anti").select("root", "id", "depth", "confidence")
        if level % 2 == 0:
            front = cut(front)
        seen = seen.unionByName(front)
    return seen.filter("depth > 0")


#: Deepest walk, callers listed unless told otherwise, and most callers read of one symbol in a step.
MOST_DEPTH, CALLERS, FAN_OUT = 5, 50, 500
#: Alternatives of the same name that are looked up, and offered.
LOOKED_UP, OFFERED = 16, 5


def walk_callers(edges: DataFrame, roots: DataFrame, symbols: DataFrame, depth: int = 2, least: int = HEURISTIC, limit: int = CALLERS) -> tuple[DataFrame, DataFrame]:
    """Callers of every root as a report lists them, at most `limit` each, and what is known of the walk.

    (root, id, depth, confidence, kind, line) and (root, structural, truncated). The walk is breadth first; a symbol's
    callers come by certainty, path, line, start line, id and kind, at most min(limit + 1, FAN_OUT) of them. Each symbol
    keeps its first place and the weakest confidence of all ways seen; the walk of a root ends with the first caller
    beyond the limit. Work is bounded by roots, limit and fan-out, however many callers a hub has.
    """
    roots = roots.select("root").distinct()
    if limit <= 0:
        none = edges.select(F.col("src").alias("root"), F.col("src").alias("id"), F.lit(0).alias("depth"), "confidence", "kind", "line").limit(0)
        return none, roots.select("root", F.lit(True).alias("structural"), F.lit(True).alias("truncated"))
    fan = min(limit + 1, FAN_OUT)
    placed = symbols.select("id", "path", "start_line")
    back = edges.filter(F.col("confidence") >= least).select(F.col("dst").alias("at"), F.col("src").alias("id"), "kind", "confidence", "line").join(placed, "id")
    order = Window.partitionBy("at").orderBy(F.col("confidence").desc(), "path", "line", "start_line", "id", "kind")
    near = cut(back.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= fan).select("at", "id", "kind", "confidence", "line", "place"))
    front = roots.select("root", F.col("root").alias("at"), F.lit(RESOLVED + 1).alias("reached"), F.lit(0).alias("rank"))
    found, ways, stops = None, None, None
    for level in range(1, max(1, min(depth, MOST_DEPTH)) + 1):
        met = front.join(near, "at").select("root", "id", "kind", "line", "confidence", F.least("reached", "confidence").alias("got"), F.struct("rank", "place").alias("pos"))
        fresh = met.filter("id <> root").groupBy("root", "id").agg(F.min(F.struct("pos", "got", "kind", "line")).alias("f"))
        before = F.lit(0)
        if found is not None:
            fresh = fresh.join(found.select("root", "id"), ["root", "id"], "left_anti").join(found.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root", "left")
            before = F.coalesce("n", F.lit(0))
        ranked = fresh.withColumn("rank", (before + F.row_number().over(Window.partitionBy("root").orderBy("f.pos"))).cast("int"))
        new = cut(ranked.select("root", "id", "rank", "f", F.lit(level).alias("depth")).filter(F.col("rank") <= limit + 1))
        stop = new.filter(F.col("rank") > limit).select("root", F.col("f.pos").alias("stop"))
        seen = met.join(stop, "root", "left").filter(F.col("stop").isNull() | (F.col("pos") < F.col("stop"))).select("root", "id", "got", "confidence")
        kept = new.filter(F.col("rank") <= limit)
        found = kept if found is None else found.unionByName(kept)
        ways = seen if ways is None else ways.unionByName(seen)
        stops = stop.select("root") if stops is None else stops.unionByName(stop.select("root"))
        front = kept.join(stop, "root", "left_anti").select("root", F.col("id").alias("at"), F.col("f.got").alias("reached"), "rank")
    weakest = ways.groupBy("root", "id").agg(F.min("got").alias("confidence"))
    callers = found.join(weakest, ["root", "id"]).select("root", "id", "depth", "confidence", "f.kind", "f.line")
    sure = ways.groupBy("root").agg((F.min("confidence") >= RESOLVED).alias("structural"))
    flags = roots.join(sure, "root", "left").join(stops.distinct().withColumn("truncated", F.lit(True)), "root", "left")
    return callers, flags.select("root", F.coalesce("structural", F.lit(True)).alias("structural"), F.coalesce("truncated", F.lit(False)).alias("truncated"))


def verdict_of(callers: Column, structural: Column, truncated: Column, visibility: Column) -> Column:
    """unknown, exact or lower-bound: what a list of callers is worth."""
    open_to_all = visibility.isin("public", "unknown")
    return F.when((callers == 0) & open_to_all, "unknown").when(structural & ~truncated & (visibility == "private"), "exact").otherwise("lower-bound")


def verdict(callers: DataFrame, flags: DataFrame, roots: DataFrame) -> DataFrame:
    """Per root (root, visibility) the number of its callers and their worth, from the frames of `walk_callers`."""
    seen = callers.groupBy("root").agg(F.count(F.lit(1)).alias("callers"))
    rows = roots.join(flags, "root").join(seen, "root", "left").na.fill(0, ["callers"])
    return rows.select("root", "callers", verdict_of(F.col("callers"), F.col("structural"), F.col("truncated"), F.col("visibility")).alias("verdict"))


def impact_lists(callers: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per root the sorted files of its callers and those among them that are tests; a walk lists a bounded number of callers."""
    placed = callers.join(symbols.select("id", "path"), "id").select("root", "path").distinct()
    return placed.groupBy("root").agg(F.sort_array(F.collect_list("path")).alias("files"), F.sort_array(F.collect_list(F.when(is_test_path(F.col("path")), F.col("path")))).alias("tests"))


def alternatives(roots: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per root (column root) up to five other symbols of its name, in any case, exact ones first: `id path qualified_name` each."""
    own = roots.select("root").join(symbols.select(F.col("id").alias("root"), F.col("name").alias("asked")), "root")
    # a name's own first symbols, one list per spelling asked for: a common name is looked up once, not once per root
    asked = own.select("asked").distinct()
    named = symbols.select("id", "path", "start_line", "qualified_name", "name", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("qualified_name")))).alias("key"))
    hits = asked.withColumn("key", F.lower("asked")).join(named, "key")
    order = Window.partitionBy("asked").orderBy(((F.col("name") == F.col("asked")) | (F.col("qualified_name") == F.col("asked"))).desc(), "path", "start_line", "id")
    first = hits.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= LOOKED_UP)
    listed = first.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("k", "id", F.concat_ws(" ", "id", "path", "qualified_name").alias("told")))).alias("all"))
    others = F.slice(F.filter("all", lambda x: x["id"] != F.col("root")), 1, OFFERED)
    return own.join(listed, "asked", "left").select("root", F.coalesce(F.transform(others, lambda x: x["told"]), F.array().cast("array<string>")).alias("alternatives"))


def impact_report(edges: DataFrame, roots: DataFrame, symbols: DataFrame, depth: int = 2, least: int = HEURISTIC, limit: int = CALLERS) -> DataFrame:
    """One row per root: callers, direct, truncated, verdict, files, tests, alternatives and the commands to go on with."""
    depth, roots = max(1, min(depth, MOST_DEPTH)), roots.select("root").distinct()
    callers, flags = walk_callers(edges, roots, symbols, depth, least, limit)
    callers = cut(callers)
    placed = callers.join(symbols.select("id", "path", "start_line", "name"), "id")
    top = placed.groupBy("root").agg(
        F.count(F.lit(1)).alias("callers"), F.count_if(F.col("depth") == 1).alias("direct"), F.min_by("id", F.struct("depth", -F.col("confidence"), "path", "line", "name", "id")).alias("first"))
    own = symbols.select(F.col("id").alias("root"), "qualified_name", "visibility")
    rows = flags.join(own, "root").join(top, "root", "left").join(impact_lists(callers, symbols), "root", "left").join(alternatives(roots, symbols), "root", "left").na.fill(0, ["callers", "direct"])
    none = F.array().cast("array<string>")
    more = F.when(F.col("truncated"), F.concat(F.lit("impact "), F.col("root").cast("string"), F.lit(f" --limit {max(2 * limit, 2)}"))).when((F.col("callers") > 0) & F.lit(depth < MOST_DEPTH), F.concat(F.lit("impact "), F.col("root").cast("string"), F.lit(f" --depth {depth + 1}")))
    following = F.array_compact(F.array(F.concat(F.lit("expand "), F.coalesce("first", "root").cast("string")), more, F.concat(F.lit('recall "'), F.col("qualified_name"), F.lit('"'))))
    worth = verdict_of(F.col("callers"), F.col("structural"), F.col("truncated"), F.col("visibility"))
    return rows.select("root", "callers", "direct", "truncated", worth.alias("verdict"), F.coalesce("files", none).alias("files"), F.coalesce("tests", none).alias("tests"), "alternatives", following.alias("next"))


def around(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Symbols within `depth` edges of the seeds (column id), either way: (id, depth)."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    front = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    seen = front
    for level in range(1, depth + 1):
        nxt = both.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        front = cut(nxt.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(level)))
        seen = seen.unionByName(front)
    return seen


def among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes (column id)."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def _weight(edges: DataFrame) -> Column:
    return F.col("weight") if "weight" in edges.columns else F.lit(1)


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst, kind): its summed weight (1 each where none is given), at least 1, and best confidence; no loops."""
    return edges.filter("src <> dst").groupBy("src", "dst", "kind").agg(F.greatest(F.sum(_weight(edges)), F.lit(1)).cast("bigint").alias("weight"), F.max("confidence").alias("confidence"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of edges at each node, at least 1."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id")))
    counted = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("id").join(counted, "id", "left").select("id", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("degree"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-6, every: int = 5) -> DataFrame:
    """(id, score): PageRank of nodes with an edge, scaled so that the highest is 1.

    Every row of `edges` counts, loops too. Nodes without outgoing edges share their rank among all. Stops after
    `rounds` rounds or when the sum of changes falls below `tolerance` (looked at when lineage is cut).
    """
    links = cut(edges.select("src", "dst"))
    out = links.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    nodes = cut(links.select(F.col("src").alias("id")).union(links.select(F.col("dst").alias("id"))).distinct().join(out.withColumnRenamed("src", "id"), "id", "left").na.fill(0, ["out"]))
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("score"))
    flows = links.repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
    rank = nodes.withColumn("r", F.lit(1.0 / n))
    loose_ends = bool(nodes.filter("out = 0").take(1))
    every = 1 if loose_ends else every  # the loose rank reads a round's ranks a second time
    for k in range(1, rounds + 1):
        before = rank
        given = flows.join(before.filter("out > 0").select(F.col("id").alias("src"), (F.col("r") / F.col("out")).alias("part")), "src")
        got = given.groupBy(F.col("dst").alias("id")).agg(F.sum("part").alias("got"))
        rank = nodes.join(got, "id", "left")
        share = F.lit(0.0)
        if loose_ends:
            rank = rank.join(F.broadcast(before.agg(F.coalesce(F.sum(F.when(F.col("out") == 0, F.col("r"))), F.lit(0.0)).alias("loose"))), F.lit(True))  # a single row
            share = F.col("loose") / n
        rank = rank.select("id", "out", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + share)).alias("r"))
        if k % every == 0 or k == rounds:
            rank = cut(rank)
            if tolerance and k > 1:
                was = before.select("id", F.col("r").alias("was"))
                if rank.join(was, "id").agg(F.sum(F.abs(F.col("r") - F.col("was")))).first()[0] < tolerance:
                    break
    flows.unpersist()
    most = rank.agg(F.max("r").alias("most"))
    return rank.join(F.broadcast(most), F.lit(True)).select("id", (F.col("r") / F.col("most")).alias("score"))


def refresh_due(first: bool, forced: bool, rewritten: int, most: int = 50) -> bool:
    """Whether PageRank is computed again after an index run: the first time, on request, or after many new edges."""
    return first or forced or rewritten > most


def export_graph(nodes: DataFrame, edges: DataFrame, most_nodes: int, most_edges: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a drawing. nodes: (id, weight); edges: (src, dst, kind, confidence, ord).

    Edges of one pair merge whatever their kind: weights (of a column weight, at least 1 each) add up, the label comes from the first
    certain edge, else the first. The heaviest nodes by (weight, weighted degree, id) stay, then the heaviest edges.
    """
    real = edges.filter("src <> dst")
    merged = real.groupBy("src", "dst").agg(
        F.sum(F.greatest(_weight(edges), F.lit(1))).cast("bigint").alias("weight"), F.min_by("kind", F.struct((F.col("confidence") < RESOLVED).alias("unsure"), "ord")).alias("label"), F.max("confidence").alias("confidence"), F.min("ord").alias("ord"))
    both = merged.select(F.col("src").alias("id"), "weight").union(merged.select(F.col("dst").alias("id"), "weight")).groupBy("id").agg(F.sum("weight").alias("degree"))
    kept = nodes.join(both, "id", "left").na.fill(0, ["degree"]).orderBy(F.col("weight").desc(), F.col("degree").desc(), "id").limit(most_nodes)
    return kept, among(merged, kept).orderBy(F.col("weight").desc(), "ord", "src", "dst").limit(most_edges)


def as_lines(edges: DataFrame, form: str, label: str = "label") -> DataFrame:
    """Edges as lines of a drawing language (mermaid or dot) or of JSON, one row each (src, dst, line)."""
    if form == "mermaid":
        line = F.format_string("  n%d -->|%s| n%d", "src", label, "dst")
    elif form == "dot":
        line = F.format_string('  n%d -> n%d [label="%s"];', "src", "dst", label)
    elif form == "json":
        line = F.to_json(F.struct("src", "dst", F.col(label).alias("label"), "weight", "confidence"))
    else:
        raise ValueError(f"no such form: {form}")
    return edges.select("src", "dst", line.alias("line"))


def brain(nodes: DataFrame, edges: DataFrame, most_nodes: int = 6000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Columns of the drawing of a whole repository: nodes, edges and regions by number.

    nodes: (id, path, visibility). The most central nodes come first, then public ones, then by path; nodes are
    numbered in that order and regions (two directories) by name.
    """
    ranked = nodes.join(in_degrees(edges, GUESS), "id", "left").na.fill(0, ["degree"])
    tier = F.when(F.col("degree") > 0, 0).when(F.col("visibility") == "public", 1).otherwise(2)
    kept = ranked.withColumn("tier", tier).orderBy("tier", F.col("degree").desc(), "path", "id").limit(most_nodes)
    kept = kept.withColumn("region", region(F.col("path"), 2)).withColumn("n", F.row_number().over(Window.orderBy("tier", F.col("degree").desc(), "path", "id")) - 1)
    regions = kept.select("region").distinct().withColumn("region_n", F.row_number().over(Window.orderBy("region")) - 1)
    numbered = kept.join(F.broadcast(regions), "region").select("n", "id", "region_n", "degree")
    ends = numbered.select("id", "n")
    lines = edges.select("src", "dst", "kind").distinct().join(ends.select(F.col("id").alias("src"), F.col("n").alias("from_n")), "src").join(ends.select(F.col("id").alias("dst"), F.col("n").alias("to_n")), "dst").select("from_n", "to_n", "kind")
    return numbered, lines, regions
