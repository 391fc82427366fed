"""Queries on graphs (A4, A11, A12, A17, A18, A20, J10-J12, G1-G12, K4, W2, O6) over the graph of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symvane import views
from symvane.operators import graph as g
from symvane.operators.hierarchy import hierarchy
from symvane.runtime import cut, table


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return g.modules(views.parts(spark, d), 2).select("id", "module")


def central_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The twenty parts that most often come next."""
    return g.central(views.part_edges(spark, d), 20)


def a11_out_degrees(spark: SparkSession, d: str) -> DataFrame:
    return g.out_degrees(views.part_edges(spark, d), 24)


def a12_file_scores(spark: SparkSession, d: str) -> DataFrame:
    """Per file 1 plus the degrees of its symbols among the thousand most central, and its relevance."""
    top = g.central(views.part_edges(spark, d), 1000)
    files = views.parts(spark, d).select("id", F.col("family").alias("path")).join(top, "id", "left").groupBy("path").agg((1 + F.coalesce(F.sum("degree"), F.lit(0))).alias("score"))
    return files.select("path", "score", F.round(1 + F.log("score"), 6).alias("relevance"))


def a17_merged_edges(spark: SparkSession, d: str) -> DataFrame:
    return g.merge_edges(views.part_edges(spark, d))


def a18_degrees(spark: SparkSession, d: str) -> DataFrame:
    return g.degrees(views.part_edges(spark, d).filter("src <> dst"), views.parts(spark, d))


def a20_export_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = views.part_edges(spark, d).withColumn("ord", F.col("src") * 1_000_000 + F.col("dst"))
    nodes = views.parts(spark, d).select("id", F.col("start_line").alias("weight"))
    return g.export_graph(nodes, edges, 60, 240)[1].select("src", "dst", "weight", "label", "confidence")


def k4_mermaid(spark: SparkSession, d: str) -> DataFrame:
    edges = views.part_edges(spark, d).filter("src <> dst").withColumn("ord", F.col("src") * 1_000_000 + F.col("dst"))
    nodes = views.parts(spark, d).select("id", F.col("start_line").alias("weight"))
    return g.as_lines(g.export_graph(nodes, edges, 60, 240)[1], "mermaid")


def k4_dot(spark: SparkSession, d: str) -> DataFrame:
    edges = views.part_edges(spark, d).filter("src <> dst").withColumn("ord", F.col("src") * 1_000_000 + F.col("dst"))
    nodes = views.parts(spark, d).select("id", F.col("start_line").alias("weight"))
    return g.as_lines(g.export_graph(nodes, edges, 60, 240)[1], "dot")


def k4_json(spark: SparkSession, d: str) -> DataFrame:
    edges = views.part_edges(spark, d).filter("src <> dst").withColumn("ord", F.col("src") * 1_000_000 + F.col("dst"))
    nodes = views.parts(spark, d).select("id", F.col("start_line").alias("weight"))
    return g.as_lines(g.export_graph(nodes, edges, 60, 240)[1], "json")


def g1_modules(spark: SparkSession, d: str) -> DataFrame:
    """Modules of the stored files at two depths."""
    files = views.files(spark, d).select("file_id", "path")
    return g.modules(files, 1).select("file_id", F.lit(1).alias("depth"), "module").unionByName(g.modules(files, 3).select("file_id", F.lit(3).alias("depth"), "module"))


def g2_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Six neighbours each way of every part."""
    seeds = views.parts(spark, d).select(F.col("id").alias("seed"))
    return g.neighbors(views.part_edges(spark, d), seeds, views.parts(spark, d), 6, 1).select("seed", "direction", "id", "kind", "confidence", "line", "rank")


def a6_module_stats(spark: SparkSession, d: str) -> DataFrame:
    return g.module_stats(views.part_edges(spark, d), _placed(spark, d))


def a7_module_pairs(spark: SparkSession, d: str) -> DataFrame:
    return g.module_pairs(views.part_edges(spark, d), _placed(spark, d))


def g7_module_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges among the forty modules with most edges, at most eight each."""
    edges, placed = views.part_edges(spark, d), _placed(spark, d)
    top = g.module_stats(edges, placed).orderBy((F.col("incoming") + F.col("outgoing")).desc(), "module").limit(40).select("module")
    pairs = g.module_pairs(edges, placed)
    kept = pairs.join(top.withColumnRenamed("module", "from_module"), "from_module", "left_semi").join(top.withColumnRenamed("module", "to_module"), "to_module", "left_semi")
    return kept.orderBy(F.col("weight").desc(), "from_module", "to_module").limit(320)


def _callers(spark: SparkSession, d: str) -> DataFrame:
    roots = g.central(views.part_edges(spark, d), 5).select(F.col("id").alias("root"))
    return g.impact(views.part_edges(spark, d).filter("src <> dst"), roots, 2, 2)


def g3_impact(spark: SparkSession, d: str) -> DataFrame:
    """Callers of the five most central parts, two steps back over certain edges."""
    return _callers(spark, d)


def g4_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What the list of at most twelve callers of every part is worth."""
    roots = views.parts(spark, d).select(F.col("id").alias("root"), "visibility")
    callers, flags = g.walk_callers(views.part_edges(spark, d), roots, views.parts(spark, d), 1, 1, 12)
    return g.verdict(callers, flags, roots)


def g3_limited(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty callers of every symbol over resolved references, two steps back."""
    symbols = views.symbols(spark, d, "file_id", "start_line").join(views.files(spark, d).select("file_id", "path"), "file_id")
    return g.walk_callers(cut(views.edges(spark, d)), symbols.select(F.col("id").alias("root")), symbols, 2, 0)[0]


def g5_reports(spark: SparkSession, d: str) -> DataFrame:
    """The report on every symbol that is referenced: callers, worth, files, tests, alternatives, next steps."""
    symbols = views.symbols(spark, d, "file_id", "start_line", "name", "qualified_name", "visibility").join(views.files(spark, d).select("file_id", "path"), "file_id")
    edges = cut(views.edges(spark, d))
    rows = g.impact_report(edges, edges.select(F.col("dst").alias("root")), symbols, 1, 0)
    return rows.select("root", "callers", "direct", "truncated", "verdict", *[F.array_join(c, ";").alias(c) for c in ("files", "tests", "alternatives", "next")])


def g5_impact_files(spark: SparkSession, d: str) -> DataFrame:
    lists = g.impact_lists(_callers(spark, d), views.parts(spark, d))
    return lists.select("root", F.size("files").alias("files"), F.size("tests").alias("tests"), F.element_at("files", 1).alias("first"))


def g6_around(spark: SparkSession, d: str) -> DataFrame:
    """Parts within two certain edges of the most central one."""
    edges = views.part_edges(spark, d).filter("confidence >= 2")
    return g.around(edges, g.central(views.part_edges(spark, d), 1), 2)


def g6_among(spark: SparkSession, d: str) -> DataFrame:
    return g.among(views.part_edges(spark, d), g.central(views.part_edges(spark, d), 60)).select("src", "dst", "kind", "confidence")


def g8_pagerank(spark: SparkSession, d: str) -> DataFrame:
    """PageRank of parts, ten rounds."""
    return g.pagerank(views.part_edges(spark, d), rounds=10, tolerance=0).select("id", F.round("score", 6).alias("score"))


def g8_pagerank_refs(spark: SparkSession, d: str) -> DataFrame:
    """PageRank over resolved references, ten rounds."""
    return g.pagerank(views.edges(spark, d), rounds=10, tolerance=0).select("id", F.round("score", 6).alias("score"))


def g11_brain_nodes(spark: SparkSession, d: str) -> DataFrame:
    return g.brain(views.parts(spark, d), views.part_edges(spark, d))[0]


def g11_brain_edges(spark: SparkSession, d: str) -> DataFrame:
    return g.brain(views.parts(spark, d), views.part_edges(spark, d))[1]


def g12_nesting(spark: SparkSession, d: str) -> DataFrame:
    """Nesting depth of symbols, counted up to 32."""
    placed = hierarchy(table(spark, d, "symbols"), "id", "parent_id", "name", locality="file_id").filter("state = 'rooted'")
    return placed.select("id", F.least("depth", F.lit(32)).alias("depth"))


QUERIES = {f.__name__: f for f in (central_symbols, a6_module_stats, a7_module_pairs, a11_out_degrees, a12_file_scores, a17_merged_edges, a18_degrees, a20_export_edges, k4_mermaid, k4_dot, k4_json, g1_modules, g2_neighbors, g3_impact, g3_limited, g4_verdicts, g5_impact_files, g5_reports, g6_around, g6_among, g7_module_graph, g8_pagerank, g8_pagerank_refs, g11_brain_nodes, g11_brain_edges, g12_nesting)}

#: The graph of parts.
PARTS = """
WITH steps AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst, l_linestatus AS kind,
  CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS confidence, l_linenumber AS line FROM lineitem),
e AS (SELECT src, dst, kind, CAST(max(confidence) AS INT) AS confidence, min(line) AS line FROM steps WHERE dst IS NOT NULL GROUP BY ALL),
p AS (SELECT p_partkey AS id, p_name AS name, p_type AS family, p_type || '/' || p_brand || '/' || p_name AS path, p_size AS start_line, CASE WHEN p_retailprice > 1500 THEN 'private' ELSE 'public' END AS visibility, p_type || '/' || p_brand AS module FROM part),
deg AS (SELECT dst AS id, count(*) AS degree FROM e WHERE confidence >= 1 GROUP BY 1),
pairs AS (SELECT a.module AS from_module, b.module AS to_module, count(*) AS weight FROM e JOIN p a ON a.id = src JOIN p b ON b.id = dst WHERE confidence >= 1 AND a.module <> b.module GROUP BY 1, 2),
stats AS (SELECT m.module, m.symbols, coalesce(i.w, 0) AS incoming, coalesce(o.w, 0) AS outgoing FROM (SELECT module, count(*) AS symbols FROM p GROUP BY 1) m
  LEFT JOIN (SELECT to_module, sum(weight)::BIGINT AS w FROM pairs GROUP BY 1) i ON i.to_module = m.module LEFT JOIN (SELECT from_module, sum(weight)::BIGINT AS w FROM pairs GROUP BY 1) o ON o.from_module = m.module),
merged AS (SELECT src, dst, count(*) AS weight, arg_min(kind, (confidence < 2)::INT * 1e15 + src * 1000000 + dst + CASE WHEN kind = 'F' THEN 0.1 ELSE 0.2 END) AS label, max(confidence) AS confidence FROM e WHERE src <> dst GROUP BY 1, 2),
md AS (SELECT id, sum(weight) AS degree FROM (SELECT src AS id, weight FROM merged UNION ALL SELECT dst, weight FROM merged) GROUP BY 1),
kept AS (SELECT p.id FROM p LEFT JOIN md ON md.id = p.id ORDER BY start_line DESC, coalesce(degree, 0) DESC, p.id LIMIT 60),
drawn AS (SELECT * FROM merged WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept) ORDER BY weight DESC, src, dst LIMIT 240),
roots AS (SELECT id AS root FROM deg ORDER BY degree DESC, id LIMIT 5),
back AS (SELECT dst AS at, src AS id, max(confidence) AS c FROM e WHERE confidence >= 2 AND src <> dst GROUP BY 1, 2),
i1 AS (SELECT root, b.id, min(c) AS confidence FROM roots JOIN back b ON b.at = root WHERE b.id <> root GROUP BY 1, 2),
i2 AS (SELECT root, b.id, min(least(confidence, c)) AS confidence FROM i1 JOIN back b ON b.at = i1.id WHERE b.id <> root AND NOT EXISTS (SELECT 1 FROM i1 x WHERE x.root = i1.root AND x.id = b.id) GROUP BY 1, 2),
callers AS (SELECT root, id, 1 AS depth, confidence FROM i1 UNION ALL SELECT root, id, 2, confidence FROM i2),
bd AS (SELECT dst AS id, count(*) AS degree FROM e GROUP BY 1),
br AS (SELECT p.*, coalesce(degree, 0) AS degree, CASE WHEN degree > 0 THEN 0 WHEN visibility = 'public' THEN 1 ELSE 2 END AS tier FROM p LEFT JOIN bd ON bd.id = p.id),
bn AS (SELECT *, CAST(row_number() OVER (ORDER BY tier, degree DESC, path, id) - 1 AS INT) AS n FROM br QUALIFY n < 6000),
breg AS (SELECT module, CAST(row_number() OVER (ORDER BY module) - 1 AS INT) AS region_n FROM (SELECT DISTINCT module FROM bn))
"""


def _pagerank(base: str, edges: str, rounds: int) -> str:
    sql = base + f""", pn AS (SELECT id, (SELECT count(*) FROM {edges} WHERE src = id) AS outs FROM (SELECT src AS id FROM {edges} UNION SELECT dst FROM {edges})),
    k AS (SELECT count(*)::DOUBLE AS n FROM pn), r0 AS (SELECT id, outs, 1.0 / (SELECT n FROM k) AS r FROM pn)"""
    for i in range(1, rounds + 1):
        sql += f""", g{i} AS (SELECT e.dst AS id, sum(r / outs) AS got FROM {edges} e JOIN r{i - 1} x ON x.id = e.src GROUP BY 1),
        r{i} AS (SELECT pn.id, pn.outs, 0.15 / (SELECT n FROM k) + 0.85 * (coalesce(got, 0) + (SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE outs = 0) / (SELECT n FROM k)) AS r FROM pn LEFT JOIN g{i} g ON g.id = pn.id)"""
    return sql + f" SELECT id, round(r / (SELECT max(r) FROM r{rounds}), 6) AS score FROM r{rounds}"


from symvane.queries.resolution import BASE  # noqa: E402

#: Ranked callers of every symbol over resolved references.
_NEAR = """, ranked AS (SELECT e.dst AS here, e.src AS id, e.kind, e.confidence, e.line, row_number() OVER (PARTITION BY e.dst ORDER BY e.confidence DESC, f.path, e.line, x.start_line, e.src, e.kind) AS place FROM edges e JOIN s x ON x.id = e.src JOIN files f ON f.file_id = x.file_id)"""

SQL = {
    "central_symbols": PARTS + "SELECT id, degree FROM deg ORDER BY degree DESC, id LIMIT 20",
    "a6_module_stats": PARTS + "SELECT * FROM stats",
    "a7_module_pairs": PARTS + "SELECT * FROM pairs",
    "a11_out_degrees": PARTS + "SELECT src AS id, least(count(*), 24) AS degree FROM e GROUP BY 1",
    "a12_file_scores": PARTS + "SELECT family AS path, (1 + coalesce(sum(degree), 0))::BIGINT AS score, round(1 + ln(1 + coalesce(sum(degree), 0)), 6) AS relevance FROM p LEFT JOIN (SELECT * FROM deg ORDER BY degree DESC, id LIMIT 1000) t ON t.id = p.id GROUP BY 1",
    "a17_merged_edges": PARTS + "SELECT src, dst, kind, count(*) AS weight, max(confidence) AS confidence FROM e WHERE src <> dst GROUP BY 1, 2, 3",
    "a18_degrees": PARTS + "SELECT p.id, greatest(coalesce(n, 0), 1) AS degree FROM p LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT src AS id FROM e WHERE src <> dst UNION ALL SELECT dst FROM e WHERE src <> dst) GROUP BY 1) x ON x.id = p.id",
    "a20_export_edges": PARTS + "SELECT src, dst, weight, label, confidence FROM drawn",
    "k4_mermaid": PARTS + "SELECT src, dst, '  n' || src || ' -->|' || label || '| n' || dst AS line FROM drawn",
    "k4_dot": PARTS + """SELECT src, dst, '  n' || src || ' -> n' || dst || ' [label="' || label || '"];' AS line FROM drawn""",
    "k4_json": PARTS + """SELECT src, dst, '{"src":' || src || ',"dst":' || dst || ',"label":"' || label || '","weight":' || weight || ',"confidence":' || confidence || '}' AS line FROM drawn""",
    "g1_modules": "SELECT file_id, k AS depth, CASE WHEN NOT contains(path, '/') THEN '.' ELSE array_to_string(string_split(path, '/')[1:least(k, len(string_split(path, '/')) - 1)], '/') END AS module FROM files, (VALUES (1), (3)) v(k)",
    "g2_neighbors": PARTS + """SELECT seed, direction, id, kind, confidence, line, rank FROM (
      SELECT x.*, CAST(row_number() OVER (PARTITION BY seed, direction ORDER BY confidence DESC, path, line, start_line, x.id, kind) AS INT) AS rank FROM (
        SELECT src AS seed, 'out' AS direction, dst AS id, kind, confidence, line FROM e UNION ALL SELECT dst, 'in', src, kind, confidence, line FROM e) x
      JOIN p ON p.id = x.id WHERE confidence >= 1) WHERE rank <= 6""",
    "g3_impact": PARTS + "SELECT root, id, depth, confidence FROM callers",
    "g3_limited": BASE + _NEAR + """, l1 AS (SELECT here AS root, id, confidence AS got, kind, line, place FROM ranked WHERE place <= 51),
      f1 AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY place) AS rank FROM (SELECT root, id, arg_min(got, place) AS got, arg_min(kind, place) AS kind, arg_min(line, place) AS line, min(place) AS place FROM l1 WHERE id <> root GROUP BY 1, 2)),
      stop1 AS (SELECT root, place AS stop FROM f1 WHERE rank = 51), w1 AS (SELECT l1.* FROM l1 LEFT JOIN stop1 s ON s.root = l1.root WHERE stop IS NULL OR place < stop),
      k1 AS (SELECT * FROM f1 WHERE rank <= 50), had AS (SELECT root, count(*) AS n FROM k1 GROUP BY 1),
      l2 AS (SELECT f.root, n.id, least(f.got, n.confidence) AS got, n.kind, n.line, f.rank * 1000 + n.place AS pos FROM k1 f JOIN ranked n ON n.here = f.id AND n.place <= 51 WHERE f.root NOT IN (SELECT root FROM stop1)),
      f2 AS (SELECT x.*, n + row_number() OVER (PARTITION BY x.root ORDER BY first) AS rank FROM (SELECT root, id, arg_min(kind, pos) AS kind, arg_min(line, pos) AS line, min(pos) AS first FROM l2 WHERE id <> root AND (root, id) NOT IN (SELECT (root, id) FROM f1) GROUP BY 1, 2) x JOIN had ON had.root = x.root),
      stop2 AS (SELECT root, min(first) AS stop FROM f2 WHERE rank > 50 GROUP BY 1), w2 AS (SELECT l2.* FROM l2 LEFT JOIN stop2 s ON s.root = l2.root WHERE stop IS NULL OR pos < stop),
      ways AS (SELECT root, id, min(got) AS confidence FROM (SELECT root, id, got FROM w1 UNION ALL SELECT root, id, got FROM w2) GROUP BY 1, 2)
      SELECT x.root, x.id, depth, confidence, kind, line FROM (SELECT root, id, 1 AS depth, kind, line FROM k1 UNION ALL SELECT root, id, 2, kind, line FROM f2 WHERE rank <= 50) x JOIN ways w ON w.root = x.root AND w.id = x.id""",
    "g4_verdicts": PARTS + """, near AS (SELECT dst, src, confidence, row_number() OVER (PARTITION BY dst ORDER BY confidence DESC, path, line, start_line, src, kind) AS place FROM e JOIN p ON p.id = src WHERE confidence >= 1),
      c AS (SELECT dst, count(DISTINCT src) FILTER (src <> dst) AS n, min(confidence) AS w FROM near WHERE place <= 13 GROUP BY 1)
      SELECT p.id AS root, least(coalesce(n, 0), 12) AS callers, CASE WHEN coalesce(n, 0) = 0 AND visibility IN ('public', 'unknown') THEN 'unknown' WHEN coalesce(w, 2) >= 2 AND coalesce(n, 0) <= 12 AND visibility = 'private' THEN 'exact' ELSE 'lower-bound' END AS verdict
      FROM p LEFT JOIN c ON c.dst = p.id""",
    "g5_reports": BASE + _NEAR + """, full_s AS (SELECT DISTINCT s.id, s.name, s.qualified_name, s.start_line, y.visibility, f.path FROM s JOIN files f ON f.file_id = s.file_id JOIN symbols y ON y.id = s.id),
      f1 AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY place) AS rank FROM (SELECT here AS root, id, arg_min(line, place) AS line, min(place) AS place FROM ranked WHERE id <> here AND place <= 51 GROUP BY 1, 2)),
      stops AS (SELECT root, place AS stop FROM f1 WHERE rank = 51), seen AS (SELECT r.* FROM ranked r LEFT JOIN stops ON root = here WHERE place <= 51 AND (stop IS NULL OR place < stop)),
      c AS (SELECT f1.root, f1.id, f1.line, min(confidence) AS conf FROM f1 JOIN seen ON here = f1.root AND seen.id = f1.id WHERE rank <= 50 GROUP BY 1, 2, 3),
      roots AS (SELECT DISTINCT dst AS root FROM edges), sure AS (SELECT here AS root, min(confidence) AS w FROM seen GROUP BY 1),
      t AS (SELECT root, count(*) AS callers, string_agg(DISTINCT path, ';' ORDER BY path) AS files, string_agg(DISTINCT path, ';' ORDER BY path) FILTER (regexp_matches(path, '(?i)(^|/)(tests?|spec|__tests__)/') OR regexp_matches(path, '(?i)[_.](test|spec)\\.[^/]*$')) AS tests,
        (list(c.id ORDER BY conf DESC, path, c.line, name, c.id))[1] AS first FROM c JOIN full_s ON full_s.id = c.id GROUP BY 1),
      hits AS (SELECT r.root, x.id, x.id || ' ' || x.path || ' ' || x.qualified_name AS told, row_number() OVER (PARTITION BY r.root ORDER BY (x.name = o.name OR x.qualified_name = o.name) DESC, x.path, x.start_line, x.id) AS k
        FROM roots r JOIN full_s o ON o.id = r.root JOIN full_s x ON lower(x.name) = lower(o.name) OR lower(x.qualified_name) = lower(o.name)),
      alt AS (SELECT root, list(told ORDER BY k)[1:5] AS told FROM hits WHERE k <= 16 AND id <> root GROUP BY 1)
      SELECT r.root, coalesce(callers, 0) AS callers, coalesce(callers, 0) AS direct, r.root IN (SELECT root FROM stops) AS truncated,
        CASE WHEN callers IS NULL AND o.visibility IN ('public', 'unknown') THEN 'unknown' WHEN coalesce(w, 2) >= 2 AND r.root NOT IN (SELECT root FROM stops) AND o.visibility = 'private' THEN 'exact' ELSE 'lower-bound' END AS verdict,
        coalesce(files, '') AS files, coalesce(tests, '') AS tests, coalesce(array_to_string(told, ';'), '') AS alternatives,
        'expand ' || coalesce(first, r.root) || CASE WHEN r.root IN (SELECT root FROM stops) THEN ';impact ' || r.root || ' --limit 100' WHEN callers > 0 THEN ';impact ' || r.root || ' --depth 2' ELSE '' END || ';recall "' || o.qualified_name || '"' AS next
      FROM roots r JOIN full_s o ON o.id = r.root LEFT JOIN t ON t.root = r.root LEFT JOIN sure ON sure.root = r.root LEFT JOIN alt ON alt.root = r.root""",
    "g5_impact_files": PARTS + "SELECT root, CAST(count(DISTINCT path) AS INT) AS files, CAST(0 AS INT) AS tests, min(path) AS first FROM callers c JOIN p ON p.id = c.id GROUP BY 1",
    "g6_around": PARTS + """, b2 AS (SELECT src, dst FROM e WHERE confidence >= 2 UNION SELECT dst, src FROM e WHERE confidence >= 2),
      z0 AS (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 1), z1 AS (SELECT DISTINCT dst AS id FROM b2 WHERE src IN (SELECT id FROM z0) AND dst NOT IN (SELECT id FROM z0)),
      z2 AS (SELECT DISTINCT dst AS id FROM b2 WHERE src IN (SELECT id FROM z1) AND dst NOT IN (SELECT id FROM z0) AND dst NOT IN (SELECT id FROM z1))
      SELECT id, 0 AS depth FROM z0 UNION ALL SELECT id, 1 FROM z1 UNION ALL SELECT id, 2 FROM z2""",
    "g6_among": PARTS + ", c60 AS (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 60) SELECT src, dst, kind, confidence FROM e WHERE src IN (SELECT id FROM c60) AND dst IN (SELECT id FROM c60)",
    "g7_module_graph": PARTS + ", top AS (SELECT module FROM stats ORDER BY incoming + outgoing DESC, module LIMIT 40) SELECT * FROM pairs WHERE from_module IN (SELECT module FROM top) AND to_module IN (SELECT module FROM top) ORDER BY weight DESC, from_module, to_module LIMIT 320",
    "g8_pagerank": _pagerank(PARTS, "e", 10),
    "g8_pagerank_refs": _pagerank(BASE, "edges", 10),
    "g11_brain_nodes": PARTS + "SELECT n, id, region_n, degree FROM bn JOIN breg ON breg.module = bn.module",
    "g11_brain_edges": PARTS + "SELECT a.n AS from_n, b.n AS to_n, kind FROM (SELECT DISTINCT src, dst, kind FROM e) x JOIN bn a ON a.id = src JOIN bn b ON b.id = dst",
    "g12_nesting": "WITH RECURSIVE s AS (SELECT DISTINCT id, parent_id FROM symbols), w AS (SELECT id, 0 AS depth FROM s WHERE parent_id IS NULL UNION ALL SELECT s.id, depth + 1 FROM s JOIN w ON w.id = s.parent_id) SELECT id, least(depth, 32) AS depth FROM w",
}
