"""Queries of scans, predicates, joins, aggregates, order and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symvane import views
from symvane.functions import scoring as sc
from symvane.functions import text as tx
from symvane.operators.resolve import edge_kind, family_of
from symvane.runtime import table


def s7_files(spark: SparkSession, d: str) -> DataFrame:
    """Files in order of path."""
    return views.files(spark, d).select("file_id", "path", "language", "hash", "size").orderBy("path")


def s8_symbol(spark: SparkSession, d: str) -> DataFrame:
    """The stored row of one file by its path: the scan is filtered at the source."""
    return views.files(spark, d).filter(F.col("path").startswith("amber-atlas/tools/ribbon_ledger_e")).select("path", "hash")


def p1_symbol_rows(spark: SparkSession, d: str) -> DataFrame:
    """Symbols with their file's path and language."""
    cols = ["id", "file_id", "seq", "ordinal", "name", "qualified_name", "kind", "signature", "doc", "visibility", "start_line", "end_line", "start_byte", "end_byte", "parent_id", "sig_hash", "body_hash"]
    return views.symbols(spark, d, *cols[1:]).join(views.files(spark, d).select("file_id", "path", "language"), "file_id")


def p2_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Files below a prefix."""
    return views.files(spark, d).filter(F.col("path").startswith("amber-")).select("file_id", "path")


def p3_kinds(spark: SparkSession, d: str) -> DataFrame:
    return views.symbols(spark, d, "kind", "name").filter(F.col("kind").isin(*{"function", "method", "class"}))


def p4_certain(spark: SparkSession, d: str) -> DataFrame:
    return views.part_edges(spark, d).filter("confidence >= 2").select("src", "dst", "kind")


def p5_undocumented(spark: SparkSession, d: str) -> DataFrame:
    return views.symbols(spark, d, "doc", "visibility").filter(tx.blank(F.col("doc")) & (F.col("visibility") == "public")).select("id")


def p6_find(spark: SparkSession, d: str) -> DataFrame:
    """Symbols whose name equals that of a shared owner or of a heavy reference, ignoring case, exact ones first."""
    wanted = table(spark, d, "tmp_refs").groupBy("name").agg(F.countDistinct("rid").alias("n")).filter("n >= 20").select(F.col("name").alias("wanted"))
    s = views.symbols(spark, d, "name", "file_id")
    hit = s.join(wanted, F.lower("name") == F.lower("wanted"))
    return hit.select("wanted", "id", "name", (F.col("name") == F.col("wanted")).cast("int").alias("exact"))


def p7_memories(spark: SparkSession, d: str) -> DataFrame:
    return views.memories(spark, d).filter("kind = 'decision'").select("id", "kind", "provenance", "created_at")


def p11_tests(spark: SparkSession, d: str) -> DataFrame:
    """Files with whether they look like tests, some renamed as tests are."""
    path = F.col("path")
    named = F.when(F.col("family") == "go", F.regexp_replace(path, r"\.go$", "_test.go")).when(F.col("family") == "python", F.concat(F.lit("tests/"), path)).otherwise(path)
    return views.files(spark, d).select("file_id", tx.is_test_path(named).alias("test"))


def p12_finite(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("kind") == "function", F.lit(float("nan"))).when(F.col("kind") == "method", -F.col("pagerank")).otherwise(F.col("pagerank"))
    return views.symbols(spark, d, "pagerank", "kind").select("id", x.alias("x")).filter(sc.finite(F.col("x")))


def p13_maps(spark: SparkSession, d: str) -> DataFrame:
    """Families of languages, and edge kinds of reference kinds."""
    fams = views.files(spark, d).select("language", family_of(F.col("language")).alias("family")).distinct()
    kinds = spark.createDataFrame([("call",), ("type",), ("inherit",)], "language string").select("language", edge_kind(F.col("language")).alias("family"))
    return fams.unionByName(kinds)


def j12_left(spark: SparkSession, d: str) -> DataFrame:
    """Files with what refers to their symbols' names and what they refer to, zero where nothing does."""
    refs = views.refs(spark, d)
    out = refs.groupBy("file_id").agg(F.count(F.lit(1)).alias("outgoing"))
    syms = views.symbols(spark, d, "file_id").groupBy("file_id").agg(F.count(F.lit(1)).alias("symbols"))
    return views.files(spark, d).select("file_id").join(out, "file_id", "left").join(syms, "file_id", "left").na.fill(0)


def j13_semi(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that own a reference."""
    owners = table(spark, d, "tmp_refs").select(F.col("owner").alias("id"))
    return views.symbols(spark, d, "name").join(owners, "id", "left_semi")


def j14_exists(spark: SparkSession, d: str) -> DataFrame:
    """Distinct names of references that a symbol of their family carries."""
    s = views.symbols(spark, d, "name", "file_id").join(views.files(spark, d).select("file_id", "family"), "file_id")
    return table(spark, d, "tmp_refs").select("name", "family").distinct().join(s, ["name", "family"], "left_semi")


def j15_anti(spark: SparkSession, d: str) -> DataFrame:
    """Files without references."""
    return views.files(spark, d).join(table(spark, d, "tmp_refs").select("file_id"), "file_id", "left_anti").select("file_id", "path")


def j16_anchor_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of anchors: by link, and where the link is dead by path and qualified name."""
    s = views.symbols(spark, d, "file_id", "qualified_name").join(views.files(spark, d).select("file_id", "path"), "file_id").select("id", "path", "qualified_name")
    a = views.anchors(spark, d).select("memory_id", "symbol_id", "path", "qualified_name")
    linked = a.join(s.select(F.col("id").alias("symbol_id")), "symbol_id").select("memory_id", F.col("symbol_id").alias("id"))
    dead = a.join(s.select(F.col("id").alias("symbol_id")), "symbol_id", "left_anti")
    return linked.union(dead.join(s, ["path", "qualified_name"]).select("memory_id", "id")).distinct()


def a5_index_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the index, one row each."""
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    return one("files", views.files(spark, d)).unionByName(one("symbols", views.symbols(spark, d))).unionByName(one("references", views.refs(spark, d))).unionByName(one("memories", views.memories(spark, d)))


def a8_doc_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Documented symbols per language in whole percent."""
    rows = views.symbols(spark, d, "file_id", "doc").join(views.files(spark, d).select("file_id", "language"), "file_id")
    counted = rows.groupBy("language").agg(F.count(F.lit(1)).alias("symbols"), F.count_if(~tx.blank(F.col("doc"))).alias("documented"))
    return counted.select("*", F.when(F.col("symbols") == 0, 0).otherwise(F.floor(100 * F.col("documented") / F.col("symbols"))).cast("bigint").alias("percent"))


def a9_file_totals(spark: SparkSession, d: str) -> DataFrame:
    return views.files(spark, d).agg(F.sum("lines").alias("lines"), F.count_if(F.col("parse_errors") > 0).alias("with_errors"))


def a10_languages(spark: SparkSession, d: str) -> DataFrame:
    return views.files(spark, d).groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("symbol_count").alias("symbols")).orderBy(F.col("files").desc(), F.col("symbols").desc(), "language")


def o1_order(spark: SparkSession, d: str) -> DataFrame:
    """Symbols in the order of every listing."""
    return views.symbols(spark, d, "file_id", "start_line").join(views.files(spark, d).select("file_id", "path"), "file_id").select("path", "start_line", "id").orderBy("path", "start_line", "id")


def o2_limit(spark: SparkSession, d: str) -> DataFrame:
    return views.symbols(spark, d, "pagerank").orderBy(F.col("pagerank").desc(), "id").limit(25)


def o7_hotspots(spark: SparkSession, d: str) -> DataFrame:
    """Hotspots in report order."""
    return table(spark, d, "hotspots").distinct().orderBy(F.col("callers").desc_nulls_last(), F.col("callees").desc(), "path", "line", "id")


def u1_both_ways(spark: SparkSession, d: str) -> DataFrame:
    pairs = views.together(spark, d).select("a", "b").distinct()
    return pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.count(F.lit(1)).alias("partners"))


def u3_scope_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that the files of one family define or mention."""
    f = views.files(spark, d).filter("family = 'go'").select("file_id")
    own = views.symbols(spark, d, "file_id", "name").join(f, "file_id", "left_semi").select("name")
    said = table(spark, d, "tmp_refs").join(f, "file_id", "left_semi").select("name")
    return own.union(said).distinct()


def u4_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tmp_refs").select("name", "family", "recv").distinct()


def u5_diff(spark: SparkSession, d: str) -> DataFrame:
    """Symbols against the rows stored last, without regard to plans: added, removed, modified, kept."""
    old = table(spark, d, "old_symbols").groupBy("id").agg(F.max(F.struct("stored_at", "sig_hash", "body_hash")).alias("r")).select("id", F.col("r.sig_hash").alias("s0"), F.col("r.body_hash").alias("b0"))
    new = views.symbols(spark, d, "sig_hash", "body_hash")
    both = new.join(old, "id", "full_outer")
    kind = F.when(F.col("s0").isNull(), "added").when(F.col("sig_hash").isNull(), "removed").when((F.col("s0") != F.col("sig_hash")) | (F.col("b0") != F.col("body_hash")), "modified").otherwise("kept")
    return both.select("id", kind.alias("change"))


def f24_regions(spark: SparkSession, d: str) -> DataFrame:
    return views.files(spark, d).groupBy(tx.region(F.col("path"), 2).alias("region")).agg(F.count(F.lit(1)).alias("files"))


def f26_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", tx.count_lines(F.col("text")).alias("lines"))


QUERIES = {f.__name__: f for f in (s7_files, s8_symbol, p1_symbol_rows, p2_prefix, p3_kinds, p4_certain, p5_undocumented, p6_find, p7_memories, p11_tests, p12_finite, p13_maps, j12_left, j13_semi, j14_exists, j15_anti, j16_anchor_fallback, a5_index_stats, a8_doc_coverage, a9_file_totals, a10_languages, o1_order, o2_limit, o7_hotspots, u1_both_ways, u3_scope_names, u4_distinct, u5_diff, f24_regions, f26_lines)}
#: Keys of the training-data problems start with p and a number too; those of the inventory get the prefix "inv_".
QUERIES = {(f"inv_{k}" if k[0] == "p" else k): f for k, f in QUERIES.items()}

_MEM = "old AS (SELECT * FROM old_symbols WHERE length(trim(doc, ' ')) > 0), mem AS (SELECT id, arg_max(kind, (stored_at, doc)) AS k0, max(stored_at) AS at FROM old GROUP BY id), lastrow AS (SELECT o.* FROM old o JOIN mem ON mem.id = o.id AND mem.at = o.stored_at QUALIFY row_number() OVER (PARTITION BY o.id ORDER BY doc DESC) = 1)"

SQL = {
    "s7_files": "SELECT file_id, path, language, hash, size FROM files",
    "s8_symbol": "SELECT path, hash FROM files WHERE starts_with(path, 'amber-atlas/tools/ribbon_ledger_e')",
    "inv_p1_symbol_rows": "SELECT DISTINCT s.id, s.file_id, s.seq, s.ordinal, s.name, s.qualified_name, s.kind, s.signature, s.doc, s.visibility, s.start_line, s.end_line, s.start_byte, s.end_byte, s.parent_id, s.sig_hash, s.body_hash, f.path, f.language FROM symbols s JOIN files f ON f.file_id = s.file_id",
    "inv_p2_prefix": "SELECT file_id, path FROM files WHERE path >= 'amber-' AND path < 'amber.'",
    "inv_p3_kinds": "SELECT DISTINCT id, kind, name FROM symbols WHERE kind IN ('function', 'method', 'class')",
    "inv_p5_undocumented": "SELECT DISTINCT id FROM symbols WHERE visibility = 'public' AND trim(coalesce(doc, ''), E' \\t\\r\\n') = ''",
    "inv_p6_find": "WITH w AS (SELECT name FROM tmp_refs GROUP BY name HAVING count(DISTINCT rid) >= 20) SELECT w.name AS wanted, s.id, s.name, (s.name = w.name)::INT AS exact FROM w JOIN (SELECT DISTINCT id, name FROM symbols) s ON lower(s.name) = lower(w.name)",
    "inv_p7_memories": f"WITH {_MEM} SELECT id, 'decision' AS kind, CASE kind WHEN 'class' THEN 'auto' ELSE 'tool' END AS provenance, floor(epoch(stored_at))::BIGINT AS created_at FROM lastrow WHERE kind IN ('class', 'struct', 'interface')",
    "inv_p11_tests": "SELECT file_id, regexp_matches(p, '(^|/)(tests?|spec|__tests__)/', 'i') OR regexp_matches(p, '[_.](test|spec)\\.[^/]*$', 'i') AS test FROM (SELECT file_id, CASE family WHEN 'go' THEN regexp_replace(path, '\\.go$', '_test.go') WHEN 'python' THEN 'tests/' || path ELSE path END AS p FROM files)",
    "inv_p12_finite": "SELECT id, pagerank AS x FROM (SELECT DISTINCT id, pagerank, kind FROM symbols) WHERE kind NOT IN ('function', 'method') AND pagerank > 0",
    "inv_p13_maps": "SELECT DISTINCT language, CASE WHEN language IN ('javascript', 'typescript', 'tsx') THEN 'ecmascript' WHEN language IN ('c', 'cpp') THEN 'c_family' ELSE language END AS family FROM files UNION ALL VALUES ('call', 'calls'), ('type', 'uses'), ('inherit', 'inherits')",
    "j12_left": "SELECT f.file_id, coalesce(o.n, 0) AS outgoing, coalesce(s.n, 0) AS symbols FROM files f LEFT JOIN (SELECT file_id, count(DISTINCT rid) AS n FROM tmp_refs GROUP BY 1) o ON o.file_id = f.file_id LEFT JOIN (SELECT file_id, count(DISTINCT id) AS n FROM symbols GROUP BY 1) s ON s.file_id = f.file_id",
    "j13_semi": "SELECT DISTINCT id, name FROM symbols WHERE id IN (SELECT owner FROM tmp_refs)",
    "j14_exists": "SELECT DISTINCT name, family FROM tmp_refs r WHERE EXISTS (SELECT 1 FROM symbols s JOIN files f ON f.file_id = s.file_id WHERE s.name = r.name AND f.family = r.family)",
    "j15_anti": "SELECT file_id, path FROM files WHERE file_id NOT IN (SELECT file_id FROM tmp_refs)",
    "j16_anchor_fallback": f"""WITH {_MEM}, s AS (SELECT DISTINCT s.id, f.path, s.qualified_name FROM symbols s JOIN files f ON f.file_id = s.file_id),
      x AS (SELECT id, max(stored_at) AS at FROM old GROUP BY id), a AS (SELECT o.id, f.path, o.qualified_name FROM lastrow o JOIN files f ON f.file_id = o.file_id)
      SELECT a.id AS memory_id, a.id FROM a WHERE a.id IN (SELECT id FROM s) UNION SELECT a.id, s.id FROM a JOIN s ON s.path = a.path AND s.qualified_name = a.qualified_name WHERE a.id NOT IN (SELECT id FROM s)""",
    "a5_index_stats": f"WITH {_MEM} SELECT 'files' AS what, count(*) AS n FROM files UNION ALL SELECT 'symbols', count(DISTINCT id) FROM symbols UNION ALL SELECT 'references', count(DISTINCT rid) FROM tmp_refs UNION ALL SELECT 'memories', count(*) FROM lastrow",
    "a8_doc_coverage": "SELECT language, count(*) AS symbols, count(*) FILTER (trim(coalesce(doc, ''), E' \\t\\r\\n') <> '') AS documented, 100 * count(*) FILTER (trim(coalesce(doc, ''), E' \\t\\r\\n') <> '') // count(*) AS percent FROM (SELECT DISTINCT id, file_id, doc FROM symbols) s JOIN files f ON f.file_id = s.file_id GROUP BY 1",
    "a9_file_totals": "SELECT sum(lines)::BIGINT AS lines, count(*) FILTER (parse_errors > 0) AS with_errors FROM files",
    "a10_languages": "SELECT language, count(*) AS files, sum(symbol_count)::BIGINT AS symbols FROM files GROUP BY 1",
    "o1_order": "SELECT DISTINCT f.path, s.start_line, s.id FROM symbols s JOIN files f ON f.file_id = s.file_id",
    "o2_limit": "SELECT * FROM (SELECT DISTINCT id, pagerank FROM symbols) ORDER BY pagerank DESC, id LIMIT 25",
    "o7_hotspots": "SELECT DISTINCT * FROM hotspots",
    "u1_both_ways": "WITH l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), p AS (SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM l x JOIN l y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey) SELECT a, count(*) AS partners FROM (SELECT a, b FROM p UNION ALL SELECT b, a FROM p) GROUP BY 1",
    "u3_scope_names": "SELECT name FROM symbols WHERE file_id IN (SELECT file_id FROM files WHERE family = 'go') UNION SELECT name FROM tmp_refs WHERE file_id IN (SELECT file_id FROM files WHERE family = 'go')",
    "u4_distinct": "SELECT DISTINCT name, family, recv FROM tmp_refs",
    "u5_diff": "WITH o AS (SELECT id, arg_max(sig_hash, stored_at) AS s, arg_max(body_hash, stored_at) AS b FROM old_symbols GROUP BY id), n AS (SELECT DISTINCT id, sig_hash, body_hash FROM symbols) SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN s <> sig_hash OR b <> body_hash THEN 'modified' ELSE 'kept' END AS change FROM n FULL JOIN o ON o.id = n.id",
    "f24_regions": "SELECT CASE WHEN NOT contains(path, '/') THEN '.' ELSE array_to_string(string_split(path, '/')[1:least(2, len(string_split(path, '/')) - 1)], '/') END AS region, count(*) AS files FROM files GROUP BY 1",
    "f26_lines": "SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + (NOT ends_with(text, chr(10)))::INT END::INT AS lines FROM documents WHERE text IS NOT NULL",
}
from symvane.queries.graph import PARTS  # noqa: E402

SQL["inv_p4_certain"] = PARTS + "SELECT src, dst, kind FROM e WHERE confidence >= 2"
