"""Queries of reference resolution (J2-J9, W1-W4, A1-A3, G10, P8-P10, ST3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symvane import views
from symvane.operators import resolve as r
from symvane.runtime import cut


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    symbols = views.symbols(spark, d, "file_id", "name", "qualified_name", "start_line", "parent_id")
    candidates = r.candidates_of(symbols, views.files(spark, d))
    return candidates, r.load_refs(views.refs(spark, d), candidates, views.files(spark, d))


def j2_refs_in_files(spark: SparkSession, d: str) -> DataFrame:
    """References with an owner and the family of their file."""
    return views.refs(spark, d).filter("owner_id IS NOT NULL").join(views.files(spark, d).select("file_id", "family", "path"), "file_id").select("id", "name", "family", "path")


def j3_same_file(spark: SparkSession, d: str) -> DataFrame:
    """References with the symbols of their name in their file, other than the owner."""
    s = views.symbols(spark, d, "file_id", "name").withColumnRenamed("id", "sid")
    return views.refs(spark, d).join(s, ["name", "file_id"]).filter("sid <> owner_id").select("id", "sid")


def j4_unique_in_family(spark: SparkSession, d: str) -> DataFrame:
    """Distinct referenced names with the one symbol that carries them in a family."""
    candidates, loaded = _parts(spark, d)
    one = loaded.filter("nsame = 0 AND cnt = 1").select("name", "family").distinct()
    return one.join(candidates.select("name", "family", "sid", "sfile"), ["name", "family"])


def j5_hints(spark: SparkSession, d: str) -> DataFrame:
    """References whose receiver points at exactly one candidate."""
    candidates, loaded = _parts(spark, d)
    return r.hints(loaded, candidates)


def j6_picks(spark: SparkSession, d: str) -> DataFrame:
    """References of ambiguous names with the candidates picked for their file."""
    candidates, loaded = _parts(spark, d)
    told = loaded.join(r.hints(loaded, candidates), "id", "left")
    return told.filter("nsame = 0 AND cnt >= 2 AND hint IS NULL").join(r.picks(told, candidates), ["name", "family", "file_id"]).select("id", "rank", "sid")


def j7_parents(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol with the name of its parent, if it has one."""
    s = views.symbols(spark, d, "name", "parent_id")
    p = s.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    return s.join(p, "parent_id", "left").select("id", "name", "parent_name")


def j8_counts(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of every reference in its file and in its family."""
    _, loaded = _parts(spark, d)
    return loaded.select("id", "nsame", "cnt")


def a1_names(spark: SparkSession, d: str) -> DataFrame:
    """How many symbols carry a name in a family."""
    candidates, _ = _parts(spark, d)
    return candidates.groupBy("name", "family").agg(F.count(F.lit(1)).alias("cnt"))


def w1_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The four nearest candidates of a reference in its own file."""
    candidates, loaded = _parts(spark, d)
    return r.same_file(loaded, candidates).select("src", "dst", "kind", "line")


def w3_shared_path(spark: SparkSession, d: str) -> DataFrame:
    """The five best candidates of ambiguous names per file by shared path."""
    candidates, loaded = _parts(spark, d)
    return r.picks(loaded.join(r.hints(loaded, candidates), "id", "left"), candidates)


def w4_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Position of a symbol among those of its qualified name and kind in its file."""
    w = Window.partitionBy("file_id", "qualified_name", "kind").orderBy("seq", "id")
    return views.symbols(spark, d, "file_id", "qualified_name", "kind", "seq").withColumn("nth", F.row_number().over(w) - 1).select("id", "nth")


def g10_edges(spark: SparkSession, d: str) -> DataFrame:
    """All edges."""
    return views.edges(spark, d)


def a2_edge_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Edges by kind and confidence."""
    return views.edges(spark, d).groupBy("kind", "confidence").agg(F.count(F.lit(1)).alias("edges"), F.min("line").alias("first_line"))


def p8_names_type(spark: SparkSession, d: str) -> DataFrame:
    """Distinct receivers with the candidates whose type they name."""
    candidates, loaded = _parts(spark, d)
    said = loaded.filter("recv IS NOT NULL AND recv <> ''").select("name", "family", "recv").distinct().join(candidates, ["name", "family"])
    return said.filter(r.names_type(F.col("recv"), F.col("name"), F.col("qualified"), F.col("parent"))).select("name", "family", "recv", "sid")


def p9_names_place(spark: SparkSession, d: str) -> DataFrame:
    """Distinct receivers with the candidates whose file or directory they name."""
    candidates, loaded = _parts(spark, d)
    said = loaded.filter("recv IS NOT NULL AND recv <> ''").select("name", "family", "recv").distinct().join(candidates, ["name", "family"])
    return said.filter(r.names_place(F.col("recv"), F.col("spath"))).select("name", "family", "recv", "sid")


def p10_no_self(spark: SparkSession, d: str) -> DataFrame:
    """References that carry their owner's name, with whether they must not link to it."""
    owners = views.symbols(spark, d, "name").select(F.col("id").alias("owner_id"), F.col("name").alias("owner_name"))
    rows = views.refs(spark, d).join(owners, "owner_id").filter("owner_name = name")
    return rows.select("id", r.no_self(F.col("owner_name"), F.col("name"), F.col("recv")).alias("no_self"))


def f5_receivers(spark: SparkSession, d: str) -> DataFrame:
    """Receiver words of qualifiers made from references."""
    q = F.when(F.col("recv") == "", "(expr)").when(F.col("kind") == "calls", F.concat(F.lit("$this->"), "recv")).when(F.col("kind") == "uses", F.concat(F.lit("self."), F.initcap("recv"))).otherwise(F.concat(F.lit("std::"), "recv"))
    return views.refs(spark, d).select("id", r.receiver_word(q).alias("word"))


def st3_touching(spark: SparkSession, d: str) -> DataFrame:
    """Edges after files of one family are taken for changed, from partial resolution: equal to all edges."""
    files, refs = views.files(spark, d), views.refs(spark, d)
    symbols = cut(views.symbols(spark, d, "file_id", "name", "qualified_name", "start_line", "parent_id"))
    before = cut(views.edges(spark, d))
    changed = files.filter("family = 'python'").select("file_id")
    dirty = symbols.join(changed, "file_id", "left_semi").join(files.select("file_id", "family"), "file_id").select("name", "family").distinct()
    return r.touching(refs, symbols, files, before, changed, dirty)


def _pointed_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    refs, symbols, files = views.pointed(spark, d)
    candidates = cut(r.candidates_of(symbols, files))
    return candidates, r.load_refs(refs, candidates, files)


def j5_pointed(spark: SparkSession, d: str) -> DataFrame:
    """As j5_hints, over references whose receivers name types, files and directories."""
    candidates, loaded = _pointed_parts(spark, d)
    return r.hints(cut(loaded), candidates)


def j8_pointed(spark: SparkSession, d: str) -> DataFrame:
    """As j8_counts, over references whose receivers name types, files and directories."""
    return _pointed_parts(spark, d)[1].select("id", "nsame", "cnt")


def g10_pointed(spark: SparkSession, d: str) -> DataFrame:
    """Edges of all references whose receivers name types, files and directories."""
    return r.resolve(*views.pointed(spark, d))


def _asked(loaded: DataFrame) -> DataFrame:
    return loaded.filter("recv IS NOT NULL AND recv <> ''").select("name", "family", "recv").distinct()


def p8_pointed(spark: SparkSession, d: str) -> DataFrame:
    """As p8_names_type, over receivers that name types, files and directories."""
    candidates, loaded = _pointed_parts(spark, d)
    return r.typed_pairs(_asked(loaded), candidates)


def p9_pointed(spark: SparkSession, d: str) -> DataFrame:
    """As p9_names_place, over receivers that name types, files and directories."""
    candidates, loaded = _pointed_parts(spark, d)
    return r.placed_pairs(_asked(loaded), candidates)


QUERIES = {f.__name__: f for f in (j2_refs_in_files, j3_same_file, j4_unique_in_family, j5_hints, j6_picks, j7_parents, j8_counts, a1_names, w1_nearest, w3_shared_path, w4_ordinals, g10_edges, a2_edge_tiers, p8_names_type, p9_names_place, p10_no_self, f5_receivers, st3_touching, j5_pointed, j8_pointed, g10_pointed, p8_pointed, p9_pointed)}
QUERIES = {(f"inv_{k}" if k[0] == "p" else k): f for k, f in QUERIES.items()}  # p and a number is for the training-data problems

_TYPE = """(recv <> '' AND (coalesce(replace(lower(parent), '_', '') = replace(recv, '_', ''), false)
  OR length(recv) >= 4 AND coalesce(ends_with(replace(lower(parent), '_', ''), replace(recv, '_', '')), false)
  OR qualified ILIKE recv || '::' || name OR qualified ILIKE '%::' || recv || '::' || name OR length(recv) >= 4 AND qualified ILIKE '%' || recv || '::' || name
  OR qualified ILIKE recv || '.' || name OR qualified ILIKE '%.' || recv || '.' || name OR length(recv) >= 4 AND qualified ILIKE '%' || recv || '.' || name))"""


def _place(path: str) -> str:
    return f"(recv <> '' AND ({path} ILIKE '%/' || recv || '.%' OR {path} ILIKE recv || '.%' OR {path} ILIKE '%/' || recv || '/%' OR {path} ILIKE recv || '/%'))"


#: Common table expressions up to `edges`, for every query on edges.
BASE = f"""
WITH s AS (SELECT DISTINCT id, file_id, name, qualified_name, start_line, parent_id FROM symbols),
cand AS (SELECT s.id AS sid, s.name, s.qualified_name AS qualified, s.start_line, s.file_id AS sfile, f.path AS spath, f.family, p.name AS parent
  FROM s JOIN files f ON f.file_id = s.file_id LEFT JOIN s p ON p.id = s.parent_id),
r AS (SELECT DISTINCT rid AS id, file_id, owner, name, kind, line, excl, recv FROM tmp_refs),
near AS (SELECT r.*, f.path, f.family FROM r JOIN files f ON f.file_id = r.file_id),
n1 AS (SELECT near.id, count(*) - any_value(excl) AS nsame FROM near JOIN cand c ON c.name = near.name AND c.sfile = near.file_id WHERE recv IS NULL GROUP BY near.id),
n2 AS (SELECT id, count(*) AS nsame FROM (SELECT near.*, c.sid, c.qualified, c.parent FROM near JOIN cand c ON c.name = near.name AND c.sfile = near.file_id WHERE recv <> '')
  WHERE (excl = 0 OR sid <> owner) AND ({_TYPE} OR {_place('path')}) GROUP BY id),
nn AS (SELECT * FROM n1 UNION ALL SELECT * FROM n2),
names AS (SELECT name, family, count(*) AS n FROM cand GROUP BY 1, 2),
loaded AS (SELECT near.*, coalesce(nn.nsame, 0) AS nsame, coalesce(names.n, 0) - near.excl AS cnt
  FROM near LEFT JOIN nn ON nn.id = near.id LEFT JOIN names ON names.name = near.name AND names.family = near.family),
asked AS (SELECT id, name, family, recv, owner, excl FROM loaded WHERE nsame = 0 AND recv <> ''),
shared AS (SELECT name, family, recv, sum(t::INT) AS t, max(CASE WHEN t THEN sid END) AS tid, sum(p::INT) AS p, max(CASE WHEN p THEN sid END) AS pid FROM (
  SELECT a.name, a.family, recv, sid, {_TYPE.replace('|| name', '|| a.name')} AS t, {_place('spath')} AS p
  FROM (SELECT DISTINCT name, family, recv FROM asked WHERE excl = 0) a JOIN cand c ON c.name = a.name AND c.family = a.family) GROUP BY 1, 2, 3),
own AS (SELECT id, sum(t::INT) AS t, max(CASE WHEN t THEN sid END) AS tid, sum(p::INT) AS p, max(CASE WHEN p THEN sid END) AS pid FROM (
  SELECT a.id, sid, {_TYPE.replace('|| name', '|| a.name')} AS t, {_place('spath')} AS p
  FROM (SELECT * FROM asked WHERE excl = 1) a JOIN cand c ON c.name = a.name AND c.family = a.family WHERE sid <> owner) GROUP BY 1),
hint AS (SELECT * FROM (
  SELECT a.id, CASE WHEN t = 1 THEN tid WHEN t = 0 AND p = 1 THEN pid END AS hint FROM asked a JOIN shared h ON h.name = a.name AND h.family = a.family AND h.recv = a.recv WHERE a.excl = 0
  UNION ALL SELECT id, CASE WHEN t = 1 THEN tid WHEN t = 0 AND p = 1 THEN pid END FROM own) WHERE hint IS NOT NULL),
told AS (SELECT l.*, hint FROM loaded l LEFT JOIN hint ON hint.id = l.id),
amb AS (SELECT DISTINCT name, family, file_id, path FROM told WHERE nsame = 0 AND cnt >= 2 AND hint IS NULL),
picks AS (SELECT * FROM (SELECT a.name, a.family, a.file_id, c.sid, c.sfile, CAST(row_number() OVER (PARTITION BY a.name, a.family, a.file_id ORDER BY
    coalesce(list_min([i FOR i IN range(least(length(a.path), length(c.spath))) IF a.path[i + 1] <> c.spath[i + 1]]), least(length(a.path), length(c.spath))) DESC, c.spath, c.sid) AS INT) AS rank
  FROM amb a JOIN cand c ON c.name = a.name AND c.family = a.family) WHERE rank <= 5),
t1 AS (SELECT owner AS src, sid AS dst, kind, 2 AS confidence, line, file_id AS src_file, file_id AS dst_file FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(start_line - line), sid) AS rn FROM (
    SELECT l.*, c.sid, c.start_line, c.qualified, c.parent FROM loaded l JOIN cand c ON c.name = l.name AND c.sfile = l.file_id WHERE l.nsame > 0)
  WHERE (excl = 0 OR sid <> owner) AND (recv IS NULL OR {_TYPE} OR {_place('path')})) WHERE rn <= 4),
t2 AS (SELECT owner, sid, kind, CASE WHEN recv IS NULL OR hint = sid THEN 1 ELSE 0 END, line, file_id, sfile
  FROM told t JOIN cand c ON c.name = t.name AND c.family = t.family WHERE nsame = 0 AND cnt = 1 AND (excl = 0 OR sid <> owner)),
t3 AS (SELECT owner, hint, kind, 1, line, t.file_id, sfile FROM told t JOIN cand c ON c.sid = t.hint WHERE nsame = 0 AND cnt >= 2),
t4 AS (SELECT owner, sid, kind, 0, line, file_id, sfile FROM (
  SELECT t.*, p.sid, p.sfile, row_number() OVER (PARTITION BY t.id ORDER BY p.rank) AS rn FROM told t JOIN picks p ON p.name = t.name AND p.family = t.family AND p.file_id = t.file_id
  WHERE nsame = 0 AND cnt >= 2 AND hint IS NULL AND (excl = 0 OR sid <> owner)) WHERE rn <= 4),
edges AS (SELECT src, dst, kind, CAST(max(confidence) AS INT) AS confidence, min(line) AS line, min(src_file) AS src_file, min(dst_file) AS dst_file FROM (
  SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3 UNION ALL SELECT * FROM t4) GROUP BY src, dst, kind)
"""

SQL = {
    "j2_refs_in_files": "SELECT DISTINCT rid AS id, r.name, f.family, f.path FROM tmp_refs r JOIN files f ON f.file_id = r.file_id WHERE owner IS NOT NULL",
    "j3_same_file": BASE + "SELECT r.id, s.id AS sid FROM r JOIN s ON s.name = r.name AND s.file_id = r.file_id WHERE s.id <> r.owner",
    "j4_unique_in_family": BASE + "SELECT DISTINCT l.name, l.family, sid, sfile FROM loaded l JOIN cand c ON c.name = l.name AND c.family = l.family WHERE nsame = 0 AND cnt = 1",
    "j5_hints": BASE + "SELECT id, hint FROM hint",
    "j6_picks": BASE + "SELECT t.id, p.rank, p.sid FROM told t JOIN picks p ON p.name = t.name AND p.family = t.family AND p.file_id = t.file_id WHERE nsame = 0 AND cnt >= 2 AND hint IS NULL",
    "j7_parents": BASE + "SELECT s.id, s.name, p.name AS parent_name FROM s LEFT JOIN s p ON p.id = s.parent_id",
    "j8_counts": BASE + "SELECT id, nsame, cnt FROM loaded",
    "a1_names": BASE + "SELECT name, family, n AS cnt FROM names",
    "w1_nearest": BASE + "SELECT src, dst, kind, line FROM t1",
    "w3_shared_path": BASE + "SELECT * FROM picks",
    "w4_ordinals": "SELECT id, CAST(row_number() OVER (PARTITION BY file_id, qualified_name, kind ORDER BY seq, id) - 1 AS INT) AS nth FROM (SELECT DISTINCT id, file_id, qualified_name, kind, seq FROM symbols)",
    "g10_edges": BASE + "SELECT * FROM edges",
    "a2_edge_tiers": BASE + "SELECT kind, confidence, count(*) AS edges, min(line) AS first_line FROM edges GROUP BY 1, 2",
    "inv_p8_names_type": BASE + f"SELECT a.name, a.family, recv, sid FROM (SELECT DISTINCT name, family, recv FROM loaded WHERE recv <> '') a JOIN cand c ON c.name = a.name AND c.family = a.family WHERE {_TYPE.replace('|| name', '|| a.name')}",
    "inv_p9_names_place": BASE + f"SELECT a.name, a.family, recv, sid FROM (SELECT DISTINCT name, family, recv FROM loaded WHERE recv <> '') a JOIN cand c ON c.name = a.name AND c.family = a.family WHERE {_place('spath')}",
    "inv_p10_no_self": BASE + "SELECT r.id, CASE WHEN recv IS NOT NULL AND recv NOT IN ('self', 'this', 'Self', 'cls', '$this', 'static') THEN 1 ELSE 0 END AS no_self FROM r JOIN s ON s.id = r.owner AND s.name = r.name",
    "f5_receivers": "SELECT DISTINCT rid AS id, CASE WHEN recv IN ('self', 'this', 'cls', 'static') THEN NULL ELSE lower(recv) END AS word FROM tmp_refs",
    "st3_touching": BASE + "SELECT * FROM edges",
}

#: The same over references that point, from names of one word.
POINTED = BASE.replace("WITH s AS (SELECT DISTINCT id, file_id, name, qualified_name, start_line, parent_id FROM symbols),", """WITH s AS (SELECT id, file_id, CASE WHEN short = '' THEN name ELSE lower(short) END AS name, qualified_name, start_line, parent_id FROM (
  SELECT DISTINCT id, file_id, name, regexp_extract(name, '([A-Z]?[a-z]+)[^a-z]*$', 1) AS short, qualified_name, start_line, parent_id FROM symbols)),""").replace(
    "r AS (SELECT DISTINCT rid AS id, file_id, owner, name, kind, line, excl, recv FROM tmp_refs),", """nxt AS (SELECT file_id, path, lead(file_id) OVER (PARTITION BY family ORDER BY file_id) AS next_file FROM files),
r AS (SELECT s.id, next_file AS file_id, s.parent_id AS owner, s.name, 'calls' AS kind, s.start_line + 1 AS line, (s.id % 5 = 0)::INT AS excl,
  CASE s.id % 5 WHEN 0 THEN lower(p.name) WHEN 1 THEN lower(string_split(string_split(path, '/')[-1], '.')[1]) WHEN 2 THEN lower(string_split(path, '/')[1]) WHEN 3 THEN lower(p.name) || 's' END AS recv
  FROM s LEFT JOIN s p ON p.id = s.parent_id JOIN nxt ON nxt.file_id = s.file_id WHERE next_file IS NOT NULL AND s.parent_id IS NOT NULL),""")
SQL |= {
    "j5_pointed": POINTED + "SELECT id, hint FROM hint", "j8_pointed": POINTED + "SELECT id, nsame, cnt FROM loaded", "g10_pointed": POINTED + "SELECT * FROM edges",
    "inv_p8_pointed": POINTED + f"SELECT a.name, a.family, recv, sid FROM (SELECT DISTINCT name, family, recv FROM loaded WHERE recv <> '') a JOIN cand c ON c.name = a.name AND c.family = a.family WHERE {_TYPE.replace('|| name', '|| a.name')}",
    "inv_p9_pointed": POINTED + f"SELECT a.name, a.family, recv, sid FROM (SELECT DISTINCT name, family, recv FROM loaded WHERE recv <> '') a JOIN cand c ON c.name = a.name AND c.family = a.family WHERE {_place('spath')}",
}
