"""Queries of use cases: learning, memories, packing, recall and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symvane import views
from symvane.functions import scoring as sc
from symvane.operators import graph as g
from symvane.operators import learning as ln
from symvane.operators import memory as mem
from symvane.operators import search as s
from symvane.plans import capsule as cp
from symvane.plans import recall as rc
from symvane.runtime import cut, table

NOW = 1_767_225_600


def l1_utility(spark: SparkSession, d: str) -> DataFrame:
    """Learned state of every target."""
    return ln.utility(views.signals(spark, d)).select("target_id", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"), "updated_at")


def l1_multipliers(spark: SparkSession, d: str) -> DataFrame:
    return ln.multipliers(ln.utility(views.signals(spark, d)), F.lit(1_706_745_600)).select("target_id", F.round("multiplier", 6).alias("multiplier"))


def a13_status(spark: SparkSession, d: str) -> DataFrame:
    sig = views.signals(spark, d)
    return ln.status(ln.utility(sig), sig, ln.coaccess(views.together(spark, d)))


def a14_usage(spark: SparkSession, d: str) -> DataFrame:
    """Usage by kind of event: counts, sums, whole averages and percents."""
    e = table(spark, d, "events").filter("value IS NOT NULL").select("event_type", F.floor("value").cast("bigint").alias("used"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("used").alias("used")).select("*", F.expr("used div n").alias("average"), F.expr("100 * used div (n * 1000)").alias("percent"))


def l2_ignored(spark: SparkSession, d: str) -> DataFrame:
    """Events as showings: a user is a session, a view shows its event's day."""
    e = table(spark, d, "events").select(F.col("event_type").alias("session"), F.col("user_id").alias("target_id"), F.unix_timestamp("ts").alias("at"), F.lit(1).alias("level"), (F.col("value") > 80).alias("expanded"))
    return ln.ignored(e)


def l3_together(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("session"), F.col("user_id").alias("target_id"), F.unix_timestamp("ts").alias("at"))
    return ln.expanded_together(e).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def l4_coaccess(spark: SparkSession, d: str) -> DataFrame:
    """Weights of pairs of parts ordered together."""
    return ln.coaccess(views.together(spark, d)).select("a", "b", F.round("weight", 6).alias("weight"), "updated_at")


def o4_partners(spark: SparkSession, d: str) -> DataFrame:
    """The four strongest partners of every part."""
    return ln.partners(ln.coaccess(views.together(spark, d)), F.lit(NOW), 4).select("id", "partner", F.round("weight", 6).alias("weight"), "rank")


def j18_boosts(spark: SparkSession, d: str) -> DataFrame:
    """Parts with what was learned of the user of the same number, 1 where nothing was."""
    state = ln.multipliers(ln.utility(views.signals(spark, d)), F.lit(1_706_745_600)).select(F.col("target_id").alias("id"), "multiplier")
    return views.parts(spark, d).select("id").join(state, "id", "left").select("id", F.round(F.coalesce("multiplier", F.lit(1.0)), 6).alias("multiplier"))


def m6_stale(spark: SparkSession, d: str) -> DataFrame:
    """Memories whose symbol changed, went or stayed."""
    sym = views.symbols(spark, d, "file_id", "qualified_name", "start_line", "sig_hash", "body_hash").join(views.files(spark, d).select("file_id", "path"), "file_id").drop("file_id")
    return mem.staleness(views.memories(spark, d), views.anchors(spark, d), sym)


def m5_reanchor(spark: SparkSession, d: str) -> DataFrame:
    sym = views.symbols(spark, d, "file_id", "qualified_name", "start_line", "sig_hash", "body_hash").join(views.files(spark, d).select("file_id", "path"), "file_id").drop("file_id")
    return mem.reanchor(views.anchors(spark, d), sym).select("memory_id", "symbol_id", "sig_hash", "body_hash")


def m3_corroborate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("memory_id"), F.when(F.col("event_type") == "error", "tool").otherwise("agent").alias("provenance"), F.unix_timestamp("ts").alias("at"))
    return mem.corroborations(e)


def j19_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of memories of one kind about one place: here symbols of one file stand for one anchor."""
    a = views.anchors(spark, d).select("memory_id", F.xxhash64("path", "qualified_name").alias("symbol_id"))
    parent = views.anchors(spark, d).select("memory_id", F.xxhash64("path", F.regexp_replace("qualified_name", r"(::|\.)[^.:]+$", "")).alias("symbol_id"))
    return mem.anchored_pairs(views.memories(spark, d), a.unionByName(parent))


def m1_compare(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of comparing every pair of memories about one place."""
    return mem.compare(cut(j19_pairs(spark, d)), views.memories(spark, d)).select("left_id", "right_id", "outcome", "reason", F.round("similarity", 6).alias("similarity"))


def m1_admitted(spark: SparkSession, d: str) -> DataFrame:
    """Memories as they would be kept, with the guard's reasons."""
    return mem.admitted(views.memories(spark, d)).select("id", "kind", F.array_join("reasons", ",").alias("reasons"))


def _tables(spark: SparkSession, d: str) -> rc.Tables:
    sym = views.symbols(spark, d, "file_id", "name", "qualified_name", "signature", "doc", "outline", "visibility", "start_line", "pagerank").join(views.files(spark, d).select("file_id", "path"), "file_id")
    return rc.Tables(cut(sym), s.index_of(s.postings(sym, "id", s.WEIGHTS, s.COLUMN_BYTES)), cut(views.edges(spark, d)))


QUESTIONS = [(1, "sealBucket", 500), (2, "write the frozen journal", 1000), (3, "which caller must hold the lock", 1000), (4, "parse token tree", 2000), (5, "tabla registro", 500)]


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id int, text string, budget int")


def e1_recall(spark: SparkSession, d: str) -> DataFrame:
    """Five questions answered under their budgets, in one job."""
    return rc.recall(_tables(spark, d), _questions(spark)).select("query_id", "id", "level", "tokens", F.round("relevance", 6).alias("relevance"))


def e1_capsules(spark: SparkSession, d: str) -> DataFrame:
    """Capsules of five questions, with memories: their sizes."""
    t = _tables(spark, d)
    found = cut(rc.ranked(t, _questions(spark)))
    notes = views.memories(spark, d).select("id", "text")
    hits = s.strict_or_any(s.postings(notes, "id", {"text": 1.0}, s.MEMORY_BYTES), s.query_terms(_questions(spark), "query_id", "text"), cp.BY_TEXT)
    known = cp.memory_candidates(found, views.anchors(spark, d).select("memory_id", "symbol_id"), notes, hits)
    return cp.capsules(found, t.symbols, _questions(spark), known).select("query_id", "used", "symbols", "memories")


def f25_costs(spark: SparkSession, d: str) -> DataFrame:
    """Cost of every symbol at every level of detail."""
    sym = views.symbols(spark, d, "name", "signature", "doc", "outline")
    return rc.options(sym.select(F.lit(1).alias("query_id"), "id", F.lit(1.0).alias("relevance")), sym).select("id", "level", "tokens")


def e5_brief(spark: SparkSession, d: str) -> DataFrame:
    """A brief in 300 tokens: (section, id, text)."""
    central = table(spark, d, "hotspots").filter("callers IS NOT NULL").distinct().orderBy(F.col("callers").desc(), "id").limit(40).select("id", F.concat("name", F.lit(" "), "path").alias("text"))
    mods = g.modules(views.files(spark, d), 1).groupBy("module").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "module").limit(20).select(F.xxhash64("module").alias("id"), F.concat("module", F.lit(" files "), F.col("n").cast("string")).alias("text"))
    rows = rc.brief({"central": central, "modules": mods}, 300)
    return spark.createDataFrame([(k, r[0], r[1]) for k, rs in rows.items() for r in rs], "section string, id bigint, text string")


def o3_candidates(spark: SparkSession, d: str) -> DataFrame:
    return rc.ranked(_tables(spark, d), _questions(spark)).select("query_id", "id", F.round("relevance", 6).alias("relevance"), "reason")


def e2_expand(spark: SparkSession, d: str) -> DataFrame:
    """Lines 3 to 40 of every document, as far as 200 tokens go."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    return rc.expand(docs, 3, 40, tokens=200).select("id", "shown", "has_more")


def e3_outline(spark: SparkSession, d: str) -> DataFrame:
    """Detail at which the outline of each file fits 600 tokens."""
    rows = table(spark, d, "outline_rows").select("path", "id", "name", "signature", "doc").distinct()
    return rc.outline(rows, rows.select("path").distinct().withColumn("budget", F.lit(600)))


def e4_map(spark: SparkSession, d: str) -> DataFrame:
    """The repository in 2000 tokens."""
    names = views.symbols(spark, d, "file_id", "name", "start_line").groupBy("file_id").agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("start_line", "name"))), 1, 8), lambda x: x["name"]).alias("names"))
    refs = table(spark, d, "hotspots").filter("callers IS NOT NULL").distinct().groupBy("path").agg((1 + F.sum("callers")).alias("score"))
    scores = refs.select("path", (1 + F.log("score")).alias("relevance"))
    files = views.files(spark, d).select("file_id", "path", "symbol_count").join(names, "file_id")
    return rc.file_map(scores, files, 2000).select("id", "level", "tokens")


def e7_names(spark: SparkSession, d: str) -> DataFrame:
    """What every shared owner's, heavy reference's and hotspot's name means."""
    sym = views.symbols(spark, d, "file_id", "name", "qualified_name").join(views.files(spark, d).select("file_id", "path"), "file_id")
    asked = table(spark, d, "hotspots").select(F.col("id").alias("query_id"), "name").distinct()
    return rc.resolve_symbol(sym, asked)


def e8_doc_gaps(spark: SparkSession, d: str) -> DataFrame:
    """The two thousand most used public symbols without documentation."""
    sym = views.symbols(spark, d, "file_id", "doc", "visibility", "start_line").join(views.files(spark, d).select("file_id", "path"), "file_id")
    deg = table(spark, d, "hotspots").filter("callers IS NOT NULL").select("id", F.col("callers").alias("degree")).distinct()
    return rc.doc_gaps(sym, deg, 2000)


def e10_bench(spark: SparkSession, d: str) -> DataFrame:
    """Recall on a hundred known items, by description and by name, under three budgets, beside reading three whole files."""
    t = _tables(spark, d)
    tasks = rc.known_item_tasks(t.symbols, 100, 7, 0).withColumn("budget", F.explode(F.array(F.lit(500), F.lit(1000), F.lit(2000))))
    tasks = cut(tasks.withColumn("query_id", F.col("budget") * 2_000_000_000_000_000 + F.col("query_id")))  # ids stay apart by budget, and even or odd
    piece = F.concat_ws("\n", "signature", F.coalesce("doc", F.lit("")))
    files = t.symbols.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "id", piece.alias("p")))), lambda x: x["p"]), "\n").alias("text"))
    return rc.bench(t, tasks, rc.baseline_arm(tasks, cut(files), t.symbols))


def e1_learned(spark: SparkSession, d: str) -> DataFrame:
    """Five questions answered with learned state, symbols used together and sources, and the certain relations among each answer's symbols."""
    t = _tables(spark, d)
    users = 150
    state = ln.multipliers(ln.utility(views.signals(spark, d)), F.lit(1_706_745_600)).withColumn("k", F.pmod("target_id", F.lit(users)))
    t.state = t.symbols.select(F.col("id").alias("target_id"), F.pmod("id", F.lit(users)).alias("k")).join(state.groupBy("k").agg(F.max("multiplier").alias("multiplier")), "k").drop("k")
    t.pairs = ln.partners(t.edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("weight"), F.lit(0).cast("bigint").alias("updated_at")), F.lit(0), rc.PARTNERS)
    t.sources = t.symbols.select("id", F.concat_ws("\n", "signature", "doc").alias("source"))
    got = cut(rc.recall(t, _questions(spark)))
    told = got.select("query_id", F.lit("symbol").alias("what"), "id", F.col("level").cast("bigint").alias("n"), "reason")
    return told.unionByName(rc.relations(got, t.edges).select("query_id", F.lit("relation").alias("what"), F.col("src").alias("id"), F.col("dst").alias("n"), F.col("kind").alias("reason")))


def m1_remember(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of every stored comment's oldest version when it is told again: stored, reinforced, a duplicate, a conflict or refused."""
    notes, anchors = views.memories(spark, d), views.anchors(spark, d).select("memory_id", "symbol_id")
    first = table(spark, d, "old_symbols").filter(F.length(F.trim("doc")) > 0).groupBy("id").agg(F.min(F.struct("stored_at", "doc")).alias("r")).select((-F.col("id")).alias("id"), F.col("r.doc").alias("text"))
    kinds = notes.select((-F.col("id")).alias("id"), "kind")
    told = mem.remember(first.join(kinds, "id"), anchors.select((-F.col("memory_id")).alias("memory_id"), "symbol_id"), notes, anchors)
    return told.groupBy("outcome").agg(F.count(F.lit(1)).alias("notes"))


def e6_insights(spark: SparkSession, d: str) -> DataFrame:
    """Rows of all report sections in one table: (section, key, n)."""
    lang = views.files(spark, d).groupBy(F.col("language").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("languages").alias("section"), "key", "n")
    mods = g.modules(views.files(spark, d), 1).groupBy(F.col("module").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("modules").alias("section"), "key", "n")
    spots = table(spark, d, "hotspots").distinct().filter("callers >= 10").select(F.lit("hotspots").alias("section"), F.col("id").cast("string").alias("key"), F.col("callers").cast("bigint").alias("n"))
    runs = table(spark, d, "upsert_plans").distinct().groupBy(F.coalesce("outcome", F.lit("never ended")).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("runs").alias("section"), "key", "n")
    return lang.unionByName(mods).unionByName(spots).unionByName(runs)


QUERIES = {f.__name__: f for f in (l1_utility, l1_multipliers, a13_status, a14_usage, l2_ignored, l3_together, l4_coaccess, o4_partners, j18_boosts, m6_stale, m5_reanchor, m3_corroborate, j19_pairs, m1_compare, m1_admitted, o3_candidates, e1_recall, e1_capsules, f25_costs, e5_brief, e2_expand, e3_outline, e4_map, e6_insights, e7_names, e8_doc_gaps, e10_bench, e1_learned, m1_remember)}

_SIG = "sig AS (SELECT event_id AS id, user_id AS t, floor(epoch(ts))::BIGINT AS s0, CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 2.0 ELSE 0.0 END AS da, CASE event_type WHEN 'signup' THEN 0.25 WHEN 'error' THEN 1.5 WHEN 'purchase' THEN 2.0 ELSE 0.0 END AS db FROM events), lst AS (SELECT t, max(s0) AS u FROM sig GROUP BY 1), st AS (SELECT sig.t, sum(da * pow(0.5, (u - s0) / 2592000.0)) AS alpha, sum(db * pow(0.5, (u - s0) / 2592000.0)) AS beta, max(u) AS u FROM sig JOIN lst ON lst.t = sig.t GROUP BY 1), sh AS (SELECT t, CASE WHEN 1706745600 <= u THEN 1 ELSE pow(0.5, (1706745600 - u) / 2592000.0) END AS k, alpha, beta FROM st), mu AS (SELECT t, CASE WHEN (alpha + beta) * k < 0.05 THEN 1 ELSE least(greatest(1 + 0.5 * (2 * (1 + alpha * k) / (2 + (alpha + beta) * k) - 1) * (alpha + beta) * k / ((alpha + beta) * k + 4), 0.5), 1.5) END AS m FROM sh)"
_TOG = "tog AS (SELECT x.l_partkey AS a, y.l_partkey AS b, floor(epoch(o_orderdate))::BIGINT AS s0 FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) x JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey JOIN orders ON o_orderkey = x.l_orderkey), tl AS (SELECT a, b, max(s0) AS u FROM tog GROUP BY 1, 2), co AS (SELECT tog.a, tog.b, sum(pow(0.5, (u - s0) / 2592000.0)) AS w, max(u) AS u FROM tog JOIN tl ON tl.a = tog.a AND tl.b = tog.b GROUP BY 1, 2)"
_MEM = "old AS (SELECT * FROM old_symbols WHERE length(trim(doc, ' ')) > 0), lr AS (SELECT o.*, f.path FROM (SELECT * FROM old QUALIFY row_number() OVER (PARTITION BY id ORDER BY stored_at DESC, doc DESC) = 1) o JOIN files f ON f.file_id = o.file_id), s AS (SELECT DISTINCT s.id, f.path, s.qualified_name, s.start_line, s.sig_hash, s.body_hash FROM symbols s JOIN files f ON f.file_id = s.file_id), fs AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY path, qualified_name ORDER BY start_line, id) = 1)"

SQL = {
    "l1_utility": f"WITH {_SIG} SELECT t AS target_id, round(alpha, 6) AS alpha, round(beta, 6) AS beta, u AS updated_at FROM st",
    "l1_multipliers": f"WITH {_SIG} SELECT t AS target_id, round(m, 6) AS multiplier FROM mu",
    "a13_status": f"WITH {_SIG}, {_TOG} SELECT 'targets' AS what, count(*) AS n FROM st UNION ALL SELECT 'signals', count(*) FROM sig UNION ALL SELECT 'pairs', count(*) FROM co",
    "a14_usage": "WITH e AS (SELECT event_type, floor(value)::BIGINT AS used FROM events WHERE value IS NOT NULL) SELECT event_type, count(*) AS n, sum(used)::BIGINT AS used, (sum(used) // count(*))::BIGINT AS average, (100 * sum(used) // (count(*) * 1000))::BIGINT AS percent FROM e GROUP BY 1",
    "l4_coaccess": f"WITH {_TOG} SELECT a, b, round(w, 6) AS weight, u AS updated_at FROM co",
    "o4_partners": f"WITH {_TOG}, d AS (SELECT a, b, w * CASE WHEN {NOW} <= u THEN 1 ELSE pow(0.5, ({NOW} - u) / 2592000.0) END AS w FROM co), b2 AS (SELECT a AS id, b AS partner, w FROM d UNION ALL SELECT b, a, w FROM d) SELECT id, partner, round(w, 6) AS weight, CAST(row_number() OVER (PARTITION BY id ORDER BY round(w, 9) DESC, partner) AS INT) AS rank FROM b2 QUALIFY rank <= 4",
    "j18_boosts": f"WITH {_SIG} SELECT p_partkey AS id, round(coalesce(m, 1), 6) AS multiplier FROM part LEFT JOIN mu ON t = p_partkey",
    "l2_ignored": "WITH e AS (SELECT event_type AS session, user_id AS target_id, floor(epoch(ts))::BIGINT AS s0, value > 80 AS ex FROM events), n AS (SELECT session, s0, lead(s0) OVER (PARTITION BY session ORDER BY s0) AS nx FROM (SELECT DISTINCT session, s0 FROM e)) SELECT e.session, e.target_id, nx AS at FROM e JOIN n ON n.session = e.session AND n.s0 = e.s0 WHERE NOT ex AND nx - e.s0 < 1800 QUALIFY row_number() OVER (PARTITION BY e.session, e.s0 ORDER BY target_id) <= 20",
    "m6_stale": f"WITH {_MEM} SELECT lr.id AS memory_id, CASE WHEN s.id IS NULL AND fs.id IS NULL THEN 'symbol_deleted' WHEN coalesce(s.sig_hash, fs.sig_hash) <> lr.sig_hash THEN 'signature_changed' ELSE 'body_changed' END AS stale_reason FROM lr LEFT JOIN s ON s.id = lr.id LEFT JOIN fs ON fs.path = lr.path AND fs.qualified_name = lr.qualified_name WHERE s.id IS NULL AND fs.id IS NULL OR coalesce(s.sig_hash, fs.sig_hash) <> lr.sig_hash OR coalesce(s.body_hash, fs.body_hash) <> lr.body_hash",
    "m5_reanchor": f"WITH {_MEM} SELECT lr.id AS memory_id, coalesce(s.id, fs.id) AS symbol_id, coalesce(s.sig_hash, fs.sig_hash, lr.sig_hash) AS sig_hash, coalesce(s.body_hash, fs.body_hash, lr.body_hash) AS body_hash FROM lr LEFT JOIN s ON s.id = lr.id LEFT JOIN fs ON fs.path = lr.path AND fs.qualified_name = lr.qualified_name",
    "e6_insights": "SELECT 'languages' AS section, language AS key, count(*) AS n FROM files GROUP BY 2 UNION ALL SELECT 'modules', CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '.' END, count(*) FROM files GROUP BY 2 UNION ALL SELECT 'hotspots', id::VARCHAR, callers FROM (SELECT DISTINCT * FROM hotspots) WHERE callers >= 10 UNION ALL SELECT 'runs', coalesce(outcome, 'never ended'), count(*) FROM (SELECT DISTINCT * FROM upsert_plans) GROUP BY 2",
    "e7_names": """WITH s AS (SELECT DISTINCT s.id, s.name, s.qualified_name FROM symbols s), q AS (SELECT DISTINCT id AS query_id, name FROM hotspots),
      h AS (SELECT query_id, s.id, max((q.name = qualified_name)::INT) AS ex FROM q JOIN s ON lower(s.name) = lower(q.name) OR s.qualified_name = q.name GROUP BY 1, 2), w AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, sum(ex) OVER (PARTITION BY query_id) AS e FROM h)
      SELECT query_id, id, CASE WHEN n = 1 OR e = 1 THEN 'found' ELSE 'ambiguous' END AS verdict FROM w WHERE n = 1 OR e <> 1 OR ex = 1 UNION ALL SELECT query_id, NULL, 'unknown' FROM q WHERE query_id NOT IN (SELECT query_id FROM h)""",
    "e8_doc_gaps": r"SELECT s.id, path, coalesce(callers, 0) AS degree FROM (SELECT DISTINCT id, file_id, start_line FROM symbols WHERE visibility = 'public' AND trim(coalesce(doc, ''), E' \t\r\n') = '') s JOIN files f ON f.file_id = s.file_id LEFT JOIN (SELECT DISTINCT id, callers FROM hotspots WHERE callers IS NOT NULL) h ON h.id = s.id ORDER BY degree DESC, path, start_line, s.id LIMIT 2000",
}


def _tokens(x: str) -> str:
    """The token estimate in DuckDB."""
    return rf"""(CASE WHEN {x} = '' THEN 0 ELSE greatest(round(0.4878 * len(regexp_extract_all({x}, '[0-9]')) + 0.2783 * len(regexp_extract_all({x}, '[A-Za-z0-9_]+'))
      + 0.8258 * len(regexp_extract_all(regexp_replace({x}, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[0-9]+|[A-Z]+[a-z]*|[a-z]+')) + 0.402 * len(regexp_extract_all({x}, '[!-/:-@\[-^`{{-~\x00-\x08\x0b\x0e-\x1f\x7f]'))
      + 1.7999 * len(regexp_extract_all({x}, '\n')) + 0.8308 * len(regexp_extract_all({x}, '[^\x00-\x7f]')))::INT, 1) END)"""


SQL["e3_outline"] = f"""WITH r AS (SELECT DISTINCT path, id, name, signature, doc FROM outline_rows),
c AS (SELECT path, sum(9 + {_tokens("signature")} + CASE WHEN doc = '' THEN 0 ELSE {_tokens("doc")} END)::BIGINT AS d, sum(9 + {_tokens("signature")})::BIGINT AS s, sum({_tokens("name")} + 1)::BIGINT AS n FROM r GROUP BY 1),
x AS (SELECT path, CASE WHEN d <= 600 THEN 'documented' WHEN s <= 600 THEN 'signature' ELSE 'name' END AS detail, CASE WHEN d <= 600 THEN d WHEN s <= 600 THEN s ELSE n END AS tokens FROM c)
SELECT path, detail, tokens, tokens <= 600 AS fits FROM x"""
SQL["j19_pairs"] = rf"""WITH {_MEM}, m AS (SELECT id, path, qualified_name AS q, CASE WHEN kind IN ('function', 'method') THEN 'fact' WHEN kind IN ('class', 'struct', 'interface') THEN 'decision' WHEN kind = 'module' THEN 'convention' ELSE 'lesson' END AS k FROM lr),
a AS (SELECT DISTINCT * FROM (SELECT id, k, path, q AS place FROM m UNION ALL SELECT id, k, path, regexp_replace(q, '(::|\.)[^.:]+$', '') FROM m))
SELECT DISTINCT x.id AS left_id, y.id AS right_id, x.k AS kind FROM a x JOIN a y ON x.path = y.path AND x.place = y.place AND x.k = y.k AND x.id < y.id"""
