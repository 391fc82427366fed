"""Queries of sources, sinks and streams (S1-S11, K1, K2, K3, K6, K7, ST1, ST2, ST5)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symvane import views
from symvane.queries.plans import e6_insights
from symvane.runtime import scratch_dir, table
from symvane.sources import extract as ex
from symvane.sources import records as rd
from symvane.sources import toon
from symvane.sources.tree import list_files, read_files, slices
from symvane.streaming import signals as st

#: The source tree that the scan queries read: this package.
HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Parts of a path's entries.
ENTRY_PARTS = 16


def s1_tree(spark: SparkSession, d: str) -> DataFrame:
    """Files of a source tree."""
    return list_files(spark, HERE)


def s2_contents(spark: SparkSession, d: str) -> DataFrame:
    return read_files(spark, HERE)[0].select("path", F.length("text").alias("chars"))


def s4_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of this package by Python's parser."""
    texts = read_files(spark, HERE)[0].join(list_files(spark, HERE).select("path", "language"), "path")
    return ex.symbol_rows(texts).select("path", "qualified_name", "kind", "start_line", "end_line", "visibility")


def s4_refs(spark: SparkSession, d: str) -> DataFrame:
    texts = read_files(spark, HERE)[0].join(list_files(spark, HERE).select("path", "language"), "path")
    return ex.ref_rows(texts).groupBy("kind").agg(F.count(F.lit(1)).alias("refs"))


def s5_lexical(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of signatures, set as sources of their language."""
    rows = views.symbols(spark, d, "file_id", "signature", "kind").filter("kind IN ('function', 'method', 'struct', 'class', 'enum', 'trait', 'interface')").join(views.files(spark, d).select("file_id", "language"), "file_id")
    texts = rows.select(F.col("id").cast("string").alias("path"), "language", F.concat("signature", F.lit(" {\n}\n")).alias("text"))
    return ex.symbol_rows(texts).select("path", "name", "kind")


#: Languages that are read by token rules.
GRAMMARS = ("rust", "javascript", "typescript", "go", "java", "csharp", "c", "cpp", "php")


def s4_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions found in sources made of every file's documented signatures with bodies that call the name before, by language."""
    order = Window.partitionBy("file_id").orderBy("seq", "id")
    rows = views.symbols(spark, d, "file_id", "seq", "name", "signature", "kind").filter("kind IN ('function', 'method')").join(views.files(spark, d).select("file_id", "language").filter(F.col("language").isin(*GRAMMARS)), "file_id")
    rows = rows.withColumn("before", F.lag("name").over(order)).withColumn("block", F.floor((F.row_number().over(order) - 1) / rd.MOST_ENTRIES))  # a huge file as several texts
    call = F.when(F.col("before").isNotNull(), F.concat(F.lit("  if (x > 1) { "), F.col("before"), F.lit("(x); }\n"))).otherwise("")
    piece = F.concat(F.lit("// Said of it: { (\n"), "signature", F.lit(" {\n"), call, F.lit("}\n"))
    whole = rows.groupBy("file_id", "language", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id", piece.alias("p")))), lambda x: x["p"]), "").alias("body"))
    text = F.when(F.col("language").isin("java", "csharp"), F.concat(F.lit("class Holder {\n"), "body", F.lit("}\n"))).otherwise(F.col("body"))
    path = F.concat_ws("/", "file_id", "block")
    found = ex.symbol_rows(whole.select(path.alias("path"), "language", text.alias("text"))).filter("kind IN ('function', 'method')")
    return found.select(F.split("path", "/")[0].cast("bigint").alias("file_id"), "name", F.coalesce(F.try_element_at("outline", F.lit(1)), F.lit("")).alias("calls"), (F.col("doc") == "Said of it: { (").alias("documented"))


def s9_slices(spark: SparkSession, d: str) -> DataFrame:
    """Halves of documents by byte offsets, only where the hash still holds and no character is cut in two."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    contents = docs.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), F.md5("text").alias("hash"))
    files = docs.select(F.col("doc_id").alias("file_id"), F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_kind") == "note", F.md5("text")).otherwise("old").alias("hash"))
    half = F.floor(F.octet_length("text") / 2).cast("int")
    symbols = docs.select(F.col("doc_id").alias("file_id"), F.explode(F.array(F.struct((F.col("doc_id") * 2).alias("id"), F.lit(0).alias("start_byte"), half.alias("end_byte")), F.struct((F.col("doc_id") * 2 + 1).alias("id"), half.alias("start_byte"), F.octet_length("text").alias("end_byte")))).alias("s")).select("file_id", "s.*")
    return slices(symbols, files, contents)


def s10_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Usage read back from lines of JSON, some of them broken."""
    path = f"{scratch_dir(spark)}/symvane-metrics-{os.getpid()}-{abs(hash(d))}"
    e = table(spark, d, "events").select(F.when(F.col("event_type") == "view", F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("event_type").alias("kind"), F.floor(F.coalesce("value", F.lit(0.0))).cast("bigint").alias("used"), F.lit(1000).alias("budget")))).alias("value"))
    e.write.mode("overwrite").text(path)
    return rd.usage(rd.read_metrics(spark, path))


def s11_entries(spark: SparkSession, d: str) -> DataFrame:
    """Documentation entries of every file, from JSON."""
    # a text holds at most MOST_ENTRIES entries, so a path has several; parts keep a hot path from one task
    parted = table(spark, d, "outline_rows").select("path", "name", "doc").distinct().withColumn("part", F.pmod(F.xxhash64("name", "doc"), F.lit(ENTRY_PARTS)))
    order = Window.partitionBy("path", "part").orderBy("name", "doc")
    numbered = parted.withColumn("block", F.floor((F.row_number().over(order) - 1) / rd.MOST_ENTRIES))
    rows = numbered.groupBy("path", "part", "block").agg(F.to_json(F.collect_list(F.struct(F.col("name").alias("symbol"), "doc"))).alias("text"))
    return rd.read_entries(rows).groupBy("symbol").agg(F.count(F.lit(1)).alias("entries"))


def k1_toon(spark: SparkSession, d: str) -> DataFrame:
    """Outline rows of every file as TOON, read back: both must be equal."""
    rows = table(spark, d, "outline_rows").distinct().groupBy("path").agg(F.to_json(F.sort_array(F.collect_list(F.struct("line", "id", "name", "signature", "doc")))).alias("j"))
    made = rows.select("path", "j", toon.to_toon(F.col("j")).alias("t"))
    back = made.select("path", "j", "t", toon.from_toon(F.col("t")).alias("b"))
    form = "array<struct<line:int,id:bigint,name:string,signature:string,doc:string>>"
    return back.select("path", F.size(F.from_json("b", form)).alias("rows"), (F.to_json(F.from_json("b", form)) == F.to_json(F.from_json("j", form))).alias("same"))


def k2_json(spark: SparkSession, d: str) -> DataFrame:
    return rd.as_json(views.files(spark, d).select("file_id", "path", "lines"))


def k3_report(spark: SparkSession, d: str) -> DataFrame:
    return rd.report(e6_insights(spark, d))


def k3_html(spark: SparkSession, d: str) -> DataFrame:
    return rd.report_html(e6_insights(spark, d))


def k2_text(spark: SparkSession, d: str) -> DataFrame:
    return rd.as_text(views.files(spark, d).select("path", "language", "lines"))


def k6_api(spark: SparkSession, d: str) -> DataFrame:
    """Markdown reference of public symbols."""
    sym = views.symbols(spark, d, "file_id", "kind", "qualified_name", "signature", "doc", "visibility", "start_line").join(views.files(spark, d).select("file_id", "path"), "file_id")
    return rd.api_reference(sym)


def k7_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Stored rows with all files of one language replaced by what the extractor sees now."""
    cols = ["id", "file_id", "qualified_name", "kind", "ordinal", "sig_hash", "body_hash"]
    old = table(spark, d, "old_symbols").groupBy("id").agg(F.max(F.struct("stored_at", *cols[1:])).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in cols[1:]])
    fresh = views.symbols(spark, d, *cols[1:]).join(views.files(spark, d).filter("language = 'rust'").select("file_id"), "file_id", "left_semi")
    return rd.upsert(old, fresh.select(*cols), ["id"], "file_id").select("id", "file_id", "sig_hash")


def st1_diff(spark: SparkSession, d: str) -> DataFrame:
    """Stored rows against current ones by place and name."""
    cols = ["id", "file_id", "name", "qualified_name", "kind", "ordinal", "sig_hash", "body_hash"]
    old = table(spark, d, "old_symbols").groupBy("id").agg(F.max(F.struct("stored_at", *cols[1:])).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in cols[1:]])
    return rd.upsert_diff(old, views.symbols(spark, d, *cols[1:])).select("old_id", "new_id", "change")


def st1_dirty(spark: SparkSession, d: str) -> DataFrame:
    cols = ["id", "file_id", "name", "qualified_name", "kind", "ordinal", "sig_hash", "body_hash"]
    old = table(spark, d, "old_symbols").groupBy("id").agg(F.max(F.struct("stored_at", *cols[1:])).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in cols[1:]])
    return rd.dirty_names(rd.upsert_diff(old, views.symbols(spark, d, *cols[1:])), views.files(spark, d), views.refs(spark, d))


def st2_changed(spark: SparkSession, d: str) -> DataFrame:
    """Listed files whose stored hash differs: here those of one family are taken for edited."""
    stored = views.files(spark, d)
    listed = stored.withColumn("hash", F.when(F.col("family") == "go", F.concat("hash", F.lit("+"))).otherwise(F.col("hash")))
    return rd.changed_files(listed.select("path", "hash"), stored)


def st5_stream(spark: SparkSession, d: str) -> DataFrame:
    """Learned state from the event log read as a stream."""
    path = f"{d}/events.parquet"
    src = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if os.path.isdir(path) else f"{d}/events*.parquet")
    kind = F.coalesce(*[F.when(F.col("event_type") == e, s) for e, s in views.SIGNAL_OF.items()])
    sig = src.select(F.lit("symbol").alias("target_kind"), F.col("user_id").alias("target_id"), kind.alias("kind"), F.unix_timestamp("ts").alias("at"))
    rows = st.run_to_table(st.utility_stream(sig), "update")
    last = rows.groupBy("target_id").agg(F.max(F.struct("batch_id", "alpha", "beta", "updated_at")).alias("r"))
    return last.select("target_id", F.round("r.alpha", 6).alias("alpha"), F.round("r.beta", 6).alias("beta"), F.col("r.updated_at").alias("updated_at"))


def st6_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events an hour and kind, from the log read as a stream."""
    path = f"{d}/events.parquet"
    src = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if os.path.isdir(path) else f"{d}/events*.parquet")
    rows = st.run_to_table(st.windowed_counts(src.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind")), "1 hour", "40 days"), "update")
    return rows.groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "kind").agg(F.max_by("n", "batch_id").alias("n"))


QUERIES = {f.__name__: f for f in (s1_tree, s2_contents, s4_symbols, s4_refs, s4_functions, s5_lexical, s9_slices, s10_metrics, s11_entries, k1_toon, k2_json, k2_text, k3_report, k3_html, k6_api, k7_upsert, st1_diff, st1_dirty, st2_changed, st5_stream, st6_windows)}

from symvane.queries.plans import SQL as _PLANS  # noqa: E402
from symvane.queries.search import SQL as _SEARCH  # noqa: E402

_CUR = "c AS (SELECT DISTINCT id, file_id, name, qualified_name, kind, ordinal, sig_hash, body_hash FROM symbols), o AS (SELECT * FROM (SELECT DISTINCT * FROM old_symbols) QUALIFY row_number() OVER (PARTITION BY id ORDER BY stored_at DESC, file_id DESC, name DESC) = 1)"
_DIFF = _CUR + ", diff AS (SELECT o.id AS old_id, c.id AS new_id, coalesce(c.file_id, o.file_id) AS file_id, coalesce(c.name, o.name) AS name, CASE WHEN o.id IS NULL THEN 'added' WHEN c.id IS NULL THEN 'removed' WHEN o.name <> c.name THEN 'renamed' WHEN o.sig_hash <> c.sig_hash OR o.body_hash <> c.body_hash THEN 'modified' ELSE 'kept' END AS change FROM o FULL JOIN c ON o.file_id = c.file_id AND o.qualified_name = c.qualified_name AND o.kind = c.kind AND o.ordinal = c.ordinal)"

SQL = {
    "s4_functions": "WITH s AS (SELECT DISTINCT s.id, s.file_id, s.seq, s.name FROM symbols s JOIN files f ON f.file_id = s.file_id WHERE s.kind IN ('function', 'method') AND f.language IN ('rust', 'javascript', 'typescript', 'go', 'java', 'csharp', 'c', 'cpp', 'php')) SELECT file_id, name, CASE WHEN lag(name) OVER w = name THEN name ELSE coalesce(lag(name) OVER w, '') END AS calls, true AS documented FROM s WINDOW w AS (PARTITION BY file_id ORDER BY seq, id)",
    "s9_slices": """WITH h AS (SELECT doc_id, text, [i FOR i IN range(length(text) + 1) IF strlen(text[1:i]) = strlen(text) // 2] AS cuts FROM documents WHERE doc_kind = 'note' AND text IS NOT NULL)
      SELECT doc_id * 2 AS id, text[1:cuts[1]] AS source FROM h WHERE len(cuts) > 0 UNION ALL SELECT doc_id * 2 + 1, text[cuts[1] + 1:] FROM h WHERE len(cuts) > 0""",
    "s10_metrics": "SELECT event_type AS event, count(*) AS n, sum(floor(coalesce(value, 0)))::BIGINT AS used, (sum(floor(coalesce(value, 0)))::BIGINT // count(*))::BIGINT AS average, (100 * sum(floor(coalesce(value, 0)))::BIGINT // (1000 * count(*)))::BIGINT AS percent FROM events WHERE event_type <> 'view' GROUP BY 1",
    "s11_entries": "SELECT name AS symbol, count(*) AS entries FROM (SELECT DISTINCT path, name, doc FROM outline_rows WHERE trim(doc) <> '') GROUP BY 1",
    "k1_toon": "SELECT path, count(*)::INT AS rows, true AS same FROM (SELECT DISTINCT * FROM outline_rows) GROUP BY 1",
    "k2_json": "SELECT '{\"file_id\":' || file_id || ',\"path\":\"' || path || '\",\"lines\":' || lines || '}' AS value FROM files",
    "k2_text": "SELECT path || '  ' || language || '  ' || lines AS value FROM files",
    "k6_api": "K6",
    "k7_upsert": f"WITH {_CUR}, r AS (SELECT file_id FROM files WHERE language = 'rust'), n AS (SELECT * FROM c WHERE file_id IN (SELECT file_id FROM r)) SELECT id, file_id, sig_hash FROM o WHERE file_id NOT IN (SELECT file_id FROM n) UNION ALL SELECT id, file_id, sig_hash FROM n",
    "st1_diff": f"WITH {_DIFF} SELECT old_id, new_id, change FROM diff",
    "st1_dirty": f"WITH {_DIFF} SELECT DISTINCT d.name, f.family FROM diff d JOIN files f ON f.file_id = d.file_id WHERE change IN ('added', 'removed', 'renamed') AND EXISTS (SELECT 1 FROM tmp_refs r JOIN files g ON g.file_id = r.file_id WHERE r.name = d.name AND g.family = f.family)",
    "st2_changed": "SELECT path, hash || '+' AS hash FROM files WHERE family = 'go'",
    "st5_stream": _PLANS["l1_utility"],
    "st6_windows": "SELECT date_trunc('hour', ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2",
}

_ROWS = _PLANS["e6_insights"]
SQL["k3_report"] = f"""SELECT section, '## ' || upper(section[1]) || section[2:] || E'\\n\\n| | |\\n|---|---|\\n' || string_agg('| ' || key || ' | ' || n || ' |', E'\\n' ORDER BY n DESC, key) AS markdown FROM ({_ROWS}) GROUP BY 1"""
SQL["k3_html"] = f"""SELECT section, '<h2>' || section || '</h2><table>' || string_agg('<tr><td>' || key || '</td><td>' || n || '</td></tr>', '' ORDER BY n DESC, key) || '</table>' AS html FROM ({_ROWS}) GROUP BY 1"""
_CELL = "replace(replace(replace(replace(replace(translate({0}, chr(9) || chr(10) || chr(13), '   '), chr(92), chr(92) || chr(92)), '|', chr(92) || '|'), '`', chr(92) || '`'), '<', '&lt;'), '>', '&gt;')"
SQL["k6_api"] = f"""WITH sent AS ({_SEARCH['f4_first_sentence']}), s AS (SELECT DISTINCT s.id, s.start_line, s.kind, s.qualified_name, s.signature, coalesce(sent.summary, '') AS summary, f.path FROM symbols s JOIN files f ON f.file_id = s.file_id LEFT JOIN sent ON sent.id = s.id WHERE visibility = 'public' AND kind <> 'module'),
n AS (SELECT *, row_number() OVER (ORDER BY path, start_line, id) AS k FROM s), kept AS (SELECT * FROM n WHERE k <= 5000)
SELECT path, '## ' || {_CELL.format('path')} || E'\\n\\n| kind | name | signature | summary |\\n|---|---|---|---|\\n' || string_agg('| ' || kind || ' | ' || {_CELL.format('qualified_name')} || ' | ' || {_CELL.format('signature')} || ' | ' || {_CELL.format('summary')} || ' |', E'\\n' ORDER BY k) AS markdown FROM kept GROUP BY path
UNION ALL SELECT NULL, '> ' || count(*) || ' more public symbols were left out at the limit of 5000; narrow the reference with a path prefix.' FROM n WHERE k > 5000 HAVING count(*) > 0"""
