"""Readers and sinks of records: metrics, documentation entries, Markdown and JSON reports, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from symvane.functions.text import blank, first_sentence, redact
from symvane.runtime import cut

_METRIC = T.StructType([T.StructField(c, T.StringType()) for c in ("event", "kind", "op")] + [T.StructField(c, T.LongType()) for c in ("at", "used", "budget")] + [T.StructField("_bad", T.StringType())])
#: Most entries of a documentation file, and characters of one.
MOST_ENTRIES, MOST_CHARS = 500, 2_000


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON as (event, at, used, budget); the event is named event, kind or op; bad lines are skipped."""
    rows = spark.read.schema(_METRIC).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter("_bad IS NULL").select(F.coalesce("event", "kind", "op").alias("event"), "at", "used", "budget").filter("event IS NOT NULL")


def usage(metrics: DataFrame) -> DataFrame:
    """Per event its count, sum, whole average and percent of budget; 0 where nothing was granted."""
    sums = metrics.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("used"), F.lit(0)).alias("used"), F.coalesce(F.sum("budget"), F.lit(0)).alias("budget"))
    return sums.select("event", "n", "used", F.expr("used div n").alias("average"), F.expr("CASE WHEN budget > 0 THEN 100 * used div budget ELSE 0 END").alias("percent"))


def read_entries(texts: DataFrame) -> DataFrame:
    """Documentation entries (symbol, doc) of JSON texts (column text), valid ones only, at most 500 a text."""
    form = T.ArrayType(T.StructType([T.StructField("symbol", T.StringType()), T.StructField("doc", T.StringType())]))
    listed = texts.select(F.slice(F.from_json("text", form), 1, MOST_ENTRIES).alias("es")).select(F.explode("es").alias("e")).select("e.*")
    return listed.filter(F.col("symbol").isNotNull() & ~blank(F.col("doc")) & (F.length("doc") <= MOST_CHARS))


def _cell(c: Column) -> Column:
    """Text of a table's cell: nothing in it ends the cell or opens markup."""
    for char, instead in (("\\", "\\\\"), ("|", "\\|"), ("`", "\\`"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(instead))
    return F.translate(c, "\n\r\t", "   ")


def api_reference(symbols: DataFrame, most: int = 5_000) -> DataFrame:
    """Markdown tables of the public symbols of every file, in order: (path, markdown), `most` rows in all, then the count of the rest (path null)."""
    public = symbols.filter("visibility = 'public' AND kind <> 'module'")
    kept = public.orderBy("path", "start_line", "id").limit(most)
    summary = first_sentence(F.coalesce("doc", F.lit("")))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "kind", _cell(F.col("qualified_name")), _cell(F.col("signature")), _cell(summary)), F.lit(" |"))
    grouped = kept.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start_line", "id", line.alias("line")))).alias("ls"))
    head = F.concat(F.lit("## "), _cell(F.col("path")), F.lit("\n\n| kind | name | signature | summary |\n|---|---|---|---|\n"))
    rows = grouped.select("path", F.concat(head, F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("markdown"))
    rest = public.agg((F.count(F.lit(1)) - most).alias("n")).filter("n > 0")
    told = F.concat(F.lit("> "), F.col("n").cast("string"), F.lit(f" more public symbols were left out at the limit of {most}; narrow the reference with a path prefix."))
    return rows.unionByName(rest.select(F.lit(None).cast("string").alias("path"), told.alias("markdown")))


def report(sections: DataFrame, language: str = "en") -> DataFrame:
    """A Markdown report of (section, key, n) rows: one row (section, markdown) each, keys by n and name."""
    # Headings.
    titles = {"en": {"languages": "Languages", "modules": "Modules", "hotspots": "Hotspots", "runs": "Runs"}, "es": {"languages": "Lenguajes", "modules": "Módulos", "hotspots": "Puntos calientes", "runs": "Ejecuciones"}}[language]
    title = F.coalesce(*[F.when(F.col("section") == k, v) for k, v in titles.items()], F.col("section"))
    rows = sections.groupBy("section").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), "key"))).alias("ls"))
    line = F.array_join(F.transform("ls", lambda x: F.concat(F.lit("| "), x["key"], F.lit(" | "), (-x["minus"]).cast("string"), F.lit(" |"))), "\n")
    return rows.select("section", F.concat(F.lit("## "), title, F.lit("\n\n| | |\n|---|---|\n"), line).alias("markdown"))


def _escaped(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def report_html(sections: DataFrame) -> DataFrame:
    """The rows of `report` as HTML: one row (section, html) each."""
    rows = sections.groupBy("section").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), "key"))).alias("ls"))
    line = F.array_join(F.transform("ls", lambda x: F.concat(F.lit("<tr><td>"), _escaped(x["key"]), F.lit("</td><td>"), (-x["minus"]).cast("string"), F.lit("</td></tr>"))), "")
    return rows.select("section", F.concat(F.lit("<h2>"), _escaped(F.col("section")), F.lit("</h2><table>"), line, F.lit("</table>")).alias("html"))


def as_text(df: DataFrame, separator: str = "  ") -> DataFrame:
    """Every row as one line of text (column value); null shows as a dash."""
    return df.select(F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns]).alias("value"))


def as_json(df: DataFrame) -> DataFrame:
    """Every row as one JSON text (column value)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], scope: str) -> DataFrame:
    """The table after a batch: rows of incoming replace all rows of the scopes (say files) they come from; others stay.

    `keys` names a row within its table; of rows with equal keys in the batch one stays, the greatest.
    """
    rest = [c for c in incoming.columns if c not in keys]
    one = incoming.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
    kept = current.join(incoming.select(scope).distinct(), scope, "left_anti")
    return kept.select(*current.columns).unionByName(one.select(*current.columns))


def upsert_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a batch changes, by (file_id, qualified_name, kind, ordinal): added, removed, modified, renamed, kept, with both ids."""
    key = ["file_id", "qualified_name", "kind", "ordinal"]
    o = old.select(*key, F.col("id").alias("old_id"), F.col("name").alias("old_name"), F.col("sig_hash").alias("s0"), F.col("body_hash").alias("b0"))
    n = new.select(*key, F.col("id").alias("new_id"), F.col("name").alias("new_name"), F.col("sig_hash").alias("s1"), F.col("body_hash").alias("b1"))
    change = F.when(F.col("old_id").isNull(), "added").when(F.col("new_id").isNull(), "removed").when(F.col("old_name") != F.col("new_name"), "renamed").when((F.col("s0") != F.col("s1")) | (F.col("b0") != F.col("b1")), "modified").otherwise("kept")
    return o.join(n, key, "full_outer").select(*key, "old_id", "new_id", change.alias("change"), F.coalesce("new_name", "old_name").alias("name"))


def dirty_names(diff: DataFrame, files: DataFrame, refs: DataFrame) -> DataFrame:
    """Names (name, family) whose meaning a batch changed and that some reference of the family mentions."""
    changed = diff.filter("change IN ('added', 'removed', 'renamed')").join(files.select("file_id", "family"), "file_id").select("name", "family").distinct()
    mentioned = refs.join(files.select("file_id", "family"), "file_id").select("name", "family").distinct()
    return changed.join(mentioned, ["name", "family"], "left_semi")


def changed_files(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """Listed files (path, hash) that aren't stored with the same content."""
    return listed.join(stored.select("path", "hash"), ["path", "hash"], "left_anti")


#: Files and bytes of one batch, and hash ranges that batches are counted in.
BATCH_FILES, BATCH_BYTES, BATCH_RANGES = 200, 16 << 20, 64


def batches(files: DataFrame, most_files: int = BATCH_FILES, most_bytes: int = BATCH_BYTES, ranges: int = BATCH_RANGES) -> DataFrame:
    """files (path, size) with the batch of each: at most `most_files` files that begin within `most_bytes` of the batch's first.

    Batches are counted within ranges of the path's hash, so no task sees all files; a file larger than a batch has one
    to itself or ends one. An empty list gives none.
    """
    ordered = Window.partitionBy("__range").orderBy("path")
    rows = files.withColumn("__range", F.pmod(F.xxhash64("path"), F.lit(ranges)).cast("int"))
    before = F.coalesce(F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cell = rows.withColumn("__cell", F.floor(before / most_bytes)).withColumn("__nth", F.row_number().over(Window.partitionBy("__range", "__cell").orderBy("path")))
    return cell.withColumn("batch", F.concat_ws("-", "__range", "__cell", F.floor((F.col("__nth") - 1) / most_files))).drop("__range", "__cell", "__nth")


# How a line of documentation opens, by language.
DOC_SIGNS = {"rust": "/// ", "python": "# ", "ruby": "# ", "shell": "# ", "r": "# ", "elixir": "# ", "sql": "-- ", "lua": "-- ", "haskell": "-- ", "clojure": "; "}


def insert_docs(text: str, language: str, places: list[tuple[int, int, str]]) -> str:
    """A source with documentation before its lines (line, id, doc), put in from the bottom up, with the line's indentation."""
    lines = text.split("\n")
    sign = DOC_SIGNS.get(language, "// ")
    for line, _, doc in sorted(places, key=lambda p: (-p[0], -p[1])):
        pad = lines[line - 1][: len(lines[line - 1]) - len(lines[line - 1].lstrip())]
        lines[line - 1 : line - 1] = [f"{pad}{sign}{x}".rstrip() for x in doc.strip().split("\n")]
    return "\n".join(lines)


def apply_docs(entries: DataFrame, symbols: DataFrame, contents: DataFrame, dry_run: bool = False) -> DataFrame:
    """Files with the documentation of entries (symbol, doc) put before their symbols: (path, text, applied, refused).

    symbols: (id, name, qualified_name, path, start_line, hash), hash being that of the content they were read from;
    contents: (path, language, text, hash). An entry names a symbol by #id, qualified name, or a name only one symbol
    has; others are left out. A file that has changed since is refused whole. With `dry_run` text is null.
    """
    key = lambda c, w: symbols.select(c.alias("symbol"), F.lit(w).alias("weight"), "id", "path", "start_line", "hash")
    names = key(F.concat(F.lit("#"), F.col("id").cast("string")), 0).unionByName(key(F.col("qualified_name"), 1)).unionByName(key(F.col("name"), 2))
    clean = entries.filter(~blank(F.col("doc")) & (F.length("doc") <= MOST_CHARS)).withColumn("doc", redact(F.col("doc"))).distinct()
    hits = clean.join(names, "symbol").groupBy("symbol", "doc").agg(F.min("weight").alias("weight"), F.collect_set(F.struct("weight", "id", "path", "start_line", "hash")).alias("all"))
    best = hits.select("doc", F.filter("all", lambda x: x["weight"] == F.col("weight")).alias("found")).filter(F.size("found") == 1).select("doc", F.col("found")[0].alias("f")).select("doc", "f.id", "f.path", "f.start_line", "f.hash")
    one = best.groupBy("path", "id", "start_line", "hash").agg(F.min("doc").alias("doc"))
    grouped = one.groupBy("path").agg(F.collect_list(F.struct("start_line", "id", "doc")).alias("places"), F.collect_set("hash").alias("hashes"))
    joined = grouped.join(contents, "path").withColumn("refused", (F.size("hashes") > 1) | (F.col("hashes")[0] != F.col("hash")))

    @F.udf(T.StringType())
    def put(text: str, language: str, places: list) -> str:
        return insert_docs(text, language, [tuple(p) for p in places])

    text = F.when(~F.col("refused"), put("text", "language", "places")) if not dry_run else F.lit(None).cast("string")
    return joined.select("path", text.alias("text"), F.when(F.col("refused"), 0).otherwise(F.size("places")).alias("applied"), "refused")


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrite a table that df may itself read: the rows are written apart first."""
    cut(df).write.mode("overwrite").parquet(path)
