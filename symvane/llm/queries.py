"""Queries of the problems for language models (2, 4, 5, 7, 8, 9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symvane.llm.encode import encode
from symvane.llm.language import Detector, labelled_sample, languages, source_languages
from symvane.llm.leakage import leaks
from symvane.llm.pairs import code_doc_pairs, source_functions, stored_pairs
from symvane.llm.sentences import split_sentences
from symvane.llm.topn import top_n
from symvane.operators.incremental import latest
from symvane.runtime import table, tasks_of


def _detector(spark: SparkSession, d: str) -> Detector:
    return Detector.fit(labelled_sample(table(spark, d, "documents"), "doc_id", "text", "lang"))


# Ends of paths of languages by the signs of their comments.
SLASH_ENDS = ("rs", "js", "mjs", "jsx", "ts", "tsx", "go", "java", "c", "h", "cpp", "cc", "hpp", "cs", "zig", "kt", "swift", "scala")
HASH_ENDS, DASH_ENDS = ("py", "rb", "sh", "ex", "r"), ("sql", "lua", "hs")


def comment_family(path: Column) -> Column:
    """How the language of a path marks comments; mixed where the path doesn't tell."""
    end = F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))
    return F.when(end.isin(*SLASH_ENDS), "star").when(end.isin(*HASH_ENDS), "hash").when(end.isin(*DASH_ENDS), "dash").otherwise("mixed")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of the doc text and of the name of every stored row."""
    stored = latest(table(spark, d, "old_symbols"), "id", "stored_at", ["name", "doc"], 2 * tasks_of(spark))
    return languages(stored, "id", "doc", "name", _detector(spark, d)).select("id", "field", "lang")


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    """Each language's share of the running doc text of every file."""
    stored = latest(table(spark, d, "old_symbols"), "id", "stored_at", ["file_id", "name", "doc"], 2 * tasks_of(spark))
    keyed = stored.select(F.struct("file_id", "id").alias("row"), "name", "doc")
    found = languages(keyed, "row", "doc", "name", _detector(spark, d)).filter("field = 'doc'")
    sums = found.groupBy(F.col("id.file_id").alias("file_id"), "lang").agg(F.sum("chars").alias("chars"))
    whole = sums.groupBy("file_id").agg(F.sum("chars").alias("__all"))
    return sums.join(whole, "file_id").select("file_id", "lang", "chars", (F.col("chars") / F.col("__all")).alias("share"))


def p2_documents(spark: SparkSession, d: str) -> DataFrame:
    """Languages of comments and strings in the documents: whole commented sources, and the fenced code of all others."""
    family = F.when(F.col("doc_kind") == "source", comment_family(F.col("path"))).otherwise("fenced")
    return source_languages(table(spark, d, "documents").withColumn("family", family), "doc_id", "text", "family", _detector(spark, d))


def _documented(spark: SparkSession, d: str) -> DataFrame:
    stored = latest(table(spark, d, "old_symbols"), "id", "stored_at", ["name", "kind", "signature", "doc"]).filter("kind IN ('function', 'method')")
    blank = F.length(F.regexp_replace(F.coalesce("doc", F.lit("")), r"(?U)\s+", "")) == 0
    outline = table(spark, d, "outline_rows").filter("doc <> ''").groupBy("id").agg(F.max("doc").alias("__outline"))
    told = stored.filter(~blank).select("id", "name", "signature", "doc")
    untold = stored.filter(blank).join(outline, "id").select("id", "name", "signature", F.col("__outline").alias("doc"))
    return stored_pairs(told.unionByName(untold), "id", "name", "signature", "doc")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Stored functions and methods whose documentation says something."""
    return _documented(spark, d).select("id")


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Signature and documentation of stored functions and methods."""
    return _documented(spark, d).select("id", "signature", "doc")


def p4_sources(spark: SparkSession, d: str) -> DataFrame:
    """Documented functions in the texts of the documents."""
    return code_doc_pairs(table(spark, d, "documents"), "doc_id", "text")


def p4_functions(spark: SparkSession, d: str) -> DataFrame:
    """Every function in the texts of the documents, documented or not."""
    return source_functions(table(spark, d, "documents"), "doc_id", "text").select("id", "name", "line")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The three leading references of every file and hotspots of every path."""
    refs = top_n(table(spark, d, "tmp_refs"), ["file_id"], [("nsame", True), ("line", False)], "rid", 3)
    spots = top_n(table(spark, d, "hotspots"), ["path"], [("callers", True), ("line", False)], "id", 3)
    return refs.select(F.lit("refs").alias("list_name"), F.col("file_id").cast("string").alias("group_key"), "rank_no", F.col("rid").alias("item_id")).unionByName(
        spots.select(F.lit("hotspots").alias("list_name"), F.col("path").alias("group_key"), "rank_no", F.col("id").alias("item_id")))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    return encode(table(spark, d, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold passages of held-out items."""
    return leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of every document."""
    return split_sentences(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p2_found, p2_shares, p2_documents, p4_found, p4_pairs, p4_sources, p4_functions, p5_found, p7_ids, p8_found, p9_found)}
SQL: dict[str, str] = {
    "p4_functions": r"""WITH l AS (SELECT doc_id AS id, unnest(ls) AS line_text, unnest(range(1, len(ls) + 1))::INT AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS ls FROM documents WHERE length(text) > 0))
      SELECT id, regexp_extract(line_text, '^\s*(?:def|fn|func|function)\s+(\w+)\s*\(', 1) AS name, line FROM l WHERE regexp_matches(line_text, '^\s*(?:def|fn|func|function)\s+\w+\s*\(')""",
    "p5_found": """
WITH a AS (SELECT DISTINCT rid, file_id, nsame, line FROM tmp_refs),
b AS (SELECT DISTINCT id, path, callers, line FROM hotspots WHERE callers IS NOT NULL)
SELECT * FROM (
  SELECT 'refs' AS list_name, CAST(file_id AS VARCHAR) AS group_key, CAST(row_number() OVER (PARTITION BY file_id ORDER BY nsame DESC, line, rid) AS INT) AS rank_no, rid AS item_id FROM a
  UNION ALL
  SELECT 'hotspots', path, CAST(row_number() OVER (PARTITION BY path ORDER BY callers DESC, line, id) AS INT), id FROM b
) WHERE rank_no <= 3""",
}
