"""The model's tables over a folder of test data.

Files and symbols are stored tables; references are the loaded reference rows, one per id;
memories are stored symbols' comments with the stored hashes as anchors; signals are the event
log; pairs of parts bought together stand for symbols used together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symvane.operators.resolve import resolve
from symvane.runtime import cut, table


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files")


def symbols(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    rows = table(spark, d, "symbols")
    return (rows.select("id", *columns) if columns else rows).distinct()


def refs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tmp_refs").select(F.col("rid").alias("id"), "file_id", F.col("owner").alias("owner_id"), "name", "kind", "line", F.col("excl").alias("no_self"), "recv")
    return rows.distinct()


def edges(spark: SparkSession, d: str) -> DataFrame:
    return resolve(refs(spark, d), symbols(spark, d, "file_id", "name", "qualified_name", "start_line", "parent_id"), files(spark, d))


def pointed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """References with receivers that point: (refs, symbols, files) where names are the last word of the stored ones, so that
    many symbols share one, and every symbol is referenced from the next file of its family through its parent's name, its
    file's stem, its directory, another word or none."""
    places = files(spark, d).withColumn("next_file", F.lead("file_id").over(Window.partitionBy("family").orderBy("file_id")))
    rows = symbols(spark, d, "file_id", "name", "qualified_name", "start_line", "parent_id")
    short = F.regexp_extract("name", "([A-Z]?[a-z]+)[^a-z]*$", 1)
    named = cut(rows.withColumn("name", F.when(short == "", F.col("name")).otherwise(F.lower(short))))
    parents = named.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    told = named.join(parents, "parent_id", "left").join(places.select("file_id", "path", "next_file"), "file_id").filter("next_file IS NOT NULL AND parent_id IS NOT NULL")
    parts = F.split("path", "/")
    stem = F.split(F.element_at(parts, -1), r"\.")[0]
    kind = F.pmod("id", F.lit(5))
    recv = F.when(kind == 0, F.lower("parent")).when(kind == 1, F.lower(stem)).when(kind == 2, F.lower(parts[0])).when(kind == 3, F.concat(F.lower("parent"), F.lit("s")))
    refs = told.select("id", F.col("next_file").alias("file_id"), F.col("parent_id").alias("owner_id"), "name", F.lit("calls").alias("kind"), (F.col("start_line") + 1).alias("line"), (kind == 0).cast("int").alias("no_self"), recv.alias("recv"))
    return cut(refs), named, files(spark, d)


def memories(spark: SparkSession, d: str) -> DataFrame:
    """Comments of stored symbols: the kind from the symbol's kind, the provenance from its language's habit."""
    rows = table(spark, d, "old_symbols").filter(F.length(F.trim("doc")) > 0)
    kind = F.when(F.col("kind").isin("function", "method"), "fact").when(F.col("kind").isin("class", "struct", "interface"), "decision").when(F.col("kind") == "module", "convention").otherwise("lesson")
    provenance = F.when(F.col("kind") == "method", "agent").when(F.col("kind") == "function", "user").when(F.col("kind") == "class", "auto").otherwise("tool")
    return rows.groupBy("id").agg(F.max(F.struct("stored_at", "doc", kind.alias("kind"), provenance.alias("provenance"))).alias("r")).select(
        "id", "r.kind", F.col("r.doc").alias("text"), "r.provenance", F.unix_timestamp("r.stored_at").alias("created_at"))


def anchors(spark: SparkSession, d: str) -> DataFrame:
    """One anchor per memory: its symbol as it was stored."""
    rows = table(spark, d, "old_symbols").filter(F.length(F.trim("doc")) > 0)
    last = rows.groupBy("id").agg(F.max(F.struct("stored_at", "doc", "qualified_name", "file_id", "sig_hash", "body_hash")).alias("r"))
    return last.select(F.col("id").alias("memory_id"), F.lit(0).alias("ordinal"), F.col("id").alias("symbol_id"), "r.qualified_name", "r.file_id", "r.sig_hash", "r.body_hash").join(files(spark, d).select("file_id", "path"), "file_id").drop("file_id")


#: Event types as signals.
SIGNAL_OF = {"view": "used", "click": "useful", "error": "dead_end", "signup": "ignored", "purchase": "corrected"}


def signals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    kind = F.coalesce(*[F.when(F.col("event_type") == e, s) for e, s in SIGNAL_OF.items()])
    return rows.select(F.col("event_id").alias("id"), F.lit("symbol").alias("target_kind"), F.col("user_id").alias("target_id"), kind.alias("kind"), F.unix_timestamp("ts").alias("at"))


def together(spark: SparkSession, d: str) -> DataFrame:
    """Pairs (a < b) of parts of one order with the order's time."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    other = lines.withColumnRenamed("l_partkey", "b")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.unix_timestamp("o_orderdate").alias("at"))
    return lines.withColumnRenamed("l_partkey", "a").join(other, "l_orderkey").filter("a < b").join(orders, "l_orderkey").select("a", "b", "at")


def part_edges(spark: SparkSession, d: str) -> DataFrame:
    """A dense graph: parts that follow one another in an order; kind and confidence from the line's flags."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag")
    steps = lines.withColumn("dst", F.lead("l_partkey").over(w)).filter("dst IS NOT NULL")
    confidence = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    return steps.groupBy(F.col("l_partkey").alias("src"), "dst", F.col("l_linestatus").alias("kind")).agg(F.max(confidence).alias("confidence"), F.min("l_linenumber").alias("line"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as symbols of files named by type and brand."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("family"), F.concat_ws("/", "p_type", "p_brand", "p_name").alias("path"), F.col("p_size").alias("start_line"), F.when(F.col("p_retailprice") > 1500, "private").otherwise("public").alias("visibility"))
