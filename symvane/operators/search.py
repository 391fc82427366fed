"""Full-text search: tokens to postings, weighted BM25, any-word mode, baseline ranking.

Postings are a table (term, column, doc, tf) built once; a batch of queries is a table of
(query_id, term), so many queries run as one join. Document frequency, lengths and scores are
plain aggregates; the last word of a query also matches as a prefix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symvane.functions.text import fold, index_terms, word_parts
from symvane.runtime import cut

#: Weights of columns, and the parameters of BM25.
WEIGHTS = {"name": 10.0, "qualified_name": 5.0, "signature": 2.0, "doc": 1.0}
K1, B = 1.2, 0.75
#: Bytes of a column that are indexed; terms of a query, and bytes of it.
COLUMN_BYTES, MEMORY_BYTES, QUERY_TERMS, QUERY_BYTES = 8_192, 16_384, 32, 2_048
#: Letters that prefixes are looked up by.
PREFIX = 3
# Words without a meaning of their own in a question.
STOP_WORDS = "a about after all also an and any are as at be been before but by can could did do does for from had has have how i if in into is it its me my no not of on or our please should so that the their then there these this those to up was we were what when where which who why will with would you your".split()


def postings(rows: DataFrame, id_col: str, columns: dict[str, float], most: int | None = None) -> DataFrame:
    """(doc, term, tf): weighted counts of the terms of each row, of whole texts unless an index is defined on the first `most` characters."""
    per = None
    for c, weight in columns.items():
        text = F.coalesce(F.col(c), F.lit(""))
        terms = F.transform(index_terms(F.substring(text, 1, most) if most else text), fold)
        one = rows.select(F.col(id_col).alias("doc"), F.explode(terms).alias("term"), F.lit(weight).alias("w"))
        per = one if per is None else per.unionByName(one)
    return per.groupBy("doc", "term").agg(F.sum("w").alias("tf"))


def statistics(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Document frequencies (term, df) and lengths (doc, length) with N and the mean length in `length`'s frame."""
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    length = posts.groupBy("doc").agg(F.sum("tf").alias("length"))
    return df, length


@dataclass
class Index:
    """Postings with what every search needs of them, computed once."""

    posts: DataFrame
    df: DataFrame
    length: DataFrame
    documents: int
    mean: float


def index_of(posts: DataFrame) -> Index:
    """The index of postings; they and their statistics are written once."""
    kept = cut(posts)
    df, length = statistics(kept)
    length = cut(length)
    n, mean = length.agg(F.count(F.lit(1)), F.coalesce(F.avg("length"), F.lit(1.0))).first()
    return Index(kept, cut(df), length, n, mean)


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, term, prefix): at most 32 distinct word parts, the last kept; the last one also matches as a prefix."""
    parts = F.transform(word_parts(F.substring(F.col(text_col), 1, QUERY_BYTES)), fold)
    last = F.element_at("parts", -1)
    rows = queries.select(F.col(id_col).alias("query_id"), parts.alias("parts")).filter(F.size("parts") > 0)
    kept = F.array_union(F.slice(F.array_distinct(F.filter("parts", lambda x: x != last)), 1, QUERY_TERMS - 1), F.array(last))
    return rows.select("query_id", last.alias("last"), F.explode(kept).alias("term")).select("query_id", "term", (F.col("term") == F.col("last")).alias("prefix"))


def content_terms(terms: DataFrame, most: int = 6) -> DataFrame:
    """Query words without stop words and single letters, the first six in order. terms: (query_id, terms array)."""
    return terms.select("query_id", F.slice(F.array_distinct(F.filter("terms", lambda x: (F.length(x) > 1) & ~x.isin(STOP_WORDS))), 1, most).alias("terms"))


def bm25(posts: DataFrame | Index, queries: DataFrame, any_word: bool = False, limit: int | None = None) -> DataFrame:
    """(query_id, doc, score, rank). queries: (query_id, term, prefix).

    Unless `any_word`, every term must occur; a prefix term stands for all terms it begins, each scored by its
    own frequency, and counts as one. Equal scores (to 9 digits) rank by doc.
    """
    index = posts if isinstance(posts, Index) else index_of(posts)
    exact = queries.filter(~F.col("prefix")).select("query_id", F.col("term").alias("asked"), "term")
    opened = queries.filter("prefix").select("query_id", F.col("term").alias("asked"), F.substring("term", 1, PREFIX).alias("initial"))
    starts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(PREFIX)), lambda k: F.substring("term", F.lit(1), k)))  # a shorter question meets the terms by its own length
    started = index.df.select("term", F.explode(starts).alias("initial")).join(opened, "initial").filter(F.startswith("term", "asked")).select("query_id", "asked", "term").distinct()
    wanted = exact.unionByName(started).join(index.df, "term")
    hits = wanted.join(index.posts, "term").join(index.length, "doc")
    idf = F.log(1 + (index.documents - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / index.mean))
    scored = hits.groupBy("query_id", "doc").agg(F.round(F.sum(part), 9).alias("score"), F.count_distinct("asked").alias("met"))
    if not any_word:
        scored = scored.join(queries.groupBy("query_id").agg(F.count_distinct("term").alias("need")), "query_id").filter("met = need")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc")
    ranked = scored.select("query_id", "doc", "score").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= limit) if limit is not None else ranked


def strict_or_any(posts: DataFrame | Index, queries: DataFrame, limit: int) -> DataFrame:
    """Per query its strict hits, or any-word hits where it has no strict one."""
    posts = posts if isinstance(posts, Index) else index_of(posts)
    strict = bm25(posts, queries, limit=limit).withColumn("mode", F.lit("all"))
    loose = bm25(posts, queries, any_word=True, limit=limit).withColumn("mode", F.lit("any"))
    return strict.unionByName(loose.join(strict.select("query_id").distinct(), "query_id", "left_anti"))


def baseline(posts: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """The k documents with most distinct query words: (query_id, doc, words, rank)."""
    met = queries.select("query_id", "term").distinct().join(posts, "term").groupBy("query_id", "doc").agg(F.count(F.lit(1)).alias("words"))
    order = Window.partitionBy("query_id").orderBy(F.col("words").desc(), "doc")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def known_item_words(sentence, name):
    """Words of a description without those equal to, or sharing a beginning of three letters with, a word of the name."""
    own = word_parts(name)
    alike = lambda w: F.exists(own, lambda o: (w == o) | (F.length(w) >= 3) & (F.length(o) >= 3) & (F.substring(w, 1, 3) == F.substring(o, 1, 3)))
    return F.filter(word_parts(sentence), lambda w: ~alike(w))
