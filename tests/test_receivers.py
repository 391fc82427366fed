"""Receivers against the predicates of every pair, and the cost of names that many candidates and receivers share."""

import random
import time

import pytest
from pyspark.sql import functions as F

from symvane.operators import resolve as r

KEY = ["name", "family", "recv"]
CANDIDATE = "sid long, name string, qualified string, start_line int, sfile long, spath string, family string, parent string"


def random_rows(seed):
    rng = random.Random(seed)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, n)))
    names, paths = ["a", "b_", "_a", "AB", "a%", "Éa"], [f"{word(4, 'ab_/')}/{word(5, 'abA_.-/É')}.x" for _ in range(25)] + ["", "a", "/a/", "ab.b/a"]
    cand = []
    for i in range(160):
        n, p, f = rng.choice(names), rng.choice([None, "", word(7, "abA_É")]), rng.randrange(len(paths))
        cand.append((i, n, None if rng.random() < 0.05 else f"{word(8, 'abA_.:')}{rng.choice(['::', '.', ''])}{n}", 1, f, paths[f], rng.choice("pq"), p))
    asked = {(rng.choice(names), rng.choice("pq"), rng.choice([word(7, "ab_"), word(5, "ab_é/.-"), word(4, "ab%")])) for _ in range(400)} | {("a", "p", "____"), ("a", "p", "_")}
    return cand, sorted(asked)


@pytest.mark.parametrize("seed", [1, 2])
def test_places_of_receivers_equal_the_predicate_of_every_pair(spark, seed):
    cand, asked = random_rows(seed)
    candidates, asked = spark.createDataFrame(cand, CANDIDATE), spark.createDataFrame(asked, "name string, family string, recv string")
    want = asked.join(candidates, ["name", "family"]).filter(r.names_place(F.col("recv"), F.col("spath"))).select(*KEY, "sid")
    got = sorted(map(tuple, r.placed_pairs(asked, candidates).collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 100
    assert not r.placed_pairs(asked.limit(0), candidates).collect() and not r.placed_pairs(asked, candidates.limit(0)).collect()


def crowd(spark, n):
    """n candidates of one name, each asked for by a receiver of its own through its file or its parent."""
    at = F.col("id").cast("string")
    candidates = spark.range(n).select(F.col("id").alias("sid"), F.lit("run").alias("name"), F.concat(F.lit("Type"), at, F.lit(".run")).alias("qualified"), F.lit(1).alias("start_line"), F.col("id").alias("sfile"), F.concat(F.lit("src/file_"), at, F.lit(".rs")).alias("spath"), F.lit("rust").alias("family"), F.concat(F.lit("Type"), at).alias("parent"))
    asked = lambda word: spark.range(n).select(F.lit("run").alias("name"), F.lit("rust").alias("family"), F.concat(F.lit(word), F.col("id").cast("string")).alias("recv"))
    return candidates, asked


def test_places_cost_files_and_receivers_and_not_their_product(spark):
    candidates, asked = crowd(spark, 12_000)
    began = time.time()
    assert r.placed_pairs(asked("file_"), candidates).count() == 12_000
    assert time.time() - began < 60


@pytest.mark.parametrize("seed", [1, 2])
def test_types_of_receivers_equal_the_predicate_of_every_pair(spark, seed):
    cand, asked = random_rows(seed)
    candidates, asked = spark.createDataFrame(cand, CANDIDATE), spark.createDataFrame(asked, "name string, family string, recv string")
    want = asked.join(candidates, ["name", "family"]).filter(r.names_type(F.col("recv"), F.col("name"), F.col("qualified"), F.col("parent"))).select(*KEY, "sid")
    got = sorted(map(tuple, r.typed_pairs(asked, candidates).collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 100
    assert not r.typed_pairs(asked.limit(0), candidates).collect() and not r.typed_pairs(asked, candidates.limit(0)).collect()


def test_types_cost_candidates_and_receivers_and_not_their_product(spark):
    candidates, asked = crowd(spark, 12_000)
    began = time.time()
    assert r.typed_pairs(asked("type"), candidates).count() == 12_000
    assert time.time() - began < 60


@pytest.mark.parametrize("excl", [0, 1])
def test_hints_cost_candidates_and_references_and_not_their_product(spark, excl):
    candidates, asked = crowd(spark, 12_000)
    loaded = asked("type").withColumns({"id": F.regexp_extract("recv", r"(\d+)", 1).cast("long"), "owner": F.lit(-1).cast("long"), "nsame": F.lit(0), "excl": F.lit(excl)})
    began = time.time()
    got = r.hints(loaded, candidates)
    assert got.count() == 12_000 and not got.filter("id <> hint").count()
    assert time.time() - began < 90


def test_picks_below_long_paths_cost_their_partings_and_not_their_bytes(spark):
    deep = "d" * 2000
    candidates = spark.range(6000).select(F.col("id").alias("sid"), F.lit("run").alias("name"), F.lit("rust").alias("family"), (F.col("id") % 20).alias("sfile")).withColumn("spath", F.concat(F.lit(f"{deep}/"), F.col("sfile").cast("string")))
    loaded = spark.range(20).select(F.col("id").alias("file_id"), F.lit("run").alias("name"), F.lit("rust").alias("family"), F.concat(F.lit(f"{deep}/"), F.col("id").cast("string")).alias("path"), F.lit(0).alias("nsame"), F.lit(6000).alias("cnt"), F.lit(0).alias("excl"), F.lit(None).cast("long").alias("hint"))
    began = time.time()
    got = r.picks(loaded, candidates).collect()
    assert sorted((x.file_id, x["rank"], x.sid) for x in got) == [(f, k + 1, f + 20 * k) for f in range(20) for k in range(5)]
    assert time.time() - began < 60
