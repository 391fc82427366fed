import random
from collections import defaultdict

from pyspark.sql import functions as F

from symvane.operators.skew import SPLIT, balanced_distinct_count, balanced_join, heavy_keys, murmur3_int, pack, plan_loads, slots


def test_slots_are_where_spark_puts_them(spark):
    for tasks in (1, 3, 8):
        df = spark.createDataFrame([(s,) for s in slots(tasks)], "s int").select("s", F.pmod(F.hash("s"), F.lit(tasks)).alias("p"))
        assert sorted(r.p for r in df.collect()) == list(range(tasks))
    assert [r[0] for r in spark.range(5).select(F.hash(F.col("id").cast("int"))).collect()] == [murmur3_int(i) for i in range(5)]


def test_pack_is_even():
    at = pack([90, 10, 10, 10, 10, 50, 40], 3)
    load = defaultdict(int)
    for n, t in zip([90, 10, 10, 10, 10, 50, 40], at):
        load[t] += n
    assert max(load.values()) == 90


def rows(n=4000):
    r = random.Random(3)
    return [("hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{r.randrange(400)}", i % (n - 50), i) for i in range(n)]


def test_heavy_keys_are_named_and_spread(spark):
    df = spark.createDataFrame(rows(), "key string, rid long, slot int")
    plan = plan_loads(df, ["key"], 6)
    assert plan.total == 4000 and len(plan.heavy) <= SPLIT * 6
    assert plan.heavy[0][0] == ("hot",) and (None,) in [h[0] for h in plan.heavy]
    loads = [r.n for r in plan.place(df, "__slot", [F.col("rid")]).groupBy("__slot").agg(F.count("*").alias("n")).collect()]
    assert max(loads) < 1.4 * 4000 / 6


def test_distinct_counts(spark):
    data = rows()
    df = spark.createDataFrame(data, "key string, rid long, n int")
    want = defaultdict(set)
    for k, rid, _ in data:
        want[k].add(rid)
    got = {r.key: r.n for r in balanced_distinct_count(df, ["key"], "rid").collect()}
    assert got == {k: len(v) for k, v in want.items()}
    assert balanced_distinct_count(df.limit(0), ["key"], "rid").collect() == []
    assert {r.key: r.n for r in balanced_distinct_count(spark.createDataFrame([("a", None)], "key string, rid long"), ["key"], "rid").collect()} == {"a": 0}


def test_join_equals_plain_join(spark):
    left = spark.createDataFrame(rows(), "key string, rid long, v int")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), (None, 4), ("none", 5)], "key string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = sorted(map(str, balanced_join(left, right, ["key"], ["rid"], how).collect()))
        plain = right if how.startswith("left_") else right.withColumnRenamed("v", "v_right")
        assert got == sorted(map(str, left.join(plain, "key", how).select(*balanced_join(left, right, ["key"], ["rid"], how).columns).collect()))


def test_share(spark):
    df = spark.createDataFrame([("a", 10), ("b", 9), ("c", 0)], "key string, n long")
    assert [r.key for r in heavy_keys(df, 1000, 0.01).collect()] == ["a"]
    assert heavy_keys(df.filter("n = 0"), 0, 0.01).collect() == []


def test_join_edges(spark):
    left = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), (None, None, None)], "key string, rid long, __slot string")
    right = spark.createDataFrame([("a", "y")], "key string, __slot string")
    got = sorted(map(str, balanced_join(left, right, ["key"], ["rid"], "left").collect()))
    assert len(got) == 3 and sum("='y'" in r for r in got) == 2 and balanced_join(left, right, ["key"], ["rid"]).columns == ["key", "rid", "__slot", "__slot_right"]
    assert balanced_join(left.limit(0), right, ["key"], ["rid"]).collect() == [] and balanced_join(left, right.limit(0), ["key"], ["rid"]).collect() == []
    assert balanced_join(left, right.limit(0), ["key"], ["rid"], "left_anti").count() == 3
    long = spark.createDataFrame([("k" * 200_000, i) for i in range(50)], "key string, rid long")
    assert balanced_join(long, long.limit(1).withColumnRenamed("rid", "n"), ["key"], ["rid"]).count() == 50
