import random

import pytest

from symvane.llm import topn
from symvane.llm.topn import top_n


def brute(rows, n):
    groups = {}
    for g, score, line, rid in set(rows):
        if score is not None and line is not None and rid is not None and score == score:
            groups.setdefault(g, {})
            key = (-score, line, rid)
            groups[g][rid] = min(key, groups[g].get(rid, key))
    return sorted((str(g), k + 1, x[2]) for g, ids in groups.items() for k, x in enumerate(sorted(ids.values())[:n]))


@pytest.mark.parametrize("buffer", [50, 100_000])
def test_equals_brute_force(spark, monkeypatch, buffer):
    monkeypatch.setattr(topn, "BUFFER_ROWS", buffer)
    r = random.Random(5)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 == 0 else f"g{r.randrange(300)}", r.choice([None, 1.5, 2.0, 3.0, float("nan")]), r.choice([None, 1, 2, 3]), r.choice([None, r.randrange(600)])) for i in range(3000)]
    rows += rows[:400]
    df = spark.createDataFrame(rows, "g string, score double, line int, rid long").repartition(5)
    got = sorted((str(x.g), x.rank_no, x.rid) for x in top_n(df, ["g"], [("score", True), ("line", False)], "rid", 3).collect())
    assert got == brute(rows, 3)


def test_edges(spark):
    df = spark.createDataFrame([("a", 1, 2, "x"), ("a", 1, 1, "y"), ("a", 1, 1, "y")], "g string, s int, id int, rank_no string")
    assert [(r.id, r.rank_no) for r in top_n(df.drop("rank_no"), ["g"], [("s", True)], "id", 5).orderBy("rank_no").collect()] == [(1, 1), (2, 2)]
    assert top_n(df, ["g"], [("s", True)], "id", 0).collect() == []
    assert top_n(df.limit(0), ["g"], [("s", True)], "id", 3).collect() == []
    assert len(top_n(df, ["g"], [("s", True)], "id", 3).collect()) == 2  # an extra column of a clashing name is ignored
    big = spark.createDataFrame([("x" * 100_000, 2**62 + i, i) for i in range(4)], "g string, s long, id int")
    assert [r.id for r in top_n(big, ["g"], [("s", True)], "id", 2).orderBy("rank_no").collect()] == [3, 2]


def test_one_group_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', cast(id % 40 as string)) AS g", "cast(id % 97 as int) AS s", "id")
        got = sorted((r.g, r.rank_no, r.id) for r in top_n(df, ["g"], [("s", True)], "id", 4).collect())
        assert got == brute([(r.g, float(r.s), 0, r.id) for r in df.collect()], 4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_equals_sql(spark):
    from compare import canon, duck
    from symvane.llm.queries import QUERIES, SQL
    from tests.conftest import SMALL

    df = QUERIES["p5_found"](spark, SMALL).select("list_name", "group_key", "rank_no", "item_id")
    assert sorted(canon(tuple(r)) for r in df.collect()) == sorted(canon(r) for r in duck(SMALL).execute(f"SELECT list_name, group_key, rank_no, item_id FROM ({SQL['p5_found']})").fetchall())
