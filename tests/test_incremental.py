from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symvane.operators.incremental import COMPACT_RUNS, Ledger, changes, latest, processed_ledger, watermark

t = lambda d, h=0: datetime(2026, 1, d, h)


def test_changes(spark):
    stored = spark.createDataFrame([(1, 10, t(1)), (1, 11, t(3)), (1, 12, t(2)), (2, 20, t(1)), (3, 30, t(1)), (4, None, t(1)), (5, 50, t(1)), (5, 50, t(1)), (None, 1, t(1)), (6, 60, None), (7, 70, t(1))], "id long, v long, at timestamp")
    removals = spark.createDataFrame([(2, t(2)), (3, t(1)), (7, t(5)), (8, t(1)), (None, t(1))], "id long, removed_at timestamp")
    ledger = processed_ledger(stored, "id", ["v"], "at", removals)
    assert {r.id: r.v for r in ledger.collect()} == {1: 11, 3: 30, 4: None, 5: 50, 6: 60}
    current = spark.createDataFrame([(1, 11, "x"), (2, 20, "x"), (3, 31, "x"), (4, None, "x"), (9, 90, None), (9, 90, None), (None, 4, None), (6, 60, "y")], "id long, v long, change_kind string")
    assert sorted(tuple(r) for r in changes(current, ledger, "id", ["v"]).collect()) == [(2, "added"), (3, "modified"), (5, "removed"), (9, "added")]
    assert changes(current.limit(0), ledger.limit(0), "id", ["v"]).collect() == []
    assert changes(current, ledger.limit(0), "id", ["v"]).filter("change_kind = 'added'").count() == 6


def test_latest(spark):
    df = spark.createDataFrame([(1, "a", t(1)), (1, "b", t(2)), (1, "c", t(2)), (None, "x", t(9)), (2, None, None)], "id long, v string, at timestamp")
    for tasks in (None, 3):
        assert {r.id: r.v for r in latest(df, "id", "at", ["v"], tasks).collect()} == {1: "c", 2: None}


def test_watermark(spark):
    schema = "started timestamp, ended timestamp, outcome string"
    ok, bad = F.col("outcome") == "committed", F.col("outcome").isin("failed", "rolled_back")
    since = lambda rows: watermark(spark.createDataFrame(rows, schema), "started", "ended", ok, bad).first()[0]
    assert since([]) is None
    assert since([(t(1), t(2), "failed")]) is None
    assert since([(t(1), t(2), "committed"), (t(3), t(4), "committed")]) == t(3)
    assert since([(t(1), None, None), (t(3), t(4), "committed")]) == t(1)  # never ended: still open then
    assert since([(t(2), t(6), "committed"), (t(3), t(4), "committed"), (t(5), t(7), "failed")]) == t(2)


def test_runs_survive_failures(spark, tmp_path):
    led = Ledger(spark, str(tmp_path / "ledger"), "id", ["v"], T.LongType(), [T.LongType()])
    source = spark.createDataFrame([(1, 1), (2, None), (2, None), (3, 3)], "id long, v long")
    seen = []

    def fail(rows):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        led.run(led.pending(source), fail)
    assert led.runs() == [] and led.pending(source).count() == 3  # nothing skipped
    led.run(led.pending(source), lambda rows: seen.extend(r.id for r in rows.collect()))
    assert sorted(seen) == [1, 2, 3] and led.pending(source).count() == 0  # nothing repeated
    more = source.union(spark.createDataFrame([(1, 2), (4, 4)], "id long, v long"))
    led.run(led.pending(more), lambda rows: seen.extend(r.id for r in rows.collect()))
    assert sorted(seen[3:]) == [1, 4]


def ledger(spark, tmp_path):
    return Ledger(spark, str(tmp_path / "ledger"), "id", ["v"], T.LongType(), [T.LongType()])


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id long, v long")


def test_a_lazy_failure_leaves_everything_pending(spark, tmp_path):
    led = ledger(spark, tmp_path)
    source = rows(spark, (1, 1), (2, 2))
    with pytest.raises(Exception, match="lost"):
        led.run(led.pending(source), lambda df: df.select(F.raise_error(F.concat(F.lit("lost "), "id")).cast("string").alias("x")))
    assert led.runs() == [] and led.pending(source).count() == 2
    made = led.run(led.pending(source), lambda df: df.select("id", (F.col("v") * 10).alias("w")))
    assert sorted((r.id, r.w) for r in made.collect()) == [(1, 10), (2, 20)] and led.pending(source).count() == 0


def test_a_version_that_returns_is_pending(spark, tmp_path):
    led = ledger(spark, tmp_path)
    for v in (10, 11, 10):
        source = rows(spark, (1, v), (2, 5))
        assert 1 in {r.id for r in led.pending(source).collect()}
        led.run(led.pending(source), lambda df: None)
        assert led.pending(source).count() == 0
    history = spark.createDataFrame([(1, 10, t(1)), (1, 11, t(2)), (1, 10, t(3)), (1, 12, None), (None, 1, t(9))], "id long, v long, at timestamp")
    assert led.pending(history, "at").count() == 0 and [r.v for r in led.pending(history, "at", t(9)).collect()] == [12]


def test_removed_and_added_again(spark, tmp_path):
    led = ledger(spark, tmp_path)
    led.run(rows(spark, (1, 1), (2, 2)), lambda df: None)
    left = rows(spark, (1, 1))
    assert [r.id for r in led.removed(left).collect()] == [2]
    seen = []
    led.run(led.pending(left), lambda df, gone: seen.extend(r.id for r in gone.collect()), led.removed(left))
    assert seen == [2] and led.removed(left).count() == 0
    assert [tuple(r) for r in led.pending(rows(spark, (1, 1), (2, 2))).collect()] == [(2, 2)]


def test_runs_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("symvane.operators.incremental.COMPACT_RUNS", 3)
    led = ledger(spark, tmp_path)
    for k in range(6):
        led.run(rows(spark, (k, k), (100, k)), lambda df: None)
        assert len(led.runs()) <= 3 < COMPACT_RUNS
    assert sorted((r.id, r.v) for r in led.frame().collect()) == [(k, k) for k in range(6)] + [(100, 5)]
    assert len(list((tmp_path / "ledger").glob("run=*"))) == len(led.runs())
