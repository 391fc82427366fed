"""Processing only what is new or changed since the last successful run.

A ledger holds the key and version of everything processed. A run rereads its source from the
start of the oldest transaction that was still open at the last successful run (rows of such a
transaction may have become visible only afterwards), and an anti-join of (key, version) pairs
against the ledger removes the overlap. What a run makes and its ledger entries are written first
and become valid with one marker file, so a run that fails at any point leaves no trace and the
next one neither skips nor repeats a record.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Successful runs after which a ledger's entries are folded into one base.
COMPACT_RUNS = 20


def watermark(log: DataFrame, start: str, end: str, committed: Column, failed: Column) -> DataFrame:
    """One row `since`: from where the next run must reread.

    The last successful run is the committed one with the latest `end`; it saw what was there when it started. A
    transaction was open then if it had started and not ended (a null `end` without a failure counts as never
    ended; one that failed later was still open), the run itself included. `since` is the earliest start of those;
    null if no run ever succeeded, so that everything is read.
    """
    runs = log.select(F.col(start).alias("s"), F.col(end).alias("e"), F.coalesce(committed, F.lit(False)).alias("ok"), F.coalesce(failed, F.lit(False)).alias("bad"))
    last = runs.filter("ok AND e IS NOT NULL").agg(F.max_by("s", "e").alias("own"))
    open_then = (F.col("s") <= F.col("own")) & (F.col("e").isNull() & ~F.col("bad") | (F.col("e") > F.col("own")))
    return runs.join(F.broadcast(last), F.lit(True)).agg(F.min(F.when(open_then, F.col("s"))).alias("since"))  # `last` is a single row


def processed_ledger(stored: DataFrame, key: str, version: list[str], at: str, removals: DataFrame | None = None, removed_at: str = "removed_at") -> DataFrame:
    """Per key the version stored last, without keys removed later: key, version columns.

    `removals` has (key, removed_at) of committed removals. One of several equal latest rows counts; of latest
    rows that differ, the greatest version. A row without a time is the oldest. Null keys are left out.
    """
    rows = stored.select(F.col(key), F.struct(F.col(at).alias("at"), F.struct(*version).alias("v")).alias("s"), F.lit(None).cast("timestamp").alias("gone"))
    if removals is not None:
        empty = F.lit(None).cast(rows.schema["s"].dataType)
        rows = rows.unionByName(removals.select(F.col(key), empty.alias("s"), F.col(removed_at).cast("timestamp").alias("gone")))
    last = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("s").alias("s"), F.max("gone").alias("gone"))
    kept = last.filter(F.col("s").isNotNull() & (F.col("gone").isNull() | F.coalesce(F.col("gone") <= F.col("s.at"), F.lit(False))))
    return kept.select(key, *[F.col(f"s.v.{v}").alias(v) for v in version])


def unprocessed(rows: DataFrame, ledger: DataFrame, key: str, version: list[str]) -> DataFrame:
    """Rows whose pair of key and version the ledger lacks; null versions compare equal to null."""
    held = ledger.select(F.col(key).alias("__key"), *[F.col(v).alias(f"__{v}") for v in version])
    pair = rows[key] == held["__key"]
    for v in version:
        pair &= rows[v].eqNullSafe(held[f"__{v}"])
    return rows.join(held, pair, "left_anti")


def changes(current: DataFrame, ledger: DataFrame, key: str, version: list[str], as_kind: str = "change_kind") -> DataFrame:
    """What the next run has to process: key, added | modified | removed, each key once.

    Pairs of key and version that the ledger holds are removed by an anti-join (null versions compare equal to
    null); what is left was added or modified. Keys of the ledger that `current` lacks were removed. A key with
    several current versions is modified if any of them is new. Null keys are left out.
    """
    now = current.select(key, *version).filter(F.col(key).isNotNull()).distinct()
    todo = unprocessed(now, ledger, key, version).select(key).distinct()
    keys = ledger.select(F.col(key).alias("__key"))
    changed = todo.join(keys, todo[key] == keys["__key"], "left").select(key, F.when(F.col("__key").isNull(), "added").otherwise("modified").alias(as_kind)).distinct()
    gone = keys.join(now.select(key), keys["__key"] == now[key], "left_anti").select(F.col("__key").alias(key), F.lit("removed").alias(as_kind)).distinct()
    return changed.unionByName(gone)


class Ledger:
    """What was processed, on shared storage: the version each key had in the run that processed it last.

    A run's entries (key, version, gone) lie in `folder/run=<number>-<id>`, its output in `folder/_out/run=...`, and
    the file `folder/_done/<number>-<id>` makes both valid. It is created last, after everything the run makes has been
    written, so a run that fails at any point, in a lazy plan too, leaves nothing that counts. After COMPACT_RUNS runs
    the entries are folded into one base, so that neither the driver's list of paths nor a read grows without bound.
    One writer at a time: a run that finds its number taken by another's marker fails.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, version: list[str], key_type: T.DataType, version_types: list[T.DataType]):
        self.spark, self.folder, self.key, self.version = spark, folder.rstrip("/"), key, version
        self.schema = T.StructType([T.StructField(key, key_type), *[T.StructField(v, t) for v, t in zip(version, version_types)]])
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._entries = T.StructType([*self.schema.fields, T.StructField("__gone", T.BooleanType())])

    def runs(self) -> list[str]:
        """The successful runs, oldest first; a base and those after it."""
        done = self._path(f"{self.folder}/_done")
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(done)) if self._fs.exists(done) else []
        return names[max((i for i, n in enumerate(names) if n.endswith("-base")), default=0) :]

    def frame(self) -> DataFrame:
        """Key and version as processed last, keys removed since left out."""
        every = None
        for n, r in enumerate(self.runs()):  # at most COMPACT_RUNS + 1
            rows = self.spark.read.schema(self._entries).parquet(f"{self.folder}/run={r}").withColumn("__run", F.lit(n))
            every = rows if every is None else every.unionByName(rows)
        if every is None:
            return self.spark.createDataFrame([], self.schema)
        last = every.groupBy(self.key).agg(F.max(F.struct("__run", "__gone", F.struct(*self.version).alias("v"))).alias("s"))
        return last.filter("NOT s.__gone").select(self.key, *[F.col(f"s.v.{v}").alias(v) for v in self.version])

    def pending(self, source: DataFrame, changed_at: str | None = None, since: object | None = None) -> DataFrame:
        """Rows of source whose key the ledger doesn't hold at their version, one row per key.

        Of several rows of a key the latest by `changed_at` counts, and of those the one with the greatest version. With
        `since` only rows from then on (and rows without a time) are read. A version that returns after another one was
        processed is pending again. Null keys are left out.
        """
        if changed_at and since is not None:
            source = source.filter((F.col(changed_at) >= F.lit(since)) | F.col(changed_at).isNull())
        order = [F.col(c) for c in ([changed_at] if changed_at else []) + self.version]
        rest = [c for c in source.columns if c != self.key]
        current = source.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(self.key, *[F.col(f"__row.`{c}`").alias(c) for c in rest])
        return unprocessed(current, self.frame(), self.key, self.version)

    def removed(self, source: DataFrame) -> DataFrame:
        """Keys the ledger holds that source, read whole, lacks."""
        return self.frame().select(self.key).join(source.select(self.key), self.key, "left_anti")

    def run(self, pending: DataFrame, process, removed: DataFrame | None = None) -> DataFrame | None:
        """Process the pending rows and mark them done; returns what `process` made of them, read back.

        `process` is given exactly the staged rows; a frame it returns is written before the marker is. `removed` (key)
        is staged with the run and leaves the ledger; with it `process` is called as process(rows, removed).
        """
        done = self.runs()
        number = int(done[-1].split("-")[0]) + 1 if done else 0
        run = f"{number:08d}-{uuid.uuid4().hex}"
        staged = f"{self.folder}/_staged/{run}"
        pending.write.parquet(f"{staged}/rows")
        rows = self.spark.read.schema(pending.schema).parquet(f"{staged}/rows")
        entries = rows.select(*self.schema.names, F.lit(False).alias("__gone"))
        if removed is None:
            result = process(rows)
        else:
            removed.select(self.key).write.parquet(f"{staged}/removed")
            gone = self.spark.read.schema(T.StructType([self.schema[self.key]])).parquet(f"{staged}/removed")
            empty = [F.lit(None).cast(self.schema[v].dataType).alias(v) for v in self.version]
            entries = entries.unionByName(gone.select(self.key, *empty, F.lit(True).alias("__gone")))
            result = process(rows, gone)
        made = isinstance(result, DataFrame)
        if made:
            result.write.parquet(f"{self.folder}/_out/run={run}")
        entries.write.parquet(f"{self.folder}/run={run}")
        self._mark(run, number)
        self._fs.delete(self._path(staged), True)
        if len(self.runs()) > COMPACT_RUNS:
            self.compact()
        return self.spark.read.schema(result.schema).parquet(f"{self.folder}/_out/run={run}") if made else result

    def load(self, entries: DataFrame) -> None:
        """Take key and version of what was processed elsewhere for a run of its own."""
        self.run(entries.select(*self.schema.names), lambda rows: None)

    def compact(self) -> None:
        """Fold all runs into one base; the runs' own entries are deleted after it counts."""
        old = self.runs()
        if not old:
            return
        run = f"{int(old[-1].split('-')[0]) + 1:08d}-{uuid.uuid4().hex}-base"
        self.frame().withColumn("__gone", F.lit(False)).write.parquet(f"{self.folder}/run={run}")
        self._mark(run, int(run.split("-")[0]))
        for r in old:
            self._fs.delete(self._path(f"{self.folder}/_done/{r}"), False)
            self._fs.delete(self._path(f"{self.folder}/run={r}"), True)

    def _mark(self, run: str, number: int) -> None:
        if any(int(r.split("-")[0]) >= number for r in self.runs()):
            raise RuntimeError(f"another run took number {number}")
        self._fs.create(self._path(f"{self.folder}/_done/{run}"), False).close()


def latest(stored: DataFrame, key: str, at: str, columns: list[str], tasks: int | None = None) -> DataFrame:
    """Of each key the row stored last: key, `columns`. Of equally late rows the greatest; null keys are left out.

    With `tasks` the result comes in that many partitions, however small, for costly work on each row.
    """
    rows = stored.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.col(at).alias("at"), F.struct(*columns).alias("r"))).alias("s"))
    last = rows.select(key, *[F.col(f"s.r.{c}").alias(c) for c in columns])
    return last.repartition(tasks, key) if tasks else last  # keys are unique here, so this spreads evenly
