"""Signals as a stream: decayed state per target, windowed counts, incremental tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from symvane.functions.scoring import DELTAS, HALF_LIFE
from symvane.runtime import scratch_dir
from symvane.sources.records import changed_files, upsert

STATE = T.StructType([T.StructField("alpha", T.DoubleType()), T.StructField("beta", T.DoubleType()), T.StructField("updated_at", T.LongType())])
UPDATE = T.StructType([T.StructField("target_kind", T.StringType()), T.StructField("target_id", T.LongType()), *STATE.fields])


def fold_signals(state: tuple[float, float, int] | None, rows: list[tuple[int, str]]) -> tuple[float, float, int]:
    """State after signals (at, kind) in order of time: decay to the signal's time, then add.

    A signal older than the state doesn't decay it and counts in full; the time never goes back.
    """
    alpha, beta, last = state or (0.0, 0.0, rows[0][0])
    for at, kind in rows:
        if at > last:
            share = 0.5 ** ((at - last) / HALF_LIFE)
            alpha, beta, last = alpha * share, beta * share, at
        a, b = DELTAS.get(kind, (0.0, 0.0))
        alpha, beta = alpha + a, beta + b
    return alpha, beta, last


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = sorted((int(at), str(kind)) for pdf in batches for at, kind in zip(pdf["at"], pdf["kind"]) if pd.notna(at))
    if rows:
        now = fold_signals(state.get if state.exists else None, rows)
        state.update(now)
        yield pd.DataFrame([(key[0], int(key[1]), *now)], columns=UPDATE.names)


def utility_stream(signals: DataFrame) -> DataFrame:
    """A stream of signals (target_kind, target_id, kind, at) as a stream of states, one row per target and batch it changed in."""
    return signals.select("target_kind", "target_id", "kind", "at").groupBy("target_kind", "target_id").applyInPandasWithState(_step, UPDATE, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(signals: DataFrame, width: str = "1 hour", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Signals per kind and window of event time (column ts), with a watermark for late ones."""
    return signals.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "kind", "n")


def sessions(signals: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of every target: runs of signals less than a gap apart."""
    return signals.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "target_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "target_id", "n")


def run_to_table(stream: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all there is and return what it wrote, with the batch it came from (batch_id).

    Batches are written by their number, so a batch that is run again after a failure replaces itself.
    """
    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/symvane-stream-{uuid.uuid4().hex}"
    out = f"{base}/rows"

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch_id={batch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint or f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])).parquet(out)


def upsert_batches(spark: SparkSession, table: str, keys: list[str], scope: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps a Parquet table: each batch replaces the scopes it brings.

    Versions of the table lie side by side, `table/v=N`; a batch writes version N + 1 from the last one before
    it, so running it again gives the same version.
    """

    def apply(batch: DataFrame, number: int) -> None:
        before = latest_version(spark, table, number)
        new = batch if before is None else upsert(before, batch, keys, scope)
        new.write.mode("overwrite").parquet(f"{table}/v={number + 1}")

    return apply


def latest_version(spark: SparkSession, table: str, most: int | None = None) -> DataFrame | None:
    """The newest version of a table kept by `upsert_batches`, up to number `most`."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(table)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = [int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v=")]
    found = [n for n in found if (most is None or n <= most) and fs.exists(hadoop.Path(f"{table}/v={n}/_SUCCESS"))]
    return spark.read.parquet(f"{table}/v={max(found)}") if found else None


def only_changed(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Files of a batch (path, hash, ...) whose content isn't stored already."""
    return batch if stored is None else changed_files(batch, stored)
