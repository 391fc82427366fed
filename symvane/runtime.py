"""Session, table and lineage helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Largest table, in rows, whose rows an operator may merge in a single task or send to every executor.
MERGE_ROWS = 200_000


def session(name: str = "symvane", cores: str = "*", partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators are written for (AQE, UTC, Arrow)."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{cores}]")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_of(spark: SparkSession) -> int:
    """Tasks a shuffle is planned for: the session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; one of our own only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="symvane-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.symvane.scratch", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Lineage ends there, a lost executor loses nothing of it, and the planner knows the
    table's true size, so that a later broadcast rests on a measured bound. The files
    stay until `release` or until the shared folder is emptied.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/symvane-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes a core reads at once; a scan of at least so much for each core has splits enough as it is.
SPLIT_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores before costly work on each row, where it is a small scan of fewer files than there are cores.

    A scan of SPLIT_BYTES or more a core is left alone, whatever its files: large files are split by the reader.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= cores * SPLIT_BYTES:
        return df
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def release(df: DataFrame) -> None:
    """Delete the files of a frame made by `cut`, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/symvane-" in file:
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names near `wanted` that df doesn't hold yet, so that extra columns never clash."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
