"""Frames that operators keep because they are read several times.

`keep` persists a frame (memory, then disk; lost blocks are computed again from lineage) and
remembers it; nothing runs.  `discard` deletes a staged frame that nothing reads any more.  `stage` writes a frame to the shared folder at once and returns
the written table: its plan is one scan whatever the depth of the frame's own plan, and a lost
executor loses nothing.  `release` drops what both have kept so far in the session; a caller that
has written its result calls it.
"""
from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from .session import shared_folder

_KEPT: list[DataFrame] = []
_STAGED: list[tuple[SparkSession, str, str | None]] = []  # session, path, table


def keep(df: DataFrame) -> DataFrame:
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _KEPT.append(kept)
    return kept


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to a new path below the shared folder, and read from there."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    _STAGED.append((spark, path, None))
    return spark.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, name: str, buckets: int, *cols: str, placed: bool = False) -> DataFrame:
    """df as a table bucketed by `cols`: joins on them do not shuffle it again.  A frame that is `placed` is
    partitioned like the buckets already and is written as it lies."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    table = "parallax_" + path.rstrip("/").rsplit("/", 1)[-1].replace("-", "_")
    rows = df if placed else df.repartition(buckets, *cols)
    rows.write.bucketBy(buckets, *cols).sortBy(*cols).option("path", path).option("compression", "zstd").saveAsTable(table)
    _STAGED.append((spark, path, table))
    return spark.table(table)


def discard(*frames: DataFrame) -> None:
    """Deletes staged frames, and lets Spark drop the shuffles of what is not referred to any more."""
    for df in frames:
        spark, files = df.sparkSession, df.inputFiles()
        for x in [x for x in _STAGED if x[0] is spark and x[2] is None and any(f"/{x[1].rstrip('/').rsplit('/', 1)[-1]}/" in f for f in files[:1])]:
            _delete(spark, x[1])
            _STAGED.remove(x)
    for spark in {df.sparkSession for df in frames}:
        spark.sparkContext._jvm.System.gc()


def _delete(session: SparkSession, path: str) -> None:
    place = session._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(session._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession | None = None) -> int:
    """Unpersist or delete what was kept so far (of one session, or all); returns how many frames."""
    own = [d for d in _KEPT if spark is None or d.sparkSession is spark]
    for d in own:
        d.unpersist()
        _KEPT.remove(d)
    written = [x for x in _STAGED if spark is None or x[0] is spark]
    for x in written:
        session, path, table = x
        if table:
            session.sql(f"DROP TABLE IF EXISTS {table}")
        _delete(session, path)
        _STAGED.remove(x)
    return len(own) + len(written)
