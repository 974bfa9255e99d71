"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_tables: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's spark.checkpoint.dir; only where a session has none (tests on one machine)
    is one made.
    """
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not conf:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="phenogrid-")
        sc.setCheckpointDir(conf)
    return conf.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when this process ends."""
    path = f"{shared_dir(spark)}/phenogrid/{tag}-{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(_remove_all)
    _tables.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def _remove_all() -> None:
    for spark, path in _tables:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended first
            return


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table of the shared folder and read it again: this cuts its lineage.

    Unlike blocks that executors keep, the files outlive a lost executor.
    """
    spark = df.sparkSession
    path = new_folder(spark, tag)
    # What the write shuffled goes when it ends; else it stays on the executors' disks until the driver's next collection.
    cleanup = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, cleanup)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def forget(df: DataFrame) -> None:
    """Remove the files behind a table of written() that nothing reads any more."""
    path = getattr(df, "written_path", None)
    if path:
        remove(df.sparkSession, path)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Bound the rows that go to a Python worker at once: documents can be very long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def size_in_memory(spark: SparkSession, times: int = 10) -> None:
    """Let joins reckon with rows that are so many times longer in memory than in files, so that none is broadcast that only its file makes look small."""
    spark.conf.set("spark.sql.sources.fileCompressionFactor", str(times))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of a column as text, modulo a number."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


_resident: dict[tuple, object] = {}


def resident(key: tuple, make):
    """What a Python worker keeps from task to task, made once; another key's makes room for it."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def release() -> None:
    """Called by tasks that keep nothing: a worker that served another operator before gives its cache back."""
    _resident.clear()
