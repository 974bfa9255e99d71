"""Feature tables, metadata, matrices, results and parameters: discovery, reading and writing."""

from __future__ import annotations

import json
import logging
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenogrid.labels import METADATA_NAMES

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FEATURES = re.compile(r"(_count|struct)\.parquet$")

log = logging.getLogger("phenogrid")


def _files(spark: SparkSession, folder: str) -> list[str]:
    """Paths in a folder of any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(str(s.getPath()) for s in fs.listStatus(path)) if fs.exists(path) else []


def _text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def feature_tables(spark: SparkSession, folder: str) -> dict[str, tuple[str, str]]:
    """{feature type: (path, id column)}: the id column is the one that isn't genome_id or value."""
    found = {}
    for path in _files(spark, folder):
        if _FEATURES.search(path):
            ids = [c for c in spark.read.parquet(path).columns if c not in ("genome_id", "value")]
            if len(ids) != 1:
                raise ValueError(f"{path} must have exactly one id column, found {ids}")
            found[ids[0]] = (path, ids[0])
    return found


def read_features(spark: SparkSession, folder: str) -> DataFrame:
    """All feature tables of a folder, long: (feature_type, genome_id, feature_id, value)."""
    parts = [spark.read.parquet(path).select(F.lit(kind).alias("feature_type"), F.col("genome_id").cast("string").alias("genome_id"), F.col(column).cast("string").alias("feature_id"), F.col("value").cast("double").alias("value")) for kind, (path, column) in feature_tables(spark, folder).items()]
    if not parts:
        raise ValueError(f"no feature tables in {folder}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """The metadata table with dotted names replaced."""
    files = [f for f in _files(spark, folder) if re.search(r"(^|/)metadata[^/]*\.parquet$", f)]
    if not files:
        raise FileNotFoundError(f"metadata parquet not found in {folder}")
    df = spark.read.parquet(*files)
    return df.select(*[F.col(f"`{c}`").alias(METADATA_NAMES.get(c, c)) for c in df.columns])


def write_matrix(matrix: DataFrame, folder: str, partition_by: list[str]) -> None:
    """One table for all jobs, a folder for each; rows within a file in order of genome and feature."""
    ordered = matrix.repartition(*partition_by, F.pmod(F.xxhash64("genome_id"), F.lit(16))).sortWithinPartitions(*partition_by, "genome_id", *[c for c in ("feature_id",) if c in matrix.columns])
    ordered.write.mode("overwrite").partitionBy(*partition_by).option("compression", "zstd").parquet(folder)
    # A partitioned table without rows has no file that tells its columns.
    _write_text(matrix.sparkSession, f"{folder.rstrip('/')}.schema.json", matrix.schema.json())


def read_matrix(spark: SparkSession, folder: str) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(_text(spark, f"{folder.rstrip('/')}.schema.json")))
    df = spark.read.schema(schema).parquet(folder)
    # An empty stratum is no folder's name, so it comes back as null.
    return df.na.fill("", ["strat_value"]) if "strat_value" in df.columns else df


def write_result(result: DataFrame, folder: str, values: dict[str, object]) -> None:
    """Write a table's partition of these values: its rows replace all that an earlier run wrote there, even if there are none now; other partitions stay."""
    place = "/".join([folder.rstrip("/"), *(f"{c}={str(v).lower() if isinstance(v, bool) else v}" for c, v in values.items())])
    result.drop(*values).write.mode("overwrite").option("compression", "zstd").parquet(place)


def read_result(spark: SparkSession, folder: str) -> DataFrame | None:
    """A table of write_result(), or None if there is none yet."""
    if not any("=" in f.rpartition("/")[2] for f in _files(spark, folder)):
        return None
    df = spark.read.parquet(folder)
    return df.withColumn("shuffled", F.col("shuffled").cast("boolean")) if "shuffled" in df.columns else df


def read_results(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """All result files of a folder by name, missing columns null, with each row's file name."""
    df = spark.read.option("mergeSchema", "true").option("pathGlobFilter", pattern).parquet(folder)
    return df.withColumn("filename", F.element_at(F.split(F.input_file_name(), "/"), -1))


#: Bytes of files and of shuffled rows that a task takes, and how much longer rows are in memory than in files.
TASK_BYTES, UNPACKED = 16 << 20, 10


def bound_tasks(spark: SparkSession, rows: int = 0, task_rows: int = 40_000) -> None:
    """Let what a task holds stay the same as tables grow, and broadcast no table that only its file makes look small.

    rows: of the table whose rows come together by key; a shuffle has a partition for each task_rows of them at
    least, of which adaptive execution joins small ones.
    """
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(TASK_BYTES))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES))
    spark.conf.set("spark.sql.sources.fileCompressionFactor", str(UNPACKED))
    parts = "spark.sql.shuffle.partitions"
    spark.conf.set(parts, str(max(int(spark.conf.get(parts)), 1 + rows // task_rows)))


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that the driver and all executors share, removed when this process ends.

    The folder is spark.checkpoint.dir; only where a session has none, as in tests on one machine, is one made.
    """
    import atexit
    import tempfile

    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="phenogrid-")
        sc.setCheckpointDir(shared)
    path = f"{shared.rstrip('/')}/phenogrid/{tag}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may have ended first
            return

    atexit.register(remove)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table of the shared folder, so that it is computed once and outlives a lost executor."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, tag)
    # What the write shuffled goes when it ends; else it stays on the executors' disks until the driver's next collection.
    cleanup = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, cleanup)
    return spark.read.schema(df.schema).parquet(path)


def write_parameters(spark: SparkSession, folder: str, n_fold: int | None, split: tuple[float, float], seed: int) -> dict:
    train, val = split
    p = {"mode": "cv" if n_fold is not None else "splits", "n_fold": n_fold, "split": list(split), "train_prop": train, "val_prop": val, "test_prop": round(1 - train - val, 12), "seed": seed, "timestamp": time.strftime("%Y-%m-%d %H:%M:%S")}
    _write_text(spark, f"{folder.rstrip('/')}/ml_parameters.json", json.dumps(p, indent=2))
    return p


def read_parameters(spark: SparkSession, folder: str) -> dict:
    """The parameters beside a matrix, or in the folder above."""
    from phenogrid.functions.validate import check_mode, check_seed

    folder = folder.rstrip("/")
    for place in (folder, folder.rpartition("/")[0]):
        if f"{place}/ml_parameters.json".split("://")[-1].lstrip("/") in [f.split(":")[-1].lstrip("/") for f in _files(spark, place)]:
            p = json.loads(_text(spark, f"{place}/ml_parameters.json"))
            if p.get("n_fold") == {}:
                p["n_fold"] = None
            if check_mode(p["split"], p["n_fold"]) != p["mode"]:
                raise ValueError(f"mode {p['mode']} does not go with split {p['split']} and n_fold {p['n_fold']}")
            check_seed(p["seed"])
            return p
    raise FileNotFoundError(f"no ml_parameters.json in {folder} or above")


def write_tsv(rows: DataFrame, path: str, order: list[str]) -> None:
    """A small table, such as a log, as one tab-separated file with a header; it appears under its name when it is complete."""
    spark = rows.sparkSession
    folder, _, _ = path.rpartition("/")
    staged = f"{folder}/_staged-{uuid.uuid4().hex}"
    rows.orderBy(*order).coalesce(1).write.csv(staged, sep="\t", header=True, emptyValue="")
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        part = next(f for f in _files(spark, staged) if f.rpartition("/")[2].startswith("part-"))
        fs.delete(jvm.org.apache.hadoop.fs.Path(path), False)
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.hadoop.fs.Path(path)):
            raise OSError(f"can't rename to {path}")
    finally:
        fs.delete(jvm.org.apache.hadoop.fs.Path(staged), True)


def read_table(spark: SparkSession, source: DataFrame | str, file: str | None = None) -> DataFrame:
    """A DataFrame as it is; a path as Parquet or, by its ending, tab-separated text; a folder's file."""
    if isinstance(source, DataFrame):
        return source
    path = f"{source.rstrip('/')}/{file}" if file else source
    if path.endswith((".tsv", ".txt")):
        return spark.read.csv(path, sep="\t", header=True, inferSchema=True)
    return spark.read.parquet(path)
