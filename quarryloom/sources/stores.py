"""Stores: versioned tables behind a log of snapshots, one store per knowledge base, drafts that never overwrite.

All paths go through Hadoop's file system, so they may be on any store that Spark knows.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KB_ID, KB_ID_CHARS = r"^[A-Za-z0-9][A-Za-z0-9_-]*\z", 64


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


class Conflict(Exception):
    """Another writer has published since the snapshot that this one builds on."""


def _entry(root: str, number: int) -> str:
    return f"{root}/_log/{number:020d}"


def _told(spark: SparkSession, root: str, number: int) -> tuple[str, int] | None:
    """(version, rows) of a log entry; None if there is none, or if its writer has not finished it."""
    fs, path = _fs(spark, root)
    if not fs.exists(path(_entry(root, number))):
        return None
    lines = [r.value for r in spark.read.text(_entry(root, number)).collect()]
    version, _, rows = lines[0].partition("\t") if lines else ("", "", "")
    rows, ended, _ = rows.partition(";")
    return (version, int(rows)) if ended else None


def last_snapshot(spark: SparkSession, root: str) -> int:
    """The number of the newest finished snapshot; 0 before the first."""
    fs, path = _fs(spark, root)
    if not fs.exists(path(f"{root}/_log")):
        return 0
    numbers = sorted((int(s.getPath().getName()) for s in fs.listStatus(path(f"{root}/_log")) if s.getPath().getName().isdigit()), reverse=True)
    return next((n for n in numbers if _told(spark, root, n)), 0)


def publish_version(df: DataFrame, root: str, version: str, after: int | None = None) -> tuple[int, str]:
    """Writes a version to its own folder, checks it, then appends it to the log; returns (rows, version).

    The log has a file a snapshot, numbered without gaps. A number is taken by creating its file, which fails if it is
    there: of two writers one gets it. With ``after`` (the snapshot that the version builds on) the other one gets
    Conflict; without, it takes the next number. Nothing is moved or deleted, so readers always find a whole snapshot,
    and a failure before the last step leaves the log as it is. Earlier versions stay.
    """
    spark = df.sparkSession
    if after is not None and last_snapshot(spark, root) != after:
        raise Conflict(f"snapshot {after} is not the newest")
    df.write.mode("errorifexists").parquet(f"{root}/versions/{version}")
    rows = spark.read.parquet(f"{root}/versions/{version}").count()
    if not rows:
        raise ValueError(f"version {version} is empty; the current one stays")
    fs, path = _fs(spark, root)
    fs.mkdirs(path(f"{root}/_log"))
    number = (last_snapshot(spark, root) if after is None else after) + 1
    while True:
        try:
            out = fs.create(path(_entry(root, number)), False)
        except Py4JJavaError as e:
            if not fs.exists(path(_entry(root, number))):
                raise
            if after is not None:
                raise Conflict(f"snapshot {number} has been taken") from e
            number += 1
            continue
        out.write(bytearray(f"{version}\t{rows};\n".encode()))
        out.close()
        return rows, version


def current_version(spark: SparkSession, root: str) -> str:
    return _told(spark, root, last_snapshot(spark, root))[0]


def read_snapshot(spark: SparkSession, root: str, number: int) -> DataFrame:
    """A snapshot by its number, also an earlier one."""
    told = _told(spark, root, number)
    if told is None:
        raise ValueError(f"no snapshot {number}")
    return spark.read.parquet(f"{root}/versions/{told[0]}")


def read_current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/versions/{current_version(spark, root)}")


def valid_kb_id(c: Column) -> Column:
    return F.coalesce(c.rlike(KB_ID) & (F.length(c) <= KB_ID_CHARS), F.lit(False))


def write_kb(df: DataFrame, root: str) -> None:
    """One folder per ``kb_id``; a bad id fails the write before anything is written."""
    checked = df.withColumn("kb_id", F.when(valid_kb_id(F.col("kb_id")), F.col("kb_id")).otherwise(F.raise_error(F.concat(F.lit("bad kb_id: "), F.coalesce("kb_id", F.lit("null"))))))
    checked.write.mode("append").partitionBy("kb_id").parquet(root)


def read_kb(spark: SparkSession, root: str, kb_id: str) -> DataFrame:
    """Only that store's folder is read."""
    return spark.read.parquet(root).where(F.col("kb_id") == kb_id)


def list_kbs(spark: SparkSession, root: str) -> list[str]:
    """Names of the stores, in order; folders with other names are left out."""
    fs, path = _fs(spark, root)
    names = [s.getPath().getName().removeprefix("kb_id=") for s in fs.listStatus(path(root)) if s.isDirectory()]
    ok = spark.createDataFrame([(n,) for n in names] or [("",)], "name string").where(valid_kb_id(F.col("name")))
    return sorted(r.name for r in ok.collect())


def write_drafts(df: DataFrame, target: str) -> str:
    """Writes drafts to ``target`` or, if that is there, to the next free ``<target>.draft-N``; returns where."""
    fs, path = _fs(df.sparkSession, target)
    at, n = target, 0
    while fs.exists(path(at)):
        n += 1
        at = f"{target}.draft-{n}"
    df.write.mode("errorifexists").parquet(at)
    return at
