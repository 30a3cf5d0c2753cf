"""Sessions: a default one for scripts and tests, and the package on every executor."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HOME = Path(__file__).resolve().parent
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in the Python workers of a session, once per application.

    Spark's own file server takes the archive to the executors, so nothing has to be installed or shared there.
    """
    # texts are long: batches of Spark's ten thousand rows would hold hundreds of MB in each task
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        to = Path(tempfile.mkdtemp()) / "quarryloom_package.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(HOME.rglob("*.py")):
                z.write(p, Path(HOME.name) / p.relative_to(HOME))
        sc.addPyFile(str(to))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the cluster names; a session on one machine gets one of its own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder:
        return folder
    if not re.match(r"local\b(?!-cluster)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def checkpoint_ready(spark: SparkSession) -> None:
    """checkpoint() writes to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def local_session(cores: int | str = 4, name: str = "quarryloom", **conf: str) -> SparkSession:
    """A session for scripts and tests on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
        "spark.sql.adaptive.enabled": "true",
    } | conf
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
