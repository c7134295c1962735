"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, shuffle_partitions: int = 8, app: str = "docweave") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own session."""
    cpus = cpus or os.cpu_count() or 1
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session.

    Only where the session names none and runs in one machine (`local[...]`: tests, a laptop) a local
    folder is made; it is removed at the end. On a cluster without that setting this raises, as a
    folder of each machine's own would lose rows.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        check_one_machine(spark.sparkContext.master)
        folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = "file://" + folder
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def check_one_machine(master: str) -> None:
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"Set spark.checkpoint.dir to a folder that all executors of {master} share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; nothing exists there yet. What is there goes when Python ends."""
    root = f"{shared_dir(spark)}/docweave/{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_remove, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


_ROOTS: set[str] = set()


def _remove(spark: SparkSession, root: str) -> None:
    """Remove a scratch folder, if the session still runs."""
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone; the folder is left to its owner
        pass


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once per session; no need where it is installed there."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    _SHIPPED.add(spark.sparkContext.applicationId)
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{here.name}.zip"
    atexit.register(shutil.rmtree, target.parent, ignore_errors=True)
    with zipfile.ZipFile(target, "w") as packed:
        for file in sorted(here.rglob("*.py")):
            packed.write(file, file.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(target))


_SHIPPED: set[str] = set()


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` once as parquet in the shared folder and read it back.

    It cuts the lineage: a lost executor costs only the tasks it ran, not the stages before.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
