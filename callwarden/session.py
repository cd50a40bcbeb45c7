"""Session set-up for local runs and lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    parts = shuffle_partitions or (cpus if isinstance(cpus, int) else 8)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("callwarden")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: list = []


def ship_package(spark: SparkSession) -> None:
    """Give executors this package once per context, for the few Arrow stages."""
    context = spark.sparkContext
    if any(known is context for known in _shipped):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="callwarden-"), "callwarden")
    archive = shutil.make_archive(target, "zip", os.path.dirname(home), os.path.basename(home))
    context.addPyFile(archive)
    _shipped.append(context)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; a scratch folder serves one-machine sessions only."""
    if spark.sparkContext.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="spark-ckpt-")
    spark.sparkContext.setCheckpointDir(configured)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on the shared checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
