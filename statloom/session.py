"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Where executors share files on a cluster; read from the session, never guessed.
CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("STATLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers of ``spark`` import this package, wherever they run; once for each context."""
    context = spark.sparkContext
    if getattr(context, "_statloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for module in sorted(package.rglob("*.py")):
            file.write(module, module.relative_to(package.parent))
    context.addPyFile(str(archive))  # Spark's own file server hands it to the executors
    context._statloom_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of the cluster; set one of our own only where a local session names none."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if not folder and not context.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} is unset: executors need a folder that they share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from those files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like :func:`cut_lineage`, as a parquet table: for large results of which steps read some columns each."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
