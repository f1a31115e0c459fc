"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "carecheck", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; everything else is the cluster's choice."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Where none is named, local mode has one of its own; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.master == "local" or context.master.startswith("local["):
        return f"/tmp/checkpoints/{context.applicationId}"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def new_folder(spark: SparkSession) -> str:
    """A new name under the shared folder; Spark makes it when it writes there."""
    return f"{shared_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"


ROWS_PER_FILE = 40_000  # rows with texts that one task writes
LEAST_ROWS = 1_000  # fewer are not worth a task


def spread(df: DataFrame, key: str, rows_per_part: int = ROWS_PER_FILE) -> DataFrame:
    """The rows dealt by the hash of a unique key over as many partitions as their number asks for, and as there are cores.

    Counts the rows, a job of its own. A source file of one row group is one task however large the cluster; what is
    computed after this is not.
    """
    rows = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, -(-rows // rows_per_part), min(cores, -(-rows // LEAST_ROWS))), key)


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per application, so that it need not be installed there."""
    context = spark.sparkContext
    if getattr(context, "_carecheck_shipped", None) != context.applicationId:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp()) / "carecheck.zip"  # read on the driver, which hands it to the workers
        with zipfile.ZipFile(archive, "w") as package:
            for source in sorted(root.rglob("*.py")):
                package.write(source, source.relative_to(root.parent))
        context.addPyFile(str(archive))
        context._carecheck_shipped = context.applicationId


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
