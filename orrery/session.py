"""Session helpers: a local builder for tests, and the checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "orrery") -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the caller's session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; only a local master without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="orrery-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, for tables that a query writes."""
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    sc._orrery_written = [*getattr(sc, "_orrery_written", []), path]
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the checkpoint folder: compressed, with statistics, and read by column. Like `cut` it ends the lineage, but it keeps no partitioning."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> int:
    """Delete what this context's queries have written and checkpointed so far; results that aren't read yet are lost.

    For the caller to use once it has its results: a query can't know when its rows have been read.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if not folder:
        return 0
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [hadoop.Path(p) for p in getattr(sc, "_orrery_written", [])]
    gone += [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("rdd-")]
    sc._orrery_written = []
    return sum(bool(fs.delete(p, True)) for p in gone)


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per context, unless they have it on their path already."""
    import os
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_orrery_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="orrery-code-")  # read by the driver alone, which sends it to the executors
    path = os.path.join(folder, "orrery.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.join("orrery", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._orrery_shipped = True
