"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "jobmeter", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; pass further settings as keywords with '__' for '.'."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    defaults.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_OWN: dict[str, str] = {}  # by application, the folder of a local session that names none


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only a local master, whose executors are the driver itself, may go without; it gets one folder for the session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir is not set; name a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="jobmeter-")
    return _OWN[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


@contextmanager
def staged(df: DataFrame, label: str, session: SparkSession | None = None) -> Iterator[DataFrame]:
    """``df`` written to the shared folder and read back, so that later steps do not depend on its lineage.

    The copy is removed when the block ends. A batch of a stream belongs to a session of its own, without adaptive plans; ``session`` names another one to read in.
    """
    spark = session or df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        fs, folder = file_system(spark, path)
        fs.delete(folder, True)


@contextmanager
def small_splits(spark: SparkSession, size: int = 16 << 20, shuffled: int = 8 << 20) -> Iterator[None]:
    """A task of what runs in the block reads at most ``size`` bytes of a scan, and is given no more than ``shuffled`` bytes by joining small partitions of a shuffle.

    Packed files and shuffles hold far more in rows, which some steps sort. Settings that are lower already stay.
    """
    given = {}
    for name, most in (("spark.sql.files.maxPartitionBytes", size), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", shuffled)):
        now = spark.conf.get(name)
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > most:
            given[name] = now
            spark.conf.set(name, most)
    try:
        yield
    finally:
        for name, was in given.items():
            spark.conf.set(name, was)


def keep_versions(spark: SparkSession, path: str, prefix: str = "", keep: int = 2) -> list[int]:
    """Numbered folders ``<prefix><n>`` below ``path``; all but the ``keep`` highest are removed."""
    fs, folder = file_system(spark, path)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    found = sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit())
    for n in found[:-keep]:
        old = file_system(spark, f"{path}/{prefix}{n}")[1]
        fs.delete(old, True)
    return found[-keep:]
