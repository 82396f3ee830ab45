"""Session set-up and lineage cutting.

Iterative operators write each round to a Parquet table under the folder the cluster names
in ``spark.checkpoint.dir`` and read it back.  Unlike executor-local blocks such a table
survives the loss of an executor, and its size statistics let AQE pick join strategies.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SCRATCH_KEY = "veilmill.scratch.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: set[str] = set()
_writing: dict[str, tuple[int, str]] = {}
_lock = threading.Lock()


def build_session(master: str | None = None, app: str = "veilmill", **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.files.maxPartitionBytes": "128m",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark context.

    Functions that run in Python workers are sent by name, so the workers must be able to import them
    wherever the session was started.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="veilmill-code-")) / "veilmill_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, one sub-folder per session."""
    known = spark.conf.get(_SCRATCH_KEY, None)
    if known:
        return known
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(
                "set spark.checkpoint.dir to a folder that every executor can reach"
            )
        base = tempfile.mkdtemp(prefix="veilmill-")
    path = f"{base.rstrip('/')}/veilmill-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path)
    fs.deleteOnExit(hadoop_path)
    spark.conf.set(_SCRATCH_KEY, path)
    return path


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Files of the shuffles of a query go when it ends, not when the driver happens to collect its garbage.

    Threads of a session share the setting: it is as before when the last of them has left.
    """
    key = spark.sparkContext.applicationId
    with _lock:
        n, before = _writing.get(key) or (0, spark.conf.get(_CLEANUP, "false"))
        _writing[key] = n + 1, before
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _writing.pop(key)
            if n > 1:
                _writing[key] = n - 1, before
            else:
                spark.conf.set(_CLEANUP, before)


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the scratch folder and continue from the written table."""
    return _written(df, name)[0]


@contextmanager
def temporary(df: DataFrame, name: str = "step") -> Iterator[DataFrame]:
    """``cut_lineage`` for the time of a block; the table goes at its end, so what is worked out later must not need it."""
    made, path = _written(df, name)
    try:
        yield made
    finally:
        spark = df.sparkSession
        hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_end(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
