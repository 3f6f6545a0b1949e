"""Session settings the operators rely on."""

from __future__ import annotations

import io
import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings that change results or plans; cluster sizing stays with the cluster.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # JSON bodies may repeat a key; the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Sketches and week lists take a few KB per group; keep them hashed for longer
    # before falling back to sorting.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "8192",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the required settings to a session somebody else started."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder.

    A folder of our own is set only where none is configured and all tasks run
    in this process. On a cluster that would be another disk on every machine.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="eventloom-checkpoint-")
    context.setCheckpointDir(folder)


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back.

    Cuts the lineage like `checkpoint()`, but computes the rows once, and the
    files carry the sizes Spark's own choice of joins needs. The table stays there
    as long as the application, as the result is read later; inside a
    `scratch_scope` it is removed at the end.
    """
    path = scratch_path(df.sparkSession)
    if _scope.get() is not None:
        _scope.get().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_scope: ContextVar[list[str] | None] = ContextVar("scratch_scope", default=None)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the tables materialised inside, when all their readers are done."""
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in paths:
            remove_folder(spark, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession) -> str:
    """A new folder name inside the shared checkpoint folder.

    All such folders lie below one of this application, which the file system
    removes when the application ends.
    """
    ensure_checkpoint_dir(spark)
    context = spark.sparkContext
    folder = f"{context._jsc.sc().getCheckpointDir().get()}/eventloom-{context.applicationId}"
    if folder not in _roots:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _roots.add(folder)
    return f"{folder}/{uuid.uuid4()}"


_roots: set[str] = set()


def local_session(cpus: str | int = 8, app: str = "eventloom") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable for Python workers, once per application.

    Only the combining of very large islands runs Python on the workers.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = pathlib.Path(__file__).resolve().parent
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as files:
        for source in sorted(package.rglob("*.py")):
            files.write(source, source.relative_to(package.parent))
    path = context._jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark)}/{package.name}.zip")
    stream = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    stream.write(archive.getvalue())
    stream.close()
    context.addPyFile(path.toString())
    _shipped.add(context.applicationId)
