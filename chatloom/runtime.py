"""What operators need from a Spark session besides its DataFrames: table paths, shared storage, shipped code."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, which may be any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share; a local one where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _own_dir:
            _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="chatloom-")
            _remove_at_exit(spark, _own_dir[app])
        base = _own_dir[app]
    return base.rstrip("/")


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    def remove() -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            delete(spark, path)

    atexit.register(remove)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path in whatever store it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession):
    """Shuffle files of the queries run inside are removed as each query ends: their results are in shared storage by then."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """``df`` written to shared storage and read again: lineage ends here, and lost executors cost nothing that is done.

    ``by``: a column of few values, each of which gets a folder of its own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chatloom/{uuid.uuid4().hex}-{tag}"
    with tidy_shuffles(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    _remove_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._chatloom_path = path
    return out


def discard(written: DataFrame, part: str | None = None) -> None:
    """Delete what :func:`materialise` wrote, or one ``column=value`` of it, when nothing will read it again."""
    delete(written.sparkSession, f"{written._chatloom_path}/{part}" if part else written._chatloom_path)


#: Bytes of an Arrow batch on its way to a Python worker, which holds a few times that.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once a session; their Python workers then need no shared folder.

    Arrow batches are cut at ``BATCH_BYTES``, unless the session says a smaller number.
    """
    if int(spark.conf.get(_BATCH).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # already running from an archive
        return
    fd, path = tempfile.mkstemp(prefix="chatloom-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
