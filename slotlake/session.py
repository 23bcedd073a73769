"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Broadcast only what was measured to stay below this many bytes in memory.
BROADCAST_LIMIT_BYTES = 256 * 1024 * 1024

_SHIPPED: set[str] = set()


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings every slotlake session should have. UTC is required: timestamps
    in cells without a zone are UTC by definition."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Row conversion makes wide generated code. The JVM never compiles methods
        # over 8000 bytes; above that Spark falls back to its split-up projections.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the cluster's spark.checkpoint.dir.

    Only when that is unset in local mode (tests) a temporary folder is made,
    remembered for the rest of the session, and deleted when the process ends. On a
    cluster executors would each write to a disk of their own, so there it must be
    set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.slotlake.scratchDir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="run-slotlake-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.slotlake.scratchDir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the scratch folder that no other run uses."""
    return f"{scratch_root(spark)}/slotlake/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage by writing `df` once and reading it back.

    The files survive executor loss, and their size gives the optimizer true
    statistics for its join choice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint behind a size check; beyond it the planner is left free to
    shuffle (and to split skewed keys)."""
    if rows * row_bytes <= BROADCAST_LIMIT_BYTES:
        return F.broadcast(df)
    return df


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once an application: the
    driver serves it to them as a file."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="slotlake-code-")) / "slotlake.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) for any URI Spark can write to."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return jpath.getFileSystem(conf), jpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = hadoop_path(spark, path)
    return bool(fs.exists(jpath))


def delete_path(spark: SparkSession, path: str) -> None:
    fs, jpath = hadoop_path(spark, path)
    fs.delete(jpath, True)


def literal_path(path: str) -> str:
    """The path as a pattern that only it matches."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def folders_with(spark: SparkSession, pattern: str) -> list[str]:
    """Folders of the files that a glob pattern matches, sorted."""
    fs, jpath = hadoop_path(spark, pattern)
    return sorted(hit.getPath().getParent().toString() for hit in (fs.globStatus(jpath) or []))


def touch(spark: SparkSession, path: str) -> None:
    """Create an empty marker file."""
    fs, jpath = hadoop_path(spark, path)
    fs.create(jpath, True).close()


def marked_before(spark: SparkSession, pattern: str, seconds: int) -> list[str]:
    """Directories with a marker (glob `pattern`) at least that many seconds old."""
    fs, jpath = hadoop_path(spark, pattern)
    limit = int(time.time() * 1000) - seconds * 1000
    return [
        hit.getPath().getParent().toString()
        for hit in (fs.globStatus(jpath) or [])
        if hit.getModificationTime() <= limit
    ]


def read_small_text(spark: SparkSession | None, path: str) -> str:
    """A configuration file as one string (local path, or any URI with a session)."""
    if spark is None:
        with open(path, encoding="utf-8") as fh:
            return fh.read()
    row = spark.read.text(path, wholetext=True).head(1)
    return row[0].value if row else ""
