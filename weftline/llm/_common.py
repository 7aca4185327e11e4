"""What the operators of this subpackage share: the shared folder, lineage cuts, names."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null id ranks after every other id.
LAST_ID = 9223372036854775807
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(out))
    _shipped.add(app)


#: The paths given out within the innermost scratch() of this thread.
_within: ContextVar[list[str] | None] = ContextVar("within", default=None)


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    The folder is the session's spark.checkpoint.dir. Where that is unset, a temporary one
    serves if the master is local; on a cluster that is an error, for executors would not
    see each other's files. The path goes at the end of the scratch() it is asked for in,
    else as the JVM ends. The session's settings stay as they are.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir()
    path = f"{base.rstrip('/')}/weftline-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    if (paths := _within.get()) is not None:
        paths.append(path)
    return path


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes such paths, once nothing reads them any more."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(where, True)
        fs.cancelDeleteOnExit(where)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end the shared paths given out within, in this thread, but those taken from the list.

    What an operator returns reads such paths, so write it before the end:
    `with scratch(spark): operator(docs).write.parquet(...)`.
    """
    paths: list[str] = []
    token = _within.set(paths)
    try:
        yield paths
    finally:
        _within.reset(token)
        remove(spark, paths)


def handed_on(paths: list[str]) -> None:
    """Gives paths taken from an inner scratch() to the one around it, if there is one."""
    if (outer := _within.get()) is not None:
        outer.extend(paths)


def materialize(df: DataFrame, compression: str = "zstd", **options: str) -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it from there."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.options(compression=compression, **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """The top-level column of that exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else; wholly ASCII strings take the fast path."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip(os.sep)}/{name}.parquet")


def open_fs(uri: str):
    """(file system, path) of pyarrow for a folder that all executors share."""
    from pyarrow import fs

    parts = urlsplit(uri)
    return fs.FileSystem.from_uri("file://" + parts.path if parts.scheme in ("", "file") else uri)
