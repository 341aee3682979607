"""Scratch tables in the shared checkpoint folder, and small helpers the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most this many narrow rows may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 20_000


#: Folders of local sessions that have none set.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session in local mode (tests) gets a folder of its own; on a cluster executors would
    not see each other's files there, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _LOCAL.setdefault(spark.sparkContext.applicationId, "")
        if not found:
            found = _LOCAL[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="candela-")
    return found.rstrip("/")


#: Folder of this process's tables under each shared folder; it goes when the driver's JVM ends.
_FOLDERS: dict[tuple[str, str], str] = {}
#: Tables made since each open :func:`scratch` began.
_OPEN: list[list[str]] = []


def _folder(spark: SparkSession) -> str:
    key = (spark.sparkContext.applicationId, shared_dir(spark))
    if key not in _FOLDERS:
        _FOLDERS[key] = f"{key[1]}/candela-{uuid.uuid4().hex}"
        path, fs = _hadoop(spark, _FOLDERS[key])
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return _FOLDERS[key]


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    Cuts the lineage; a lost executor costs nothing already written, and the plan that reads
    it knows the true size.
    """
    spark = df.sparkSession
    path = folder_for(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder_for(spark: SparkSession) -> str:
    """The path of a new table in the shared folder; it goes with the :func:`scratch` around it."""
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def files_in(spark: SparkSession, path: str) -> list[str]:
    """The files of a folder, by name."""
    folder, fs = _hadoop(spark, path)
    return sorted(str(x.getPath()) for x in fs.listStatus(folder))


def _path_of(df: DataFrame) -> str | None:
    return next((name.rsplit("/", 1)[0] for name in df.inputFiles()[:1]), None)


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that nothing reads any more."""
    path = _path_of(df)
    if path:
        folder, fs = _hadoop(df.sparkSession, path)
        fs.delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables that are :func:`written` inside when it ends, but those given to the function it yields."""
    made: list[str] = []
    kept: list[str] = []
    _OPEN.append(made)

    def keep(df: DataFrame) -> DataFrame:
        out = written(df)
        kept.append(made.pop())
        return out

    try:
        yield keep
    finally:
        _OPEN.pop()
        if _OPEN:
            _OPEN[-1] += kept
        for path in made:
            folder, fs = _hadoop(spark, path)
            fs.delete(folder, True)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if ``rows``, its counted size, is small; else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality of columns of the same name."""
    return reduce(lambda a, b: a & b, (left[n].eqNullSafe(right[n]) for n in names))


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 4: remainder 2 is the held-out part. A null id counts as 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4, F.lit(0))


def unit_hash(*cols: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) from the hash of the columns and a seed."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 53)) / F.lit(float(1 << 53))
