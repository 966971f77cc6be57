"""Tables in the folder that the driver and all executors share: they outlive executors and have no lineage."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers that may be broadcast; their count is checked before.
SMALL = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder's URI below the checkpoint folder."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = sc._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: a cluster's tasks need a folder that they share")
        base = tempfile.mkdtemp(prefix="spotweave-")  # one machine, as in tests
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/spotweave-{uuid.uuid4().hex}"


#: For each thread, the folders that each open scope of ``passing`` deletes at its end.
_THREAD = threading.local()


def _scopes() -> list[list[str]]:
    if not hasattr(_THREAD, "scopes"):
        _THREAD.scopes = []
    return _THREAD.scopes


def written(df: DataFrame, keep: bool = False, folder: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder (a new one, or ``folder``), read again.

    Inside a scope of ``passing`` the table is deleted at the scope's end, but for those to ``keep``.
    """
    spark = df.sparkSession
    folder = folder or shared_folder(spark)
    if _scopes() and not keep:
        _scopes()[-1].append(folder)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """A scope whose written tables are needed until its end only."""
    _scopes().append([])
    try:
        yield
    finally:
        for folder in _scopes().pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if its rows are few."""
    return F.broadcast(df) if df.count() <= SMALL else df
