"""Where jobs cut their lineage: tables in the folder that the cluster shares.

Executors may go at any time, so nothing here relies on blocks that live on
one of them. `materialize` writes Parquet under `spark.checkpoint.dir`, which
the driver and all executors see, and reads it back with the same schema.
`Scratch` does so for the tables of one job and removes them when it ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: With this setting Spark frees a query's shuffle files as soon as the query is done.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; a folder of our own only where none is set and Spark runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="beaconframe-"))
    return context._jsc.sc().getCheckpointDir().get()


_writing: dict[str, tuple[int, str]] = {}
_lock = threading.Lock()


@contextlib.contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """While this lasts, queries of the session free their shuffle files as they end; of several such times the last one restores the setting.

    Only for writes: what an iterator to the driver has not read yet would have to be made again.
    """
    name = spark._jsparkSession.sessionUUID()
    with _lock:
        n, before = _writing.get(name, (0, None))
        if not n:
            before = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _writing[name] = (n + 1, before)
    try:
        yield
    finally:
        with _lock:
            n, before = _writing.pop(name)
            if n > 1:
                _writing[name] = (n - 1, before)
            else:
                spark.conf.set(_CLEANUP, before)


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    with _cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows up to which a table is small enough to be sent to every executor.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """`df`, marked for broadcast if it is counted to have SMALL rows at most; else Spark joins it as it can."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


#: Paths of the tables that `materialize` has written and nobody has released, by session.
_kept: dict[str, SparkSession] = {}


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` once as Parquet in the shared folder and return the reread table, which stays until `release` or the program's end."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    out = _write(df, path)
    _kept[path] = df.sparkSession
    return out


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder for what a stream or a store writes; it goes as a table of `materialize` does."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _kept[path] = spark
    return path


def release(*tables: DataFrame | str) -> None:
    """Removes tables of `materialize` that nothing reads any more, given as they are, as a DataFrame on them, or as paths."""
    for table in tables:
        files = [table] if isinstance(table, str) else table.inputFiles()
        for path in [p for p in _kept if any(f.rstrip("/").endswith(p.split(":", 1)[-1].rstrip("/")) or f"{p.split(':', 1)[-1]}/" in f for f in files)]:
            _remove(_kept.pop(path), path)


def _release_all() -> None:
    for path, spark in list(_kept.items()):
        del _kept[path]
        with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
            _remove(spark, path)


atexit.register(_release_all)


class Scratch:
    """The tables of one job, removed at its end: `with Scratch(spark) as table: x = table(df, "x")`.

    What leaves the block must be written by `materialize` within it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.at = spark, f"{shared_dir(spark).rstrip('/')}/job-{uuid.uuid4().hex}", {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        _remove(self.spark, self.root)

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.at)}"
        out = _write(df, path)
        self.at[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        for table in tables:
            path, _ = self.at[id(table)]
            _remove(self.spark, path)
