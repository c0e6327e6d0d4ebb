"""Session settings and lineage cuts, owned in one place."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Only for sessions this package opens itself; a cluster brings its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def open_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    n = 8 if cores == "*" else int(cores)
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(n), "spark.driver.memory": "8g"} | conf
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster names one.

    Where it is unset (a local test), a temporary folder of this process serves and is removed at exit; a session with
    executors on other machines must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(shared_folder, "own", None)
    if own is None:
        own = shared_folder.own = tempfile.mkdtemp(prefix="marlstone-")
        atexit.register(shutil.rmtree, own, True)
    return f"file://{own}"


def cut(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Writes df as a Parquet table into the shared folder and reads it back.

    Cuts the lineage: a later loss of an executor re-reads files instead of running the plan again, and the
    planner sees the table's true size when it picks a join. Empty inputs keep their schema.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    for held in _open:
        held.append(jvm_path)
    (df if partitions is None else df.repartition(partitions)).write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut = jvm_path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that cut() returned, as soon as nothing reads them any more; what else is given stays."""
    for table in tables:
        path = getattr(table, "_cut", None)
        if path is not None:
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what cut() writes inside the block go when it is written, not when the driver happens to collect its
    garbage."""
    was = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(_TIDY) if was is None else spark.conf.set(_TIDY, was)


_open: list[list] = []
#: Called when released() drops tables: what remembers a cut table must forget it.
on_release: list[Callable[[], None]] = []


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Drops what cut() writes inside the block when it ends. For long sessions: run a query, write or collect its result
    within the block, and its intermediate tables are gone, instead of at the session's end."""
    held: list = []
    _open.append(held)
    try:
        yield
    finally:
        _open[:] = [h for h in _open if h is not held]
        for forget in on_release:
            forget()
        for path in held:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_rows(df: DataFrame, most: int) -> list:
    """Rows of a table whose size is fixed by its meaning (a field list, a limit table); more than `most` is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a settings table has more than {most} rows")
    return rows
