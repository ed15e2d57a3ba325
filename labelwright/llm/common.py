"""What the operators share: tables, the shared scratch folder, shipping of the package, lambda-bound columns."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where a local master has one machine and names none."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master: {master})")
        base = "file://" + tempfile.mkdtemp(prefix="labelwright-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/labelwright/{name}-{uuid.uuid4().hex}"


class _Written(threading.local):
    """This thread's written tables that nothing has deleted yet, in the order they were written."""

    def __init__(self):
        self.tables: list[DataFrame] = []


_written = _Written()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a table in the shared folder; a lost executor costs a rerun of tasks, never the rows."""
    spark = df.sparkSession
    df.write.parquet(path := scratch_path(spark, name))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    _written.tables.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(conf).delete(path, True)
        _written.tables = [x for x in _written.tables if x._scratch != df._scratch]


def settle(df: DataFrame, name: str, since: int) -> DataFrame:
    """The table, written; of what this thread had written for it, after :func:`written` gave that number, nothing stays."""
    out = materialize(df, name)
    discard(*(x for x in _written.tables[since:] if x is not out))
    return out


def written() -> int:
    """How many written tables this thread has, to :func:`settle` what comes after."""
    return len(_written.tables)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once per context, wherever they run, and bounds Arrow batches by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    sc = spark.sparkContext
    if getattr(sc, "_labelwright_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="labelwright-")), "labelwright_ship.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"labelwright/{f.relative_to(top)}")
    sc.addPyFile(path)
    sc._labelwright_shipped = True


_tenant: list[tuple[str, Callable[[], None]]] = []


def _give_back() -> None:
    """Returns freed memory of this process to the system, where its allocators can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lodged(name: str, clear: Callable[[], None], run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` of a Python worker that other operators use in turn.

    A worker outlives its tasks; what an operator caches in it is cleared when a task of another operator comes, and
    freed memory goes back to the system after each task. So operators that follow each other don't add up.
    """

    def task(batches: Iterator) -> Iterator:
        _enter(name, clear)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return task


def _enter(name: str, clear: Callable[[], None]) -> None:
    if _tenant and _tenant[0][0] != name:
        _tenant[0][1]()
        gc.collect()
        _give_back()
    _tenant[:] = [(name, clear)]


def nothing() -> None:
    """Clears nothing."""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _row_bytes(schema: T.StructType) -> Column:
    """About what a row holds: eight bytes a number, the bytes of strings, arrays' elements."""

    def of(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.size(c), F.lit(0)) * 8 + 16
        if isinstance(kind, T.StructType):
            return sum((of(c[f.name], f.dataType) for f in kind.fields), F.lit(16))
        return F.lit(8)

    return sum((of(F.col(f"`{f.name}`"), f.dataType) for f in schema.fields), F.lit(16)).cast("long")


def sized(df: DataFrame, max_bytes: int = 8 << 20) -> DataFrame:
    """A written table, marked for broadcast only if its rows are counted to hold no more than that many bytes."""
    held = df.agg(F.sum(_row_bytes(df.schema))).first()[0] or 0
    return F.broadcast(df) if held <= max_bytes else df
