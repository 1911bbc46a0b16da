"""What the operators share: inputs, staged tables in the cluster's shared folder, and small Column helpers."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import make_importable

#: White space of the contracts: space and the controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_staged: list[tuple[SparkSession, str]] = []
#: What operators keep in a Python worker from task to task, by owner.
_kept: dict[str, dict] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole `documents` table."""
    make_importable(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset, a local master gets a temporary folder of its own and a cluster gets a folder below
    its warehouse, and the setting is made for the rest of the session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            configured = "file://" + tempfile.mkdtemp(prefix="sceneloom-")
        else:
            configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_sceneloom_staging"
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def staged(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Writes df as Parquet below the shared folder and reads it back: cuts the lineage in a way that survives lost executors.

    batch_rows: rows that Python workers are handed at once while it is written, for rows that are long.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sceneloom/{name}-{uuid.uuid4().hex}"
    # What was shuffled for the write is of no use after it.
    wanted = {_CLEANUP: "true"} | ({_BATCH_ROWS: str(batch_rows)} if batch_rows else {})
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    _staged.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


def drop_staged(*tables: DataFrame) -> None:
    """Deletes the files of tables made by staged() that nothing reads any more."""
    for table in tables:
        spark, path = table.sparkSession, table._staged_at
        _delete(spark, path)
        _staged.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean_up() -> None:
    """At the driver's end; a session that has already stopped leaves its files to the owner of the shared folder."""
    for spark, path in _staged:
        if spark.sparkContext._jsc is not None and spark.sparkContext._gateway is not None:
            try:
                _delete(spark, path)
            except Exception:  # noqa: BLE001  the JVM may be gone already
                return


atexit.register(_clean_up)


def kept(owner: str) -> dict:
    """What tasks of this owner keep in a worker, until a task of another one comes."""
    return _kept.setdefault(owner, {})


def forget_others(owner: str) -> None:
    for name, values in _kept.items():
        if name != owner:
            values.clear()


def give_back() -> None:
    """Hands memory that this process has freed back to the system. Arrow's pool and the C library keep it otherwise, and a worker stays beside its executor after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "", seconds: float = 1.0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with the same batches: what other operators left in the worker goes first, and freed memory is handed back every so many seconds and at the task's end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(owner)
        give_back()
        last = time.monotonic()
        for batch in run(batches):
            yield batch
            del batch
            if time.monotonic() - last > seconds:
                give_back()
                last = time.monotonic()
        give_back()

    return tidied


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once per row, however often body names it (also inside lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ranges_for(df: DataFrame, mb: int = 64) -> int:
    """Partitions for a shuffle of df: as the session has them, but more where the input's files have more than mb MB for each."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    # Inputs without statistics claim an absurd size.
    known = sum(size for size in sizes if size < 1 << 60)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // (mb << 20)))


def put(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """array with values at a place, in a larger copy where they don't fit."""
    if at + len(values) > len(array):
        larger = np.zeros(max(2 * len(array), at + len(values)), array.dtype)
        larger[:at] = array[:at]
        array = larger
    array[at : at + len(values)] = values
    return array


def text_or_empty(df: DataFrame, text: str = "text") -> Column:
    return F.coalesce(df[text].cast("string"), F.lit(""))
