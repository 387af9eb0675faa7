"""Session helpers shared by the operators: shared-folder tables and worker imports."""

from __future__ import annotations

import atexit
import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_written: list[tuple[SparkSession, str]] = []
_tables: dict[str, str] = {}
#: most rows and bytes of an Arrow batch, so that a worker's memory, and the native memory of the JVM, do not depend on how long the texts are
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 10_000, "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 20}


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started from, and bound the batches they are sent."""
    for key, most in BATCH.items():
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, env.get("PYTHONPATH", "")]))


def trimmed(scan: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """scan, which at its end gives free memory back to the machine: workers are used again, and the next stage has its own needs."""

    @functools.wraps(scan)
    def run(batches):
        try:
            yield from scan(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim is not None:
                trim(0)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where a local session names none (tests), a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="factlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table of the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_sweep)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, name: str, key: str, dealt: bool = False) -> DataFrame:
    """Like cut(), as a table of buckets by `key`: joins on it shuffle the other side only, however often it is read.

    Rows that are few and large are `dealt` where they are: each task writes them to their buckets, without a shuffle or an order.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"factlake_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/factlake/{table}"
    rows = df.write if dealt else df.repartition(parts, key).write
    rows = rows.format("parquet").option("path", path).bucketBy(parts, key)
    (rows if dealt else rows.sortBy(key)).saveAsTable(table)
    if not _written:
        atexit.register(_sweep)
    _written.append((spark, path))
    _tables[path] = table
    return spark.table(table)


class Tables:
    """The tables that a run writes for itself, deleted together when its result stands."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def add(self, df: DataFrame) -> DataFrame:
        self.made.append(df)
        return df

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        return self.add(cut(df, name))

    def close(self) -> None:
        for df in self.made:
            drop(df)
        self.made = []


class Kept(NamedTuple):
    """A table whose own columns go by generated names, so that no column that an operator adds can clash with them."""

    table: DataFrame
    names: list[str]

    def __getitem__(self, name: str) -> Column:
        """The column of this name, as Spark resolves it: of names that differ in case only, the one written alike."""
        alike = [i for i, n in enumerate(self.names) if n.lower() == name.lower()]
        same = [i for i in alike if self.names[i] == name]
        return F.col(self.table.columns[(same or alike)[0]])

    def back(self, df: DataFrame) -> DataFrame:
        """The own columns of df's rows, under their names."""
        return df.select(*self.table.columns).toDF(*self.names)


def kept(df: DataFrame) -> Kept:
    return Kept(df.toDF(*[f"_own{i}" for i in range(len(df.columns))]), df.columns)


def over_rows(table: DataFrame, columns: list[str], schema: str, each: Callable[[Iterator[tuple]], Iterator[list]]) -> DataFrame:
    """A narrow pass: the column arrays that `each` gives for a task's rows, which it gets one by one as Arrow scalars of the columns named."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrays in each(tuple(c[i] for c in batch.columns) for batch in batches for i in range(batch.num_rows)):
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return table.select(*columns).mapInArrow(scan, schema)


def table_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The Parquet table at path, or None where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def drop(df: DataFrame) -> None:
    """Delete a table made by cut() or cut_by() that no later plan reads."""
    spark = df.sparkSession
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        for path in [p for p in _tables if os.path.basename(p) == os.path.basename(f)]:
            spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
        _delete(spark, f)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    """At the driver's end, remove what cut() wrote; a session that is gone leaves its tables to the folder's owner."""
    for spark, path in _written:
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            return
        if path in _tables:
            spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
        _delete(spark, path)
