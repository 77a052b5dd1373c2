"""Session preparation and shared-folder staging for the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import time
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows and bytes in one Arrow batch handed to a Python worker. Texts may be long,
#: so the default of 10,000 rows could be gigabytes.
ARROW_ROWS, ARROW_BYTES = 512, 16 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the Python stages need: small Arrow batches, the package on the workers' path."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    env = spark.sparkContext.environment
    if _ROOT not in (env.get("PYTHONPATH") or "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH")) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one where it is unset (tests)."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="quire-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


#: Least seconds between two times that tables give memory back, and when they last did.
PAUSE = 3.0
_gave_back = 0.0


def trim_native(spark: SparkSession) -> str:
    """Return what the JVM has freed outside its heap to the system; what it says of that."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm

    def array(kind, *items):
        out = gateway.new_array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    # The server's class is hidden; the method is reached by its interface.
    of = jvm.java.lang.Class.forName
    kinds = array(jvm.java.lang.Class, of("javax.management.ObjectName"), of("java.lang.String"), of("[Ljava.lang.Object;"), of("[Ljava.lang.String;"))
    invoke = of("javax.management.MBeanServer").getMethod("invoke", kinds)
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    return invoke.invoke(server, array(jvm.java.lang.Object, name, "systemTrimNativeHeap", None, None))


def give_back(spark: SparkSession) -> None:
    """Return what the driver's Python and JVM have freed to the system: their allocators keep it, more with each plan and thread, else."""
    global _gave_back
    _gave_back = time.monotonic()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have none
        ctypes.CDLL(None).malloc_trim(0)
    run = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    # Collecting all shrinks the heap to what lives, and lets Spark drop what nothing refers to.
    if 2 * run.totalMemory() > run.maxMemory():
        run.gc()
    with contextlib.suppress(Py4JError):  # other JVMs have none
        trim_native(spark)


class Stage:
    """Intermediate tables of one operator run, written to the shared folder.

    A written table cuts lineage, survives lost executors and carries its size,
    by which Spark decides on its own whether a join may broadcast it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = prepare(spark)
        self.root = f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def write(self, df: DataFrame, name: str, **options) -> DataFrame:
        at = self.path(name)
        # The table replaces the shuffles that made it: their files go at once.
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.options(**options).parquet(at)
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        if time.monotonic() - _gave_back >= PAUSE:
            give_back(self.spark)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._quire_path = at
        return out

    def small(self, df: DataFrame, table: DataFrame | None = None, most: int = 16 << 20) -> DataFrame:
        """df, of a written table (itself by default), to be broadcast if the table's files have at most `most` bytes; else Spark joins it as any other."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path((df if table is None else table)._quire_path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return F.broadcast(df) if fs.getContentSummary(at).getLength() <= most else df

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in dfs:
            at = jvm.org.apache.hadoop.fs.Path(df._quire_path)
            at.getFileSystem(conf).delete(at, True)

    def clear(self) -> None:
        """Delete all tables, once nothing reads any of them any more."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores added while a column is called so."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name
