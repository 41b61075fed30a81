"""Tables in the shared scratch folder: lineage is cut by writing, never by a local checkpoint."""

from __future__ import annotations

import ctypes
import gc
import os
import subprocess
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many rows of a few numbers, some 10 MB, may be broadcast; it is counted first.
BROADCAST_ROWS = 250_000
_open = threading.local()  # the scopes of saved tables that this thread is in


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where it is unset, a private one in local mode; an error elsewhere."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="kerbline-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the scratch root."""
    return f"{scratch_root(spark)}/kerbline/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """df as written to the shared scratch folder and read back; a lost executor costs a task, not the table."""
    path = scratch_path(df.sparkSession, label)
    if scopes := getattr(_open, "scopes", None):
        scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _folder(df: DataFrame) -> set[str]:
    return {x.rsplit("/", 2)[1] for x in df.inputFiles()}


def discard(*frames: DataFrame) -> None:
    """Delete the files behind frames that saved() returned; nothing may read them afterwards."""
    for df in frames:
        _delete(df.sparkSession, sorted({x.rsplit("/", 1)[0] for x in df.inputFiles()}))


def give_back() -> None:
    """Return memory that this Python process has freed to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trim_native(spark: SparkSession) -> None:
    """Let the driver's JVM return freed native memory to the system; the compilers of many generated classes leave much of it.

    This is the JVM's own diagnostic command System.trim_native_heap; JVMs and systems without it stay as they are.
    """
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    named = jvm.java.lang.Class.forName
    kinds, values = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = named(kind)
    try:
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, values)
    except Py4JJavaError:  # no such command
        pass


def _trim_executor(frames: Iterator) -> Iterator:
    """For mapInPandas: the worker, and by its own jcmd the JVM that the worker belongs to, return freed native memory."""
    for frame in frames:
        give_back()
        try:
            pid = os.getppid()
            while pid > 1 and os.path.basename(exe := os.readlink(f"/proc/{pid}/exe")) != "java":
                with open(f"/proc/{pid}/stat") as stat:
                    pid = int(stat.read().rpartition(")")[2].split()[1])
            if pid > 1:
                tool = [os.path.join(os.path.dirname(exe), "jcmd"), "-J-Xmx16m", "-J-XX:+UseSerialGC", "-J-XX:TieredStopAtLevel=1"]
                subprocess.run([*tool, str(pid), "System.trim_native_heap"], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, timeout=20)
        except (OSError, subprocess.SubprocessError):  # no /proc, or no such tool
            pass
        yield frame


def release_executors(spark: SparkSession, native: bool = True) -> None:
    """Let each executor's JVM collect its garbage, which shrinks its heap, and return freed native memory, too.

    A heap that has once grown keeps its pages otherwise, and so do the allocator's arenas, so that the peaks of all
    steps add up to what a container must hold. A task for each executor does it; idle executors get one each.
    In local mode the driver's JVM is the only one. native: whether Python workers may run for the native memory.
    """
    n = len(spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos()) - 1  # the driver is among them
    if n < 1:
        return
    tasks = spark.range(0, n, 1, n).selectExpr("id", "reflect('java.lang.System', 'gc') AS said")
    (tasks.mapInPandas(_trim_executor, "id long, said string") if native else tasks).collect()


def release(spark: SparkSession, native: bool = True) -> None:
    """Let the driver and the executors drop what no frame refers to any more; native is release_executors()'s.

    Spark deletes spent broadcasts and shuffle files only once the driver's garbage is collected, which a driver that
    plans much and allocates little seldom does by itself; generated classes and plans go with them.
    """
    gc.collect()  # frames in reference cycles hold their plans in the JVM
    spark._jvm.System.gc()
    trim_native(spark)
    give_back()
    release_executors(spark, native)


class Scope:
    """The tables that are saved within, and which of them stay."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.kept: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """df, whose saved tables outlive the scope."""
        self.kept.append(df)
        return df


@contextmanager
def scratch(spark: SparkSession, native: bool = True) -> Iterator[Scope]:
    """Deletes at its end the tables that are saved within, but for those that Scope.keep() is given.

    Frames that read a deleted table can't be used any more: what is returned must read kept tables alone. Kept
    tables belong to the scope around, if there is one. At its end the driver and
    the executors let go of what is spent, too (native: see release()). After an exception all tables stay, for a second look.
    """
    scopes = _open.scopes = getattr(_open, "scopes", [])
    scope = Scope()
    scopes.append(scope.paths)
    try:
        yield scope
    finally:
        scopes.pop()
    stay = set().union(*(_folder(df) for df in scope.kept))
    if scopes:
        scopes[-1].extend(x for x in scope.paths if x.rsplit("/", 1)[1] in stay)
    _delete(spark, [x for x in scope.paths if x.rsplit("/", 1)[1] not in stay])
    release(spark, native)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows; as it is beyond, for a shuffle join. rows: its count, if known."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df
