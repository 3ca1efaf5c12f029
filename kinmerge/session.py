"""Session helpers: executors get this package without it being installed on them."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_kinmerge_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    if not top.is_dir():  # already running from a shipped archive
        return
    fd, path = tempfile.mkstemp(prefix="kinmerge-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((top / "kinmerge").rglob("*.py")):
            z.write(p, p.relative_to(top).as_posix())
    sc.addPyFile(path)
    sc._kinmerge_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset a folder of this machine serves, but only under a master that
    runs in this process; on a cluster what one machine wrote another could not read.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    held = getattr(sc, "_kinmerge_shared_dir", None)
    if held is None:
        held = sc._kinmerge_shared_dir = "file://" + tempfile.mkdtemp(prefix="kinmerge-")
    return held


def shuffles(spark: SparkSession) -> int:
    """How many shuffles the driver still knows of."""
    return spark._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()


def trim_driver(spark: SparkSession) -> bool:
    """Give memory that the driver's JVM has freed, its compiler's above all, back to the system; false where the JVM offers no such command."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    try:
        named, kinds, args = jvm.java.lang.Class.forName, gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = named(kind)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface, as the server's own class is not open to callers
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Exception:  # another JVM, or an older one  # noqa: BLE001
        return False
    return True


def free_shuffles(spark: SparkSession, left: int = 0) -> None:
    """Remove what was shuffled for tables that nothing refers to any more: it goes when the driver collects its garbage.

    The end of a query may still be on its way to its listeners, which hold its plan, so this asks again until no more than
    ``left`` shuffles are known, for some seconds at most, and twice at least.
    """
    gc.collect()
    for n in range(12):
        spark._jvm.System.gc()
        time.sleep(0.2)
        if n and shuffles(spark) <= left:
            break
    trim_driver(spark)


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """df computed once and kept as a compressed table in the shared folder, its lineage cut; it goes when the driver's Python ends.

    A checkpoint would be uncompressed rows. With ``free`` what was shuffled for it goes from the executors' disks at
    once, which takes about a second.
    """
    spark = df.sparkSession
    before = shuffles(spark) if free else 0
    path = f"{shared_dir(spark)}/kinmerge-cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if free:
        free_shuffles(spark, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    atexit.register(drop_cut, out)
    return out


def drop_cut(df: DataFrame) -> None:
    """Remove a table of ``cut`` that nothing reads any more."""
    try:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may have ended already  # noqa: BLE001
        pass
