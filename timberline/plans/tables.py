"""The driver's tables seen as point clouds, and tables between stages."""

from __future__ import annotations

import gc
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Points from the events table by exact arithmetic: users are stems on a lattice, 15 wide.
POINTS = """
SELECT event_id AS pid,
       CAST(user_id % 15 AS DOUBLE) + CAST((event_id * 7919) % 1000 AS DOUBLE) / 2500 AS x,
       CAST(floor(user_id / 15) AS DOUBLE) + CAST((event_id * 104729) % 1000 AS DOUBLE) / 2500 AS y,
       value / {height} AS z,
       value / {height} AS n_z,
       CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS label,
       CAST(floor(user_id / 15) AS INT) AS tile
FROM events
"""


def points_sql(height: int = 40) -> str:
    return POINTS.format(height=height)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, height: int = 40) -> DataFrame:
    return spark.sql(POINTS.format(height=height).replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder (spark.checkpoint.dir; where that is unset, the warehouse)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/timberline/{name}-{uuid.uuid4().hex}"


#: Bytes of the driver's heap from which on a cut collects it: twice what is alive in a driver that has run all its rounds, or more.
HEAP = 256 << 20


def collect_heap(spark: SparkSession) -> None:
    """Collect the driver's garbage; its JVM then returns what it holds free to the system.

    A heap that has once grown stays so, since one that is large enough is never marked; what is alive in it is the plans and numbers of past runs.
    Java objects that only Python's cycles still hold go first.
    """
    gc.collect()
    spark._jvm.java.lang.System.gc()


def trim_native(spark: SparkSession) -> bool:
    """Return what the driver's JVM has freed outside its heap (compiler, buffers of files) to the system; false where the JVM has no such command."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    kind = jvm.java.lang.Class.forName
    # by the interface's method, as the server's own class is not open to reflection
    kinds = array(jvm.java.lang.Class, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = kind(name)
    given = array(jvm.java.lang.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        kind("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError:
        return False
    return True


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write to the shared folder and read again: ends the lineage, and outlives executors. The driver gives back what its JVM has freed, and its garbage where the heap has grown past HEAP."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    if spark._jvm.java.lang.Runtime.getRuntime().totalMemory() > HEAP:
        collect_heap(spark)
    trim_native(spark)
    return spark.read.schema(df.schema).parquet(path)
