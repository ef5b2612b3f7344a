"""Helpers shared by the corpus operators: shared storage, stable hashes, sampling, prefix sums."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Tables of verdicts up to this many rows are broadcast; beyond it they are shuffled.
BROADCAST_ROWS = 500_000

#: Where a whole row is carried beside keys of our own: it is one column, so that its columns may have any name.
ROW, AT = "row", "at"

#: Rows and bytes of the Arrow batches in which texts go to Python: a worker and the JVM hold one batch each beside what they work on.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset (tests) the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return base.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for what is run inside, and are put back after."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/timberline/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that `materialize` or `new_path` made, once nothing reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """The tables that an operator writes on its way: all in one folder, which goes when the operator is done. Texts go to Python in small batches meanwhile.

    with Rounds(spark, name) as rounds: `rounds.table(df, name)` writes and reads again, `rounds.result(df)` does so outside the folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.folder, self._settings = spark, name, new_path(spark, name), settings(spark, BATCHES)
        self._shipped: list = []

    def __enter__(self) -> Rounds:
        self._settings.__enter__()
        return self

    def __exit__(self, *error) -> None:
        self._settings.__exit__(*error)
        for b in self._shipped:
            b.unpersist()
        drop_path(self.spark, self.folder)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name, f"{self.folder}/{name}-{uuid.uuid4().hex}")

    def result(self, df: DataFrame) -> DataFrame:
        return materialize(df, f"{self.name}-result")

    def ship(self, value):
        """A broadcast that is given up at the end."""
        self._shipped.append(self.spark.sparkContext.broadcast(value))
        return self._shipped[-1]

    def drop(self, df: DataFrame) -> None:
        """Remove a table before the end."""
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
            drop_path(self.spark, path)


class Sieve:
    """A bit for each of 2 ** bits remainders of 64-bit hashes, of one size whatever it holds: tells rows that a join cannot meet before they move.

    The bits are gathered in words of 64, by partial aggregation, so the driver gets 2 ** (bits - 6) rows at most. What passes may still have no partner.
    """

    def __init__(self, hashes: DataFrame, column: str, bits: int = 25):
        b = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
        words = hashes.select(F.shiftright(b, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 AS INT))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
        self.mask, self.words = np.uint64((1 << bits) - 1), np.zeros(1 << (bits - 6), np.uint64)
        self.words[words.column("w").to_numpy()] = words.column("m").to_numpy().view(np.uint64)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        b = hashes.view(np.uint64) & self.mask
        return (self.words[b >> np.uint64(6)] >> (b & np.uint64(63)) & np.uint64(1)).astype(bool)


def text_of(name: str = "text") -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A uniform number in [0, 1) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) * F.lit(2.0**-53)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for uint64 arrays (murmur-style multiply and shift)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def give_back() -> None:
    """Return what a Python worker has freed to the system: workers outlive their tasks, and share an executor's memory with its JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def give_back_heaps(spark: SparkSession) -> None:
    """Collect the garbage of all executors' JVMs, which return what they then hold free to the system.

    A heap that has once grown may stay so until the application ends: it is only made smaller after a marking, and one that is large enough
    is never marked. Python workers share an executor's memory with it. A task for each core, so each executor that is idle gets some.
    """
    collected = F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("collected")
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(collected).write.format("noop").mode("overwrite").save()


def window_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n tokens, by position."""
    m = len(tokens) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = (out ^ tokens[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix64(out)


def without(docs: DataFrame, keys: list[Column], gone: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, whose `keys` are not in `gone` (as many columns, in that order); null meets null."""
    names = [f"{AT}{i}" for i in range(len(keys))]
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(ROW), *[k.alias(n) for k, n in zip(keys, names, strict=True)])
    gone = gone.toDF(*names)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return null_safe_join(rows, gone, names, "left_anti").select(f"{ROW}.*")


def grouped_prefix(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the same group that come before, by (bucket, order).

    Two levels, so that a group with any share of all rows is still spread over tasks: sums per (group, bucket)
    are made first (partial sums before the shuffle), their prefixes give each bucket's offset, and the rows are only
    ordered within their own bucket. `bucket` must rise with `order`.
    """
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    rows = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.withColumn("_within", F.coalesce(F.sum(value).over(rows), F.lit(0)))
    return null_safe_join(ranked, sums, keys).select(*df.columns, (F.col("_within") + F.col("_offset")).alias(out))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null meets null; the keys are the left side's."""
    right = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        match = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = match if i == 0 else cond & match
    return left.join(right, cond, how).select(*left.columns, *([] if how in ("left_anti", "left_semi") else [c for c in right.columns if c not in {f"_r_{k}" for k in keys}]))
