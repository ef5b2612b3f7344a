"""Exact deduplication as a stateful stream."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import AT, BROADCAST_ROWS, ROW, SPACE, drop_path, materialize, new_path, settings, text_of

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of many small stores sets aside megabytes of disk
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",  # executors give up the stores of a query that has ended that soon
}
EVENTS = "doc_id BIGINT, digest STRING, locator STRING"


def normalised(text: str = "text") -> Column:
    """Null as empty, and each run of white space as one space."""
    return F.regexp_replace(text_of(text), SPACE, " ")


def located(docs: DataFrame, folder: str) -> DataFrame:
    """The rows as those of files, whose content a locator can lead back to: rows that are not of files are written to `folder` first."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return materialize(docs, "content", f"{folder}/content-{uuid.uuid4().hex}")
    return docs


def with_locator(docs: DataFrame, name: str = "_locator") -> DataFrame:
    """Add where each row's content lies: its file and row number. `docs` are rows of files."""
    return docs.withColumn(name, F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string")))


def fetched(wanted: DataFrame) -> DataFrame:
    """digest, stored: the normalised content of the rows that `wanted` (digest, keep_at) leads to, in Parquet files of text. The driver lists the files only."""
    spark = wanted.sparkSession
    files = [r.f for r in wanted.select(F.substring_index("keep_at", "#", 1).alias("f")).distinct().collect()]
    if not files:
        return wanted.select("digest", F.lit("").alias("stored")).limit(0)
    rows = with_locator(spark.read.parquet(*map(unquote, files)).select("text"), "keep_at").select("keep_at", normalised().alias("stored"))
    return rows.join(wanted, "keep_at").select("digest", "stored")


class StreamingDedup:
    """Keyed state without expiry: for each digest the smallest identifier, that row's content locator, and a count.

    The state lies in RocksDB on the executors' disks and, batch by batch, in the checkpoint in the shared folder, so a lost
    executor's part is restored from there. It is a streaming aggregation: each task reduces its rows to one for each
    digest before the shuffle, so a digest that a third of all rows share reaches the state as one row a task.
    A state is never dropped; later runs with the same folder go on from it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def ingest(self, events: DataFrame) -> None:
        """Take in all that is new in a stream of EVENTS, and write the digests that changed, by batch."""
        state = events.groupBy("digest").agg(F.min(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("n"))
        out = f"{self.folder}/groups"

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that is run again replaces itself

        with settings(self.spark, STATE):
            query = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
            query.awaitTermination()

    def groups(self) -> DataFrame:
        """digest, keep_id, keep_at, n as the last batch that changed the digest left them."""
        rows = self.spark.read.schema("digest STRING, keep STRUCT<doc_id: BIGINT, locator: STRING>, n BIGINT, batch BIGINT").parquet(f"{self.folder}/groups")
        last = rows.groupBy("digest").agg(F.max(F.struct("batch", "keep", "n")).alias("s"))
        return last.select("digest", F.col("s.keep.doc_id").alias("keep_id"), F.col("s.keep.locator").alias("keep_at"), F.col("s.n").alias("n"))


def dedup(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, locator, keep_id, keep_at, group_size, kept, text_sha256.

    Texts are equal when identical after `normalised`; null is empty, and empty texts are equal to each other. Of equal texts
    the row with the smallest (doc_id, locator) stays, a null doc_id coming first; so of repeated rows with the same doc_id
    one stays. Digests meet in `StreamingDedup`; then every row whose digest is in state for another
    row is compared with the stored row's full bytes, fetched by its locator, and rows that differ in spite of an equal digest form groups of their
    own. With a `folder` the state goes on from earlier calls: keep_id, keep_at and group_size are then over all of them, and the content of rows seen earlier is
    fetched from their files, which must still be there (rows that were not of files lie in `folder`). An empty table gives no rows; further columns are not looked at.
    """
    spark = docs.sparkSession
    own_folder = folder or new_path(spark, "dedup")
    run = f"{own_folder}/run-{uuid.uuid4().hex}"
    cut = lambda df, name: materialize(df, name, f"{run}/{name}")
    rows = located(docs, own_folder).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    content = with_locator(rows).select("doc_id", F.col("_locator").alias("locator"), normalised().alias("norm"))
    content = content.withColumn("digest", F.sha2("norm", 256))
    events = materialize(content.select("doc_id", "digest", "locator"), "events", f"{own_folder}/events/{uuid.uuid4().hex}")
    stream = StreamingDedup(spark, own_folder)
    stream.ingest(spark.readStream.schema(EVENTS).parquet(f"{own_folder}/events/*"))
    groups = cut(stream.groups(), "last")  # a table, so that joins with it can split hot digests

    hits = cut(content.join(groups.where("n > 1"), "digest"), "hits")
    here = hits.where(F.col("locator") == F.col("keep_at")).select("digest", F.col("norm").alias("stored")).dropDuplicates(["digest"])
    gone = cut(hits.select("digest", "keep_at").distinct().join(here.select("digest"), "digest", "left_anti"), "elsewhere")
    stored = cut(here.unionByName(fetched(gone)), "stored")
    differ = cut(hits.join(stored, "digest").where("norm <> stored").select("doc_id", "locator", "digest", "norm"), "collisions")
    lost = differ.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
    own = differ.groupBy("digest", "norm").agg(F.min(F.struct("doc_id", "locator")).alias("k"), F.count(F.lit(1)).alias("own_n"))
    own = differ.join(own, ["digest", "norm"]).select(F.col("doc_id").alias("_id"), F.col("locator").alias("_at"), F.col("digest").alias("_digest"), F.col("k.doc_id").alias("own_id"), F.col("k.locator").alias("own_at"), "own_n")
    groups = cut(groups.join(lost, "digest", "left"), "groups")
    out = events.join(groups, "digest")
    out = out.join(own, (out.locator == own._at) & (out.digest == own._digest) & out.doc_id.eqNullSafe(own._id), "left")
    keep_id = F.when(F.col("own_n").isNull(), F.col("keep_id")).otherwise(F.col("own_id"))
    keep_at = F.coalesce("own_at", "keep_at")
    size = F.coalesce("own_n", F.col("n") - F.coalesce("lost", F.lit(0)))
    out = out.select(
        "doc_id", "locator", keep_id.alias("keep_id"), keep_at.alias("keep_at"), size.alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep_id) & F.col("locator").eqNullSafe(keep_at)).alias("kept"), F.col("digest").alias("text_sha256"),
    )
    out = materialize(out, "dedup-result")
    drop_path(spark, run if folder else own_folder)
    return out


def kept(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that `dedup` keeps: of equal texts one."""
    spark = docs.sparkSession
    files = located(docs, new_path(spark, "dedup-content"))
    gone = dedup(files.select("doc_id", "text")).where("NOT kept").select(F.col("locator").alias(AT))
    n = gone.count()
    rows = files.select(F.struct(*files.columns).alias(ROW), F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string")).alias(AT))
    return rows.join(F.broadcast(gone) if n <= BROADCAST_ROWS else gone, AT, "left_anti").select(f"{ROW}.*")
