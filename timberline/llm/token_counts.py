"""Token counts through a cache of digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import text_of

CACHE_SCHEMA = "digest BINARY, n_tokens BIGINT"
#: Texts handed to the library at once, in characters; bounds what a worker holds beside its Arrow batch.
ENCODE_CHARS = 2_000_000


@dataclass(frozen=True)
class Tokenizer:
    """A vocabulary file; `name` ends in .model (sentencepiece) or .json (tokenizers)."""

    name: str

    def path(self) -> str:
        import public_tokenizers

        return public_tokenizers.path(self.name)

    def version(self) -> str:
        """Digest of the vocabulary file and of the library's version, both of which the counts depend on."""
        import importlib.metadata

        library = "sentencepiece" if self.name.endswith(".model") else "tokenizers"
        with open(self.path(), "rb") as f:
            return hashlib.sha256(f.read() + f"{library} {importlib.metadata.version(library)}".encode()).hexdigest()

    def counter(self):
        """A function from a list of texts to their numbers of tokens: no added tokens, truncation or padding."""
        if self.name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=self.path())
            return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        from tokenizers import Tokenizer as Library

        model = Library.from_file(self.path())
        model.no_truncation()
        model.no_padding()
        return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def _encode(tokenizer: Tokenizer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokenizer.counter()
        for batch in batches:
            texts, out, start, size = batch.column("text").to_pylist(), [], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= ENCODE_CHARS or i == len(texts) - 1:
                    out += count(texts[start : i + 1])
                    start, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(out, pa.int64())], ["digest", "n_tokens"])

    return run


def _cached(spark: SparkSession, path: str) -> DataFrame:
    """The cache's entries for one tokenizer version; an absent cache is empty. Two runs that met may both have
    appended an entry, so one is taken of each digest."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: Tokenizer, cache: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) of each row and n_bytes, n_tokens of its whole text; null counts as empty.

    Content is normalised to its UTF-8 bytes with null as empty (anything more could change the count) and keyed by
    SHA-256, beside the tokenizer's version, in a Parquet table at `cache`. Contents that the cache lacks are reduced
    to one text for each digest (before the shuffle, so a text that a third of all rows share moves once a task),
    encoded once each, and appended. A later call encodes only what is new. An empty table gives no rows; repeated
    rows give repeated rows; columns of any name beside `text` pass through.
    """
    spark = docs.sparkSession
    path = f"{cache}/version={tokenizer.version()}"
    body = docs.select(text_of(text).alias("text")).select(F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    distinct = body.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(_cached(spark, path), "digest", "left_anti")
    misses.mapInArrow(_encode(tokenizer), CACHE_SCHEMA).write.mode("append").parquet(path)
    keep = docs.columns if keep is None else keep
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.octet_length(text_of(text)).cast("long").alias("_bytes"), F.unhex(F.sha2(text_of(text), 256)).alias("_digest"))
    counts = _cached(spark, path).select(F.col("digest").alias("_digest"), F.col("n_tokens").alias("_tokens"))
    return rows.join(counts, "_digest", "left").select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("_bytes").alias("n_bytes"), F.col("_tokens").alias("n_tokens"))
