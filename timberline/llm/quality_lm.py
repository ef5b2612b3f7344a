"""Quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from timberline.llm.common import BROADCAST_ROWS, Rounds, give_back, materialize, mix64, text_of

#: Letters of an n-gram: enough to span a short word, or the end of one and the start of the next.
ORDER = 5
#: One in FOLDS trusted texts (by a hash of the text, so copies go together) is not learned from: the bounds come from these, which the model
#: has seen no more than any other text.
FOLDS = 5
#: Share of a language's trusted texts outside either bound, the trusted texts that a language needs for bounds of its own, and how many must lie
#: outside a bound for the quantile itself to be used: with fewer it would hang on single texts.
TAIL, LEAST, OUTSIDE = 0.01, 50, 5
#: Rows of the n-gram table that a shard holds, and letters of documents whose blocks meet one copy of a shard.
SHARD_ROWS, PART_LETTERS = 250_000, 500_000_000
#: Letters that n-grams are made of at once, letters of a block of documents, n-grams that a task takes together before it merges equal ones, and
#: distinct ones that it gathers before it reports them.
PIECE, BLOCK, MERGED, GATHERED = 300_000, 16_000_000, 700_000, 300_000
START = "\x02"


def _pieces(batches: Iterator[pa.RecordBatch], other: str) -> Iterator[tuple[list[str], list]]:
    """Runs of rows of about PIECE letters, whatever the batches: their texts, and their values of the column `other`."""
    texts, values, size = [], [], 0
    for batch in batches:
        for text, value in zip(batch.column("text").to_pylist(), batch.column(other).to_pylist(), strict=True):
            texts.append(text)
            values.append(value)
            size += len(text)
            if size >= PIECE:
                yield texts, values
                texts, values, size = [], [], 0
    if texts:
        yield texts, values
    give_back()


def _ngrams(texts: list[str], order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """For each letter of the texts: its text, the letters of the n-gram that ends there (by place), and that n-gram's hash.

    A run of white space is one space and none stands at either end; before a text's first letter stand START marks.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    of = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    codes[codes == 0] = 0xFFFD
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    codes[space] = 32
    drop = space.copy()
    drop[1:] &= space[:-1] | (of[1:] != of[:-1])
    codes, of, space = codes[~drop], of[~drop], space[~drop]
    if len(codes):
        drop = space
        drop[:-1] &= of[1:] != of[:-1]
        codes, of = codes[~drop], of[~drop]
    begin = np.zeros(len(codes), np.int32)
    if len(codes):
        fresh = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        begin = np.repeat(fresh.astype(np.int32), np.diff(np.append(fresh, len(codes))))
    place = np.arange(len(codes), dtype=np.int32) - begin
    columns = []
    for k in range(order - 1, -1, -1):
        c = np.full(len(codes), ord(START), "<u4")
        c[k:] = codes[: len(codes) - k]
        c[place < k] = ord(START)
        columns.append(c)
    return of, columns, _hash(columns)


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return mix64(h)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each hash among the distinct ones, a place of each distinct one, and the distinct ones."""
    coded = pa.array(h).dictionary_encode()
    code, own = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    place = np.empty(len(own), np.int64)
    place[code] = np.arange(len(code))
    return code, place, own


def ngrams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, n: all n-grams of all texts, with how often trusted texts have them. `docs` has text and trusted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []  # hashes, numbers and names, of a piece or of several
        size = 0

        def merged() -> tuple[np.ndarray, ...]:
            h, n, names = (np.concatenate(c) for c in zip(*parts, strict=True))
            code, place, own = _distinct(h)
            return own, np.bincount(code, n, len(own)).astype(np.int64), names[place]

        def flush(n: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.string()), pa.array(n)], ["gram", "n"])

        for texts, trusted in _pieces(batches, "trusted"):
            of, columns, h = _ngrams(texts, order)
            if not len(h):
                continue
            code, place, own = _distinct(h)
            names = np.ascontiguousarray(np.stack([c[place] for c in columns], axis=1)).view(f"<U{order}").ravel()
            parts.append((own, np.bincount(code[np.array(trusted, bool)[of]], minlength=len(own)), names))
            size += len(own)
            if size >= MERGED:
                parts = [merged()]
                size = len(parts[0][0])
                if size >= GATHERED:
                    yield flush(*parts[0][1:])
                    parts, size = [], 0
        if parts:
            yield flush(*merged()[1:])
        give_back()

    return docs.select("text", "trusted").mapInArrow(run, "gram STRING, n BIGINT").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ of Chen and Goodman from the counts of counts; where these are too few for the formula, 0.5, 1, 1.5."""
    n = {r.c: r.n for r in counts.where("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not n.get(k) for k in (1, 2, 3, 4)):
        return [0.5, 1.0, 1.5]
    y = n[1] / (n[1] + 2 * n[2])
    return [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.01) for k in (1, 2, 3)]


def probabilities(grams: DataFrame, order: int = ORDER, table: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """gram, logp for every row of `grams` (gram, n), under the interpolated modified Kneser-Ney model of those counted in n.

    The highest order has counts, each lower one continuation counts (distinct letters before). For each order the
    n-grams asked for meet the counts, their contexts' totals and the next lower order's probabilities in joins whose keys (n-grams)
    spread the tables over shards; `table` writes each order to the shared folder.
    """
    tables = [table(grams.where("n > 0").select("gram", F.col("n").alias("c")), "grams")]
    for k in range(order - 1, 0, -1):
        tables.append(table(tables[-1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("c")), "grams"))
    tables.reverse()  # by order, from 1
    asked = [grams.select("gram")]
    for k in range(order - 1, 0, -1):
        asked.append(table(asked[-1].select(F.substring("gram", 2, k).alias("gram")).distinct(), "asked"))
    asked.reverse()
    letters = asked[0].count() + 1  # and one for all that no text has
    below = None
    for k, (counts, wanted) in enumerate(zip(tables, asked, strict=True), 1):
        d = _discounts(counts)
        discount = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = F.substring("gram", 1, k - 1) if k > 1 else F.lit("")
        sums = counts.groupBy(context.alias("context")).agg(F.sum("c").alias("total"), F.sum(discount).alias("left"))
        rows = wanted.join(counts, "gram", "left").withColumn("context", context)
        rows = rows.join(sums, "context", "left")
        own = F.coalesce((F.col("c") - discount) / F.col("total"), F.lit(0.0))
        share = F.coalesce(F.col("left") / F.col("total"), F.lit(1.0))
        if below is None:
            rows = rows.select("gram", (own + share / letters).alias("p"))
        else:
            rows = rows.withColumn("shorter", F.substring("gram", 2, k - 1)).join(below.select(F.col("gram").alias("shorter"), F.col("p").alias("lower")), "shorter").select("gram", (own + share * F.col("lower")).alias("p"))
        below = table(rows, "probabilities")
    return below.select("gram", F.log("p").alias("logp"))


def _pack(h: np.ndarray) -> bytes:
    """Ascending hashes as steps, the bytes of each place together, compressed."""
    steps = np.diff(h, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view("<u8").ravel(), dtype=np.uint64)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bool, list[str], np.ndarray]]:
    """The pieces of a task's documents: their block (no other task has the same), number in it, whether the block ends, texts and keys."""
    block, n, size = TaskContext.get().partitionId() << 32, 0, 0
    last = None
    for texts, keys in _pieces(batches, "key"):
        if last:
            yield (*last[:2], size >= BLOCK, *last[2:])
            if size >= BLOCK:
                block, n, size = block + 1, 0, 0
        last = (block, n, texts, np.array(keys, np.int64))
        n, size = n + 1, size + sum(map(len, texts))
    if last:
        yield (*last[:2], True, *last[2:])


ASKED = "shard INT, part INT, block BIGINT, digest BIGINT, hashes BINARY"
HELD = "block BIGINT, piece INT, keys BINARY, lengths BINARY, texts BINARY"


def _asked(docs: DataFrame, order: int, shards: int, parts: int) -> DataFrame:
    """For each block of documents and shard, the block's distinct n-grams there; `digest` tells the block's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_, digest = [], 0
        for block, _, ends, texts, keys in _numbered(batches):
            parts_.append(pc.unique(pa.array(_ngrams(texts, order)[2])))
            digest = xxh64_intdigest(keys.tobytes(), seed=digest)
            if ends or sum(map(len, parts_)) >= MERGED:
                parts_ = [pc.unique(pa.concat_arrays(parts_))]
            if not ends:
                continue
            held = np.sort(parts_[0].to_numpy())
            home = (held % np.uint64(shards)).astype(np.int32)
            some = np.unique(home)
            rows = [some, np.full(len(some), (block >> 32) + (block & 0xFFFFFFFF), np.int64) % parts, np.full(len(some), block), np.full(len(some), digest >> 1), [_pack(held[home == s]) for s in some.tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["shard", "part", "block", "digest", "hashes"])
            parts_, digest = [], 0
        give_back()

    return docs.select("key", "text").mapInArrow(run, ASKED)


def _held(docs: DataFrame) -> DataFrame:
    """The documents of the blocks, piece by piece, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, piece, _, texts, keys in _numbered(batches):
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            data = (block, piece, keys.tobytes(), np.array([len(r) for r in raw], "<u4").tobytes(), zstandard.ZstdCompressor(level=6).compress(b"".join(raw)))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(data, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["block", "piece", "keys", "lengths", "texts"])
        give_back()

    return docs.select("key", "text").mapInArrow(run, HELD)


def document_scores(docs: DataFrame, probabilities_: DataFrame, order: int, shards: int, parts: int) -> DataFrame:
    """key, logp, letters of each document, from its n-grams' probabilities. `docs` has key and text; equal keys are rows of their own; texts without a letter have no row.

    A block of documents asks for each of its distinct n-grams once. Asked and table meet by shard (of the n-gram's hash) and part (of the blocks, each with a copy of the
    shard): a group holds about SHARD_ROWS rows of the table and the blocks of PART_LETTERS letters. The answers then meet the block's texts, compressed,
    where they are summed up piece by piece. `docs` is read twice, in the same order: as files are, or tables that are spread in a fixed way.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = np.array(b.column("gram").to_pylist(), f"<U{order}")
            letters = names.view("<u4").reshape(-1, order)
            h = _hash([np.ascontiguousarray(letters[:, k]) for k in range(order)]) if len(names) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((h % np.uint64(shards)).astype(np.int32)), pa.array(h.view(np.int64)), b.column("logp")], ["shard", "hash", "logp"])

    table = probabilities_.mapInArrow(digest, "shard INT, hash BIGINT, logp DOUBLE").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(asked: pd.DataFrame, grams: pd.DataFrame) -> pd.DataFrame:
        h = grams["hash"].to_numpy().view(np.uint64)
        sort = np.argsort(h)
        h, logp = h[sort], grams.logp.to_numpy()[sort].astype("<f4")
        return pd.DataFrame({"block": asked.block, "digest": asked.digest, "hashes": asked.hashes, "logp": [logp[np.searchsorted(h, _unpack(x))].tobytes() for x in asked.hashes]})

    asked = _asked(docs, order, shards, parts).groupBy("shard", "part")
    answers = asked.cogroup(table.groupBy("shard", "part")).applyInPandas(meet, "block BIGINT, digest BIGINT, hashes BINARY, logp BINARY")

    def add(pieces: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        pieces, digest, out = pieces.sort_values("piece"), 0, []
        for keys in pieces["keys"]:
            digest = xxh64_intdigest(keys, seed=digest)
        if (answers.digest != digest >> 1).any():
            raise ValueError("the documents came in another order when they were read again")
        h = np.concatenate([_unpack(x) for x in answers.hashes] or [np.empty(0, np.uint64)])
        sort = np.argsort(h)
        h, logp = h[sort], np.concatenate([np.frombuffer(x, "<f4") for x in answers.logp] or [np.empty(0)])[sort].astype(float)
        for p in pieces.itertuples():
            raw, ends = zstandard.ZstdDecompressor().decompress(p.texts), np.cumsum(np.frombuffer(p.lengths, "<u4").astype(np.int64)).tolist()
            of, _, own = _ngrams([raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends], ends, strict=False)], order)
            coded = pa.array(own).dictionary_encode()
            at = np.searchsorted(h, coded.dictionary.to_numpy())
            letters = np.bincount(of, minlength=len(ends))
            sums = np.bincount(of, logp[at][coded.indices.to_numpy()], minlength=len(ends)) if len(of) else np.zeros(len(ends))
            some = letters > 0
            out.append(pd.DataFrame({"key": np.frombuffer(p.keys, np.int64)[some], "logp": sums[some], "letters": letters[some]}))
        give_back()
        return pd.concat(out) if out else pd.DataFrame({"key": [], "logp": [], "letters": []})

    return _held(docs).groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(add, "key BIGINT, logp DOUBLE, letters BIGINT")


def bounds(scored: DataFrame, table: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """lang, mean, lo, hi from the marked texts of each language with LEAST of them, and for lang null from all.

    A text of log probability L over its letters deviates by (L - mean x letters) / sqrt(letters), which for text like the trusted has the same spread at
    every length; lo and hi are the TAIL quantiles of that, or with fewer texts than OUTSIDE / TAIL those of the normal distribution with the same quartiles. So the bounds on perplexity are wide for short texts and
    narrow for long ones. Quantiles are sketches (1 in 10,000), which merge: no language meets in one task.
    """
    trusted = scored.where("trusted AND letters > 0")
    trusted = trusted.select(F.explode(F.array(F.col("lang"), F.lit(None).cast("string"))).alias("lang"), "logp", "letters")
    means = trusted.groupBy("lang").agg((F.sum("logp") / F.sum("letters")).alias("mean"), F.count(F.lit(1)).alias("n"))
    means = F.broadcast(table(means.where((F.col("n") >= LEAST) | F.col("lang").isNull()), "means"))  # a row for each language
    rows = trusted.join(means, trusted.lang.eqNullSafe(means.lang)).select(means.lang, "mean", "n", ((F.col("logp") - F.col("mean") * F.col("letters")) / F.sqrt("letters")).alias("d"))
    q = F.percentile_approx("d", [TAIL, 1 - TAIL, 0.25, 0.5, 0.75], 10_000)
    normal, q_ = NormalDist(), F.col("q")
    reach = (q_[4] - q_[2]) * (normal.inv_cdf(1 - TAIL) / (2 * normal.inv_cdf(0.75)))
    many = F.col("n") >= OUTSIDE / TAIL
    lo, hi = F.when(many, q_[0]).otherwise(q_[3] - reach), F.when(many, q_[1]).otherwise(q_[3] + reach)
    return rows.groupBy("lang", "mean", "n").agg(q.alias("q")).select("lang", "mean", lo.alias("lo"), hi.alias("hi"))


def classify(docs: DataFrame, trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang): doc_id, key (a hash of doc_id and text), perplexity (a letter), lo, hi (the bounds on it), kept.

    `trusted` holds the doc_id of texts to learn from. Units are letters, case kept, with white space as one space; n-grams meet the model's counts in
    joins, and documents their n-grams' probabilities in shards. Null and empty texts have no perplexity and are not kept. Languages without enough trusted text, and null, have the bounds of
    all. The lower bound does not reject texts that were learned from. Without trusted text all other documents are kept. Repeated rows get the same result each; an empty table gives no rows;
    further columns are not looked at. A text is worked on whole, so a task's memory grows with the longest one.
    """
    with Rounds(docs.sparkSession, "quality") as rounds:
        table = rounds.table
        known = trusted.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().withColumn("trusted", F.lit(True))
        held = F.pmod(F.xxhash64(F.lit(FOLDS), text_of()), F.lit(FOLDS)) == 0
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held"), F.col("lang").cast("string").alias("lang"), text_of().cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("key"))
        flags = rows.select("doc_id", "key", "lang", "held", F.length("text").alias("size")).join(known, "doc_id", "left")
        mark = F.coalesce("trusted", F.lit(False))
        flags = table(flags.select("doc_id", "key", "lang", "size", (mark & F.col("held")).alias("trusted"), (mark & ~F.col("held")).alias("learned")), "flags")
        # Texts that are learned from are told by their key, so that the texts themselves need not move.
        keys = flags.where("learned").select("key").distinct()
        n, size = flags.agg(F.count(F.when(F.col("learned"), 1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        keys = keys.withColumn("trusted", F.lit(True))
        marked = rows.select("text", "key").join(F.broadcast(keys) if n <= BROADCAST_ROWS else keys, "key", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
        grams = table(ngrams(marked, order), "ngrams")
        logs = table(probabilities(grams, order, table), "model")
        shards, parts = max(1, math.ceil(logs.count() / SHARD_ROWS)), max(1, math.ceil(size / PART_LETTERS))
        scores = table(document_scores(rows.select("key", "text"), logs, order, shards, parts).dropDuplicates(["key"]), "scores")
        scored = table(flags.join(scores, "key", "left"), "scored")
        limits = F.broadcast(table(bounds(scored, table), "bounds"))  # a row for each language
        own = limits.where("lang IS NOT NULL")
        every = limits.where("lang IS NULL").select(*[F.col(c).alias(f"all_{c}") for c in ("mean", "lo", "hi")])
        found = scored.join(own, "lang", "left").join(every, F.lit(True), "left")
        for c in ("mean", "lo", "hi"):
            found = found.withColumn(c, F.coalesce(c, f"all_{c}"))
        at = lambda c: F.exp(-(F.col("mean") + F.col(c) / F.sqrt("letters")))
        found = found.withColumn("perplexity", F.exp(-F.col("logp") / F.col("letters"))).withColumn("most", at("lo")).withColumn("least", at("hi"))
        # The model fits what it has learned from too well, so the lower bound says nothing of that.
        inside = (F.col("learned") | (F.col("perplexity") >= F.col("least"))) & (F.col("perplexity") <= F.col("most"))
        kept = F.col("letters").isNotNull() & F.coalesce(inside, F.lit(True))
        return rounds.result(found.select("doc_id", "key", "perplexity", F.col("least").alias("lo"), F.col("most").alias("hi"), kept.alias("kept")))
