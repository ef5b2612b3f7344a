"""Benchmark decontamination through templates of the benchmark's items."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import Rounds, Sieve, give_back, null_safe_join, window_hashes

#: Tokens of a window, and how many of them must be literal in a template; windows with fewer are only found verbatim. A shorter item is one window of its
#: own length, which below SHORTEST tokens has no template.
WINDOW, LITERAL, SHORTEST = 8, 5, 4
#: Tells hashes of raw tokens from those of templates.
RAW = np.uint64(0x5851F42D4C957F2D)
#: An item is leaked if this share of its windows is found, or a run of this many tokens.
COVERAGE, RUN = 0.5, 13
#: Bits of the sieve of the items' windows, through which the documents' windows pass before the join.
SIEVE_BITS = 25
#: Units of measure that a number turns into a placeholder.
UNITS = frozenset("kg g mg lb lbs oz km m cm mm mi mile miles ft feet inch inches yd l ml gal s sec seconds min minutes h hr hours day days week weeks month months year years percent usd eur gbp dollars cents euros pounds kb mb gb tb hz khz mhz w kw v".split())
TOKEN = re.compile(r"[.!?:;\n]+|\d+(?:[.,:/]\d+)*|[^\W\d_]+")
BREAKS = frozenset(".!?:;\n")
#: Texts whose templates are made together, in characters.
BATCH_CHARS = 1_000_000


class Lexicon(dict):
    """A number for each token, and by number: its kind (BREAK, LITERAL, CAPITAL, NUMERAL, MEASURE) and the hash of its lower-case form. Remembered up to a bound."""

    BREAK, LITERAL, CAPITAL, NUMERAL, MEASURE = range(5)
    BOUND = 250_000

    def __init__(self):
        super().__init__()
        from xxhash import xxh64_intdigest

        self._digest = xxh64_intdigest
        self.placeholder = {k: xxh64_intdigest(f"\x00{k}") for k in (self.CAPITAL, self.NUMERAL, self.MEASURE)}
        self.kinds, self.hashes = np.zeros(1024, np.int8), np.zeros(1024, np.uint64)

    def __missing__(self, token: str) -> int:
        i, low, c = len(self), token.lower(), token[0]
        if c in BREAKS:
            kind = self.BREAK
        elif c.isdigit():
            kind = self.NUMERAL
        elif low in UNITS:
            kind = self.MEASURE
        elif len(token) > 1 and c != low[0] and token[1:] == low[1:]:
            kind = self.CAPITAL
        else:
            kind = self.LITERAL
        if i >= len(self.kinds):
            self.kinds, self.hashes = np.concatenate([self.kinds, np.zeros_like(self.kinds)]), np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.kinds[i], self.hashes[i] = kind, self._digest(low.encode("utf-8", "surrogatepass"))
        self[token] = i
        return i

    def templates(self, texts: list[str | None]) -> Templates:
        """The texts' templates, laid end to end."""
        if len(self) > self.BOUND:
            self.clear()
            self.kinds, self.hashes = np.zeros(1024, np.int8), np.zeros(1024, np.uint64)
        words: list[str] = []
        lengths = []
        for t in texts:
            found = TOKEN.findall(t or "")
            words += found
            lengths.append(len(found))
        codes = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        kinds, doc = self.kinds[codes], np.repeat(np.arange(len(texts)), lengths)
        at = np.flatnonzero(kinds != self.BREAK)
        kind, of = kinds[at], doc[at]
        raw = self.hashes[codes[at]]
        ids = raw.copy()
        fresh = np.ones(len(at), bool)  # the first of its text or sentence
        fresh[1:] = (of[1:] != of[:-1]) | (np.diff(at) > 1)
        after_number = np.zeros(len(at), bool)
        after_number[1:] = (kind[:-1] == self.NUMERAL) & (of[1:] == of[:-1])
        held = np.zeros(len(at), bool)
        for k, where in ((self.CAPITAL, ~fresh), (self.NUMERAL, True), (self.MEASURE, after_number)):
            hit = (kind == k) & where
            held |= hit
            ids[hit] = self.placeholder[k]
        return Templates(words, at, of, ids, raw, held)


@dataclass
class Templates:
    """Tokens without breaks: their places among all `words`, texts, hashes (of placeholders, where `held`), hashes of the tokens themselves."""

    words: list[str]
    at: np.ndarray
    of: np.ndarray
    ids: np.ndarray
    raw: np.ndarray
    held: np.ndarray

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and places (among these tokens) of the runs of n tokens within one text: of their templates, where these have enough literal
        tokens, and of the tokens themselves; and which are templates."""
        found = window_hashes(self.ids, n) ^ np.uint64(n)
        if not len(found):
            return found, np.empty(0, np.int64), np.empty(0, bool)
        sums = np.concatenate([[0], np.cumsum(self.held)])
        every = np.flatnonzero(self.of[n - 1 :] == self.of[: len(found)])
        typed = every[n - (sums[n:] - sums[:-n])[every] >= min(LITERAL, max(1, n - 1))] if n >= SHORTEST else every[:0]
        raw = (window_hashes(self.raw, n) ^ np.uint64(n) ^ RAW)[every]
        return np.concatenate([found[typed], raw]), np.concatenate([typed, every]), np.arange(len(typed) + len(every)) < len(typed)

    def slots(self, place: int, n: int) -> list[str]:
        """What the placeholders of a window stand for."""
        return [self.words[self.at[i]].lower() for i in range(place, place + n) if self.held[i]]


ITEM_WINDOWS = "item_id BIGINT, window BIGINT, place INT, slots ARRAY<STRING>, size INT, n_windows INT, typed BOOLEAN, n_typed INT"


def item_windows(benchmark: DataFrame) -> DataFrame:
    """The windows of each item (item_id, text), each by its tokens and, where it is `typed`, by its template. The windows by tokens have no slots."""

    names = ["item_id", "window", "place", "slots", "size", "n_windows", "typed", "n_typed"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon()
        for f in frames:
            rows = []
            for item, text in zip(f.item_id, f.text, strict=True):
                t = lexicon.templates([text])
                n = min(WINDOW, len(t.at))
                if n:
                    found, at, template = t.windows(n)
                    typed = set(at[template].tolist())
                    rows += [(item, h, p, t.slots(p, n) if by else [], n, len(at) - len(typed), p in typed, len(typed)) for h, p, by in zip(found.view(np.int64).tolist(), at.tolist(), template.tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=names)

    return benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, ITEM_WINDOWS)


HITS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("doc_place", pa.int32()), ("window", pa.int64()), ("doc_slots", pa.list_(pa.string()))])


def _doc_windows(docs: DataFrame, sizes: list[int], wanted: Sieve, rounds: Rounds) -> DataFrame:
    shipped = rounds.ship(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, wanted = Lexicon(), shipped.value
        for batch in batches:
            ids, keys, texts = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), batch.column("text").to_pylist()
            size, first = 0, 0
            for last, text in enumerate(texts, 1):
                size += len(text or "")
                if size < BATCH_CHARS and last < len(texts):
                    continue
                t = lexicon.templates(texts[first:last])
                begins = np.searchsorted(t.of, np.arange(last - first))
                for n in sizes:
                    found, at, template = t.windows(n)
                    keep = np.flatnonzero(wanted.passes(found))
                    found, at, template = found[keep], at[keep], template[keep]
                    for lo in range(0, len(at), 50_000):
                        h, p, by = found[lo : lo + 50_000], at[lo : lo + 50_000], template[lo : lo + 50_000]
                        d = t.of[p]
                        data = ([ids[first + i] for i in d], [keys[first + i] for i in d], p - begins[d], h.view(np.int64), [t.slots(i, n) if b else [] for i, b in zip(p.tolist(), by.tolist(), strict=True)])
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(data, HITS, strict=True)], schema=HITS)
                first, size = last, 0
            give_back()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id BIGINT, text_key BIGINT, doc_place INT, window BIGINT, doc_slots ARRAY<STRING>")


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, run: int = RUN) -> DataFrame:
    """doc_id, text_key, item_id, coverage, run, kind for each document (doc_id, text) that holds an item (item_id, text) or a re-parameterised
    copy of it.

    Texts become templates (`Lexicon.templates`); windows of WINDOW tokens of both meet in a hash join. Where a document and an item share
    windows along one diagonal (the item at one place of the document), each value of the item stands for the value of the document
    that it meets most often there, and each of the document for one of the item; only windows in which values meet others are left out, and none whose values equal the item's. kind is
    `exact` if all values that meet are equal, else `reparameterised`.
    `coverage` is the share of the item's windows found in a document, of all or of those with a template, whichever is more; `run` the most tokens of it in a row. Null and empty texts hold
    nothing; repeated documents and items count once each, of items of one id with different texts every text's windows belong to that id; a null item_id is no item; empty tables give no rows; further columns are not looked at.
    """
    with Rounds(docs.sparkSession, "leaks") as rounds:
        return rounds.result(_leaks(docs, benchmark, coverage, run, rounds))


def _leaks(docs: DataFrame, benchmark: DataFrame, coverage: float, run: int, rounds: Rounds) -> DataFrame:
    items = rounds.table(item_windows(benchmark).dropDuplicates(["item_id", "window", "place"]), "items")
    sizes = sorted(r.size for r in items.select("size").distinct().collect())  # at most WINDOW of them
    windows = rounds.table(_doc_windows(docs, sizes, Sieve(items, "window", SIEVE_BITS), rounds), "windows")
    met = windows.join(items, "window").select("doc_id", "text_key", "item_id", (F.col("doc_place") - F.col("place")).alias("diagonal"), "place", "size", "n_windows", "typed", "n_typed", "slots", "doc_slots")
    met = rounds.table(met, "met")
    where = ["doc_id", "text_key", "item_id", "diagonal"]
    # The value of the document that each value of the item stands for most often, with equal counts its own; and the other way round.
    pairs = met.select(*where, F.explode(F.arrays_zip(F.col("slots").alias("a"), F.col("doc_slots").alias("b"))).alias("s")).select(*where, F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    pairs = rounds.table(pairs.groupBy(*where, "a", "b").agg(F.count(F.lit(1)).alias("n"), F.first(F.col("a") == F.col("b")).alias("same")), "pairs")
    mapped = lambda a, b, out: pairs.groupBy(*where, a).agg(F.max_by(b, F.struct("n", "same", b)).alias(b), F.min("same").alias("same")).groupBy(*where).agg(F.map_from_entries(F.collect_list(F.struct(a, b))).alias(out), F.min("same").alias("same"))
    slots = null_safe_join(mapped("a", "b", "stands"), mapped("b", "a", "back").drop("same"), where)
    fits = F.col("slots") == F.col("doc_slots")
    fits = fits | F.forall(F.arrays_zip(F.col("slots").alias("a"), F.col("doc_slots").alias("b")), lambda s: (F.element_at("stands", s["a"]) == s["b"]) & (F.element_at("back", s["b"]) == s["a"]))
    met = null_safe_join(met, slots, where, "left").where(fits).select(*where, "place", "size", "n_windows", "typed", "n_typed", F.coalesce("same", F.lit(True)).alias("same"))
    # Runs of windows at consecutive places along a diagonal.
    by_diagonal = met.groupBy(*where).agg(F.collect_set(F.struct("place", "typed")).alias("hits"), F.first("size").alias("size"), F.first("n_windows").alias("n_windows"), F.first("n_typed").alias("n_typed"), F.min("same").alias("same"))
    by_diagonal = by_diagonal.withColumn("places", F.sort_array(F.array_distinct(F.col("hits.place"))))
    longest = F.aggregate(
        "places", F.struct(F.lit(-2).alias("last"), F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda acc, p: F.struct(p.alias("last"), F.when(p == acc["last"] + 1, acc["now"] + 1).otherwise(F.lit(1)).alias("now"), F.greatest(acc["best"], F.when(p == acc["last"] + 1, acc["now"] + 1).otherwise(F.lit(1))).alias("best")),
        lambda acc: acc["best"],
    )
    by_diagonal = by_diagonal.withColumn("run", longest + F.col("size") - 1)
    # Sets of the item's places: bounded by the item, however many diagonals a long text shares with it.
    hits = by_diagonal.select("doc_id", "text_key", "item_id", "n_windows", "n_typed", "run", "same", F.explode("hits").alias("hit"))
    found = hits.groupBy("doc_id", "text_key", "item_id").agg(
        F.size(F.collect_set("hit.place")).alias("found"), F.first("n_windows").alias("n_windows"),
        F.size(F.collect_set(F.when(F.col("hit.typed"), F.col("hit.place")))).alias("typed"), F.first("n_typed").alias("n_typed"), F.max("run").alias("run"), F.max("same").alias("same")
    )
    found = found.withColumn("coverage", F.greatest(F.col("found") / F.col("n_windows"), F.when(F.col("n_typed") > 0, F.col("typed") / F.col("n_typed")))).where((F.col("coverage") >= coverage) | (F.col("run") >= run))
    return found.select("doc_id", "text_key", "item_id", F.round("coverage", 4).alias("coverage"), F.col("run").cast("int").alias("run"), F.when(F.col("same"), "exact").otherwise("reparameterised").alias("kind"))
