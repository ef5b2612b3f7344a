"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_hexdigest, xxh64_intdigest

from timberline.llm.common import Rounds, Sieve, give_back, mix64, text_of, window_hashes
from timberline.operators.graph import connected_components

#: Words of a shingle, least similarity, bands and samples of a band.
SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 8, 3
#: Shingles in at least this share of all texts are counted one by one; all rarer ones have the greatest weight.
COMMON = 1 / 1000
#: Texts that a task of the counting pass holds at least, where there are so many.
PER_TASK = 8192
#: Shingles whose local counts a task sums at a time; shingles that are sampled at a time.
HELD, CHUNK = 3_000_000, 1 << 16
#: Bits of a hash that tell the ranges in which a task merges its counts.
RANGES = 3
#: Letters of texts that are cut into words together.
TOGETHER = 2_000_000
#: Samples of which a pair must agree in so many to be tested: of one of similarity 0.8 fewer agree with a chance of 1 in 100,000.
AGREEING = 10
#: Members of a bucket that a task holds and tests among each other; larger buckets are first dealt to groups of about DEALT.
HELD_TOGETHER, DEALT = 512, 64

_U = (np.arange(65536) + 0.5) / 65536


def _gamma() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) in 65536 steps, their inverses and logarithms: draws are table look-ups by 16 bits of a hash."""
    x = np.concatenate([[0.0], np.geomspace(1e-4, 40, 400_000)])
    q = np.interp(_U, 1 - (1 + x) * np.exp(-x), x)
    return q.astype(np.float32), (1 / q).astype(np.float32), np.log(q).astype(np.float32)


def signatures(shingles: np.ndarray, log_weights: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Improved consistent weighted samples (Ioffe 2010) of several weighted sets laid end to end: sets x k, uint64.

    Sample j of a set is the pair (shingle, t) of least ln c - r (t - beta + 1), t = floor(ln w / r + beta), with r and c from Gamma(2, 1) and beta uniform,
    all drawn from a hash of shingle and j. Two sets agree on a sample with a chance equal to their weighted Jaccard similarity.
    """
    r_of, inverse_of, log_of = _gamma_tables()
    ends = np.append(starts[1:], len(shingles))
    out = np.empty((len(starts), k), np.uint64)
    groups, first = [], 0  # sets are taken together up to CHUNK shingles, so that the arrays stay in the processor's cache
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + CHUNK, "right")))
        groups.append((first, last))
        first = last
    seeds = mix64(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    for lo, hi in groups:
        a, b = starts[lo], ends[hi - 1]
        h, lw, at = shingles[a:b], log_weights[a:b], starts[lo:hi] - a
        of = np.repeat(np.arange(hi - lo), ends[lo:hi] - starts[lo:hi])
        for j in range(k):
            x = (h ^ seeds[j]) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            i = (x >> np.uint64(48)).astype(np.uint16)
            r = r_of[i]
            c = log_of[(x >> np.uint64(32)).astype(np.uint16)]
            beta = (x >> np.uint64(8) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2**-24)
            t = np.floor(lw * inverse_of[i] + beta)
            c -= r * (t - beta + 1)
            least = np.minimum.reduceat(c, at)
            hit = np.flatnonzero(c == least[of])
            pick = hit[np.searchsorted(of[hit], np.arange(hi - lo))]
            out[lo:hi, j] = mix64(h[pick] + t[pick].astype(np.int64).view(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return out


_TABLES: list = []


def _gamma_tables():
    if not _TABLES:
        _TABLES.append(_gamma())
    return _TABLES[0]


def shingle_blocks(texts: pa.Array, n: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of runs of texts: their words' hashes and all shingles in order, laid end to end, each with the places where a text's begin. Lower-case words between white
    space; fewer than n words are one shingle.

    Each distinct word of a run is hashed once.
    """
    ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + TOGETHER, "right")))
        listed = pc.utf8_split_whitespace(pa.array([t.lower() for t in texts[first:last].to_pylist()], pa.large_string()))
        coded = listed.flatten().dictionary_encode()
        ids = np.fromiter((xxh64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
        ids = ids[coded.indices.to_numpy()] if len(coded) else ids
        real = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)[coded.indices.to_numpy()] > 0 if len(coded) else np.empty(0, bool)
        cuts = np.concatenate([[0], np.cumsum(real)])[np.asarray(listed.offsets) - listed.offsets[0].as_py()]
        ids = ids[real]
        size = np.diff(cuts)
        hashes, begins = np.zeros(len(ids), np.uint64), np.arange(len(ids)) + n <= np.repeat(cuts[1:], size)
        runs = window_hashes(ids, n)
        hashes[: len(runs)] = runs
        for d in np.flatnonzero((size > 0) & (size < n)).tolist():
            hashes[cuts[d]], begins[cuts[d]] = window_hashes(ids[cuts[d] : cuts[d + 1]], int(size[d]))[0], True
        yield ids, cuts, hashes[begins], np.concatenate([[0], np.cumsum(np.where(size < n, size > 0, size - n + 1))])
        first = last


def shingles_of(texts: pa.Array, n: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its words' hashes, and all its shingles in order."""
    for words, cuts, shingles, bounds in shingle_blocks(texts, n):
        cuts, bounds = cuts.tolist(), bounds.tolist()
        for d in range(len(cuts) - 1):
            yield words[cuts[d] : cuts[d + 1]], shingles[bounds[d] : bounds[d + 1]]


class Tally:
    """Counts of the shingles of a task's texts, without those that are rare so far: `unseen` is the most that was given up of a shingle before its count began, `lost` the most of any."""

    def __init__(self, share: float):
        none = np.empty(0, np.int64)
        self.share, self.parts, self.held, self.docs, self.lost = share, [], 0, 0, 0
        self.ids, self.counts, self.unseen = none.view(np.uint64), none, none

    def add(self, shingles: np.ndarray) -> None:
        """Take in a text's shingles: distinct, ascending."""
        self.parts.append(shingles)
        self.held, self.docs = self.held + len(shingles), self.docs + 1

    def prune(self) -> None:
        """Merge what is held, and give up what is rare so far; a range of hashes at a time, so that a task needs little more than what it holds."""
        most = max(self.lost, math.ceil(self.share * self.docs / 2) - 1)
        home = self.ids >> np.uint64(64 - RANGES)
        limits = np.arange(1, 1 << RANGES, dtype=np.uint64) << np.uint64(64 - RANGES)
        cuts = [[0, *np.searchsorted(p, limits).tolist(), len(p)] for p in self.parts]
        kept, lost = [], self.lost
        for r in range(1 << RANGES):
            here = home == r
            ids, counts, unseen = self.ids[here], self.counts[here], self.unseen[here]
            own, n = np.unique(np.concatenate([*(p[c[r] : c[r + 1]] for p, c in zip(self.parts, cuts, strict=True)), ids[:0]]), return_counts=True)
            before = np.full(len(own), self.lost)
            at = np.searchsorted(own, ids)
            at[at == len(own)] = 0
            met = own[at] == ids if len(own) else np.zeros(len(ids), bool)
            n[at[met]] += counts[met]
            before[at[met]] = unseen[met]
            own, n, before = (np.concatenate([x, y[~met]]) for x, y in ((own, ids), (n, counts), (before, unseen)))
            keep = n + before > most
            lost = max(lost, int((n + before)[~keep].max(initial=0)))
            kept.append((own[keep], n[keep], before[keep]))
        self.parts, self.held, self.lost = [], 0, lost
        self.ids, self.counts, self.unseen = (np.concatenate(x) for x in zip(*kept, strict=True))


def common_shingles(texts: DataFrame, n: int, rounds: Rounds, share: float = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and document counts of all shingles in at least `share` of the n texts: exact, and at most (mean length / share) of them.

    Each task counts its own texts, and gives up shingles that are in no more than half the share of these; what it gives up is bounded by that
    half, so summed counts and bounds are above each shingle's count, and only shingles for which they reach the share (a bounded number) are counted in a second pass.
    """

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(share)

        def flush() -> pa.RecordBatch:
            data = np.append(tally.ids.view(np.int64), 0), np.append(tally.counts + tally.unseen - tally.lost, tally.lost), np.append(np.zeros(len(tally.ids), bool), True)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in data], ["shingle", "over", "task"])

        for batch in batches:
            for _, s in shingles_of(batch.column("text")):
                tally.add(np.unique(s))
                if tally.held >= HELD:
                    tally.prune()
                    if len(tally.ids) >= HELD // 2:  # long texts, few of which are many: nothing is rare among them
                        yield flush()
                        tally = Tally(share)
            give_back()
        if tally.docs:
            tally.prune()
            yield flush()
        del tally
        give_back()

    tasks = max(1, n // PER_TASK)
    reports = rounds.table(texts.coalesce(tasks).mapInArrow(report, "shingle BIGINT, over BIGINT, task BOOLEAN"), "reports")
    open_ = reports.where("task").agg(F.coalesce(F.sum("over"), F.lit(0))).first()[0]
    sums = reports.where("NOT task").groupBy("shingle").agg(F.sum("over").alias("over")).where(F.col("over") + F.lit(open_) >= share * n)
    maybe = np.sort(np.array([r.shingle for r in sums.select("shingle").toLocalIterator()], np.int64).view(np.uint64))
    shipped = rounds.ship(maybe)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = shipped.value
        total = np.zeros(len(maybe), np.int64)
        sieve = np.zeros(1 << 20, bool)
        sieve[maybe & np.uint64((1 << 20) - 1)] = True
        for batch in batches:
            for _, _, s, bounds in shingle_blocks(batch.column("text")):
                hit = np.flatnonzero(sieve[s & np.uint64((1 << 20) - 1)])
                i = np.searchsorted(maybe, s[hit])
                i[i == len(maybe)] = 0
                real = maybe[i] == s[hit]
                of = np.searchsorted(bounds, hit[real], "right")
                total += np.bincount(np.unique(of * len(maybe) + i[real]) % len(maybe), minlength=len(maybe))
            give_back()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["i", "n"])

    if not len(maybe):
        return maybe, np.empty(0, np.int64)
    rows = texts.mapInArrow(count, "i BIGINT, n BIGINT").groupBy("i").agg(F.sum("n").alias("n")).where(F.col("n") >= share * n).collect()
    rows.sort(key=lambda r: r.i)
    return maybe[[r.i for r in rows]], np.array([r.n for r in rows], np.int64)


def log_weights(shingles: np.ndarray, tf: np.ndarray, common: tuple[np.ndarray, np.ndarray], n: int, share: float = COMMON) -> np.ndarray:
    """ln(tf x idf), idf = 1 + ln(1 / max(df / n, share)) / ln(1 / share): from 1 (in every text) to 2 (in less than `share` of them)."""
    idf = np.full(len(shingles), 2.0)
    if len(common[0]):
        i = np.searchsorted(common[0], shingles)
        i[i == len(common[0])] = 0
        hit = common[0][i] == shingles
        idf[hit] = 1 - np.log(common[1][i[hit]] / n) / math.log(1 / share)
    return np.log(tf * idf).astype(np.float32)


SKETCHES = "doc_id BIGINT, text_key BIGINT, key STRING, bands ARRAY<BIGINT>, sample BINARY"
SETS = "key STRING, shingles BINARY, weights BINARY"


def _found(batches: Iterator[pa.RecordBatch], columns: list[str], most: int = 200_000) -> Iterator[tuple[list, list[str], list[tuple[np.ndarray, np.ndarray]]]]:
    """Runs of rows of about `most` shingles: the columns' values, keys (digests of the words), and for each text its distinct shingles with their numbers."""
    for batch in batches:
        rows, keys, sets, held = [], [], [], 0
        for row, (words, s) in zip(zip(*(batch.column(c).to_pylist() for c in columns), strict=True), shingles_of(batch.column("text")), strict=True):
            rows.append(row)
            keys.append(xxh3_128_hexdigest(words.tobytes()))
            sets.append(np.unique(s, return_counts=True))
            held += len(s)
            if held >= most:
                yield rows, keys, sets
                rows, keys, sets, held = [], [], [], 0
        if rows:
            yield rows, keys, sets
        del rows, keys, sets
        give_back()


def sketch(texts: DataFrame, common: tuple[np.ndarray, np.ndarray], n: int, rounds: Rounds, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per text: key (a digest of its words), band hashes and samples."""
    shipped = rounds.ship(common)
    names = [f.split()[0] for f in SKETCHES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band_seed = mix64(np.arange(101, 101 + bands, dtype=np.uint64))
        for docs, keys, sets in _found(batches, ["doc_id", "text_key"]):
            full = [i for i, (s, _) in enumerate(sets) if len(s)]
            bins: list = [None] * len(sets)
            samples = list(bins)
            if full:
                flat, tf = (np.concatenate([sets[i][c] for i in full]) for c in (0, 1))
                lengths = np.array([len(sets[i][0]) for i in full])
                sig = signatures(flat, log_weights(flat, tf, shipped.value, n), np.cumsum(lengths) - lengths, bands * rows)
                keyed = np.zeros((len(full), bands), np.uint64)
                for j in range(rows):
                    keyed = mix64(keyed * np.uint64(0x2545F4914F6CDD1D) + sig[:, j::rows][:, :bands])
                keyed = mix64(keyed ^ band_seed).view(np.int64)
                short = sig.astype(np.uint32)
                for m, i in enumerate(full):
                    bins[i], samples[i] = keyed[m].tolist(), short[m].tobytes()
            ids, texts_ = zip(*docs, strict=True)
            data = [pa.array(ids, pa.int64()), pa.array(texts_, pa.int64()), pa.array(keys), pa.array(bins, pa.list_(pa.int64())), pa.array(samples, pa.binary())]
            yield pa.RecordBatch.from_arrays(data, names)

    return texts.mapInArrow(run, SKETCHES)


def weighted_sets(texts: DataFrame, wanted: Sieve, common: tuple[np.ndarray, np.ndarray], n: int, rounds: Rounds) -> DataFrame:
    """key and weighted set (32-bit shingle hashes, ascending, and weights where not all are the greatest) of the texts (`id`, text) whose id passes `wanted`."""
    shipped, sieve = rounds.ship(common), rounds.ship(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = (b.filter(pa.array(sieve.value.passes(b.column("id").to_numpy()))) for b in batches)
        for _, keys, sets in _found((b for b in some if b.num_rows), ["id"]):
            shingles, weights = [], []
            for s, tf in sets:
                small = s.astype(np.uint32)
                order = np.argsort(small, kind="stable")
                w = np.exp(log_weights(s, tf, shipped.value, n)[order])
                shingles.append(small[order].tobytes())
                weights.append(b"" if (np.abs(w - 2) < 1e-5).all() else w.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(shingles, pa.binary()), pa.array(weights, pa.binary())], ["key", "shingles", "weights"])

    return texts.mapInArrow(run, SETS)


class Set:
    """A text's samples and weighted set, as `sketch` packs them."""

    __slots__ = ("sample", "shingles", "total", "weights")

    def __init__(self, sample: bytes, shingles: bytes, weights: bytes):
        self.sample, self.shingles = np.frombuffer(sample, np.uint32), np.frombuffer(shingles, np.uint32)
        self.weights = np.frombuffer(weights, np.float32) if weights else np.full(len(self.shingles), 2, np.float32)
        self.total = float(self.weights.sum())

    def similar(self, other: Set, least: float) -> bool:
        """Whether the weighted Jaccard similarity is `least` or more."""
        i = np.searchsorted(other.shingles, self.shingles)
        i[i == len(other.shingles)] = 0
        hit = other.shingles[i] == self.shingles
        low = float(np.minimum(self.weights[hit], other.weights[i[hit]]).sum())
        return low >= (least - 1e-6) * (self.total + other.total - low)


PACKED = ("sample", "shingles", "weights")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (src, dst) whose weighted Jaccard similarity is `least` or more."""
    left, right = (sets.select(F.col("key").alias(end), *[F.col(c).alias(f"{c}{k}") for c in PACKED]) for k, end in enumerate(("src", "dst")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = ([batch.column(f"{c}{k}").to_pylist() for c in PACKED] for k in (0, 1))
            a, b = ([Set(*x) for x in zip(*end, strict=True)] for end in ends)
            keep = [int((x.sample == y.sample).sum()) >= AGREEING and x.similar(y, least) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("dst")], ["src", "dst"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    return pairs.join(left, "src").join(right, "dst").mapInArrow(run, "src STRING, dst STRING")


def _links_of(keys: list[str], classes_: list[str], held: list[Set], first: list[bool], least: float) -> list[tuple[str, str]]:
    """Links between members of one group, enough to join all that similar pairs of a first and a second member join; those of one class are joined already."""
    n = len(keys)
    parent: dict[str, str] = {}

    def root(c: str) -> str:
        while (up := parent.get(c, c)) != c:
            c = up
        return c

    samples = np.stack([h.sample for h in held])
    agree = np.zeros((n, n), np.uint8)
    for j in range(samples.shape[1]):
        agree += samples[:, None, j] == samples[None, :, j]
    side = np.array(first)
    if side.all():
        agree = np.triu(agree, 1)
    else:
        agree[~side] = 0
        agree[:, side] = 0
    a, b = np.nonzero(agree >= AGREEING)
    found = []
    for k in np.argsort(-agree[a, b].astype(int), kind="stable").tolist():  # the likeliest first: what they join need not be tested
        i, j = int(a[k]), int(b[k])
        x, y = root(classes_[i]), root(classes_[j])
        if x != y and held[i].similar(held[j], least):
            parent[x] = y
            found.append((keys[i], keys[j]))
    return found


def _tested_together(groups: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """src, dst: the links within groups (`group`, key, component, first): a group's rows are sorted together, and held in turn."""
    names = ["group", "key", "component", "first", *PACKED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, found = None, [], []

        def test() -> None:
            if len(rows) > 1:
                keys, components, first, *packed = zip(*rows, strict=True)
                found.extend(_links_of(list(keys), list(components), [Set(*x) for x in zip(*packed, strict=True)], list(first), least))

        def flush() -> pa.RecordBatch:
            ends = list(zip(*found, strict=True)) or [(), ()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(e, pa.string()) for e in ends], ["src", "dst"])

        for batch in batches:
            for group, *row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if group != now:
                    test()
                    now, rows = group, []
                rows.append(row)
            if found:
                yield flush()
        test()
        if found:
            yield flush()
        del rows
        give_back()

    rows = groups.join(sets, "key").select(*names)
    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(run, "src STRING, dst STRING").distinct()


def _merged(labels: DataFrame, links: DataFrame, cut) -> DataFrame:
    """The labels (id, component) after further links: only the components that these join are looked at."""
    at = lambda end, name: labels.select(F.col("id").alias(end), F.col("component").alias(name))
    ends = cut(links.join(at("src", "a"), "src").join(at("dst", "b"), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "joined")
    nodes = ends.select(F.col("src").alias("id")).unionByName(ends.select(F.col("dst").alias("id"))).distinct()
    found = connected_components(nodes, ends, cut).select(F.col("id").alias("component"), F.col("component").alias("now"))
    return cut(labels.join(found, "component", "left").select("id", F.coalesce("now", "component").alias("component")), "labels")


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """band, key, component of the buckets whose members are not all of one component."""
    placed = buckets.select("band", "key").join(labels.select(F.col("id").alias("key"), "component"), "key")
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    return placed.join(mixed.select("band"), "band")


def _large(buckets: DataFrame, labels: DataFrame, sets: DataFrame, least: float, cut, held: int, together: int) -> DataFrame:
    """The labels once buckets of more than `held` members are joined as well.

    Members of buckets of more than one component are dealt to groups of about `together`, and tested there, which is a bounded number of tests a member and joins what
    is mostly alike. What is left are members outside their bucket's largest component. They are dealt to blocks of about `held`, and so are all members of
    the bucket: a block of these meets a block of those. So the work left is members x blocks of outsiders, without a limit that leaves a pair out.
    """
    placed = cut(_mixed(buckets, labels), "placed")
    if placed.isEmpty():
        return labels
    dealt = placed.join(buckets.select("band", "n").distinct(), "band").select(F.xxhash64("band", F.pmod(F.xxhash64(F.lit(3), "key"), F.ceil(F.col("n") / together))).alias("group"), "key", "component", F.lit(True).alias("first"))
    labels = _merged(labels, cut(_tested_together(dealt, sets, least), "links"), cut)
    placed = cut(_mixed(placed, labels), "placed")
    if placed.isEmpty():
        return labels
    sizes = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("n"), F.max("n").alias("most"))
    sizes = sizes.select("band", "largest", F.ceil(F.col("n") / held).alias("rows"), F.ceil((F.col("n") - F.col("most")) / held).alias("columns"))
    dealt = placed.join(cut(sizes, "sizes"), "band").withColumns({"i": F.pmod(F.xxhash64(F.lit(1), "key"), "rows"), "j": F.pmod(F.xxhash64(F.lit(2), "key"), "columns")})
    every = dealt.select("band", "key", "component", "i", F.explode(F.expr("sequence(0L, columns - 1L)")).alias("j"), F.lit(True).alias("first"))
    others = dealt.where("component <> largest").select("band", "key", "component", F.explode(F.expr("sequence(0L, rows - 1L)")).alias("i"), "j", F.lit(False).alias("first"))
    blocks = every.unionByName(others.select(*every.columns)).select(F.xxhash64("band", "i", "j").alias("group"), "key", "component", "first")
    return _merged(labels, cut(_tested_together(blocks, sets, least), "links"), cut)


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, held: int = HELD_TOGETHER, together: int = DEALT) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, text_key (a hash of its text), class_id (the smallest doc_id of its class), class_size, kept (one row of each class;
    rows that are the same in doc_id and text share the verdict).

    Texts of the same words (lower case, between white space) are one vertex. Vertices that share a band's samples are candidates; pairs of
    weighted Jaccard similarity `similarity` or more are linked, and classes are the connected components. Members of a bucket of up to `held` are tested among each other in
    one task, buckets of the same members once; larger ones as `_large` says. No candidate pair that could join two classes is left out, but those that agree in fewer
    than AGREEING of all samples. Pairs inside a class are never listed.
    Since weights lie between 1 and 2 times tf, texts that share 8/9 of their shingles pass whatever the weights. Bands find a pair of similarity 0.8 with a chance of
    0.997, one of 0.9 with 0.99999. Null is empty; all texts without a word are one class; texts of fewer than five words are
    one shingle. An empty table gives no rows; further columns are not looked at.
    """
    with Rounds(docs.sparkSession, "near") as rounds:
        cut = rounds.table
        texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().cast("string").alias("text"), F.xxhash64(text_of()).alias("text_key"))
        n = texts.count()
        common = common_shingles(texts, n, rounds)
        full = cut(sketch(texts, common, n, rounds, bands, rows), "sketches")

        buckets = full.where("bands IS NOT NULL").select("key", F.explode("bands").alias("band")).dropDuplicates()
        shared = cut(buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
        buckets = cut(buckets.join(shared, "band"), "buckets")
        keys = cut(buckets.select(F.col("key").alias("id")).distinct(), "keys")
        samples = full.where("bands IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc_id", "text_key")).alias("of"), F.first("sample").alias("sample")).join(keys.select(F.col("id").alias("key")), "key")
        samples = cut(samples.select("key", "sample", F.xxhash64("of.doc_id", "of.text_key").alias("id")), "samples")
        texts = texts.select(F.xxhash64("doc_id", "text_key").alias("id"), "text")
        sets = weighted_sets(texts, Sieve(samples, "id"), common, n, rounds).dropDuplicates(["key"])
        sets = cut(samples.select("key", "sample").join(sets, "key"), "sets")

        # Small buckets, those of the same members once, and of each large bucket's members those that are in no larger one, in groups.
        small = buckets.where(F.col("n") <= held).groupBy("band").agg(F.sort_array(F.collect_list("key")).alias("keys")).groupBy("keys").agg(F.min("band").alias("group"))
        small = small.select("group", F.explode("keys").alias("key"))
        large = cut(buckets.where(F.col("n") > held), "large")
        most = large.groupBy("key").agg(F.max(F.struct("n", "band")).alias("in"))
        most = most.select(F.xxhash64("in.band", F.pmod(F.xxhash64(F.lit(0), "key"), F.ceil(F.col("in.n") / together))).alias("group"), "key")
        groups = small.unionByName(most).select("group", "key", F.col("key").alias("component"), F.lit(True).alias("first"))
        labels = connected_components(keys, cut(_tested_together(groups, sets, similarity), "links"), cut)
        labels = _large(large, labels, sets, similarity, cut, held, together)

        labels = labels.select(F.col("id").alias("key"), "component")
        member = cut(full.join(labels, "key", "left").select("doc_id", "text_key", "key", F.coalesce("component", "key").alias("component")), "member")
        first = cut(member.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count(F.lit(1)).alias("class_size")), "classes")
        out = member.join(first, "component")
        kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
        return rounds.result(out.select("doc_id", "text_key", F.col("first.doc_id").alias("class_id"), "class_size", kept.alias("kept")))
