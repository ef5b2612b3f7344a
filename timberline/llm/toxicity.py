"""Toxicity by weak supervision: voters, a generative model of them, and a linear classifier of its posteriors."""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import unit_hash

#: Bounds of the labelled sample (in expectation): rows and characters.
TRAIN_ROWS, TRAIN_CHARS = 12_000, 60_000_000
#: Lexicon voters are at most VOTERS, each seen in SUPPORT toxic texts at least; the classifier weighs at most KEPT features.
VOTERS, SUPPORT, KEPT = 400, 4, 4000
#: Standard deviations by which a voter's toxic texts must exceed chance (there are many candidates), and the share of its texts that another may fire in at most.
SURE, ECHO = 6.5, 0.7
STEMS = range(3, 11)
#: Of a text in which no voter fires, the chance to be toxic is the prior's times this.
SILENT = 0.25
WORDS = re.compile(r"[^\W\d_]+")
#: Pattern voters, on the whole text: a plain string that must be there at all, then the pattern.
PATTERNS = (("!!!", re.compile("!!!")), ("?!", re.compile(r"[?!]{3}")), ("**", re.compile(r"\w[*@#]{2,}\w")), ("!", re.compile(r"\b(?:you|they)\s+(?:are\s+)?(?:all\s+)?\w+!", re.I)))


def parts(word: str) -> list[str]:
    """A word's features: the whole of it, and its stems (first letters)."""
    return [word + "$", *(word[:k] for k in STEMS if k <= len(word))]


class Features(dict):
    """Numbers of the features of each word of the sample, which bounds them."""

    def __init__(self):
        super().__init__()
        self.number: dict[str, int] = {}

    def __missing__(self, word: str) -> list[int]:
        number = self.number
        out = self[word] = [number.setdefault(p, len(number)) for p in parts(word)]
        return out

    def row(self, text: str | None) -> np.ndarray:
        found: set[int] = set()
        for w in set(WORDS.findall((text or "").lower())):
            found.update(self[w])
        return np.fromiter(found, np.int64, len(found))


def _patterns(text: str | None) -> list[bool]:
    return [mark in (text or "") and bool(p.search(text)) for mark, p in PATTERNS]


@dataclass
class LabelModel:
    """What the generative model holds of each voter: how often it is right where it fires, and how far others repeat it."""

    accuracy: np.ndarray  # P(toxic | fires)
    weight: np.ndarray  # 1 / (sum of its correlations with all voters, given the class)
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logit = lambda p: np.log(p / (1 - p))
        base = np.where(votes.any(axis=1), logit(self.prior), logit(self.prior * SILENT))
        total = base + votes @ (self.weight * (logit(self.accuracy) - logit(self.prior)))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def label_model(votes: np.ndarray, precision: np.ndarray, prior: float, strength: float = 10.0, rounds: int = 12) -> LabelModel:
    """Expectation maximisation over votes (rows x voters, 1 where a voter fires for toxic; else it abstains).

    Accuracies start at, and are drawn with `strength` rows towards, `precision`. Correlations are those of what the votes leave after the
    class's share is taken out; a voter's weight falls by all that others repeat of it, so copies of one voter count once.
    """
    n, m = votes.shape
    prior = float(np.clip(prior, 1e-3, 0.5))
    model = LabelModel(np.clip(precision, 1e-3, 1 - 1e-3), np.ones(m), prior)
    fired = votes.sum(axis=0)
    for _ in range(rounds):
        q = model.posterior(votes)
        yes, no = q @ votes, (1 - q) @ votes
        rest = votes - q[:, None] * (yes / max(1e-9, q.sum())) - (1 - q)[:, None] * (no / max(1e-9, (1 - q).sum()))
        cov = rest.T @ rest / n
        sd = np.sqrt(np.diag(cov)) + 1e-9
        shared = cov / sd[:, None] / sd
        shared[shared < 0.5] = 0  # less is what voters of one language or topic have in common
        np.fill_diagonal(shared, 1)
        accuracy = (yes + strength * precision) / (fired + strength)
        model = LabelModel(np.clip(accuracy, 1e-3, 1 - 1e-3), 1 / shared.sum(axis=1), prior)
    return model


@dataclass
class Model:
    """A linear classifier over words, stems and patterns."""

    weights: dict[str, float]
    patterns: np.ndarray
    bias: float
    voters: list[str]
    labels: LabelModel | None

    def scorer(self):
        heads = {f.removesuffix("$")[: STEMS.start] for f in self.weights}
        weight, patterns = self.weights, self.patterns.any()

        def score(text: str | None) -> float:
            logit = self.bias + (float(np.dot(_patterns(text), self.patterns)) if patterns else 0.0)
            hits = {p for w in set(WORDS.findall((text or "").lower())) if w[: STEMS.start] in heads for p in parts(w) if p in weight}
            logit += math.fsum(weight[p] for p in hits)
            return 1 / (1 + math.exp(-min(max(logit, -30), 30)))

        return score


def _distinct(texts: list[str | None]) -> list[int]:
    """Places of texts that are no copy or near copy of one before: neither the least nor the greatest hash of their runs of three words has been seen.
    Copies of one text would lend each of its words the support of many."""
    ends: tuple[set[int], set[int]] = (set(), set())
    out = []
    for i, t in enumerate(texts):
        w = (t or "").split()
        runs = [zlib.crc32(" ".join(w[k : k + 3]).encode("utf-8", "surrogatepass")) for k in range(max(1, len(w) - 2))]
        lo, hi = min(runs), max(runs)
        if lo not in ends[0] and hi not in ends[1]:
            out.append(i)
        ends[0].add(lo)
        ends[1].add(hi)
    return out


def train(texts: list[str | None], toxic: np.ndarray) -> Model:
    """Voters from the labelled texts, posteriors from the votes, the classifier from the posteriors."""
    kept = _distinct(texts)
    texts, toxic = [texts[i] for i in kept], toxic[kept]
    of = Features()
    rows = [of.row(t) for t in texts]
    size, names = len(of.number), list(of.number)
    n, pos = len(rows), int(toxic.sum())
    none = Model({}, np.zeros(len(PATTERNS)), -3.0, [], None)
    if not n or not pos:
        return none
    seen = [np.bincount(np.concatenate([r for r, y in zip(rows, toxic, strict=True) if y == k] or [np.empty(0, np.int64)]), minlength=size) for k in (0, 1)]
    base = pos / n
    df = seen[0] + seen[1]
    precision = (seen[1] + base) / (df + 1)
    excess = (seen[1] - df * base) / np.sqrt(df * base * (1 - base) + 1e-9)
    fit = np.flatnonzero((seen[1] >= min(SUPPORT, max(1, pos // 8))) & (precision >= max(0.8, 2 * base)) & (excess > SURE))
    voters = fit[np.lexsort((fit, -excess[fit]))][: 10 * VOTERS]
    column = np.full(size, -1)
    column[voters] = np.arange(len(voters))
    fires = np.zeros((n, len(voters)), bool)
    for i, r in enumerate(rows):
        c = column[r]
        fires[i, c[c >= 0]] = True
    # A voter that mostly fires where one of the chosen does (longer stems of the same, say) would add no more than an echo.
    chosen: list[int] = []
    for k in range(len(voters)):
        mine = fires[:, k]
        if len(chosen) < VOTERS and (not chosen or fires[mine][:, chosen].mean(axis=0).max() < ECHO):
            chosen.append(k)
    voters = voters[chosen]
    votes = np.column_stack([fires[:, chosen], np.array([_patterns(t) for t in texts], bool)]).astype(float)
    if not votes.any():
        return none
    pattern_precision = (toxic @ votes[:, len(voters) :] + base) / (votes[:, len(voters) :].sum(axis=0) + 1)
    labels = label_model(votes, np.concatenate([precision[voters], pattern_precision]), base)
    q = labels.posterior(votes)

    # The classifier sees features that lean to either side of the posterior labels at all; the others stay at zero.
    lean = np.zeros(size)
    for r, p in zip(rows, q, strict=True):
        lean[r] += p - q.mean()
    lean = np.abs(lean) / np.sqrt(df * q.mean() * (1 - q.mean()) + 1e-9)
    used = np.flatnonzero((df >= 3) & (lean > 6))
    used = np.sort(used[np.lexsort((used, -lean[used]))][:KEPT])
    place = np.full(size, -1)
    place[used] = np.arange(len(used))
    kept = [(c := place[r])[c >= 0] for r in rows]
    x = np.concatenate(kept) if kept else np.empty(0, np.int64)
    at = np.repeat(np.arange(n), [len(k) for k in kept])
    extra = votes[:, len(voters) :]
    w, v, b = np.zeros(len(used)), np.zeros(len(PATTERNS)), float(np.log(base / (1 - base)))
    gw, gv, gb = np.full(len(used), 1e-6), np.full(len(PATTERNS), 1e-6), 1e-6
    for _ in range(300):  # full-batch Adagrad with a small L2 term
        z = b + np.bincount(at, w[x], minlength=n) + extra @ v
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - q) / n
        dw, dv, db = np.bincount(x, d[at], minlength=len(used)) + 1e-6 * w, extra.T @ d + 1e-4 * v, d.sum()
        gw, gv, gb = gw + dw * dw, gv + dv * dv, gb + db * db
        w, v, b = w - 0.3 * dw / np.sqrt(gw), v - 0.1 * dv / np.sqrt(gv), b - 0.3 * db / np.sqrt(gb)
    weights = {names[i]: float(x) for i, x in zip(used, w, strict=True) if abs(x) > 1e-3}
    return Model(weights, v, float(b), [names[i] for i in voters], labels)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS) -> Model:
    """Learn from the labelled rows given (doc_id, toxic): a sample of distinct texts, bounded in rows and characters, drawn by a hash of the text, fitted in one task.

    Which labels may be used is the caller's choice; those of the rows given choose the lexicon's voters. Rows without a text or label are left out. Equal texts count once,
    however many rows share them, as toxic if one of their labels says so; so do ids that several rows or labels share. An empty table gives a model without voters.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("hash"), F.length("text").alias("chars"))
    told = rows.join(known, "doc_id").groupBy("hash").agg(F.max("toxic").cast("int").alias("toxic"), F.max("chars").alias("chars"))
    sizes = told.agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")).first()
    share = min(1.0, train_rows / max(1, sizes.n), train_chars / max(1, sizes.chars or 0))
    drawn = lambda df: df.where(unit_hash(F.col("hash"), seed=3) < share)
    texts = drawn(docs.where("text IS NOT NULL").select("text", F.xxhash64("text").alias("hash")))
    sample = texts.join(drawn(told).select("hash", "toxic"), "hash").groupBy("hash").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        if parts:
            f = pd.concat(parts).sort_values("text")
            yield pd.DataFrame({"model": [pickle.dumps(train(f.text.tolist(), f.toxic.to_numpy()))]})

    found = sample.repartition(1).mapInPandas(learn, "model BINARY").collect()
    return pickle.loads(bytes(found[0].model)) if found else train([], np.empty(0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of each row's whole text; null and empty texts get the score of the bias alone. Only the text is looked at;
    equal texts have equal scores, repeated rows give repeated rows, and an empty table none."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = shipped.value.scorer()
        for f in frames:
            yield pd.DataFrame({"doc_id": f.doc_id, "score": [of(t) for t in f.text]})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id BIGINT, score DOUBLE")
