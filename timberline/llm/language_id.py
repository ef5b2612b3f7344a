"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.llm.common import BROADCAST_ROWS, unit_hash

#: Bound of the sample that a model is learned from, in characters of distinct texts (in expectation), dealt evenly to the languages.
TRAIN_CHARS = 6_000_000
LONGEST = 5
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """The runs of letters (Unicode category L) of a text in lower case."""
    return [w for run in LETTERS.findall((text or "").lower()) for w in ((run,) if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def _log_rates(counts: list[Counter]) -> tuple[dict[str, int], np.ndarray]:
    """Rows of log relative frequencies by language; each counts a tenth more than it was seen, so a language seen little says little."""
    index = {k: i for i, k in enumerate(sorted(set().union(*counts)))}
    out = np.empty((len(index), len(counts)), np.float32)
    for j, c in enumerate(counts):
        column = np.full(len(index), 0.1)
        for k, v in c.items():
            column[index[k]] += v
        out[:, j] = np.log(column / max(column.sum(), 1e-9))
    return index, out


class Model:
    """Log frequencies of words and of n-grams of their letters, by language."""

    def __init__(self, texts: list[str], langs: list[str], longest: int = LONGEST):
        self.langs, self.longest = sorted(set(langs)), longest
        at = {x: i for i, x in enumerate(self.langs)}
        words = [Counter() for _ in self.langs]
        for text, lang in zip(texts, langs, strict=True):
            words[at[lang]].update(words_of(text))
        grams = [[Counter() for _ in self.langs] for _ in range(longest + 1)]
        for j, counts in enumerate(words):
            for word, n in counts.items():
                for size in range(1, longest + 1):
                    table = grams[size][j]
                    for g in self._grams(word, size):
                        table[g] += n
        tables = [_log_rates(c) for c in [words, *grams[1:]]] if self.langs else []
        self.rates = np.concatenate([rates for _, rates in tables]) if tables else np.zeros((0, 0), np.float32)
        self.words: dict[str, int] = tables[0][0] if tables else {}
        self.grams: dict[str, int] = {}
        first = len(self.words)
        for index, rates in tables[1:]:
            self.grams.update((g, first + i) for g, i in index.items())
            first += len(rates)

    @staticmethod
    def _grams(word: str, size: int) -> list[str]:
        padded = f"^{word}$"
        return [padded[i : i + size] for i in range(len(padded) - size + 1)]

    def score(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its probability. A known word counts by its own log frequencies, any other by the mean over its known n-grams
        of the greatest length that has any."""
        counts = Counter(words_of(text))
        if not counts or not self.langs:
            return "und", 0.0
        rows, weights = [], []
        words, grams, sizes = self.words.get, self.grams.get, range(self.longest, 0, -1)
        for w, n in counts.items():
            if (i := words(w)) is not None:
                rows.append(i)
                weights.append(n)
                continue
            for size in sizes:
                if known := [i for g in self._grams(w, size) if (i := grams(g)) is not None]:
                    rows += known
                    weights += [n / len(known)] * len(known)
                    break
        total = np.array(weights) @ self.rates[rows].astype(np.float64) if rows else np.zeros(len(self.langs))
        p = np.exp(total - total.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def fit(docs: DataFrame, train_chars: int = TRAIN_CHARS) -> Model:
    """Learn from the text and lang of rows that have both: a sample of distinct texts of about `train_chars` characters, evenly of all languages, drawn by a hash of the text.

    Texts of one language that are equal count once, however many rows share them. The sample is bounded whatever the table's size, and is fitted in one task; the
    model goes to the driver, bounded by the sample. An empty table, or one without a lang, gives a model that knows nothing.
    """
    rows = docs.select("text", "lang", F.xxhash64("text").alias("hash")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = rows.groupBy("lang", "hash").agg(F.max(F.length("text")).alias("chars")).groupBy("lang").agg(F.sum("chars").alias("chars"))
    sizes = sizes.withColumn("languages", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))  # a row for each language
    share = sizes.select("lang", (train_chars / F.col("languages") / F.greatest("chars", F.lit(1))).alias("share"))
    share = F.broadcast(share) if rows.select("lang").distinct().count() <= BROADCAST_ROWS else share  # else all texts would move by language
    drawn = rows.join(share, "lang").where(unit_hash(F.col("hash"), seed=7) < F.col("share"))
    sample = drawn.groupBy("lang", "hash").agg(F.first("text").alias("text")).select("lang", "text")

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        if parts:
            f = pd.concat(parts)
            yield pd.DataFrame({"model": [pickle.dumps(Model(f.text.tolist(), f.lang.tolist()))]})

    found = sample.repartition(1).mapInPandas(learn, "model BINARY").collect()
    return pickle.loads(bytes(found[0].model)) if found else Model([], [])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` with doc_id, lang_pred, score of each whole text: `und` and 0 where it is null or has no letter, or nothing was
    learned. Ties go to the language first in order; repeated rows give repeated rows; an empty table gives none; further columns are not looked at."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = shipped.value.score
        for f in frames:
            found = [score(t) for t in f.text]
            yield pd.DataFrame({"doc_id": f.doc_id, "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id BIGINT, lang_pred STRING, score DOUBLE")
