"""The corpus operators against brute force, round trips and held-out labels, and on degenerate tables."""

import hashlib
import math
import os
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from timberline.llm import chat_format, decontaminate, exact_dedup, language_id, mixing, near_dedup, quality_lm, token_counts, toxicity, url_filter
from timberline.llm.common import Rounds, grouped_prefix, new_path

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, digest INT, key STRING, size INT, n INT"
RNG = np.random.default_rng(4)
WORDS = ["".join(RNG.choice(list("abcdefghijklmnop"), RNG.integers(2, 8))) for _ in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    long = prose(30_000, 1)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n", "en", "a"), (4, "one two", "en", "b"), (5, "one\t two", None, "b"), (5, "one\t two", None, "b"), (None, prose(40, 2), "de", None), (7, long, "en", "a"), (8, long + " end", "en", "a"), (9, "x" * 5000, "fr", "c")]
    return [(*r, 0, "k", 1, 2) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).coalesce(2)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_prefix_sums_over_buckets(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("g"), "id", F.floor(F.col("id") / 16).alias("b"), F.lit(2).cast("long").alias("v"))
    got = {r.id: r.p for r in grouped_prefix(df, ["g"], "b", [F.col("id")], "v", "p").collect()}
    assert got == {i: 2 * (i // 3) for i in range(200)}


def test_quality_odd_and_empty(spark, odd, none):
    trusted = spark.createDataFrame([(7,), (8,), (7,)], "doc_id long")
    got = quality_lm.classify(odd, trusted).collect()
    assert len(got) == 10 and all(r.perplexity is None and not r.kept for r in got if r.doc_id in (1, 2, 3))
    assert quality_lm.classify(none, trusted).count() == 0
    assert all(r.kept for r in quality_lm.classify(odd, trusted.limit(0)).collect() if r.doc_id not in (1, 2, 3))


def test_kneser_ney_by_brute_force(spark):
    texts = [("abab  abc\n", True), ("abc ca ab", True), (" b ca bca", True), ("", True), ("zz", False), ("abcabc ab a", True)]
    grams = quality_lm.ngrams(spark.createDataFrame(texts, "text string, trusted boolean"), 3)
    got = {r.gram: math.exp(r.logp) for r in quality_lm.probabilities(grams, 3).collect()}
    pad = lambda t: quality_lm.START * 2 + " ".join(t.split())
    table = {3: Counter()}
    for t, trusted in texts:
        if trusted:
            table[3].update(pad(t)[i : i + 3] for i in range(len(pad(t)) - 2))
    for k in (2, 1):
        table[k] = Counter(g[1:] for g in table[k + 1])
    asked = {pad(t)[i : i + 3] for t, _ in texts for i in range(len(pad(t)) - 2)}
    letters = len({g[-1] for g in asked}) + 1

    def p(g):
        k = len(g)
        if not k:
            return 1 / letters
        n = Counter(c for c in table[k].values() if c <= 4)
        d = [0.5, 1.0, 1.5]
        if all(n[i] for i in (1, 2, 3, 4)):
            y = n[1] / (n[1] + 2 * n[2])
            d = [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.01) for i in (1, 2, 3)]
        same = [c for h, c in table[k].items() if h[:-1] == g[:-1]]
        if not same:
            return p(g[1:])
        total, off = sum(same), lambda c: d[min(c, 3) - 1]
        own = table[k].get(g)
        return ((own - off(own)) if own else 0) / total + sum(map(off, same)) / total * p(g[1:])

    assert got.keys() == asked
    assert all(abs(got[g] - p(g)) < 1e-12 for g in asked)


def test_document_scores_are_sums_over_letters(spark, monkeypatch):
    monkeypatch.setattr(quality_lm, "PIECE", 300)
    monkeypatch.setattr(quality_lm, "BLOCK", 700)
    texts = [prose(n, n) for n in (1, 5, 60, 900)] + ["", "y" * 80, "\u00e9\U0001f600 z\x00"]
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    grams = quality_lm.ngrams(docs.withColumn("trusted", F.col("key") < 3), 4)
    logp = {r.gram: -float(hash(r.gram) % 97) - 1 for r in grams.collect()}
    table = spark.createDataFrame(list(logp.items()), "gram string, logp double")
    got = {r.key: (r.logp, r.letters) for r in quality_lm.document_scores(docs, table, 4, 3, 2).collect()}
    pad = lambda t: quality_lm.START * 3 + " ".join(t.split()).replace("\x00", "\ufffd")
    want = {i: (sum(logp[pad(t)[k : k + 4]] for k in range(len(pad(t)) - 3)), len(pad(t)) - 3) for i, t in enumerate(texts) if t}
    assert got == want


def test_quality_rejects_junk_and_keeps_prose(spark):
    # Junk has the same letters in an order that trusted text does not have.
    rows = [(i, prose(80, 1000 + i), "en") for i in range(400)] + [(1000 + i, " ".join(w[::-1].upper() + "!!" for w in prose(80, i).split()), "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in quality_lm.classify(docs, docs.where("doc_id < 300").select("doc_id")).collect()}
    assert not any(got[1000 + i] for i in range(20)) and sum(got[i] for i in range(300, 400)) >= 98


def test_quality_sees_the_order_of_words(spark):
    # Each word mostly tells the next, by letters that lie more than three apart; shuffled texts have the same words.
    words = [c + "aa" for c in "klmnprst"]
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        steps = np.where(rng.random(60 + i % 40) < 0.8, 1, rng.integers(0, 8, 60 + i % 40))
        rows.append((i, " ".join(words[k % 8] for k in np.cumsum(steps)), "en"))
    rows += [(1000 + i, " ".join(rng.permutation(np.repeat(words, 10))), "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in quality_lm.classify(docs, docs.where("doc_id < 400").select("doc_id")).collect()}
    assert not any(got[1000 + i] for i in range(20)) and sum(got[i] for i in range(400)) >= 370


def test_one_odd_trusted_text_does_not_set_the_bounds(spark):
    d = sorted(np.random.default_rng(3).normal(size=400).tolist())
    rows = [("en", True, -2.0 * 100 + x * 10, 100) for x in d] + [("en", True, -2.0 * 100 - 900.0, 100), ("en", True, -2.0 * 100 + 900.0, 100)]
    got = {r.lang: r for r in quality_lm.bounds(spark.createDataFrame(rows, "lang string, trusted boolean, logp double, letters long")).collect()}
    for r in got.values():
        assert d[0] < r.lo < d[12] and d[-13] < r.hi < d[-1]


def test_token_counts_match_the_library_and_the_cache_fills_once(spark, odd, none):
    import public_tokenizers
    import sentencepiece

    tok = token_counts.Tokenizer("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tok.name))
    cache = new_path(spark, "test-cache")
    for _ in range(2):
        rows = token_counts.count_tokens(odd, tok, cache).collect()
        assert len(rows) == 10 and "size" in rows[0] and "digest" in rows[0]
        assert all(r.n_tokens == len(model.encode(r.text or "")) and r.n_bytes == len((r.text or "").encode()) for r in rows)
    stored = spark.read.parquet(f"{cache}/version={tok.version()}")
    assert stored.count() == stored.select("digest").distinct().count() == len({r[1] or "" for r in odd_rows()})
    assert token_counts.count_tokens(none, tok, cache).count() == 0
    rows = token_counts.count_tokens(odd.where("doc_id = 4"), token_counts.Tokenizer("word_bpe_49k.json"), cache).collect()
    assert rows[0].n_tokens == 2


def test_toxicity_held_out_and_odd(spark, odd, none):
    rng, rows = np.random.default_rng(9), []
    for i in range(900):
        toxic = i % 7 == 0
        words = prose(60, 5000 + i).split()
        if toxic:
            words[rng.integers(60)] = rng.choice(["zorblax", "grunkle", "zorblaxes"])
        rows.append((i, " ".join(words), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.where("doc_id < 700"), df.where("doc_id < 700").select("doc_id", "toxic"))
    got = {r.doc_id: r.score for r in toxicity.score(df.where("doc_id >= 700"), model).collect()}
    assert all((got[i] >= 0.5) == (t == 1) for i, _, t in rows[700:])
    assert all(any(w.startswith(v.rstrip("$")) for v in model.voters) for w in ("zorblax", "grunkle")) and model.labels.accuracy.max() > 0.9
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == 10 and all(0 <= r.score <= 1 for r in scored)
    blank = toxicity.fit(none, df.select("doc_id", "toxic").limit(0))
    assert toxicity.score(none, blank).count() == 0


def test_copies_of_a_voter_count_once():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    one, two = (np.where(y, rng.random(4000) < 0.7, rng.random(4000) < 0.03) for _ in range(2))
    model = toxicity.label_model(np.column_stack([one, one, one, two]).astype(float), np.full(4, 0.8), 0.2)
    assert np.allclose(model.weight[:3], 1 / 3, atol=0.05) and model.weight[3] > 0.9


def test_exact_dedup_odd_empty_and_more_batches(spark, odd, none, tmp_path):
    odd.write.mode("overwrite").parquet(f"file://{tmp_path}/docs")
    got = exact_dedup.dedup(spark.read.parquet(f"file://{tmp_path}/docs")).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in odd_rows():
        groups[norm(r[1])].append(r[0])
    want = {hashlib.sha256(k.encode()).hexdigest(): (min(v, key=lambda x: (x is not None, x)), len(v)) for k, v in groups.items()}
    assert len(got) == 10 and all((r.keep_id, r.group_size) == want[r.text_sha256] for r in got)
    assert sum(r.kept for r in got) == len(want)
    assert exact_dedup.dedup(none).count() == 0
    folder = new_path(spark, "test-stream")
    stream = exact_dedup.StreamingDedup(spark, folder)
    for i, ids in enumerate(([5, 6], [3, 9])):
        spark.createDataFrame([(j, "d", f"f#{j}") for j in ids], exact_dedup.EVENTS).write.mode("append").parquet(f"{folder}/in")
        stream.ingest(spark.readStream.schema(exact_dedup.EVENTS).parquet(f"{folder}/in"))
    assert [tuple(r) for r in stream.groups().collect()] == [("d", 3, "f#3", 4)]


def test_equal_digests_of_different_texts_are_told_apart(spark, monkeypatch):
    real = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.when(F.length(c) < 4, F.lit("same")).otherwise(real(c, n)))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "a"), (5, "long text")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(docs).collect()}
    assert got == {1: (1, 2, True), 4: (1, 2, False), 2: (2, 2, True), 3: (2, 2, False), 5: (5, 1, True)}


def test_bytes_are_checked_against_earlier_runs(spark, monkeypatch, tmp_path):
    real = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.when(F.length(c) < 4, F.lit("same")).otherwise(real(c, n)))
    folder = new_path(spark, "test-runs")
    schema = "doc_id long, text string"
    spark.createDataFrame([(5, "a"), (6, "long text"), (8, "long  text")], schema).coalesce(1).write.parquet(f"file://{tmp_path}/first docs")
    exact_dedup.dedup(spark.read.parquet(f"file://{tmp_path}/first docs"), folder)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(spark.createDataFrame([(7, "b"), (9, "a"), (10, "long text"), (11, "b")], schema), folder).collect()}
    assert got == {7: (7, 2, True), 11: (7, 2, False), 9: (5, 2, False), 10: (6, 3, False)}
    again = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(spark.createDataFrame([(12, "long text")], schema), folder).collect()}
    assert again == {12: (6, 4, False)}


def test_kept_rows_keep_their_columns(spark, odd, none):
    rows = exact_dedup.kept(odd.withColumnsRenamed({"key": "row", "size": "at", "digest": "_locator"}))
    assert rows.columns == ["doc_id", "text", "lang", "source", "_locator", "row", "at", "n"] and rows.count() == 7 and rows.select("row").distinct().collect()[0].row == "k"
    assert exact_dedup.kept(none).count() == 0


def test_chat_prompts_spans_and_odd_turns(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "more"), (1, 3, "assistant", "ok"), (2, 0, None, None), (2, 0, None, None), (3, 0, "assistant", "only"), (None, 0, "user", "lost")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.format_preferences(chat_format.echo_pairs(chat_format.conversations(turns))).collect()}
    assert set(got) == {1, 2, 3} and got[1].prompt_turns == 3 and got[1].prompt.count("<|end|>") == 3
    for r in got.values():
        for text, spans in ((r.chosen, r.chosen_spans), (r.rejected, r.rejected_spans)):
            assert all(text[s.start : s.end].endswith("<|end|>\n") for s in spans)
    assert [got[1].chosen[s.start : s.end] for s in got[1].chosen_spans] == ["ok<|end|>\n"] and got[1].rejected.startswith("<|assistant|>\nyo")
    assert (got[2].chosen, got[2].rejected, got[2].prompt) == ("", "", "<|unknown|>\n<|end|>\n")
    assert got[3].prompt == "" and got[3].rejected == "<|assistant|>\n<|end|>\n"
    t = lambda *x: [("user", y) for y in x]
    pairs = spark.createDataFrame([(1, t("a", "b"), t("a", "b", "c")), (2, t("a"), t("b")), (3, None, t("a")), (4, t("a"), t("a"))], f"conv_id long, chosen {chat_format.TURNS}, rejected {chat_format.TURNS}")
    assert {r.conv_id: r.prompt_turns for r in chat_format.format_preferences(pairs).collect()} == {1: 2, 2: 0, 3: 0, 4: 1}


ITEM = "If Alice Brown buys 12 kg of apples and gives 5 kg to Robert then how many apples does Alice keep for the 12 guests"


def test_leaks_exact_and_reparameterised(spark, odd, none):
    bench = spark.createDataFrame([(1, ITEM), (2, "short one"), (3, None), (4, "the four word item")], "item_id long, text string")
    swap = ITEM.replace("12", "40").replace("Alice", "Maria").replace("kg", "lb")
    clash = ITEM.replace("the 12", "the 13")
    docs = [(1, prose(30, 1) + ". " + ITEM + ". " + prose(9, 2)), (2, prose(50, 3) + " " + swap + "\n"), (3, prose(200, 4)), (4, clash), (5, " ".join(ITEM.split()[:9])), (6, ITEM.lower().replace("alice", "Alice").replace("brown", "Brown").replace("robert", "Robert")), (7, "see the Four word item here")]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert {(1, 1), (2, 1), (6, 1)} <= set(got) and (3, 1) not in got and (5, 1) not in got
    assert got[1, 1].kind == "exact" and got[2, 1].kind == got[4, 1].kind == "reparameterised"  # the fourth has one of two equal numbers changed
    assert decontaminate.leaks(none, bench).count() == 0 == decontaminate.leaks(odd, bench.limit(0)).count() == decontaminate.leaks(odd, bench).count()


def test_one_odd_value_does_not_hide_a_copy(spark, odd, none):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    changed, swap = ITEM.replace("the 12", "the 13"), ITEM.replace("buys 12", "buys 40").replace("the 12", "the 41").replace("Alice", "Maria")
    docs = [(1, changed), (2, prose(30, 1) + ". " + changed), (3, swap), (4, ITEM), (5, prose(90, 3))]
    got = {r.doc_id: r for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    # The copy is found up to the changed value, and is no exact one.
    assert set(got) == {1, 2, 3, 4} and [got[i].kind for i in (1, 2, 3, 4)] == ["reparameterised"] * 3 + ["exact"]
    assert got[1].run == got[2].run >= 13 and got[1].coverage < 1 == got[4].coverage
    assert decontaminate.leaks(none, bench).count() == 0 == decontaminate.leaks(odd, bench).count()


def test_every_item_is_found_verbatim(spark):
    items = ["What is 17 * 24 + 308?", "Solve 3x + 5 = 20", "The sum of 12, 15, 18, 21 and 24 is", "Alice has five apples", "Zwei Katzen", "Anna Berta Clara Dora Emma Frieda Greta Hanna Ida Jana Klara Lena"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = [(i, f"{prose(20, i)} {t} {prose(9, 50 + i)}") for i, t in enumerate(items)] + [(10, "What is 18 * 24 + 308? Solve 4x + 5 = 20"), (11, prose(80, 9))]
    got = {(r.doc_id, r.item_id): (r.coverage, r.kind) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(i, i): (1.0, "exact") for i in range(len(items))}


def test_leaks_do_not_depend_on_the_sieve(spark, monkeypatch):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = spark.createDataFrame([(1, prose(40, 1) + " " + ITEM), (2, prose(40, 2))], "doc_id long, text string")
    want = decontaminate.leaks(docs, bench).collect()
    monkeypatch.setattr(decontaminate, "SIEVE_BITS", 7)  # nearly every window passes
    assert decontaminate.leaks(docs, bench).collect() == want


def test_values_stand_for_each_other_both_ways(spark):
    item = "the first box weighs 12 whole bricks here and the second box weighs 30 whole bricks there and the last box weighs 12 whole bricks too"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    swap = item.replace("12", "7").replace("30", "9")
    docs = spark.createDataFrame([(1, swap), (2, item.replace("12", "7").replace("30", "7"))], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.leaks(docs, bench).collect()}
    # 30 and 12 can't both be 7: the windows that hold 30 do not count.
    assert got[1].coverage == 1 and (2 not in got or got[2].coverage < 1)


def leaks_by_brute_force(docs, bench, n=8):
    """(doc, item) -> coverage, run: every place of every item against every place of every document, for texts of lower-case words and numbers."""
    out = {}
    number = lambda w: w[0].isdigit()
    for item, text in bench:
        a = text.split()
        every = [p for p in range(len(a) - n + 1)]
        typed = [p for p in every if sum(not number(w) for w in a[p : p + n]) >= 5]
        for doc, body in docs:
            b, found, found_typed, best = body.split(), set(), set(), 0
            for d in range(-len(a), len(b)):
                meets = lambda p: 0 <= p + d and p + d + n <= len(b)  # noqa: B023, E731
                alike = [p for p in typed if meets(p) and all(x == y or (number(x) and number(y)) for x, y in zip(a[p : p + n], b[p + d : p + d + n]))]
                pairs = Counter((a[p + k], b[p + d + k]) for p in alike for k in range(n) if number(a[p + k]))
                stands, back = {}, {}
                for (x, y), c in pairs.items():
                    stands[x] = max(stands.get(x, (0, False, "")), (c, x == y, y))
                    back[y] = max(back.get(y, (0, False, "")), (c, x == y, x))
                fits = [p for p in alike if all(a[p + k] == b[p + d + k] for k in range(n)) or all(stands[a[p + k]][2] == b[p + d + k] and back[b[p + d + k]][2] == a[p + k] for k in range(n) if number(a[p + k]))]
                exact = [p for p in every if meets(p) and a[p : p + n] == b[p + d : p + d + n]]
                here = sorted(set(fits) | set(exact))
                found |= set(here)
                found_typed |= set(here) & set(typed)
                run = 0
                for i, p in enumerate(here):
                    run = run + 1 if i and p == here[i - 1] + 1 else 1
                    best = max(best, run + n - 1)
            coverage = max(len(found) / len(every), len(found_typed) / len(typed) if typed else 0)
            if coverage >= 0.5 or best >= 13:
                out[doc, item] = (round(coverage, 4), best)
    return out


def test_leaks_by_brute_force(spark):
    rng, bench, docs = np.random.default_rng(31), [], []
    for i in range(12):
        words = prose(24, 4000 + i).split()
        for at in rng.choice(24, 5, replace=False):
            words[at] = str(rng.integers(2, 9))
        bench.append((i, " ".join(words)))
    for k in range(60):
        words = bench[k % 12][1].split()
        new = {str(v): str(rng.integers(20, 25)) for v in range(2, 9)}
        words = [new.get(w, w) if k % 3 else w for w in words]
        for at in rng.choice(24, k % 4, replace=False):
            words[at] = rng.choice(WORDS) if rng.random() < 0.5 else "77"
        docs.append((k, " ".join([*prose(10, k).split(), *words[k % 5 :], *prose(6, 900 + k).split()])))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.coverage, r.run) for r in got} == leaks_by_brute_force(docs, bench)


def test_languages_held_out_and_odd(spark, odd, none):
    de, en = [w + "ung" for w in WORDS], [w + "ing" for w in WORDS]
    rows = [(i, " ".join(np.random.default_rng(i).choice(de if i % 2 else en, 30)), "de" if i % 2 else "en") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs.where("doc_id < 150"))
    got = {r.doc_id: r for r in language_id.predict(docs.where("doc_id >= 150"), model).collect()}
    assert all(got[i].lang_pred == lang and 0.5 < got[i].score <= 1 for i, _, lang in rows[150:])
    assert model.score("qqqung")[0] == "de" and model.score("1 2 !") == ("und", 0.0) == model.score(None)
    assert len(language_id.predict(odd, model).collect()) == 10
    assert language_id.predict(odd, language_id.fit(none)).where("lang_pred <> 'und'").count() == 0


def test_words_are_letters_only(spark):
    model = language_id.Model(["eins zwei", "one two"], ["de", "en"])
    assert [model.score(t)[0] for t in ("½ ² ① Ⅷ 12", "", None, "zwei²", "１")] == ["und", "und", "und", "de", "und"]
    assert language_id.words_of("Ab½cd_e 1f") == ["ab", "cd", "e", "f"]


def test_backoff_scores_by_brute_force():
    texts, langs = ["baba dada baba", "dada fufu", "xoxo fufu xo"], ["a", "a", "b"]
    model = language_id.Model(texts, langs, longest=3)
    words = {lang: Counter(w for t, x in zip(texts, langs) if x == lang for w in t.split()) for lang in "ab"}
    grams = {k: {lang: Counter(f"^{w}$"[i : i + k] for w, n in c.items() for _ in range(n) for i in range(len(w) + 3 - k)) for lang, c in words.items()} for k in (1, 2, 3)}

    def rate(table, x):
        size = len(set(table["a"]) | set(table["b"]))
        return [math.log((table[lang][x] + 0.1) / (sum(table[lang].values()) + 0.1 * size)) for lang in "ab"]

    def brute(text):
        total = np.zeros(2)
        for w in text.split():
            if any(words[lang][w] for lang in "ab"):
                total += rate(words, w)
                continue
            for k in (3, 2, 1):
                own = [f"^{w}$"[i : i + k] for i in range(len(w) + 3 - k)]
                if known := [g for g in own if any(grams[k][lang][g] for lang in "ab")]:
                    total += np.mean([rate(grams[k], g) for g in known], axis=0)
                    break
        p = np.exp(total - total.max())
        return "ab"[int(p.argmax())], float(p.max() / p.sum())

    for text in ("baba", "fufu xo", "babu", "zzz", "dad xox fu", "xoxo dada q"):
        got, want = model.score(text), brute(text)
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-5


def test_one_text_of_many_rows_counts_once(spark):
    rows = [(i, "eins zwei drei", "de") for i in range(300)] + [(1000 + i, prose(20, i), "en") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.langs == ["de", "en"] and model.score("eins zwei drei")[0] == "de" and model.score(prose(20, 3))[0] == "en"
    many = spark.createDataFrame([(i, f"wort{chr(97 + i % 26)}{chr(97 + i // 26)} " * 3, f"l{i}") for i in range(300)], "doc_id long, text string, lang string")
    assert len(language_id.fit(many).langs) == 300


def test_posteriors_by_brute_force():
    rng = np.random.default_rng(5)
    votes = (rng.random((40, 3)) < 0.3).astype(float)
    model = toxicity.label_model(votes, np.array([0.9, 0.7, 0.8]), 0.2)
    logit = lambda p: math.log(p / (1 - p))
    for v, got in zip(votes, model.posterior(votes), strict=True):
        z = logit(0.2 if v.any() else 0.2 * toxicity.SILENT) + sum(w * (logit(a) - logit(0.2)) for x, w, a in zip(v, model.weight, model.accuracy, strict=True) if x)
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-9


def jaccard_classes(texts, weighted=False):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    df = Counter(s for a in sets for s in a)
    idf = {s: 1 + math.log(1 / max(n / len(texts), 0.001)) / math.log(1000) if weighted else 1 for s, n in df.items()}
    weight = lambda a: sum(n * idf[s] for s, n in a.items())
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both, either = weight(a & b), weight(a | b)
            if (not a and not b) or (either and both / either >= 0.8):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def near_corpus():
    rng, texts = np.random.default_rng(6), []
    for k in range(25):
        base = prose(150, 7000 + k).split()
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(0, 6))):
            copy = list(base)
            for at in rng.choice(150, rng.integers(0, 3), replace=False):
                copy[at] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    return texts


def test_near_classes_by_brute_force(spark, odd, none):
    texts = near_corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    want = jaccard_classes(texts)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    wrong = [(i, j) for i, j in pairs if (got[i] == got[j]) != (want[i] == want[j])]
    assert not wrong
    rows = near_dedup.classes(odd).collect()
    assert len(rows) == 10 and {r.class_id for r in rows if r.doc_id in (7, 8)} == {7} and len({r.class_id for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert near_dedup.classes(none).count() == 0


def test_large_buckets_lose_no_link(spark):
    # One text of which a third of all are copies with few changes, chains of copies of copies, and copies that are just too far from it.
    rng, base, texts = np.random.default_rng(12), prose(120, 9100).split(), []
    for k in range(150):
        copy = list(base)
        for at in rng.choice(120, k % 7, replace=False):
            copy[at] = rng.choice(WORDS)
        texts.append(" ".join(copy))
    texts += [prose(100, 9200 + k) for k in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r.doc_id: (r.class_id, r.class_size) for r in near_dedup.classes(docs).collect()}
    assert {r.doc_id: (r.class_id, r.class_size) for r in near_dedup.classes(docs, held=8, together=4).collect()} == whole
    want = jaccard_classes(texts, weighted=True)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    lost = [(i, j) for i, j in pairs if want[i] == want[j] and whole[i][0] != whole[j][0]]
    assert len(lost) <= 0.1 * sum(want[i] == want[j] for i, j in pairs) and len({c for c, _ in whole.values()}) > 100
    assert not [(i, j) for i, j in pairs if want[i] != want[j] and whole[i][0] == whole[j][0]]


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(2)
    k, pool = 3000, rng.integers(1, 2**62, 400, dtype=np.int64).view(np.uint64)
    a, b = np.sort(pool[:300]), np.sort(pool[60:360])
    w = {int(s): float(x) for s, x in zip(pool, rng.uniform(1, 4, 400), strict=True)}
    wa, wb = ({int(s): w[int(s)] * (1.3 if side and int(s) % 5 == 0 else 1) for s in x} for side, x in ((0, a), (1, b)))
    want = sum(min(wa.get(s, 0), wb.get(s, 0)) for s in wa | wb) / sum(max(wa.get(s, 0), wb.get(s, 0)) for s in wa | wb)
    flat, lw = np.concatenate([a, b]), np.log([*(wa[int(s)] for s in a), *(wb[int(s)] for s in b)]).astype(np.float32)
    one, two = near_dedup.signatures(flat, lw, np.array([0, 300]), k)
    assert abs((one == two).mean() - want) < 4 * math.sqrt(want * (1 - want) / k)


def test_common_shingles_are_counted_exactly(spark):
    texts = [prose(12, i % 40) for i in range(300)] + ["a b c d e f"] * 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    with Rounds(spark, "test") as rounds:
        ids, counts = near_dedup.common_shingles(df, len(texts), rounds, share=0.05)
    want = Counter(h for _, s in near_dedup.shingles_of(pa.array(texts)) for h in set(s.tolist()))
    assert len(set(want)) == len({w for t in texts for w in (tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4)))})
    assert dict(zip(ids.tolist(), counts.tolist(), strict=True)) == {h: n for h, n in want.items() if n >= 0.05 * len(texts)}


def test_shingles_of_a_task_are_merged_in_little_memory():
    random = np.random.default_rng(1)
    often = np.sort(random.integers(0, 2**64, 50, np.uint64))
    tally = near_dedup.Tally(0.01)
    for _ in range(400):
        tally.add(np.union1d(random.integers(0, 2**64, 5000, np.uint64), often))
    held = tally.held * 8
    tracemalloc.start()
    tally.prune()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * held  # merged at once it takes more than five times what is held
    assert (tally.ids == often).all() and (tally.counts == 400).all() and not tally.unseen.any() and tally.lost == 1
    for _ in range(3):
        tally.add(often[:20])
    tally.prune()
    assert (tally.ids == often).all() and (tally.counts[:20] == 403).all() and (tally.counts[20:] == 400).all()


def test_stages_begin_with_heaps_given_back(spark, none):
    import corpus_pipeline as c

    beans = [b for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Young" not in b.getName() and "Concurrent" not in b.getName()]
    for name in ("exact_dedup", "near_dedup", "mixing"):
        before = sum(b.getCollectionCount() for b in beans)
        assert dict(c.STAGES)[name](spark, none, "").count() == 0
        assert sum(b.getCollectionCount() for b in beans) > before, name


def test_urls_by_rule_and_by_rank(spark):
    cases = {
        "http://a.net/x": ("a.net", "/x", "net/", "block"), "https://WWW.Example.NET/en/1?q=/de/": ("www.example.net", "/en/1", "example.net/en/", "allow"), "http://net": ("net", "", None, "allow"),
        "http://b.example.com/de/": ("b.example.com", "/de/", "example.com/de/", "block"), "ftp://x.org/fr/#a": ("x.org", "/fr/", "org/fr/", "allow"), "notexample.com/de/": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "http://badexample.com/de/": ("badexample.com", "/de/", None, "allow"), "x://y://z/": ("y:", "//z/", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(cases)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got == dict(enumerate(cases.values()))
    assert url_filter.judge(pages.limit(0)).count() == 0
    link = lambda *h: "".join(f'<a HREF="https://{x}/p">' for x in h)
    web = [(1, "http://spam.net/1", None), (2, "http://feeder.example.com/en/", link("spam.net", "spam.net", "spam.net")), (3, "http://fine.example.org/en/", link("good.org", "unknown.host")), (4, "http://good.org/fr/", link("fine.example.org"))]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(web, "page_id long, url string, html string")).collect()}
    assert [got[i].verdict for i in (1, 2, 3, 4)] == ["block", "block", "allow", "allow"] and got[2].distrust > 0.4 > got[3].distrust and got[3].trust > 0


def test_hosts_that_are_only_linked_to_count(spark):
    link = lambda *u: "".join(f'<a href="{x}">' for x in u)
    web = [(1, "http://feeder.test/en/", link("https://Spam.NET/a", "//spam.net/a?x=1", "http://spam.net/b#c")), (2, "http://far.test/en/", link("http://hub.test/z")), (3, "http://plain.test/", link("http://nothing.test"))]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(web, "page_id long, url string, html string")).collect()}
    assert len(got) == 3 and [got[i].verdict for i in (1, 2, 3)] == ["block", "allow", "allow"]
    assert got[1].distrust > 0.4 and got[2].distrust == got[3].distrust == 0
    # An allow rule on the linked path, and trust through a host without pages.
    web = [(1, "http://x.org/fr/", link("http://hub.test/1")), (2, "http://one.test/", link("http://kind.org/fr/q")), (3, "http://hub.test.sub/", None), (4, "http://a.hub.test/", None)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(web, "page_id long, url string, html string")).collect()}
    assert got[4].trust > 0 == got[3].trust
    links = url_filter.host_links(url_filter.with_host(spark.createDataFrame(web, "page_id long, url string, html string")).select("host", "html"))
    assert {(r.src, r.dst, r.path, r.n) for r in links.collect()} == {("x.org", "hub.test", "/1", 1), ("one.test", "kind.org", "/fr/q", 1)}


def test_ranks_by_power_iteration(spark):
    names = list("abcd")
    w = np.array([[1, 2, 0, 0], [0, 1, 1, 0], [3, 0, 1, 1], [0, 0, 0, 1]], float)
    edges = spark.createDataFrame([(names[i], names[j], float(w[i, j])) for i in range(4) for j in range(4) if w[i, j]], "src string, dst string, weight double")
    pages, good, bad = np.array([4, 1, 2, 1]), np.array([2, 0, 0, 0]), np.array([0, 0, 1, 1])
    seeds = spark.createDataFrame([(n, *map(int, x)) for n, *x in zip(names, pages, good, bad, strict=True)], "host string, pages long, trusted long, blocked long")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(edges, seeds).collect()}

    def share(m, own):
        m = m / m.sum(axis=1, keepdims=True)
        a, s = pages / 8, own / 8
        for _ in range(url_filter.STEPS):
            a, s = 0.15 * pages / 8 + 0.85 * a @ m, 0.15 * own / 8 + 0.85 * s @ m
        return s / a

    assert np.allclose([got[n] for n in names], np.column_stack([share(w, good), share(w.T, bad)]))


def test_mix_is_what_the_sequence_gives(spark, odd, none, monkeypatch):
    rows = [(i, prose(1 + i % 90, i), ["a", "b", "c", None][min(i % 7, 3)]) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, block=16).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.taken <= 2 * r.size and r.source_size == sum(len(t.split()) for _, t, s in rows if s == r.source)
    total = sum(r.size for r in got)
    assert all(abs(sum(r.taken for r in v) - v[0].target) <= 3 * 16 for v in by.values())
    assert abs(sum(v[0].target for v in by.values()) - 1.5 * total) < 1e-6 * total and all(v[0].target <= 2 * v[0].source_size + 1e-9 for v in by.values())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7), block=16).collect()))
    # The sequence itself: the same words, every block whole, and sources in low discrepancy along it.
    runs = mixing.sequence(docs, block=16).collect()
    taken, slots = Counter(), Counter()
    for r in runs:
        taken[r.doc_id] += r.last - r.first
        slots[r.slot] += r.last - r.first
        assert 0 <= r.first < r.last <= 1 + r.doc_id % 90
    assert taken == {r.doc_id: r.taken for r in got if r.taken} and max(slots.values()) == 16 and sum(n < 16 for n in slots.values()) <= 8
    of = {r.slot: r.source for r in runs}
    for n in (50, 200, 900):
        for s, v in by.items():
            assert abs(sum(x == s for k, x in of.items() if k < n) - n * v[0].target / sum(x[0].target for x in by.values())) < 5
    monkeypatch.setattr(mixing, "GOLDEN", 0.0)
    assert sorted(map(str, got)) != sorted(map(str, mixing.mix(docs, block=16).collect()))
    monkeypatch.undo()
    assert len(mixing.mix(odd).collect()) == 10 and mixing.mix(none).count() == 0 == mixing.sequence(none).count()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pipeline_runs_and_its_stages_hold(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for i, (_, stage) in enumerate(c.STAGES):
        path = new_path(spark, f"test-stage-{i}")
        stage(spark, docs, sf).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if i < 4:
            assert docs.columns == names and docs.count() <= before.count()
        if i == 1:
            texts = [" ".join(re.split(r"[\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()]
            assert len(texts) == len(set(texts))
        if i == 2:
            kept = {r.doc_id for r in docs.collect()}
            rows = sorted((r.doc_id, r.text) for r in before.collect())
            roots = jaccard_classes([t for _, t in rows])
            first = {}
            for (d, _), k in zip(rows, roots, strict=True):
                first.setdefault(k, d)
            assert kept == set(first.values())
    assert docs.count() == before.count()


def test_chat_and_urls_on_odd_tables(spark):
    turns = "conv_id long, turn long, role string, text string, turns string, _n int, _key string"
    long = "x" * 200_000
    rows = [(1, 0, "user", "q", "t", 1, "k"), (1, 1, "assistant", long, "t", 1, "k"), (1, 1, "assistant", long, "t", 1, "k"), (1, 2, "assistant", "b", None, 1, "k"), (2, 0, "user", "", "t", 1, "k")]
    form = lambda df: chat_format.format_preferences(chat_format.echo_pairs(chat_format.conversations(df)))
    got = {r.conv_id: r for r in form(spark.createDataFrame(rows, turns)).collect()}
    assert got[1].prompt_turns == 2 and long in got[1].prompt and got[1].chosen == "<|assistant|>\nb<|end|>\n" and got[1].rejected.count("x") == 200_000 and got[2].prompt_turns == 1
    assert form(spark.createDataFrame([], turns)).count() == 0
    pages = "page_id long, url string, html string, host string, path string, rule string, src string, verdict string"
    rest = ("h", "p", "r", "s", "v")
    rows = [(1, "http://a.net/" + "y" * 100_000, None, *rest), (1, "http://a.net/" + "y" * 100_000, None, *rest), (None, "http://b.org/fr/", "", *rest), (3, "", "<a href=", *rest)]
    got = url_filter.judge(spark.createDataFrame(rows, pages)).collect()
    assert sorted((r.page_id or 0, r.host, r.rule or "", r.verdict) for r in got) == [(0, "b.org", "org/fr/", "allow"), (1, "a.net", "net/", "block"), (1, "a.net", "net/", "block"), (3, "", "", "allow")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_stages_on_odd_rows(spark, odd, none):
    import corpus_pipeline as c

    clash = {"digest": "_key", "key": "text_key", "size": "row", "n": "at0"}
    rows, empty = odd.withColumnsRenamed(clash), none.withColumnsRenamed(clash)
    sf = "/root/testdata/sf0.001"
    kept = {}
    for name, stage in c.STAGES[:-1]:
        got = stage(spark, rows, sf)
        assert got.columns == rows.columns and stage(spark, empty, sf).count() == 0
        kept[name] = got.collect()
        assert all((r._key, r.text_key, r.row, r.at0) == (0, "k", 1, 2) for r in kept[name])
    ids = {k: sorted(r.doc_id or 0 for r in v) for k, v in kept.items()}
    assert not {1, 2, 3} & set(ids["quality"]) and ids["exact_dedup"] == [0, 1, 3, 4, 7, 8, 9] and ids["near_dedup"] == [0, 1, 4, 7, 9] and ids["decontaminate"] == [0, 1, 2, 3, 4, 5, 5, 7, 8, 9]
    assert c.STAGES[-1][1](spark, rows, sf).count() == 10 and c.STAGES[-1][1](spark, empty, sf).count() == 0
