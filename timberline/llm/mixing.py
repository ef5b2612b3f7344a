"""Mixing sources to target weights by a low-discrepancy schedule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.llm.common import WORD, Rounds, grouped_prefix, null_safe_join

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Words of a block. A source gets its share of blocks up to two or so, so this is how near it comes to its target.
BLOCK = 32
#: Buckets of the documents' shuffled order; a source's rows are only sorted within a bucket.
BUCKETS = 4096
#: Slots of the schedule in a run whose ranks are counted together, and cells of the unit interval.
RUN = 65_536
CELLS = 4096
#: Tables of one row per source are broadcast up to this many; beyond it they are shuffled.
BROADCAST_SOURCES = 100_000
GOLDEN = 0.6180339887498949


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> + weight, target.

    The sources in order of code point, null last, get the weights in turn; `share` times all sizes is dealt by
    weight, a target stops at `most` times its source's size, and the excess is dealt again until none is above. The fixed point of that is
    min(cap, level * weight) for one level: in order of cap / weight, the first so many sources are at their caps. It runs over
    one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ws = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.element_at(ws, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(
        "*", F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("_full"), F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("_used"),
        (F.lit(share) * F.sum("source_size").over(everything)).alias("_all"), F.sum("weight").over(everything).alias("_weights"),
    )
    # The level if exactly the sources before this one are at their caps: it rises up to the first cap that it does not pass, then falls.
    level = (F.col("_all") - F.col("_full")) / (F.col("_weights") - F.col("_used"))
    rows = rows.withColumn("_level", F.when(level * F.col("weight") <= F.col("cap"), level))
    rows = rows.withColumn("_level", F.max("_level").over(everything))
    return rows.select("source", "source_size", "weight", F.coalesce(F.least("cap", F.col("_level") * F.col("weight")), F.col("cap")).alias("target"))


def schedule(plan: DataFrame, most: float = MOST) -> DataFrame:
    """slot, source, rank, round, block: the mix as a sequence of blocks.

    Slot i of the golden-ratio sequence lies at frac((i + 1) * golden), which the cumulative needs map to a source; so after any number of
    slots each source has its share of them up to a few. The slots of a source are ranked in order, and take its blocks in turn, round after round.
    `plan` has source, need and blocks (to take, and that it has); there are as many slots as blocks needed. Slots past `most` rounds of a source stay empty.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    line = plan.where("need > 0").withColumn("_total", F.sum("need").over(everything))
    line = line.withColumn("hi", F.sum("need").over(by_name.rowsBetween(Window.unboundedPreceding, 0)) / F.col("_total"))
    line = line.withColumn("lo", F.coalesce(F.lag("hi").over(by_name), F.lit(0.0)))
    cells = line.select("source", "blocks", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    slots = plan.agg(F.coalesce(F.sum("need"), F.lit(0)).cast("long")).first()[0]
    points = plan.sparkSession.range(slots).select(F.col("id").alias("slot"), F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1.0)).alias("u"))
    points = points.withColumn("cell", F.least(F.floor(F.col("u") * CELLS), F.lit(CELLS - 1)))
    dealt = points.join(cells, "cell").where("lo <= u AND u < hi").select("source", "blocks", "slot", F.floor(F.col("slot") / RUN).alias("run"), F.lit(1).cast("long").alias("one"))
    ranked = grouped_prefix(dealt, ["source"], "run", [F.col("slot")], "one", "rank").where(F.col("rank") < F.floor(F.col("blocks") * most))
    return ranked.select("slot", "source", "rank", F.expr("rank div blocks").alias("round"), F.expr("rank % blocks").alias("block"))


def _laid(docs: DataFrame, block: int, weights: Sequence[float], share: float, most: float, table) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents on their sources' lines (doc_id, source, size, start); the words of each in each block (source, start, doc_id, block, lo, hi: counted from the block's start);
    and the sources' plan."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), F.xxhash64("text").alias("_text"))
    rows = rows.withColumn("_order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    rows = table(rows.withColumn("_bucket", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int")), "sizes")
    plan = targets(rows.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size")), weights, share, most)
    take = F.round("target").cast("bigint")
    blocks = F.ceil(F.col("source_size") / block)
    need = F.when(F.col("source_size") > 0, F.expr("_take div source_size") * F.col("blocks") + F.ceil((F.col("_take") % F.col("source_size")) / block)).otherwise(F.lit(0))
    plan = table(plan.withColumn("_take", take).withColumn("blocks", blocks).withColumn("need", need.cast("bigint")).drop("_take"), "plan")
    laid = grouped_prefix(rows, ["source"], "_bucket", [F.col("_order"), F.col("doc_id"), F.col("size"), F.col("_text")], "size", "start")
    laid = table(laid.select("doc_id", "source", "size", "start"), "line")
    parts = laid.where("size > 0").select("source", "start", "size", "doc_id", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    lo = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    hi = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    return laid, parts.select("source", "start", "doc_id", "block", lo.alias("lo"), hi.alias("hi")), plan


def sequence(docs: DataFrame, block: int = BLOCK, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: slot, source, doc_id, first, last for each run of words of a document in each scheduled block; words are counted from 0 and `last` is left out."""
    with Rounds(docs.sparkSession, "mix-sequence") as rounds:
        _, parts, plan = _laid(docs, block, weights, share, most, rounds.table)
        first = F.col("block") * block + F.col("lo") - F.col("start")
        rows = null_safe_join(parts, schedule(plan, most).select("slot", "source", "block"), ["source", "block"])
        return rounds.result(rows.select("slot", "source", "doc_id", first.alias("first"), (first + F.col("hi") - F.col("lo")).alias("last")))


def mix(docs: DataFrame, block: int = BLOCK, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source): doc_id, source, size, source_size, target, taken: the words of it in all blocks of `schedule`.

    A source's documents are put in an order shuffled by a digest of doc_id and laid end to end; the line is cut into blocks of `block`
    words, of which the last may be shorter. The mix is the blocks that `schedule` gives the slots of the sequence, so a source's words come
    to its target up to two blocks or so, and no document is taken more than `most` times (rounded up to whole rounds). Size is the number of runs of
    characters other than white space; null is empty. Empty texts take nothing; null sources form a source of their own, the last; rows that
    are the same in doc_id and text are rows of their own. An empty table gives no rows; further columns are not looked at.
    """
    with Rounds(docs.sparkSession, "mix") as rounds:
        laid, parts, plan = _laid(docs, block, weights, share, most, rounds.table)
        uses = schedule(plan, most).groupBy("source", "block").agg(F.count(F.lit(1)).alias("uses"))
        taken = null_safe_join(parts, uses, ["source", "block"]).groupBy("source", "start").agg(F.sum(F.col("uses") * (F.col("hi") - F.col("lo"))).alias("taken"))
        out = laid.withColumn("_key", F.when(F.col("size") > 0, F.col("start")))
        out = null_safe_join(out, taken.withColumnRenamed("start", "_key"), ["source", "_key"], "left")
        facts = plan.select("source", "source_size", "target")
        out = null_safe_join(out, F.broadcast(facts) if facts.count() <= BROADCAST_SOURCES else facts, ["source"])
        return rounds.result(out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")))
