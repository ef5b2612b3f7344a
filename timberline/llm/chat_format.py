"""Preference formatting of conversations, by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
TURNS = "array<struct<role:string,text:string>>"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, from rows of conv_id, turn, role, text.

    A row that is repeated in all four counts once; different rows at one turn come in order of role, then text; a
    null turn comes first; a null role is `unknown` and a null text empty. Rows with a null conv_id belong to no
    conversation. A conversation is one example and so one value: its rows meet in one row, as in any output that
    holds whole conversations.
    """
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates()
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def echo_pairs(convs: DataFrame) -> DataFrame:
    """Pairs for conversations that have no rejected twin: the rejected one gives the conversation's first assistant reply
    again as its last (an empty one, where the first is the last). Without an assistant turn both are the same."""
    at = F.filter(F.transform("turns", lambda x, i: F.when(x["role"] == "assistant", i)), lambda i: i.isNotNull())
    rows = convs.withColumn("_at", at).withColumn("_last", F.try_element_at("_at", F.lit(-1))).withColumn("_first", F.try_element_at("_at", F.lit(1)))
    again = F.when(F.col("_first") < F.col("_last"), F.try_element_at("turns", F.col("_first") + 1)["text"]).otherwise(F.lit(""))
    rows = rows.withColumn("_again", again)
    worse = F.transform("turns", lambda x, i: F.struct(x["role"].alias("role"), F.when(i == F.col("_last"), F.col("_again")).otherwise(x["text"]).alias("text")))
    return rows.select("conv_id", F.col("turns").alias("chosen"), worse.alias("rejected"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit(HEAD), x["role"], F.lit(MIDDLE), x["text"], F.lit(END))), "")


def _spans(turns: Column) -> Column:
    """Where the trained characters lie in the rendered turns: an assistant's text and end mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        body = acc["at"] + F.length(x["role"]) + F.lit(len(HEAD) + len(MIDDLE))
        stop = body + F.length(x["text"]) + F.lit(len(END))
        span = F.struct(body.cast("int").alias("start"), stop.cast("int").alias("end"))
        return F.struct(stop.cast("int").alias("at"), F.when(x["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans, from pairs of `chosen` and `rejected` turns.

    The longest common prefix of turns (role and text both equal) is rendered once, as the prompt; what follows on either
    side is a completion, with the spans of characters to train on. Equal sides give two empty completions; sides that
    differ from the start an empty prompt; a null side is an empty one. An empty table gives no rows.
    """
    c, r = (F.coalesce(F.col(x), F.array().cast(TURNS)) for x in ("chosen", "rejected"))
    rows = pairs.select(F.col(key).alias("_key"), c.alias("_c"), r.alias("_r"))
    apart = F.array_position(F.zip_with("_c", "_r", lambda x, y: ~x.eqNullSafe(y)), True)
    rows = rows.withColumn("_n", F.when(apart > 0, apart - 1).otherwise(F.size("_c")).cast("int"))
    tail = lambda side: F.slice(side, F.col("_n") + 1, F.size(side))
    rows = rows.select("_key", "_n", F.slice("_c", F.lit(1), F.col("_n")).alias("_p"), tail("_c").alias("_c"), tail("_r").alias("_r"))
    return rows.select(
        F.col("_key").alias(key), F.col("_n").alias("prompt_turns"), _render(F.col("_p")).alias("prompt"), _render(F.col("_c")).alias("chosen"), _render(F.col("_r")).alias("rejected"),
        _spans(F.col("_c")).alias("chosen_spans"), _spans(F.col("_r")).alias("rejected_spans"),
    )
