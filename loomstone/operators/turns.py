"""Conversation and state tables: pairs, windows, latest rows, expiry, traces.

Messages are (conv_id, turn, role, text) with a long ``turn``. A conversation
may be of any length, so ordered logic runs in segments of turns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.plans.ordered import Mark, history, position_bucket, scan, top_rows

# Window and history sizes, role names, life of a state row.
WINDOW_TURNS, HISTORY_TURNS, HISTORY_CHARS = 3, 4, 300
MAX_MESSAGES, TTL_DAYS, RECENT_LOGS = 40, 7, 5
ROLE_NAMES = {"user": "사용자", "assistant": "어시스턴트"}


def turn_pairs(messages: DataFrame) -> DataFrame:
    """User messages with the message right after them: (conv_id, turn, text, reply_turn, reply_role, reply_text).

    A pair uses up both messages, so in a row of user messages every second
    one starts a pair.
    """
    m = scan(
        messages, ["conv_id"], ["turn"], position_bucket("turn"),
        sums={"_n": F.lit(1).cast("long")},
        marks={"_other": Mark("_n", F.col("role") != "user")},
        nexts={"reply_turn": "turn", "reply_role": "role", "reply_text": "text"},
    )
    in_run = F.col("_n") - F.coalesce("_other", F.lit(0)) - 1
    starts = (F.col("role") == "user") & (in_run % 2 == 0) & F.col("reply_turn").isNotNull()
    return m.filter(starts).select("conv_id", "turn", "text", "reply_turn", "reply_role", "reply_text")


def last_exchange(messages: DataFrame) -> DataFrame:
    """Latest assistant message and the user message before it: (conv_id, user_turn, user_text, reply_turn, reply_text)."""
    said = messages.filter(F.coalesce("text", F.lit("")) != "")
    replies = said.filter("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("reply_turn"), F.max_by("text", "turn").alias("reply_text"))
    asked = said.filter("role = 'user'").join(replies, "conv_id").filter(F.col("turn") < F.col("reply_turn"))
    return asked.groupBy("conv_id", "reply_turn", "reply_text").agg(F.max("turn").alias("user_turn"), F.max_by("text", "turn").alias("user_text"))


def window_text(messages: DataFrame, turns: int = WINDOW_TURNS) -> DataFrame:
    """Each user message with up to ``turns`` user messages before it: (conv_id, turn, text, recent, window)."""
    m = messages.filter("role = 'user'").select("conv_id", "turn", "text")
    m = history(m, ["conv_id"], ["turn"], position_bucket("turn"), "text", turns, "_before")
    return m.select("conv_id", "turn", "text", F.size("_before").alias("recent"), F.concat_ws(" ", "_before", "text").alias("window"))


def recent_history(messages: DataFrame, turns: int = HISTORY_TURNS, chars: int = HISTORY_CHARS) -> DataFrame:
    """Last messages of a conversation as labelled lines, blank ones left out: (conv_id, history)."""
    last = top_rows(messages, ["conv_id"], [F.col("turn").desc()], turns).withColumn("text", tx.strip("text"))
    role = F.when(F.col("role") == "user", ROLE_NAMES["user"]).otherwise(ROLE_NAMES["assistant"])
    line = F.when(F.col("text") != "", F.struct("turn", F.concat(role, F.lit(": "), F.left("text", F.lit(chars))).alias("l")))
    packed = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("h"))
    return packed.select("conv_id", F.array_join(F.transform("h", lambda x: x["l"]), "\n").alias("history"))


def trim_messages(messages: DataFrame, n: int = MAX_MESSAGES) -> DataFrame:
    """Last ``n`` messages of each conversation."""
    return top_rows(messages, ["conv_id"], [F.col("turn").desc()], n, "_rank").drop("_rank")


def storage_key(thread: Column, namespace: Column) -> Column:
    return F.when(F.coalesce(namespace, F.lit("")) != "", F.concat(thread.cast("string"), F.lit("::"), namespace)).otherwise(thread.cast("string"))


def latest_per_thread(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The newest row per key; tasks pass on one row per key."""
    rest = [c for c in rows.columns if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return newest.select(key, "r.*")


def expire_ttl(rows: DataFrame, updated: str, as_of: Column, days: int = TTL_DAYS) -> DataFrame:
    """Rows whose life has not ended at ``as_of``, with the time it ends."""
    ends = F.col(updated) + F.make_dt_interval(F.lit(days))
    return rows.withColumn("expires_at", ends).filter(F.col("expires_at") > as_of)


def reset_or_append(steps: DataFrame, key: str, order: str, bucket: Column) -> DataFrame:
    """Trace kept per key of (key, order, items): a null resets it, a list is appended.

    Gives the trace in long form, one row per item with its place, so that a
    trace may have any length: (key, place, item).
    """
    is_reset = F.col("items").isNull()
    size = F.when(is_reset, F.lit(0)).otherwise(F.size("items")).cast("long")
    last = steps.groupBy(key).agg(F.max(F.when(is_reset, F.col(order))).alias("_last"))
    live = scan(steps, [key], [order], bucket, sums={"_end": size}, marks={"_base": Mark("_end", is_reset)}).join(last, key)
    live = live.filter(~is_reset & (F.col("_last").isNull() | (F.col(order) > F.col("_last"))))
    start = F.col("_end") - F.size("items") - F.coalesce("_base", F.lit(0))
    rows = live.select(key, start.alias("_start"), F.posexplode("items").alias("_i", "item"))
    return rows.select(key, (F.col("_start") + F.col("_i")).alias("place"), "item")


def changed_fields(states: DataFrame, key: str, order: str, bucket: Column, fields: Sequence[str], trace: str) -> DataFrame:
    """Per state the fields that differ from the state before, and the new end of its trace array."""
    prevs = {f"_was_{c}": c for c in [*fields, trace]}
    s = scan(states.withColumn("_one", F.lit(1)), [key], [order], bucket, prevs={**prevs, "_had": "_one"})
    first = F.col("_had").isNull()
    names = F.filter(
        F.array(*[F.when(first | ~F.col(c).eqNullSafe(F.col(f"_was_{c}")), F.lit(c)) for c in fields]), lambda x: x.isNotNull()
    )
    done = F.when(first, F.lit(0)).otherwise(F.coalesce(F.size(f"_was_{trace}"), F.lit(0)))
    delta = F.slice(trace, done + 1, F.greatest(F.size(trace) - done, F.lit(0)))
    return s.select(key, order, names.alias("changed"), delta.alias("trace_delta"))


def recent_by_user(logs: DataFrame, user: str, order: Sequence[Column], n: int = RECENT_LOGS) -> DataFrame:
    """Newest ``n`` log rows per user."""
    return top_rows(logs, [user], order, n)
