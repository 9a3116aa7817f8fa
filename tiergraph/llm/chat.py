"""Chat formatting from an event log, by DataFrame functions alone.

A log row is (conversation, sequence, message, kind, role, text). A message's text is folded from its events in order of
sequence: `message`, `edit` and `regenerate` begin it anew, `delta` adds to it, `delete` takes it away until it begins
anew. Messages stand in the order of their first event.

A message is rendered as `### role: text</turn>` and a line end. In texts and roles `\\`, `<` and `#` become `\\b`, `\\l`
and `\\h` (in roles also `:` becomes `\\c`), so neither a turn's mark nor its end can stand in a text, and each escape is
undone by itself. Rows of the output are messages: a conversation is never gathered into a row until its digest asks for
its whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
RESETS = ("message", "edit", "regenerate", "delete")
#: The assistant's texts are learned from; the loss mask covers them.
LEARNED = "assistant"


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in (("<", "\\l"), ("#", "\\h"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def from_rows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A log in which each row of conversations is a message; rows that share a turn are messages in order of role and text."""
    plain = conversations.select(
        conversations[conv_col].alias("conv_id"), conversations[turn_col].alias("turn"), F.coalesce(conversations[role_col], F.lit("")).alias("role"), F.coalesce(conversations[text_col], F.lit("")).alias("text")
    )
    at = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("bigint")
    return plain.select("conv_id", at.alias("seq"), at.alias("message"), F.lit("message").alias("kind"), "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, at, role, text): the final messages; at is the sequence of a message's first event.

    Events of one message that share a sequence are taken in order of kind and text. A message that ends deleted is
    left out; its role is the last that an event names. Null text adds nothing. A delta before any beginning counts.
    """
    order = W.partitionBy("conv_id", "message").orderBy("seq", "kind", "text")
    reset = F.col("kind").isin(*RESETS)
    # beginnings after this event, its own not counted
    later = F.coalesce(F.sum(reset.cast("int")).over(order.rowsBetween(1, W.unboundedFollowing)), F.lit(0))
    live = events.withColumn("live", later == 0)
    parts = F.array_sort(F.collect_list(F.when(F.col("live") & (F.col("kind") != "delete"), F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text")))))
    folded = live.groupBy("conv_id", "message").agg(
        F.min("seq").alias("at"),
        F.max_by(F.col("role"), F.when(F.col("role").isNotNull(), F.struct("seq", "kind"))).alias("role"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
        F.bool_or(F.col("live") & (F.col("kind") == "delete")).alias("gone"),
        F.bool_or(F.col("live") & (F.col("kind") == "delta")).alias("added"),
    )
    return folded.where(~F.col("gone") | F.col("added")).select("conv_id", "message", "at", F.coalesce("role", F.lit("")).alias("role"), "text")


def render(messages: DataFrame, learned: str = LEARNED) -> DataFrame:
    """(conv_id, turn, start, chars, rendered, loss_start, loss_chars): each message as it stands in the output.

    start is the place of the message in its conversation's text, in code points; the loss mask is given within it.
    """
    order = W.partitionBy("conv_id").orderBy("at", "message")
    role = F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c"))
    head = F.concat(F.lit(OPEN), role, F.lit(MIDDLE))
    body = escape(F.col("text"))
    out = messages.select("conv_id", "at", "message", head.alias("head"), body.alias("body"), (F.col("role") == learned).alias("learned"))
    out = out.select(
        "conv_id", "at", "message", F.concat("head", "body", F.lit(CLOSE)).alias("rendered"), F.when(F.col("learned"), F.length("head")).alias("loss_start"), F.when(F.col("learned"), F.length("body")).alias("loss_chars")
    ).withColumn("chars", F.length("rendered").cast("bigint"))
    before = F.coalesce(F.sum("chars").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return out.select("conv_id", (F.row_number().over(order) - 1).alias("turn"), before.alias("start"), "chars", "rendered", "loss_start", "loss_chars")


def parse(rendered: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, loss): read back from the rendered output; loss is what the mask covers, unescaped."""
    middle = F.instr("rendered", MIDDLE)
    role = F.substring(F.col("rendered"), F.lit(len(OPEN) + 1), middle - len(OPEN) - 1)
    role = unescape(F.replace(role, F.lit("\\c"), F.lit(":")))
    body = F.substring(F.col("rendered"), middle + len(MIDDLE), F.length("rendered") - middle - len(MIDDLE) - len(CLOSE) + 1)
    loss = F.substring(F.col("rendered"), F.col("loss_start") + 1, F.col("loss_chars"))
    return rendered.select("conv_id", "turn", "chars", role.alias("role"), unescape(body).alias("text"), unescape(loss).alias("loss"))


def digests(rendered: DataFrame) -> DataFrame:
    """A row per conversation, from its rendered messages. A conversation's digest needs its text in one place."""
    turns = parse(rendered)
    line = F.concat("role", F.lit("\n"), "text", F.lit("\n"))

    def whole(column: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", column.alias("x")))), lambda t: t["x"]), "")

    found = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), whole(line).alias("turns"), whole(F.coalesce("loss", F.lit(""))).alias("loss"), F.sum("chars").alias("formatted_chars"))
    return found.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def chat_format(conversations: DataFrame, **columns) -> DataFrame:
    """Reconstruct, render, write the output and read it back as digests: a row per conversation.

    Null texts and roles count as empty; a null conversation id is a conversation of its own; rows that share a turn,
    or repeat, are each a message. An empty table gives no rows. Other columns aren't read.
    """
    return digests(materialise(render(fold(from_rows(conversations, **columns))), "chat-rendered"))
