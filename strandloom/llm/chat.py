"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

An event log has one row per event: conv_id, seq, msg, kind, role, text. Kinds:

* ``message``    starts message msg, or replaces it as a whole (role and text)
* ``delta``      appends its text to the message (streamed tokens)
* ``edit``       replaces the message's text
* ``regenerate`` clears the message's text, takes its own text as a first delta, and drops the
                 messages that began after msg did and before this event

Events fold by (conv_id, msg), so that a hot conversation spreads over tasks while its deltas are
folded; only finished messages meet in the conversation's row.

Defined cases: a null text is empty; a null role is empty; a null conv_id is one conversation of its
own; null seq sorts first; ties in seq are broken by kind, role and text; repeated rows are repeated
events; a message without a starting event has the role of its first event; an empty log gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    r"""No ``<|`` is left: ``<``, any backslashes and ``|`` get one backslash more. Undone by unescape()."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    r"""Roles stand on a line: a backslash becomes ``\s``, a line end ``\n``, and marks are escaped as in texts."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, msg, first_seq, role, text."""
    e = F.struct(
        F.col("seq"), F.col("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    by_message = events.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list(e)).alias("log"))
    at = lambda kinds: F.coalesce(  # noqa: E731  index of the last event of these kinds
        F.array_max(F.transform("log", lambda x, i: F.when(x["kind"].isin(*kinds), i))), F.lit(0)
    )
    messages = by_message.select(
        "conv_id", "msg", "log", at(["message", "edit", "regenerate"]).alias("from"), at(["message"]).alias("head")
    ).select(
        "conv_id",
        "msg",
        F.col("log")[0]["seq"].alias("first_seq"),
        F.col("log")[F.col("head")]["role"].alias("role"),
        F.array_join(F.transform(F.slice("log", F.col("from") + 1, F.size("log")), lambda x: x["text"]), "").alias("text"),
        F.array_max(F.transform("log", lambda x: F.when(x["kind"] == "regenerate", x["seq"]))).alias("regenerated"),
    )
    # A message falls if an earlier message was regenerated after it began.
    later = W.partitionBy("conv_id").orderBy("first_seq", "msg").rowsBetween(W.unboundedPreceding, -1)
    fell = F.max("regenerated").over(later) > F.col("first_seq")
    return messages.withColumn("fell", F.coalesce(fell, F.lit(False))).filter(~F.col("fell")).drop("fell", "regenerated")


def render(messages: DataFrame) -> DataFrame:
    """Formatted conversations: conv_id, text, loss (spans of assistant texts).

    A span is (turn, start, length): turn counts from 1, start is the offset in code points after that
    turn's start mark, so that masks are read in linear time however long a conversation is.
    """
    role, text = escape_role(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    turns = messages.select("conv_id", "first_seq", "msg", F.col("role").alias("raw_role"), role.alias("role"), text.alias("text"))
    turn = F.struct("first_seq", "msg", F.coalesce("raw_role", F.lit("")).alias("raw_role"), "role", "text")
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    piece = lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))
    span = lambda t, i: F.when(
        t["raw_role"] == "assistant",
        F.struct((i + 1).alias("turn"), (F.length(t["role"]) + 1).alias("start"), F.length(t["text"]).alias("length")),
    )
    return rows.select(
        "conv_id",
        F.array_join(F.transform("turns", piece), "").alias("text"),
        F.filter(F.transform("turns", span), lambda s: s.isNotNull()).alias("loss"),
    )


def parse(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back: conv_id, text, turns (role, text), loss_text."""
    mark = START.replace("|", r"\|")
    cut = formatted.select("conv_id", "text", "loss", F.split("text", mark).alias("pieces"))
    tail = len(END) + 1

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        n = F.length(role)
        return F.struct(
            unescape_role(role).alias("role"),
            unescape(F.substring(p, n + 2, F.length(p) - n - 1 - tail)).alias("text"),
        )

    return cut.select(
        "conv_id",
        "text",
        F.transform(F.slice("pieces", 2, F.size("pieces")), turn).alias("turns"),
        F.array_join(
            F.transform("loss", lambda s: unescape(F.substring(F.col("pieces")[s["turn"]], s["start"] + 1, s["length"]))), ""
        ).alias("loss_text"),
    )


def events_of(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as an event log: each row is one message event, in order of turn."""
    order = W.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return conversations.select(
        "conv_id", F.col("turn").alias("seq"), F.row_number().over(order).alias("msg"), F.lit("message").alias("kind"), "role", "text"
    )
