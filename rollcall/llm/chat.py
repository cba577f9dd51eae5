"""Chat formatting from event logs, with DataFrame functions only.

``events`` has one row per event: conv_id, seq (order within a conversation), message (place of the message),
kind, role, text. Kinds: ``delta`` adds to a message, ``edit`` replaces what it said, ``regenerate`` empties it and
drops the messages after it that began before. A message begins with its first event, whose role it has.

``fold`` sorts each message's events and keeps what follows its last edit or regeneration: messages are folded
first, each for itself, and only their final texts meet per conversation. An event delivered twice (equal
conversation, sequence, message, kind, role and text) counts once.

Template: a turn is an opening mark, a blank, the escaped text, a blank and a closing mark. Marks: ``<<SYS>>`` and
``<</SYS>>``, ``[INST]`` and ``[/INST]``, ``<s>`` and ``</s>`` for system, user, assistant; ``[ROLE:name]`` and
``[/ROLE]`` for others. Inside texts ``~`` becomes ``~0``, and the first character of a mark ``~1`` or ``~2``, so
that marks in formatted text are the template's alone and texts can be read back exactly.

Defined cases: null text is empty; a null role is the empty role; null conversations are one conversation; a
message without remaining events after a regeneration is empty; events of unknown kind are deltas; an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: marks of the template
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER_OPEN, OTHER_CLOSE = "[ROLE:", "[/ROLE]"
ANGLE = r"<(?=/?s>|</?SYS>>)"
SQUARE = r"\[(?=/?INST\]|ROLE:|/ROLE\])"
TURN = (r"(?s)(<<SYS>>|\[INST\]|<s>|\[ROLE:[^\]]*\]) (.*?) (<</SYS>>|\[/INST\]|</s>|\[/ROLE\])")


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("~"), F.lit("~0"))
    return F.regexp_replace(F.regexp_replace(text, ANGLE, "~1"), SQUARE, "~2")


def unescaped(text: Column) -> Column:
    for code, char in (("~3", "]"), ("~2", "["), ("~1", "<"), ("~0", "~")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def _opening(role: Column) -> Column:
    name = F.replace(escaped(role), F.lit("]"), F.lit("~3"))
    out = F.concat(F.lit(OTHER_OPEN), name, F.lit("]"))
    for r, (mark, _) in MARKS.items():
        out = F.when(role == r, F.lit(mark)).otherwise(out)
    return out


def _closing(role: Column) -> Column:
    out = F.lit(OTHER_CLOSE)
    for r, (_, mark) in MARKS.items():
        out = F.when(role == r, F.lit(mark)).otherwise(out)
    return out


def fold(events: DataFrame) -> DataFrame:
    """conv_id, message, role, text of every message that remains, from the event log."""
    log = events.select("conv_id", F.col("seq").cast("bigint").alias("seq"), F.col("message").cast("bigint").alias("message"),
                        F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    each = F.sort_array(F.array_distinct(F.collect_list(F.struct("seq", "kind", "text", "role"))))
    cut = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq")))
    again = F.max(F.when(F.col("kind") == "regenerate", F.col("seq")))
    per = log.groupBy("conv_id", "message").agg(each.alias("e"), cut.alias("cut"), again.alias("again"))
    live = F.filter("e", lambda x: (F.col("cut").isNull() | (x["seq"] >= F.col("cut"))) & (x["kind"] != "regenerate"))
    said = per.select("conv_id", "message", F.col("e")[0]["role"].alias("role"), F.col("e")[0]["seq"].alias("began"),
                      F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text"), "again")
    # a regeneration drops later messages begun before it
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    return (said.withColumn("reset", F.max("again").over(earlier))
            .where(F.col("reset").isNull() | (F.col("began") > F.col("reset"))).select("conv_id", "message", "role", "text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss: formatted text of each conversation and the assistant texts' (start, length) in it."""
    piece = messages.select("conv_id", "message", "role", escaped(F.col("text")).alias("body"),
                            _opening(F.col("role")).alias("open"), _closing(F.col("role")).alias("close"))
    turns = piece.withColumn("turn", F.concat_ws(" ", "open", "body", "close"))
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("at", F.coalesce(F.sum(F.length("turn")).over(earlier), F.lit(0)))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("at") + F.length("open") + 1).cast("int").alias("start"),
                                                         F.length("body").alias("length")))
    per = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message", "turn"))).alias("t"),
                                        F.sort_array(F.collect_list(span)).alias("loss"))
    return per.select("conv_id", F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"), "loss")


def parse(formatted: Column) -> Column:
    """Array of (role, text) read back from formatted text."""
    opens, bodies = F.regexp_extract_all(formatted, F.lit(TURN), 1), F.regexp_extract_all(formatted, F.lit(TURN), 2)

    def role(mark):
        out = unescaped(F.regexp_extract(mark, r"(?s)^\[ROLE:(.*)\]$", 1))
        for r, (m, _) in MARKS.items():
            out = F.when(mark == m, F.lit(r)).otherwise(out)
        return out
    return F.zip_with(opens, bodies, lambda m, b: F.struct(role(m).alias("role"), unescaped(b).alias("text")))


def learned(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, read from the formatted text and unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["length"]))), "")
