"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it as
context, and only that reply under the loss mask.  Turns after the last reply
(or a conversation without one) make a last example with an empty mask and
trainable false, so that the output holds every turn and a trainer can leave such
rows out.  A turn is written <turn>role<text>text</turn> and a
line end; inside, a backslash is written \\b and < is written \\l, so that no text
can hold a control string.  All of it is built-in expressions on one row for each
conversation; the examples are exploded from there without another shuffle.

Defined results: a null text or role is empty; turns with one number are ordered
by role and text, null turns come first; a null conversation id is one
conversation; repeated rows are turns of their own; a conversation of any length
is one row, and its examples repeat its turns; an empty table gives no examples;
other columns play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLY = "assistant"


def escaped(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def chat_examples(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each example: conv_id, n (its number of turns), formatted, loss_start and loss_length (code points of the
    trainable reply in formatted; a length of 0 and a start of -1 without one), and trainable (whether there is one)."""
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    talks = rows.groupBy(F.col(f"`{conv_col}`").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit("<turn>"), escaped(t["role"]), F.lit("<text>"))
    written = F.transform("turns", lambda t: F.concat(head(t), escaped(t["text"]), F.lit("</turn>\n")))
    sizes = F.transform("turns", lambda t: F.struct(F.length(head(t)).alias("head"), F.length(escaped(t["text"])).alias("text"), (t["role"] == REPLY).alias("reply")))
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("sizes", i)["reply"] | (i == F.size("turns")))
    out = talks.withColumn("written", written).withColumn("sizes", sizes).withColumn("n", F.explode(ends))
    last = F.element_at("sizes", F.col("n"))
    before = F.coalesce(F.length(F.array_join(F.slice("written", F.lit(1), F.col("n") - 1), "")), F.lit(0))
    return out.select(
        "conv_id",
        F.col("n").cast("long").alias("n"),
        F.array_join(F.slice("written", F.lit(1), F.col("n")), "").alias("formatted"),
        F.when(last["reply"], before + last["head"]).otherwise(-1).cast("long").alias("loss_start"),
        F.when(last["reply"], last["text"]).otherwise(0).cast("long").alias("loss_length"),
        last["reply"].alias("trainable"),
    )


def parsed(formatted: Column) -> Column:
    """The turns of a formatted example, as array of (role, text)."""
    turns = F.filter(F.split(formatted, "</turn>\n"), lambda t: t != "")
    return F.transform(turns, lambda t: F.struct(unescaped(F.substring_index(F.substring(t, 7, 1 << 30), "<text>", 1)).alias("role"), unescaped(F.substring_index(t, "<text>", -1)).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    loss = unescaped(F.expr("substring(formatted, cast(loss_start + 1 as int), cast(loss_length as int))"))
    one = F.struct("n", F.when(F.col("loss_start") >= 0, loss).otherwise("").alias("loss"))
    per = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "n").alias("whole"),
        F.sort_array(F.collect_list(one)).alias("replies"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    text = F.array_join(F.transform("replies", lambda r: r["loss"]), "")
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return per.withColumn("turns", parsed(F.col("whole"))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length(text).cast("long").alias("loss_chars"),
        F.sha2(text, 256).alias("loss_sha256"),
        "formatted_chars",
    )
