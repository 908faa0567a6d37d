"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it as context, and only that reply under the loss
mask. Turns after the last reply (or a conversation without any) make one more example with nothing to train on, so
that no turn is lost. The template marks a turn as ``<turn role>``, a new line, the text, ``</turn>``, a new line; in
roles and texts ``&``, ``<`` and ``>`` are written ``&amp;``, ``&lt;`` and ``&gt;``, so that no text can look like a mark,
and reading back gives every text as it was.

An example is one row, so a conversation has to fit one; its examples take space as its length times its replies,
which is what this expansion asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"


def escaped(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescaped(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<"))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def examples(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, example, text, loss_from, loss_to (code points, end exclusive; null: no loss).

    Rows are ordered by turn (null turns first), then role and text. Null roles and texts count as empty; repeated
    rows are turns like any other. Rows with a null conv_id form one conversation. No rows give no examples.
    """
    part = F.concat(F.lit("<turn "), escaped(F.col("role")), F.lit(">\n"), escaped(F.col("text")), F.lit(END))
    turn = F.struct("turn", "role", "text", part.alias("part"), F.length(part).alias("n"), (F.col("role") == "assistant").alias("reply"))
    whole = conversations.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # Number of turns of each example: up to each reply, and all of them if turns are left after the last.
    size = F.size("turns")
    replies = F.filter(F.sequence(F.lit(1), size), lambda i: F.coalesce(F.element_at(F.col("turns"), i)["reply"], F.lit(False)))
    last = F.coalesce(F.element_at(F.col("turns"), -1)["reply"], F.lit(False))
    upto = F.when(last, replies).otherwise(F.concat(replies, F.array(size)))
    each = whole.select("conv_id", "turns", F.posexplode(upto).alias("example", "k"))
    each = each.withColumn("target", F.element_at("turns", F.col("k")))
    text = F.array_join(F.transform(F.slice("turns", 1, F.col("k")), lambda t: t["part"]), "")
    trained = F.coalesce(F.col("target.reply"), F.lit(False))
    each = each.select("conv_id", "example", text.alias("text"), trained.alias("trained"), F.length(escaped(F.col("target.text"))).alias("n"))
    to = F.length("text") - F.lit(len(END))
    return each.select("conv_id", "example", "text", F.when(F.col("trained"), to - F.col("n")).alias("loss_from"), F.when(F.col("trained"), to).alias("loss_to"))


def turns_of(text: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    parts = F.filter(F.split(text, END), lambda p: p != "")
    mark = r"(?s)^<turn ([^>]*)>\n(.*)$"
    return F.transform(parts, lambda p: F.struct(unescaped(F.regexp_extract(p, mark, 1)).alias("role"), unescaped(F.regexp_extract(p, mark, 2)).alias("text")))


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted examples alone.

    conv_id, n_turns, turns_sha256 (role, new line, text, new line of every turn), loss_chars, loss_sha256 (all text
    under the loss masks, in order), formatted_chars (characters of all its examples).
    """
    loss = unescaped(F.substring(F.col("text"), F.col("loss_from") + 1, F.col("loss_to") - F.col("loss_from")))
    gathered = formatted.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("longest"),
        F.sum(F.length("text")).alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", F.coalesce(loss, F.lit("")).alias("loss")))), lambda x: x["loss"]), "").alias("loss"),
    )
    turns = turns_of(F.col("longest"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return gathered.withColumn("turns", turns).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
