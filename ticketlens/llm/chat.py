"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns up to and
including it are the text, and only its reply is trainable.  Turns that follow
the last reply (and conversations without a reply) end in one more example
without a loss span, so every turn can be read back from the output.

Template: ``<|im_start|>`` role, a newline, text, ``<|im_end|>``, a newline.
Control strings inside texts are escaped reversibly: ``<``, any number of
backslashes and ``|`` get one backslash more, so an escaped text never holds
``<|``.  A newline inside a role is written ``<|nl|>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n")))


def expand_chat(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text", target_role: str = "assistant") -> DataFrame:
    """Examples (conv_id, target, n_turns, formatted, loss_start, loss_chars, is_last).

    ``target`` numbers a conversation's examples from 0; the loss span is in
    code points from 0 within ``formatted`` (loss_start null: no loss).
    ``is_last`` marks the example that holds every turn.

    Defined cases: null role and text count as empty; a null turn orders first
    and equal turns by role, then text; repeated rows are repeated turns; rows
    with a null conversation form one conversation; other columns are ignored.
    Memory: a task holds one conversation's text, and prefixes are cut from it
    one at a time.
    """
    t = turns.select(turns[conv].alias("conv_id"), turns[turn].alias("turn"),
                     F.coalesce(turns[role], F.lit("")).alias("role"), F.coalesce(turns[text], F.lit("")).alias("text"))
    t = t.select("conv_id", F.struct("turn", "role", "text").alias("t"))
    c = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    head = lambda x: F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n"))
    c = c.withColumn("parts", F.transform("ts", lambda x: F.struct(
        (x["role"] == target_role).alias("hit"), F.length(head(x)).alias("head"), F.length(escape(x["text"])).alias("body"),
        F.concat(head(x), escape(x["text"]), F.lit(END), F.lit("\n")).alias("whole"))))
    tail = len(END) + 1
    # spans: running end of each turn, kept for assistant turns and for the last turn
    spans = F.aggregate(
        "parts", F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"),
                          F.array().cast("array<struct<n:int,hit:boolean,start:int,body:int,end:int>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["head"] + x["body"] + tail).alias("at"), (a["n"] + 1).alias("n"),
            F.when(x["hit"] | (a["n"] + 1 == F.size("parts")), F.concat(a["out"], F.array(F.struct(
                (a["n"] + 1).alias("n"), x["hit"].alias("hit"), (a["at"] + x["head"]).alias("start"),
                x["body"].alias("body"), (a["at"] + x["head"] + x["body"] + tail).alias("end")))))
            .otherwise(a["out"]).alias("out")),
        lambda a: a["out"])
    c = c.select("conv_id", F.size("ts").alias("all_turns"),
                 F.array_join(F.transform("parts", lambda x: x["whole"]), "").alias("whole"),
                 spans.alias("spans"))
    e = c.select("conv_id", "all_turns", "whole", F.posexplode("spans").alias("target", "s"))
    return e.select("conv_id", F.col("target").cast("long").alias("target"), F.col("s.n").cast("long").alias("n_turns"),
                    F.substring(F.col("whole"), F.lit(1), F.col("s.end")).alias("formatted"),
                    F.when(F.col("s.hit"), F.col("s.start")).alias("loss_start"),
                    F.when(F.col("s.hit"), F.col("s.body")).alias("loss_chars"),
                    (F.col("s.n") == F.col("all_turns")).alias("is_last"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as array<struct<role, text>>, unescaped."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")
    role = lambda x: F.substring_index(x, "\n", 1)
    return F.transform(parts, lambda x: F.struct(
        unescape_role(role(x)).alias("role"),
        unescape(F.substring(x, F.length(role(x)) + 2, F.length(x) - F.length(role(x)) - 1 - len(END) - 1)).alias("text")))


def read_loss(formatted: Column, start: Column, chars: Column) -> Column:
    """The trainable text of an example, unescaped; null without a loss span."""
    return unescape(F.substring(formatted, start + 1, chars))


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, computed from the formatted texts and their loss spans alone."""
    turns = read_turns(F.col("formatted"))
    joined = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    e = examples.select(
        "conv_id", "target", read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("is_last"), F.size(turns).cast("long")).alias("n"),
        F.when(F.col("is_last"), F.sha2(joined, 256)).alias("sha"))
    g = e.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("target", "loss")))),
                                 lambda x: x["loss"]), "").alias("loss"),
        F.count("loss").alias("n_examples"), F.sum("chars").alias("formatted_chars"))
    return g.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
                    F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")
