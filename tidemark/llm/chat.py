"""Relational chat formatting: sort, merge, escape and concatenate turns with Spark expressions only.

A conversation becomes ``<turn>ROLE<says>TEXT</turn>\\n`` for each run of turns of one role, the run's
texts kept apart by ``<next>``. Texts and roles are escaped so that they hold no ``<``: backslash,
``<`` and ``#`` become ``\\b``, ``\\l`` and ``\\h``. A control string can't arise inside a text, and
replacing in the reverse order gives every text back. The loss mask lists, in code points of the
formatted string, where each assistant text stands.

Defined results: null text and null role are empty; turns are sorted by turn, then role, then text
(nulls first), repeated rows stay; a null conv_id is a conversation of its own; an empty table gives no
rows. One conversation becomes one string, so it has to fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

OPEN, SAYS, NEXT, CLOSE = "<turn>", "<says>", "<next>", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
LEARNED_ROLE = "assistant"
CHUNK = 512


def escape(c: Column) -> Column:
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def format_chats(conversations: DataFrame, learned_role: str = LEARNED_ROLE) -> DataFrame:
    """conv_id, formatted, loss_spans (array of start and length in code points)."""
    turns = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    convs = convs.withColumn("n", F.size("turns"))

    def piece(t: Column, i: Column) -> Column:
        role = t["role"]
        first = (i == 0) | (F.get(F.col("turns"), i - 1)["role"] != role)
        last = (i == F.col("n") - 1) | (F.get(F.col("turns"), i + 1)["role"] != role)
        head = F.when(first, F.concat(F.lit(OPEN), escape(role), F.lit(SAYS))).otherwise(F.lit(NEXT))
        return F.struct(head.alias("head"), escape(t["text"]).alias("body"), F.when(last, F.lit(CLOSE)).otherwise(F.lit("")).alias("tail"), (role == learned_role).alias("learned"))

    convs = convs.select("conv_id", F.transform("turns", piece).alias("pieces"))
    zero = F.lit(0).cast("long").alias("at")
    none = F.struct(zero, F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        size = F.length(p["body"]).cast("long")
        span = F.struct(start.alias("start"), size.alias("length"))
        return F.struct((start + size + F.length(p["tail"])).alias("at"), F.when(p["learned"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    # Spans in two levels: inside chunks of CHUNK pieces, then shifted by the lengths of the chunks before, so that no long list is copied at every turn.
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("pieces") - 1) / CHUNK).cast("int")), lambda k: F.slice("pieces", k * CHUNK + 1, F.lit(CHUNK)))
    convs = convs.select("conv_id", F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"), chunks.alias("chunks"))
    convs = convs.select("conv_id", "formatted", F.transform("chunks", lambda c: F.aggregate(c, none, step)).alias("parts"))
    start = F.struct(zero, F.array().cast("array<bigint>").alias("starts"))
    shifts = F.aggregate("parts", start, lambda acc, p: F.struct((acc["at"] + p["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")))["starts"]
    moved = F.zip_with("parts", shifts, lambda p, by: F.transform(p["spans"], lambda s: F.struct((s["start"] + by).alias("start"), s["length"].alias("length"))))
    return convs.select("conv_id", "formatted", F.flatten(moved).alias("loss_spans"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """The inverse: conv_id, turns (array of role and text), loss_text (what the mask covers, unescaped)."""
    runs = F.filter(F.split("formatted", CLOSE), lambda r: r != "")

    def turns_of(run: Column) -> Column:
        parts = F.split(F.substring(run, len(OPEN) + 1, 2**31 - 1), SAYS)
        return F.transform(F.split(parts[1], NEXT), lambda x: F.struct(unescape(parts[0]).alias("role"), unescape(x).alias("text")))

    covered = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(runs, turns_of)).alias("turns"), F.array_join(covered, "").alias("loss_text"))


def written_chats(conversations: DataFrame, path: str | None = None, learned_role: str = LEARNED_ROLE) -> DataFrame:
    """Format, write as Parquet (to ``path`` or the scratch folder) and read the files back."""
    out = format_chats(conversations, learned_role)
    if path is None:
        return Scratch(conversations.sparkSession).put(out, "chats")
    out.write.mode("overwrite").parquet(path)
    return conversations.sparkSession.read.parquet(path)


def digest(formatted: DataFrame) -> DataFrame:
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return parse_chats(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
