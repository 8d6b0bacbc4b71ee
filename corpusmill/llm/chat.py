"""Chat formatting by quotation linking, in DataFrame operations only.

A message's lines are cut into passages: runs of lines of one quote level, that
is, of the number of ``>`` they begin with (blanks between them allowed), parted
by empty lines. A passage is normalised (lower-cased, white space to single
blanks) and hashed. A quoted passage is linked to the message of its conversation
in which it first stood as a passage of its own, or as its whole unquoted text,
if that message is earlier. A message replies to the latest message that its
shallowest linked level quotes; deeper levels quote what that one replied to.

Following replies upwards gives the message that began the thread. Ordered by
(thread, turn), every message follows the one it replies to, and messages without
a link stand in their turn. The quoted lines are taken out of the text, and what
is left is formatted as ``<|role|>`` and the text, in which ``<|`` becomes ``< |`` so
that no text can begin a turn.

Each message is one row: a conversation is never gathered into one value, so one
that holds a third of all rows is as good as any. Originals are reduced to the
first of each (conversation, hash) before the join, so no passage that is quoted
often or said often multiplies rows, and adaptive execution can split the join.
Replies are followed by pointer doubling over the linked messages alone.

Defined results: a null text has no lines, an empty body and no quotes. A null
conversation or turn is kept and never linked. Of rows with one conversation and
turn each is linked by itself; repeated rows get the same result each. Of links of one
level the latest message wins. ``>`` alone is an empty quoted line. An empty table
gives no rows. Texts of any length are cut whole, in time that grows with it; other
columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import checkpointed

#: One or more ``>``, with blanks or tabs before and between.
QUOTE = r"^[ \t]*((?:>[ \t]*)+)"


def level_of(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 1), r"[^>]", ""))


def bare(line: Column) -> Column:
    return F.regexp_replace(line, QUOTE, "")


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\x0B\f\r]+", " "))


def _with(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, as the variable of a transform."""
    return F.transform(F.array(value), use)[0]


def passages(text: Column) -> Column:
    """Array of (level, body) of the passages, in order. Each line is looked at once."""

    def cut(lines: Column) -> Column:
        bares = F.transform(lines, bare)
        # Empty lines are of level -1 and belong to no passage.
        levels = F.transform(lines, lambda line: F.when(F.trim(bare(line)) == "", F.lit(-1)).otherwise(level_of(line)))
        return F.struct(bares.alias("bares"), levels.alias("levels"))

    def joined(x: Column) -> Column:
        levels = x["levels"]
        n = F.size(levels)
        edge = lambda step: F.filter(
            F.transform(levels, lambda level, i: F.when((level >= 0) & ~level.eqNullSafe(F.get(levels, i + step)), i)), lambda i: i.isNotNull()
        )
        return F.when(n == 0, F.array().cast("array<struct<level:int,body:string>>")).otherwise(
            F.zip_with(edge(-1), edge(1), lambda s, e: F.struct(F.get(levels, s).alias("level"), F.array_join(F.slice(x["bares"], s + 1, e - s + 1), "\n").alias("body")))
        )

    return _with(F.split(text, "\n"), lambda lines: _with(cut(lines), joined))


def _escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def unquoted(text: Column) -> Column:
    """The text without quoted lines, runs of empty lines made one."""
    kept = F.filter(F.split(text, "\n"), lambda line: level_of(line) == 0)
    return F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\n\s*\n\s*", "\n\n"))


def link(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, reply_to, thread, n_quotes, n_linked, quote_depth, body, formatted) for each message."""
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = rows.withColumn("body", F.coalesce(unquoted(F.col("text")), F.lit("")))
    named = rows.where("conv_id is not null and turn is not null and text is not null")
    quoting = named.where(F.col("text").rlike("(?m)" + QUOTE))
    # What is quoted: a few passages of the messages that quote at all.
    quotes = checkpointed(
        quoting.select("conv_id", "turn", F.xxhash64("text").alias("form"), F.posexplode(passages(F.col("text"))).alias("k", "p"))
        .select("conv_id", "turn", "form", "k", "p.level", F.md5(normal(F.col("p.body"))).alias("hash"))
        .where("level > 0")
        .distinct()  # repeated rows count once
    )
    links = quotes.limit(0).select("conv_id", "turn", "form", F.lit(0).cast("bigint").alias("n_linked"), F.lit(0).cast("bigint").alias("reply_to"))
    if not quotes.isEmpty():
        own = F.concat(F.transform(F.filter(passages(F.col("text")), lambda p: p["level"] == 0), lambda p: F.md5(normal(p["body"]))), F.array(F.md5(normal(F.col("body")))))
        first = named.join(quotes.select("conv_id").distinct(), "conv_id", "left_semi").where("trim(body) <> ''").select("conv_id", "turn", F.explode(F.array_distinct(own)).alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
        linked = quotes.join(first, ["conv_id", "hash"]).where("original < turn")
        links = linked.groupBy("conv_id", "turn", "form").agg(F.count("*").alias("n_linked"), F.max(F.struct((-F.col("level")).alias("near"), F.col("original").cast("bigint").alias("original")))["original"].alias("reply_to"))
    links = checkpointed(links)
    told = quotes.groupBy("conv_id", "turn", "form").agg(F.count("*").alias("n_quotes"), F.max("level").alias("quote_depth"))
    threads = _threads(links)
    keyed = rows.withColumn("form", F.xxhash64("text"))
    on = ["conv_id", "turn", "form"]
    return (
        keyed.join(told, on, "left").join(links, on, "left").join(threads, on, "left")
        .select(
            "conv_id", "turn", "role", "reply_to", F.coalesce("thread", F.col("turn")).cast("bigint").alias("thread"),
            F.coalesce("n_quotes", F.lit(0)).cast("bigint").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), F.coalesce("quote_depth", F.lit(0)).cast("int").alias("quote_depth"),
            "body", F.concat(F.lit("<|"), _escaped(F.coalesce("role", F.lit(""))), F.lit("|>\n"), _escaped(F.col("body"))).alias("formatted"),
        )
    )


def _threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, form, thread): the turn reached by following replies up. Each round doubles the steps taken."""
    # A turn that several rows share replies, for those who reply to it, where the earliest of its links goes.
    up = links.groupBy("conv_id", "turn").agg(F.min("reply_to").alias("up")).select("conv_id", F.col("turn").alias("at"), "up")
    up = checkpointed(up)
    while True:
        further = up.select("conv_id", F.col("at").alias("up"), F.col("up").alias("next"))
        after = checkpointed(up.join(further, ["conv_id", "up"], "left").select("conv_id", "at", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
        up = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    top = up.select("conv_id", F.col("at").alias("reply_to"), F.col("up").alias("top"))
    return links.join(top, ["conv_id", "reply_to"], "left").select("conv_id", "turn", "form", F.coalesce("top", "reply_to").alias("thread"))
