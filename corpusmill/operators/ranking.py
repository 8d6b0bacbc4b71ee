"""Ranking, selection and sessionisation over windows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import checkpointed


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order (A22, R12). Keeps whole rows, so a window; one shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Rank 1..k in each group (W1, T1). Spark cuts each task's rows to k a group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def merge_intervals(df: DataFrame, group: Sequence[str], start: str, end: str, gap: int, pad: int = 0) -> DataFrame:
    """Joins intervals less than ``gap`` apart, then pads both sides (W4): a break is where a start lies beyond all earlier ends."""
    w = Window.partitionBy(*group).orderBy(start, end)
    earlier = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__break", F.when(earlier.isNull() | (F.col(start) - earlier >= gap), 1).otherwise(0))
    islands = marked.withColumn("__island", F.sum("__break").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*group, "__island").agg((F.greatest(F.min(start) - pad, F.lit(0))).alias(start), (F.max(end) + pad).alias(end)).drop("__island")


def fair_pick(df: DataFrame, query: str, doc: str, score: str, tie: str, budget: int) -> DataFrame:
    """The best hit of each document first, documents by best score, then the rest by rank, up to a budget."""
    by_doc = Window.partitionBy(query, doc).orderBy(F.desc(score), tie)
    ranked = df.withColumn("__in_doc", F.row_number().over(by_doc))
    picked = ranked.withColumn("__pick", F.row_number().over(Window.partitionBy(query).orderBy(F.when(F.col("__in_doc") == 1, 0).otherwise(1), F.desc(score), tie)))
    return picked.where(F.col("__pick") <= budget).drop("__in_doc", "__pick")


def provenance_winners(df: DataFrame, field: str, precedence: str, confidence: str, order: str) -> DataFrame:
    """The winner of each field by (precedence, confidence, order)."""
    return first_per_key(df, [field], [F.col(precedence), F.desc(confidence), F.col(order)])


#: Openings that say nothing of a conversation, and the mark of an upload.
CHITCHAT = ("hi", "hii", "hiii", "hiiii", "hello", "hallo", "hey", "heya", "yo", "sup", "ok", "okay", "okk", "okkk", "test", "testing", "check", "checking", "thanks", "thank you", "danke", "?", "??", "???")
UPLOAD = "📎"


def display_titles(sessions: DataFrame, messages: DataFrame, key: str, *, order: str = "turn") -> DataFrame:
    """sessions (.., title, filename), messages (.., role, text) -> sessions with ``display``.

    A title that was given; else the beginning of the first message of a user that says something: not an upload, not
    small talk, twelve characters at least; else the file's name; else that of the first message; else Untitled chat.
    One aggregation with two minima.
    """
    said, user = F.trim("text"), F.col("role") == "user"
    real = user & (said != "") & (F.substring(said, 1, 1) != UPLOAD) & (F.length(said) >= 12) & ~F.lower(said).isin(*CHITCHAT)
    first = lambda test: F.min_by(F.when(test, F.substring("text", 1, 80)), F.when(test, F.col(order)))
    found = messages.groupBy(F.col(key).alias("__key")).agg(first(real).alias("__good"), first(user).alias("__any"))
    given = lambda c: F.when(F.trim(c) != "", F.trim(c))
    display = F.coalesce(given("title"), "__good", given("filename"), "__any", F.lit("Untitled chat"))
    return sessions.join(found, F.col(key) == F.col("__key"), "left").select(*sessions.columns, display.alias("display"))


def placed(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """df with ``place``, each row's number in its group by an order, from 1.

    Rows are sorted in ranges of group and order together, so a group of any size lies in many; each range counts on
    from where the ones before end. Ranges lie side by side, so at most one group of a range began in an earlier one:
    what is broadcast has no more rows than there are ranges. Ties are numbered in any order.
    """
    ranges = checkpointed(df.repartitionByRange(*group, *order).withColumn("__range", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("__range", *group).orderBy(*order))
    sizes = ranges.groupBy("__range", *group).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    begun = sizes.withColumn("__before", F.sum("__n").over(earlier)).where("__before > 0").drop("__n").withColumnsRenamed({c: f"__{k}" for k, c in enumerate(["__range", *group])})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{k}")) for k, c in enumerate(["__range", *group])])
    met = ranges.withColumn("__place", inside).join(F.broadcast(begun), same, "left")
    return met.withColumn("place", F.col("__place") + F.coalesce("__before", F.lit(0))).select(*df.columns, "place")
