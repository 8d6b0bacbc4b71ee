"""Keyed tables as pure functions: insert, upsert, replace, prune, cascade, and the content-hash feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.ranking import placed
from corpusmill.session import checkpointed


def insert_ignore(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new whose key is not there yet; of repeats the first by key order stays (M1)."""
    return new.dropDuplicates([key]).join(existing.select(F.col(key).alias("__key")), F.col(key) == F.col("__key"), "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The newest version of each key (M2). One aggregation, no window: the whole row is carried in the maximum."""
    rest = [c for c in existing.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), version)
    return existing.unionByName(new).groupBy(*keys).agg(newest.alias("__r")).select(*keys, "__r.*").select(*existing.columns)


def replace(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of a key that comes again give way to the new ones (M3)."""
    keys = new.select(F.col(key).alias("__key")).distinct()
    return existing.join(keys, F.col(key) == F.col("__key"), "left_anti").unionByName(new)


def prune(existing: DataFrame, current: DataFrame, key: str, last_seen: str, cutoff: Column) -> DataFrame:
    """Rows last seen before the cutoff and absent from the current keys go (M4)."""
    now = current.select(F.col(key).alias("__key")).distinct().withColumn("__now", F.lit(True))
    joined = existing.join(now, F.col(key) == F.col("__key"), "left")
    return joined.where(F.col("__now").isNotNull() | (F.col(last_seen) >= cutoff)).select(*existing.columns)


def cascade(children: DataFrame, kept: DataFrame, foreign: str, key: str) -> DataFrame:
    """Children whose parent is still there (M4, M5)."""
    return children.join(kept.select(F.col(key).alias("__key")), F.col(foreign) == F.col("__key"), "left_semi")


def fingerprint(user: Column, ids: Column, preset: Column, name: Column) -> Column:
    """A request's identity, whatever the order of its documents (M8)."""
    return F.sha2(F.concat_ws("|", user, F.array_join(F.array_sort(ids.cast("array<string>")), ","), preset, name), 256)


def fill_nulls(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """New values win where they are not empty."""
    given = new.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in columns))
    merged = old.join(given, F.col(key) == F.col("__key"), "left")
    kept = [F.coalesce(F.when(F.col(f"__{c}").cast("string") != "", F.col(f"__{c}")), F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns]
    return merged.select(*kept)


def changes(state: DataFrame, snapshot: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): unchanged, changed, new or vanished, by content hash (X3). One full outer join of two hashes."""
    a = state.select(F.col(key).alias("__a"), F.col(digest).alias("__old"))
    b = snapshot.select(F.col(key).alias("__b"), F.col(digest).alias("__new"))
    change = F.when(F.col("__b").isNull(), "vanished").when(F.col("__a").isNull(), "new").when(F.col("__old") == F.col("__new"), "unchanged").otherwise("changed")
    return a.join(b, F.col("__a") == F.col("__b"), "full_outer").select(F.coalesce("__a", "__b").alias(key), change.alias("change"))


def numbered(df: DataFrame, group: str | None, order: Sequence[Column], template: str) -> DataFrame:
    """Ids like cp-0001 in order, in each group.

    Rows are sorted in ranges and each range is numbered from where the one before ends, so no task gets the whole
    table or a whole group.
    """
    if group:
        return placed(df, [group], list(order)).withColumn("id", F.format_string(template, "place")).drop("place")
    ranges = checkpointed(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = sorted(ranges.groupBy("__range").count().collect())  # a row for each range
    starts, at = {}, 0
    for number, n in sizes:
        starts[number] = at
        at += n
    offset = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])[F.col("__range")] if starts else F.lit(0)
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) + offset
    return ranges.withColumn("id", F.format_string(template, place)).drop("__range")
