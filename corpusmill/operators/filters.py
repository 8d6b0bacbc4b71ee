"""Projections and filters. All are expressions; none shuffles unless it says so."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exclude_values(value: Column, values: Sequence) -> Column:
    """NOT IN that keeps nulls."""
    return value.isNull() | ~value.isin(*values)


def unclassified(labels: Column) -> Column:
    """No label array, or an empty one."""
    return labels.isNull() | (F.coalesce(F.size(labels), F.lit(0)) <= 0)


def page(df: DataFrame, filters: dict[str, object | None], order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """Equality filters where a value is given, then a page in order."""
    for name, value in filters.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df.orderBy(*order).offset(offset).limit(limit)


def within(ts: Column, since: str, until: str) -> Column:
    """Half-open time range."""
    return (ts >= F.lit(since).cast("timestamp")) & (ts < F.lit(until).cast("timestamp"))


def visible_to(df: DataFrame, shares: DataFrame, user: object, *, key: str, owner: str, share_key: str, share_user: str) -> DataFrame:
    """Rows that a user owns or that are shared with them: one existence join."""
    mine = shares.where(F.col(share_user) == F.lit(user)).select(F.col(share_key).alias("__key")).distinct().withColumn("__shared", F.lit(True))
    return df.join(mine, F.col(key) == F.col("__key"), "left").where((F.col(owner) == F.lit(user)) | F.col("__shared")).select(*df.columns)


def live(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows whose key exists elsewhere."""
    return df.join(other.select(F.col(other_key).alias("__key")), F.col(key) == F.col("__key"), "left_semi")


def missing(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows whose key does not exist elsewhere."""
    return df.join(other.select(F.col(other_key).alias("__key")), F.col(key) == F.col("__key"), "left_anti")


#: Signs of a broken extraction, and everyday words that prose of any length has.
GARBLED = r"/a\d{2,}|[\u2700-\u27BF\u2190-\u21FF\u2300-\u23FF]{3,}|\uFFFD"
EVERYDAY = r"(?iU)\b(der|die|das|und|von|für|fuer|ist|nicht|den|dem|des|ein|eine|einen|mit|auf|im|zu|nach|bei|durch|werden|wird|sind|the|and|of|in|to|is|for|with|on)\b"
#: Marks that count as readable besides letters, digits and white space.
READABLE_MARKS = r""".,;:!?()\[\]{}§%\-–/€$"'„“”’"""


def readable(text: Column) -> Column:
    """Prose rather than what a broken extraction leaves: not garbled, seven tenths of usual characters, and an everyday word if it has over 120."""
    odd = F.length(F.regexp_replace(text, rf"(?U)[\p{{L}}\p{{N}}\s{READABLE_MARKS}]", ""))
    usual = 1 - odd / F.length(text) >= 0.7
    return F.coalesce((F.trim(text) != "") & ~text.rlike(GARBLED) & usual & ((F.length(text) <= 120) | text.rlike(EVERYDAY)), F.lit(False))


def unless_none(df: DataFrame, good: Column, group: Sequence[str]) -> DataFrame:
    """Rows that pass; of a group where none passes, all rows (P8). One shuffle by group."""
    flagged = df.withColumn("__good", F.coalesce(good, F.lit(False)))
    any_good = F.max("__good").over(Window.partitionBy(*group))
    return flagged.withColumn("__any", any_good).where("__good or not __any").select(*df.columns)


def drop_reasons(df: DataFrame, reasons: dict[str, Column]) -> Column:
    """The first reason to drop a row, or null."""
    out = F.lit(None).cast("string")
    for name, test in reversed(reasons.items()):
        out = F.when(F.coalesce(test, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def shard_counts(records: DataFrame, languages: Sequence[str], types: Sequence[str] = (), jurisdictions: Sequence[str] = (), sample: int = 5) -> DataFrame:
    """records (shard, index, language, type, jurisdiction) -> (shard, skipped, seen, wrong_language, wrong_type, wrong_jurisdiction, kept).

    A shard whose first records are all of one language that is not asked for is skipped whole. Of several reasons
    the first counts; empty lists allow everything.
    """
    first = records.where(F.col("index") < sample).groupBy("shard").agg(F.countDistinct(F.coalesce("language", F.lit(""))).alias("k"), F.max("language").alias("one"))
    skipped = F.coalesce((F.col("k") == 1) & ~F.col("one").isin(*languages), F.lit(False))
    allowed = lambda c, values: F.lit(True) if not values else F.coalesce(F.col(c).isin(*values), F.lit(False))
    lang, kind, law = allowed("language", languages), allowed("type", types), allowed("jurisdiction", jurisdictions)
    counted = records.groupBy("shard").agg(F.count("*").alias("seen"), F.count_if(~lang).alias("wrong_language"), F.count_if(lang & ~kind).alias("wrong_type"), F.count_if(lang & kind & ~law).alias("wrong_jurisdiction"), F.count_if(lang & kind & law).alias("kept"))
    told = counted.join(first, "shard", "left").withColumn("skipped", skipped)
    none = lambda c: F.when(F.col("skipped"), 0).otherwise(F.col(c)).cast("bigint").alias(c)
    return told.select("shard", "skipped", *map(none, ("seen", "wrong_language", "wrong_type", "wrong_jurisdiction", "kept")))


def share_targets(users: DataFrame, shared: DataFrame, *, caller: Column, owner: Column, org: Column, text: str, limit: int = 10) -> DataFrame:
    """users (id, org, status, name, email), shared (id) -> whom a session may be shared with, the likest first.

    Active users of the organisation whose name or address has the text, but the caller, the owner and those who have
    it. Texts under two characters find none; 1 to 50 are returned.
    """
    from corpusmill.operators.retrieval import trigram_similarity

    low = text.strip().lower()
    if len(low) < 2:
        return users.limit(0).select("id", "name", "email", F.lit(0.0).alias("likeness"))
    name, email = F.lower("name"), F.col("email")
    found = users.where((F.col("status") == "active") & (F.col("org") == org) & (F.col("id") != caller) & (F.col("id") != owner) & (name.contains(low) | email.contains(low)))
    likeness = F.round(F.greatest(trigram_similarity(name, F.lit(low)), trigram_similarity(email, F.lit(low))), 6)
    left = missing(found, shared, "id", "id")
    return left.select("id", "name", "email", likeness.alias("likeness")).orderBy(F.desc("likeness"), "name", "id").limit(max(1, min(50, limit)))


def unexpired(expires: Column, as_of: Column) -> Column:
    """A null expiry counts as expired."""
    return expires.isNotNull() & (expires > as_of)


#: Cell contents that mean nothing.
NULL_WORDS = ("", "-", "n/a", "na", "none", "null", "unbekannt", "unknown", "k.a.", "keine angabe")


def plausible_text(value: Column, fallback: str) -> Column:
    """Cell text, or the fallback for words that mean nothing."""
    return F.when(value.isNull() | F.lower(F.trim(value)).isin(*NULL_WORDS), F.lit(fallback)).otherwise(F.trim(value))


def plausible_power(kw: Column) -> Column:
    return F.when((kw > 0) & (kw <= 10_000), kw)


#: States of a document on its way in.
UNDER_WAY, ARRIVED = ("queued", "processing", "uploading"), ("done", "ready")


def empty_grounding(turns: DataFrame, docs: DataFrame) -> DataFrame:
    """(turn_id, outcome, pages_done, pages_total, reason): what to say to a turn that found nothing to stand on.

    turns (turn_id, session, mode, n_matter, n_all), docs (session, place, status, n_chunks, pages_done, pages_total, error).
    Only turns about documents are held back: while one is under way (processing, with its pages), when all failed
    (failed, with the first reason), and else because no passage fits (no_passage). All others generate.
    """
    status = F.lower(F.coalesce("status", F.lit("")))
    going, arrived = status.isin(*UNDER_WAY), status.isin(*ARRIVED)
    chunks = F.coalesce("n_chunks", F.lit(0))
    failed = (status == "failed") | (arrived & (chunks == 0))
    pages = lambda c: F.sum(F.when(going, F.coalesce(c, F.lit(0))).otherwise(0))
    reason = F.min(F.when(failed & (F.trim("error") != ""), F.struct("place", F.trim("error").alias("error"))))["error"]
    state = docs.groupBy("session").agg(F.count_if(going).alias("going"), F.count_if(arrived & (chunks > 0)).alias("usable"), F.count_if(failed).alias("failed"), pages("pages_done").alias("pages_done"), pages("pages_total").alias("pages_total"), reason.alias("reason"))
    found = F.when(F.col("mode") == "rag+contract", F.col("n_all")).otherwise(F.col("n_matter"))
    outcome = (
        F.when(~F.col("mode").isin("contract", "rag+contract") | (found > 0), "generate")
        .when(F.col("going") > 0, "processing")
        .when((F.col("failed") > 0) & (F.col("usable") == 0), "failed")
        .otherwise("no_passage")
    )
    told = turns.join(state, "session", "left").withColumn("outcome", outcome)
    held = lambda kind, c: F.when(F.col("outcome") == kind, F.col(c))
    return told.select("turn_id", "outcome", held("processing", "pages_done").alias("pages_done"), held("processing", "pages_total").alias("pages_total"), held("failed", "reason").alias("reason"))
