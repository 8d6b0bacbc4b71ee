"""Requests that change tables, as functions from tables to tables: what a transaction would do, done for a batch of requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.feed import fingerprint


def purge(rows: DataFrame, ts: str, as_of: Column, days: int, *, dry_run: bool = False) -> DataFrame:
    """The rows of the last so many days; a dry run says how many would go and stay (M6)."""
    old = F.col(ts) < as_of - F.make_dt_interval(F.lit(days))
    if dry_run:
        return rows.agg(F.count_if(old).alias("purged"), F.count_if(~F.coalesce(old, F.lit(False))).alias("kept"))
    return rows.where(~F.coalesce(old, F.lit(False)))


def request_key(user: Column, ids: Column, preset: Column, name: Column) -> Column:
    """A request's identity: its documents in any order, preset and name without case and outer blanks (M8)."""
    bare = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return fingerprint(user, F.coalesce(ids, F.array().cast("array<string>")), bare(preset), bare(name))


def reusable(requests: DataFrame, reports: DataFrame, as_of: Column, hours: int = 2) -> DataFrame:
    """requests (request, fp, user), reports (report, fp, user, status, created, started) -> requests with the report to reuse (M8).

    The newest report of the same user and key that is done, or was begun in the last hours; null if there is none.
    """
    begun = F.coalesce("started", "created")
    live = (F.col("status") == "done") | (F.col("status").isin("queued", "running") & (begun > as_of - F.make_dt_interval(F.lit(0), F.lit(hours))))
    newest = reports.where(live).groupBy("fp", "user").agg(F.max(F.struct("created", "report", "status")).alias("r"))
    return requests.join(newest, ["fp", "user"], "left").select(*requests.columns, F.col("r.report").alias("report"), F.col("r.status").alias("status"))


def rebase(rows: DataFrame, id_col: str, row_col: str, offset: int = 100_000_000) -> DataFrame:
    """Missing ids become the row number plus an offset; doing it again changes nothing (M9). An id that is there already in that range raises."""
    taken = rows.agg(F.max(F.col(id_col)).alias("top"), F.count_if(F.col(id_col).isNull()).alias("missing"), F.count_if(F.col(id_col) - offset != F.col(row_col)).alias("others")).first()
    if taken.missing and taken.others and rows.where((F.col(id_col) > offset) & (F.col(id_col) - offset != F.col(row_col))).limit(1).count():
        raise ValueError(f"ids over {offset} are in use")
    return rows.withColumn(id_col, F.coalesce(F.col(id_col), F.col(row_col) + offset))


def invite(existing: DataFrame, asked: DataFrame, keys: Sequence[str], order: str, done: str) -> DataFrame:
    """At most one open row a key: a new request replaces the open one; finished rows are never touched.

    Of several requests of a key the last by ``order`` counts. Both tables have the same columns.
    """
    rest = [c for c in existing.columns if c not in keys]
    last = asked.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*").select(*existing.columns)
    finished, open_ = existing.where(F.col(done).isNotNull()), existing.where(F.col(done).isNull())
    return finished.unionByName(open_.join(last.select(*keys), list(keys), "left_anti").select(*existing.columns)).unionByName(last)


def consume(tokens: DataFrame, asked: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """tokens (hash, expires, consumed), asked (request, hash, at) -> (tokens after, (request, granted)).

    A token serves its first request if it is neither consumed nor expired then; all others fail.
    """
    first = asked.groupBy("hash").agg(F.min(F.struct("at", "request")).alias("f"))
    met = tokens.join(first, "hash", "left")
    good = F.col("f").isNotNull() & F.col("consumed").isNull() & (F.col("expires") > F.coalesce(F.col("f.at"), as_of))
    after = met.select("hash", "expires", F.when(good, F.col("f.at")).otherwise(F.col("consumed")).alias("consumed"))
    served = met.where(good).select(F.col("f.request").alias("request"), F.lit(True).alias("granted"))
    return after, asked.select("request").join(served, "request", "left").select("request", F.coalesce("granted", F.lit(False)).alias("granted"))


def share(owners: DataFrame, shares: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """owners (session, owner), shares (session, user, granted_by), asked (request, at, kind, session, user, by) -> (shares after, outcomes).

    kind is grant or revoke; only the owner may ask (else ``refused``), and a grant to the owner is ``own`` and changes
    nothing. Of several requests about a session and user the last one counts.
    """
    told = asked.join(owners, "session", "left")
    outcome = F.when(F.col("owner").isNull() | (F.col("owner") != F.col("by")), "refused").when((F.col("kind") == "grant") & (F.col("user") == F.col("owner")), "own").otherwise(F.col("kind"))
    told = told.withColumn("outcome", outcome)
    last = told.where(F.col("outcome").isin("grant", "revoke")).groupBy("session", "user").agg(F.max(F.struct("at", "request", "kind", "by")).alias("l"))
    kept = shares.join(last.select("session", "user"), ["session", "user"], "left_anti").select("session", "user", "granted_by")
    granted = last.where("l.kind = 'grant'").select("session", "user", F.col("l.by").alias("granted_by"))
    return kept.unionByName(granted), told.select("request", "outcome")


def add_documents(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing (session, doc_index, filename, status), new (session, filename, at) -> (session, filename, doc_index, outcome).

    File names lose their folders. A name that is there keeps its number (``existing``, or ``retry`` if it failed);
    others are numbered on from the session's largest number, in the order of ``at``. Repeats in a batch count once.
    """
    leaf = F.coalesce(F.when(F.element_at(F.split("filename", "/"), -1) != "", F.element_at(F.split("filename", "/"), -1)), F.col("filename"))
    named = new.withColumn("filename", leaf).groupBy("session", "filename").agg(F.min("at").alias("at"))
    there = existing.select("session", "filename", "doc_index", F.when(F.col("status") == "failed", "retry").otherwise("existing").alias("outcome"))
    met = named.join(there, ["session", "filename"], "left")
    top = existing.groupBy("session").agg(F.max("doc_index").alias("top"))
    fresh = met.where("outcome is null").join(top, "session", "left")
    place = F.row_number().over(Window.partitionBy("session").orderBy("at", "filename"))
    added = fresh.select("session", "filename", (F.coalesce("top", F.lit(0)) + place).cast("bigint").alias("doc_index"), F.lit("added").alias("outcome"))
    return met.where("outcome is not null").select("session", "filename", F.col("doc_index").cast("bigint").alias("doc_index"), "outcome").unionByName(added)


def first_source(sources: Sequence[DataFrame], key: str, *, only_if_none: DataFrame | None = None) -> DataFrame:
    """Rows of several sources, of each key those of the first source that has it, with the source's place.

    ``only_if_none`` counts only if the others have no row at all. Columns as in all sources.
    """
    every = None
    for place, df in enumerate(sources):
        one = df.withColumn("source", F.lit(place))
        every = one if every is None else every.unionByName(one)
    if only_if_none is not None:
        some = every.select(F.lit(1).alias("__some")).limit(1)
        last = only_if_none.withColumn("source", F.lit(len(sources)))
        every = every.unionByName(last.join(F.broadcast(some), F.lit(True), "left_anti").select(*every.columns))
    rest = [c for c in every.columns if c != key]
    return every.groupBy(key).agg(F.min(F.struct("source", *[c for c in rest if c != "source"])).alias("__r")).select(key, "__r.*")


#: The states of a document on its way in, and what each may become.
STATES = {"queued": ("processing", "failed"), "processing": ("done", "failed"), "failed": ("queued",), "done": ()}


def ingestion(events: DataFrame) -> DataFrame:
    """events (key, ord, state, error, pages) -> (key, state, error, pages_done, refused, enqueue): documents after their events.

    An event that the state before doesn't allow is refused and changes nothing; the first must be queued. Errors are
    cut at 500 characters and go with a retry, pages start anew then. What is queued or processing goes back to the queue.
    """
    start = F.struct(F.lit("").alias("state"), F.lit(None).cast("string").alias("error"), F.lit(0).cast("bigint").alias("pages"), F.lit(0).cast("bigint").alias("refused"))

    def step(acc: Column, e: Column) -> Column:
        allowed = F.lit(False)
        for state, after in (("", ("queued",)), *STATES.items()):
            allowed = allowed | ((acc["state"] == state) & e["state"].isin(*after)) if after else allowed
        same = (acc["state"] == "processing") & (e["state"] == "processing")  # progress
        moved = F.struct(
            e["state"].alias("state"), F.when(e["state"] == "failed", F.substring(e["error"], 1, 500)).alias("error"),
            F.when(e["state"] == "queued", F.lit(0).cast("bigint")).otherwise(F.greatest(acc["pages"], F.coalesce(e["pages"].cast("bigint"), F.lit(0)))).alias("pages"), acc["refused"].alias("refused"),
        )
        stayed = F.struct(acc["state"].alias("state"), acc["error"].alias("error"), acc["pages"].alias("pages"), (acc["refused"] + 1).alias("refused"))
        return F.when(allowed | same, moved).otherwise(stayed)

    # A document has a handful of events; they are its whole history.
    history = events.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", "state", "error", "pages"))).alias("h"))
    out = history.select("key", F.aggregate("h", start, step).alias("s"))
    return out.select("key", "s.state", "s.error", F.col("s.pages").alias("pages_done"), "s.refused", F.col("s.state").isin("queued", "processing").alias("enqueue"))


def progress(docs: DataFrame, key: str) -> DataFrame:
    """docs (.., status, pages_done, pages_total) -> documents of each state, and pages of those under way."""
    going = F.col("status").isin("queued", "processing")
    pages = lambda c: F.coalesce(F.sum(F.when(going, F.coalesce(c, F.lit(0)))), F.lit(0)).cast("bigint")
    states = [F.count_if(F.col("status") == s).alias(s) for s in STATES]
    return docs.groupBy(key).agg(*states, pages("pages_done").alias("pages_done"), pages("pages_total").alias("pages_total"))


def cached(requests: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    """requests (key), cache (key, value, expires) -> (key, value, hit): what a cache still has; a null expiry has passed."""
    live = cache.where(F.col("expires").isNotNull() & (F.col("expires") > as_of)).groupBy("key").agg(F.max_by("value", "expires").alias("value"), F.lit(True).alias("hit"))
    return requests.select("key").distinct().join(live, "key", "left").select("key", "value", F.coalesce("hit", F.lit(False)).alias("hit"))


def cache_after(cache: DataFrame, fetched: DataFrame, as_of: Column, days: int) -> DataFrame:
    """The cache with what was fetched, to expire in so many days; entries of one key are replaced, expired ones go."""
    new = fetched.groupBy("key").agg(F.max("value").alias("value")).select("key", "value", (as_of + F.make_dt_interval(F.lit(days))).alias("expires"))
    live = cache.where(F.col("expires").isNotNull() & (F.col("expires") > as_of))
    return live.join(new, "key", "left_anti").select("key", "value", "expires").unionByName(new)
