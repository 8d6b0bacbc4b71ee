"""Joins of sets by similarity, exact, without comparing all pairs.

Tokens are ordered by how many sets hold them, rare ones first. Two sets that are similar
enough share one of their first few tokens (a prefix, whose length follows from the threshold),
so prefixes are the keys of a plain equi-join. A pair met under its first common token alone,
and goes on if the sizes allow it, if the places of that token leave enough tokens behind it,
and if enough tokens are common. What stays is exact.

The measures: ``jaccard``, common tokens over all tokens, and ``dice``, twice the common ones
over the sum of the sizes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.retrieval import MOST_TERMS, trigrams
from corpusmill.session import checkpointed

#: How a threshold's rounding may err.
_SLACK = 1e-9


def least_common(measure: str, threshold: float, a: Column, b: Column) -> Column:
    """The fewest common tokens with which sets of these sizes reach the threshold."""
    share = threshold / (1 + threshold) if measure == "jaccard" else threshold / 2
    return F.ceil((a + b) * share - _SLACK)


def prefix_length(measure: str, threshold: float, n: Column) -> Column:
    """n less the fewest common tokens with any other set, and one."""
    share = threshold if measure == "jaccard" else threshold / (2 - threshold)
    return n - F.ceil(n * share - _SLACK) + 1


def similarity(measure: str, common: Column, a: Column, b: Column) -> Column:
    return common / (a + b - common) if measure == "jaccard" else 2 * common / (a + b)


def ordered_sets(sets: DataFrame, frequencies: DataFrame) -> DataFrame:
    """sets (id, tokens) -> (id, n, tokens) with tokens from rare to frequent; those without a frequency come first."""
    each = sets.select("id", F.explode(F.array_distinct("tokens")).alias("token")).join(frequencies, "token", "left")
    listed = each.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "token"))).alias("tokens"))
    return listed.select("id", F.size("tokens").alias("n"), F.transform("tokens", lambda t: t["token"]).alias("tokens"))


def prefixes(sets: DataFrame, measure: str, threshold: float) -> DataFrame:
    """(id, n, tokens) -> a row for each token of the prefix, with its place."""
    first = F.slice("tokens", 1, F.greatest(prefix_length(measure, threshold, F.col("n")), F.lit(0)).cast("int"))
    return sets.select("id", "n", "tokens", F.posexplode(first).alias("place", "token"))


def candidates(left: DataFrame, right: DataFrame, measure: str, threshold: float) -> DataFrame:
    """Prefix rows of two sides -> (a, b, common) of the pairs that pass the filters of size, place and count."""
    r = right.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("tokens").alias("tokens2"), F.col("place").alias("place2"), "token")
    met = left.withColumnRenamed("id", "a").join(r, "token")
    need = least_common(measure, threshold, F.col("n"), F.col("n2"))
    open_ = 1 + F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) - 1
    met = met.where((F.least("n", "n2") >= need) & (open_ >= need))
    both = met.withColumn("both", F.array_intersect("tokens", "tokens2")).where((F.col("both")[0] == F.col("token")) & (F.size("both") >= need))
    return both.select("a", "b", "n", "n2", F.size("both").alias("common"))


def frequencies(sets: DataFrame) -> DataFrame:
    return sets.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").count()


def join(left: DataFrame, right: DataFrame, *, measure: str, threshold: float) -> DataFrame:
    """left, right (id, tokens) -> (a, b, similarity) of all pairs that reach the threshold. Null or empty sets meet nothing."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold: over 0, at most 1")
    counts = checkpointed(frequencies(left.select("tokens").unionByName(right.select("tokens"))))
    sides = [prefixes(ordered_sets(side, counts), measure, threshold) for side in (left, right)]
    met = candidates(*sides, measure, threshold)
    found = similarity(measure, F.col("common"), F.col("n"), F.col("n2"))
    return met.select("a", "b", found.alias("similarity")).where(F.col("similarity") >= threshold - _SLACK)


#: Names whose tokens and postings a task sorts at once.
NAMES = 20_000


class TrigramIndex:
    """Postings of names' trigrams, kept in a folder for batches of needles.

    For a least similarity fixed when it is built, the first trigrams of each name are kept as keys, in
    ``buckets`` by their hash; a batch of needles reads the buckets of its own first trigrams alone.
    """

    def __init__(self, spark: SparkSession, folder: str, threshold: float = 0.3, buckets: int = 32, tokens: Callable[[Column], Column] = trigrams):
        self.spark, self.folder, self.threshold, self.buckets, self.tokens = spark, folder.rstrip("/"), threshold, buckets, tokens

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int")

    def build(self, names: DataFrame, *, id_col: str, name_col: str) -> TrigramIndex:
        """Names of repeated ids, or null ones, count as one set for an id, or as none."""
        parts = max(self.spark.sparkContext.defaultParallelism, -(-names.count() // NAMES))
        # Dealt by id once, as names; what tokens need further stays in place, and parts are counted by rows, not by compressed bytes.
        dealt = names.select(F.col(id_col).alias("id"), F.col(name_col).alias("name")).repartition(parts, "id")
        sets = dealt.select("id", F.explode(self.tokens(F.col("name"))).alias("token")).distinct()
        counts = checkpointed(sets.groupBy("token").count())
        small = F.broadcast if counts.count() <= MOST_TERMS else lambda df: df
        each = sets.join(small(counts), "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("tokens"))
        listed = each.select("id", F.size("tokens").alias("n"), F.transform("tokens", lambda t: t["token"]).alias("tokens"))
        for name, df, keys in (("counts", counts, ["token"]), ("postings", prefixes(listed, "jaccard", self.threshold), ["token", "id"])):
            df.withColumn("bucket", self._bucket()).repartitionByRange(parts, "bucket", *keys).sortWithinPartitions("bucket", *keys).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}")
        return self

    def candidates(self, needles: DataFrame) -> DataFrame:
        """needles (qid, needle) -> (a, b, n, n2, common): the pairs that pass the filters."""
        sets = needles.select(F.col("qid").alias("id"), self.tokens(F.col("needle")).alias("tokens"))
        own = sets.select(F.explode("tokens").alias("token")).distinct().withColumn("bucket", self._bucket())
        folders = [r.bucket for r in own.select("bucket").distinct().collect()]  # no more than buckets
        counts = self.spark.read.parquet(f"{self.folder}/counts").where(F.col("bucket").isin(folders)).join(own, ["bucket", "token"], "left_semi").select("token", "count")
        asked = checkpointed(prefixes(ordered_sets(sets, counts), "jaccard", self.threshold).withColumn("bucket", self._bucket()))
        some = [r.bucket for r in asked.select("bucket").distinct().collect()]
        postings = self.spark.read.parquet(f"{self.folder}/postings").where(F.col("bucket").isin(some))
        asked = asked.drop("bucket")
        # Few needles go to the postings, so that the names of a frequent token don't meet in one task.
        return candidates(F.broadcast(asked) if asked.count() <= MOST_TERMS else asked, postings.drop("bucket"), "jaccard", self.threshold)

    def search(self, needles: DataFrame, threshold: float | None = None) -> DataFrame:
        """needles (qid, needle) -> (qid, id, similarity) of all names that are similar enough."""
        least = self.threshold if threshold is None else threshold
        if least < self.threshold:
            raise ValueError(f"the index is built for a similarity of {self.threshold} or more")
        found = similarity("jaccard", F.col("common"), F.col("n"), F.col("n2"))
        return self.candidates(needles).select(F.col("a").alias("qid"), F.col("b").alias("id"), found.alias("similarity")).where(F.col("similarity") >= least - _SLACK)
