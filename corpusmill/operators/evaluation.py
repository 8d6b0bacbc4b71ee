"""Retrieval evaluation: recall, reciprocal rank, slices, splits and the variant rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hit(rank: str, k: int) -> Column:
    return F.when(F.col(rank) <= k, 1.0).otherwise(0.0)


def recall(ranks: DataFrame, rank: str, ks: Sequence[int]) -> DataFrame:
    """Recall at each k and mean reciprocal rank; a null rank is a miss, no rows give zeros (A5)."""
    each = [F.round(F.coalesce(F.avg(hit(rank, k)), F.lit(0.0)), 6).alias(f"recall_{k}") for k in ks]
    mrr = F.round(F.coalesce(F.avg(F.coalesce(1.0 / F.col(rank), F.lit(0.0))), F.lit(0.0)), 6)
    return ranks.agg(F.count("*").alias("n"), *each, mrr.alias("mrr"))


def bucketed_recall(ranks: DataFrame, rank: str, axes: Sequence[str], k: int) -> DataFrame:
    """Recall by each axis in one pass (A6): rows are counted under every axis."""
    slices = ranks.select(F.col(rank), F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("bucket")) for a in axes])).alias("s"))
    return slices.groupBy("s.axis", "s.bucket").agg(F.count("*").alias("n"), F.round(F.avg(hit(rank, k)), 6).alias("recall_" + str(k)))


def failure_labels(ranks: DataFrame, rank: str, k: int, labels: dict[str, Column]) -> DataFrame:
    """Counts of each label over the misses; a miss can have several."""
    missed = ranks.where(F.col(rank).isNull() | (F.col(rank) > k))
    return missed.select(F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in labels.items()]))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def stratified_split(df: DataFrame, stratum: str, key: str, *, share: float, seed: int) -> DataFrame:
    """An exact share of each stratum, one row at least, in the order of a seeded hash.

    Rows are counted by the first four digits of the hash; only those of the one beginning within which the
    share ends are sorted, a 65,536th of a stratum. Rows that share hash and key are taken in any order.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    hashed = df.withColumn("__h", order).withColumn("__p", F.substring("__h", 1, 4))
    counts = hashed.groupBy(F.col(stratum).alias("__s"), F.col("__p").alias("__q")).agg(F.count("*").alias("__k"))
    w = Window.partitionBy("__s")
    upto = counts.withColumn("__upto", F.sum("__k").over(w.orderBy("__q"))).withColumn("__most", F.greatest(F.lit(1), F.floor(F.lit(share) * F.sum("__k").over(w))))
    edge = upto.where((F.col("__upto") >= F.col("__most")) & (F.col("__upto") - F.col("__k") < F.col("__most"))).select("__s", F.col("__q").alias("__edge"), (F.col("__most") - (F.col("__upto") - F.col("__k"))).alias("__left"))
    met = hashed.join(edge, F.col(stratum).eqNullSafe(F.col("__s")))
    clear = met.where("__p <> __edge").select(*df.columns, (F.col("__p") < F.col("__edge")).alias("val"))
    close = met.where("__p = __edge").withColumn("__rn", F.row_number().over(Window.partitionBy(stratum).orderBy("__h", key)))
    return clear.unionByName(close.select(*df.columns, (F.col("__rn") <= F.col("__left")).alias("val")))


def choose_variant(results: DataFrame, *, control: str, metric: str, latency: str, most_loss: float = 0.01) -> DataFrame:
    """Variants that lose at most so much against the control survive; the fastest wins."""
    base = results.where(F.col("variant") == control).select(F.col(metric).alias("__base"))
    kept = results.crossJoin(F.broadcast(base)).where(F.col(metric) - F.col("__base") >= -most_loss)
    return kept.agg(F.min_by("variant", F.struct(latency, "variant")).alias("variant"), F.count("*").alias("survivors"))


def pool_comparison(hits: DataFrame, members: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """hits (qid, id, score), members (pool, id), gold (qid, id) -> (pool, n, recall, mrr): what further documents do to a search.

    A question's hits are ranked anew among the documents of each pool. Questions without a gold document in any pool count in none.
    """
    inside = hits.join(members, "id")
    # A gold document's rank is one more than the number of hits before it: counted, not sorted.
    first = inside.join(gold, ["qid", "id"]).groupBy("pool", "qid").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("id").alias("i"))).alias("first"))
    before = (F.col("score") > -F.col("first.s")) | ((F.col("score") == -F.col("first.s")) & (F.col("id") < F.col("first.i")))
    best = inside.join(first, ["pool", "qid"]).groupBy("pool", "qid").agg((F.count_if(before) + 1).alias("rank"))
    asked = gold.select("qid").distinct().crossJoin(F.broadcast(members.select("pool").distinct()))  # a few pools
    told = asked.join(best, ["pool", "qid"], "left")
    return told.groupBy("pool").agg(F.count("*").alias("n"), F.round(F.avg(hit("rank", k)), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))
