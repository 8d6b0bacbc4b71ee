"""Audits of tables: order statistics, grounding, schemas, and rates from histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import legal as G
from corpusmill.session import checkpointed


def ranked_values(df: DataFrame, groups: Sequence[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """The values at ranks (from 1) of each group's sorted values; a rank may use ``n``. By a count of each value:
    no group is sorted whole in one task, only its distinct values (A8, A19)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("__k"))
    w = Window.partitionBy(*groups)
    upto = counts.withColumn("__upto", F.sum("__k").over(w.orderBy(value))).withColumn("n", F.sum("__k").over(w))
    return upto.groupBy(*groups).agg(F.first("n").alias("n"), *[F.min(F.when(F.col("__upto") >= rank, F.col(value))).alias(name) for name, rank in ranks.items()])


def corpus_stats(df: DataFrame, group: str, size: str, flags: dict[str, Column]) -> DataFrame:
    """n, whole mean, median and longest, the 90th percentile by the exclusive method (the longest of up to ten), and rates of flags."""
    n = F.col("n")
    at = F.lit(0.9) * (n + 1)
    picked = ranked_values(df, [group], size, {"__a": F.expr("(n + 1) div 2"), "__b": F.expr("n div 2 + 1"), "__lo": F.floor(at), "__hi": F.least(F.floor(at) + 1, n)})
    rates = df.groupBy(group).agg(F.floor(F.avg(size)).alias("mean"), F.max(size).alias("longest"), *[F.round(F.avg(F.when(test, 1.0).otherwise(0.0)), 6).alias(f"{name}_rate") for name, test in flags.items()])
    p90 = F.when(n <= 10, F.col("longest")).otherwise(F.floor(F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (at - F.floor(at)) + 0.000001))
    out = rates.join(picked, group)
    return out.select(group, "n", "mean", F.floor((F.col("__a") + F.col("__b")) / 2).alias("median"), p90.alias("p90"), "longest", *[f"{name}_rate" for name in flags])


def domains_of_contents(contents: DataFrame, registry: DataFrame, domain: Column) -> tuple[DataFrame, DataFrame]:
    """contents (slug), registry (slug) -> (laws of each domain, most first; slugs of the registry that the contents lack) (A4)."""
    counted = contents.groupBy(domain.alias("domain")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain")
    return counted, registry.select("slug").distinct().join(contents.select("slug"), "slug", "left_anti").orderBy("slug")


def grounding_audit(samples: DataFrame, task: str, answer: str, passage: str, *, free: Sequence[str] = ("summarize", "explain")) -> DataFrame:
    """For each task: samples, references and those found, their share, mean word overlap, and the share under a fifth but for free retelling (A10)."""
    g = samples.select(F.col(task).alias("task"), G.grounding(F.col(answer), F.col(passage)).alias("g")).select("task", "g.*")
    low = (F.col("word_overlap") < 0.2) & ~F.col("task").isin(*free)
    sums = g.groupBy("task").agg(F.count("*").alias("n"), F.sum("ref_total").alias("ref_total"), F.sum("ref_found").alias("ref_found"), F.round(F.avg("word_overlap"), 3).alias("avg_word_overlap"), F.round(100 * F.count_if(low) / F.count("*"), 2).alias("low_overlap_pct"))
    return sums.withColumn("cited_pct", F.when(F.col("ref_total") > 0, F.round(100 * F.col("ref_found") / F.col("ref_total"), 2)))


#: The classes of parcels, and a box around Germany (south, west, north, east).
CLASSES = ("secured", "not_secured", "uncertain")
GERMANY = (47.0, 5.5, 55.1, 15.1)


def parcel_validation(parcels: DataFrame) -> DataFrame:
    """parcels (id, class, ring) -> one row: counts of classes, coverage, duplicate and conflicting ids, errors of geometry.

    By id first, so no distinct count of everything is in one task. A ring is in error without points, or with one outside of Germany.
    """
    s, w, n, e = GERMANY
    outside = F.exists("ring", lambda p: (F.size(p) >= 2) & ~(p[0].between(s, n) & p[1].between(w, e)))
    bad = F.col("ring").isNull() | (F.size("ring") == 0) | outside
    counts = [F.count_if(F.col("class") == c).alias(c) for c in CLASSES]
    each = parcels.groupBy("id").agg(F.count("*").alias("rows"), *counts, F.countDistinct("class").alias("kinds"), F.count_if(bad).alias("bad"))
    named = (F.col("id").isNotNull()) & (F.col("id") != "")
    total = F.coalesce(F.sum("rows"), F.lit(0))
    sums = each.agg(total.alias("total"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CLASSES], F.coalesce(F.sum(F.when(named, F.col("rows") - 1)), F.lit(0)).alias("duplicates"), F.count_if(named & (F.col("kinds") > 1)).alias("conflicts"), F.coalesce(F.sum("bad"), F.lit(0)).alias("geometry_errors"))
    return sums.withColumn("unclassified", F.col("total") - sum(F.col(c) for c in CLASSES)).withColumn("coverage", F.when(F.col("total") > 0, F.round(F.col("secured") / F.col("total"), 4)).otherwise(0.0))


def probe_summary(probes: DataFrame) -> DataFrame:
    """probes (category, language, base, tuned) -> n, equal answers, mean lengths, and for German the drift of the ASCII share."""
    ascii_share = lambda c: F.length(F.regexp_replace(c, r"[^\x00-\x7F]", "")) / F.greatest(F.length(c), F.lit(1))
    drift = F.when(F.col("language") == "de", ascii_share(F.col("tuned")) - ascii_share(F.col("base")))
    mean = lambda c: F.round(F.avg(F.length(c)), 4)
    return probes.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("base") == F.col("tuned")).alias("equal"), mean("base").alias("mean_base"), mean("tuned").alias("mean_tuned"), F.round(F.avg(drift), 6).alias("de_drift"))


def flattened(docs: DataFrame, json_col: str, *, most_depth: int = 32) -> DataFrame:
    """(path, type, empty, text) of every key of every document, nested ones as a.b; of a list its first element, if it is an object, as a[*].b.

    One pass a level of nesting, until no value is an object or a list.
    """
    value = lambda c: F.when(c.rlike(r"^\s*[{\[]"), c)
    level = docs.select(F.lit("").alias("path"), F.col(json_col).alias("json"))
    out = None
    for _ in range(most_depth):
        objects = level.where(F.ltrim("json").startswith("{"))
        parts = objects.select("path", F.explode(F.from_json("json", "map<string,variant>")).alias("k", "v"))
        keys = parts.select(F.concat(F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit("."))), "k").alias("path"), F.schema_of_variant("v").alias("kind"), F.to_json("v").alias("json"), F.try_variant_get("v", "$", "string").alias("text"))
        kind = F.when(F.col("kind").startswith("OBJECT"), "dict").when(F.col("kind").startswith("ARRAY"), "list").when(F.col("kind") == "STRING", "str").when(F.col("kind") == "BIGINT", "int").when(F.col("kind") == "BOOLEAN", "bool").when(F.col("kind") == "VOID", "null").otherwise("float")
        empty = (F.col("kind") == "VOID") | F.col("json").isNull() | F.col("json").isin('""', "[]", "{}")
        keys = checkpointed(keys.select("path", kind.alias("type"), F.coalesce(empty, F.lit(True)).alias("empty"), F.when(kind == "str", F.col("text")).alias("text"), value(F.col("json")).alias("json")))
        out = keys if out is None else out.unionByName(keys)
        inner = keys.where("json is not null and type = 'dict'").select("path", "json")
        lists = keys.where("json is not null and type = 'list'").select(F.concat("path", F.lit("[*]")).alias("path"), F.get(F.from_json("json", "array<string>"), F.lit(0)).alias("json"))
        level = inner.unionByName(lists.where(value(F.col("json")).isNotNull()))
        if level.isEmpty():
            break
    return out.select("path", "type", "empty", "text")


def schema_audit(docs: DataFrame, json_col: str) -> DataFrame:
    """(path, present, empty, types, p50, p95, longest, n_values, enum) of every path.

    Types by count as ``str:3,null:1``. Lengths of strings are the elements at n div 2 and at 0.95 n of the sorted ones. A path
    is an enum if its strings under 50 characters have 3 to 30 values, of which the ten commonest make nine tenths of all.
    """
    flat = checkpointed(flattened(docs, json_col))
    kinds = flat.groupBy("path", "type").agg(F.count("*").alias("k"), F.count_if("empty").alias("e"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "type")))
    counts = kinds.groupBy("path").agg(F.sum("k").alias("present"), F.sum("e").alias("empty"), F.array_join(F.transform(listed, lambda s: F.concat(s["type"], F.lit(":"), (-s["k"]).cast("string"))), ",").alias("types"))
    sized = flat.where("text is not null").select("path", "text", F.length("text").alias("len"))
    n = F.col("n")
    lens = ranked_values(sized, ["path"], "len", {"p50": F.expr("n div 2 + 1"), "p95": F.floor(n * 0.95) + 1, "longest": n}).drop("n")
    values = sized.where("len < 50").groupBy("path", "text").agg(F.count("*").alias("k"))
    ranked = values.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("k"), "text")))
    enums = ranked.groupBy("path").agg(F.count("*").alias("n_values"), F.sum(F.when(F.col("r") <= 10, F.col("k"))).alias("top"))
    enum = F.coalesce(F.col("n_values").between(3, 30) & (F.col("top") >= F.col("present") * 0.9), F.lit(False))
    return counts.join(lens, "path", "left").join(enums, "path", "left").select("path", "present", "empty", "types", "p50", "p95", "longest", F.coalesce("n_values", F.lit(0)).alias("n_values"), enum.alias("enum"))


def histogram_quantile(q: float, counts: Column, bounds: Sequence[float]) -> Column:
    """The quantile that cumulated counts of buckets suggest: straight lines within a bucket, which begins at the bound before or at 0.

    counts has a further bucket for all above the last bound; a quantile in there is that bound. Null without counts.
    """
    total = F.element_at(counts, len(bounds) + 1)
    rank = q * total
    out = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low, below = (float(bounds[i - 1]), F.element_at(counts, i)) if i else (0.0, F.lit(0))
        inside = F.element_at(counts, i + 1) - below
        line = F.when(inside > 0, low + (bounds[i] - low) * (rank - below) / inside).otherwise(low)
        out = F.when(F.element_at(counts, i + 1) >= rank, line).otherwise(out)
    return F.when(total > 0, out)


def rate_panels(events: DataFrame, ts: str, value: str, window: str, bounds: Sequence[float], error: Column) -> DataFrame:
    """For each window: events, the share of errors, and quantiles as a dashboard reads them from a histogram."""
    below = F.array(*[F.count_if(F.col(value) <= b) for b in bounds], F.count(value))
    counted = events.groupBy(F.window(ts, window).alias("w")).agg(F.count("*").alias("n"), F.round(F.count_if(error) / F.greatest(F.count("*"), F.lit(1e-9)), 6).alias("error_rate"), below.alias("c"))
    return counted.select(F.col("w.start").alias("start"), "n", "error_rate", *[F.round(histogram_quantile(q, F.col("c"), bounds), 6).alias(f"p{round(100 * q)}") for q in (0.5, 0.95, 0.99)])
