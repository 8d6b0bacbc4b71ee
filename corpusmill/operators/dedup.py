"""Exact and near duplicates of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.graph import connected_components
from corpusmill.session import checkpointed

#: Classes of which the texts are looked for by a broadcast; more are joined.
BROADCAST = 500_000


def content_hash(text: Column) -> Column:
    """Hash of the text in lower case with white space collapsed."""
    return F.md5(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")))


def exact_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(hash, keep, n) of the texts that occur more than once. Only hashes are shuffled, summed first."""
    return docs.groupBy(content_hash(F.col(text_col)).alias("hash")).agg(F.min(id_col).alias("keep"), F.count("*").alias("n")).where("n > 1")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def _shingled(words: Column, width: int) -> Column:
    """Hashes of the distinct n-grams of words; what lies beyond the last word is null and left out."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0)))
    return F.when(words.isNotNull(), F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.concat_ws(" ", *(F.get(words, i + k) for k in range(width)))))))


def shingles(text: Column, width: int) -> Column:
    """Hashes of the distinct word n-grams. Words are cut once: a lambda works out again whatever it captures."""
    return F.transform(F.array(_words(text)), lambda ws: _shingled(ws, width))[0]


def _marked(text: Column, width: int) -> Column:
    """To be selected: the columns hash and s of each text, its content hash (empty for none) and its shingles, of words cut once."""
    return F.inline(F.transform(F.array(_words(text)), lambda ws: F.struct(F.coalesce(F.md5(F.array_join(ws, " ")), F.lit("")).alias("hash"), _shingled(ws, width).alias("s"))))


def _keys(column: pa.Array, bands: int, rows: int) -> pa.Array:
    """The band keys of each list of hashes, null where there are none. Lists lie side by side, some 32,000 hashes at once."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes[sizes > 0])
    starts = ends - sizes[sizes > 0]
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
    out, at = np.empty((len(ends), bands), np.uint64), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + (1 << 15), "right")))
        part = flat[starts[at] : ends[to - 1]]
        part, firsts = part ^ (part >> np.uint64(31)), starts[at:to] - starts[at]
        for b in range(bands):
            key = np.full(to - at, b + 1, np.uint64)
            for r in range(rows):
                mixed = part * np.uint64((0x9E3779B97F4A7C15 * (2 * (b * rows + r) + 1)) % (1 << 64) | 1)
                mixed ^= mixed >> np.uint64(29)
                key = (key ^ np.minimum.reduceat(mixed, firsts)) * np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(32)
            out[at:to, b] = key
        at = to
    offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.reshape(-1).view(np.int64)), mask=pa.array(sizes == 0))


def minhash(hashes: Column, bands: int, rows: int) -> Column:
    """One key for each band: of the minima of its rows, each under a mixing of the hashes of its own. In numpy, in Arrow batches."""
    return F.arrow_udf(lambda column: _keys(column, bands, rows), "array<bigint>")(hashes)


def sketches(rows: DataFrame, bands: int, depth: int) -> DataFrame:
    """(id, hash, s) -> (id, hash, keys): the band keys of each row's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _keys(batch.column(2), bands, depth)], names=["id", "hash", "keys"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, hash string, keys array<bigint>")


def _similar(pairs: DataFrame, cut: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs whose shingles pass the check."""
    left, right = cut.select(F.col("hash").alias("a"), F.col("s").alias("sa")), cut.select(F.col("hash").alias("b"), F.col("s").alias("sb"))
    jaccard = F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(F.round(jaccard, 6) >= threshold).select("a", "b")


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows (hash, ...) with the component that the links give; their own hash where there are none."""
    found = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return rows.join(found.withColumnRenamed("node", "hash"), "hash", "left").withColumn("component", F.coalesce("component", "hash"))


def prefix_pairs(members: DataFrame, cut: DataFrame, threshold: float) -> DataFrame:
    """members (hash, component, keys), cut (hash, s) -> (a, b) of other components that share a key and can reach the threshold.

    Shingles are ordered from rare to frequent. Of two sets that are similar enough the smaller has one of its
    first n - 2tn / (1 + t) + 1 shingles among the first n - tn + 1 of the larger; where these lie bounds what
    can still be common. So members that differ in their own, rare shingles meet nobody, however many share the rest.
    """
    each = cut.join(members.select("hash"), "hash", "left_semi").select("hash", F.explode("s").alias("token"))
    counts = each.groupBy("token").count().where("count > 1")
    sizes = members.join(cut, "hash").select("hash", "component", "keys", F.size("s").alias("n"))
    # Shingles of one member alone come first of all: they take places, and are no keys.
    shared = each.join(counts, "token").groupBy("hash").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("tokens"))
    placed = sizes.join(shared, "hash").withColumn("alone", F.col("n") - F.size("tokens"))
    probe = F.col("n") - F.ceil(F.col("n") * (threshold - 1e-6)) + 1
    index = F.col("n") - F.ceil(F.col("n") * (2 * (threshold - 1e-6) / (1 + threshold))) + 1

    def keys(length: Column) -> DataFrame:
        first = F.slice("tokens", 1, F.greatest(length - F.col("alone"), F.lit(0)).cast("int"))
        each = placed.select("hash", "component", "keys", "n", "alone", F.posexplode(first).alias("at", "t"))
        return each.select("hash", "component", "keys", "n", (F.col("alone") + F.col("at")).alias("place"), F.col("t.token").alias("token"))

    small, large = keys(index), keys(probe).withColumnsRenamed({c: f"{c}2" for c in ("hash", "component", "keys", "n", "place")})
    met = small.join(large, "token").where("component <> component2 and (n < n2 or n = n2 and hash < hash2)")
    need = (F.col("n") + F.col("n2")) * ((threshold - 1e-6) / (1 + threshold))
    fine = met.where((F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) >= need) & F.arrays_overlap("keys", "keys2"))
    return fine.select(F.least("hash", "hash2").alias("a"), F.greatest("hash", "hash2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, *, width: int = 5, bands: int = 16, rows: int = 4, threshold: float = 0.8) -> DataFrame:
    """(id, class, component) of every row.

    class is the least id of the same content hash; component the least id that can be reached over pairs of
    classes that share a band and pass the check. Texts stay where they are: what is shuffled are hashes and bands,
    and the shingles of classes that share a band with another.

    In rounds, members of a bucket are linked to its least one, and those that were not go on, as long as a
    twentieth at least is linked; a round is linear. Then members of one bucket that are still of different
    components meet by the prefixes of their shingles. The rounds save work and change no result.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketched = checkpointed(sketches(texts.select("id", _marked(F.col("text"), width)), bands, rows))
    classes = checkpointed(sketched.groupBy("hash").agg(F.min("id").alias("id"), F.any_value("keys").alias("keys")))
    every = classes.where("keys is not null").select("hash", F.posexplode("keys").alias("band", "key"))
    sizes = every.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1").drop("m")
    left = banded = checkpointed(every.join(sizes, ["band", "key"]))
    needed = checkpointed(classes.join(banded.select("hash").distinct(), "hash").select(F.col("id").alias("first"), F.col("hash").alias("wanted")))
    # A class's first row has its shingles, so no other is cut again. Rows without an id are found by their content.
    same = F.col("first").eqNullSafe(F.col("id")) & F.when(F.col("first").isNull(), F.col("wanted")).eqNullSafe(F.when(F.col("id").isNull(), content_hash(F.col("text"))))
    chosen = texts.join(F.broadcast(needed) if needed.count() <= BROADCAST else needed, same)
    cut = checkpointed(chosen.select("wanted", _marked(F.col("text"), width)).where("hash = wanted").groupBy("hash").agg(F.any_value("s").alias("s")))
    links = checkpointed(banded.limit(0).select(F.col("hash").alias("a"), F.col("hash").alias("b")))
    while True:
        least = left.groupBy("band", "key").agg(F.min("hash").alias("a"), F.count("*").alias("m")).where("m > 1").drop("m")
        met = checkpointed(left.join(least, ["band", "key"]).where("hash <> a"))
        pairs = met.select("a", F.col("hash").alias("b")).distinct()
        new = checkpointed(_similar(pairs, cut, threshold))
        links = links.unionByName(new)
        found, tried = new.count(), met.count()
        left = met.join(new.withColumnRenamed("b", "hash"), ["a", "hash"], "left_anti").select("hash", "band", "key")
        if not tried or found < tried / 20 / bands:
            break
    member = checkpointed(_labelled(banded, links))
    live = member.groupBy("band", "key").agg(F.min("component").alias("first"), F.max("component").alias("last")).where("first < last").select("band", "key")
    open_ = member.join(live, ["band", "key"]).groupBy("hash", "component").agg(F.collect_set(F.struct("band", "key")).alias("keys"))  # one for each band at most
    more = checkpointed(_similar(prefix_pairs(checkpointed(open_), cut, threshold), cut, threshold))
    reached = checkpointed(_labelled(classes.select("hash", "id"), links.unionByName(more)))
    least = reached.groupBy("component").agg(F.min("id").alias("least"))
    named = reached.join(least, "component").select("hash", F.col("id").alias("class"), F.col("least").alias("component"))
    return sketched.select("id", "hash").join(named, "hash").select(F.col("id").alias(id_col), "class", "component")
