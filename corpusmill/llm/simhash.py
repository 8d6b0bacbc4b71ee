"""SimHash near-duplicates, with pigeonring filtering of candidates.

A 64-bit fingerprint is cut into a ring of m segments. If two fingerprints
differ in at most t bits, some segment starts a chain of consecutive segments in
which the first l differ in at most l*t/m bits, for every l. Written out for the
first few segments of a chain this says which segments must be equal, and those
are the join keys; what meets there must pass the whole chain test before the
full Hamming check.

Equal fingerprints are one class, so copies meet only once. Classes that meet under
a key may still be many. They agree in the key's segments, so all their differing
bits lie in the others: these are cut into a ring of their own, finer, whose chains
give further segments that must be equal. So large buckets are split until they
have few classes, or so few free bits that these bound them.

Defined results: null or wordless texts have fingerprint zero and are linked
like any other; fewer than three words make one shingle. A row without an id links
others like any row, but never names a component; one of such rows alone has none.
Repeated rows give repeated rows, an empty table none.
Bits that half the hashes have are 0. Texts of any length are hashed whole; other
columns are not read, whatever their names, and ``keep_one`` hands them on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import ascii_words, checkpointed, text_blocks
from corpusmill.operators.graph import connected_components

BITS = 64
#: For each byte its bits as eight counters of eight bits.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def shingle_hashes(text: str | None, width: int = 3, seed: int = 42) -> Iterator[int]:
    words = ascii_words(text)
    if not words:
        return iter(())
    parts = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return map(partial(xxhash.xxh64_intdigest, seed=seed), parts)


def fingerprints_of(texts: list[str | None], width: int = 3, seed: int = 42) -> np.ndarray:
    """A fingerprint for each text: bit i is set if it is set in over half the shingle hashes."""
    each = [np.fromiter(shingle_hashes(t, width, seed), np.uint64) for t in texts]
    n = np.array([len(h) for h in each], np.int64)
    out = np.zeros(len(texts), np.uint64)
    if not n.sum():
        return out
    hashes = np.concatenate(each)
    # Counters of eight bits hold 255 hashes: cut each text's hashes at every 255th.
    starts, first = [], np.cumsum(n) - n
    pieces = -(-n // 255)
    starts = np.repeat(first, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    sums = np.add.reduceat(_LANES[hashes.view(np.uint8).reshape(-1, 8)], starts, axis=0)
    counts = sums.view(np.uint8).reshape(len(starts), BITS).astype(np.int64)
    full = np.flatnonzero(n)
    counts = np.add.reduceat(counts, (np.cumsum(pieces) - pieces)[full], axis=0)
    out[full] = np.packbits(2 * counts > n[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text, as a signed long. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints_of(texts, width, seed) for _, texts in text_blocks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def ring(segments: int, bits: list[int] | None = None) -> list[list[int]]:
    """The bits of each segment, of all bits or of some."""
    bits = list(range(BITS)) if bits is None else bits
    edges = [len(bits) * i // segments for i in range(segments + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:])]


def budgets(segments: int, distance: int) -> list[int]:
    return [(i + 1) * distance // segments for i in range(segments)]


def chain_keys(segments: int, distance: int, length: int) -> list[tuple[int, ...]]:
    """The sets of segments that are equal in some chain: what its first ``length`` segments may differ in, worked out."""
    allowed = budgets(segments, distance)[:length]
    most = allowed[-1]
    keys = set()
    for uneven in combinations(range(length), most):
        if all(sum(u <= i for u in uneven) <= b for i, b in enumerate(allowed)):
            keys |= {tuple(sorted((start + i) % segments for i in range(length) if i not in uneven)) for start in range(segments)}
    return sorted(keys)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _mask(places: list[list[int]]) -> int:
    return sum(1 << b for place in places for b in place)


def chain_test(x: Column, segments: int, distance: int) -> Column:
    """Whether the differing bits x pass a chain from some start around the whole ring."""
    counts = [F.bit_count(x.bitwiseAND(F.lit(_signed(_mask([s]))))) for s in ring(segments)]
    found = F.lit(False)
    for start in range(segments):
        total, good = F.lit(0), F.lit(True)
        for i, most in enumerate(budgets(segments, distance)):
            total = total + counts[(start + i) % segments]
            good = good & (total <= most)
        found = found | good
    return found


def _masks(free: list[int], segments: int, distance: int, length: int) -> list[int]:
    """For a ring over the free bits, the masks of what is equal in some chain."""
    places = ring(segments, free)
    return [_mask([places[i] for i in k]) for k in chain_keys(segments, distance, length)]


def links(classes: DataFrame, *, distance: int = 2, segments: int = 4, length: int = 3, few: int = 32, least_bits: int = 8) -> DataFrame:
    """classes (fp), each once -> edges (src, dst) between the fingerprints that are within the distance.

    Buckets of over ``few`` classes are split by a ring over their free bits, down to ``least_bits`` of them.
    """
    spark = classes.sparkSession
    buckets, every = classes.select("fp", F.lit(0).cast("bigint").alias("mask")), []
    known = {0: list(range(BITS))}
    while known:
        finer = {m: [m | more for more in _masks(free, segments, distance, length)] for m, free in known.items()}
        rows = [(_signed(m), _signed(k)) for m, keys in finer.items() for k in keys]
        keys = F.broadcast(spark.createDataFrame(rows, "mask bigint, key bigint"))  # fixed by the parameters, not by the data
        keyed = buckets.join(keys, "mask").select("fp", F.col("key").alias("mask"), F.col("fp").bitwiseAND(F.col("key")).alias("part"))
        keyed = keyed.distinct() if every else keyed  # finer keys can be reached by several ways
        sizes = keyed.groupBy("mask", "part").agg(F.count("*").alias("n")).where("n > 1")
        met = checkpointed(keyed.join(sizes, ["mask", "part"]))
        known = {k: free for m in finer for k in finer[m] if len(free := [b for b in range(BITS) if not k >> b & 1]) > least_bits}
        split = (F.col("n") > few) & F.col("mask").isin([_signed(k) for k in known])
        one = met.where(~split).select("mask", "part", "fp")
        other = one.select("mask", "part", F.col("fp").alias("fp2"))
        apart = F.col("fp").bitwiseXOR(F.col("fp2"))
        near = one.join(other, ["mask", "part"]).where(F.col("fp") < F.col("fp2")).where(chain_test(apart, segments, distance)).where(F.bit_count(apart) <= distance)
        every.append(near.select(F.col("fp").alias("src"), F.col("fp2").alias("dst")))
        buckets = met.where(split).select("fp", "mask")
        if not known or buckets.isEmpty():
            break
    return reduce(DataFrame.unionByName, every).distinct()


def components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, distance: int = 2, segments: int = 4, length: int = 3) -> DataFrame:
    """(id, fp, component) for each row: component is the least id whose fingerprint can be reached by links."""
    prints = checkpointed(fingerprints(docs, id_col=id_col, text_col=text_col, width=width, seed=seed))
    classes = checkpointed(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    reached = connected_components(links(classes.select("fp"), distance=distance, segments=segments, length=length))
    linked = checkpointed(classes.join(reached, classes.fp == reached.node).select("fp", "rep", F.col("component").alias("root")))
    least = linked.groupBy("root").agg(F.min("rep").alias("least")).withColumnRenamed("root", "top")
    named = linked.join(least, linked.root == least.top).select(F.col("fp").alias("linked"), "least")
    labelled = classes.join(named, classes.fp == named.linked, "left").select(F.col("fp").alias("class"), F.when(F.col("linked").isNotNull(), F.col("least")).otherwise(F.col("rep")).alias("component"))
    return prints.join(labelled, prints.fp == labelled["class"]).select("id", "fp", "component")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row."""
    found = components(docs, id_col=id_col, text_col=text_col, **how)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One document of each component stays: the one with the least id.

    Rows without an id stay. Of repeated rows with one id that of the least text hash stays, then that of the least
    hash of the whole row; only those rows are compared by id.
    """
    found = components(docs, id_col=id_col, text_col=text_col, **how)
    per_id = checkpointed(found.groupBy("id").agg(F.min("component").alias("component"), F.count("*").alias("copies")).where("id is not null and (id <> component or copies > 1)"))
    gone = per_id.where("id <> component").select(F.col("id").alias(id_col))
    kept = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    repeated = per_id.where("id = component").select(F.col("id").alias(id_col))
    if repeated.isEmpty():
        return kept
    order = F.struct(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), F.sha2(F.to_json(F.struct(*docs.columns)), 256))
    once = kept.join(repeated, id_col, "left_semi").groupBy(id_col).agg(F.min_by(F.struct(*docs.columns), order).alias("__row")).select("__row.*")
    return kept.join(repeated, id_col, "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
