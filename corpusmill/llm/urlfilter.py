"""URL filters: a Bloom filter cascade over listed hosts, under a few path rules.

A key is a host or one of its parent domains, of no more characters than the longest listed
key has: longer ones cannot be listed, and are not asked. Level 0 is a Bloom filter of the
listed keys; level 1 holds the keys of the corpus that level 0 lets through
wrongly; level 2 the listed keys that level 1 lets through wrongly; and so on
until a level lets nothing through wrongly. Over the corpus's own keys, all of
which were asked at every level, the answer is exact, and asking is a few bit
tests: no join with the list.

Level 0 lets through as many keys of the corpus as would make level 1 about as large,
and every later level a share of ``rate``; so levels alternate and shrink by that share.
The cascade grows with the listed keys and with what level 0 lets through, not with the
corpus. It is broadcast; one of over ``most_bytes`` raises before it is gathered.

Defined results: a null url, or one without ``://``, has empty host and path, and
no key, so it is allowed unless a rule fits. Of rules of one length the last in order
wins. Repeated rows give repeated rows, and repeated or null keys of the list count
once or not at all. An empty list allows everything; an empty table gives no rows.
Urls of any length are read whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, most: int) -> Column:
    """The host and its parent domains, without empty ones and those of over ``most`` characters.

    Only the last ``most`` characters and the one before are cut into labels, so a host of any length costs no more.
    """
    labels = F.split(F.right(host, F.lit(most + 1)), r"\.", -1)
    each = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.filter(each, lambda k: (k != "") & (F.length(k) <= most))


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (null: none)."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # later ones override, so the longest wins
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: bytes

    def has(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        held = np.frombuffer(self.words, np.uint64)
        out = np.ones(len(first), bool)
        for i in range(self.hashes):
            at = (first + np.uint64(i) * second) % np.uint64(self.bits)
            out &= (held[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def _seeds(level: int) -> tuple[int, int]:
    return 2 * level + 1, 2 * level + 2


def _hash(key: Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed))


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    @property
    def size(self) -> int:
        return sum(len(x.words) for x in self.levels)

    def has(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """pairs: the two hashes of each key, for each level. The first level that refuses a key tells: an odd one that it is listed, an even one that it is not."""
        n = len(pairs[0][0]) if pairs else 0
        answer = np.full(n, len(self.levels) % 2 == 1)
        open_ = np.ones(n, bool)
        for k, level in enumerate(self.levels):
            refused = open_ & ~level.has(*pairs[k])
            answer[refused] = k % 2 == 1
            open_ &= ~refused
        return answer


def _bits(n: int, rate: float) -> int:
    return max(64, 64 * math.ceil(n * -math.log2(rate) / math.log(2) / 64))


def _bloom(keys: DataFrame, level: int, n: int, rate: float) -> Level:
    """Bits are set by an aggregation that ors 64-bit words: its result has a row for each word, whatever the input."""
    bits, hashes = _bits(n, rate), max(1, round(-math.log2(rate)))
    a, b = _seeds(level)
    # The halves have 40 bits, so that sums with a few multiples stay positive longs.
    places = F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(F.col("a") + i * F.col("b"), F.lit(bits)))
    top = lambda seed: F.pmod(_hash(F.col("key"), seed), F.lit(1 << 40))
    at = keys.select(top(a).alias("a"), top(b).alias("b")).select(F.explode(places).alias("at"))
    words = at.groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits"))
    held = np.zeros(bits // 64, np.uint64)
    got = words.toPandas()
    held[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return Level(bits, hashes, held.tobytes())


def _tested(keys: DataFrame, level: Level, k: int) -> DataFrame:
    """The keys that a level lets through."""
    sent = keys.sparkSession.sparkContext.broadcast(level)
    a, b = _seeds(k)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            first, second = (batch.field(i).to_numpy(zero_copy_only=False).astype(np.uint64) for i in (0, 1))
            yield pa.array(sent.value.has(first, second))

    test = F.arrow_udf(run, "boolean", F.ArrowUDFType.SCALAR_ITER)
    top = lambda seed: F.pmod(_hash(F.col("key"), seed), F.lit(1 << 40))
    return keys.where(test(F.struct(top(a).alias("a"), top(b).alias("b"))))


def build(universe: DataFrame, listed: DataFrame, *, rate: float = 0.125, most_levels: int = 64, most_bytes: int = 256 << 20) -> Cascade:
    """universe: distinct keys; listed: keys (one column each). Membership is exact for every key of the universe.

    Every level is checkpointed with the count of what it lets through wrongly, so a loss costs one level.
    Each level refuses all but a share of its keys with hashes of its own, so ``most_levels`` are never reached
    but for keys of equal hashes in all of them; then this raises.
    """
    listed = checkpointed(listed.toDF("key").where("key is not null").distinct())
    universe = checkpointed(universe.toDF("key"))
    inside, outside, levels = listed, universe, []
    n, share = inside.count(), rate
    while n:
        if not levels:
            share = min(rate, max(1e-6, n / max(1, universe.count()) / math.sqrt(2)))
        if len(levels) == most_levels:
            raise ValueError(f"{n} keys are still open after {most_levels} levels")
        if _bits(n, share) // 8 + sum(len(x.words) for x in levels) > most_bytes:
            raise ValueError(f"the cascade would have over {most_bytes} bytes; split the list")
        level = _bloom(inside, len(levels), n, share)
        through = _tested(outside, level, len(levels))
        if not levels:
            through = through.join(listed, "key", "left_anti")  # of the universe only what level 0 lets through
        inside, outside = checkpointed(through), inside
        levels.append(level)
        n, share = inside.count(), rate
    return Cascade(levels)


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url", **how) -> DataFrame:
    """Per row: host, path, the rule that fits (null: none), and allow or block."""
    spark = pages.sparkSession
    listed = listed.toDF("key")
    most = listed.agg(F.coalesce(F.max(F.length("key")), F.lit(0))).first()[0]
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    universe = urls.select("host").distinct().select(F.explode(keys_of(F.col("host"), most)).alias("key")).distinct()
    cascade = build(universe, listed, **how)
    sent = spark.sparkContext.broadcast(cascade)
    depth = len(cascade.levels)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """Hashes of every key of each row (key by key, two for each level) -> whether any key is listed."""
        for batch in batches:
            flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.uint64).reshape(-1, 2 * depth)
            hit = sent.value.has([(flat[:, 2 * k], flat[:, 2 * k + 1]) for k in range(depth)])
            ends = np.concatenate([[0], np.cumsum(hit)])
            offsets = (batch.offsets.to_numpy() - batch.offsets[0].as_py()) // (2 * depth)
            yield pa.array(ends[offsets[1:]] > ends[offsets[:-1]])

    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    if depth:
        seeds = [s for k in range(depth) for s in _seeds(k)]
        hashes = F.flatten(F.transform(keys_of(F.col("host"), most), lambda key: F.array(*[F.pmod(_hash(key, s), F.lit(1 << 40)) for s in seeds])))
        blocked = F.arrow_udf(run, "boolean", F.ArrowUDFType.SCALAR_ITER)(hashes)
    else:
        blocked = F.lit(False)
    out = urls.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), blocked.alias("listed"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed")
