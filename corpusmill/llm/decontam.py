"""Benchmark decontamination: BM25 over the test items with block-max WAND, then an overlap check.

The index is over the test items; the queries are the training passages: windows of
twice an item's length, half overlapping, so that every stretch of an item's length
lies inside one. Items are indexed by classes of length (powers of two), each with
passages of its own width, so a long item doesn't widen the passages of short ones.
Item weights are BM25 weights divided by their sum, so a score is the weighted share
of an item that a passage has. Document frequencies and the mean length are those of
all items, so the classes, and shards of more than ``shard_items`` items, give every
item the same scores.

All items that score at least ``threshold`` are retrieved. A passage whose terms'
largest weights, or largest weights in each block of items, cannot reach the
threshold has no pivot and is left without walking a posting list; these bounds
are taken for many passages at once in numpy. The rest run block-max WAND.

A retrieved item counts if at least ``overlap`` of its five-word shingles stand
in the passage, and if its question and its answer (the last sentence, or the
last half of a single one) each share that much of their words.

Defined results: null or wordless texts and items match nothing; an item shorter
than five words is one shingle. Item ids may be of any type and null; items of the
same words are looked up once, with the least of their texts, and reported under each
id. Of several passages with an item the one of the largest overlap is reported, of
equal ones the first. Repeated rows of documents give repeated rows. Texts of any
length are cut into passages whole. Empty tables give no rows; other columns are
handed on by ``clean``, whatever their names, and not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from corpusmill.llm.common import checkpointed, text_blocks

#: ASCII characters that are no letters or digits part words.
_PARTS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def terms_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_PARTS).split() if text else []


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    sentences = [s for s in _SENTENCE.split(text) if terms_of(s)]
    if len(sentences) > 1:
        return terms_of(" ".join(sentences[:-1])), terms_of(sentences[-1])
    words = terms_of(text)
    half = (len(words) + 1) // 2
    return words[:half], words[half:]


def _shingles(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def _share(part: set, whole: set) -> float:
    return len(part & whole) / len(part) if part else 1.0


class BlockMaxIndex:
    """Postings of the items' BM25 weights, in blocks of items with the largest weight of each block.

    held: in how many of all ``n_all`` items each term is; mean: their mean length. Both may go beyond these items.
    Postings and block maxima of all terms lie in flat arrays, so their size is that of the postings.
    """

    def __init__(self, items: list[list[bytes]], held: dict[bytes, int], n_all: int, mean: float, *, k1: float = 1.2, b: float = 0.75, block: int = 4):
        self.block, self.n_blocks = block, -(-len(items) // block)
        self.term: dict[bytes, int] = {}
        terms, ids, weights = [], [], []
        for i, words in enumerate(items):
            size = k1 * (1 - b + b * len(words) / mean)
            each = {t: math.log(1 + (n_all - held[t] + 0.5) / (held[t] + 0.5)) * f * (k1 + 1) / (f + size) for t, f in Counter(words).items()}
            total = math.fsum(each.values())
            for t, w in each.items():
                terms.append(self.term.setdefault(t, len(self.term)))
                ids.append(i)
                weights.append(w / total)
        term, item, weight = np.array(terms, np.int32), np.array(ids, np.int32), np.array(weights)
        by = np.lexsort((item, term))
        term, self.item, self.weight = term[by], item[by], weight[by]
        self.start = np.searchsorted(term, np.arange(len(self.term) + 1))
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(term)), bool), (np.diff(term) != 0) | (np.diff(self.item // block) != 0)]))
        self.block_id = (self.item[first] // block).astype(np.int32)
        most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.block_most = most.astype(np.float32) * np.float32(1.000001)
        self.block_start = np.searchsorted(term[first], np.arange(len(self.term) + 1))
        self.list_max = np.maximum.reduceat(self.block_most, self.block_start[:-1]) if len(first) else np.zeros(0, np.float32)

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: every item whose score reaches the threshold, for distinct terms."""
        found: list[tuple[int, float]] = []
        lists = []
        for t in terms:
            here, blocks = slice(*self.start[t : t + 2]), slice(*self.block_start[t : t + 2])
            most = dict(zip(self.block_id[blocks].tolist(), self.block_most[blocks].tolist()))
            lists.append([self.item[here].tolist(), self.weight[here].tolist(), 0, float(self.list_max[t]), most])
        slack = threshold - 1e-9

        def advance(cursor: list, to: int) -> None:
            ids, at = cursor[0], cursor[2]
            while at < len(ids) and ids[at] < to:
                at += 1
            cursor[2] = at

        while lists:
            lists.sort(key=lambda c: c[0][c[2]])
            bound, pivot = 0.0, -1
            for i, c in enumerate(lists):
                bound += c[3]
                if bound >= slack:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = lists[pivot][0][lists[pivot][2]]
            last = pivot
            while last + 1 < len(lists) and lists[last + 1][0][lists[last + 1][2]] == item:
                last += 1
            here = item // self.block
            if sum(c[4].get(here, 0.0) for c in lists[: last + 1]) < slack:
                beyond = (here + 1) * self.block  # nothing before the next list's item, or in this block, can reach it
                if last + 1 < len(lists):
                    beyond = min(beyond, lists[last + 1][0][lists[last + 1][2]])
                for c in lists[: last + 1]:
                    advance(c, max(beyond, item + 1))
            elif lists[0][0][lists[0][2]] == item:
                score = math.fsum(c[1][c[2]] for c in lists[: last + 1])  # the same in any order
                for c in lists[: last + 1]:
                    c[2] += 1
                if score >= slack:
                    found.append((item, score))
            else:
                for c in lists[:pivot]:
                    advance(c, item)
            lists = [c for c in lists if c[2] < len(c[0])]
        return found

    def open_passages(self, ids: np.ndarray, owner: np.ndarray, n: int, threshold: float) -> np.ndarray:
        """Which of n passages may reach the threshold; ids are distinct terms, ordered by their passage (owner)."""
        slack = threshold - 1e-4  # sums of 32-bit floats
        bound = np.bincount(owner, self.list_max[ids], n)
        alive = np.flatnonzero(bound >= slack)
        if not len(alive):
            return alive
        mine = np.zeros(n, bool)
        mine[alive] = True
        keep = mine[owner]
        ids, owner = ids[keep], owner[keep]
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        size = np.diff(self.block_start)[ids]
        before = np.concatenate([[0], np.cumsum(size)])
        edges = np.append(starts, len(ids))
        best, a = np.zeros(len(starts), np.float32), 0
        while a < len(starts):  # so many passages that their sums, and what is summed, stay small
            b = int(np.searchsorted(before[edges], before[edges[a]] + 2_000_000, side="right")) - 1
            b = max(a + 1, min(b, a + max(1, 2_000_000 // max(1, self.n_blocks)), len(starts)))
            lo, hi = edges[a], edges[b]
            n_each = size[lo:hi]
            at = np.repeat(self.block_start[ids[lo:hi]] - (before[lo:hi] - before[lo]), n_each) + np.arange(int(n_each.sum()))
            passage = np.repeat(np.repeat(np.arange(b - a), np.diff(edges[a : b + 1])), n_each)
            sums = np.bincount(passage * self.n_blocks + self.block_id[at], self.block_most[at], (b - a) * self.n_blocks)
            best[a:b] = sums.reshape(b - a, self.n_blocks).max(axis=1)
            a = b
        return owner[starts[best >= slack]]


class ItemClass:
    """Items of like length with their index, and what the overlap check needs of them."""

    def __init__(self, items: list[tuple[int, list[bytes], str]], held: dict[bytes, int], n_all: int, mean: float, *, threshold: float, overlap: float, width: int = 5, block: int = 4):
        """items: key, words and text."""
        self.keys, self.words = [k for k, _, _ in items], [w for _, w, _ in items]
        self.index = BlockMaxIndex(self.words, held, n_all, mean, block=block)
        self.shingles = [_shingles(w, width) for w in self.words]
        self.parts = [tuple(map(set, question_and_answer(t))) for _, _, t in items]
        self.threshold, self.overlap, self.width = threshold, overlap, width
        self.stride = max(map(len, self.words))

    def matches(self, words: list[list[bytes]], out: list[dict[int, tuple[float, float, float, float]]]) -> None:
        """Adds to ``out``, for each text, the keys of the items found in it: score, and overlap of shingles, question and answer."""
        n = np.array(list(map(len, words)), np.int64)
        total, get, stride = int(n.sum()), self.index.term.get, self.stride
        if not total:
            return
        ids = np.fromiter((get(w, -1) for ws in words for w in ws), np.int64, total)
        # Stretches of one stride; passage k of a text is its stretches k and k + 1.
        first = np.cumsum(n) - n
        stretches = -(-n // stride)
        base = np.cumsum(stretches) - stretches
        row = np.repeat(np.arange(len(words)), n)
        stretch = base[row] + (np.arange(total) - first[row]) // stride
        known = ids >= 0
        ids, row, stretch = ids[known], row[known], stretch[known]
        earlier = stretch > base[row]
        size, n_passages = len(self.index.term), int(stretches.sum())
        keys = np.unique(np.concatenate([stretch * size + ids, (stretch[earlier] - 1) * size + ids[earlier]]))
        passage, term = keys // size, keys % size
        doc = np.repeat(np.arange(len(words)), stretches)
        for p in self.index.open_passages(term, passage, n_passages, self.threshold).tolist():
            lo, hi = np.searchsorted(passage, [p, p + 1])
            d, k = int(doc[p]), p - int(base[doc[p]])
            hits = self.index.search(term[lo:hi].tolist(), self.threshold)
            if hits:
                part = words[d][k * stride : (k + 2) * stride]
                have, single = _shingles(part, self.width), set(part)
                for item, score in hits:
                    whole = self.shingles[item]
                    if len(self.words[item]) < self.width:
                        near = float(any(part[i : i + len(self.words[item])] == self.words[item] for i in range(len(part))))
                    else:
                        near = _share(whole, have)
                    question, answer = (_share(x, single) for x in self.parts[item])
                    key = self.keys[item]
                    if min(near, question, answer) >= self.overlap and near > out[d].get(key, (0, -1.0))[1]:
                        out[d][key] = (score, near, question, answer)


class Benchmark:
    """A shard of the items, by classes of length."""

    def __init__(self, items: list[tuple[int, list[bytes], str]], held: dict[bytes, int], n_all: int, mean: float, **how):
        by_size: dict[int, list] = {}
        for item in items:
            by_size.setdefault((len(item[1]) - 1).bit_length(), []).append(item)
        self.classes = [ItemClass(by_size[size], held, n_all, mean, **how) for size in sorted(by_size)]

    def matches(self, texts: list[str | None]) -> list[dict[int, tuple[float, float, float, float]]]:
        out: list[dict] = [{} for _ in texts]
        words = [terms_of(t) for t in texts]
        for one in self.classes:
            one.matches(words, out)
        return out


_FOUND = ("score", "shingle_overlap", "question_overlap", "answer_overlap")


def _words_of() -> Column:
    def words(column: pa.Array) -> pa.Array:
        return pa.array([[w.decode() for w in terms_of(t)] for t in column.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(words, "array<string>")


class Items:
    """Test items by the hash of their words, with document frequencies over all of them, in shards that are collected one at a time."""

    def __init__(self, items: DataFrame, *, item_col: str, text_col: str, shard_items: int):
        text = F.col(text_col)
        named = items.select(F.col(item_col).alias("item_id"), text.alias("text"), _words_of()(text).alias("words")).where(F.size("words") > 0)
        self.named = checkpointed(named.withColumn("key", F.xxhash64("words")))
        self.distinct = self.named.groupBy("key").agg(F.first("words").alias("words"), F.min("text").alias("text"))
        self.n, self.mean = self.distinct.agg(F.count("*"), F.coalesce(F.avg(F.size("words")), F.lit(1.0))).first()
        self.shards = max(1, -(-self.n // shard_items))

    def shard(self, number: int) -> tuple[list[Row], dict[bytes, int]]:
        """About ``shard_items`` items, and the frequencies of their terms."""
        terms = self.distinct.select("key", F.explode(F.array_distinct("words")).alias("term"))
        mine = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(self.shards)) == number
        held = terms.groupBy("term").count()
        asked = terms.where(mine).select("term").distinct()
        return self.distinct.where(mine).orderBy("key").collect(), {r[0].encode(): r[1] for r in held.join(asked, "term").collect()}


def _shards(docs: DataFrame, items: DataFrame, *, item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.6, overlap: float = 0.8, shard_items: int = 20_000) -> tuple[Items, Iterator]:
    """The items, and the broadcast index of one shard of them after the other. What is broadcast holds about ``shard_items`` items."""
    known = Items(items, item_col=item_col, text_col=item_text_col, shard_items=shard_items)

    def each() -> Iterator:
        for number in range(known.shards):
            rows, held = known.shard(number)
            shard = [(r.key, [w.encode() for w in r.words], r.text) for r in rows]
            yield docs.sparkSession.sparkContext.broadcast(Benchmark(shard, held, known.n, known.mean, threshold=threshold, overlap=overlap))

    return known, each()


def _rows(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = sent.value
        for batch in batches:
            found = [(at + i, key, *v) for at, texts in text_blocks(batch.column(1)) for i, m in enumerate(bench.matches(texts)) for key, v in m.items()]
            at, key, *values = zip(*found) if found else [[]] * (2 + len(_FOUND))
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(key, pa.int64()), *(pa.array(v, pa.float64()) for v in values)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "key", *_FOUND])

    return run


def _untouched(sent):
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bench = sent.value
        for batch in batches:
            yield pa.array([not m for _, texts in text_blocks(batch) for m in bench.matches(texts)], pa.bool_())

    return F.arrow_udf(match, "boolean", F.ArrowUDFType.SCALAR_ITER)


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each document and test item found in it.

    A pass over the texts for each shard; a plain join by the items' hash gives their ids.
    """
    known, shards = _shards(docs, items, **how)
    asked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, key bigint, " + ", ".join(f"{n} double" for n in _FOUND)
    found = [asked.mapInArrow(_rows(sent), schema) for sent in shards]
    return reduce(DataFrame.unionByName, found).join(known.named.select("key", "item_id"), "key").select(F.col("id").alias(id_col), "item_id", *_FOUND)


def clean(docs: DataFrame, items: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """The documents, all columns, in which no test item is found. Each shard leaves fewer to the next one."""
    known, shards = _shards(docs, items, **how)
    for number, sent in enumerate(shards):
        docs = docs.where(_untouched(sent)(F.col(text_col)))
        if number + 1 < known.shards:
            docs = checkpointed(docs)
    return docs
