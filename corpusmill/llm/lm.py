"""Language-model scoring with a weighted backoff automaton.

The model holds every word and every n-gram up to ``order`` of the training texts,
whatever its count. With c for counts, its probabilities are

    P(w)      = (c(w) + 0.1) / (N + 0.1 * (V + 1))
    P(w | hv) = (c(hvw) + m * P(w | v)) / (c(hv) + m)

where ``strength`` m is the weight of the shorter history (a Dirichlet prior). They
sum to one. As an automaton: every n-gram shorter than ``order`` is a state, and the
root has no word. On a word a state has an arc, with weight log10 P, where the longer
n-gram was seen; else its failure arc leads to the state of the shorter history, with
weight log10 (m / (c + m)). The root has an arc for every word, seen or not.

An automaton of a whole corpus fits no worker, and none needs all of it. The texts are
cut into blocks of ``block_bytes``. Each block asks for the counts of the distinct
n-grams in it, by hash, in sorted runs that go to ``buckets`` of the key; a bucket adds
up what the blocks hold and sends every block its counts in the same order. With these
the block has the part of the automaton that its texts can reach, and one traversal
from left to right carries the state and adds up weights. The state after a token
depends on the last words alone, so numpy does the traversal for all tokens of a
block at once; following a failure arc is a step back in the order.

So all rows are hashed evenly, a frequent n-gram comes once from each block, and
nothing is sent to the driver but sums. Words go by 62-bit hashes and
longer n-grams by 53-bit ones.

Defined results: a null or empty text has the end token alone. Repeated rows, ties
and repeated ids get the same result each; extra columns are not read, whatever their
names. A text longer than a block is a block of its own. Without training texts
N = V = 0 and every token has probability one. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import checkpointed

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODEC = pa.Codec("zstd", 9)
#: Bits of the keys of words and of longer n-grams.
WORD_BITS, GRAM_BITS = 62, 54


def _compressed(data: bytes) -> bytes:
    return _CODEC.compress(data, asbytes=True)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each token, tokens in each text, hash of each number); number 0 is the end."""
    column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    word = ~_SPACE[data]
    before = np.concatenate([[False], word[:-1]])[: len(word)]
    before[offsets[:-1][np.diff(offsets) > 0]] = False  # texts lie side by side
    starts = np.flatnonzero(word & ~before)
    # An empty text shares its offset with the next one; the last of those has the bytes.
    of = np.searchsorted(offsets[:-1], starts, side="right") - 1
    letters = np.concatenate([[0], np.cumsum(word)])
    ends = np.append(letters[starts], letters[-1]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[data[word]])]).dictionary_encode()
    n = np.bincount(of, minlength=len(column)) + 1
    number = np.zeros(len(starts) + len(column), np.int32)
    number[np.arange(len(starts)) + of] = words.indices.to_numpy(zero_copy_only=False) + 1
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in [b" end", *words.dictionary.to_pylist()]), np.uint64, len(words.dictionary) + 1)
    return number, n, hashes


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def places_inside(n: np.ndarray) -> np.ndarray:
    """For each token the number of tokens before it in its text."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def ngram_keys(number: np.ndarray, n: np.ndarray, hashes: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order (places, keys): where n-grams of this order end, and their keys.

    Words have keys of WORD_BITS; longer n-grams of GRAM_BITS, the highest of which says the order.
    """
    word = hashes[number]
    inside = places_inside(n)
    hashed, found = word, [(np.arange(len(number)), word >> np.uint64(64 - WORD_BITS))]
    for k in range(2, order + 1):
        at = np.flatnonzero(inside >= k - 1)
        longer = np.zeros(len(number), np.uint64)
        longer[at] = _mixed(hashed[at - 1] * np.uint64(0x9E3779B97F4A7C15) + word[at] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k))
        hashed = longer
        found.append((at, hashed[at] >> np.uint64(65 - GRAM_BITS) | np.uint64((k & 1) << GRAM_BITS - 1)))
    return found


def packed(values: np.ndarray) -> bytes:
    """Unsigned values by planes of their bytes, without the planes that are zero, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    used = 8
    while used > 1 and not planes[used - 1].any():
        used -= 1
    return bytes([used]) + _compressed(planes[:used].tobytes())


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.zeros((8, n), np.uint8)
    planes[: data[0]] = np.frombuffer(_CODEC.decompress(data[1:], data[0] * n, asbytes=True), np.uint8).reshape(data[0], n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(n)


_BLOCK = "block bigint, id array<{kind}>, training array<boolean>, sizes array<int>, size bigint, texts binary"


def blocks_of(docs: DataFrame, training: Column, *, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """The texts in blocks of whole texts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at = TaskContext.get().partitionId(), 0
        waiting: list[pa.RecordBatch] = []
        held = 0

        def out() -> pa.RecordBatch:
            nonlocal at, waiting, held
            rows = pa.Table.from_batches(waiting).combine_chunks()
            texts = pc.cast(pc.fill_null(rows.column("text").chunk(0), ""), pa.binary())
            sizes = pc.binary_length(texts)
            data = b"".join(texts.to_pylist())
            whole = pa.array([0, len(texts)], pa.int32())
            lists = [pa.ListArray.from_arrays(whole, x) for x in (rows.column("id").chunk(0), rows.column("training").chunk(0), sizes)]
            made = [pa.array([task << 33 | at], pa.int64()), *lists, pa.array([len(data)], pa.int64()), pa.array([_compressed(data)], pa.binary())]
            at, waiting, held = at + 1, [], 0
            return pa.RecordBatch.from_arrays(made, names=["block", "id", "training", "sizes", "size", "texts"])

        for batch in batches:
            ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)).astype(np.int64))
            row = 0
            while row < len(ends):
                upto = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + block_bytes - held, side="right")))
                waiting.append(batch.slice(row, upto - row))
                held += int(ends[upto - 1] - (ends[row - 1] if row else 0))
                row = upto
                if held >= block_bytes or row < len(ends):
                    yield out()
        if waiting:
            yield out()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    return rows.mapInArrow(run, _BLOCK.format(kind=kind))


def _block_tokens(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = pa.array(np.cumsum([0, *block["sizes"]]).astype(np.int32))
    texts = _CODEC.decompress(block["texts"], block["size"])
    return tokens(pa.Array.from_buffers(pa.string(), len(block["sizes"]), [None, ends.buffers()[1], texts]))


def _summed(keys: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, and how often they stand where ``other`` is false."""
    marked = keys << np.uint64(1) | other.astype(np.uint64)
    marked.sort()
    keys = marked >> np.uint64(1)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(~marked & np.uint64(1), first) if len(first) else np.zeros(0, np.uint64)


def _runs(block: int, keys: np.ndarray, counts: np.ndarray, width: int, bits: int) -> Iterator[tuple]:
    """Rows of ``asked``, for each bucket that has keys."""
    shift = np.uint64(width - bits)
    cuts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << shift)
    cuts = np.append(cuts, len(keys))
    for bucket in np.flatnonzero(np.diff(cuts)).tolist():
        lo, hi = cuts[bucket], cuts[bucket + 1]
        steps = np.diff(keys[lo:hi], prepend=np.uint64(bucket) << shift)
        yield block, bucket if width == GRAM_BITS else -1 - bucket, int(hi - lo), packed(steps), packed(counts[lo:hi])


_ASKED = "block bigint, bucket bigint, n int, keys binary, counts binary"
_ASKED_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def asked(blocks: DataFrame, *, order: int, bits: int) -> DataFrame:
    """What each block asks of each bucket, the first bits of a key: the distinct keys, in order, and their number in its training texts.

    Words have buckets of their own, below 0; half of the others is for either order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                (block,) = batch.slice(at, 1).to_pylist()
                number, n, hashes = _block_tokens(block)
                other = np.repeat(~np.array(block["training"], bool), n)
                rows = []
                for k, (place, keys) in enumerate(ngram_keys(number, n, hashes, order)):
                    rows += _runs(block["block"], *_summed(keys, other[place]), GRAM_BITS if k else WORD_BITS, bits if k else max(0, bits - 4))
                for part in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[part : part + 4096]), _ASKED_ARROW)], schema=_ASKED_ARROW)

    return blocks.mapInArrow(run, _ASKED)


_TOLD = "block bigint, bucket bigint, n int, counts binary, tokens bigint, words bigint"
_TOLD_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("n", pa.int32()), ("counts", pa.binary()), ("tokens", pa.int64()), ("words", pa.int64())])


def told(wanted: DataFrame) -> DataFrame:
    """The counts over all blocks, in the order in which each block asked; and, on one row of each bucket of words, its training tokens and distinct words."""

    def run(group: pa.Table) -> pa.Table:
        sizes = group.column("n").to_numpy()
        # Every run starts from the first key of its bucket; that key cancels out here.
        keys = np.concatenate([np.cumsum(unpacked(d, n), dtype=np.uint64) for d, n in zip(group.column("keys").to_pylist(), sizes)])
        counts = np.concatenate([unpacked(d, n) for d, n in zip(group.column("counts").to_pylist(), sizes)])
        unique, place = np.unique(keys, return_inverse=True)
        total = np.bincount(place, counts.astype(np.float64), len(unique)).astype(np.uint64)
        answer, ends = total[place], np.cumsum(sizes)
        tokens, words = np.zeros((2, len(sizes)), np.int64)
        if group.column("bucket")[0].as_py() < 0:
            tokens[0], words[0] = int(total.sum()), int(np.count_nonzero(total))
        back = pa.array([packed(answer[e - n : e]) for e, n in zip(ends, sizes)], pa.binary())
        return pa.Table.from_arrays([group.column("block"), group.column("bucket"), group.column("n"), back, pa.array(tokens), pa.array(words)], schema=_TOLD_ARROW)

    return wanted.groupBy("bucket").applyInArrow(run, _TOLD)


def _seen(block: dict, answers: pa.Table, order: int, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Tokens in each text, and for each order the count of the n-gram that ends at each token."""
    number, n, hashes = _block_tokens(block)
    bucket = answers.column("bucket").to_numpy()
    parts, sizes = answers.column("counts").to_pylist(), answers.column("n").to_numpy()
    seen = []
    for k, (place, keys) in enumerate(ngram_keys(number, n, hashes, order)):
        mine = np.flatnonzero((bucket >= 0) & (bucket >> bits - 1 == (k + 1) % 2) if k else bucket < 0)
        by = mine[np.argsort(np.abs(bucket[mine]), kind="stable")]
        told = np.concatenate([unpacked(parts[i], sizes[i]) for i in by.tolist()] or [np.zeros(0, np.uint64)])
        seen.append(np.zeros(len(number)))
        seen[-1][place] = told[np.unique(keys, return_inverse=True)[1]]
    return n, seen


class Automaton:
    """The part of the automaton that one block can reach: for each order the count of the n-gram that ends at each token."""

    def __init__(self, seen: list[np.ndarray], inside: np.ndarray, total: int, distinct: int, strength: float):
        self.seen, self.inside, self.total, self.distinct, self.strength = seen, inside, total, distinct, strength

    def traverse(self) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities of all tokens by their unigrams, and by the whole model."""
        order, m = len(self.seen), self.strength
        arc = [(self.seen[0] + 0.1) / (self.total + 0.1 * (self.distinct + 1))]
        base = np.log10(arc[0])
        for k in range(1, order):
            context = np.concatenate([[0.0], self.seen[k - 1][:-1]])
            arc.append((self.seen[k] + m * arc[k - 1]) / (context + m))
        # The state before a token: words of the longest history that was seen.
        state = np.zeros(len(base), np.int64)
        for k in range(1, order):
            state[1:][(self.seen[k - 1][:-1] > 0) & (self.inside[1:] >= k)] = k
        return base, self._walk(state, arc, m)

    def _walk(self, state: np.ndarray, arc: list[np.ndarray], m: float) -> np.ndarray:
        weight, at = np.zeros(len(state)), np.arange(len(state))
        for k in range(len(arc) - 1, 0, -1):
            here = at[state[at] == k]
            has = self.seen[k][here] > 0
            weight[here[has]] += np.log10(arc[k][here[has]])
            fails = here[~has]
            weight[fails] += np.log10(m / (self.seen[k - 1][fails - 1] + m))
            state[fails] = k - 1
            state[here[has]] = -1
        root = at[state == 0]
        weight[root] += np.log10(arc[0][root])
        return weight


def score(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", order: int = 3, strength: float = 256.0, block_bytes: int = 16_000_000, bucket_bytes: int = 4_000_000) -> DataFrame:
    """Per row: held_out, n_tokens, n_known, train_tokens, base_score and score. The rows that are not held out are the training texts.

    The default ``strength`` was chosen within training texts: of 4, 16, 64, 256 and 1024 it gave those with crc32 modulo 10
    equal to 1 the highest probability after learning from those with 2 to 9. No held-out text took part.
    """
    if not 1 <= order <= 3:
        raise ValueError("order: from 1 to 3")  # one bit of a key
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = checkpointed(blocks_of(docs, ~held_out, id_col=id_col, text_col=text_col, block_bytes=block_bytes))
    size = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bits = 1 + (size // (2 * bucket_bytes)).bit_length()
    counts = checkpointed(told(asked(blocks, order=order, bits=bits)))
    total, distinct = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()

    def run(mine: pa.Table, answers: pa.Table) -> pa.Table:
        (block,) = mine.to_pylist()
        n, seen = _seen(block, answers, order, bits)
        base, weight = Automaton(seen, places_inside(n), total, distinct, strength).traverse()
        starts = np.cumsum(n) - n
        known = np.add.reduceat((seen[0] > 0).astype(np.int64), starts)
        columns = [mine.column("id").combine_chunks().flatten(), pa.array(~np.array(block["training"], bool)), pa.array(n), pa.array(known), pa.array(np.full(len(n), total, np.int64)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(weight, starts))]
        return pa.table(columns, names=names)

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(run, schema)
