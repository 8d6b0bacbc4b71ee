"""BPE encoding and decoding by speculation and verification.

Every distinct piece of text is first cut by greedy longest match. A proposal is
right exactly when no merge could ever have crossed one of its borders, and that
holds when every two adjacent tokens are compatible: merging the text of both
alone gives the same two tokens. Compatibility is tested for all pairs of a
batch at once in numpy, by undoing the latest merge on either side step by step.
Only pieces that fail are merged exactly.

Defined results: a null or empty text has no tokens (0, hash of the empty
string). Repeated rows give repeated rows; other columns of the input are
ignored unless asked for. Very long texts and very long words are handled in
O(n log n). Text that cannot be UTF-8 (lone surrogates) cannot occur in Spark. An
empty table gives no rows; of merges of one rank the leftmost is made first.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import text_blocks

_WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_NOT_WHITE = regex.compile(f"[^{_WHITE}]+")
#: str.split() also splits at these, which are no white space to the tokenizer.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
_NEVER = np.int64(1) << 40


def _byte_chars() -> dict[int, str]:
    """Printable stand-ins for the 256 bytes: printable Latin-1 stands for itself, the rest follows from U+0100."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """A BPE vocabulary with end-of-word suffix, read from the JSON of a public tokenizer file."""

    def __init__(self, spec: str | bytes):
        spec = json.loads(spec)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.size = size
        self.names = [""] * size
        for name, i in [*self.vocab.items(), *self.special.items()]:
            self.names[i] = name
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern)
        self.cut_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        #: The longest token that begins with each three characters.
        self.longest: dict[str, int] = {}
        for name in self.vocab:
            bare = name.removesuffix(self.suffix)
            self.longest[bare[:3]] = max(self.longest.get(bare[:3], 2), len(bare))
        self.bytes_as = _byte_chars()
        self._learn(model["merges"], size)

    def _learn(self, merges: list, size: int) -> None:
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.merge: dict[int, int] = {}
        self.made: list[int] = []
        sound = np.ones(size, bool)
        for r, (a, b) in enumerate(pairs):
            ia, ib, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merge.setdefault(ia * size + ib, r)
            self.made.append(made)
            if self.rank[made] >= 0 or self.rank[ia] >= r or self.rank[ib] >= r:
                sound[made] = False  # made in two ways, or before its parts: such tokens always go to exact merging
                continue
            self.rank[made], self.left[made], self.right[made] = r, ia, ib
        self.made_ids = np.array(self.made, np.int64)
        self.start = {c: i for c, i in self.vocab.items() if len(c) == 1}
        keys = np.array(list(self.merge), np.int64)
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.int64(-1) & ((1 << 62) - 1))
        self.pair_ranks = np.append(np.array(list(self.merge.values()), np.int64)[order], _NEVER)
        # A token is stable if merging its own text gives it back.
        made = np.flatnonzero(self.rank >= 0)
        made = made[np.argsort(self.rank[made])]
        fine = self.compatible(self.left[made], self.right[made], self.rank[made])
        self.stable = sound.copy()
        for t, ok in zip(made.tolist(), fine.tolist()):
            self.stable[t] &= ok and self.stable[self.left[t]] and self.stable[self.right[t]]

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.size + b
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether each border between tokens a[i] and b[i] is one that no merge of a rank under the limit crosses."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), _NEVER) if limit is None else limit.astype(np.int64)
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        while len(at):
            x, y = a[at], b[at]
            crossed = self._rank_of(x, y) < limit[at]
            good[at[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry = at[go], x[go], y[go], rx[go], ry[go]
            undo_left = rx > ry  # of two merges of one rank the right one is the later
            limit[at] = np.where(undo_left, rx, ry + 1)
            a[at] = np.where(undo_left, self.right[x], x)
            b[at] = np.where(undo_left, y, self.left[y])
        return good

    def spell(self, piece: str) -> str:
        raw = piece.encode("utf-8")
        return piece if piece.isascii() and piece.isprintable() else "".join(map(self.bytes_as.__getitem__, raw))

    def propose(self, piece: str) -> list[int] | None:
        """Greedy longest match; None if a symbol is not in the vocabulary."""
        get, longest, suffix, out, i, n = self.vocab.get, self.longest.get, self.suffix, [], 0, len(piece)
        while True:
            most = longest(piece[i : i + 3], 2)
            if n - i <= most and (tail := get(piece[i:] + suffix)) is not None:
                out.append(tail)
                return out
            j = min(n - 1, i + most)
            while j > i and (token := get(piece[i:j])) is None:
                j -= 1
            if j <= i:
                return None
            out.append(token)
            i = j

    def exact(self, piece: str) -> list[int]:
        """Merges the pair of least rank, leftmost first, until none is left. Unknown symbols are dropped."""
        names = [*piece[:-1], piece[-1] + self.suffix]
        ids = [self.vocab[s] for s in names if s in self.vocab]
        return self._merge_short(ids) if len(ids) <= 48 else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        rank, size, never = self.merge.get, self.size, int(_NEVER)
        ranks = [rank(a * size + b, never) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < never:
            i = ranks.index(least)
            ids[i : i + 2] = [made := self.made[least]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(made * size + ids[i + 1], never)
            if i:
                ranks[i - 1] = rank(ids[i - 1] * size + made, never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank, size, n = self.merge.get, self.size, len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank(a * size + b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = self.made[r], False, after[j]
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := rank(ids[left] * size + ids[right])) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
            if after[i] < n:
                before[after[i]] = i
        return [t for t, ok in zip(ids, alive) if ok]

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Token ids of each piece: all proposals are verified at once, failing ones are merged exactly."""
        spelt = [self.spell(p) for p in pieces]
        found = [self.propose(s) for s in spelt]
        lengths = np.array([len(f) if f else 0 for f in found], np.int64)
        flat = np.array([t for f in found if f for t in f], np.int64)
        owner = np.repeat(np.arange(len(pieces)), lengths)
        wrong = np.array([f is None for f in found], bool) if found else np.zeros(0, bool)
        wrong[owner[~self.stable[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        fine = self.compatible(pairs // self.size, pairs % self.size)[back]
        wrong[owner[inner[~fine]]] = True
        failing = np.flatnonzero(wrong).tolist()
        for i, ids in zip(failing, self.exact_all([spelt[i] for i in failing])):
            found[i] = ids
        return found

    def exact_all(self, pieces: list[str]) -> list[list[int]]:
        """Exact merging of many pieces at once: every round makes the next merge of each of them."""
        start = self.start
        ids = [[start[c] for c in p[:-1] if c in start] + [self.vocab[p[-1] + self.suffix]] if p[-1] + self.suffix in self.vocab else self.exact(p) for p in pieces]
        out = list(ids)
        sizes = np.array(list(map(len, ids)), np.int64)
        for least, most in ((2, 8), (9, 14), (15, 24), (25, 48)):
            rows = np.flatnonzero((sizes >= least) & (sizes <= most))
            for a in range(0, len(rows), 20_000):
                some = rows[a : a + 20_000].tolist()
                for i, merged in zip(some, self._merge_rows([ids[i] for i in some], most)):
                    out[i] = merged
        for i in np.flatnonzero(sizes > 48).tolist():
            out[i] = self._merge_long(ids[i])
        return out

    def _merge_rows(self, rows: list[list[int]], width: int) -> list[list[int]]:
        table = np.full((len(rows), width + 1), -1, np.int64)
        sizes = np.array(list(map(len, rows)), np.int64)
        table[:, :width][np.arange(width) < sizes[:, None]] = [t for r in rows for t in r]
        ranks = np.full((len(rows), width), _NEVER)
        both = table[:, 1:] >= 0
        ranks[both] = self._rank_of(table[:, :-1][both], table[:, 1:][both])
        columns, at = np.arange(width), np.arange(len(rows))
        while len(at):
            i = ranks[at].argmin(axis=1)
            least = ranks[at, i]
            go = least < _NEVER
            at, i, least = at[go], i[go], least[go]
            if not len(at):
                break
            # What follows the pair moves one place to the left, in the tokens and in the ranks.
            shift = columns + (columns > i[:, None])
            moved = np.take_along_axis(table[at], np.minimum(shift, width), axis=1)
            moved[np.arange(len(at)), i] = self.made_ids[least]
            table[at, :width] = moved
            table[at, width] = -1
            near = np.concatenate([ranks[at], np.full((len(at), 1), _NEVER)], axis=1)
            near = np.take_along_axis(near, columns + (columns >= i[:, None]), axis=1)
            for k in (i - 1, i):
                fine = (k >= 0) & (table[at, np.minimum(k + 1, width)] >= 0)
                r = np.full(len(at), _NEVER)
                r[fine] = self._rank_of(table[at[fine], k[fine]], table[at[fine], k[fine] + 1])
                near[k >= 0, k[k >= 0]] = r[k >= 0]
            ranks[at] = near
        return [[t for t in r if t >= 0] for r in table.tolist()]

    def chunks(self, text: str) -> list[str]:
        """The runs between white space, which no token crosses; special tokens stand alone."""
        if "<|" not in text or self.cut_special is None:
            return self._runs(text)
        out: list[str] = []
        for k, part in enumerate(self.cut_special.split(text)):
            out += [part] if k % 2 else self._runs(part)
        return out

    @staticmethod
    def _runs(text: str) -> list[str]:
        return _NOT_WHITE.findall(text) if _SEPARATORS.search(text) else text.split()

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        normal = [unicodedata.normalize("NFC", c).replace("Σ", "σ").lower() if not c.isascii() else c.lower() for c in chunks]
        cut = [self.pieces.findall(c) if not s else [] for c, s in zip(normal, (c in self.special for c in chunks))]
        distinct = list(dict.fromkeys(p for ps in cut for p in ps))
        ids = dict(zip(distinct, self.encode_pieces(distinct)))
        return [[self.special[c]] if c in self.special else [t for p in ps for t in ids[p]] for c, ps in zip(chunks, cut)]

    def encode(self, text: str | None) -> list[int]:
        return [t for ids in self.encode_chunks(self.chunks(text or "")) for t in ids]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokenizer file has no decoder, so the tokens are joined by blanks, special ones included."""
        return " ".join(map(self.names.__getitem__, ids))


class Encoder:
    """Encodes texts and remembers chunks of up to ``longest`` characters: those seen first stay, which are mostly the frequent ones.

    The rest, and longer chunks, are forgotten after each batch; so what is held is bounded in bytes, whatever the script.
    """

    def __init__(self, bpe: WordBpe, remember: int = 200_000, longest: int = 32):
        self.bpe, self.remember, self.longest = bpe, remember, longest
        self.ids: dict[str, str] = {}
        self.text: dict[str, str] = {}

    def batch(self, texts: list[str | None]) -> Iterator[tuple[str, str]]:
        """For each text the decimal ids joined by blanks, and the decoded text."""
        chunks = [self.bpe.chunks(t) if t else [] for t in texts]
        known, decoded = self.ids, self.text
        room = self.remember - len(known)
        new = list(dict.fromkeys(c for cs in chunks for c in cs if c not in known))
        for c, ids in zip(new, self.bpe.encode_chunks(new)):
            known[c] = " ".join(map(str, ids))
            decoded[c] = self.bpe.decode(ids)
        for cs in chunks:
            yield " ".join(map(known.__getitem__, cs)), " ".join(map(decoded.__getitem__, cs))
        for c in new:
            if len(c) > self.longest or room <= 0:
                del known[c], decoded[c]
            else:
                room -= 1


def tokenizer_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _encoded(coder: Encoder, ids: pa.Array, texts: list[str | None], with_ids: bool) -> pa.RecordBatch:
    counts, hashes, decoded, tokens = [], [], [], []
    for numbers, text in coder.batch(texts):
        counts.append(numbers.count(" ") + 1 if numbers else 0)
        hashes.append(hashlib.sha256(numbers.encode()).hexdigest())
        decoded.append(hashlib.sha256(text.encode()).hexdigest())
        if with_ids:
            tokens.append(np.array(numbers.split(), np.int32))
    columns = [ids, pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
    if with_ids:
        ends = np.append(0, np.cumsum(counts)).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int32))))
    return pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes whole texts and decodes the ids again.

    The vocabulary (one file of fixed size) is read on the driver and broadcast.
    No shuffle: one pass over the scan. ``with_ids`` adds the ids as an array.
    """
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles, and the many short lists would set it off all the time
        try:
            coder = Encoder(WordBpe(spec.value))
            for batch in batches:
                for at, texts in text_blocks(batch.column(1), 2_000_000):
                    yield _encoded(coder, batch.column(0).slice(at, len(texts)), texts, with_ids)
        finally:
            gc.enable()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decodes arrays of ids to text (null: null). Ids outside the vocabulary raise."""
    spec = tokens.sparkSession.sparkContext.broadcast(tokenizer_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(spec.value)
        for batch in batches:
            out = [None if ids is None else bpe.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
