"""Hard negatives by inner product, with ball trees searched by branch and bound.

Components are whole numbers, so scores are exact. Every task builds trees over its rows, a
tree for each ``tree_bytes`` of them, and walks them for a block of anchors at once. Around a
node's centre c with radius r all inner products with an anchor q lie between q.c - |q| r
and q.c + |q| r. A node is left out if these bounds lie outside the score window, or if the
upper one is strictly beneath the current kth best; at an equal score a smaller id may still
win. Leaves are multiplied out. Bounds are widened by the rounding that they can have.

Two searches follow each other for each block of anchors: the best rows of the anchor's own
label are its positives (no window); then for each positive the best rows of other labels in
the window that its score sets. A task returns k rows for each search at most, a window merges
them. Anchors are a stated set of queries: they and their positives are sent in blocks of
``block_bytes``, whatever their number, and every row is searched.

Defined results: rows without an id, a label or a vector take no part, nor do those with a
null or non-finite component (or one that isn't finite after scaling). Of rows with one id, the
one of the least label, then vector, takes part. Vectors of different lengths are multiplied as
if zeros followed. A score that no long holds counts as the nearest long. Ties go to smaller
ids. An anchor without positives, or a positive without rows in its window, has no row; an
empty table gives none. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import checkpointed

_NONE = np.iinfo(np.int64).min
_MOST = np.iinfo(np.int64).max
#: Whole numbers up to here are exact as doubles, and so are their sums; scores in composed keys stay longs.
_EXACT = float(1 << 52)


def scaled(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the usable rows, their components as floor(scale * x)), shorter ones filled with zeros."""
    whole = np.flatnonzero(np.asarray(pc.is_valid(column)))
    column = column.take(pa.array(whole))
    sizes = np.asarray(pc.list_value_length(column)).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    row = np.repeat(np.arange(len(sizes)), sizes)
    fine = np.bincount(row[~np.isfinite(flat)], minlength=len(sizes)) == 0
    out = np.zeros((len(sizes), sizes.max(initial=0)))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return whole[fine], out[fine]


def _wide(m: np.ndarray, dims: int) -> np.ndarray:
    return m if m.shape[1] == dims else np.pad(m, ((0, 0), (0, dims - m.shape[1])))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact, as longs."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1]) < _EXACT:
        return (q @ x.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in q], object).reshape(q.shape) @ np.array([[int(v) for v in r] for r in x], object).reshape(x.shape).T
    return np.array([[min(max(int(v), _NONE + 1), _MOST) for v in np.atleast_1d(r)] for r in exact], np.int64).reshape(len(q), len(x))


def window(score: int) -> tuple[int, int]:
    """The negative scores n with 50 * score <= 100 * n <= 95 * score."""
    return -(-score // 2), 95 * score // 100


@dataclass
class BallTree:
    """Nodes with children, or rows start:end of the reordered rows; leaves hold rows by rising id."""

    x: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    spans: list[tuple[int, int]]
    children: list[tuple[int, int] | None]

    @staticmethod
    def build(x: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = 128) -> BallTree:
        order = np.argsort(ids, kind="stable")
        centres, radii, spans, children = [], [], [], []

        def grow(start: int, end: int) -> int:
            rows = x[order[start:end]]
            centre = rows.mean(axis=0)
            away = np.sqrt(((rows - centre) ** 2).sum(axis=1))
            me = len(spans)
            centres.append(centre)
            radii.append(away.max(initial=0))
            spans.append((start, end))
            children.append(None)
            if end - start > leaf:
                one = rows[away.argmax()]  # from the farthest row to the one farthest from it
                other = rows[((rows - one) ** 2).sum(axis=1).argmax()]
                half = (end - start) // 2
                order[start:end] = order[start:end][np.argpartition(rows @ (other - one), half)]
                children[me] = grow(start, start + half), grow(start + half, end)
            else:
                order[start:end] = order[start:end][np.argsort(ids[order[start:end]], kind="stable")]
            return me

        if len(x):
            grow(0, len(x))
        return BallTree(x[order], ids[order], labels[order], np.array(centres).reshape(len(spans), x.shape[1]), np.array(radii), spans, children)


@dataclass
class Searches:
    """For each search: its anchor (a row of q, with its id), its label, the window, and whether rows of that label or of others are wanted."""

    q: np.ndarray
    anchor: np.ndarray
    own: np.ndarray
    label: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool


class Best:
    """The best k of each search so far: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), _NONE)
        self.ids = np.full((n, k), _MOST)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores (searches, rows), the rows by rising id; _NONE: not wanted."""
        k, n = self.k, scores.shape[1]
        if n > k:
            if np.abs(np.where(scores == _NONE, 0, scores)).max(initial=0) < _EXACT // n:
                key = np.where(scores == _NONE, _NONE, scores * n + (n - 1 - np.arange(n)))
                top = np.argpartition(key, n - k, axis=1)[:, n - k :]
            else:
                top = np.argsort(~scores, axis=1, kind="stable")[:, :k]
            scores, ids = np.take_along_axis(scores, top, axis=1), ids[top]
        else:
            ids = np.broadcast_to(ids, scores.shape)
        both, named = np.concatenate([self.scores[at], scores], axis=1), np.concatenate([self.ids[at], ids], axis=1)
        order = np.lexsort((named, ~both), axis=1)[:, :k]
        self.scores[at], self.ids[at] = np.take_along_axis(both, order, axis=1), np.take_along_axis(named, order, axis=1)


def search(tree: BallTree, s: Searches, best: Best, chunk: int = 2048) -> int:
    """Walks a tree for all searches; returns how many rows were multiplied out. Bounds that overflow to nan prune nothing."""
    seen = 0
    if not tree.spans:
        return seen
    dims = max(tree.x.shape[1], s.q.shape[1])
    q, x, centres = _wide(s.q, dims), _wide(tree.x, dims), _wide(tree.centres, dims)
    length, size = np.sqrt((q * q).sum(axis=1)), np.sqrt((centres * centres).sum(axis=1))
    leaves = np.array([c is None for c in tree.children])
    low, high = s.low.astype(np.float64), s.high.astype(np.float64)

    for first in range(0, len(s.anchor), chunk):
        mine = np.arange(first, min(first + chunk, len(s.anchor)))
        rows, back = np.unique(s.anchor[mine], return_inverse=True)
        middle = (q[rows] @ centres.T)[back]
        ball = length[rows][back][:, None]
        slack = ball * (size + tree.radii) * 1e-9 + 1e-6
        upper, lower = middle + ball * tree.radii + slack, middle - ball * tree.radii - slack

        def open_at(node: int, at: np.ndarray) -> np.ndarray:
            kth = best.scores[mine[at], -1].astype(np.float64)
            up = upper[at, node]
            return at[~((up < kth) | (up < low[mine[at]]) | (lower[at, node] > high[mine[at]]))]

        def multiply(node: int, at: np.ndarray) -> None:
            nonlocal seen
            start, end = tree.spans[node]
            for part in np.array_split(at, max(1, len(at) * (end - start) // 2_000_000)):
                which, place = np.unique(s.anchor[mine[part]], return_inverse=True)
                scores = products(q[which], x[start:end])[place]
                seen += scores.size
                to = mine[part]
                wanted = (tree.labels[start:end] == s.label[to][:, None]) == s.same
                wanted &= (scores >= s.low[to][:, None]) & (scores <= s.high[to][:, None]) & (tree.ids[start:end] != s.own[to][:, None])
                scores[~wanted] = _NONE
                good = np.flatnonzero((wanted & (scores >= best.scores[to, -1:])).any(axis=1))
                if len(good):
                    best.add(to[good], scores[good], tree.ids[start:end])

        # Each search begins at its most promising leaf, so that a good kth prunes the rest.
        fair = np.where(leaves & (lower <= high[mine][:, None]), upper, -np.inf)
        begun = fair.argmax(axis=1)
        begun[~np.isfinite(fair.max(axis=1))] = -1
        for node in np.unique(begun[begun >= 0]).tolist():
            multiply(node, np.flatnonzero(begun == node))
        waiting = [(0, np.arange(len(mine)))]
        while waiting:
            node, at = waiting.pop()
            at = open_at(node, at)
            if not len(at):
                continue
            if tree.children[node] is None:
                at = at[begun[at] != node]
                if len(at):
                    multiply(node, at)
                continue
            a, b = tree.children[node]
            later, sooner = (a, b) if upper[at, a].sum() < upper[at, b].sum() else (b, a)
            waiting += [(later, at), (sooner, at)]
    return seen


def _rows(batches: Iterator[pa.RecordBatch], scale: int, tree_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of usable rows, in blocks."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dims = max(h[2].shape[1] for h in held)
        return np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([_wide(h[2], dims) for h in held])

    for batch in batches:
        for at in range(0, len(batch), 4096):
            part = batch.slice(at, 4096)
            places, x = scaled(part.column(2), scale)
            held.append((part.column(0).to_numpy()[places], part.column(1).to_numpy()[places], x))
            size += x.nbytes + 16 * len(x)
            if size >= tree_bytes:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _found(rows: DataFrame, s: Searches, k: int, scale: int, tree_bytes: int) -> DataFrame:
    """(search, score, id): the best k of each search over all rows, ranked."""
    sent = rows.sparkSession.sparkContext.broadcast(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = sent.value
        best = Best(len(mine.anchor), k)
        with np.errstate(over="ignore", invalid="ignore"):
            for ids, labels, x in _rows(batches, scale, tree_bytes):
                search(BallTree.build(x, ids, labels), mine, best)
        at, place = np.nonzero(best.scores > _NONE)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(best.scores[at, place]), pa.array(best.ids[at, place])], names=["search", "score", "id"])

    best = Window.partitionBy("search").orderBy(F.desc("score"), "id")
    found = rows.mapInArrow(run, "search bigint, score bigint, id bigint")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _once(rows: DataFrame) -> DataFrame:
    """One row for each id; only rows of repeated ids are shuffled."""
    rows = rows.where("id is not null and label is not null and vector is not null")
    repeated = checkpointed(rows.groupBy("id").count().where("count > 1").select("id"))
    if repeated.isEmpty():
        return rows
    limit = F.lit(float("inf"))
    usable = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == limit))
    some = rows.join(repeated, "id", "left_semi").where(usable)
    least = some.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("least")).select("id", "least.label", "least.vector")
    return checkpointed(rows.join(repeated, "id", "left_anti").select("id", "label", "vector").unionByName(least))


def mine(
    vectors: DataFrame, anchors: Column, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", label: Column | None = None,
    positives: int = 5, negatives: int = 3, scale: int = 256, block_bytes: int = 16 << 20, tree_bytes: int = 32 << 20,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    anchors: which rows ask. label: a whole number, ``label_col`` unless another expression is given.
    """
    name, kind = F.col(id_col).cast("bigint").alias("id"), F.col(label_col) if label is None else label
    rows = _once(vectors.select(name, kind.cast("bigint").alias("label"), F.col(vector_col).alias("vector")))
    asking = vectors.where(anchors).select(name).where("id is not null").distinct()
    asking = checkpointed(rows.join(asking, "id", "left_semi"))
    n, dims = asking.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    parts = max(1, -(-n * 8 * max(1, dims) // block_bytes))
    blocks = []
    for part in range(parts):
        # About ``block_bytes`` of anchors come to the driver and go to the tasks at once.
        block = asking if parts == 1 else asking.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        held = list(_rows(iter(pa.Table.to_batches(block.select("id", "label", "vector").toArrow())), scale, 1 << 62))
        if not held or not len(held[0][0]):
            continue
        ids, labels, q = held[0]
        every = np.arange(len(ids))
        first = Searches(q, every, ids, labels, np.full(len(ids), _NONE + 1), np.full(len(ids), _MOST), True)
        near = _found(rows, first, positives, scale, tree_bytes).select("search", "id", "score").toArrow()  # a few for each anchor of the block
        of, positive, score = (near.column(c).to_numpy() for c in ("search", "id", "score"))
        bounds = np.array([window(v) for v in score.tolist()], np.int64).reshape(-1, 2)
        some = bounds[:, 0] <= bounds[:, 1]
        of, positive, score, bounds = of[some], positive[some], score[some], bounds[some]
        second = Searches(q, of, ids[of], labels[of], bounds[:, 0], bounds[:, 1], False)
        found = _found(rows, second, negatives, scale, tree_bytes)
        blocks.append(checkpointed(_named(found, ids[of], positive, score)))
    if not blocks:
        return rows.limit(0).select(*(F.lit(0).cast(t).alias(c) for c, t in _OUT))
    return reduce(DataFrame.unionByName, blocks)


_OUT = [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]


def _named(found: DataFrame, anchor: np.ndarray, positive: np.ndarray, score: np.ndarray) -> DataFrame:
    sent = found.sparkSession.sparkContext.broadcast((anchor, positive, score))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, p, s = sent.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(p[at]), batch.column(1), batch.column(2), pa.array(s[at]), batch.column(3)], names=[c for c, _ in _OUT])

    return found.select("search", F.col("rank").cast("int").alias("rank"), "id", "score").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in _OUT))
