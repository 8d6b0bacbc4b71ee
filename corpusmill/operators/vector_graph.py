"""Approximate vector search over navigable graphs, one for each block of vectors.

Vectors are dealt evenly to blocks of ``block`` by a hash of their ids. A block's graph is built in one task with
matrix products: every vector's nearest ones in the block, thinned so that a neighbour stays only if no kept one is
nearer to it than the vector is, and the links back. So links lead in different directions, and few hops reach any place.

A search walks all queries of a batch at once: from the block's centre each goes on to the best candidate not
visited yet, until its best ``ef`` have been visited. ``ef`` is the knob between speed and recall. Blocks are
searched side by side, and what is shuffled is k rows for each query and block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusmill.operators.vectors import _blocks, _matrix, _usable, ranked
from corpusmill.session import checkpointed

#: Rows of one matrix product, and rows of it that are ordered at once: their places take three times the memory.
_ROWS, _ORDERED = 1024, 128


def _nearest(sims: np.ndarray, near: int) -> np.ndarray:
    """The places of the ``near`` largest of each row, largest first."""
    if not near:
        return np.zeros((len(sims), 0), np.int64)
    parts = []
    for a in range(0, len(sims), _ORDERED):
        some = sims[a : a + _ORDERED]
        best = np.argpartition(-some, near - 1, axis=1)[:, :near]
        parts.append(np.take_along_axis(best, np.argsort(-np.take_along_axis(some, best, axis=1), axis=1, kind="stable"), axis=1))
    return np.concatenate(parts)


def build(m: np.ndarray, degree: int, near: int) -> np.ndarray:
    """Links of unit vectors: a row of ``2 * degree`` places for each vector, -1 where there are fewer."""
    n = len(m)
    near = min(near, n - 1)
    out: list[list[int]] = [[] for _ in range(n)]
    for a in range(0, n, _ROWS):
        sims = m[a : a + _ROWS] @ m.T
        sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -np.inf
        for i, places in enumerate(_nearest(sims, near)):
            among = m[places] @ m[places].T
            own, kept = sims[i, places], []
            for j in range(near):
                if len(kept) == degree:
                    break
                if not kept or among[j, kept].max() < own[j]:
                    kept.append(j)
            out[a + i] = places[kept].tolist()
    links = [list(x) for x in out]
    for i, places in enumerate(out):
        for j in places:
            if len(links[j]) < 2 * degree and i not in links[j]:
                links[j].append(i)
    table = np.full((n, 2 * degree), -1, np.int32)
    for i, places in enumerate(links):
        table[i, : len(places)] = places
    return table


def search(m: np.ndarray, links: np.ndarray, q: np.ndarray, k: int, ef: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores) of the best k of each query, and how many products were taken."""
    n, ef = len(m), min(max(ef, k), len(m))
    rows = np.arange(len(q))
    seen = np.zeros((len(q), n), bool)
    seen[:, entries] = True
    # Candidates: the best ef so far, with a mark for the visited.
    scores = np.full((len(q), ef), -np.inf)
    places = np.full((len(q), ef), -1, np.int64)
    visited = np.zeros((len(q), ef), bool)
    first = q @ m[entries].T
    taken = first.size

    def merge(at: np.ndarray, new_scores: np.ndarray, new_places: np.ndarray) -> None:
        s, p = np.concatenate([scores[at], new_scores], axis=1), np.concatenate([places[at], new_places], axis=1)
        v = np.concatenate([visited[at], np.zeros(new_scores.shape, bool)], axis=1)
        order = np.argsort(-s, axis=1, kind="stable")[:, :ef]
        scores[at], places[at], visited[at] = (np.take_along_axis(x, order, axis=1) for x in (s, p, v))

    merge(rows, first, np.broadcast_to(entries, first.shape))
    live = rows
    while len(live):
        open_ = np.where(visited[live] | (places[live] < 0), -np.inf, scores[live])
        best = open_.argmax(axis=1)
        go = np.isfinite(open_[np.arange(len(live)), best])
        live, best = live[go], best[go]
        if not len(live):
            break
        visited[live, best] = True
        around = links[places[live, best]]
        fresh = (around >= 0) & ~seen[live[:, None], np.maximum(around, 0)]
        r, c = np.nonzero(fresh)
        seen[live[r], around[r, c]] = True
        found = np.full(around.shape, -np.inf)
        found[r, c] = np.einsum("ij,ij->i", q[live[r]], m[around[r, c]])
        taken += len(r)
        merge(live, found, np.where(fresh, around, -1).astype(np.int64))
    return places[:, :k], scores[:, :k], taken


class GraphIndex:
    """Graphs over blocks of about ``block`` vectors; each is one row of ``table``: ids, vectors, links and entries."""

    def __init__(self, vectors: DataFrame, *, id_col: str, vector_col: str, block: int = 10_000, degree: int = 16, near: int = 64, entries: int = 8):
        named = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
        first = named.where(F.col("vector").isNotNull()).select(F.size("vector")).first()
        self.dims = first[0] if first else 1
        named = _usable(named.where("id is not null"), "vector", self.dims)
        blocks = max(1, -(-named.count() // block))
        self.kind = named.schema["id"].dataType.simpleString()
        schema = f"block int, ids array<{self.kind}>, vectors binary, links binary, width int, entries array<int>"
        kind = to_arrow_type(named.schema["id"].dataType)

        def run(group: pa.Table) -> pa.Table:
            group = group.sort_by("id")
            m = _matrix(group.column("vector").combine_chunks()).astype(np.float32)
            links = build(m, degree, near)
            # Vectors spread over the block: the one nearest to its centre, and then others in equal steps of their products with it.
            order = np.argsort(-(m @ m.mean(axis=0)), kind="stable")
            starts = np.unique(order[np.linspace(0, len(m) - 1, min(entries, len(m))).astype(int)]).tolist()
            row = [pa.array([group.column("block")[0].as_py()], pa.int32()), pa.array([group.column("id").to_pylist()], pa.list_(kind)), pa.array([m.tobytes()], pa.binary()), pa.array([links.tobytes()], pa.binary()), pa.array([links.shape[1]], pa.int32()), pa.array([starts], pa.list_(pa.int32()))]
            return pa.table(row, names=["block", "ids", "vectors", "links", "width", "entries"])

        dealt = named.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        #: To be written where it is searched often.
        self.table = checkpointed(dealt.select("id", "vector", "block").groupBy("block").applyInArrow(run, schema))

    def search(self, queries: DataFrame, *, k: int, ef: int = 64) -> DataFrame:
        """queries (qid, q) -> (qid, id, score, rank): the best k that the walks find."""
        hits = []
        kind = queries.schema["qid"].dataType
        for rows in _blocks(_usable(queries, "q", self.dims), self.dims):
            if rows:
                hits.append(self._found(rows, kind, k, ef))
        if not hits:
            none = self.table.limit(0).select(F.lit(None).cast(kind).alias("qid"), F.explode("ids").alias("id"), F.lit(0.0).alias("score"))
            return ranked(none, k)
        return ranked(reduce(DataFrame.unionByName, hits), k)

    def _found(self, rows: list, kind, k: int, ef: int) -> DataFrame:
        sent = self.table.sparkSession.sparkContext.broadcast(np.array([r.q for r in rows], np.float64))
        qids, dims, id_kind, qid_kind = [r.qid for r in rows], self.dims, self.table.schema["ids"].dataType.elementType, to_arrow_type(kind)
        out_kind = to_arrow_type(id_kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(len(batch)):
                    (row,) = batch.slice(at, 1).to_pylist()
                    m = np.frombuffer(row["vectors"], np.float32).reshape(-1, dims)
                    links = np.frombuffer(row["links"], np.int32).reshape(len(m), row["width"])
                    for a in range(0, len(qids), 512):
                        q = sent.value[a : a + 512]
                        q = q / np.sqrt((q**2).sum(axis=1, keepdims=True))
                        places, scores, _ = search(m, links, q.astype(np.float32), k, ef, np.array(row["entries"]))
                        r, c = np.nonzero(places >= 0)
                        exact = np.round(np.einsum("ij,ij->i", q[r], m[places[r, c]].astype(np.float64)), 6)
                        ids = [row["ids"][p] for p in places[r, c].tolist()]
                        yield pa.RecordBatch.from_arrays([pa.array([qids[a + i] for i in r.tolist()], qid_kind), pa.array(ids, out_kind), pa.array(exact)], names=["qid", "id", "score"])

        return self.table.mapInArrow(run, f"qid {kind.simpleString()}, id {id_kind.simpleString()}, score double")
