"""Vector search for batches of queries: exact, and by an inverted file of cells.

Queries are broadcast in blocks of bounded size. Every task multiplies its batches of
vectors with a block's matrix and keeps the best k of each query, so what is shuffled is
k rows for each query and task; a window merges them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of one block of queries as doubles.
BLOCK_BYTES = 64 << 20
#: Products of queries and vectors that a task holds at once.
PRODUCTS = 1 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of unit length."""
    m = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


class Best:
    """The best k of each query so far: larger scores first, then smaller ids. Ids that are whole numbers are kept as such."""

    def __init__(self, n: int, k: int, digits: int, whole: bool = False):
        self.k, self.digits, self.whole = k, digits, whole
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.zeros((n, k), np.int64) if whole else np.full((n, k), None, object)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores (rows, vectors), the vectors by rising id."""
        k = min(self.k, scores.shape[1])
        # A key that no two vectors share: the rounded score, then the place.
        scale = 10**self.digits
        key = (scale - np.rint(scores * scale).astype(np.int64)) * scores.shape[1] + np.arange(scores.shape[1])
        top = np.argpartition(key, k - 1, axis=1)[:, :k] if k < scores.shape[1] else np.broadcast_to(np.arange(k), (len(scores), k))
        some = np.concatenate([self.scores[rows], np.round(np.take_along_axis(scores, top, axis=1), self.digits)], axis=1)
        named = np.concatenate([self.ids[rows], ids[top]], axis=1)
        if self.whole:
            order = np.lexsort((named, -some), axis=1)[:, : self.k]
            self.scores[rows], self.ids[rows] = np.take_along_axis(some, order, axis=1), np.take_along_axis(named, order, axis=1)
            return
        for i, r in enumerate(rows.tolist()):
            order = sorted((j for j in range(some.shape[1]) if named[i, j] is not None), key=lambda j: (-some[i, j], named[i, j]))[: self.k]
            self.scores[r, : len(order)], self.ids[r, : len(order)] = some[i, order], named[i, order]

    def add_product(self, rows: np.ndarray, q: np.ndarray, m: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the rows' queries q and the vectors m, made for so many queries at once that they stay small."""
        step = max(1, PRODUCTS // max(1, len(m)))
        for at in range(0, len(rows), step):
            self.add(rows[at : at + step], q[at : at + step] @ m.T, ids)

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, ids, scores) of what was found, in bounded parts."""
        step = max(1, PRODUCTS // 8 // self.k)
        for at in range(0, len(self.scores), step):
            i, j = np.nonzero(self.scores[at : at + step] > -np.inf)
            yield at + i, self.ids[at : at + step][i, j], self.scores[at : at + step][i, j]


def _usable(vectors: DataFrame, vector: str, dims: int) -> DataFrame:
    """Vectors of the right size without nulls, and not zero, which have no direction."""
    v = F.col(vector)
    return vectors.where((F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull()) & F.exists(v, lambda x: x != 0))


def _blocks(queries: DataFrame, dims: int) -> Iterator[list]:
    """queries (qid, q) in blocks that a broadcast can hold."""
    most = max(1, BLOCK_BYTES // (8 * dims))
    n = queries.count()
    parts = max(1, -(-n // most))
    for part in range(parts):
        mine = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part)
        yield mine.select("qid", "q").collect()  # about ``most`` rows


def _best_of_tasks(vectors: DataFrame, rows: list, k: int, qid_kind: str, digits: int, cells: np.ndarray | None = None) -> DataFrame:
    """vectors (id, vector[, cell]). cells: for each query, the cells that it looks into."""
    types = (to_arrow_type(vectors.sparkSession.createDataFrame([], f"q {qid_kind}").schema["q"].dataType), to_arrow_type(vectors.schema["id"].dataType))
    sent = vectors.sparkSession.sparkContext.broadcast((np.array([r.q for r in rows], np.float64), cells))
    qids, whole = [r.qid for r in rows], pa.types.is_integer(types[1])
    id_kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, looked = sent.value
        q = q / np.sqrt((q * q).sum(axis=1, keepdims=True))
        best = Best(len(q), k, digits, whole)
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(0)))
            order = pc.sort_indices(batch.column(0))
            ids, m = batch.column(0).take(order), _matrix(batch.column(1).take(order))
            ids = ids.cast(pa.int64()).to_numpy(zero_copy_only=False) if whole else np.array(ids.to_pylist(), object)
            if looked is None:
                if len(m):
                    best.add_product(np.arange(len(q)), q, m, ids)
                continue
            cell = np.asarray(batch.column(2).take(order))
            for c in np.unique(cell).tolist():
                asking, here = np.flatnonzero((looked == c).any(axis=1)), np.flatnonzero(cell == c)
                if len(asking):
                    best.add_product(asking, q[asking], m[here], ids[here])
        for rows, ids, scores in best.found():
            yield pa.RecordBatch.from_pydict({"qid": pa.array([qids[i] for i in rows.tolist()], types[0]), "id": pa.array(ids.tolist(), types[1]), "score": pa.array(scores, pa.float64())})

    return vectors.mapInArrow(run, f"qid {qid_kind}, id {id_kind}, score double")


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """Rank by score, then id; ranks beyond k go."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_search(queries: DataFrame, vectors: DataFrame, *, id_col: str, vector_col: str, k: int, digits: int = 6) -> DataFrame:
    """queries (qid, q) -> (qid, id, score, rank): the best k of each by exact cosine, to so many digits."""
    first = queries.where(F.col("q").isNotNull()).select(F.size("q")).first()
    dims = first[0] if first else 1
    named = _usable(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), "vector", dims)
    kind = queries.schema["qid"].dataType.simpleString()
    hits = [_best_of_tasks(named, rows, k, kind, digits) for rows in _blocks(_usable(queries, "q", dims), dims) if rows]
    if not hits:
        return ranked(named.limit(0).select(F.lit(None).cast(kind).alias("qid"), "id", F.lit(0.0).alias("score")), k)
    return ranked(reduce(DataFrame.unionByName, hits), k)


class CellIndex:
    """An inverted file: every vector belongs to the cell of its nearest centre.

    The centres are fitted by spherical k-means on at most ``sample`` vectors, those of least id hash;
    every vector is then assigned to a cell. A query looks into its ``probes`` nearest cells, the knob
    between speed and recall.
    """

    def __init__(self, vectors: DataFrame, *, id_col: str, vector_col: str, cells: int = 64, sample: int = 20_000, rounds: int = 12, seed: int = 3):
        named = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
        first = named.where(F.col("vector").isNotNull()).select(F.size("vector")).first()
        self.dims = first[0] if first else 1
        named = _usable(named, "vector", self.dims)
        some = named.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()
        m = np.array([r.vector for r in some], np.float64).reshape(-1, self.dims)
        m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
        rng = np.random.default_rng(seed)
        self.centres = m[rng.permutation(len(m))[:cells]]
        for _ in range(rounds):
            near = (m @ self.centres.T).argmax(axis=1)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, near, m)
            size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            self.centres = np.where(size > 0, sums / np.maximum(size, 1e-12), self.centres)
        self.table = self._assigned(named)

    def _assigned(self, named: DataFrame) -> DataFrame:
        """(id, vector, cell) of every row; to be written partitioned by cell where it is searched often."""
        sent = named.sparkSession.sparkContext.broadcast(self.centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = (_matrix(batch.column(1)) @ sent.value.T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["id", "vector", "cell"])

        kinds = [named.schema[c].dataType.simpleString() for c in ("id", "vector")]
        return named.mapInArrow(run, f"id {kinds[0]}, vector {kinds[1]}, cell int")

    def probes_for(self, recall: float, *, k: int, queries: int = 100) -> int:
        """The fewest probes, by steps of a 16th of the cells, with such a recall for a bounded number of the index's own vectors."""
        asked = self.table.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(queries).select(F.col("id").alias("qid"), F.col("vector").alias("q"))
        exact = {(r.qid, r.id) for r in vector_search(asked, self.table, id_col="id", vector_col="vector", k=k).collect()}
        step = max(1, len(self.centres) // 16)
        for probes in range(step, len(self.centres), step):
            if sum((r.qid, r.id) in exact for r in self.search(asked, k=k, probes=probes).collect()) >= recall * len(exact):
                return probes
        return len(self.centres)

    def search(self, queries: DataFrame, *, k: int, probes: int = 16) -> DataFrame:
        """queries (qid, q) -> (qid, id, score, rank) of the best k in the cells looked into."""
        kind, hits = queries.schema["qid"].dataType.simpleString(), []
        for rows in _blocks(_usable(queries, "q", self.dims), self.dims):
            if rows:
                near = np.argsort(-(np.array([r.q for r in rows], np.float64) @ self.centres.T), axis=1, kind="stable")[:, :probes]
                hits.append(_best_of_tasks(self.table, rows, k, kind, 6, near))
        if not hits:
            return ranked(self.table.limit(0).select(F.lit(None).cast(kind).alias("qid"), "id", F.lit(0.0).alias("score")), k)
        return ranked(reduce(DataFrame.unionByName, hits), k)
