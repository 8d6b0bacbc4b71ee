"""A quality classifier by co-training.

Two views of a document: its text (hashed words and the shares of its bytes) and
its page's metadata (language, source, length). Each has a logistic regression.
In every round both classifiers score all unlabelled documents, in one pass of Spark,
and the ``per_round`` that each is surest of, split over the classes as the labels
are, go into the other's training set: the exchange is a fixed number of the surest,
chosen from the whole table. Both are calibrated on labelled documents held back from
training, in every round, so that only a view that has earned it is sure of anything.
At the end their log-odds are added, less the prior that both contain.

Bounds: at most ``max_labelled`` labelled documents are learned from (those whose ids
hash lowest), and ``rounds`` times ``per_round`` pseudo-labels in either view. Scores
are over whole texts of all documents, in one pass without a shuffle.

Defined results: a null text or null metadata counts as absent, never as an
error. An id labelled more than once counts with its worst label. Of rows that share
an id that of the least text hash is learned from; equally sure ones go by the hash of
their ids. Without labels of both kinds every document is kept, with the share of good
labels (or one half) as its score. An empty table gives no rows; repeated rows give
repeated rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import ascii_words, checkpointed, text_blocks

WORD_BUCKETS, BYTES, SHAPES, META_BUCKETS = 512, 256, 4, 64
TEXT_WIDTH = WORD_BUCKETS + BYTES + SHAPES
#: Bytes and shapes say more of quality than single words do.
_WORD_SCALE, _SCALE = 0.3, 3.0


def text_view(text: str | None) -> np.ndarray:
    """Distinct words hashed into buckets, the square roots of the bytes' shares, and the text's shape."""
    out = np.zeros(TEXT_WIDTH, np.float32)
    words = ascii_words(text)
    if words:
        each = set(words)
        at = np.fromiter(map(zlib.crc32, each), np.int64, len(each)) % WORD_BUCKETS
        out[:WORD_BUCKETS] = np.bincount(at, minlength=WORD_BUCKETS) * (_WORD_SCALE / math.sqrt(len(each)))
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        out[WORD_BUCKETS:-SHAPES] = _SCALE * np.sqrt(np.bincount(raw, minlength=BYTES) / len(raw))
        lines = text.count("\n") + 1
        out[-SHAPES:] = _SCALE * np.array([len(each) / len(words), math.log10(len(words)) / 4, len(raw) / len(words) / 20, min(1.0, lines / len(words))])
    return out


def meta_view(values: list) -> np.ndarray:
    """One bucket for each value: strings as they are, numbers by their magnitude."""
    out = np.zeros(META_BUCKETS * len(values), np.float32)
    for i, v in enumerate(values):
        if v is not None:
            key = v if isinstance(v, str) else round(2 * math.log2(1 + abs(v))) if math.isfinite(v) else "?"
            out[META_BUCKETS * i + zlib.crc32(repr(key).encode()) % META_BUCKETS] = 1
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Linear:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift


def fit_linear(x: np.ndarray, y: np.ndarray, *, penalty: float = 1e-3, steps: int = 250, rate: float = 0.1) -> Linear:
    """Logistic regression with both classes of equal weight in the loss, by Adam."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    each = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())).astype(np.float32)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for k in range(1, steps + 1):
        wrong = (_sigmoid(x @ w + b) - y) * each
        g = np.append(x.T @ wrong + penalty * w, wrong.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - step[-1]
    return Linear(w, float(b))


def calibrate(model: Linear, x: np.ndarray, y: np.ndarray, pull: float = 0.05) -> None:
    """Platt scaling by Newton's method, with a little pull towards a slope of zero."""
    s = model.raw(x).astype(float)
    unit = s.std() or 1.0
    s /= unit
    a, b = 0.0, math.log((y.sum() + 1) / ((~y).sum() + 1))
    # Targets a little inside 0 and 1 keep separable scores finite.
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    for _ in range(50):
        p = _sigmoid(a * s + b)
        g = np.array([((p - target) * s).sum() + pull * a, (p - target).sum()])
        q = p * (1 - p)
        h = np.array([[(q * s * s).sum() + pull, (q * s).sum()], [(q * s).sum(), q.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - np.clip(d[0], -2, 2), b - np.clip(d[1], -2, 2)
        if abs(d).max() < 1e-8:
            break
    model.slope, model.shift = float(max(0.0, a)) / unit, float(b)


@dataclass
class CoTrained:
    text: Linear | None
    meta: Linear | None
    prior: float

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality from both views, from text alone and from metadata alone."""
        if self.text is None:
            flat = np.full(len(text), _sigmoid(self.prior))
            return flat, flat, flat
        a, b = self.text.log_odds(text), self.meta.log_odds(meta)
        return _sigmoid(a + b - self.prior), _sigmoid(a), _sigmoid(b)


class Views:
    """The two training sets while they grow. Rows are views of documents: text and metadata."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, label: np.ndarray, seed: int = 5):
        """label: 1 good, 0 bad. Every fifth row of either class is held back for calibration."""
        known = np.random.default_rng(seed).permutation(len(label))
        self.held = np.concatenate([known[label[known] == c][::5] for c in (0, 1)])
        learned = np.setdiff1d(known, self.held)
        if len(set(label[learned].tolist())) < 2:  # too few labels to hold any back
            learned = self.held = known
        self.views, self.label = (text, meta), label == 1
        self.share = {c: float((label[learned] == c).mean()) for c in (0, 1)}
        self.sets = [(v[learned], self.label[learned]) for v in self.views]
        good = int(self.label.sum())
        self.prior = math.log((good + 0.5) / (len(label) - good + 0.5))

    def fitted(self) -> CoTrained:
        models = []
        for view, (x, y) in zip(self.views, self.sets):
            model = fit_linear(x, y)
            calibrate(model, view[self.held], self.label[self.held])
            models.append(model)
        return CoTrained(*models, prior=self.prior)

    def add(self, to: int, rows: np.ndarray, good: bool) -> None:
        x, y = self.sets[to]
        self.sets[to] = (np.concatenate([x, rows]), np.append(y, np.full(len(rows), good)))


def _viewed(rows: DataFrame, n_meta: int, id_kind: str) -> DataFrame:
    """rows (key, form, text, m0..) -> (key, form, text, meta), the views as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_view(t).tobytes() for _, some in text_blocks(batch.column(2)) for t in some]
            metas = [meta_view(list(v)).tobytes() for v in zip(*(batch.column(i).to_pylist() for i in range(3, batch.num_columns)))] if n_meta else [b""] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary()), pa.array(metas, pa.binary())], names=["key", "form", "text", "meta"])

    return rows.mapInArrow(run, f"key {id_kind}, form bigint, text binary, meta binary")


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("lang", "source", "n_chars"), label_id: str = "doc_id", label_col: str = "quality", max_labelled: int = 4_000, rounds: int = 3, per_round: int = 400, sure: float = 0.95) -> CoTrained:
    kind, text = docs.schema[id_col].dataType.simpleString(), F.col(text_col)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("key"), F.xxhash64(text).alias("form"), text.alias("text"), *(F.col(c).alias(f"m{i}") for i, c in enumerate(meta_cols)))
    each = labels.where(F.col(label_id).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(label_id).alias("key")).agg(F.min(label_col).cast("int").alias("label"))
    some = each.orderBy(F.xxhash64("key"), "key").limit(max_labelled)

    def views(wanted: DataFrame) -> tuple[dict, np.ndarray, np.ndarray]:
        """Of a bounded number of ids: the place of each, and both views."""
        one = _viewed(rows.join(F.broadcast(wanted), "key", "left_semi"), len(meta_cols), kind).groupBy("key").agg(F.min_by(F.struct("text", "meta"), "form").alias("v"))
        found = one.select("key", "v.*").toPandas().sort_values("key", kind="stable")
        wide = lambda c, n: np.frombuffer(b"".join(found[c]), np.float32).reshape(len(found), n)
        return {k: i for i, k in enumerate(found["key"])}, wide("text", TEXT_WIDTH), wide("meta", META_BUCKETS * len(meta_cols))

    place, text_rows, meta_rows = views(some.select("key"))
    given = {r.key: r.label for r in some.collect()}
    label = np.array([int(given[k] > 0) for k in place], np.int64)
    good = int(label.sum())
    if not good or good == len(label):
        return CoTrained(None, None, math.log((good + 0.5) / (len(label) - good + 0.5)))
    state, taken = Views(text_rows, meta_rows, label), [set(), set()]
    model = state.fitted()
    for _ in range(rounds):
        scored = checkpointed(_pooled(rows, model, len(meta_cols), kind).join(each.select("key"), "key", "left_anti"))  # texts are not shuffled
        lists = []
        for view, column in enumerate(("text_score", "meta_score")):
            for c in (0, 1):
                chance = F.max(column) if c else 1 - F.min(column)
                wanted = max(1, round(per_round * state.share[c]))
                best = scored.groupBy("key").agg(chance.alias("p")).where(F.col("p") >= sure).orderBy(F.desc("p"), F.xxhash64("key"), "key")
                fresh = [r.key for r in best.limit(wanted + len(taken[1 - view])).collect() if r.key not in taken[1 - view]][:wanted]
                taken[1 - view] |= set(fresh)
                lists.append((1 - view, bool(c), fresh))
        if not any(fresh for _, _, fresh in lists):
            break
        ids = docs.sparkSession.createDataFrame([(k,) for k in sorted({k for _, _, fresh in lists for k in fresh})], f"key {kind}")
        at, *both = views(ids)
        for to, c, fresh in lists:
            state.add(to, both[to][[at[k] for k in fresh]], c)
        model = state.fitted()
    return model


def _pooled(rows: DataFrame, model: CoTrained, n_meta: int, id_kind: str) -> DataFrame:
    """(key, text_score, meta_score) of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, a, b = _scores(model, batch.column(2), [batch.column(i).to_pylist() for i in range(3, 3 + n_meta)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a), pa.array(b)], names=["key", "text_score", "meta_score"])

    return rows.mapInArrow(run, f"key {id_kind}, text_score double, meta_score double")


def _scores(model: CoTrained, column: pa.Array, metas: list[list]) -> list[np.ndarray]:
    """Of whole texts, in blocks: the score, and those of text and metadata."""
    parts = []
    for at, texts in text_blocks(column):
        for a in range(0, len(texts), 1000):
            some = range(at + a, min(at + a + 1000, at + len(texts)))
            view = np.stack([text_view(t) for t in texts[a : a + 1000]])
            parts.append(model.scores(view, np.stack([meta_view([m[i] for m in metas]) for i in some])))
    return [np.concatenate(p).astype(np.float64) for p in zip(*parts)] if parts else [np.zeros(0)] * 3


def score(docs: DataFrame, model: CoTrained, *, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("lang", "source", "n_chars"), keep_from: float = 0.5) -> DataFrame:
    """Per row: score, text_score, meta_score (0 to 1) and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _scores(model, batch.column(1), [batch.column(i).to_pylist() for i in range(2, batch.num_columns)])
            kept = np.ones(batch.num_rows, bool) if model.text is None else out[0] >= keep_from
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out), pa.array(kept)], names=["id", "score", "text_score", "meta_score", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"m{i}") for i, c in enumerate(meta_cols)))
    return given.mapInArrow(run, f"id {kind}, score double, text_score double, meta_score double, kept boolean").withColumnRenamed("id", id_col)
