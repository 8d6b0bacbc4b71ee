"""Language identification with a bidirectional gated recurrent network over bytes.

The network is small and written in numpy. Training is backpropagation through
time over windows of labelled texts. In use it runs over whole texts: they are
laid end to end in windows of a fixed number of bytes, every byte of every window
gets label probabilities from the forward state before it and the backward state
after it, and a text's probabilities are the mean over all its bytes.

The gates are piecewise linear and the candidate is x / (1 + |x|), which train
like the usual sigmoid and tanh and take a fraction of their time.

Bound: at most ``per_lang`` labelled texts of each language (those whose ids hash
lowest; fewer of each if that were over ``most_texts`` in all) and ``windows``
stretches of each are learned from. No language is left out.

Defined results: null texts and texts without a letter (Unicode category L) are
``und`` with score 0, as is everything if nothing was labelled; an empty table gives
no rows. Ties go to the label that sorts first. Of rows that share id and language
one is learned from, that of the least text hash. Repeated rows give repeated rows.
Texts of any length are read whole, in windows; other columns are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import text_blocks

UNKNOWN = "und"


@dataclass
class Weights:
    """embed: bytes to the inputs of gates and candidate (biases included); recur: state to the same; out: state to labels."""

    embed: tuple[np.ndarray, np.ndarray]
    recur: tuple[np.ndarray, np.ndarray]
    out: tuple[np.ndarray, np.ndarray]
    bias: np.ndarray
    langs: list[str]

    @property
    def hidden(self) -> int:
        return self.recur[0].shape[1]

    def arrays(self) -> list[np.ndarray]:
        return [*self.embed, *self.recur, *self.out, self.bias]


def _gate(x: np.ndarray) -> np.ndarray:
    return np.clip(0.25 * x + 0.5, 0, 1)


def _step(x: np.ndarray, state: np.ndarray, recur: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step for many windows at once; arrays are (units, windows)."""
    h = len(state)
    r = recur @ state
    gates = _gate(x[: 2 * h] + r[: 2 * h])
    raw = x[2 * h :] + gates[h:] * r[2 * h :]
    new = raw / (1 + np.abs(raw))
    return new + gates[:h] * (state - new), gates, raw, new, r[2 * h :]


def _forward(weights: Weights, windows: np.ndarray, side: int) -> list[tuple]:
    """Everything of each step, in the order of the steps. windows: (time, window)."""
    state = np.zeros((weights.hidden, windows.shape[1]), np.float32)
    steps = []
    for t in range(len(windows)) if side == 0 else range(len(windows) - 1, -1, -1):
        out = _step(weights.embed[side][:, windows[t]], state, weights.recur[side])
        steps.append((t, state, *out))
        state = out[0]
    return steps


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], *, hidden: int = 8, rounds: int = 200, batch: int = 256, rate: float = 0.02, seed: int = 11) -> Weights:
    """windows (n, time) of bytes, labels (n,). Adam; every position is to name the label."""
    rng = np.random.default_rng(seed)
    start = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    w = Weights((start(3 * hidden, 256), start(3 * hidden, 256)), (start(3 * hidden, hidden), start(3 * hidden, hidden)), (start(len(langs), hidden), start(len(langs), hidden)), np.zeros((len(langs), 1), np.float32), langs)
    first, second = [np.zeros_like(a) for a in w.arrays()], [np.zeros_like(a) for a in w.arrays()]
    count = np.bincount(labels, minlength=len(langs)).astype(float)
    chance = (1 / np.maximum(count, 1))[labels]
    for k in range(1, rounds + 1):
        some = rng.choice(len(labels), batch, p=chance / chance.sum())
        for a, g, m, v in zip(w.arrays(), _gradients(w, windows[some].T, labels[some]), first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= (rate * (1 - 0.9 * k / rounds)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w


def _gradients(w: Weights, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Backpropagation through time of the mean cross-entropy over all positions."""
    time, n = windows.shape
    h = w.hidden
    sides = [_forward(w, windows, s) for s in (0, 1)]
    states = [np.empty((time, h, n), np.float32) for _ in sides]
    for s, steps in enumerate(sides):
        for step in steps:
            states[s][step[0]] = step[2]
    scores = w.out[0] @ states[0] + w.out[1] @ states[1] + w.bias
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    wrong = scores / scores.sum(axis=1, keepdims=True)
    wrong[:, labels, np.arange(n)] -= 1
    wrong /= time * n
    embed, recur, out = [np.zeros_like(a) for a in w.embed], [np.zeros_like(a) for a in w.recur], []
    for s, steps in enumerate(sides):
        out.append((wrong @ states[s].transpose(0, 2, 1)).sum(axis=0))
        into = w.out[s].T @ wrong
        later = np.zeros((h, n), np.float32)
        inputs = np.empty((3 * h, time, n), np.float32)
        for t, before, _, gates, raw, new, held in reversed(steps):
            d = into[t] + later
            z, r = gates[:h], gates[h:]
            d_raw = d * (1 - z) / (1 + np.abs(raw)) ** 2
            slope = 0.25 * ((gates > 0) & (gates < 1))
            d_z, d_r = d * (before - new) * slope[:h], d_raw * held * slope[h:]
            inputs[:, t] = np.concatenate([d_z, d_r, d_raw])
            d_re = np.concatenate([d_z, d_r, d_raw * r])
            recur[s] += d_re @ before.T
            later = d * z + w.recur[s].T @ d_re
        embed[s] += np.stack([np.bincount(windows.ravel(), unit.ravel(), 256) for unit in inputs])
    return [*embed, *recur, *out, wrong.sum(axis=(0, 2))[:, None]]


def label_positions(w: Weights, windows: np.ndarray) -> np.ndarray:
    """Probabilities (time, label, window) of each byte of windows (time, window)."""
    time, n = windows.shape
    scores = np.empty((time, len(w.langs), n), np.float32)
    for side in (0, 1):
        state = np.zeros((w.hidden, n), np.float32)
        for t in range(time) if side == 0 else range(time - 1, -1, -1):
            state = _step(np.take(w.embed[side], windows[t], axis=1), state, w.recur[side])[0]
            if side == 0:
                np.add(w.out[0] @ state, w.bias, out=scores[t])
            else:
                scores[t] += w.out[1] @ state
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def pool(w: Weights, texts: list[bytes], window: int = 64, most_windows: int = 4096) -> np.ndarray:
    """Mean probabilities (text, label) over all bytes of each text; each text starts a window of its own."""
    sizes = np.array(list(map(len, texts)), np.int64)
    spans = -(-sizes // window)
    first = np.cumsum(spans) - spans
    laid = np.full(int(spans.sum()) * window, 32, np.uint8)
    for t, a, n in zip(texts, (first * window).tolist(), sizes.tolist()):
        laid[a : a + n] = np.frombuffer(t, np.uint8)
    laid = laid.reshape(-1, window)
    filled = np.full(len(laid), window, np.int64)
    full = np.flatnonzero(spans)
    filled[(first + spans - 1)[full]] = (sizes - (spans - 1) * window)[full]
    sums = np.empty((len(laid), len(w.langs)))
    for a in range(0, len(laid), most_windows):
        part = laid[a : a + most_windows]
        each = label_positions(w, np.ascontiguousarray(part.T))
        short = np.flatnonzero(filled[a : a + most_windows] < window)
        total = each.sum(axis=0, dtype=np.float64).T
        for i in short.tolist():
            total[i] = each[: filled[a + i], :, i].sum(axis=0)
        sums[a : a + most_windows] = total
    out = np.zeros((len(texts), len(w.langs)))
    if len(full):
        out[full] = np.add.reduceat(sums, first[full], axis=0) / sizes[full, None]
    return out


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit(docs: DataFrame, usable: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 250, windows: int = 6, window: int = 64, most_texts: int = 50_000, **how) -> Weights | None:
    """Trains on a bounded sample of the usable, labelled rows; None if there are none."""
    known = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    ids = known.select("id", "lang").distinct()
    most = max(1, min(per_lang, most_texts // max(1, ids.select("lang").distinct().count())))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    some = F.broadcast(ids.withColumn("k", place).where(F.col("k") <= most).drop("k"))  # most_texts rows at most
    text = F.col("text")
    stretch = [F.substring(text, F.lit(1) + F.floor(F.length(text) * i / windows).cast("int"), F.lit(window)) for i in range(windows)]
    same = known.alias("a").join(some.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.lang") == F.col("b.lang")))
    each = same.select("a.id", "a.lang", F.xxhash64("text").alias("form"), F.array(*stretch).alias("parts"))
    rows = each.groupBy("id", "lang").agg(F.min_by("parts", "form").alias("parts")).select("lang", "parts").collect()
    found = sorted({(lang, part.encode("utf-8", "surrogatepass")[:window]) for lang, parts in rows for part in parts if part and _has_letter(part)})
    if not found:
        return None
    langs = sorted({lang for lang, _ in found})
    laid = np.full((len(found), window), 32, np.uint8)
    for row, (_, part) in zip(laid, found):
        row[: len(part)] = np.frombuffer(part, np.uint8)
    return train(laid, np.array([langs.index(lang) for lang, _ in found]), langs, **how)


def predict(docs: DataFrame, weights: Weights | None, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2_000_000) -> DataFrame:
    """id, held_out, lang_pred and score for each row. One pass over whole texts, no shuffle; only texts enter the network."""

    def block(texts: list[str | None]) -> Iterator[tuple[str, float]]:
        known = [weights is not None and t is not None and _has_letter(t) for t in texts]
        each = iter(pool(weights, [t.encode("utf-8", "surrogatepass") for t, ok in zip(texts, known) if ok])) if any(known) else iter(())
        for ok in known:
            p = next(each) if ok else None
            yield (UNKNOWN, 0.0) if p is None else (weights.langs[int(p.argmax())], float(min(1.0, p.max())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [p for _, texts in text_blocks(batch.column(2), block_bytes) for p in block(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
