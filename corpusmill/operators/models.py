"""Where a model is called: plain functions over batches of texts, with deterministic stand-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embed = Callable[[list[str]], np.ndarray]
Score = Callable[[list[tuple[str, str]]], list[float]]


def hashed_embedding(dims: int = 64) -> Embed:
    """Words hashed into a unit vector: the offline stand-in for a model."""
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % dims] += 1.0 if h >> 31 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return embed


def embed_table(df: DataFrame, id_col: str, text_col: str, embed: Embed, *, batch: int = 32, dims: int | None = None) -> DataFrame:
    """(id, embedding): batches keep their order; a wrong number of dimensions raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, batch):
                part = b.slice(a, batch)
                vectors = embed([t or "" for t in part.column(1).to_pylist()])
                if dims is not None and vectors.shape[1] != dims:
                    raise ValueError(f"{vectors.shape[1]} dimensions instead of {dims}")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors.tolist(), pa.list_(pa.float32()))], names=["id", "embedding"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, embedding array<float>")


def overlap_scorer(pairs: list[tuple[str, str]]) -> list[float]:
    """Shared words over the question's: the offline stand-in for a cross-encoder."""
    out = []
    for q, p in pairs:
        a, b = set(q.lower().split()), set(p.lower().split())
        out.append(len(a & b) / max(1, len(a)))
    return out


def rerank_score(question: Column, passage: Column, score: Score = overlap_scorer, most: int = 2000) -> Column:
    """A score for each pair, passages cut at a length."""

    def run(q: pa.Array, p: pa.Array) -> pa.Array:
        return pa.array(score([(a or "", (b or "")[:most]) for a, b in zip(q.to_pylist(), p.to_pylist())]), pa.float64())

    return F.arrow_udf(run, "double", F.ArrowUDFType.SCALAR)(question, passage)


def all_terms(question: Column, passage: Column, tokens: Callable[[Column], Column]) -> Column:
    """Term frequency of a question's terms if all of them occur, else null (R4: an AND query ranked by frequency, without stemming)."""
    q, p = F.array_distinct(tokens(question)), tokens(passage)
    return F.when(F.size(F.array_except(q, p)) == 0, F.size(F.filter(p, lambda w: F.array_contains(q, w))))
