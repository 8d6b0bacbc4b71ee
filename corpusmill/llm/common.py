"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import checkpointed  # noqa: F401

#: A word, as the contracts define it: a run of characters other than ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_bucket(column: str, buckets: int):
    """crc32 of the id as text, modulo ``buckets``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(buckets)


def text_blocks(column: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of runs of rows with at most so many bytes, or one longer text. Only a run at a time becomes Python objects."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, column.slice(at, upto - at).to_pylist()
        at = upto
    pa.default_memory_pool().release_unused()


def ascii_words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased, as UTF-8 (null: none).

    ``bytes.lower`` and ``bytes.split`` touch ASCII alone, which is what the contracts ask for.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
