"""Remote registries as a Spark data source: the reader takes a fetch function by name, which offline is a fixed answer."""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def offline(key: str) -> str:
    """The stand-in for a request."""
    return json.dumps({"key": key, "found": bool(key)})


def with_retry(fetch: Callable[[str], str], times: int = 3, wait: float = 0.0) -> Callable[[str], str]:
    """Tries again after connection errors only."""

    def run(key: str) -> str:
        for k in range(times):
            try:
                return fetch(key)
            except (ConnectionError, TimeoutError):
                if k + 1 == times:
                    raise
                time.sleep(wait * 2**k)
        raise AssertionError

    return run


class _Keys(InputPartition):
    def __init__(self, keys: list[str]):
        self.keys = keys


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.keys = [k for k in options.get("keys", "").split(",") if k]
        self.per_task = int(options.get("pertask", "50"))
        self.fetch = options.get("fetch", "corpusmill.sources.remote:offline")
        self.times, self.wait = int(options.get("times", "3")), float(options.get("wait", "0"))
        self.per_second = float(options.get("persecond", "0"))

    def partitions(self) -> list[InputPartition]:
        return [_Keys(self.keys[i : i + self.per_task]) for i in range(0, len(self.keys), self.per_task)] or [_Keys([])]

    def read(self, partition: _Keys) -> Iterator[tuple[str, str]]:
        module, _, name = self.fetch.partition(":")
        fetch = with_retry(getattr(importlib.import_module(module), name), self.times, self.wait)
        for key in partition.keys:
            began = time.monotonic()
            answer = fetch(key)
            if self.per_second:
                time.sleep(max(0.0, 1 / self.per_second - (time.monotonic() - began)))
            yield key, answer


class Registry(DataSource):
    """``spark.read.format("registry").option("keys", "a,b")``: one row a key, dealt over tasks.

    Options: ``fetch`` (module:function that takes a key and returns text), ``pertask`` (keys), ``times`` and ``wait`` (retries
    after connection errors), ``persecond`` (requests of one task at most; with tasks side by side divide the registry's limit).
    """

    @classmethod
    def name(cls) -> str:
        return "registry"

    def schema(self) -> str:
        return "key string, answer string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def fetched(keys: DataFrame, fetch: str, *, tasks: int = 8, per_second: float = 0.0, times: int = 3, wait: float = 0.0) -> DataFrame:
    """keys (key), a table or a stream -> (key, answer), by ``fetch`` (module:function) in the tasks.

    The keys never come to the driver. ``tasks`` ask side by side and share ``per_second``. As a stream over a folder
    of keys the checkpoint holds the offsets, so a restart asks for what is left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        module, _, name = fetch.partition(":")
        ask, pause = with_retry(getattr(importlib.import_module(module), name), times, wait), tasks / per_second if per_second else 0.0
        for batch in batches:
            answers = []
            for key in batch.column(0).to_pylist():
                began = time.monotonic()
                answers.append(ask(key))
                time.sleep(max(0.0, pause - (time.monotonic() - began)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string())], names=["key", "answer"])

    return keys.select(F.col("key").cast("string").alias("key")).repartition(tasks).mapInArrow(run, "key string, answer string")


def tiled(boxes: DataFrame, width: float) -> DataFrame:
    """boxes (id, south, west, north, east) -> (id, row, col, south, west, north, east): tiles of at most ``width`` degrees, so that an answer stays bounded."""
    n = lambda a, b: F.greatest(F.ceil((F.col(b) - F.col(a)) / width), F.lit(1)).cast("int")
    cut = boxes.withColumn("rows", n("south", "north")).withColumn("cols", n("west", "east"))
    each = cut.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    high, wide = (F.col("north") - F.col("south")) / F.col("rows"), (F.col("east") - F.col("west")) / F.col("cols")
    return each.select(
        "id", "row", "col", (F.col("south") + F.col("row") * high).alias("south"), (F.col("west") + F.col("col") * wide).alias("west"),
        (F.col("south") + (F.col("row") + 1) * high).alias("north"), (F.col("west") + (F.col("col") + 1) * wide).alias("east"),
    )
