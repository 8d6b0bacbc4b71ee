"""Structured Streaming forms of the incremental work. Watermarked windows are an extension: the polling they replace has no event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def files(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    """New files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def timed(events: DataFrame) -> DataFrame:
    """Event time must be an instant; times without a zone are taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def rates(events: DataFrame, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by window and type, late rows up to a bound."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return timed(events).withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user by inactivity (an extension)."""
    return timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """Each key once while the watermark holds it."""
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def top_up(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every batch goes through a merge that gives the same if it is run again."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class TopUp:
    """A table that a stream tops up, with a ledger.

    A batch's rows stand in a folder of the batch's number, its row in the ledger is written after them: number,
    rows, bytes of the mark column's greatest value so far. So a batch that is run again replaces itself, one that failed
    halfway isn't read, and counts come from the pass that writes, by observation.
    """

    LEDGER = "batch bigint, rows bigint, mark {kind}"

    def __init__(self, spark: SparkSession, folder: str, mark: str):
        self.spark, self.folder, self.mark = spark, folder.rstrip("/"), mark

    def ledger(self, kind: str = "bigint") -> DataFrame:
        none = self.spark.range(0).select(F.lit(0).cast("bigint").alias("rows"), F.lit(None).cast(kind).alias("mark"), F.col("id").alias("batch"))
        none.write.mode("ignore").partitionBy("batch").parquet(f"{self.folder}/ledger")
        return self.spark.read.schema(self.LEDGER.format(kind=kind)).parquet(f"{self.folder}/ledger")

    def put(self, df: DataFrame, batch: int) -> None:
        kind, seen = df.schema[self.mark].dataType.simpleString(), Observation()
        if self.ledger(kind).where(F.col("batch") == batch).count():
            return
        df.observe(seen, F.count("*").alias("rows"), F.max(self.mark).alias("mark")).write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch}")
        found = seen.get
        row = self.spark.createDataFrame([(found.get("rows") or 0, found.get("mark"))], f"rows bigint, mark {kind}")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={batch}")

    def rows(self, schema: str) -> DataFrame:
        """The rows of the batches that the ledger names."""
        named = self.ledger().select("batch")
        return self.spark.read.schema(f"{schema}, batch bigint").parquet(f"{self.folder}/rows").join(F.broadcast(named), "batch", "left_semi")  # a row for each batch

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return top_up(stream, self.put, checkpoint)


def watch(spark: SparkSession, folder: str, glob: str, done: Callable[[], DataFrame], process: Callable[[DataFrame], None], checkpoint: str, *, per_trigger: int = 100) -> StreamingQuery:
    """Files of a folder that have no result yet.

    Each batch of new files (path, modificationTime, length, content) loses those whose stem ``done()`` has, which is
    read anew for every batch, and goes to ``process``; the checkpoint remembers which files were seen.
    """
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)

    def batch(df: DataFrame, _: int) -> None:
        named = df.withColumn("stem", stem)
        process(named.join(done().select("stem").distinct(), "stem", "left_anti"))

    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(folder)
    return found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stale(uploads: DataFrame, touched: str, as_of, hours: int = 24) -> DataFrame:
    """Uploads last touched over a day ago."""
    return uploads.where(F.col(touched) < as_of - F.expr(f"INTERVAL {hours} HOURS"))
