"""Writers. All write in parallel from the executors; the path is any that Spark writes to."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from corpusmill.session import checkpointed


class LawStore:
    """Laws as folders of sections, swapped whole and skipped if nothing changed.

    A write goes to a folder of its own version; the ledger, written last, says which version of each law holds, with
    its hash and counts. Readers follow the ledger: a write that fails in any task leaves what was there, and a law
    whose hash is the ledger's is not written again.
    """

    META = "slug string, version int, hash string, source string, n_sections bigint, n_paragraphs bigint"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def meta(self) -> DataFrame:
        """The row of each law that holds: the one of its latest version."""
        none = self.spark.createDataFrame([], self.META)
        none.write.mode("ignore").json(f"{self.folder}/meta")
        rest = [c.split(" ")[0] for c in self.META.split(", ")[1:]]
        rows = self.spark.read.schema(self.META).json(f"{self.folder}/meta")
        return rows.groupBy("slug").agg(F.max_by(F.struct(*rest), "version").alias("m")).select("slug", "m.*")

    def write(self, sections: DataFrame) -> DataFrame:
        """sections (slug, source, seq, enbez, title, text) -> the meta rows of the laws that were written."""
        body = F.sha2(F.coalesce("text", F.lit("")), 256)
        hashed = sections.withColumn("sha256", body)
        # A law's hash is that of its sections' hashes, whatever their order in the table: two sums of parts, and their number.
        mark = [F.sum(F.conv(F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("seq", "enbez", "title", "sha256"))), 256), at, 12), 16, 10).cast("decimal(38,0)")).cast("string") for at in (1, 13, 25)]
        laws = hashed.groupBy("slug").agg(F.concat_ws("-", F.count("*").cast("string"), *mark).alias("hash"), F.max("source").alias("source"), F.count("*").alias("n_sections"), F.count_if(F.startswith("enbez", F.lit("§"))).alias("n_paragraphs"))
        held = self.meta().select("slug", F.col("hash").alias("__hash"))
        changed = checkpointed(laws.join(held, "slug", "left").where("__hash is null or __hash <> hash").drop("__hash"))
        if changed.isEmpty():
            return self.spark.createDataFrame([], self.META)
        version = (self.meta().agg(F.max("version")).first()[0] or 0) + 1
        staged = hashed.join(changed.select("slug"), "slug", "left_semi")
        staged.write.mode("overwrite").partitionBy("slug").json(f"{self.folder}/sections/version={version}")
        named = changed.select("slug", F.lit(version).alias("version"), "hash", "source", "n_sections", "n_paragraphs")
        named.write.mode("append").json(f"{self.folder}/meta")
        return named

    def sections(self) -> DataFrame:
        """The sections of every law as it holds."""
        schema = "seq bigint, enbez string, title string, text string, source string, sha256 string, version int, slug string"
        held = self.meta().select("slug", "version")
        if held.isEmpty():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.folder}/sections").join(held, ["slug", "version"], "left_semi")


def write_segments(df: DataFrame, path: str, key: str, *, force: bool = False) -> DataFrame:
    """Writes the rows whose key is not there yet, and returns them."""
    spark = df.sparkSession
    todo = df
    if not force:
        try:
            done = spark.read.json(path).select(F.col(key).alias("__key"))
            todo = df.join(done, F.col(key) == F.col("__key"), "left_anti")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "UNRESOLVED_COLUMN.WITHOUT_SUGGESTION"):
                raise  # these three: nothing is written yet
    todo.write.mode("append").json(path)
    return todo


def _mark(df: DataFrame) -> Column:
    """A checksum of rows, whatever their order."""
    return F.coalesce(F.bit_xor(F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))), F.lit(0))


def backup(df: DataFrame, path: str) -> dict[str, int]:
    """A Parquet copy and its manifest: rows and a checksum, both counted from what was written."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    kept = df.sparkSession.read.parquet(f"{path}/data")
    rows, mark = kept.agg(F.count("*"), _mark(kept)).first()
    manifest = {"rows": rows, "checksum": mark}
    df.sparkSession.createDataFrame([(k, v) for k, v in manifest.items()], "name string, value long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def restore(existing: DataFrame | None, path: str, keys: list[str], spark: SparkSession) -> DataFrame:
    """The table with the backup's rows in place of those of their keys; others stay.

    A backup whose rows aren't those of its manifest raises, and nothing is restored.
    """
    kept = spark.read.parquet(f"{path}/data")
    manifest = {r.name: r.value for r in spark.read.schema("name string, value long").json(f"{path}/manifest").collect()}
    rows, mark = kept.agg(F.count("*"), _mark(kept)).first()
    if (rows, mark) != (manifest.get("rows"), manifest.get("checksum")):
        raise ValueError(f"{path}: {rows} rows with checksum {mark}, but its manifest says {manifest}")
    if existing is None:
        return kept
    both = [existing[k].eqNullSafe(F.col(f"__{k}")) for k in keys]
    given = kept.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    return existing.join(given, reduce(lambda a, b: a & b, both), "left_anti").unionByName(kept)


def audit_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed columns, times in ISO form, structures as JSON."""
    kinds = dict(df.dtypes)
    out = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS").alias(c) if kinds[c] == "timestamp" else F.to_json(c).alias(c) if kinds[c].startswith(("struct", "array", "map")) else F.col(c).cast("string").alias(c) for c in columns]
    df.select(*out).write.mode("overwrite").option("header", "true").csv(path)


def train_val(df: DataFrame, path: str, flag: str = "val", by: str | None = None) -> None:
    """JSON lines for training and validation, and the numbers of each, by a column's values if one is given."""
    df.where(~F.col(flag)).drop(flag).write.mode("overwrite").json(f"{path}/train")
    df.where(F.col(flag)).drop(flag).write.mode("overwrite").json(f"{path}/val")
    stats = df.groupBy(*([by] if by else [])).agg(F.count_if(~F.col(flag)).alias("train"), F.count_if(F.col(flag)).alias("val"), F.count("*").alias("total"))
    stats.coalesce(1).write.mode("overwrite").json(f"{path}/stats")


def portable(df: DataFrame) -> DataFrame:
    """Columns in types that any table store has (S22): whole numbers and truth values as bigint, other numbers as double,
    vectors of floats as packed bytes, other arrays, maps and structures as JSON text, the rest as text."""

    def one(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind in ("tinyint", "smallint", "int", "bigint", "boolean"):
            return c.cast("bigint")
        if kind in ("float", "double") or kind.startswith("decimal"):
            return c.cast("double")
        if kind == "binary":
            return c
        if kind in ("array<float>", "array<double>"):
            return _packed(c)
        if kind.startswith(("array", "map", "struct")):
            return F.to_json(c)
        return c.cast("string")

    return df.select(*[one(name, kind).alias(name) for name, kind in df.dtypes])


@F.pandas_udf(BinaryType())
def _packed(vectors: pd.Series) -> pd.Series:
    """Vectors as 32-bit floats side by side."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def export_tables(spark: SparkSession, tables: list[str], target: str, *, options: dict[str, str] | None = None) -> dict[str, int]:
    """Tables of the catalogue in portable types, by JDBC if the target is a ``jdbc:`` address and else as Parquet folders; rows of each.

    Executors write their parts side by side; columns and types come from the catalogue.
    """
    written = {}
    for name in tables:
        df = portable(spark.table(name))
        if target.startswith("jdbc:"):
            df.write.format("jdbc").options(url=target, dbtable=name, **(options or {})).mode("overwrite").save()
            written[name] = df.count()
        else:
            df.write.mode("overwrite").options(**(options or {})).parquet(f"{target.rstrip('/')}/{name}")
            written[name] = spark.read.parquet(f"{target.rstrip('/')}/{name}").count()
    return written
