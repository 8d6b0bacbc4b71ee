"""A kept inverted index: built once, added to, taken from, and asked by batches of questions.

In a folder that all machines share stand, as Parquet:

* ``postings``: a row for each term and block of documents, with the greatest frequency and
  least length in it (the block's maxima) and the documents as an array;
* ``documents``: length, terms and their frequencies of each document, from which postings are made and
  a removal knows what to take off;
* ``terms``: how many documents hold a term, with negative rows for removals;
* ``gone``: removed documents by segment;
* ``ledger``: a row for each addition and removal, written last. What it doesn't name isn't there.

An addition is a segment: a folder of its own in each table. Postings and terms are cut into
``buckets`` by a term's hash and sorted by term, documents by id, so a question reads the
folders of its terms' buckets alone, and a removal those of its ids.

Blocks are dealt by the hash of an id, the same for all terms, and hold about ``block``
documents. A question adds up the bounds of its terms for each block from the maxima alone,
scores the most promising blocks, and then every other block whose bound reaches the kth
score found there. That gives the same rows as scoring all postings.

One writer at a time; readers see what the ledger names when they begin. A write that fails
leaves a segment that is never named, and the next one takes its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators.retrieval import MOST_TERMS, tokens
from corpusmill.operators.vectors import ranked
from corpusmill.session import checkpointed

_LEDGER = "segment int, added boolean, n_docs bigint, total bigint, blocks bigint, bucket_count int, kind string, source string"


def _bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _kind(ledger: list) -> str:
    """The type of ids."""
    return ledger[0].kind if ledger else "bigint"


def _postings(kind: str) -> str:
    return f"term string, block bigint, max_tf int, min_len int, docs array<struct<id: {kind}, tf: int, len: int>>"


def counted(text: Column) -> Column:
    """(len, terms, tfs) of a text: its distinct tokens by name and how often each occurs. Equal ones lie together once sorted, so nothing is shuffled."""

    def runs(toks: Column) -> Column:
        first = lambda x, i: ~x.eqNullSafe(F.get(toks, i - 1))
        starts = F.filter(F.transform(toks, lambda x, i: i), lambda i: first(F.get(toks, i), i))
        sizes = F.transform(F.array(starts), lambda at: F.transform(at, lambda i, k: F.coalesce(F.get(at, k + 1), F.size(toks)) - i))[0]
        return F.struct(F.size(toks).alias("len"), F.filter(toks, first).alias("terms"), sizes.alias("tfs"))

    return F.transform(F.array(F.sort_array(tokens(text))), runs)[0]


class LexicalIndex:
    """An index in a folder; it need not be there yet."""

    def __init__(self, spark: SparkSession, folder: str, *, buckets: int = 32, block: int = 256):
        self.spark, self.folder, self.block = spark, folder.rstrip("/"), block
        spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in (c.split(" ") for c in _LEDGER.split(", ")))).write.mode("ignore").parquet(f"{self.folder}/ledger")
        rows = self._ledger()
        self.buckets, self.begun = rows[0].bucket_count if rows else buckets, bool(rows)

    def _ledger(self) -> list:
        """A row for each addition and removal."""
        return self.spark.read.schema(_LEDGER).parquet(f"{self.folder}/ledger").orderBy("segment").collect()

    def _write(self, df: DataFrame, name: str, segment: int, *sort: str) -> None:
        """Files of even size, whatever one term's share: a range of buckets, terms and blocks to each task."""
        keys = ["bucket", *sort]
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}/segment={segment}")

    def _write_documents(self, df: DataFrame, segment: int) -> None:
        """By hashes of ids, so that texts are cut once: ranges would first be sampled."""
        parts = -(-4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        dealt = df.withColumn("bucket", _bucket("id", self.buckets)).repartition("bucket", F.pmod(F.hash("id"), F.lit(parts)))
        dealt.sortWithinPartitions("bucket", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/documents/segment={segment}")

    def _named(self, segment: int, added: bool, stats, blocks: int, kind: str, source: str) -> None:
        row = [(segment, added, stats.n_docs, stats.total, blocks, self.buckets, kind, source)]
        self.spark.createDataFrame(row, _LEDGER).coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger")

    def _read(self, name: str, schema: str, rows: list, added: bool | None = None) -> DataFrame:
        """A table's named segments; the schema is given, so no file is opened for it."""
        segments = [r.segment for r in rows if added is None or r.added == added]
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}").where(F.col("segment").isin(segments))

    def _segment(self, name: str, segment: int, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/segment={segment}")

    def postings(self, rows: list | None = None) -> DataFrame:
        rows = self._ledger() if rows is None else rows
        return self._read("postings", f"{_postings(_kind(rows))}, segment int, bucket int", rows, True)

    def documents(self) -> DataFrame:
        """(id, len, terms, segment, bucket) of documents that are there."""
        rows = self._ledger()
        kind = _kind(rows)
        every = self._read("documents", f"id {kind}, len int, terms array<string>, segment int, bucket int", rows, True)
        return every.join(self._gone(rows, kind), ["id", "segment"], "left_anti")

    def _gone(self, rows: list, kind: str) -> DataFrame:
        return self._read("gone", f"id {kind}, of int, segment int, bucket int", rows, False).select("id", F.col("of").alias("segment"))

    def add(self, docs: DataFrame, *, id_col: str, text_col: str, source: str = "") -> int:
        """Adds documents and returns the segment's number.

        Rows without an id are left out; of rows with one id that of the least text counts. Ids that are there
        already take the new text's place.
        """
        rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null")
        repeated = rows.groupBy("id").count().where("count > 1").select("id")
        if not repeated.isEmpty():
            least = rows.join(repeated, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
            rows = rows.join(repeated, "id", "left_anti").unionByName(least)
        if any(r.added for r in self._ledger()):
            self.remove(rows.select("id"))
        segment, kind = self._next(), rows.schema["id"].dataType.simpleString()
        self._write_documents(rows.select("id", counted(F.col("text")).alias("c")).select("id", "c.len", "c.terms", "c.tfs"), segment)
        kept = self._segment("documents", segment, f"id {kind}, len int, terms array<string>, tfs array<int>")
        stats = kept.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).first()
        blocks = max(1, -(-stats.n_docs // self.block))
        each = kept.select("id", "len", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))
        placed = each.withColumn("bucket", _bucket("term", self.buckets)).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        # Dealt as the files are to be, before it is packed: each posting is shuffled once.
        dealt = placed.repartitionByRange("bucket", "term", "block")
        packed = dealt.groupBy("bucket", "term", "block").agg(F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), F.sort_array(F.collect_list(F.struct("id", "tf", "len"))).alias("docs"))
        packed.sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings/segment={segment}")
        made = self._segment("postings", segment, f"{_postings(kind)}, bucket int")
        self._write(made.groupBy("bucket", "term").agg(F.sum(F.size("docs")).cast("bigint").alias("df")), "terms", segment, "term")
        self._named(segment, True, stats, blocks, kind, source)
        return segment

    def _next(self) -> int:
        return max((r.segment for r in self._ledger()), default=-1) + 1

    def remove(self, ids: DataFrame) -> int:
        """Takes documents off and returns how many there were; only the folders of their ids' buckets are read."""
        ids = ids.toDF("id").where("id is not null").distinct().withColumn("bucket", _bucket("id", self.buckets))
        folders = [r.bucket for r in ids.select("bucket").distinct().collect()]  # no more than buckets
        found = self.documents().where(F.col("bucket").isin(folders)).join(ids, ["id", "bucket"], "left_semi")
        segment = self._next()
        self._write(found.select("id", F.col("segment").alias("of"), "len", "terms", "bucket"), "gone", segment, "id")
        kind = found.schema["id"].dataType.simpleString()
        kept = self._segment("gone", segment, f"id {kind}, of int, len int, terms array<string>")
        stats = kept.agg((-F.count("*")).alias("n_docs"), (-F.coalesce(F.sum("len"), F.lit(0))).alias("total")).first()
        if stats.n_docs:
            less = kept.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("df"))
            self._write(less.withColumn("bucket", _bucket("term", self.buckets)), "terms", segment, "term")
            self._named(segment, False, stats, 0, kind, "")
        return -stats.n_docs

    def frequencies(self, wanted: DataFrame, folders: list[int] | None = None, rows: list | None = None) -> DataFrame:
        """(term, df) of the wanted terms (column term), from their buckets."""
        rows = self._ledger() if rows is None else rows
        some = wanted.select("term").distinct().withColumn("bucket", _bucket("term", self.buckets))
        folders = folders if folders is not None else [r.bucket for r in some.select("bucket").distinct().collect()]
        every = self._read("terms", "term string, df bigint, segment int, bucket int", rows)
        return every.where(F.col("bucket").isin(folders)).join(some, ["term", "bucket"], "left_semi").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def _asked(self, queries: DataFrame, k1: float, b: float):
        """(postings of the terms' buckets with the terms' weights, a document's weight, what scores postings, number of hits)."""
        rows = self._ledger()
        n, total = sum(r.n_docs for r in rows), sum(r.total for r in rows)
        mean = total / n if n else 1.0
        wanted = queries.select("qid", F.explode(F.array_distinct("terms")).alias("term")).withColumn("bucket", _bucket("term", self.buckets))
        size, folders = wanted.agg(F.count("*"), F.collect_set("bucket")).first()  # no more than buckets
        idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        weighed = checkpointed(wanted.join(self.frequencies(wanted, folders, rows), "term").select("qid", "term", idf.alias("idf"), "bucket", "df"))
        hits = weighed.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
        weighed = weighed.drop("df")
        weighed = F.broadcast(weighed) if size <= MOST_TERMS else weighed
        gone = self._gone(rows, _kind(rows)) if any(not r.added for r in rows) else None

        def weight(tf: str, length: str) -> Column:
            return F.col("idf") * F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(length) / mean))

        def live(hits: DataFrame) -> DataFrame:
            each = hits.select("qid", "segment", "idf", F.inline("docs"))
            each = each if gone is None else each.join(gone, ["id", "segment"], "left_anti")
            return each.groupBy("qid", "id").agg(F.round(F.sum(weight("tf", "len")), 6).alias("score"))

        return self.postings(rows).where(F.col("bucket").isin(folders)).join(weighed, ["bucket", "term"]), weight, live, hits

    def top_k(self, queries: DataFrame, k: int, *, k1: float = 1.2, b: float = 0.75, first: int = 4, few: int = 2_000_000) -> DataFrame:
        """queries (qid, terms) -> (qid, id, score, rank): the best k of each, as ``retrieval.bm25`` gives them.

        Up to ``few`` hits of all questions are scored at once, which is less work than bounds; the rows are the same.
        """
        met, weight, live, hits = self._asked(queries, k1, b)
        if hits <= few:
            return ranked(live(met), k)
        bounds = checkpointed(met.groupBy("qid", "segment", "block").agg(F.sum(weight("max_tf", "min_len")).alias("bound")))
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "segment", "block"))
        best = bounds.withColumn("place", place).where(F.col("place") <= first).select("qid", "segment", "block")
        kth = ranked(live(met.join(best, ["qid", "segment", "block"], "left_semi")), k).where(F.col("rank") == k).select("qid", F.col("score").alias("kth"))
        reach = bounds.join(kth, "qid", "left").where("kth is null or bound + 0.000001 >= kth").select("qid", "segment", "block")
        return ranked(live(met.join(reach, ["qid", "segment", "block"], "left_semi")), k)

    def scores(self, queries: DataFrame, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(qid, id, score) of every document that holds a term; nothing is ranked."""
        met, _, live, _ = self._asked(queries, k1, b)
        return live(met)


def snapshot(files: DataFrame) -> str:
    """What files a table has now: a digest of their names, sizes and times, from the scan's metadata alone."""
    marks = files.select("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").alias("time")).distinct()
    return "-".join(f"{v & (1 << 64) - 1:x}" for v in marks.agg(F.count("*"), *(F.coalesce(F.bit_xor(F.xxhash64(F.lit(seed), "file_path", "file_size", "time")), F.lit(0)) for seed in (1, 2))).first())


def index_of(spark: SparkSession, folder: str, docs: DataFrame, *, id_col: str, text_col: str, source: str) -> LexicalIndex:
    """The index of a table as it stands: kept under its source's mark, and built where there is none yet."""
    index = LexicalIndex(spark, f"{folder.rstrip('/')}/{source}")
    if not index.begun:
        index.add(docs, id_col=id_col, text_col=text_col, source=source)
    return index
