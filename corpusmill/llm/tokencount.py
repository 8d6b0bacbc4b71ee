"""Token counts through a cache of digests.

A text goes by the digest of its normalised content, and a tokenizer by the digest of its
file and its library's version. What the cache knows of both is joined; of the rest every
distinct content is encoded once, and its count is appended. So a second run over the same
texts encodes nothing, and a new tokenizer starts a folder of its own.

Normalised means what the tokenizer itself makes of a text before it cuts it, so texts with
one digest have one count. Most byte-level tokenizers change nothing; then the digest is
taken by Spark, without Python. Special strings are no part of what is normalised.

What is shuffled are digests, and the texts of misses, each at most once from a task: tasks
forget copies before the shuffle, so no content is hot there. Few misses are looked up by a
broadcast (``few`` digests of 32 bytes at most); then other texts aren't shuffled at all.
The counts are joined to documents by digest, which adaptive execution splits where many
share one.

An append is one Spark write, which is committed as a whole; lost tasks are made again. Two
runs at once may both append a count, which is the same, and counts as one when read.

Defined results: a null text counts as an empty one, with no bytes and no tokens. Repeated
rows, repeated and null ids get a row each; an empty table gives none. Texts are encoded
whole: byte-level tokenizers cut them into words and the like, which no token crosses, and a
worker encodes such a piece once while it remembers it; texts of over a million characters are
taken in parts cut between a letter and a blank with a letter. Other columns
are not read, whatever their names. There are no ties.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import checkpointed, text_blocks

#: Texts of more characters are encoded in pieces where that is exact.
LONG = 1_000_000
#: Digests that a task remembers in order to drop copies before the shuffle; more cost copies, not results.
REMEMBERED = 500_000
_CUT = regex.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
#: How byte-level tokenizers cut a text into pieces, none of which a token crosses.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters of which the regex module and the tokenizers library know the same (a test asks for each); texts with others are cut by the library.
_AGREED = regex.compile(r"[\x00-\u052F\u0600-\u06FF\u0900-\u0BFF\u0E00-\u0E7F\u1E00-\u206F\u20A0-\u2BFF\u3000-\u9FFF\uAC00-\uD7A3\uFE00-\uFE0F\uFF00-\uFFEF\U0001F300-\U0001FAFF]*+")
#: Pieces whose counts a worker remembers: so many, of so many characters at most.
_PIECES_KEPT, _PIECE_LENGTH = 400_000, 32
_KNOWN: dict[str, dict[str, int]] = {}


class Tokenizer:
    """Counts tokens as the library of the file's kind does: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, name: str, data: bytes):
        self.pieces, self.special, self.normal = name.endswith(".model"), None, None
        if self.pieces:
            import sentencepiece

            self.coder = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.normal, self.cut = self.coder.normalize, False
            return
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        spec, self.coder = json.loads(data), tokenizers.Tokenizer.from_str(data.decode())
        self.coder.no_truncation()
        self.coder.no_padding()
        added, cutter = spec.get("added_tokens") or [], spec.get("pre_tokenizer") or {}
        if self.coder.normalizer is not None:
            self.normal = self.coder.normalizer.normalize_str
            if added:
                self.special = regex.compile("(" + "|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))) + ")")
        if self.normal is None and added:
            self.split = regex.compile("(" + "|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))) + ")").split
        else:
            self.split = lambda text: [text]
        self.known = _KNOWN.setdefault(hashlib.sha256(data).hexdigest(), {})
        self.cut = (
            self.normal is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space", True)
            and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        )

    def digest(self, text: str) -> bytes:
        """Of the normalised content; special strings stay as they are, marked."""
        parts = self.special.split(text) if self.special else [text]
        made = [("s" if k % 2 else "n") + (p if k % 2 or self.normal is None else self.normal(p)) for k, p in enumerate(parts)]
        return hashlib.sha256("".join(f"{len(p)}:{p}" for p in made).encode()).digest()

    def parts(self, text: str) -> list[str]:
        out, at = [], 0
        while self.cut and len(text) - at > LONG and (m := _CUT.search(text, at + LONG // 2)):
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]]

    def counts(self, texts: list[str]) -> list[int]:
        if self.pieces:
            return [len(self.coder.encode(t)) for t in texts]
        if not self.cut:
            return self._encoded(texts)
        by_pieces = [_AGREED.fullmatch(t) is not None for t in texts]
        whole = iter(self._encoded([t for t, fine in zip(texts, by_pieces) if not fine]))
        return [sum(map(self._in_pieces, self.parts(t))) if fine else next(whole) for t, fine in zip(texts, by_pieces)]

    def _encoded(self, texts: list[str]) -> list[int]:
        cut = [self.parts(t) for t in texts]
        found = iter(map(len, self.coder.encode_batch_fast([p for ps in cut for p in ps], add_special_tokens=False)))
        return [sum(next(found) for _ in ps) for ps in cut]

    def _in_pieces(self, text: str) -> int:
        """The sum over pieces, each of which the library encodes once while it is remembered."""
        known, total = self.known, 0
        for k, part in enumerate(self.split(text)):
            if k % 2:
                total += 1
                continue
            pieces = _PIECES.findall(part)
            if new := list({p for p in pieces if p not in known}):
                known.update(zip(new, map(len, self.coder.encode_batch_fast(new, add_special_tokens=False))))
            total += sum(map(known.__getitem__, pieces))
            for p in new:
                if len(p) > _PIECE_LENGTH or len(known) > _PIECES_KEPT:
                    del known[p]
        return total


class Cache:
    """Counts by digest of one tokenizer, as Parquet in a folder that all machines share; the folder's name is the tokenizer's digest."""

    def __init__(self, spark: SparkSession, folder: str, tokenizer: str):
        with open(tokenizer, "rb") as f:
            self.data = f.read()
        self.spark, self.name = spark, os.path.basename(tokenizer)
        if self.name.endswith(".model"):
            import sentencepiece as library
        else:
            import tokenizers as library
        version = f"{library.__name__} {library.__version__} {self.name.rpartition('.')[2]} ".encode()
        self.version = hashlib.sha256(version + self.data).hexdigest()
        self.path = f"{folder.rstrip('/')}/{self.version}"

    def read(self) -> DataFrame:
        """(digest, n_tokens), a row for each digest. A folder that isn't there yet is made, empty."""
        none = self.spark.range(0).select(F.lit(b"").alias("digest"), F.col("id").alias("n_tokens"))
        none.write.mode("ignore").parquet(self.path)
        return self.spark.read.schema("digest binary, n_tokens bigint").parquet(self.path).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame) -> None:
        counts.select("digest", "n_tokens").write.mode("append").parquet(self.path)


def _digested(docs: DataFrame, sent, name: str, native: bool) -> DataFrame:
    """(id, digest, text) with null texts as empty ones."""
    docs = docs.select("id", F.coalesce("text", F.lit("")).alias("text"))
    if native:
        return docs.select("id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Tokenizer(name, sent.value)
        for batch in batches:
            for at, texts in text_blocks(batch.column(1)):
                some = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(map(coder.digest, texts), pa.binary()), some.column(1)], names=["id", "digest", "text"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, digest binary, text string")


def _without_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for batch in batches:
        new = []
        for digest in batch.column(0).to_pylist():
            new.append(digest not in seen)
            if len(seen) < REMEMBERED:
                seen.add(digest)
        yield batch.filter(pa.array(new, pa.bool_()))


def _counted(texts: DataFrame, misses: DataFrame, sent, name: str) -> DataFrame:
    """(digest, n_tokens) of each miss. Misses come as rows without a text, in front of the texts of their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, wanted = Tokenizer(name, sent.value), None
        for batch in batches:
            for at, some in text_blocks(batch.column(2)):
                mine, found = [], []
                for digest, text in zip(batch.column(0).slice(at, len(some)).to_pylist(), some):
                    if text is None:
                        wanted = digest
                    elif digest == wanted:
                        mine.append(digest)
                        found.append(text)
                        wanted = None
                yield pa.RecordBatch.from_arrays([pa.array(mine, pa.binary()), pa.array(coder.counts(found), pa.int64())], names=["digest", "n_tokens"])

    marks = misses.select("digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"))
    rows = marks.unionByName(texts.select("digest", F.lit(1).alias("kind"), "text"))
    return rows.repartition("digest").sortWithinPartitions("digest", "kind").mapInArrow(run, "digest binary, n_tokens bigint")


def count(docs: DataFrame, tokenizer: str, cache: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, few: int = 200_000) -> DataFrame:
    """Per row: n_bytes (UTF-8), n_tokens, and over_limit (more than ``limit`` tokens).

    tokenizer: a file on the driver, of fixed size, which is sent to the tasks. cache: a folder that all machines share.
    """
    spark = docs.sparkSession
    kept = Cache(spark, cache, tokenizer)
    sent = spark.sparkContext.broadcast(kept.data)
    native = Tokenizer(kept.name, kept.data).normal is None
    rows = _digested(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), sent, kept.name, native)
    keyed = checkpointed(rows.select("id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes")))
    misses = checkpointed(keyed.select("digest").distinct().join(kept.read(), "digest", "left_anti"))
    if n := misses.count():
        texts = rows.select("digest", "text")
        if n <= few:
            texts = texts.join(F.broadcast(misses), "digest", "left_semi")
        kept.append(_counted(texts.mapInArrow(_without_copies, "digest binary, text string"), misses, sent, kept.name))
    found = keyed.join(kept.read(), "digest", "left")
    n_tokens = F.coalesce("n_tokens", F.raise_error(F.lit("a count is missing in the cache")).cast("bigint"))
    return found.select(F.col("id").alias(id_col), "n_bytes", n_tokens.alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
