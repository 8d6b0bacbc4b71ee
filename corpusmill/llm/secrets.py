"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A byte-pair vocabulary was made from text, so it spends few tokens on what looks
like language and many on what looks like noise. A run of key-like characters
that gets fewer than ``dense_ratio`` characters a token is reported as ``dense``,
unless it is a known digest (hexadecimal of a usual length), a UUID, a number, or
an identifier (words joined by ``_ - . /`` or by capitals). Where a pattern covers
a part of a run, what is left on either side is tested as a run of its own.

Words around a random string would hide it in the average. So a run that is not
dense as a whole is cut at ``/ . = - _``: each stretch of parts between those that
are words, digests, UUIDs or numbers is tested, and where it is not dense each part.

Defined results: a null or empty text has no spans. Spans are in code points,
end exclusive, and cover the whole match; those that start together stand in the order
of KINDS. Whole texts are scanned, of any length, in time that grows with it; repeated
rows give repeated rows, an empty table none. ``scan`` reads no other columns, and
``redact`` hands them on, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import text_blocks

#: In this order, which also breaks ties.
KINDS = ("assign", "access", "hex", "dense")

_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=.-]{20,}")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: A part of a run between separators; a UUID is one.
_PART = re.compile(rf"(?<![A-Za-z0-9+]){_UUID.pattern}(?![A-Za-z0-9+])|[A-Za-z0-9+]+")
#: Characters a stretch has at least.
_LEAST = 20
_NUMBER = re.compile(r"[0-9.+/_=-]+")
_DIGEST = re.compile(r"[0-9a-fA-F]+")
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
_DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
#: Words of one case, numbers and marks; every character of a run is in one.
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[_./=+-]+")


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    spans = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    # A run that is too short has no match inside it either, so these two can ask for the length at once.
    spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def _identifier(run: str) -> bool:
    """Words joined by marks or capitals, from a word of two letters on, with numbers of four digits at most. Its
    words are long on average; random strings fall apart into short ones."""
    parts = _TOKEN.findall(run)
    words = [p for p in parts if p[0] not in "_./=+-"]
    if not words or parts[0] != words[0] or words[0].isdigit() or len(words[0]) < 2:
        return False
    return all(len(w) <= 4 for w in words if w.isdigit()) and sum(map(len, words)) >= 3.5 * len(words)


def _known(run: str) -> bool:
    return bool(_NUMBER.fullmatch(run) or _UUID.fullmatch(run) or _DIGEST.fullmatch(run) and len(run) in _DIGEST_LENGTHS)


def _plain(run: str) -> bool:
    return _known(run) or _identifier(run)


class Scanner:
    def __init__(self, ranks: bytes, pattern: str, dense_ratio: float = 1.8):
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.dense_ratio = dense_ratio

    def dense(self, run: str) -> bool:
        if len(run) < _LEAST or _plain(run):
            return False
        return len(run) < self.dense_ratio * len(self.coder.encode_ordinary(run))

    def dense_parts(self, run: str) -> list[tuple[int, int]]:
        """The whole run, or the stretches and parts in it that are dense, in order."""
        if self.dense(run):
            return [(0, len(run))]
        stretches: list[list[tuple[int, int]]] = [[]]
        for m in _PART.finditer(run):
            if _plain(m.group()):
                stretches.append([])
            else:
                stretches[-1].append(m.span())
        found = []
        for parts in stretches:
            if parts and self.dense(run[parts[0][0] : parts[-1][1]]):
                found.append((parts[0][0], parts[-1][1]))
            else:
                found += [(s, e) for s, e in parts if self.dense(run[s:e])]
        return found

    def dense_spans(self, text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """taken: by start."""
        found, at, reach = [], 0, 0
        for m in _RUN.finditer(text):
            if _known(m.group()):
                continue
            start = max(m.start(), reach)
            while at < len(taken) and taken[at][0] < m.end():
                found += self._between(text, start, taken[at][0])
                reach = max(reach, taken[at][1])
                start, at = max(start, reach), at + 1
            found += self._between(text, start, m.end())
        return found

    def _between(self, text: str, start: int, end: int) -> list[tuple[int, int, str]]:
        if end - start < _LEAST:
            return []
        return [(start + s, start + e, "dense") for s, e in self.dense_parts(text[start:end])]

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        if not text:
            return []
        base = pattern_spans(text)
        return sorted(base + self.dense_spans(text, base), key=lambda s: (s[0], KINDS.index(s[2])))

    def redact(self, text: str | None) -> str | None:
        """The text with every stretch of spans replaced by ``[secret]``."""
        spans = self.spans(text)
        if not spans:
            return text
        out, at = [], 0
        for start, end, _ in spans:
            if start >= at:
                out += [text[at:start], "[secret]"]
            at = max(at, end)
        return "".join(out) + text[at:]


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def scan(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", dense_ratio: float = 1.8) -> DataFrame:
    """Per row: counts of each kind, the hash of the pattern spans and all spans. One pass, no shuffle."""
    ranks = docs.sparkSession.sparkContext.broadcast(_vocabulary(path))  # one file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(ranks.value, pattern, dense_ratio)
        for batch in batches:
            rows = [scanner.spans(t) for _, texts in text_blocks(batch.column(1)) for t in texts]
            base = [[s for s in r if s[2] != "dense"] for r in rows]
            counts = [pa.array([sum(s[2] == k for s in r) for r in rows], pa.int64()) for k in KINDS]
            hashes = pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, hashes, pa.array(map(written, rows), pa.string())], names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text", length_col: str = "n_chars", dense_ratio: float = 1.8) -> DataFrame:
    """The same rows and columns with secrets taken out of the texts; a length column follows a changed text."""
    ranks = docs.sparkSession.sparkContext.broadcast(_vocabulary(path))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(ranks.value, pattern, dense_ratio)
        for batch in batches:
            parts = [pa.array([scanner.redact(t) for t in texts], pa.string()) for _, texts in text_blocks(batch)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    new = F.arrow_udf(run, "string", F.ArrowUDFType.SCALAR_ITER)(F.col(text_col))
    columns = {text_col: new}
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        columns[length_col] = F.when(new != F.col(text_col), F.length(new).cast(kind)).otherwise(F.col(length_col))
    return docs.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns))
