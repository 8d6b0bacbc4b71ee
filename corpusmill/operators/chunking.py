"""Chunking of documents: greedy packing depends on what went before, so it runs in Python, batch by batch, over whole documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import ABBREVIATIONS

#: What may begin a section, at the start of a line.
SECTIONS = (
    r"^§§?\s*\d+",
    r"^(?:Art(?:ikel)?\.?\s*\d+)",
    r"^(?:Abschnitt|Kapitel|Teil|Unterabschnitt)\s+[IVX\d]+",
    r"^(?:Tenor|Tatbestand|Entscheidungsgründe|Gründe|Leitsatz|Leitsätze)\s*:?\s*$",
)
_SHORT = re.compile(rf"\b(?:{'|'.join(map(re.escape, ABBREVIATIONS))})\.\Z", re.IGNORECASE)
_WINDOW = 2 + max(map(len, ABBREVIATIONS))
_GAP = re.compile(r"(?<=[.!?])\s+(?=[A-ZÄÖÜ(§\[])")
_SECTIONS = [re.compile(p, re.MULTILINE) for p in SECTIONS]


def sentences(text: str) -> list[str]:
    """Splits after ``. ! ?`` before a capital, ``(``, ``§`` or ``[``, but not after an abbreviation (F2). As ``functions.text.sentences``; linear."""
    out, start = [], 0
    for gap in _GAP.finditer(text):
        if not _SHORT.search(text[max(0, gap.start() - _WINDOW) : gap.start()]):
            out.append(text[start : gap.start()].strip())
            start = gap.end()
    out.append(text[start:].strip())
    return [s for s in out if s]


def boundaries(text: str) -> list[tuple[int, str]]:
    """(offset, marker) of section starts, by offset; of two at one place both, in the order of SECTIONS."""
    return sorted(((m.start(), m.group().strip()) for p in _SECTIONS for m in p.finditer(text)), key=lambda b: b[0])


@dataclass(frozen=True)
class Sizes:
    target: int
    most: int
    least: int
    overlap: int = 0


PARENTS = Sizes(3072, 6144, 400)
CHILDREN = Sizes(1536, 1800, 200, 384)
CHUNKS = Sizes(1200, 2000, 200, 150)


def sections(text: str) -> list[tuple[str, str]]:
    """(section, text): one long text cut at its section starts, with an introduction if it is longer than 50 characters."""
    found = boundaries(text)
    if not found:
        return [("", text)]
    out = [("Einleitung", text[: found[0][0]])] if found[0][0] > 50 else []
    ends = [at for at, _ in found[1:]] + [len(text)]
    return out + [(marker, text[at:end]) for (at, marker), end in zip(found, ends)]


def parents(segments: list[tuple[str, str]], sizes: Sizes = PARENTS) -> list[tuple[str, str]]:
    """Packs segments of one section up to a size; too short a rest is dropped, too long a segment is cut at sentences."""
    out: list[tuple[str, str]] = []
    section, held = "", ""

    def flush() -> None:
        nonlocal held
        if len(held) >= sizes.least:
            out.append((section, held))
        held = ""

    for name, text in segments:
        text = text.strip()
        if name != section:
            flush()
            section = name
        for piece in [text] if len(text) <= sizes.most else pack(sentences(text), sizes.target):
            if held and len(held) + 2 + len(piece) > sizes.most and len(held) >= sizes.least:
                flush()
            held = f"{held}\n\n{piece}" if held else piece
            if len(held) >= sizes.target:
                flush()
    flush()
    return out


def pack(parts: list[str], target: int) -> list[str]:
    out, held = [], ""
    for p in parts:
        if held and len(held) + 1 + len(p) > target:
            out.append(held)
            held = ""
        held = f"{held} {p}" if held else p
    return out + [held] if held else out


def children(text: str, sizes: Sizes = CHILDREN) -> list[str]:
    """Packs sentences; each chunk begins with the last sentences of the one before, up to the overlap."""
    out: list[list[str]] = []
    held: list[str] = []
    fresh = False
    for s in sentences(text):
        if fresh and sum(map(len, held)) + len(held) + len(s) > sizes.target:
            out.append(held)
            kept: list[str] = []
            while len(kept) < len(held) - 1 and sum(map(len, kept)) + len(held[-1 - len(kept)]) <= sizes.overlap:
                kept.insert(0, held[-1 - len(kept)])
            held, fresh = kept, False
        held = [*held, s]
        fresh = True
    if fresh:
        out.append(held)
    if len(out) > 1 and len(" ".join(out[-1])) < sizes.least:
        tail = out.pop()
        out[-1] = out[-1] + [s for s in tail if s not in out[-1]]
    return [" ".join(c) for c in out]


def chunks(text: str, sizes: Sizes = CHUNKS) -> list[tuple[int, str, int, int]]:
    """(index, text, start, end) of greedy chunks with offsets; the overlap is taken from the text, up to white space."""
    spans, at = [], 0
    for s in sentences(text):
        start = text.index(s, at)
        at = start + len(s)
        for a in range(start, at, sizes.most):
            spans.append((a, min(a + sizes.most, at)))
    merged: list[list[int]] = []
    for a, b in spans:
        if merged and b - merged[-1][0] <= sizes.target:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    if len(merged) > 1 and merged[-1][1] - merged[-1][0] < sizes.least:
        last = merged.pop()
        merged[-1][1] = last[1]
    out = []
    for i, (a, b) in enumerate(merged):
        if i and sizes.overlap:
            back = max(merged[i - 1][0], a - sizes.overlap)
            space = text.find(" ", back, a)
            a = space + 1 if space >= 0 else a
        out.append((i, text[a:b], a, b))
    return out


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = CHUNKS) -> DataFrame:
    """(id, index, text, start, end): one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a document at a time bounds the memory
                found = chunks(batch.column(1)[i].as_py() or "", sizes)
                if found:
                    index, text, start, end = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(found), batch.column(0).type), pa.array(index, pa.int32()), pa.array(text), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["id", "index", "text", "start", "end"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, index int, text string, start bigint, end bigint")


def family_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, p, c, parent_chars, text): parents with their children, ids in the order of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = [(s, p, c, len(t), child) for p, (s, t) in enumerate(parents(sections(batch.column(1)[i].as_py() or ""))) for c, child in enumerate(children(t))]
                if rows:
                    section, p, c, size, text = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(rows), batch.column(0).type), pa.array(section), pa.array(p, pa.int32()), pa.array(c, pa.int32()), pa.array(size, pa.int64()), pa.array(text)], names=["id", "section", "p", "c", "parent_chars", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, section string, p int, c int, parent_chars bigint, text string")
