"""Windows and packets of text, as column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_NONE = "array<string>"


def _slices(text: Column, size: int, stride: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(stride))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))


def stride_windows(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Windows of a fixed size that overlap (F8)."""
    return _slices(text, size, size - overlap)


def pack_paragraphs(text: Column, most: int = 4000, overlap: int = 0) -> Column:
    """Paragraphs put together up to a size; one that is longer by itself is cut into slices that may overlap."""
    start = F.struct(F.lit("").alias("buf"), F.array().cast(_NONE).alias("out"))

    def closed(acc: Column) -> Column:
        return F.when(acc["buf"] != "", F.concat(acc["out"], F.array(acc["buf"]))).otherwise(acc["out"])

    def add(acc: Column, p: Column) -> Column:
        fits = F.length(acc["buf"]) + F.length(p) + 2 <= most
        joined = F.when(acc["buf"] == "", p).otherwise(F.concat(acc["buf"], F.lit("\n\n"), p))
        long = F.length(p) > most
        out = F.when(fits, acc["out"]).when(long, F.concat(closed(acc), _slices(p, most, most - overlap))).otherwise(closed(acc))
        return F.struct(F.when(fits, joined).when(long, "").otherwise(p).alias("buf"), out.alias("out"))

    packed = F.aggregate(F.split(text, "\n\n"), start, add, closed)
    return F.when(F.length(text) <= most, F.array(text)).otherwise(packed)


def clause_windows(text: Column, most: int = 8000) -> Column:
    """Windows that end at the last empty line of their second half, or else at their size (F8)."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_NONE).alias("out"))
    n = F.length(text)

    def add(acc: Column, _: Column) -> Column:
        whole = F.substring(text, acc["at"] + 1, F.lit(most))
        from_end = F.instr(F.reverse(whole), "\n\n")
        back = F.length(whole) - from_end - 1  # characters before the last empty line
        size = F.when((acc["at"] + most < n) & (from_end > 0) & (back > most // 2), back).otherwise(F.length(whole))
        after = F.struct((acc["at"] + size).alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, size))).alias("out"))
        return F.when(acc["at"] < n, after).otherwise(acc)

    steps = F.sequence(F.lit(0), F.expr("0") + F.floor(n / F.lit(most // 2)).cast("int"))
    return F.when(n <= most, F.array(text)).otherwise(F.aggregate(steps, start, add, lambda acc: acc["out"]))


def _packed(pieces: list[str | None], most: int, least: int, overlap: int) -> list[str]:
    parts = [p.strip() for p in pieces if p and p.strip()]
    out, first = [], 0
    while first < len(parts):
        text, ends, at = "", [], first
        while at < len(parts) and len(text) < most:
            longer = f"{text}\n\n{parts[at]}" if text else parts[at]
            if text and len(longer) > most and len(text) >= least:
                break
            text = longer
            ends.append(len(text))
            at += 1
        out.append(text)
        if at == len(parts):
            break
        again = first + sum(end <= max(0, len(text) - overlap) for end in ends)
        first = again if again > first else at
    return out


def section_packets(pieces: Column, most: int = 1200, least: int = 400, overlap: int = 200) -> Column:
    """Pieces of a section put together up to a size, each packet beginning with the pieces in which the last one's end lies (F8).

    A packet under ``least`` characters takes another piece whatever its size; blank pieces go. Where a packet
    begins depends on the one before, so this runs in Python, in batches.
    """

    def pack(column: pa.Array) -> pa.Array:
        return pa.array([None if p is None else _packed(p, most, least, overlap) for p in column.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(pack, "array<string>")(pieces)


#: Kinds of documents of a collection.
KINDS = {"caselaw": "urteil", "legislation": "gesetz", "contracts": "vertrag", "legal-mc4": "legal_text", "other": "sonstige"}


def _record(uid: Column, packets: Column, one: Column, many: Column) -> Column:
    named = F.transform(packets, lambda c, i: F.struct(c.alias("text"), F.when(F.size(packets) > 1, F.concat(many, F.lit(" (part "), i + 1, F.lit(")"))).otherwise(one).alias("section")))
    return F.struct(F.substring(F.sha2(uid, 256), 1, 16).alias("doc_id"), named.alias("segments"))


def ruling_record(rid: Column, title: Column, text: Column, most: int = 4000) -> Column:
    """(doc_id, segments) of a ruling; null without an id or under 50 characters (F50). A title names all its parts."""
    i, body, name = F.trim(rid), F.trim(text), F.trim(F.coalesce(title, F.lit("")))
    plain = F.concat(F.lit("Corpus doc "), i)
    made = _record(F.concat(F.lit("gerdalir:"), i), pack_paragraphs(body, most), plain, plain)
    named = F.struct(made["doc_id"].alias("doc_id"), F.transform(made["segments"], lambda s: F.struct(s["text"].alias("text"), F.when(name != "", name).otherwise(s["section"]).alias("section"))).alias("segments"))
    return F.when((i != "") & (F.length(body) >= 50), named)


def shard_record(shard: Column, index: Column, kind: Column, text: Column, most: int = 4000, longest: int = 600_000) -> Column:
    """(doc_id, doc_type, segments) of a line of a shard; null under 200 characters, cut at 600,000."""
    body = F.substring(F.trim(text), 1, longest)
    made = _record(F.concat(F.lit("mlp:"), shard, F.lit(":"), index), pack_paragraphs(body, most), F.lit("Volltext"), F.lit("Volltext"))
    doc_type = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in KINDS.items()], F.lit("sonstige"))
    return F.when(F.length(body) >= 200, F.struct(made["doc_id"].alias("doc_id"), doc_type.alias("doc_type"), made["segments"].alias("segments")))
