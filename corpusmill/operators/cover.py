"""Ranking by cover density: texts that hold all stems of a question, by how close together they stand.

A cover is a shortest stretch of a text in which every stem occurs. Each counts a tenth over one
more than the words in it that are no hit, so scores rise with the number of covers and fall with their
gaps. One pass over the texts' words meets the question's stems, which are broadcast while they are
few; what is gathered are the hits of one question in one text.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.retrieval import MOST_TERMS, tokens
from corpusmill.operators.vectors import ranked

_VOWELS = "aeiouyäöü"
_REGION = regex.compile(rf"[{_VOWELS}][^{_VOWELS}]")
_BETWEEN = regex.compile(rf"(?<=[{_VOWELS}])[uy](?=[{_VOWELS}])")
_FIRST = regex.compile(r"(?:(?P<a>em|ern|er)|(?P<b>e|en|es)|(?<=[bdfghklmnrt])(?P<c>s))$")
_SECOND = regex.compile(r"(?:en|er|est|(?<=...[bdfghklmnt])st)$")
_THIRD = regex.compile(r"(?:end|ung|ig|ik|isch|lich|heit|keit)$")


def _longest(pattern: regex.Pattern, word: str) -> str:
    """The longest suffix that fits; patterns are anchored, so the first match from the left is the longest."""
    m = pattern.search(word)
    return m[0] if m else ""


def german_stem(word: str) -> str:
    """The stem of a lower-case German word by the published suffix rules: three steps within the regions R1 and R2."""
    w = _BETWEEN.sub(lambda m: m[0].upper(), word.replace("ß", "ss"))
    found = _REGION.search(w)
    r1 = found.end() if found else len(w)
    found = _REGION.search(w, r1)
    r2 = found.end() if found else len(w)
    r1 = max(r1, 3)

    m = _FIRST.search(w)
    if m and m.start() >= r1:
        w = w[: m.start()]
        if m["b"] and w.endswith("niss"):
            w = w[:-1]
    if (end := _longest(_SECOND, w)) and len(w) - len(end) >= r1:
        w = w[: -len(end)]
    end = _longest(_THIRD, w)
    at = len(w) - len(end)
    if end and at >= r2:
        head = w[:at]
        if end in ("end", "ung"):
            w = head[:-2] if head.endswith("ig") and not head.endswith("eig") and at - 2 >= r2 else head
        elif end in ("ig", "ik", "isch"):
            w = w if head.endswith("e") else head
        elif end in ("lich", "heit"):
            w = head[:-2] if head.endswith(("er", "en")) and at - 2 >= r1 else head
        else:
            inner = next((s for s in ("lich", "ig") if head.endswith(s)), "")
            w = head[: -len(inner)] if inner and at - len(inner) >= r2 else head
    return w.lower().translate(str.maketrans("äöü", "aou"))


def stems(words: Column, stem: Callable[[str], str] = german_stem) -> Column:
    """The stem of each word of an array, in Arrow batches; words of a batch are stemmed once."""

    def run(column: pa.Array) -> pa.Array:
        known: dict[str, str] = {}
        values = column.flatten().dictionary_encode()
        for w in values.dictionary.to_pylist():
            known[w] = stem(w)
        flat = pa.array([known[w] for w in values.dictionary.to_pylist()], pa.string()).take(values.indices)
        out, at = [], 0
        for n in pa.compute.list_value_length(column).to_pylist():
            out.append(None if n is None else flat.slice(at, n).to_pylist())
            at += n or 0
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(words)


def cover_sum(hits: Column, terms: Column) -> Column:
    """hits: array of (pos, term number) by place; terms: how many there are. The sum over all covers."""
    start = F.struct(F.transform(F.sequence(F.lit(1), terms), lambda _: F.lit(-1)).alias("last"), F.lit(-1).alias("begun"), F.lit(-1).alias("at"), F.lit(0.0).alias("sum"))

    def step(state: Column, hit: Column) -> Column:
        at = state["at"] + 1
        last = F.transform(state["last"], lambda v, j: F.when(j == hit["term"], at).otherwise(v))
        begin = F.array_min(last)
        noise = (hit["pos"] - F.get(hits, begin)["pos"]) - (at - begin)
        fresh = (begin >= 0) & (begin > state["begun"])
        return F.struct(last.alias("last"), F.when(fresh, begin).otherwise(state["begun"]).alias("begun"), at.alias("at"), (state["sum"] + F.when(fresh, F.lit(0.1) / (1 + noise)).otherwise(0.0)).alias("sum"))

    return F.aggregate(hits, start, step, lambda s: s["sum"])


def cover_density(questions: DataFrame, docs: DataFrame, *, id_col: str, text_col: str, k: int, stem: Callable[[str], str] | None = german_stem, stop: tuple[str, ...] = ()) -> DataFrame:
    """questions (qid, question) -> (qid, id, score, rank): the best k texts with all stems of each question.

    Stop words count as places in a text and are never asked for; a question without other words finds nothing.
    """
    cut = lambda text: tokens(text) if stem is None else stems(tokens(text), stem)
    words = F.filter(tokens(F.col("question")), lambda w: ~w.isin(*stop)) if stop else tokens(F.col("question"))
    asked = questions.select("qid", F.array_distinct(words if stem is None else stems(words, stem)).alias("terms")).where(F.size("terms") > 0)
    wanted = asked.select("qid", F.size("terms").alias("n"), F.posexplode("terms").alias("term", "word"))
    wanted = F.broadcast(wanted) if wanted.count() <= MOST_TERMS else wanted
    places = docs.select(F.col(id_col).alias("id"), F.posexplode(cut(F.coalesce(F.col(text_col), F.lit("")))).alias("pos", "word"))
    met = places.join(wanted, "word").groupBy("qid", "id", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("hits"))
    whole = met.where(F.size(F.array_distinct(F.transform("hits", lambda h: h["term"]))) == F.col("n"))
    return ranked(whole.select("qid", "id", F.round(cover_sum(F.col("hits"), F.col("n")), 6).alias("score")), k)
