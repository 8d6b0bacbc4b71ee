"""Quality rules: a decision list learned by sequential covering.

Labelled documents' text statistics are split into a growing and a pruning part.
A rule is grown by adding threshold conditions while they gain information, then
pruned from its end while that helps on the pruning part; what it covers is set
aside and the next rule is grown. The list is emitted as one ordered Spark
conditional expression: the first rule that holds rejects a document.

A rule is accepted only at ``least_precision`` on what is left of both parts, so
that clean documents stay.

Bound: at most ``max_labelled`` labelled documents are learned from (those whose
ids hash lowest). Statistics are computed over whole texts of all documents.

Defined results: null, empty or wordless texts have no words and fail the base
rules. An id labelled more than once counts with its worst label; of rows that share
an id that of the least text hash is learned from. Without labels of both kinds the
list is empty and only the base rules decide; an empty table gives no rows. Of
conditions that gain as much the first tried is taken. Repeated rows give repeated
rows, and texts of any length are counted whole. ``keep`` hands on other columns,
whatever their names; nothing else reads them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import text_blocks

SYMBOLS = "#*$%&|<>"
_WHITE = " \t\n\x0b\x0c\r"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_upper", "n_digits", "n_stops", "n_symbol_words")

#: Name and expression of each feature, over the counts; ratios are over at least one word, line or character.
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "symbol_word_share": "n_symbol_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "stops_per_word": "n_stops / greatest(n_words, 1)",
}


def repeated_words(words: list) -> int:
    """Words in 3-word windows that occur twice or more in the text, first ones included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    total, upto = 0, 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def counts_of(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in text.split("\n") if line.strip(_WHITE)]
    return (
        len(words),
        len(text) - sum(map(text.count, _WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(set(words)),
        len(lines),
        len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        len(raw) - len(raw.translate(None, b"0123456789")),
        len(raw) - len(raw.translate(None, b".!?")),
        len(raw.translate(bytes(1 if chr(b) in SYMBOLS else 32 for b in range(256))).split()),
    )


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts...) for each row, over whole texts. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [counts_of(t) for _, texts in text_blocks(batch.column(1)) for t in texts]
            table = np.array(rows, np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, i]) for i in range(len(COUNTS)))], names=["id", *COUNTS])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS))


def statistics_of(text: Column) -> Column:
    """The counts as one struct column, for tables whose other columns must stay."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            table = np.array([counts_of(t) for _, texts in text_blocks(batch) for t in texts], np.int64).reshape(-1, len(COUNTS))
            yield pa.StructArray.from_arrays([pa.array(table[:, i]) for i in range(len(COUNTS))], names=list(COUNTS))

    return F.arrow_udf(run, "struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">", F.ArrowUDFType.SCALAR_ITER)(text)


BASE_FAILED = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        v = table[self.feature]
        return v > self.threshold if self.above else v <= self.threshold

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def covered(rule: Rule, table: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(table)
    return out


def _cuts(values: np.ndarray, bad: np.ndarray, n: int) -> np.ndarray:
    """Thresholds half way between neighbouring values: at quantiles, and at both ends of the bad rows' range."""
    each = np.unique(values)
    if len(each) < 2:
        return each[:0]
    at = np.searchsorted(each, np.quantile(values, np.linspace(0, 1, n + 2)[1:-1]), side="right") - 1
    ends = np.searchsorted(each, [bad.min(), bad.max()])
    at = np.unique(np.clip(np.concatenate([at, ends - 1, ends]), 0, len(each) - 2))
    return (each[at] + each[at + 1]) / 2


def _grow(table: dict[str, np.ndarray], bad: np.ndarray, most: int, cuts: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < most:
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for name, values in table.items():
            for cut in _cuts(values[inside], values[inside & bad], cuts):
                for above in (True, False):
                    got = inside & ((values > cut) if above else (values <= cut))
                    p, n = int((got & bad).sum()), int((got & ~bad).sum())
                    if p:
                        g = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                        if g > gain:
                            best, gain = Condition(name, above, float(cut)), g
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(table)
    return rule


def _prune(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        got = covered(r, table, len(bad))
        p, n = int((got & bad).sum()), int((got & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=rule)


def learn(table: dict[str, np.ndarray], bad: np.ndarray, *, least_precision: float = 0.95, least_cover: int = 3, most_rules: int = 12, most_conditions: int = 4, cuts: int = 48) -> list[Rule]:
    """Sequential covering. Every third row prunes, the others grow."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    prunes = np.arange(len(bad)) % 3 == 2
    while len(rules) < most_rules and (left & bad).any():
        part = lambda rows: ({k: v[rows] for k, v in table.items()}, bad[rows])
        growing, pruning = part(left & ~prunes), part(left & prunes)
        rule = _grow(*growing, most_conditions, cuts)
        if not rule:
            break
        rule = _prune(rule, *pruning)
        got = covered(rule, table, len(bad)) & left
        p, n = int((got & bad).sum()), int((got & ~bad).sum())
        if p < least_cover or p < least_precision * (p + n):
            break
        rules.append(rule)
        left &= ~got
    return rules


def expression(rules: list[Rule]) -> Column:
    """The ordinal of the first rule that holds, from 1; null if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        held = F.expr(" and ".join(c.sql() for c in rule))
        out = F.when(held, F.lit(k)) if out is None else out.when(held, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def learn_from(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", max_labelled: int = 20_000, **how) -> list[Rule]:
    """Learns the list from docs with a label (0: bad). Of the labelled ids the ``max_labelled`` of least hash are used."""
    each = labels.where(F.col(label_id).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(label_id).alias("label_id")).agg(F.min(label_col).alias("label"))
    some = F.broadcast(each.orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(some, F.col("id") == F.col("label_id"))
    counted = rows.select("id", "label", F.xxhash64("text").alias("form"), statistics_of(F.col("text")).alias("s")).groupBy("id", "label").agg(F.min_by("s", "form").alias("s")).select("id", "label", "s.*")
    # Documents that the base rules reject anyway teach nothing.
    sample = counted.where(f"not {BASE_FAILED}").selectExpr("id", "label", *(f"double({e}) as {n}" for n, e in FEATURES.items())).toPandas()
    sample = sample.iloc[np.argsort(sample["id"].to_numpy(), kind="stable")]
    rng = np.random.default_rng(7)
    sample = sample.iloc[rng.permutation(len(sample))]
    bad = (sample["label"].to_numpy() == 0) if len(sample) else np.zeros(0, bool)
    if not bad.any() or bad.all():
        return []
    return learn({n: sample[n].to_numpy(np.float64) for n in FEATURES}, bad, **how)


def judge(docs: DataFrame, rules: list[Rule], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the base counts, base_failed, kept, and which rule rejects (null: none)."""
    stats = statistics(docs, id_col=id_col, text_col=text_col)
    rule = expression(rules)
    return stats.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr(BASE_FAILED).alias("base_failed"), (~F.expr(BASE_FAILED) & rule.isNull()).alias("kept"), rule.alias("rule"),
    )


def keep(docs: DataFrame, rules: list[Rule], *, text_col: str = "text") -> DataFrame:
    """The documents, all columns, that neither the base rules nor the list rejects."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    counted = docs.select(whole.alias("whole"), statistics_of(F.col(text_col)).alias("counts")).select("whole", "counts.*")
    rejected = [BASE_FAILED, *(" and ".join(c.sql() for c in rule) for rule in rules)]
    return counted.where(f"not ({' or '.join(f'({r})' for r in rejected)})").select("whole.*")
