"""Numbers, dates, identifiers and legal references in text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def german_number(text: Column) -> Column:
    """``1.234,56 €`` and the like to a double; ``12.500`` is twelve thousand five hundred.

    With both marks the last one is decimal. A comma alone is decimal, one dot before three digits is for
    thousands; several marks of one kind alone make no number.
    """
    bare = F.regexp_replace(F.regexp_replace(text, r"€|EUR|Euro|USD|\$", ""), r"(?i)%|\bProzent\b", "")
    run = F.regexp_replace(F.regexp_extract(bare, r"-?\d(?:[\d.,\s\u00a0]*\d)?", 0), r"[\s\u00a0]", "")
    return F.transform(F.array(run), _number_of_run)[0]  # the run is worked out once


def _number_of_run(run: Column) -> Column:
    comma, dot = F.instr(run, ","), F.instr(run, ".")
    both = (comma > 0) & (dot > 0)
    german = F.replace(F.replace(run, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = F.replace(run, F.lit(","), F.lit(""))
    value = (
        F.when(both & (F.length(F.substring_index(run, ",", -1)) < F.length(F.substring_index(run, ".", -1))), german)
        .when(both, plain)
        .when(comma > 0, F.replace(run, F.lit(","), F.lit(".")))
        .when(run.rlike(r"^-?\d+\.\d{3}$"), F.replace(run, F.lit("."), F.lit("")))
        .otherwise(run)
    )
    return value.try_cast("double")


def currency(text: Column) -> Column:
    """USD if there is a dollar sign or USD, else EUR."""
    return F.when(text.contains("$") | F.upper(text).contains("USD"), "USD").otherwise("EUR")


#: The names of the bands of ``severity``.
SEVERITIES = ("info", "low", "medium", "high")


def severity(diff: Column, total: Column) -> Column:
    """The worse of the absolute and the relative band, 0 to 3."""
    d = F.abs(diff)
    share = d / F.greatest(F.abs(total), F.lit(1e-9))
    band = lambda x, a, b, c: F.when(x > c, 3).when(x > b, 2).when(x > a, 1).otherwise(0)
    return F.greatest(band(d, 0.5, 5.0, 100.0), band(share, 0.001, 0.005, 0.01))


def diverges(value: Column, winner: Column, abs_tol: float = 0.0, rel_tol: float = 0.02) -> Column:
    """Numeric divergence beyond both tolerances."""
    d = F.abs(value - winner)
    return (d > abs_tol) & (d / F.greatest(F.abs(winner), F.lit(1.0)) > rel_tol)


def urgency(days: Column) -> Column:
    """expired, urgent, soon or future."""
    return F.when(days < 0, "expired").when(days <= 30, "urgent").when(days <= 180, "soon").when(days.isNotNull(), "future")


def parcel_number(text: Column) -> Column:
    """Separators to a slash, five or more digits split in half, leading zeros off."""
    out = F.regexp_replace(F.trim(text), r"\s*[-_\\/]\s*", "/")
    n = F.length(out)
    half = F.expr("0") + F.floor(n / 2)
    out = F.when(out.rlike(r"^\d{5,}$"), F.concat(F.substring(out, F.lit(1), half), F.lit("/"), F.substring(out, half + 1, n))).otherwise(out)
    return F.array_join(F.transform(F.split(out, "/"), lambda p: F.when(p.rlike(r"^0+\d"), F.regexp_replace(p, r"^0+(?=\d)", "")).otherwise(p)), "/")


def parcel_id(district: Column, field: Column, number: Column) -> Column:
    """gemarkung:flur:number in lower case, without the title."""
    name = F.regexp_replace(F.lower(F.trim(district)), r"^gemarkung\s+", "")
    return F.concat_ws(":", name, F.regexp_replace(F.trim(field), r"^0+(?=\d)", ""), parcel_number(number))


CITATION = r"\[[CM]-\d+\]"


def citations(text: Column) -> Column:
    """Handles like [C-1], in order of first use."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CITATION), F.lit(0)))


def drop_unknown_citations(text: Column, allowed: Column) -> Column:
    """Handles outside ``allowed`` go, their sentences are marked before the full stop; doing it again changes nothing."""
    sentences = F.split(text, r"(?<=[.!?])(?=\s)")

    def fix(s: Column) -> Column:
        wrong = F.array_except(F.regexp_extract_all(s, F.lit(CITATION), F.lit(0)), allowed)
        bare = F.aggregate(wrong, s, lambda acc, h: F.replace(acc, h, F.lit("")))
        tidy = F.regexp_replace(F.regexp_replace(bare, r" {2,}", " "), r" +([.!?])", "$1")
        marked = F.when(tidy.contains("(unbelegt)"), tidy).otherwise(F.regexp_replace(tidy, r"(?s)\A(.*?)([.!?]?)\s*\z", "$1 (unbelegt)$2"))
        return F.when(F.size(wrong) > 0, marked).otherwise(s)

    return F.array_join(F.transform(sentences, fix), "")
