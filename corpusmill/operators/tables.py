"""Tables of amounts: what each row is, and whether sums agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import values as V

#: Words in a row's label that say what it is.
TOTAL_LABELS = ("summe", "gesamt", "gesamtsumme", "gesamtbetrag", "total", "endbetrag", "rechnungsbetrag")
VAT_LABELS = ("ust", "umsatzsteuer", "mwst", "mehrwertsteuer", "vat")
NET_LABEL, GROSS_LABEL = "netto", "brutto"
#: Rates of value-added tax, and how far a rate may be off.
VAT_RATES, VAT_TOLERANCE = (0.19, 0.07), 0.005


def row_label(cells: Column) -> Column:
    """The first cell that is not blank, in lower case."""
    return F.coalesce(F.get(F.filter(F.transform(cells, lambda c: F.lower(F.trim(c))), lambda c: c != ""), F.lit(0)), F.lit(""))


def row_amount(cells: Column) -> Column:
    """The last cell with a number. Cells are read from the end, and no further than to the first that has one."""
    return F.aggregate(F.reverse(cells), F.lit(None).cast("double"), lambda found, c: F.coalesce(found, V.german_number(c)))


def row_role(label: Column) -> Column:
    """gross, total, vat, net or line; a total wins over the others."""
    has = lambda words: F.greatest(F.lit(False), *[label.contains(w) for w in words])
    return F.when(label.contains(GROSS_LABEL), "gross").when(has(TOTAL_LABELS), "total").when(has(VAT_LABELS), "vat").when(label.contains(NET_LABEL), "net").otherwise("line")


def totals(rows: DataFrame, *, table: str = "table", place: str = "place", cells: str = "cells") -> DataFrame:
    """A row for each table: stated_total, computed_total, net, vat and gross; of several rows of a role the last counts."""
    each = rows.select(F.col(table).alias("table"), F.col(place).alias("place"), F.transform(F.array(row_label(F.col(cells))), row_role)[0].alias("role"), row_amount(F.col(cells)).alias("amount"))
    last = lambda *roles: F.max_by("amount", F.when(F.col("role").isin(*roles) & F.col("amount").isNotNull(), F.col("place")))
    lines = F.sum(F.when(F.col("role") == "line", F.col("amount")))
    return each.groupBy("table").agg(last("total", "gross").alias("stated_total"), F.round(lines, 2).alias("computed_total"), last("net").alias("net"), last("vat").alias("vat"), last("gross").alias("gross"))


def findings(sums: DataFrame) -> DataFrame:
    """(table, kind, stated, computed, delta, severity): sums of lines that differ from the total, and net plus tax from gross, by more than a trifle."""
    target = F.coalesce("gross", "stated_total")
    rate = F.when(F.col("net") != 0, F.col("vat") / F.col("net")).otherwise(0.0)
    odd = F.least(*[F.abs(rate - r) for r in VAT_RATES]) > VAT_TOLERANCE
    checks = F.array(
        F.struct(F.lit("sum_mismatch").alias("kind"), F.col("stated_total").alias("stated"), F.col("computed_total").alias("computed")),
        F.struct(F.when(odd, "vat_mismatch").otherwise("sum_mismatch").alias("kind"), target.alias("stated"), F.round(F.col("net") + F.col("vat"), 2).alias("computed")),
    )
    each = sums.select("table", F.explode(checks).alias("c")).select("table", "c.*").where("stated is not null and computed is not null")
    delta = F.round(F.col("stated") - F.col("computed"), 2)
    graded = each.withColumn("delta", delta).withColumn("severity", F.element_at(F.array(*map(F.lit, V.SEVERITIES)), V.severity(delta, F.col("stated")) + 1))
    return graded.where("severity <> 'info'")
