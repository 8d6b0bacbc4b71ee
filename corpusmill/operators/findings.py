"""Rows and findings of reports: derived findings, evidence, sizes of parks, coverage of topics, and samples for training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of dates whose passing is a risk.
DEADLINES = r"(?iU)(permit|genehmigung|expir|ablauf|frist|renewal|verläng|lease|pacht|objection|widerspruch|bond|bürgschaft|warranty|gewährleist|deadline)"


def derived(timeline: DataFrame, bonds: DataFrame, owners: DataFrame) -> DataFrame:
    """(report, kind, severity, domain, subject): findings that follow from dates, bonds and owners.

    timeline (report, kind, urgency, description), bonds (report, amount, sufficient), owners (report, parcel, owner_match, confidence).
    Expired dates of a deadline are red and urgent ones yellow; a bond without an amount is red and one that doesn't
    suffice yellow; an owner that differs with a confidence of a half is red.
    """
    due = timeline.where(F.col("urgency").isin("expired", "urgent") & F.col("kind").rlike(DEADLINES))
    domain = F.when(F.col("kind").contains("permit") | F.col("kind").contains("objection"), "Regulatory").otherwise("General")
    one = due.select("report", F.lit("deadline").alias("kind"), F.when(F.col("urgency") == "expired", "red").otherwise("yellow").alias("severity"), domain.alias("domain"), F.concat(F.initcap(F.replace("kind", F.lit("_"), F.lit(" "))), F.lit(": "), "description").alias("subject"))
    short = bonds.where(F.col("amount").isNull() | (F.col("sufficient") == F.lit(False)))
    two = short.select("report", F.lit("rueckbau").alias("kind"), F.when(F.col("amount").isNull(), "red").otherwise("yellow").alias("severity"), F.lit("Regulatory").alias("domain"), F.coalesce(F.col("amount").cast("string"), F.lit("none")).alias("subject"))
    wrong = owners.where((F.col("owner_match") == F.lit(False)) & (F.col("confidence") >= 0.5))
    three = wrong.select("report", F.lit("grundbuch").alias("kind"), F.lit("red").alias("severity"), F.lit("Land").alias("domain"), F.col("parcel").cast("string").alias("subject"))
    return one.unionByName(two).unionByName(three)


#: How documents state the size of a park, and that they don't.
PER_UNIT = r"(?i)(\d+(?:[.,]\d+)?)\s*MW\s*(?:pro|je|/)\s*(?:Einheit|Anlage|WEA|Turbine)"
UNITS = r"(?i)(\d+)\s*(?:Einheiten|Einheit|Anlagen|WEA|Windenergieanlagen?|Turbinen)\b"
TOTAL = r"(?i)(\d+(?:[.,]\d+)?)\s*MW\s*(?:gesamt|insgesamt|Gesamtleistung)"
UNKNOWN = r"(?iU)(unbekannt|unbestimmbar|nicht\s+eindeutig|keine\s+vollständige|nicht\s+ableitbar|nicht\s+bestimmbar|lässt\s+sich\s+nicht|nicht\s+eindeutig\s+hervor|unzureichende?\s+Daten)"


def park_size(capacity: Column, number: Column, counted: Column, rows: Column, summed_kw: Column) -> Column:
    """(total_mw, turbines, diverges): a stated size, else none where it is called unknown, else what rows add up to.

    ``counted`` is the number that the cell itself names. Rows that differ from it by over two and a quarter give way to it, and diverge.
    """
    cells = F.concat_ws(" ", F.when(capacity != "", capacity), F.when(number != "", number))
    value = lambda p: F.replace(F.regexp_extract(cells, p, 1), F.lit(","), F.lit(".")).try_cast("double")
    stated_count, per, total = value(UNITS).cast("int"), value(PER_UNIT), value(TOTAL)
    stated = F.when(total.isNotNull(), F.round(total, 3)).when((stated_count > 0) & (per > 0), F.round(stated_count * per, 3))
    mw = F.when(stated.isNotNull(), stated).when(F.coalesce(capacity, F.lit("")).rlike(UNKNOWN), F.lit(None).cast("double")).otherwise(F.round(summed_kw / 1000, 3))
    doc, n = F.when(counted > 0, counted), F.when(rows > 0, rows)
    far = F.coalesce(F.abs(n - doc) > F.greatest(F.lit(2), F.bround(doc * 0.25, 0)), F.lit(False))
    turbines = F.when(stated_count.isNotNull(), stated_count).when(F.coalesce(number, F.lit("")).rlike(UNKNOWN) & doc.isNull(), 0).when(far, doc).otherwise(F.coalesce(n, doc, F.lit(0)))
    return F.struct(mw.alias("total_mw"), turbines.cast("int").alias("turbines"), far.alias("diverges"))


def extraction_quality(chars: Column, pages: Column, low: int = 1800, medium: int = 2500) -> Column:
    """low, medium or high by characters a page; of a text without pages low under 5,000 characters."""
    density = chars / pages
    return F.when(F.coalesce(pages, F.lit(0)) <= 0, F.when(chars < 5000, "low").otherwise("high")).when(density < low, "low").when(density < medium, "medium").otherwise("high")


def missing_clauses(quality: Column, severity: Column) -> Column:
    """(severity, low_confidence) of a clause that is missing: one step less, two at least, where the extraction is poor."""
    poor = quality == "low"
    return F.struct(F.when(poor, F.greatest(F.lit(2), severity - 1)).otherwise(severity).alias("severity"), poor.alias("low_confidence"))


def topic_gaps(topics: DataFrame, seen: DataFrame) -> DataFrame:
    """topics (contract, topic, critical, synonyms), seen (contract, kind) -> the topics that no clause of the contract covers.

    A topic is covered if one of its synonyms, or itself without any, stands in the kind of a clause. Severity 4 if critical, else 3.
    """
    words = topics.select("contract", "topic", F.explode(F.when(F.size("synonyms") > 0, F.col("synonyms")).otherwise(F.array(F.lower("topic")))).alias("word"))
    kinds = seen.select("contract", F.lower("kind").alias("kind")).distinct()
    covered = words.join(kinds, "contract").where(F.col("kind").contains(F.col("word"))).select("contract", "topic").distinct()
    gaps = topics.join(covered, ["contract", "topic"], "left_anti")
    return gaps.select("contract", "topic", F.when(F.col("critical"), 4).otherwise(3).alias("severity"))


#: Lights of a report.
LIGHTS = ("green", "yellow", "red")


def assembled(answers: DataFrame) -> DataFrame:
    """answers (row, value, light, cited, reranked, error) -> (row, value, light, evidence).

    Citations are places in the passages, from 1; those out of range go. A real value without one cites the two best
    passages. A light of another colour is none; an answer that failed is red and says so.
    """
    passages = F.coalesce("reranked", F.array().cast("array<string>"))
    good = F.filter(F.coalesce("cited", F.array().cast("array<int>")), lambda i: (i >= 1) & (i <= F.size(passages)))
    named = F.array_distinct(F.transform(good, lambda i: F.get(passages, i - 1)))
    real = F.col("value").isNotNull() & ~F.col("value").isin("", "null")
    evidence = F.when(F.size(named) > 0, named).when(real, F.slice(passages, 1, 2)).otherwise(F.array().cast("array<string>"))
    failed = F.col("error").isNotNull()
    value = F.when(failed, "Could not extract").when(real, F.trim("value")).otherwise("Information not found in documents")
    light = F.when(failed, "red").when(F.col("light").isin(*LIGHTS), F.col("light"))
    return answers.select("row", value.alias("value"), light.alias("light"), F.when(failed, F.array().cast("array<string>")).otherwise(evidence).alias("evidence"), F.when(failed, F.concat(F.lit("Error: "), F.substring("error", 1, 80))).alias("note"))


def table_records(cells: DataFrame) -> DataFrame:
    """cells (table, caption, place, columns, values) -> (table, title, rows): rows as maps from column to text, nulls and NaN as nothing.

    Tables without rows, or with a row of another width, are left out.
    """
    text = lambda v: F.when(v.isNull() | (F.lower(v) == "nan"), "").otherwise(v)
    row = F.map_from_arrays("columns", F.transform("values", text))
    fits = F.size("columns") == F.size("values")
    checked = cells.withColumn("__fits", fits & (F.size("columns") > 0) & (F.size(F.array_distinct("columns")) == F.size("columns")))
    each = checked.select("table", "caption", "place", "__fits", F.when(F.col("__fits"), row).alias("row"))
    whole = each.groupBy("table").agg(F.min("__fits").alias("good"), F.max("caption").alias("caption"), F.array_sort(F.collect_list(F.struct("place", F.to_json("row").alias("row")))).alias("rows"))
    return whole.where("good").select("table", F.when(F.trim("caption") != "", F.col("caption")).otherwise("Tabelle").alias("title"), F.transform("rows", lambda r: r["row"]).alias("rows"))


def cited_evidence(findings: DataFrame, rows: DataFrame) -> DataFrame:
    """findings (finding, text, severity, cited array of (section, label)), rows (section, label, doc, excerpt) -> findings with evidence.

    Pairs that name no row are counted as dropped; evidence of one document and the same first 50 characters counts
    once. A severity of another name is yellow; findings without a text go.
    """
    kept = findings.where(F.trim("text") != "")
    cites = kept.select("finding", F.posexplode("cited").alias("i", "c")).select("finding", "i", F.trim(F.coalesce("c.section", F.lit(""))).alias("section"), F.trim(F.coalesce("c.label", F.lit(""))).alias("label"))
    met = cites.join(rows, ["section", "label"], "left")
    dropped = met.groupBy("finding").agg(F.count_if(F.col("excerpt").isNull() & F.col("doc").isNull()).alias("dropped"))
    first = met.where("doc is not null or excerpt is not null").groupBy("finding", "doc", F.substring(F.coalesce("excerpt", F.lit("")), 1, 50).alias("head")).agg(F.min(F.struct("i", "excerpt")).alias("e"))
    listed = first.groupBy("finding").agg(F.transform(F.array_sort(F.collect_list(F.struct("e.i", "doc", "e.excerpt"))), lambda x: F.struct(x["doc"].alias("doc"), x["excerpt"].alias("excerpt"))).alias("evidence"))
    out = kept.join(listed, "finding", "left").join(dropped, "finding", "left")
    severity = F.when(F.col("severity").isin(*LIGHTS), F.col("severity")).otherwise("yellow")
    return out.select("finding", F.trim("text").alias("text"), severity.alias("severity"), F.coalesce("evidence", F.array().cast("array<struct<doc:bigint,excerpt:string>>")).alias("evidence"), F.coalesce("dropped", F.lit(0)).alias("dropped"))


def sample_plan(chars: Column, key: Column, tasks: Sequence[str], *, refusals: float = 0.1, seed: int = 1) -> Column:
    """The kinds of training samples for a text: rag_qa first, then others by a seeded hash, 2 to 5 by length, and a refusal for a share."""
    n = F.when(chars < 500, 2).when(chars < 2000, 3).when(chars < 4000, 4).otherwise(5)
    rest = F.array(*[F.struct(F.xxhash64(key, F.lit(t), F.lit(seed)).alias("h"), F.lit(t).alias("t")) for t in tasks if t != "rag_qa"])
    others = F.transform(F.slice(F.array_sort(rest), 1, n - 1), lambda s: s["t"])
    share = F.pmod(F.xxhash64(key, F.lit("refusal"), F.lit(seed)), F.lit(1_000_000)) < int(refusals * 1_000_000)
    return F.concat(F.array(F.lit("rag_qa")), others, F.when(share, F.array(F.lit("refusal"))).otherwise(F.array().cast("array<string>")))


def by_parent(hits: DataFrame, query: str, child: str, parent: str, rank: str, most: int) -> DataFrame:
    """The first hit of each parent, up to so many a query; a child without one stands for itself, as its negative id."""
    own = hits.withColumn("parent", F.coalesce(F.col(parent), -F.col(child)))
    first = own.groupBy(query, "parent").agg(F.min(F.struct(rank, child)).alias("h")).select(query, "parent", f"h.{rank}", f"h.{child}")
    place = F.row_number().over(Window.partitionBy(query).orderBy(rank, child))
    return first.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")
