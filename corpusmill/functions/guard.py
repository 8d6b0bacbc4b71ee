"""Checks and repairs of generated answers and findings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import language as L

#: What marks a reference to a chunk of evidence.
CHUNK_REF = r"\s*\[#\s*\d+(?:\s*,\s*\d+)*\s*\]"
#: What stands for a missing value.
MISSING = {"de": "Nicht in den vorgelegten Dokumenten enthalten.", "en": "Not contained in the supplied documents."}
#: Openings that defend rather than answer, and a failed extraction.
DEFENSIVE = (
    r"^\s*Die vorliegenden Kontext(ausschnitte|auszüge)?\s+enthalten\s+(keine|ausschließlich)",
    r"^\s*Der vorliegende Kontext\s+enthält\s+(keine|ausschließlich|nur)",
    r"^\s*Im (vorliegenden|gegebenen) Kontext\s+(finden sich|sind|werden)\s+keine",
    r"^\s*Als (KI|künstliche Intelligenz)",
    r"^\s*Based on the supplied context",
    r"^\s*The supplied context (is|consists|contains)",
    r"^\s*(Unable|I am unable|I cannot|I'm unable) to",
    r"^\s*As an AI",
)
EXTRACTION_FAILED = r"manual review required.*?\(findings? extraction failed\)"
#: Phrases that hedge, by language.
HEDGES = {
    "de": (r"\bmöglicherweise\b\s*", r"\bvermutlich\b\s*", r"\bggf\.\s*", r"\bgegebenenfalls\b\s*", r"\bunter Umständen\b\s*", r"\beventuell\b\s*", r"\bes scheint, dass\b\s*"),
    "en": (r"\bperhaps\b\s*", r"\bpossibly\b\s*", r"\bmight\b\s*", r"\bcould potentially\b\s*", r"\bappears to\b\s*", r"\bseems to\b\s*"),
}


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def drop_chunk_refs(text: Column) -> Column:
    return F.regexp_replace(text, CHUNK_REF, "")


def strip_hedges(text: Column, language: Column) -> Column:
    """(text, hedges): hedges of the text's language out, of a mixed one those of both, and how many (F21). Others stay as they are."""
    both = [("(?iU)" + p, language.isin(lang, "mixed")) for lang in HEDGES for p in HEDGES[lang]]
    acc = F.struct(text.alias("text"), F.lit(0).alias("hedges"))

    def without(pattern: str, mine: Column):
        return lambda a: F.struct(F.when(mine, F.regexp_replace(a["text"], pattern, "")).otherwise(a["text"]).alias("text"), (a["hedges"] + F.when(mine, F.regexp_count(a["text"], F.lit(pattern))).otherwise(0)).alias("hedges"))

    for pattern, mine in both:
        acc = _once(acc, without(pattern, mine))
    return _once(acc, lambda a: F.struct(F.when(a["hedges"] > 0, F.regexp_replace(F.regexp_replace(a["text"], "  +", " "), r"(?U)^\s+|\s+\z", "")).otherwise(a["text"]).alias("text"), a["hedges"].alias("hedges")))


def defensive(text: Column) -> Column:
    """Whether the first 200 characters defend, or tell of a failed extraction."""
    head = F.substring(text, 1, 200)
    return F.coalesce(head.rlike("(?iU)" + "|".join(DEFENSIVE)) | head.rlike("(?i)" + EXTRACTION_FAILED), F.lit(False))


def scrubbed(text: Column, language: str = "de") -> Column:
    """(text, defensive, hedges, language) of a cell: references out; a defensive text becomes the missing marker, else hedges go."""
    bare = drop_chunk_refs(F.coalesce(text, F.lit("")))

    def clean(work: Column) -> Column:
        lang, blank = L.of_cell(work), F.trim(work) == ""
        none = F.struct(work.alias("text"), F.lit(0).alias("hedges"))
        kept = F.when(blank, none).otherwise(strip_hedges(work, lang))
        defends = defensive(work)
        return F.struct(F.when(defends, MISSING[language]).otherwise(kept["text"]).alias("text"), defends.alias("defensive"), F.when(defends, 0).otherwise(kept["hedges"]).alias("hedges"), F.when(blank, "unknown").otherwise(lang).alias("language"))

    return _once(bare, clean)


def topic_hint(action: Column, domain: Column, most: int = 60, least: int = 30) -> Column:
    """The recommended action up to 60 characters, cut at a blank from the 30th on, or else the domain."""
    a = F.trim(action)
    head = F.substring(a, 1, most)
    cut = F.regexp_extract(head, rf"(?s)\A(.{{{least},}}) [^ ]*\z", 1)
    short = F.concat(F.rtrim(F.when(cut != "", cut).otherwise(head), F.lit(" ,;:")), F.lit("…"))
    return F.when(F.length(a) > most, short).when(F.length(a) > 0, a).when(F.lower(F.trim(domain)).isin("", "general"), "").otherwise(F.coalesce(F.trim(domain), F.lit("")))


def scrub(light: Column, text: Column, note: Column, action: Column, domain: Column, language: str = "de") -> Column:
    """A row or finding: (light, text, note, defensive, hedges, language). Green turns yellow where the text defends, which names its topic."""

    def update(s: Column) -> Column:
        hint = topic_hint(action, domain)
        told = F.when(s["defensive"] & (hint != ""), F.concat(s["text"], F.lit(" — "), hint)).otherwise(s["text"])
        cleaned = F.trim(drop_chunk_refs(note))
        return F.struct(F.when(s["defensive"] & (light == "green"), "yellow").otherwise(light).alias("light"), told.alias("text"), F.when(cleaned != "", cleaned).alias("note"), s["defensive"].alias("defensive"), s["hedges"].alias("hedges"), s["language"].alias("language"))

    return _once(scrubbed(text, language), update)


#: Rules that hold in one state only: state, name, patterns.
STATE_RULES = (
    ("bayern", "Bayerns 10H-Regel (Art. 82 BayBO)", (r"\b10\s*[xX×]?\s*H\b", r"(?i)\b10H[\s-]*Reg(el|elung)\b", r"\bBayBO\b", r"(?i)\bArt\.?\s*82\s+BayBO\b", r"(?i)\bArt\.?\s*82a\s+BayBO\b")),
    ("niedersachsen", "Niedersächsische Bauordnung (NBauO)", (r"\bNBauO\b",)),
    ("schleswig-holstein", "Landesbauordnung Schleswig-Holstein (LBO SH)", (r"(?i)\bLBO\s*SH\b",)),
    ("nordrhein-westfalen", "Bauordnung Nordrhein-Westfalen (BauO NRW)", (r"(?i)\bBauO\s*NRW\b",)),
)


def _excerpt(text: Column, pattern: str, around: int) -> Column:
    """The first hit with what stands around it, null without one."""
    hit = F.regexp_extract(text, f"(?U)({pattern})", 1)
    before = F.length(F.split(text, f"(?U){pattern}", 2)[0])
    start = F.greatest(before - around, F.lit(0))
    return F.when(hit != "", F.trim(F.substring(text, start + 1, before - start + F.length(hit) + around)))


def jurisdiction_warnings(text: Column, state: Column, around: int = 40) -> Column:
    """Rules of other states that an answer uses, one warning a rule with the first hit of its first pattern (F29). None where the state is not known."""
    found = []
    for key, label, patterns in STATE_RULES:
        excerpt = F.coalesce(*[_excerpt(text, p, around) for p in patterns])
        found.append(F.when((F.lower(state) != key) & (state != "") & excerpt.isNotNull(), F.struct(F.lit(label).alias("rule"), F.lit(key).alias("belongs_to"), F.lower(state).alias("expected"), excerpt.alias("excerpt"))))
    return F.array_compact(F.array(*found))


#: Domains of texts, and of statutes by their slug.
DOMAINS = (
    "immissionsschutzrecht", "energierecht", "baurecht", "umweltrecht", "vertragsrecht", "gesellschaftsrecht", "grundstuecksrecht", "arbeitsrecht", "steuerrecht",
    "verwaltungsrecht", "prozessrecht", "allgemein",
)
DOMAIN_SLUGS = {
    "immissionsschutzrecht": ("bimschg",),
    "energierecht": ("eeg_2014", "enwg_2005", "windseeg", "windbg", "kwkg_2016"),
    "baurecht": ("bbaug", "baunvo", "rog_2008"),
    "umweltrecht": ("bnatschg_2009", "uvpg", "whg_2009", "uschadg"),
    "vertragsrecht": ("bgb", "hgb"),
    "gesellschaftsrecht": ("gmbhg", "aktg"),
    "grundstuecksrecht": ("gbo", "erbbauv"),
    "arbeitsrecht": ("kschg", "betrvg", "arbzg"),
    "steuerrecht": ("estg", "kstg_1977", "ustg_1980", "gewstg"),
    "verwaltungsrecht": ("vwvfg",),
    "prozessrecht": ("vwgo", "zpo"),
}


def statute_domain(slug: Column) -> Column:
    """The domain of a statute; allgemein if its slug is not listed."""
    low = F.lower(slug)
    return F.coalesce(*[F.when(low.isin(*slugs), domain) for domain, slugs in DOMAIN_SLUGS.items()], F.lit("allgemein"))


def domains(answer: Column, text: Column) -> Column:
    """The valid labels of a model's answer, which may be fenced or explained; allgemein without one or for texts under 50 characters."""
    labels = F.from_json(F.regexp_extract(answer, r"(?s)\[.*?\]", 0), "array<string>")
    valid = F.filter(labels, lambda d: d.isin(*DOMAINS))
    return F.when((F.length(text) >= 50) & (F.size(valid) > 0), valid).otherwise(F.array(F.lit("allgemein")))


def first_label(output: Column, labels: list[str]) -> Column:
    """The first label that a model's answer contains."""
    return F.coalesce(*[F.when(F.lower(output).contains(x.lower()), F.lit(x)) for x in labels])


def contents_table(title: Column, cells: Column) -> Column:
    """A table of contents: by its title, or mostly small whole numbers of at least three."""
    numbers = F.filter(F.transform(cells, lambda c: c.try_cast("double")), lambda x: x.isNotNull())
    small = F.filter(numbers, lambda x: (x == F.floor(x)) & (x < 1000))
    return F.lower(title).rlike(r"inhalt|contents|verzeichnis") | ((F.size(numbers) >= 3) & (F.size(small) > 0.7 * F.size(numbers)))


def uncovered(topics: DataFrame, seen: DataFrame) -> DataFrame:
    """Required types that are missing, by exact name."""
    return topics.join(seen.select(F.col("kind").alias("required")).distinct(), "required", "left_anti").withColumn("severity", F.lit("high"))
