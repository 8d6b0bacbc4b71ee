"""Quality and domain of texts by their words, as column expressions (R20, R21). The word lists are of our own choice: there is only prose to go by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words whose share tells of legal prose.
LEGAL_TERMS = ("§", "§§", "Art.", "BGB", "StGB", "Gericht", "Urteil")


def term_density(text: Column) -> Column:
    """Legal terms in a hundred words."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return 100.0 * F.size(F.filter(words, lambda w: w.isin(*LEGAL_TERMS))) / F.greatest(F.size(words), F.lit(1))


def keeps(text: Column, language: Column, *, least: int = 100, most: int = 50_000, density: float = 1.0) -> Column:
    """German or English, of a fair length, dense enough in legal terms and without marks of a wrong encoding."""
    return language.isin("de", "en") & F.length(text).between(least, most) & (term_density(text) >= density) & ~text.contains("\ufffd")


#: Words of each domain: anchors weigh 5 to 8, others 2 to 4.
KEYWORDS = {
    "baurecht": {"bebauungsplan": 8, "baugenehmigung": 7, "bauantrag": 6, "grundstück": 3, "abstandsfläche": 4},
    "energierecht": {"eeg": 6, "netzanschluss": 7, "einspeisung": 6, "strom": 2, "windenergie": 4},
    "immissionsschutzrecht": {"immissionsschutz": 8, "emission": 5, "lärm": 4, "schall": 3, "genehmigung": 2},
    "steuerrecht": {"umsatzsteuer": 8, "gewerbesteuer": 8, "steuer": 4, "abgabe": 2},
    "umweltrecht": {"naturschutz": 8, "artenschutz": 8, "umwelt": 3, "gewässer": 4},
    "vertragsrecht": {"vertrag": 4, "kündigung": 5, "haftung": 5, "pacht": 4, "vergütung": 3},
    "softwarerecht": {"license": 6, "apache": 5, "version": 3, "copyright": 5},
}


def best_domain(text: Column, *, least: int = 8, words: int = 2) -> Column:
    """(domain, score) of the highest sum of weights with enough of it and enough different words, ties by name; else null."""
    names = F.array(*map(F.lit, KEYWORDS))

    def best(low: Column) -> Column:
        # One number a domain: a hundred times its weights and one for each word, so a word is looked for once.
        sums = F.array(*[sum((F.when(low.contains(w), F.lit(100 * n + 1)).otherwise(F.lit(0)) for w, n in weights.items()), F.lit(0)) for weights in KEYWORDS.values()])
        enough = lambda x: (x >= 100 * least) & (x % 100 >= words)
        scored = F.transform(sums, lambda x, i: F.when(enough(x), F.struct((-F.floor(x / 100)).cast("int").alias("s"), F.get(names, i).alias("domain"))))
        return F.array_min(F.array_compact(scored))

    found = F.transform(F.array(F.lower(text)), best)
    return F.transform(found, lambda b: F.when(b.isNotNull(), F.struct(b["domain"].alias("domain"), (-b["s"]).alias("score"))))[0]
