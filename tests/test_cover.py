import random

import pytest
import regex

from corpusmill.operators import cover
from corpusmill.plans.registry import Tables
from corpusmill.plans.search import short_questions

#: Words and their stems by the published rules.
STEMS = {
    "aufeinander": "aufeinand", "aufenthalt": "aufenthalt", "kategorie": "kategori", "kategorien": "kategori", "häuser": "haus", "hauses": "haus", "laufen": "lauf", "ergebnisse": "ergebnis", "ergebnissen": "ergebnis",
    "freundlich": "freundlich", "möglichkeit": "moglich", "möglichkeiten": "moglich", "bedeutung": "bedeut", "verständigung": "verstand", "schönheit": "schonheit", "derbst": "derb", "groß": "gross", "bauer": "bau", "feuer": "feu", "rechts": "recht", "vertragliche": "vertrag", "in": "in", "er": "er",
}


@pytest.mark.parametrize("word", sorted(STEMS))
def test_stems(word):
    assert cover.german_stem(word) == STEMS[word]


def plain_score(words, terms):
    """Over all stretches: those that hold every term and have none inside that does."""
    fits = [(i, j) for i in range(len(words)) for j in range(i, len(words)) if terms <= set(words[i : j + 1])]
    covers = [(i, j) for i, j in fits if not any(a >= i and b <= j and (a, b) != (i, j) for a, b in fits)]
    return sum(0.1 / (1 + sum(w not in terms for w in words[i : j + 1])) for i, j in covers)


def plain(questions, docs, k, stem, stop=()):
    cut = lambda t: [stem(w) for w in regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())]
    out = []
    for qid, question in questions:
        terms = {stem(w) for w in regex.findall(r"[\p{L}\p{N}]+", (question or "").lower()) if w not in stop}
        scored = [(round(plain_score(cut(t), terms), 6), i) for i, t in docs if terms and terms <= set(cut(t))]
        out += [(qid, i, s, r) for r, (s, i) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("stem", [None, cover.german_stem])
def test_all_covers(spark, stem):
    rng = random.Random(2)
    words = ["haus", "Häuser", "Recht", "rechts", "der", "die", "laufen", "läuft", "x1"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))) for i in range(60)] + [(60, None), (61, "haus " * 30 + "recht")]
    questions = [(1, "Haus"), (2, "recht haus"), (3, "die Häuser laufen"), (4, "unseen haus"), (5, ""), (6, None), (7, "der der"), (8, "haus häuser hauses")]
    found = cover.cover_density(spark.createDataFrame(questions, "qid int, question string"), spark.createDataFrame(docs, "id int, text string"), id_col="id", text_col="text", k=7, stem=stem, stop=("die",))
    got = sorted((r.qid, r.id, r.score, r.rank) for r in found.collect())
    assert got == plain(questions, docs, 7, stem or (lambda w: w), ("die",)) and len(got) > 20


def test_whole_table(spark, sf_dir):
    from corpusmill import plans

    t = Tables(spark, sf_dir)
    cut = lambda text: {cover.german_stem(w) for w in regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())}
    docs = [(r.doc_id, cut(r.text)) for r in t.documents.collect()]
    want = {r.qid: sum(cut(r.question) <= words for _, words in docs) for r in short_questions(t).collect() if r.question}
    got = {}
    for r in plans.QUERIES["r4_stemmed_cover_density"](spark, sf_dir).collect():
        got[r.qid] = got.get(r.qid, 0) + 1
    assert got == {q: min(10, n) for q, n in want.items() if n}
