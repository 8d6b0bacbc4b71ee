import random
import re

import numpy as np

from corpusmill.llm import rules
from corpusmill.llm.common import table


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_counts():
    rng = random.Random(1)
    texts = [None, "", " \n\t\x0b\x0c\r", "a b c a b c a b c", "é é é é \n|x|\n|x|\n \n \n|x|", "one\x1ctwo\x85three four", "🙂 #a# &amp;"]
    texts += ["".join(rng.choice("ab c\n#") for _ in range(rng.randint(0, 120))) for _ in range(400)]
    for t in texts:
        assert rules.counts_of(t)[:5] == plain_counts(t), repr(t)


def test_learning_finds_the_thresholds():
    rng = np.random.default_rng(3)
    n = 3000
    data = {f: rng.random(n) for f in ("words", "word_length", "digit_share")}
    bad = (data["words"] > 0.9) | ((data["word_length"] < 0.3) & (data["digit_share"] > 0.6))
    found = rules.learn(data, bad)
    assert 2 <= len(found) <= 12
    rejected = np.zeros(n, bool)
    for r in found:
        rejected |= rules.covered(r, data, n)
    assert (rejected & bad).sum() >= 0.9 * bad.sum()
    assert (rejected & ~bad).sum() <= 0.05 * rejected.sum()
    assert rules.learn(data, rng.random(n) < 0.2) == [] or len(rules.learn(data, np.zeros(n, bool))) == 0


def test_odd_rows(spark):
    good = " ".join(f"word{i}" for i in range(80))
    junk = " ".join(f"w{i}###" for i in range(80))
    texts = [None, "", "short one", good, junk, "same same same " * 60, good + " x" * 20000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, good, 1), (None, good, 1)], "doc_id long, text string, n_words int")
    labelled = spark.createDataFrame([(100 + i, int(i % 2), 5) for i in range(60)] + [(100, 1, 5), (None, 0, 5), (101, None, 5)], "doc_id long, quality int, id int")
    train = spark.createDataFrame([(100 + i, good if i % 2 else junk, 1) for i in range(60)], "doc_id long, text string, label int")
    found = rules.learn_from(train, labelled)
    assert found
    rows = rules.judge(docs, found).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = good if r.doc_id is None else texts[r.doc_id]
        n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = plain_counts(text) if len(text or "") < 9000 else rules.counts_of(text)[:5]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)
        assert r.base_failed == (n_words < 50 or 100 * n_repeat_words > 50 * n_words)
        assert r.kept == (text == good)
    kept = rules.keep(docs, found)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "3", "None"]
    for empty in (rules.learn_from(train.limit(0), labelled), rules.learn_from(train, labelled.limit(0)), rules.learn_from(train, labelled.where("quality = 1"))):
        assert empty == []
    assert rules.judge(docs.limit(0), []).collect() == []
    assert {r.kept for r in rules.judge(docs.where("doc_id = 4"), []).collect()} == {True}


def test_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    found = rules.learn_from(docs, labels.where("doc_id % 2 = 0"))
    judged = {r.doc_id: r for r in rules.judge(docs, found).collect()}
    rest = [(judged[r.doc_id], r.quality) for r in labels.where("doc_id % 2 = 1").collect() if not judged[r.doc_id].base_failed]
    bad = [j.kept for j, q in rest if q == 0]
    good = [j.kept for j, q in rest if q == 1]
    assert sum(bad) <= 0.1 * len(bad) and sum(good) >= 0.98 * len(good)
    assert {i for i, j in judged.items() if j.kept} == {r.doc_id for r in rules.keep(docs, found).collect()}


def plain_features(text):
    """Each feature from the text itself, by definitions of its own."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    chars, ratio = "".join(words), lambda a, b: a / max(b, 1)
    n_words, _, n_symbols, n_dup_lines, n_repeat_words = plain_counts(text)
    return {
        "words": n_words,
        "word_length": ratio(len(chars), n_words),
        "symbols_per_word": ratio(n_symbols, n_words),
        "symbol_word_share": ratio(sum(any(c in "#*$%&|<>" for c in w) for w in words), n_words),
        "dup_line_share": ratio(n_dup_lines, len(lines)),
        "repeat_word_share": ratio(n_repeat_words, n_words),
        "distinct_share": ratio(len(set(words)), n_words),
        "words_per_line": ratio(n_words, len(lines)),
        "upper_share": ratio(sum("A" <= c <= "Z" for c in chars), len(chars)),
        "digit_share": ratio(sum(c in "0123456789" for c in chars), len(chars)),
        "stops_per_word": ratio(sum(c in ".!?" for c in chars), n_words),
    }


def test_whole_table_by_plain_evaluation(spark, sf_dir):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = rules.learn_from(docs, table(spark, "/root/testdata/sf0.01", "labels"))
    # The learned list, and one with a condition on every feature, near the middle of its values.
    small = table(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in small.select("doc_id", "text").collect() if len(r.text or "") < 6000}
    values = {i: plain_features(t) for i, t in texts.items()}
    middle = {f: sorted(v[f] for v in values.values())[len(values) // 2] for f in rules.FEATURES}
    names = list(rules.FEATURES)
    pairs = [(rules.Condition(a, True, middle[a] * 1.02), rules.Condition(b, False, middle[b] * 0.99)) for a, b in zip(names, names[1:] + names[:1])]
    for listed in (found, pairs):
        got = {r.doc_id: r.kept for r in rules.judge(small, listed).collect() if r.doc_id in texts}
        want = {}
        for i, v in values.items():
            failed = v["words"] < 50 or 2 * v["repeat_word_share"] * max(v["words"], 1) > v["words"]
            hit = any(all(v[c.feature] > c.threshold if c.above else v[c.feature] <= c.threshold for c in rule) for rule in listed)
            want[i] = not failed and not hit
        assert got == want
    assert found and set(want.values()) == {True, False}
