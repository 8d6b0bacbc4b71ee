import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpusmill.llm import lm, queries
from corpusmill.llm.common import id_bucket, table


def plain_tokens(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]


def plain_base(rows):
    counts = Counter(t for _, text, held in rows if not held for t in plain_tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, text, held in rows:
        tokens = plain_tokens(text)
        out[i] = (held, len(tokens), sum(counts[t] > 0 for t in tokens), n, sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens))
    return out


def check(rows, got):
    want = plain_base(rows)
    for r in got:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert r.score <= 1e-9


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in table(spark, sf_dir, "documents").collect()]
    got = queries.op8_lm_scoring(spark, sf_dir).collect()
    assert len(got) == len(rows)
    check(rows, got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # contexts help on unseen texts


def corpus(seed=1, n=200):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = ["a"]
        for _ in range(rng.randint(0, 30)):
            words.append(rng.choice("abcde") if rng.random() < 0.3 else "abcde"[("abcde".index(words[-1]) + 1) % 5])
        out.append(" ".join(words))
    return out


def plain_automaton(texts, order, strength):
    """States are seen n-grams, with explicit arcs and failure arcs, as dictionaries."""
    seqs = [plain_tokens(t) for t in texts]
    counts = Counter(tuple(s[i : i + n]) for s in seqs for n in range(1, order + 1) for i in range(len(s) - n + 1))
    total, distinct = sum(map(len, seqs)), len({g for g in counts if len(g) == 1})

    def chance(g):
        if len(g) == 1:
            return (counts[g] + 0.1) / (total + 0.1 * (distinct + 1))
        return (counts[g] + strength * chance(g[1:])) / (counts[g[:-1]] + strength)

    arcs, fail = {(): {}}, {}
    for g in counts:
        if len(g) < order:
            arcs.setdefault(g, {})
            fail[g] = (g[1:], math.log10(strength / (counts[g] + strength)))
    for g in counts:
        arcs[g[:-1]][g[-1]] = (g if len(g) < order else g[1:], math.log10(chance(g)))
    return arcs, fail, math.log10(chance((object(),)))


def plain_walk(automaton, text):
    arcs, fail, unseen = automaton
    state, score = (), 0.0
    for t in plain_tokens(text):
        while t not in arcs[state] and state:
            state, weight = fail[state]
            score += weight
        state, weight = arcs[state].get(t, ((), unseen))
        score += weight
    return score


def scored(spark, texts, asked, **how):
    rows = [(i, t, i >= len(texts)) for i, t in enumerate([*texts, *asked])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(3)
    return {r.doc_id: r.score for r in lm.score(docs, docs.held, **how).collect()}


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 40, "bucket_bytes": 100}, {"block_bytes": 1, "bucket_bytes": 7}])
def test_same_as_a_plain_automaton(spark, order, sizes):
    texts, asked = corpus(5, 60) + ["b d x y z"] * 3, corpus(6, 20) + ["b d x y z b d x", "x y z", "new y z", "", None, " \t"]
    automaton = plain_automaton(texts, order, 5.0)
    got = scored(spark, texts, asked, order=order, strength=5.0, **sizes)
    assert [got[i] for i in range(len(got))] == pytest.approx([plain_walk(automaton, t) for t in [*texts, *asked]], rel=1e-9, abs=1e-9)


def test_whole_table_is_scored_as_by_a_plain_automaton(spark, sf_dir):
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in table(spark, sf_dir, "documents").collect()]
    automaton = plain_automaton([t for _, t, held in rows if not held], 3, 256.0)
    got = {r.doc_id: r.score for r in queries.op8_lm_scoring(spark, sf_dir).collect()}
    assert [got[i] for i, *_ in rows] == pytest.approx([plain_walk(automaton, t) for _, t, _ in rows], rel=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_probabilities_sum_to_one(order):
    arcs, fail, unseen = plain_automaton(corpus(), order, 3.0)
    for state in (s for s in arcs if None not in s):  # nothing follows the end
        at, weight, done, total = state, 0.0, set(), 0.0
        while True:
            total += sum(10 ** (weight + w) for t, (_, w) in arcs[at].items() if t not in done)
            done |= set(arcs[at])
            if not at:
                break
            at, more = fail[at]
            weight += more
        assert total + 10 ** (weight + unseen) == pytest.approx(1.0, abs=1e-9)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packed_numbers(values):
    assert lm.unpacked(lm.packed(np.array(values, np.uint64)), len(values)).tolist() == values


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \t\n\x1c", max_size=8)), min_size=1, max_size=8), st.integers(0, 3))
def test_tokens(texts, skip):
    column = pa.array(["x y"] * skip + texts, pa.string()).slice(skip)
    number, n, hashes = lm.tokens(column)
    want = [plain_tokens(t) for t in texts]
    assert n.tolist() == [len(w) for w in want]
    flat = [t for w in want for t in w]
    names = {}
    for i, t in zip(number.tolist(), flat):
        assert names.setdefault(i, t) == t
    assert len(set(names.values())) == len(names) == len(hashes) - (None not in flat) and (number == 0).tolist() == [t is None for t in flat]


def test_odd_rows(spark):
    rows = [(1, "The the THE cat", False), (2, None, False), (3, "", True), (4, "é É dog\x0bcat\x1cx", True), (5, "the cat " * 30000, False), (0, "unseen words only", True)]
    docs = spark.createDataFrame([(i, t, h, 0.5, 1, 2, 3) for i, t, h in rows], "doc_id long, text string, held boolean, score double, block long, n long, training long")
    got = lm.score(docs, docs.held).collect()
    assert len(got) == len(rows)
    check(rows, got)
    twice = lm.score(docs.unionByName(docs.where("doc_id = 4")), docs.held).where("doc_id = 4").collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    untrained = lm.score(docs, docs.held | ~docs.held).collect()
    assert {(r.score, r.base_score, r.train_tokens) for r in untrained} == {(0.0, 0.0, 0)}
    assert lm.score(docs.limit(0), docs.held).collect() == []
    null = spark.createDataFrame([(None, None, None)], "doc_id string, text string, held boolean")
    assert [(r.doc_id, r.n_tokens, r.n_known) for r in lm.score(null, null.held).collect()] == [(None, 1, 0)]
