import math
import pickle
import random
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import decontam
from corpusmill.llm.common import table


def plain_scores(index, terms):
    out = {}
    for t in terms:
        here = slice(*index.start[t : t + 2])
        for i, w in zip(index.item[here].tolist(), index.weight[here].tolist()):
            out[i] = out.get(i, 0.0) + w
    return out


def index_of(items, block):
    held = Counter(t for w in items for t in set(w))
    return decontam.BlockMaxIndex(items, held, len(items), sum(map(len, items)) / len(items), block=block)


@pytest.mark.parametrize("block", [1, 3, 8])
def test_wand_finds_all_above_the_threshold(block):
    rng = random.Random(block)
    vocabulary = [f"w{int(rng.paretovariate(0.8)) % 60}".encode() for _ in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 25))] for _ in range(70)]
    index = index_of(items, block)
    for _ in range(300):
        terms = sorted({index.term[t] for t in rng.sample(vocabulary, rng.randint(1, 60)) if t in index.term})
        threshold = rng.choice([0.2, 0.4, 0.6, 0.9])
        want = {i for i, s in plain_scores(index, terms).items() if s >= threshold}
        assert {i for i, _ in index.search(terms, threshold)} == want
        opened = index.open_passages(np.array(terms), np.zeros(len(terms), np.int64), 1, threshold)
        assert len(opened) or not want


def plain_matches(text, items, overlap=0.8):
    """Every item against every stretch of the text as long as two of the longest item of its class."""
    words = decontam.terms_of(text)
    known = [(i, decontam.terms_of(t), t) for i, t in items if decontam.terms_of(t)]
    found = set()
    strides = {}
    for _, w, _ in known:
        c = math.ceil(math.log2(len(w)))
        strides[c] = max(strides.get(c, 0), len(w))
    for c, at in [(c, at) for c, stride in strides.items() for at in range(0, max(1, len(words)), stride)]:
        part = words[at : at + 2 * strides[c]]
        have = {tuple(part[k : k + 5]) for k in range(len(part))}
        for i, w, t in known:
            if math.ceil(math.log2(len(w))) != c:
                continue
            if len(w) < 5:
                near = any(part[k : k + len(w)] == w for k in range(len(part)))
            else:
                each = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
                near = len(each & have) / len(each)
            shares = [len(set(p) & set(part)) / len(set(p)) if p else 1.0 for p in decontam.question_and_answer(t)]
            if min(near, *shares) >= overlap:
                found.add(i)
    return found


def test_planted_and_odd_rows(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(6, 40))) + ". " + " ".join(word() for _ in range(7)) + "?") for i in range(20)]
    items += [(20, items[0][1].upper()), (21, None), (22, " .. "), (23, "only three words"), (None, items[1][1])]
    noise = lambda n: " ".join(word() for _ in range(n))
    texts = [None, "", "...", noise(3000), items[0][1], noise(137) + " " + items[3][1] + " " + noise(400), noise(61) + items[5][1][: len(items[5][1]) // 2], noise(500) + " " + items[7][1].replace(" ", "\n").upper() + "!", "so it is only three words long", items[1][1] + items[1][1], noise(40000) + " " + items[9][1]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(4, items[0][1], "x")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, t, 0.0) for i, t in items], "item_id long, text string, score double")
    got = [(r[0], r[1]) for r in decontam.contaminated(docs, bench).collect()]
    want = [(d, i) for d, t in [*enumerate(texts), (4, texts[4])] for i in plain_matches(t, items)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {(4, 0), (4, 20), (5, 3), (7, 7), (8, 23), (9, 1), (9, None), (10, 9)} <= set(got)
    whole = sorted(map(tuple, decontam.contaminated(docs, bench).collect()), key=str)
    assert sorted(map(tuple, decontam.contaminated(docs, bench, shard_items=7).collect()), key=str) == whole  # scores as well
    assert sorted(map(str, decontam.clean(docs, bench, shard_items=7).collect())) == sorted(map(str, decontam.clean(docs, bench).collect()))
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in got}
    assert decontam.contaminated(docs.limit(0), bench).collect() == []
    assert decontam.contaminated(docs, bench.limit(0)).collect() == []


def test_whole_table(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    verbatim = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in (r.text or "")}
    assert verbatim <= got
    assert got == {(r.doc_id, i) for r in docs.collect() for i in plain_matches(r.text, items)}


def test_scores_are_shares_of_bm25_weights(spark):
    """A plain BM25 over all items gives the scores of every row."""
    rng = random.Random(8)
    items = [(f"i{i}", " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("abc") for _ in range(rng.randint(5, 40)))) for i in range(60)]
    docs = spark.createDataFrame([(i, f"before {t} after") for i, (_, t) in enumerate(items)], "doc_id long, text string")
    words = [t.split() for _, t in items]
    held, mean = Counter(t for w in words for t in set(w)), sum(map(len, words)) / len(words)

    def share(w, part):
        size = 1.2 * (1 - 0.75 + 0.75 * len(w) / mean)
        each = {t: math.log(1 + (len(words) - held[t] + 0.5) / (held[t] + 0.5)) * f * 2.2 / (f + size) for t, f in Counter(w).items()}
        return sum(v for t, v in each.items() if t in part) / sum(each.values())

    bench = spark.createDataFrame(items, "item_id string, text string")
    for shard_items in (20_000, 20):
        rows = decontam.contaminated(docs, bench, shard_items=shard_items).collect()
        assert {(r.doc_id, r.item_id) for r in rows} >= {(i, name) for i, (name, _) in enumerate(items)}
        for r in rows:
            if items[r.doc_id][0] == r.item_id:
                assert r.score == pytest.approx(1.0) and r.score == pytest.approx(share(words[r.doc_id], set(words[r.doc_id])))


def test_a_long_item_widens_no_other_passage(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    short, long = [word() for _ in range(30)], [word() for _ in range(20_000)]
    gap = [word() for _ in range(500)]
    docs = spark.createDataFrame([(1, " ".join([*short[:15], *gap, *short[15:]])), (2, " ".join(short)), (3, " ".join([*gap, *long]))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(short)), (2, " ".join(long))], "item_id long, text string")
    assert {(r[0], r[1]) for r in decontam.contaminated(docs, bench).collect()} == {(2, 1), (3, 2)}


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", [8], "k", "f")], "doc_id long, text string, __matches array<int>, key string, found string")
    bench = spark.createDataFrame([("x", "one two three four five six", 3.0)], "item_id string, text string, key double")
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()] == [(1, "x")]
    other = bench.selectExpr("item_id", "'seven eight nine ten eleven' AS text")
    assert decontam.clean(docs, other).collect() == docs.collect() and decontam.clean(docs, bench).collect() == []


def test_the_index_grows_with_its_postings():
    rng = np.random.default_rng(3)
    items = [[b"w%d" % w for w in rng.zipf(1.3, 40) % 50_000] for _ in range(20_000)]
    index = index_of(items, 4)
    assert sum(x.nbytes for x in vars(index).values() if isinstance(x, np.ndarray)) < 40_000_000
    assert len(pickle.dumps(index)) < 60_000_000
