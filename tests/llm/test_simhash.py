import random
import re

import pytest
import xxhash

from corpusmill.llm import simhash
from corpusmill.llm.common import table
from corpusmill.operators.graph import connected_components


def plain_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items, distance=2):
    root = {i: i for i, _ in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(items):
        for j, b in items[:k]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in items}


def test_fingerprints():
    rng = random.Random(1)
    texts = [None, "", " \n", "one", "One TWO", "a b c", "É É é a\x0bb\x0cc d", *(" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (3, 254, 255, 256, 257, 258, 700))]
    assert simhash.fingerprints_of(texts).tolist() == [plain_print(t) for t in texts]
    assert simhash.fingerprints_of([]).tolist() == []


@pytest.mark.parametrize("segments,distance,length", [(4, 2, 3), (6, 2, 4), (4, 3, 3), (5, 3, 3)])
def test_chain_keys_miss_no_pair(segments, distance, length):
    masks = [simhash._mask([simhash.ring(segments)[i] for i in k]) for k in simhash.chain_keys(segments, distance, length)]
    rng = random.Random(3)
    for _ in range(3000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, distance)))
        assert any(x & m == 0 for m in masks)


@pytest.mark.parametrize("distance,few,bits", [(2, 32, 8), (2, 2, 8), (2, 0, 3), (3, 2, 20)])
def test_links_are_all_near_pairs(spark, distance, few, bits):
    rng = random.Random(distance)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        at = rng.getrandbits(64)
        prints |= {at ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(25)}
        prints |= {at ^ (rng.getrandbits(6) << 40) for _ in range(25)}
    frame = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    found = [tuple(r) for r in simhash.links(frame, distance=distance, few=few, least_bits=bits).collect()]
    want = {tuple(sorted((simhash._signed(a), simhash._signed(b)))) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= distance}
    assert len(found) == len(set(found)) and set(found) == want


def test_rows_without_an_id_link_others(spark, monkeypatch):
    rng = random.Random(11)
    prints = [(rng.choice([None, i]), p) for i, p in enumerate([0, 3, 15, *(rng.getrandbits(3) << 7 * rng.randint(0, 8) for _ in range(60))])]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, **how: docs)
    frame = spark.createDataFrame([(i, simhash._signed(p)) for i, p in [(1, 0), (None, 3), (2, 15)]], "id long, fp long")
    assert [r.component for r in simhash.components(frame).collect()] == [1, 1, 1]
    got = sorted((r.fp, -1 if r.id is None else r.id, r.component) for r in simhash.components(spark.createDataFrame(prints, "id long, fp long")).collect())
    want = plain_components([(k, p) for k, (_, p) in enumerate(prints)])
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[want[k]] = min(least.get(want[k], i), i)
    assert got == sorted((p, -1 if i is None else i, least.get(want[k])) for k, (i, p) in enumerate(prints))


def test_of_one_id_the_least_text_hash_stays(spark):
    import hashlib

    texts = [f"text number {i} of one id, unlike the others in {i * i} words" for i in range(5)]
    for turn in (texts, texts[::-1]):
        docs = spark.createDataFrame([(4, t, {"k": 1}) for t in turn], "doc_id long, text string, extra map<string, int>").repartition(3)
        (row,) = simhash.keep_one(docs).collect()
        assert row.text == min(texts, key=lambda t: hashlib.sha256(t.encode()).hexdigest())


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, "same words here"), (7, "SAME  words\nhere"), (7, "SAME  words\nhere"), (None, "same words here"), (1, "x " * 5000)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, fp string")
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert found == [(-1, 7), (1, 1), (3, 3), (5, 3), (7, 7), (7, 7), (9, 7)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 1, 3, 7]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    assert simhash.keep_one(docs.limit(0)).collect() == []


def test_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    items = [(r.doc_id, plain_print(r.text)) for r in docs.collect()]
    want = plain_components(items)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{p:016x}", want[i]) for i, p in items}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 50)] + [(7, 7), (60, 60), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {i: 100 for i in range(100, 141)} | {i: 0 for i in range(50)} | {200: 200, 201: 200}
    assert got == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []
