import random

from corpusmill.operators import dedup as D
from corpusmill.session import table


def test_near_duplicates_within_buckets(spark):
    """Every pair that shares a band and passes is in one component, against all pairs in Python."""
    rng, texts = random.Random(7), []
    for f in range(2):
        words = [f"w{f}x{i}" for i in range(150)]
        for _ in range(25):
            texts.append(" ".join(words))
            for _ in range(2):
                words[rng.randrange(150)] = f"n{rng.random()}"
    texts += [texts[3].upper(), texts[3], "", None, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(2)
    got = {r.doc_id: (r["class"], r.component) for r in D.near_duplicates(docs, "doc_id", "text").collect()}
    hashed = docs.select("doc_id", D.shingles(docs.text, 5).alias("s"))
    rows = {r.doc_id: (set(r.s), set(enumerate(r.bands))) for r in hashed.select("doc_id", "s", D.minhash(hashed.s, 16, 4).alias("bands")).collect() if r.s is not None}
    root = list(range(len(texts)))
    for b in rows:
        for a in rows:
            (sa, ba), (sb, bb) = rows[a], rows[b]
            if a < b and ba & bb and round(len(sa & sb) / len(sa | sb), 6) >= 0.8 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(None if t is None else t.lower(), i)
    same = [first[None if t is None else t.lower()] for t in texts]
    assert got == {i: (same[i], root[same[i]]) for i in range(len(texts))}


def test_recall_over_a_whole_table(spark, sf_dir):
    """Of all pairs of documents that are similar by brute force, nine tenths at least are in one component."""
    docs = table(spark, sf_dir, "documents")
    sets = {r.doc_id: set(r.s) for r in docs.select("doc_id", D.shingles(docs.text, 5).alias("s")).collect() if r.s}
    ids = sorted(sets)
    similar = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component for r in D.near_duplicates(docs, "doc_id", "text").collect()}
    assert set(got) == {r.doc_id for r in docs.select("doc_id").collect()}
    assert similar and sum(got[a] == got[b] for a, b in similar) >= 0.9 * len(similar)


def test_a_large_bucket_stays_linear(spark, monkeypatch):
    """Templates with a tenth to a fifth of their words of their own share bands, but are not similar: nobody meets."""
    from pyspark.sql import functions as F

    n = 20_000
    template = F.array(*[F.lit(f"t{i}") for i in range(60)])
    own = F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: F.concat(F.lit("o"), F.col("id").cast("string"), F.lit("x"), i.cast("string")))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.array_join(F.concat(own, template), " ").alias("text"))
    cut = docs.select(F.md5("text").alias("hash"), D.shingles(F.col("text"), 5).alias("s"))
    members = cut.select("hash", F.col("hash").alias("component"), F.array(F.struct(F.lit(1).alias("band"), F.lit(1).alias("key"))).alias("keys"))
    assert D.prefix_pairs(members, cut, 0.8).count() == 0
    # With one word of their own all are similar, and the first round links them.
    near = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.concat(F.lit("o"), "id"), F.lit(" "), F.array_join(template, " ")).alias("text"))
    assert {r.component for r in D.near_duplicates(near, "doc_id", "text").collect()} == {0}


def test_prefix_pairs_lose_nothing(spark):
    rng = random.Random(3)
    sets = [[rng.randrange(60) for _ in range(rng.randint(1, 40))] for _ in range(80)]
    sets += [[*s, rng.randrange(60)] for s in sets[:40]]
    sets = [sorted(set(s)) for s in sets]
    cut = spark.createDataFrame([(f"{i:03}", s) for i, s in enumerate(sets)], "hash string, s array<bigint>")
    members = spark.createDataFrame([(f"{i:03}", f"{i:03}", [i % 2]) for i in range(len(sets))], "hash string, component string, keys array<int>")
    got = {tuple(r) for r in D.prefix_pairs(members, cut, 0.8).collect()}
    want = {(f"{i:03}", f"{j:03}") for j in range(len(sets)) for i in range(j) if i % 2 == j % 2 and len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))}
    assert want <= got and len(want) > 10 and len(got) < len(sets) ** 2 / 8


def test_shingles_are_cut_again_only_where_bands_are_shared(spark, monkeypatch):
    """Rows without an id and ids of several texts as well; of the second pass the plan joins before it cuts."""
    plans, kept = [], D.checkpointed
    monkeypatch.setattr(D, "checkpointed", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), kept(df))[1])
    a, b = [" ".join(f"{k}{i}" for i in range(120)) for k in "ab"]
    near = [t.replace("5 ", "5x ", 1) for t in (a, b)]
    given = [(None, a), (7, near[0]), (None, a.upper()), (5, b), (5, near[1]), (5, "else"), (None, None), (3, "  "), (None, "alone")]
    found = D.near_duplicates(spark.createDataFrame(given, "doc_id int, text string"), "doc_id", "text").collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, found)) == sorted([(-1, -1, 7), (7, 7, 7), (-1, -1, 7), (5, 5, 5), (5, 5, 5), (5, 5, 5), (-1, -1, -1), (3, 3, 3), (-1, -1, -1)])
    (second,) = [p for p in plans if "xxhash64" in p and p.startswith("Aggregate [hash")]
    assert "Join" in second and second.index("xxhash64") < second.index("Join")


def test_band_keys_of_lists_side_by_side(spark):
    import numpy as np

    def plain(hashes):
        keys = []
        for band in range(16):
            key = band + 1
            for row in range(4):
                odd = (0x9E3779B97F4A7C15 * (2 * (band * 4 + row) + 1)) % (1 << 64) | 1
                mixed = [((h % (1 << 64)) ^ (h % (1 << 64) >> 31)) * odd % (1 << 64) for h in hashes]
                key = (key ^ min(m ^ (m >> 29) for m in mixed)) * 0xBF58476D1CE4E5B9 % (1 << 64)
                key ^= key >> 32
            keys.append(int(np.uint64(key).astype(np.int64)))
        return keys

    rng = random.Random(5)
    lists = [[rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)] for n in (1, 7, 300, 2)] + [[], None, [-1], [rng.randrange(1 << 62) for _ in range(33_000)], [0, 5]]
    rows = spark.createDataFrame(list(enumerate(lists)), "i int, s array<bigint>").coalesce(1)
    got = {r.i: r.k for r in rows.select("i", D.minhash(rows.s, 16, 4).alias("k")).collect()}
    assert got == {i: plain(x) if x else None for i, x in enumerate(lists)}
