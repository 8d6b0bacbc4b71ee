import struct

import numpy as np
import xxhash

from corpusmill.llm import cotrain, queries
from corpusmill.llm.common import table


def plain_fit(docs, labels, rounds=3, per_round=400, sure=0.95):
    """Co-training in memory: every unlabelled document is scored in every round."""
    views = {k: (cotrain.text_view(t), cotrain.meta_view(m)) for k, t, m in docs}
    known = sorted(k for k in labels if k in views)
    stack = lambda ks, v: np.stack([views[k][v] for k in ks])
    state = cotrain.Views(stack(known, 0), stack(known, 1), np.array([int(labels[k] > 0) for k in known]))
    rest, taken, model = [k for k in views if k not in labels], [set(), set()], state.fitted()
    tie = lambda k: np.uint64(xxhash.xxh64_intdigest(struct.pack("<q", k), 42)).astype(np.int64)
    for _ in range(rounds):
        _, *p = model.scores(stack(rest, 0), stack(rest, 1))
        new = []
        for v in (0, 1):
            for c in (0, 1):
                q = dict(zip(rest, p[v] if c else 1 - p[v]))
                best = sorted((k for k in rest if q[k] >= sure and k not in taken[1 - v]), key=lambda k: (-q[k], tie(k)))
                best = best[: max(1, round(per_round * state.share[c]))]
                taken[1 - v] |= set(best)
                new.append((1 - v, bool(c), best))
        if not any(b for *_, b in new):
            break
        for to, c, best in new:
            state.add(to, stack(best, to) if best else np.zeros((0, state.views[to].shape[1]), np.float32), c)
        model = state.fitted()
    return model, views


def test_query_against_a_plain_version(spark, sf_dir):
    docs = [(r.doc_id, r.text, [r.lang, r.source, r.n_chars]) for r in table(spark, sf_dir, "documents").collect()]
    labels = {}
    for r in table(spark, sf_dir, "labels").where("doc_id is not null and quality is not null").collect():
        labels[r.doc_id] = min(r.quality, labels.get(r.doc_id, 1))
    model, views = plain_fit(docs, labels)
    got = {r.doc_id: r for r in queries.op4_quality_classifier(spark, sf_dir).collect()}
    want = dict(zip(views, model.scores(*(np.stack([v[i] for v in views.values()]) for i in (0, 1)))[0]))
    off = [k for k in want if abs(want[k] - got[k].score) > 0.01]
    assert len(got) == len(want) and len(off) <= 0.01 * len(want)
    assert all(got[k].kept == (want[k] >= 0.5) for k in want if k not in off and abs(want[k] - 0.5) > 0.02)


def test_views_help_each_other():
    """With a dozen labels, exchange of what each view is sure of beats the labels alone."""
    rng = np.random.default_rng(2)
    n = 1500
    truth = rng.random(n) < 0.5
    text, meta = (rng.standard_normal((n, d)).astype(np.float32) for d in (6, 5))
    text[:, 0] += np.where(truth, 2.5, -2.5)
    meta[:, 0] += np.where(truth, 2.5, -2.5)
    state = cotrain.Views(text[:16], meta[:16], truth[:16].astype(int))
    right = lambda m: ((m.scores(text, meta)[0] >= 0.5) == truth)[16:].mean()
    first = state.fitted()
    model = first
    for _ in range(5):
        _, *p = model.scores(text, meta)
        for v in (0, 1):
            for c in (0, 1):
                best = np.argsort(-p[v] if c else p[v])[:60]
                state.add(1 - v, (text, meta)[1 - v][best], bool(c))
        model = state.fitted()
    assert right(model) >= max(0.97, right(first))
    for p in model.scores(text, meta):
        assert ((p >= 0) & (p <= 1)).all()


def test_calibration():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 1)).astype(np.float32)
    y = rng.random(4000) < 1 / (1 + np.exp(-(3 * x[:, 0] + 1)))
    model = cotrain.Linear(np.array([10.0], np.float32), 0.0)
    cotrain.calibrate(model, x, y)
    assert abs(model.slope * 10 - 3) < 0.4 and abs(model.shift - 1) < 0.3


def test_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = cotrain.fit(docs, labels.where("doc_id % 2 = 0"))
    got = {r.doc_id: r for r in cotrain.score(docs, model).collect()}
    assert len(got) == docs.count()
    rest = [(got[r.doc_id].kept, r.quality) for r in labels.where("doc_id % 2 = 1").collect()]
    bad, good = ([k for k, q in rest if q == c] for c in (0, 1))
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_odd_rows(spark):
    rows = [(i, f"fine words number {i} " * 9 if i % 2 else "### $$$ %%% " * 9, "en", "s", 9, 1.0) for i in range(40)]
    odd = [(40, None, None, None, None, 1.0), (41, "", "en", "s", 0, None), (None, "fine words", "en", None, 2, None), (1, "fine words number 1 " * 9, "en", "s", 9, 1.0), (42, "x " * 100000, "fr", "t", 200000, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    docs = spark.createDataFrame(rows + odd, schema)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, label int")
    model = cotrain.fit(docs, labels)
    got = cotrain.score(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(r.kept == bool(r.doc_id % 2) for r in got if r.doc_id is not None and r.doc_id < 40)
    assert all(0 <= r.score <= 1 for r in got)
    for given in (labels.limit(0), labels.where("quality = 1")):
        assert all(r.kept for r in cotrain.score(docs, cotrain.fit(docs, given)).collect())
    assert cotrain.score(docs.limit(0), cotrain.fit(docs.limit(0), labels)).collect() == []


def test_clashing_columns(spark):
    rows = [(i, f"fine words number {i} " * 9 if i % 2 else "### $$$ %%% " * 9, "en", "s", 9, 1, 2, 3, "f") for i in range(40)]
    docs = spark.createDataFrame(rows + rows[:3] * 50, "doc_id long, text string, lang string, source string, n_chars long, label int, key long, m0 int, form string")
    labels = spark.createDataFrame([(i, i % 2, 5, 6) for i in range(30)], "doc_id long, quality int, label int, key int")
    got = cotrain.score(docs, cotrain.fit(docs, labels)).collect()
    assert len(got) == 190 and all(r.kept == bool(r.doc_id % 2) for r in got)


def plain_text_view(text):
    """The text's view by definitions of its own: buckets of distinct words, shares of bytes, shape."""
    import math
    import re
    import zlib

    out = [0.0] * (512 + 256 + 4)
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return out
    each, data = set(words), text.encode()
    for w in each:
        out[zlib.crc32(w.encode()) % 512] += 0.3 / math.sqrt(len(each))
    for b in range(256):
        out[512 + b] = 3 * math.sqrt(data.count(b) / len(data))
    out[768:] = [3 * x for x in (len(each) / len(words), math.log10(len(words)) / 4, len(data) / len(words) / 20, min(1.0, len(text.split("\n")) / len(words)))]
    return out


def plain_meta_view(values):
    import math
    import zlib

    out = [0.0] * (64 * len(values))
    for i, v in enumerate(values):
        if v is not None:
            key = repr(v) if isinstance(v, str) else repr(round(math.log2(1 + abs(v)) / 0.5)) if math.isfinite(v) else repr("?")
            out[64 * i + zlib.crc32(key.encode()) % 64] = 1.0
    return out


def test_views_by_their_definitions(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("text", "lang", "source", "n_chars").collect()
    texts = [None, "", " \n", "One one ONE é É", "a\x1cb\x85c\nd", *(r.text for r in rows)]
    for t in texts:
        assert np.allclose(cotrain.text_view(t), plain_text_view(t), atol=1e-5)
    for values in [[None, None, None], ["x", "", 0], ["y", None, -7], ["z", "s", float("nan")], *([r.lang, r.source, r.n_chars] for r in rows)]:
        assert np.allclose(cotrain.meta_view(values), plain_meta_view(values))
