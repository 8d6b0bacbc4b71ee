import zlib

import numpy as np

from corpusmill.llm import langid, queries
from corpusmill.llm.common import id_bucket, table


def small(seed=1, hidden=4, langs=("a", "b", "c")):
    rng = np.random.default_rng(seed)
    return rng.integers(97, 110, (60, 12)).astype(np.uint8), rng.integers(0, len(langs), 60), list(langs), hidden


def test_backpropagation_agrees_with_differences():
    windows, labels, langs, hidden = small()
    w = langid.train(windows, labels, langs, hidden=hidden, rounds=2, batch=8)
    w = langid.Weights(*(tuple(a.astype(float) for a in group) for group in (w.embed, w.recur, w.out)), w.bias.astype(float), langs)
    x, y = windows[:5].T, labels[:5]
    loss = lambda: -np.log(langid.label_positions(w, x)[:, y, np.arange(5)].astype(float)).mean()
    for a, g in zip(w.arrays(), langid._gradients(w, x, y)):
        i, e = np.unravel_index(np.abs(g).argmax(), g.shape), 1e-2
        old = a[i]
        a[i] = old + e
        up = loss()
        a[i] = old - e
        down = loss()
        a[i] = old
        assert abs(g[i] - (up - down) / 2 / e) < 0.02 * abs(g[i]) + 1e-4


def test_pooling_is_over_every_byte_of_its_own_text():
    windows, labels, langs, hidden = small()
    w = langid.train(windows, labels, langs, hidden=hidden, rounds=3, batch=8)
    texts = [b"", b"a", b"abcdefgh" * 9, b"kjih" * 16, b"m" * 1001]
    got = langid.pool(w, texts, window=16, most_windows=7)
    for t, p in zip(texts, got):
        parts = [t[i : i + 16] for i in range(0, len(t), 16)]
        each = [langid.label_positions(w, np.frombuffer(part.ljust(16), np.uint8)[:, None])[: len(part), :, 0] for part in parts]
        want = np.concatenate(each).mean(axis=0) if each else np.zeros(3)
        assert np.allclose(p, want, atol=1e-5)


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.op2_language_id(spark, sf_dir).collect()
    truth = {r.doc_id: r.lang for r in table(spark, sf_dir, "documents").collect()}
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    tested = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert sum(tested) >= 0.97 * len(tested)


def test_odd_rows(spark):
    rows = [(1, "the cat and the hat " * 9, "en", 1), (3, "der Hund und die Katze " * 9, "de", 1), (4, None, "en", 1), (5, "12 34 !?", "fr", 1), (6, "", "en", 1), (7, "語", None, 1), (8, "é" * 100000, None, 1), (None, "the hat", None, 1), (1, "the cat and the hat " * 9, "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    held = id_bucket("doc_id", 4) == 2
    weights = langid.fit(docs, docs.doc_id.isNotNull(), rounds=40, batch=16)
    assert weights.langs == ["de", "en"]
    got = langid.predict(docs, weights, held).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (4, 5, 6)] == ["und"] * 3 and by[4].score == 0
    assert by[1].lang_pred == "en" and by[3].lang_pred == "de" and by[7].lang_pred in ("de", "en")
    none = langid.fit(docs.limit(0), docs.doc_id.isNotNull())
    assert none is None and {r.lang_pred for r in langid.predict(docs, none, held).collect()} == {"und"}
    assert langid.predict(docs.limit(0), weights, held).collect() == []


def test_letters():
    assert not any(map(langid._has_letter, ["", "12 !?", "①②", "Ⅷ ⅷ", "² ½"]))
    assert all(map(langid._has_letter, ["a", "1é", "語", "ʰ", "1" * 99 + "ß"]))


def test_clashing_columns_and_many_labels(spark):
    rows = [(i, f"text {'abc'[i % 3] * 9} of {i}", f"l{i % 30:02}", "x", "y", "z", 5) for i in range(300)] * 2
    docs = spark.createDataFrame(rows + rows[:1] * 500, "doc_id long, text string, lang string, label string, some string, id string, k int")
    weights = langid.fit(docs, docs.doc_id.isNotNull(), rounds=2, batch=16, most_texts=60)
    assert weights.langs == [f"l{i:02}" for i in range(30)]
    assert langid.predict(docs, weights, docs.doc_id > 5).count() == len(rows) + 500


def test_predictions_are_those_of_each_text_alone(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    held = id_bucket("doc_id", 4) == 2
    weights = langid.fit(docs, ~held, rounds=30)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in langid.predict(docs, weights, held).collect():
        data = (texts[r.doc_id] or "").encode()
        if not any(map(str.isalpha, texts[r.doc_id] or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        parts = [data[i : i + 64] for i in range(0, len(data), 64)]
        each = np.concatenate([langid.label_positions(weights, np.frombuffer(p.ljust(64), np.uint8)[:, None])[: len(p), :, 0] for p in parts])
        mean = each.mean(axis=0)
        assert abs(r.score - mean.max()) < 1e-4 and (r.lang_pred == weights.langs[int(mean.argmax())] or np.ptp(np.sort(mean)[-2:]) < 1e-4)


def plain_positions(w, data):
    """Probabilities of each byte by scalar arithmetic: both directions, gate by gate, unit by unit."""
    h, n = w.hidden, len(data)
    gate = lambda x: min(1.0, max(0.0, 0.25 * x + 0.5))
    states = []
    for side in (0, 1):
        embed, recur = w.embed[side].tolist(), w.recur[side].tolist()
        state, found = [0.0] * h, {}
        for t in range(n) if side == 0 else reversed(range(n)):
            back = [sum(recur[u][j] * state[j] for j in range(h)) for u in range(3 * h)]
            into = [embed[u][data[t]] for u in range(3 * h)]
            keep = [gate(into[u] + back[u]) for u in range(h)]
            reset = [gate(into[h + u] + back[h + u]) for u in range(h)]
            raw = [into[2 * h + u] + reset[u] * back[2 * h + u] for u in range(h)]
            state = [keep[u] * state[u] + (1 - keep[u]) * raw[u] / (1 + abs(raw[u])) for u in range(h)]
            found[t] = state
        states.append(found)
    out = []
    for t in range(n):
        scores = [w.bias[k, 0] + sum(w.out[s][k, u] * states[s][t][u] for s in (0, 1) for u in range(h)) for k in range(len(w.langs))]
        top = max(scores)
        each = [float(np.exp(s - top)) for s in scores]
        out.append([e / sum(each) for e in each])
    return np.array(out)


def test_the_network_by_scalar_arithmetic(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    weights = langid.fit(docs, id_bucket("doc_id", 4) != 2, rounds=30)
    for r in docs.where("text is not null").orderBy("doc_id").limit(12).collect():
        data = r.text.encode()[:64]
        got = langid.label_positions(weights, np.frombuffer(data, np.uint8)[:, None])[:, :, 0]
        assert np.allclose(got, plain_positions(weights, data), atol=1e-4)
        whole = r.text.encode()[:200]
        parts = [whole[i : i + 64] for i in range(0, len(whole), 64)]
        last = plain_positions(weights, parts[-1].ljust(64))[: len(parts[-1])]
        want = np.concatenate([*(plain_positions(weights, p) for p in parts[:-1]), last]).mean(axis=0)
        assert np.allclose(langid.pool(weights, [whole])[0], want, atol=1e-4)
