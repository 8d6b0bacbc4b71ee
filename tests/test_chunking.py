"""Chunks, families and embeddings of the whole table against plain versions by index arithmetic."""

import itertools
import math
import zlib

from corpusmill import plans
from corpusmill.operators import chunking as C
from corpusmill.session import table
from tests.test_repair import plain_sentences


def spans_of(text, most):
    at = 0
    for s in plain_sentences(text):
        at = text.index(s, at)
        yield from ((a, min(a + most, at + len(s))) for a in range(at, at + len(s), most))
        at += len(s)


def plain_chunks(text, target=1200, most=2000, least=200, overlap=150):
    spans = list(spans_of(text, most))
    groups, i = [], 0
    while i < len(spans):
        j = max([i, *(j for j in range(i, min(len(spans), i + target)) if spans[j][1] - spans[i][0] <= target)])
        groups.append((spans[i][0], spans[j][1]))
        i = j + 1
    if len(groups) > 1 and groups[-1][1] - groups[-1][0] < least:
        groups[-2:] = [(groups[-2][0], groups[-1][1])]
    starts = [groups[0][0]] if groups else []
    for (before, _), (a, _) in zip(groups, groups[1:]):
        spaces = [k for k in range(max(before, a - overlap), a) if text[k] == " "]
        starts.append(spaces[0] + 1 if spaces else a)
    return [(n, text[a:b], a, b) for n, (a, (_, b)) in enumerate(zip(starts, groups))]


def plain_children(text, target=1536, least=200, overlap=384):
    s = plain_sentences(text)
    joined = lambda a, j: " ".join(s[a : j + 1])
    out, a, fresh = [], 0, 0
    while fresh < len(s):
        j = fresh
        while j + 1 < len(s) and len(joined(a, j + 1)) <= target:
            j += 1
        out.append(s[a : j + 1])
        begins = [b for b in range(a + 1, j + 1) if sum(map(len, s[b : j + 1])) <= overlap]
        a, fresh = begins[0] if begins else j + 1, j + 1
    if len(out) > 1 and len(" ".join(out[-1])) < least:
        out[-2:] = [out[-2] + [x for x in out[-1] if x not in out[-2]]]
    return [" ".join(c) for c in out]


def plain_parents(segments, target=3072, most=6144, least=400):
    out = []
    for name, run in itertools.groupby(segments, key=lambda seg: seg[0]):
        pieces = []
        for _, text in run:
            text = text.strip()
            if len(text) <= most:
                pieces.append(text)
                continue
            packed = [[]]
            for s in plain_sentences(text):
                if packed[-1] and len(" ".join([*packed[-1], s])) > target:
                    packed.append([])
                packed[-1].append(s)
            pieces += [" ".join(p) for p in packed if p]
        held = []
        for p in [*pieces, None]:
            size = len("\n\n".join(held))
            if p is None or (held and size >= least and size + 2 + len(p) > most):
                out += [(name, "\n\n".join(held))] if size >= least else []
                held = []
            if p is not None:
                held.append(p)
                if len("\n\n".join(held)) >= target:
                    out += [(name, "\n\n".join(held))] if len("\n\n".join(held)) >= least else []
                    held = []
    return out


ODD = ["", "One. Two. Three.", "A b. " * 900, "X" * 5000, "X" * 2500 + ". Y z. " * 300, "§ 1 Erstes\n" + "Das ist so. " * 700 + "\n§ 2 Zweites\n" + "Kurz. " * 20, "Art. 5 Gilt. " * 400]


def texts_of(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


def test_chunks(spark, sf_dir):
    for text in ODD:
        assert C.chunks(text) == plain_chunks(text)
    got = {}
    for r in plans.QUERIES["f2_sentences_f7_chunks"](spark, sf_dir).collect():
        got.setdefault(r.id, []).append((r["index"], r.text, r.start, r.end))
    want = {i: found for i, t in texts_of(spark, sf_dir).items() if (found := plain_chunks(t))}
    assert {i: sorted(rows) for i, rows in got.items()} == want


def test_families(spark, sf_dir):
    family = lambda text: [(s, p, c, len(t), child) for p, (s, t) in enumerate(plain_parents(C.sections(text))) for c, child in enumerate(plain_children(t))]
    for text in ODD:
        assert C.parents(C.sections(text)) == plain_parents(C.sections(text))
        assert C.children(text) == plain_children(text)
    got = {}
    for r in plans.QUERIES["f4_f5_f6_parents_and_children"](spark, sf_dir).collect():
        got.setdefault(r.id, []).append((r.section, r.p, r.c, r.parent_chars, r.text))
    want = {i: found for i, t in texts_of(spark, sf_dir).items() if (found := family(t))}
    assert {i: sorted(rows, key=lambda x: x[1:3]) for i, rows in got.items()} == want


def test_embeddings(spark, sf_dir):
    texts = texts_of(spark, sf_dir)
    rows = plans.QUERIES["r11_batch_embedding"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        counts = [0.0] * 64
        for word in texts[r.id].lower().split():
            h = zlib.crc32(word.encode())
            counts[h % 64] += 1 if h >= 1 << 31 else -1
        size = math.sqrt(sum(c * c for c in counts))
        assert all(abs(x - c / max(size, 1e-9)) < 1e-5 for x, c in zip(r.embedding, counts))
