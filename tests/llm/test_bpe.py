import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusmill.llm import bpe
from corpusmill.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n\t", "a<|startoftext|>b <|endoftext|> It'S", "Don't 12½ ΑΣ\x1cb İ é́ ​z", "x" * 3000, "ab" * 2000, "語한국어 🙂👍🏽", "the the the"]


@pytest.fixture(scope="module")
def ours():
    return bpe.WordBpe(bpe.tokenizer_file(PATH))


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


def test_random_texts_match_the_library(ours, theirs):
    rng = random.Random(5)
    letters = "aàéΣσςÏİßﬁ12½²ªⅧ'sStdm l\x1c\x85  文字あいう🙂🏽̈\t\n.,!?-_#<|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcdeinthreos") for _ in range(rng.randint(1, 30))) for _ in range(3000)] + [t or "" for t in ODD]
    for text, want in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)):
        assert ours.encode(text) == want.ids, repr(text)
        assert ours.decode(want.ids) == theirs.decode(want.ids, skip_special_tokens=False)


def test_compatible_agrees_with_exact_merging(ours):
    import numpy as np

    rng = random.Random(2)
    inner = [i for n, i in ours.vocab.items() if not n.endswith("</w>")]
    last = [i for n, i in ours.vocab.items() if n.endswith("</w>")]
    a, b = [rng.choice(inner) for _ in range(4000)], [rng.choice(last) for _ in range(4000)]
    found = ours.compatible(np.array(a), np.array(b))
    for x, y, ok in zip(a, b, found):
        assert ok == (ours.exact(ours.names[x] + ours.names[y].removesuffix("</w>")) == [x, y])


def test_long_and_short_merging_agree(ours):
    rng = random.Random(3)
    for _ in range(500):
        ids = [ours.vocab[rng.choice("aeinrst")] for _ in range(rng.randint(1, 40))]
        assert ours._merge_long(list(ids)) == ours._merge_short(list(ids)) == ours._merge_rows([ids, ids[:1]], 48)[0]


def test_encode_frame(spark, theirs):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(0, None, 1), (None, "x", 2)], "doc_id long, text string, n_tokens int")
    out = bpe.encode(docs, PATH, with_ids=True)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    rows = out.collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        text = (ODD[r.doc_id] if r.doc_id is not None else "x") or ""
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    again = {r.doc_id: r.text for r in bpe.decode(out.where("doc_id is not null"), PATH).collect()}
    assert again[8] == "the</w> the</w> the</w>"


def test_what_is_remembered_is_bounded_in_bytes(ours, theirs):
    rng = random.Random(6)
    coder = bpe.Encoder(ours, remember=50)
    texts = ["".join(rng.choice("文字语言学习机器模型数据的是") for _ in range(3000)) for _ in range(20)] + [f"word{i} other" for i in range(200)]
    for at in range(0, len(texts), 10):
        for text, (numbers, _) in zip(texts[at : at + 10], list(coder.batch(texts[at : at + 10]))):
            assert numbers == " ".join(map(str, theirs.encode(text, add_special_tokens=False).ids))
        assert len(coder.ids) == len(coder.text) <= 50 and all(len(c) <= 32 for c in coder.ids)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, PATH).collect() == []


def test_whole_table(spark, sf_dir, theirs):
    docs = table(spark, sf_dir, "documents")
    want = {r.doc_id: theirs.encode(r.text or "", add_special_tokens=False).ids for r in docs.select("doc_id", "text").collect()}
    for r in bpe.encode(docs, PATH).collect():
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want[r.doc_id])).encode()).hexdigest()
