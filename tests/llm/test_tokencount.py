import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpusmill.llm import tokencount
from corpusmill.llm.common import table
from corpusmill.llm.queries import op11_token_counts

BYTES, WORDS, PIECES = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = [None, "", " \n\t ", "a<|endoftext|>b", "<|ENDOFTEXT|>", "It's  two   blanks \n\n x", "é é ß Ω 語 🙂", "12½ ½", "x" * 5000, "the the", "The  THE"]


def plain(path):
    if path.endswith(".model"):
        coder = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(coder.encode(t or ""))
    coder = Tokenizer.from_file(path)
    return lambda t: len(coder.encode(t or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("path,few", [(BYTES, 0), (BYTES, 1000), (WORDS, 0), (PIECES, 1000)])
def test_odd_rows_and_the_cache(spark, tmp_path, path, few):
    rows = [(i, t, -1) for i, t in enumerate(ODD * 3)] + [(None, "no id", 0), (3, "again", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(5)
    want, cache = plain(path), str(tmp_path / "cache")
    expected = sorted((i if i is not None else -1, len((t or "").encode()), want(t), want(t) > 1024) for i, t, _ in rows)
    for _ in range(2):
        out = tokencount.count(docs, path, cache, few=few)
        assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in out.collect()) == expected
        stored = spark.read.parquet(f"{cache}/*")
        # Every distinct content was encoded once, in the first run alone.
        assert stored.count() == stored.select("digest").distinct().count()
    assert stored.count() <= len({t or "" for t in ODD}) + 2


def test_only_misses_are_appended(spark, tmp_path):
    cache = str(tmp_path / "cache")
    frame = lambda texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    tokencount.count(frame(["a", "b"]), BYTES, cache).collect()
    kept = tokencount.Cache(spark, cache, BYTES)
    kept.append(kept.read().limit(1))  # as of a run at the same time
    assert len(tokencount.count(frame(["a", "b", "c", "c"]), BYTES, cache).collect()) == 4
    assert kept.read().count() == 3
    tokencount.count(frame(["a"]), WORDS, cache).collect()
    assert kept.read().count() == 3  # another tokenizer has a folder of its own
    assert tokencount.Cache(spark, cache, WORDS).read().count() == 1
    assert tokencount.count(frame([]), BYTES, cache).collect() == []


def test_stored_counts_are_used(spark, tmp_path):
    kept = tokencount.Cache(spark, str(tmp_path), BYTES)
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    tokencount.count(docs, BYTES, str(tmp_path)).collect()
    kept.append(kept.read().selectExpr("digest", "cast(-7 as bigint) n_tokens"))
    assert tokencount.count(docs, BYTES, str(tmp_path)).first().n_tokens == -7


def test_normalised_texts_share_a_digest():
    with open(WORDS, "rb") as f:
        words = tokencount.Tokenizer("x.json", f.read())
    assert words.digest("The  THE") == words.digest("the the") != words.digest("thethe")
    assert words.digest("<|endoftext|>") != words.digest("<|ENDOFTEXT|>")


def test_long_texts_in_pieces(monkeypatch):
    import random

    with open(BYTES, "rb") as f:
        ours = tokencount.Tokenizer("x.json", f.read())
    monkeypatch.setattr(tokencount, "LONG", 40)
    rng, want = random.Random(4), plain(BYTES)
    texts = ["".join(rng.choice("aab  bcC'sé1.\n<|>") for _ in range(rng.randint(100, 900))) for _ in range(300)] + ["a b<|endoftext|> c d " * 30]
    assert any(len(ours.parts(t)) > 2 for t in texts)
    assert ours.counts(texts) == [want(t) for t in texts]


def test_pieces_are_those_of_the_library(monkeypatch):
    coder = Tokenizer.from_file(BYTES)
    agreed = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]) if tokencount._AGREED.fullmatch(c)]
    assert len(agreed) > 40_000
    for i in range(0, len(agreed), 2000):
        text = "\nq ".join(f"a{c}b1{c}2!{c}? {c} {c}{c} \n{c}" for c in agreed[i : i + 2000])
        assert [at for _, at in coder.pre_tokenizer.pre_tokenize_str(text)] == [m.span() for m in tokencount._PIECES.finditer(text)]


def test_random_texts_in_pieces(monkeypatch):
    import random

    with open(BYTES, "rb") as f:
        ours = tokencount.Tokenizer("x.json", f.read())
    monkeypatch.setattr(tokencount, "_PIECES_KEPT", 500)
    ours.known.clear()
    rng, want = random.Random(9), plain(BYTES)
    letters = "aeinrst" * 6 + "AÉß语あ🙂12½²'’sdmltrev  \n\t\r\x1c\x85\xa0\u3000\u200d.,!?<|>_-" + "\u0558\U000323b0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(4000)] + ["x" * 40, "a<|endoftext|><|endoftext|> b <|endoftext|"]
    assert ours.counts(texts) == [want(t) for t in texts]
    assert len(ours.known) <= 501


def test_whole_table(spark, sf_dir):
    want = plain(BYTES)
    texts = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in op11_token_counts(spark, sf_dir).collect()}
    assert got == {i: (len(t.encode()), want(t), want(t) > 1024) for i, t in texts.items()}
