import hashlib

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from corpusmill.llm import rules, secrets
from corpusmill.llm.common import table
from tests.llm.test_decontam import plain_matches
from tests.llm.test_simhash import plain_components, plain_print


def test_whole_pipeline_against_brute_force(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = rules.learn_from(docs, labels)
    judged = {r.doc_id for r in rules.judge(docs, learned).where("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in judged}
    root = plain_components([(i, plain_print(t)) for i, t in sorted(texts.items())])
    texts = {i: t for i, t in texts.items() if root[i] == i}
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    texts = {i: t for i, t in texts.items() if not plain_matches(t, items)}
    scanner = secrets.Scanner(secrets._vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: coder.encode(scanner.redact(t), add_special_tokens=False).ids for i, t in texts.items()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(want) and want
    for i, ids in want.items():
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_stages_keep_the_columns(spark, sf_dir, tmp_path):
    odd = [(None, "no id " * 60, "en", "s", 7, "k"), (1, None, None, None, None, None), (2, "", "en", "s", 0, "k"), (3, " ".join(f"w{i}" for i in range(90)), "en", "s", 400, "k"), (3, " ".join(f"w{i}" for i in range(90)), "en", "s", 400, "k")]
    odd = [(*r, 1, "w", 2, 3, 4) for r in odd]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, fp string, n_words long, whole string, component long, key long, label long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, sf_dir)
            rows = out.collect()
            assert "doc_id" in out.columns
            if k < 4:
                assert out.columns == docs.columns
            assert len(rows) <= given.count()
