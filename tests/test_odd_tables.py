"""Queries beside their SQL over small tables with odd rows."""

import duckdb
import pytest

from corpusmill import plans
from corpusmill.operators import retrieval as R
from tests.oracle import compare


def beside_sql(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    assert compare(plans.QUERIES[name](spark, str(folder)), con, plans.SQL[name]) >= 0
    return plans.QUERIES[name](spark, str(folder)).collect()


def test_any_order_excludes_a_customer(spark, tmp_path):
    orders = ([(2, 10), (4, 20)], "o_orderkey long, o_custkey long")
    found = beside_sql(spark, tmp_path, "j5_anti_join", customer=([(10,), (20,), (30,)], "c_custkey long"), orders=orders)
    assert [r.c_custkey for r in found] == [30]


QUESTIONS = ("Undäge und so", "und\u000bund üund", "und\rund", "Sowohl a\nals auch, ſowohl b als auch", "§ 1\u2028§ 2", "BGBä und äBGB, SGB II", "Dieschteßach dieenerßß ŉabcde", "ﬁnance ᾳβγδε straße", "", None)


def test_questions_filters_as_re2_reads_them(spark, tmp_path):
    beside_sql(spark, tmp_path, "f57_query_filters", benchmark=([(4 * i + k, q) for i, q in enumerate(QUESTIONS) for k in range(4)], "item_id long, text string"))


def test_capitals_of_letters_without_one(spark, tmp_path):
    beside_sql(spark, tmp_path, "r8_r9_query_expansion", benchmark=([(i, q) for i, q in enumerate(QUESTIONS[:-1])], "item_id long, text string"))


def test_questions_features_as_re2_reads_them(spark, tmp_path):
    texts = ("Jaä 2019ö", "noö", "äVG und VGä", "Windpark Ödä\u000bx", "Nordexä SEö", "BGH 12/19", "Art. 3", "Klausel\u000bx", " hallo", "ÖAB 12/19ä", "Nr. ä", " ok", None, "")
    rows = [(c, 2 * i, "user", t) for i, t in enumerate(texts) for c in range(12)]
    beside_sql(spark, tmp_path, "f32_f33_question_features", conversations=(rows, "conv_id long, turn long, role string, text string"))


def test_law_references_as_re2_reads_them(spark, tmp_path):
    beside_sql(spark, tmp_path, "f31_f55_legal_references", documents=([(i, q) for i, q in enumerate((*QUESTIONS, "§\u000b5 BGB, § 6, Art. 3\u000bAbs. 2", "BGH I\u000bZR 1/20 SGB XII SGB XIV_"))], "doc_id long, text string"))


def test_domains_lower_a_text_once(spark, tmp_path):
    texts = ("Vertrag KÜNDIGUNG Haftung", "Umsatzsteuer", "Umsatzsteuer, Gewerbesteuer, Naturschutz und Artenschutz", "", None)
    beside_sql(spark, tmp_path, "r21_domain_scoring", documents=([(6 * i + k, x) for i, x in enumerate(texts) for k in range(6)], "doc_id long, text string"))
    plan = plans.QUERIES["r21_domain_scoring"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1


PASSAGES = ("Alpha beta gamma delta epsilon", "eta gamma del", "gamma", "amm", "", "ΟΔΟΣ", "Der ΟΔΟΣ. Weg ist lang und schmal", "eg ist", "§", "nirgends", "Alpha BETA gamma delta epsilon", "a-b c", "beta gamma delta epsilon zeta eta theta iota", "dieser", "welche")
TEXTS = ("Alpha beta gamma delta epsilon zeta eta theta iota kappa", "xAlpha beta gamma delta epsilony", "Der ΟΔΟΣ. Weg ist lang und schmal, § 5", "Unda-b cd gamma", "Alpha BETA gamma delta", "", "und und und", "In dieser Lage, welche es auch sei")


@pytest.mark.parametrize("name", ["a5_lexical_search_eval", "r17_variant_sweep", "r18_pool_comparison"])
def test_passages_of_any_length_have_gold(spark, tmp_path, name):
    benchmark = ([(i, p) for i, p in enumerate(PASSAGES)] + [(None, "gamma"), (98, "gamma"), (99, None)], "item_id long, text string")
    documents = ([(i, x, ("en", "de")[i % 3 % 2]) for i, x in enumerate(TEXTS * 3)], "doc_id long, text string, lang string")
    beside_sql(spark, tmp_path, name, benchmark=benchmark, documents=documents)


@pytest.mark.parametrize("few", [0, 256])
def test_a_short_passage_is_found_inside_of_a_word(spark, few):
    items = spark.createDataFrame([(i, p) for i, p in enumerate(PASSAGES)] + [(None, "gamma"), (99, None)], "item_id long, text string")
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)] + [(None, TEXTS[0]), (50, None)], "doc_id long, text string")
    got = R.containing(docs, items, id_col="doc_id", text_col="text", pid_col="item_id", passage_col="text", few=few).collect()
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if None not in (d.text, i.text) and i.text in d.text}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_cases_are_read_to_their_ends(spark, tmp_path):
    from hashlib import md5

    odd = ' "quoted" \\n back\\slash\t\r\n\r\n\r\n\n\n\n<p>x</p> {"text": "y"} [1, 2] [Picture] § 5 ä😀 ­- $ 12 Abs. und- oder'
    texts = ("a" * 400 + "b", "a" * 400 + "c", ("wort " * 90 + odd) * 40, odd, "kurz", "", None, "x" * 200_000 + "- y")
    rows = [(3 * i + k, x) for i, x in enumerate(texts) for k in range(3)]
    found = {(r.dump, r.pos): r.h for r in beside_sql(spark, tmp_path, "s8_case_dumps", documents=(rows, "doc_id long, text string"))}
    assert all(found[d, 0] == md5(texts[d // 3].encode()).hexdigest() for d in range(6)) and found[21, 1] == md5(("x" * 200_000 + "_y").encode()).hexdigest()
