"""Vector search, passages in texts and mentions against plain versions."""

import numpy as np
import pyspark.sql.functions as F

from corpusmill.operators import feed as M
from corpusmill.operators import matching as X
from corpusmill.operators import retrieval as R
from corpusmill.operators import tables as TB
from corpusmill.operators import vectors as V
from corpusmill.session import table


def plain_best(queries, vectors, k):
    ids, m = list(vectors), np.array(list(vectors.values()), float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for qid, q in queries.items():
        s = np.round(m @ (np.array(q, float) / np.linalg.norm(q)), 6)
        out[qid] = [i for i, _ in sorted(zip(ids, s.tolist()), key=lambda x: (-x[1], x[0]))[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.qid, []).append(r.id)
    return out


def test_exact_search_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = {f"v{i:04}": rng.integers(-2, 3, 6).tolist() for i in range(700)}
    vectors = {i: v for i, v in vectors.items() if any(v)}
    rows = [(i, [float(x) for x in v]) for i, v in vectors.items()] + [("zero", [0.0] * 6), ("none", None), ("short", [1.0]), ("gap", [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "id string, v array<float>").repartition(5)
    queries = {k: list(vectors.values())[k] for k in range(40)}
    asked = spark.createDataFrame([(k, [float(x) for x in q]) for k, q in queries.items()], "qid long, q array<float>")
    want = plain_best(queries, vectors, 9)
    assert found(V.vector_search(asked, frame, id_col="id", vector_col="v", k=9)) == want
    monkeypatch.setattr(V, "BLOCK_BYTES", 8 * 6 * 7)  # blocks of about seven queries
    assert found(V.vector_search(asked, frame, id_col="id", vector_col="v", k=9)) == want
    assert V.vector_search(asked.limit(0), frame, id_col="id", vector_col="v", k=9).collect() == []
    assert V.vector_search(asked, frame.limit(0), id_col="id", vector_col="v", k=9).collect() == []


def test_cells_reach_nine_tenths(spark):
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    exact = found(V.vector_search(asked, vectors, id_col="vec_id", vector_col="embedding", k=30))
    index = V.CellIndex(vectors, id_col="vec_id", vector_col="embedding")
    assert index.table.count() == vectors.count()
    recall = lambda probes: np.mean([len(set(exact[q]) & set(ids)) / len(exact[q]) for q, ids in found(index.search(asked, k=30, probes=probes)).items()])
    probes = index.probes_for(0.92, k=30)
    few, usual, all_ = recall(2), recall(probes), recall(64)
    assert probes < 64 and few <= usual and usual >= 0.9 and all_ == 1.0


def test_containing(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    got = {(r.id, r.pid) for r in R.containing(docs, items, id_col="doc_id", text_col="text", pid_col="item_id", passage_col="text").collect()}
    assert got == {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if i.text in (d.text or "")} and got


def test_near_mentions(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ab.")) for _ in range(300)) for _ in range(4)] + ["", None, "a", "b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(r) for r in X.near_mentions(docs, "doc_id", "text", "a", "b", most=7).collect()}
    assert got == {(d, i + 1, j + 1) for d, t in enumerate(texts) for i, x in enumerate(t or "") for j, y in enumerate(t or "") if x == "a" and y == "b" and abs(i - j) < 7}


def test_numbered(spark):
    rows = spark.range(1000).selectExpr("pmod(id * 37, 1000) AS k").repartition(7)
    got = {r.id: r.k for r in M.numbered(rows, None, [F.col("k")], "cp-%04d").collect()}
    assert got == {f"cp-{k + 1:04}": k for k in range(1000)}
    assert M.numbered(rows.limit(0), None, [F.col("k")], "cp-%04d").collect() == []


def test_table_findings(spark):
    tables = {
        1: [["Posten 1", "100,00"], ["Posten 2", "3 Stk", "50,50 €"], ["Summe", "150,50"]],
        2: [["A", "100"], ["Netto", "100"], ["zzgl. 19 % MwSt", "16,00"], ["Gesamt brutto", "119,00"]],
        3: [["", "Gesamtbetrag", "1.000,00"], ["B", "996,00"], ["Text", "keine"]],
        4: [["Netto", "100"], ["USt", "19"], ["Rechnungsbetrag", "119"], ["Total", "120,00"]],
    }
    rows = spark.createDataFrame([(t, i, c) for t, cs in tables.items() for i, c in enumerate(cs)], "table int, place int, cells array<string>")
    got = {(r.table, r.kind, r.stated, r.computed, r.severity) for r in TB.findings(TB.totals(rows)).collect()}
    assert got == {(2, "sum_mismatch", 119.0, 100.0, "high"), (2, "vat_mismatch", 119.0, 116.0, "high"), (3, "sum_mismatch", 1000.0, 996.0, "low"), (4, "sum_mismatch", 120.0, 119.0, "medium")}
