"""Queries over retrieval, evaluation and duplicates (2.6, 2.10)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusmill.functions import quality as Q
from corpusmill.operators import cover as C
from corpusmill.operators import dedup as D
from corpusmill.operators import evaluation as E
from corpusmill.operators import filters as P
from corpusmill.operators import findings as FN
from corpusmill.operators import lexical as L
from corpusmill.operators import ranking as W
from corpusmill.operators import retrieval as R
from corpusmill.operators import setjoin as S
from corpusmill.operators import vector_graph as VG
from corpusmill.operators import vectors as V
from corpusmill.plans.filters import LIKENESS
from corpusmill.plans.registry import phrase, query, sql_phrase
from corpusmill.session import shared_folder

TOKS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
WORDS = "list_filter(string_split_regex(replace(text, '\"', ' '), '[\\s\\x0B]+'), lambda w: w <> '')"


def longest_sql(words: str, most: int, longer_than: int) -> str:
    def pick(least: int) -> str:
        kept = f"list_filter(list_distinct({words}), lambda w: length(w) > {least})"
        keyed = f"list_sort(list_transform({kept}, lambda w: {{'n': -length(w), 'w': w}}))"
        return f"list_slice(list_transform({keyed}, lambda s: s.w), 1, {most})"

    return f"CASE WHEN len({pick(longer_than)}) > 0 THEN {pick(longer_than)} ELSE {pick(2)} END"


STOPPED = f"list_filter({WORDS}, lambda w: lower(w) NOT IN ({', '.join(map(repr, R.STOP_WORDS))}))"
#: The words that each variant of a match expression picks.
TERMS = {"v1": longest_sql(WORDS, 6, 4), "v2": longest_sql(WORDS, 4, 5), "v3": longest_sql(WORDS, 3, 5), "v5": longest_sql(STOPPED, 6, 4)}
TERMS["v4"] = TERMS["v1"]
TERMS["v7"] = f"CASE WHEN len({WORDS}) >= 8 THEN list_slice({TERMS['v1']}, 1, 3) ELSE {TERMS['v1']} END"
TERMS["v6"] = f"list_filter(list_transform({TERMS['v1']}, lambda w: regexp_replace(lower(substr(w, 1, 5)), '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda h: length(h) >= 3)"
#: The tokens of those words are looked up.
ASKED = "SELECT {qid} AS qid, regexp_extract_all(lower(array_to_string({terms}, ' ')), '[\\p{{L}}\\p{{N}}]+') AS terms FROM benchmark"
MATCH = ASKED.format(qid="item_id", terms=TERMS["v5"])


def bm25_sql(match: str) -> str:
    return f"""
q AS ({match}), wanted AS (SELECT qid, unnest(list_distinct(terms)) AS term FROM q),
toks AS (SELECT doc_id AS id, {TOKS} AS toks, len({TOKS}) AS len FROM documents),
stats AS (SELECT count(*) AS n_docs, avg(len) AS mean_len FROM toks),
found AS (SELECT term, id, len, count(*) AS tf FROM (SELECT id, len, unnest(toks) AS term FROM toks) WHERE term IN (SELECT term FROM wanted) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM found GROUP BY 1),
hits AS (SELECT qid, id, round(sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean_len))), 6) AS score FROM found JOIN df USING (term) JOIN wanted USING (term), stats GROUP BY 1, 2),
bm25_60 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM hits) WHERE rank <= 60),
bm25 AS (SELECT * FROM bm25_60 WHERE rank <= 30)"""


BM25 = bm25_sql(MATCH)
DENSE = """
vq AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
vs AS (SELECT qid, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM embeddings, vq),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM vs) WHERE rank <= 30)"""
FUSE = "SELECT qid, id, score, found_by, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, id, round(sum(w / (60 + rank)), 9) AS score, array_to_string(list_sort(list(DISTINCT leg)), '+') AS found_by FROM (SELECT qid, id, rank, 'dense' AS leg, {d} AS w FROM dense UNION ALL SELECT qid, id, rank, 'bm25', {b} FROM bm25) GROUP BY 1, 2)) WHERE rank <= 10"


def asked_terms(variant="v5"):
    """The tokens of the words that a variant picks."""
    return R.tokens(F.array_join(R.match_terms(F.col("text"), variant), " "))


def questions(t):
    return t.benchmark.select(F.col("item_id").alias("qid"), asked_terms().alias("terms"))


def index(t):
    """The kept index of the documents; built by the first query that asks these files."""
    folder = t.spark.conf.get("spark.checkpoint.dir", None) or shared_folder(t.spark)
    return L.index_of(t.spark, f"{folder}/lexical-index", t.documents, id_col="doc_id", text_col="text", source=L.snapshot(t.documents))


def lexical(t, k=30):
    return index(t).top_k(questions(t), k)


def dense(t, k=30):
    return V.vector_search(t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), t.embeddings, id_col="vec_id", vector_col="embedding", k=k)


def gold_documents(t):
    """The documents that hold a question's passage."""
    return R.containing(t.documents, t.benchmark, id_col="doc_id", text_col="text", pid_col="item_id", passage_col="text").select(F.col("pid").alias("qid"), F.col("id").alias("doc_id"))


def hybrid(t, **how):
    """Lexical and dense legs of a batch of questions, fused; the best ten of each."""
    return R.fuse({"dense": dense(t), "bm25": lexical(t)}, 10, **how)


@query("r6_hybrid_rrf", f"WITH {BM25}, {DENSE} " + FUSE.format(d="1.0", b="1.0"))
def r6(t):
    return hybrid(t)


@query("r7_weighted_rrf", f"WITH {BM25}, {DENSE} " + FUSE.format(d="0.7", b="0.3"))
def r7(t):
    return hybrid(t, weights={"dense": 0.7, "bm25": 0.3})


@query("r3_bm25_top_k", f"WITH {BM25} SELECT * FROM bm25")
def r3(t):
    return lexical(t)


@query("r3_bm25_without_an_index", f"WITH {BM25} SELECT * FROM bm25")
def r3_scan(t):
    """The same from the texts, for a table that is asked once."""
    return R.bm25(questions(t), t.documents.select("doc_id", "text"), id_col="doc_id", text_col="text", k=30)


CHANGED = BM25.replace("FROM documents", "FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN text || ' ' || text || ' added words' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 7)")


@query("r3_bm25_after_changes", f"WITH {CHANGED} SELECT * FROM bm25")
def r3_changed(t):
    """A tenth of the documents taken off and another given new texts, in an index of its own."""
    folder = t.spark.conf.get("spark.checkpoint.dir", None) or shared_folder(t.spark)
    kept = L.LexicalIndex(t.spark, f"{folder}/changed-index/{uuid.uuid4().hex}")
    kept.add(t.documents, id_col="doc_id", text_col="text")
    kept.remove(t.documents.where("doc_id % 10 = 7").select("doc_id"))
    kept.add(t.documents.where("doc_id % 10 = 3").select("doc_id", F.concat("text", F.lit(" "), "text", F.lit(" added words")).alias("text")), id_col="doc_id", text_col="text")
    return kept.top_k(questions(t), 30)


@query("t1_vector_top_k", f"WITH {DENSE} SELECT * FROM dense")
def t1(t):
    return dense(t)


@query("t2_cells_top_k")
def t2(t):
    """Approximate: the best 30 in the cells near each query; tests/test_vectors.py measures the recall."""
    index = V.CellIndex(t.embeddings, id_col="vec_id", vector_col="embedding")
    return index.search(t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), k=30, probes=index.probes_for(0.92, k=30))


@query("t2_graph_top_k")
def t2_graph(t):
    """Approximate: the best 30 that walks over graphs of blocks find; tests/test_vector_graph.py measures the recall."""
    index = VG.GraphIndex(t.embeddings, id_col="vec_id", vector_col="embedding")
    return index.search(t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), k=30, ef=96)


@query("t3_scoped_knn", "SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)), 6) AS score FROM embeddings WHERE label = 4 ORDER BY score DESC, id LIMIT 20")
def t3(t):
    q = t.embeddings.where("vec_id = 3").select(F.lit(0).alias("qid"), F.col("embedding").alias("q"))
    return V.vector_search(q, t.embeddings.where("label = 4"), id_col="vec_id", vector_col="embedding", k=20).select("id", "score")


@query("r1_truncate_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE)), 5) AS head FROM embeddings")
def r1(t):
    return t.embeddings.select("vec_id", F.round(F.aggregate(R.truncate(F.col("embedding"), 16), F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("head"))


@query("r2_unit_vectors", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, 1.0::DOUBLE AS unit FROM embeddings")
def r2(t):
    v = F.col("embedding")
    u = R.unit(v)
    return t.embeddings.select("vec_id", F.round(F.sqrt(R.dot(v, v)), 5).alias("norm"), F.round(R.dot(u, u), 6).alias("unit"))


def expression_sql(variant: str) -> str:
    wrapped = f"list_transform({TERMS[variant]}, lambda t: " + ("t || '*')" if variant == "v6" else "'\"' || t || '\"')")
    any_of, all_of = (f"array_to_string({wrapped}, ' {word} ')" for word in ("OR", "AND"))
    written = f"CASE WHEN len({WORDS}) >= 8 THEN {all_of} ELSE {any_of} END" if variant == "v7" else any_of
    return f"SELECT item_id, '{variant}' AS variant, nullif({written}, '') AS expression FROM benchmark"


EXPRESSIONS = " UNION ALL ".join(expression_sql(f"v{n}") for n in range(1, 8))


@query("r5_match_terms", MATCH)
def r5(t):
    return questions(t)


@query("r5_match_expressions", EXPRESSIONS)
def r5_all(t):
    """All seven variants."""
    variants = F.array(*[F.struct(F.lit(v).alias("variant"), R.match_expression(F.col("text"), v).alias("expression")) for v in ("v1", "v2", "v3", "v4", "v5", "v6", "v7")])
    return t.benchmark.select("item_id", F.inline(variants))


EXPANDED = f"""WITH q AS (
  SELECT item_id AS qid, text, {longest_sql(WORDS, 3, 4)} AS ws FROM benchmark
), words AS (
  SELECT qid, unnest(ws) AS w, unnest(range(len(ws))) AS place FROM q
), raw AS (
  SELECT qid, 0 AS leg, place, unnest([0, 1, 2, 3]) AS k, w, unnest([w || 's', upper(w), w || '*', w || 'en']) AS term FROM words
  UNION ALL
  SELECT qid, 1, 0, unnest([0, 1]), NULL, unnest(['alles ueber ' || ws[1], ws[1] || 'S']) FROM q WHERE qid % 2 = 0
), safe AS (
  SELECT * FROM raw WHERE (w IS NULL OR lower(term) <> lower(w)) AND length(term) BETWEEN 2 AND 80 AND NOT regexp_matches(term, '[*()"^]')
), first AS (
  SELECT qid, min({{'leg': leg, 'place': place, 'k': k, 'term': term}}) AS t FROM safe GROUP BY qid, lower(term)
), listed AS (
  SELECT qid, list_transform(list_sort(list(t)), lambda x: x.term) AS terms FROM first GROUP BY qid
)
SELECT q.qid AS item_id, coalesce(terms, []) AS expansions,
       q.text || CASE WHEN len(coalesce(terms, [])) > 0 THEN chr(10) || 'Verwandte Begriffe: ' || array_to_string(terms, ', ') ELSE '' END AS question
FROM q LEFT JOIN listed USING (qid)"""


@query("r8_r9_query_expansion", EXPANDED)
def r8(t):
    """Forms of words and phrases as a model once gave them, here made by rule; half of the questions have phrases."""
    q = t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    top = R.longest(R._words(F.col("question")), 3, 4)
    words = q.select(F.explode(top).alias("word")).distinct()
    forms = words.select("word", F.array(F.concat("word", F.lit("s")), R.capitals(F.col("word")), F.concat("word", F.lit("*")), F.concat("word", F.lit("en"))).alias("forms"))
    named = q.where("qid % 2 = 0").select(F.sha2("question", 256).alias("key"), F.get(top, F.lit(0)).alias("w")).distinct()
    phrases = named.select("key", F.array(F.concat(F.lit("alles ueber "), "w"), F.concat("w", F.lit("S"))).alias("terms"))
    found = R.expansions(q, forms, phrases, "r3")
    return q.join(found, "qid").select(F.col("qid").alias("item_id"), "expansions", R.augmented(F.col("question"), F.col("expansions"), F.array().cast("array<string>"), "q1").alias("question"))


@query(
    "r12_dedupe_by_parent",
    f"""WITH {BM25}, own AS (SELECT qid, id, rank, CASE WHEN id % 5 = 0 THEN -id ELSE id % 40 END AS parent FROM bm25), first AS (SELECT qid, parent, min({{'rank': rank, 'id': id}}) AS h FROM own GROUP BY 1, 2)
SELECT qid, parent, h.rank AS rank, h.id AS id FROM first QUALIFY row_number() OVER (PARTITION BY qid ORDER BY h.rank, h.id) <= 10""",
)
def r12(t):
    """Hits of a question, one a parent; every fifth has none and stands for itself."""
    hits = lexical(t).withColumn("owner", F.when(F.col("id") % 5 != 0, F.col("id") % 40))
    return FN.by_parent(hits, "qid", "id", "owner", "rank", 10)


@query(
    "r14_lexical_overlap",
    f"""WITH {BM25}, pairs AS (
  SELECT item_id, c.id AS doc_id, len(list_intersect(a, b)) AS hits
  FROM bm25_60 c JOIN (SELECT item_id, list_distinct({TOKS}) AS a FROM benchmark) q ON c.qid = q.item_id
  JOIN (SELECT doc_id, list_distinct({TOKS}) AS b FROM documents) d ON c.id = d.doc_id)
SELECT item_id, doc_id, hits FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS rn FROM pairs) WHERE rn <= 3""",
)
def r14(t):
    """Each question's own first 60 passages, by the words in common."""
    asked = t.benchmark.select(F.col("item_id"), F.col("text").alias("question"))
    found = lexical(t, 60).select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"))
    pairs = found.join(t.documents.select("doc_id", "text"), "doc_id").join(asked, "item_id")
    scored = pairs.select("item_id", "doc_id", R.overlap_score(F.col("question"), F.col("text")).cast("bigint").alias("hits"))
    return W.top_per_group(scored, ["item_id"], [F.desc("hits"), F.col("doc_id")], 3).select("item_id", "doc_id", "hits")


@query("r15_budgeted_selection", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM conversations) WHERE used < 1500")
def r15(t):
    from pyspark.sql import Window

    sized = t.conversations.select("conv_id", "turn", F.length("text").alias("size"))
    by_size = sized.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("size"), "turn")))
    return R.budgeted(by_size, "conv_id", "rank", "size", "turn", 1500).select("conv_id", "turn", "place")


GUARD = """WITH docs AS (
  SELECT user_id AS session, event_id AS place, ['queued', 'PROCESSING', 'done', 'failed', 'ready', 'Done'][event_id % 6 + 1] AS status, (event_id % 4)::INT AS n_chunks,
         (event_id % 7)::INT AS pages_done, CASE WHEN event_id % 5 <> 0 THEN (event_id % 7 + 3)::INT END AS pages_total, CASE WHEN event_id % 3 = 0 THEN ' no text ' || event_id ELSE '' END AS error
  FROM events WHERE user_id % 3 = 0 OR event_id % 6 > 1
), state AS (
  SELECT session, count(*) FILTER (lower(status) IN ('queued', 'processing', 'uploading')) AS going,
         count(*) FILTER (lower(status) IN ('done', 'ready') AND n_chunks > 0) AS usable,
         count(*) FILTER (lower(status) = 'failed' OR lower(status) IN ('done', 'ready') AND n_chunks = 0) AS failed,
         coalesce(sum(pages_done) FILTER (lower(status) IN ('queued', 'processing', 'uploading')), 0) AS pages_done,
         coalesce(sum(coalesce(pages_total, 0)) FILTER (lower(status) IN ('queued', 'processing', 'uploading')), 0) AS pages_total,
         arg_min(trim(error), place) FILTER ((lower(status) = 'failed' OR lower(status) IN ('done', 'ready') AND n_chunks = 0) AND trim(error) <> '') AS reason
  FROM docs GROUP BY 1
), turns AS (
  SELECT c_custkey AS turn_id, c_custkey AS session, ['contract', 'rag', 'rag+contract', 'chat'][c_custkey % 4 + 1] AS mode, (c_custkey // 4 % 2)::INT AS n_matter, (c_custkey // 4 % 3)::INT AS n_all FROM customer
), told AS (
  SELECT t.*, s.*, CASE WHEN mode NOT IN ('contract', 'rag+contract') OR CASE WHEN mode = 'rag+contract' THEN n_all ELSE n_matter END > 0 THEN 'generate'
    WHEN going > 0 THEN 'processing' WHEN failed > 0 AND usable = 0 THEN 'failed' ELSE 'no_passage' END AS outcome
  FROM turns t LEFT JOIN state s ON t.session = s.session
)
SELECT turn_id, outcome, CASE WHEN outcome = 'processing' THEN pages_done::BIGINT END AS pages_done, CASE WHEN outcome = 'processing' THEN pages_total::BIGINT END AS pages_total, CASE WHEN outcome = 'failed' THEN reason END AS reason FROM told"""


@query("r16_empty_grounding_guard", GUARD)
def r16(t):
    """Events stand in for documents of sessions, customers for turns."""
    e = F.col("event_id")
    docs = t.events.where((F.col("user_id") % 3 == 0) | (e % 6 > 1)).select(
        F.col("user_id").alias("session"), e.alias("place"), phrase(("queued", "PROCESSING", "done", "failed", "ready", "Done"), e).alias("status"), (e % 4).alias("n_chunks"), (e % 7).alias("pages_done"),
        F.when(e % 5 != 0, e % 7 + 3).alias("pages_total"), F.when(e % 3 == 0, F.concat(F.lit(" no text "), e)).otherwise("").alias("error"),
    )
    c = F.col("c_custkey")
    turns = t.customer.select(c.alias("turn_id"), c.alias("session"), phrase(("contract", "rag", "rag+contract", "chat"), c).alias("mode"), (F.expr("c_custkey div 4") % 2).alias("n_matter"), (F.expr("c_custkey div 4") % 3).alias("n_all"))
    return P.empty_grounding(turns, docs)


SWEPT = ("v1", "v2", "v3", "v5")
SWEEP = f"""WITH {bm25_sql(" UNION ALL ".join(ASKED.format(qid=f"{{'variant': '{v}', 'item': item_id}}", terms=TERMS[v]) for v in SWEPT))},
gold AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
firsts AS (SELECT variant, g.item_id, min(rank) AS rank FROM gold g, (SELECT unnest({list(SWEPT)}) AS variant) v LEFT JOIN bm25 b ON b.qid.variant = v.variant AND b.qid.item = g.item_id AND b.id = g.doc_id GROUP BY 1, 2),
cost AS (SELECT qid.variant AS variant, count(*) AS postings FROM wanted JOIN found USING (term) GROUP BY 1),
told AS (SELECT variant, round(avg(CASE WHEN rank <= 30 THEN 1.0 ELSE 0 END), 6) AS recall, postings FROM firsts JOIN cost USING (variant) GROUP BY ALL)
SELECT arg_min(variant, (postings, variant)) AS variant, count(*) AS survivors FROM told WHERE recall - (SELECT recall FROM told WHERE variant = 'v1') >= -0.01"""


@query("r17_variant_sweep", SWEEP)
def r17(t):
    """Recall of variants of the match expression; of those that lose no more than 0.01 the one that walks the fewest postings."""
    qs = t.benchmark.select(F.inline(F.array(*[F.struct(F.struct(F.lit(v).alias("variant"), F.col("item_id").alias("item")).alias("qid"), asked_terms(v).alias("terms")) for v in SWEPT])))
    kept = index(t)
    ranks = kept.top_k(qs, 30).select("qid.variant", F.col("qid.item").alias("item"), "id", "rank")
    gold = gold_documents(t).select(F.col("qid").alias("item"), F.col("doc_id").alias("id"))
    pools = gold.crossJoin(t.spark.createDataFrame([(v,) for v in SWEPT], "variant string"))
    first = pools.join(ranks, ["variant", "item", "id"], "left").groupBy("variant", "item").agg(F.min("rank").alias("rank"))
    recall = first.groupBy("variant").agg(F.round(F.avg(F.when(F.col("rank") <= 30, 1.0).otherwise(0.0)), 6).alias("recall"))
    terms = qs.select("qid.variant", F.explode(F.array_distinct("terms")).alias("term"))
    cost = terms.join(kept.frequencies(terms), "term").groupBy("variant").agg(F.sum("df").cast("double").alias("postings"))
    return E.choose_variant(recall.join(cost, "variant"), control="v1", metric="recall", latency="postings")


@query(
    "r18_pool_comparison",
    f"""WITH {BM25}, gold AS (SELECT item_id AS qid, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), members AS (
  SELECT 'baseline' AS pool, doc_id AS id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'signal', doc_id FROM documents WHERE doc_id % 2 = 0 OR lang = 'en' UNION ALL SELECT 'noise', doc_id FROM documents WHERE doc_id % 2 = 0 OR lang <> 'en'
), ranked AS (
  SELECT pool, qid, h.id, row_number() OVER (PARTITION BY pool, qid ORDER BY score DESC, h.id) AS rank FROM hits h JOIN members m ON h.id = m.id
), best AS (
  SELECT pool, r.qid, min(rank) AS rank FROM ranked r JOIN gold g ON r.qid = g.qid AND r.id = g.id GROUP BY 1, 2
)
SELECT pool, count(*) AS n, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM (SELECT * FROM (SELECT DISTINCT qid FROM gold), (SELECT unnest(['baseline', 'signal', 'noise']) AS pool)) q LEFT JOIN best USING (pool, qid) GROUP BY 1""",
)
def r18(t):
    """Half of the documents, and what those of one language, or of the others, add."""
    even = F.col("doc_id") % 2 == 0
    pools = F.array_compact(F.array(F.when(even, "baseline"), F.when(even | (F.col("lang") == "en"), "signal"), F.when(even | (F.col("lang") != "en"), "noise")))
    members = t.documents.select(F.explode(pools).alias("pool"), F.col("doc_id").alias("id"))
    return E.pool_comparison(index(t).scores(questions(t)), members, gold_documents(t).select("qid", F.col("doc_id").alias("id")), 10)


@query("r19_minhash_near_duplicates")
def r19(t):
    return D.near_duplicates(t.documents, "doc_id", "text")


@query("r19_exact_duplicates", "SELECT md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS hash, min(doc_id) AS keep, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact(t):
    return D.exact_duplicates(t.documents, "doc_id", "text")


TERM_LIST = ", ".join("'" + w + "'" for w in Q.LEGAL_TERMS)
TERM_ENDS = ("§ 5 BGB und Urteil", "Art. 3 StGB Gericht", "nothing", "Gericht Gericht Urteil §")


@query(
    "r20_quality_filter",
    f"""WITH given AS (SELECT doc_id, lang, CASE WHEN doc_id % 5 > 0 THEN text ELSE '' END || ' ' || {sql_phrase(TERM_ENDS, "doc_id")} AS x FROM documents), counted AS (
  SELECT *, len(list_filter(string_split_regex(x, '[\\s\\x0B]+'), lambda w: w <> '')) AS n, len(list_filter(string_split_regex(x, '[\\s\\x0B]+'), lambda w: w IN ({TERM_LIST}))) AS k FROM given
)
SELECT doc_id, round(100.0 * k / greatest(n, 1), 4) AS density FROM counted WHERE lang IN ('de', 'en') AND length(x) BETWEEN 100 AND 50000 AND 100.0 * k / greatest(n, 1) >= 1 AND NOT contains(x, chr(65533))""",
)
def r20(t):
    """Texts of any length with legal endings."""
    x = F.concat(F.when(F.col("doc_id") % 5 > 0, F.col("text")).otherwise(""), F.lit(" "), phrase(TERM_ENDS, F.col("doc_id")))
    made = t.documents.select("doc_id", "lang", x.alias("x"))
    return made.where(Q.keeps(F.col("x"), F.col("lang"))).select("doc_id", F.round(Q.term_density(F.col("x")), 4).alias("density"))


def _domain_score(domain: str) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(lower(x), '{w}') THEN {n} ELSE 0 END" for w, n in Q.KEYWORDS[domain].items()) + ")"


def _domain_hits(domain: str) -> str:
    return "(" + " + ".join(f"contains(lower(x), '{w}')::INT" for w in Q.KEYWORDS[domain]) + ")"


SUBJECTS = ("Die Genehmigung nach Immissionsschutz mit Lärm und Emission", "Pacht und Vertrag mit Kündigung", "Netzanschluss und Einspeisung nach EEG", "license version apache", "Steuer", "Bebauungsplan und Bauantrag, Vertrag mit Kündigung und Haftung")


@query(
    "r21_domain_scoring",
    "SELECT doc_id, domain, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, domain) AS rn FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, '{d}' AS domain, {_domain_score(d)} AS score, {_domain_hits(d)} AS k FROM (SELECT doc_id, {sql_phrase(SUBJECTS, 'doc_id')} || ' ' || text AS x FROM documents)" for d in Q.KEYWORDS)
    + ") WHERE score >= 8 AND k >= 2) WHERE rn = 1",
)
def r21(t):
    best = Q.best_domain(F.concat(phrase(SUBJECTS, F.col("doc_id")), F.lit(" "), "text"))
    return t.documents.select("doc_id", F.inline(F.array_compact(F.array(best))))  # worked out once a row


@query("t8_trigram_order", f"SELECT c_custkey, c_name, round({LIKENESS('c_name', "'Customer 12'")}, 6) AS s FROM customer WHERE contains(lower(c_name), '12') ORDER BY s DESC, c_name, c_custkey LIMIT 20")
def t8(t):
    return t.customer.where(F.lower("c_name").contains("12")).select("c_custkey", "c_name", F.round(R.trigram_similarity(F.col("c_name"), F.lit("Customer 12")), 6).alias("s")).orderBy(F.desc("s"), "c_name", "c_custkey").limit(20)


COVERS = """WITH q AS (
  SELECT qid, unnest(terms) AS word, len(terms) AS n FROM (
    SELECT item_id AS qid, list_distinct(list_slice(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: length(w) > 2), 1, 2)) AS terms FROM benchmark)
), places AS (
  SELECT doc_id AS id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents)
), hits AS (
  SELECT qid, id, n, word, pos, row_number() OVER (PARTITION BY qid, id ORDER BY pos) AS i FROM places JOIN q USING (word)
), lasts AS (
  SELECT h.qid, h.id, h.n, h.i, h.pos, (SELECT min(m) FROM (SELECT max(g.i) AS m FROM hits g WHERE g.qid = h.qid AND g.id = h.id AND g.i <= h.i GROUP BY g.word HAVING true) x) AS b,
         (SELECT count(DISTINCT g.word) FROM hits g WHERE g.qid = h.qid AND g.id = h.id AND g.i <= h.i) AS words
  FROM hits h
), covers AS (
  SELECT qid, id, b, min(i) AS i FROM lasts WHERE words = n GROUP BY qid, id, b
), scored AS (
  SELECT c.qid, c.id, round(sum(0.1 / (1 + (e.pos - s.pos) - (c.i - c.b))), 6) AS score
  FROM covers c JOIN hits e ON e.qid = c.qid AND e.id = c.id AND e.i = c.i JOIN hits s ON s.qid = c.qid AND s.id = c.id AND s.i = c.b GROUP BY 1, 2
)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 10"""


def short_questions(t):
    """The first two words of over two letters of each question."""
    words = F.slice(F.filter(R.tokens(F.col("text")), lambda w: F.length(w) > 2), 1, 2)
    return t.benchmark.select(F.col("item_id").alias("qid"), F.array_join(words, " ").alias("question"))


@query("r4_cover_density", COVERS)
def r4_covers(t):
    return C.cover_density(short_questions(t), t.documents, id_col="doc_id", text_col="text", k=10, stem=None)


@query("r4_stemmed_cover_density")
def r4_stems(t):
    """The same over German stems; tests/test_cover.py has a plain version."""
    return C.cover_density(short_questions(t), t.documents, id_col="doc_id", text_col="text", k=10)


@query("f25_similar_names", f"SELECT n_nationkey AS qid, c_custkey AS id, round({LIKENESS('c_name', 'needle')}, 6) AS similarity FROM customer, (SELECT n_nationkey, 'customer ' || n_nationkey * 5 AS needle FROM nation) WHERE round({LIKENESS('c_name', 'needle')}, 6) >= 0.6")
def f25(t):
    """A batch of needles against the names' kept trigrams; every name that is similar enough."""
    folder = t.spark.conf.get("spark.checkpoint.dir", None) or shared_folder(t.spark)
    names = S.TrigramIndex(t.spark, f"{folder}/trigrams/{uuid.uuid4().hex}", 0.6).build(t.customer, id_col="c_custkey", name_col="c_name")
    needles = t.nation.select(F.col("n_nationkey").alias("qid"), F.concat(F.lit("customer "), F.col("n_nationkey") * 5).alias("needle"))
    return names.search(needles).select("qid", "id", F.round("similarity", 6).alias("similarity"))


@query("a5_lexical_search_eval", f"WITH {BM25}, gold AS (SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), first AS (SELECT g.qid, min(rank) AS rank FROM gold g LEFT JOIN bm25 b ON g.qid = b.qid AND b.id = g.doc_id GROUP BY 1) SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10, round(avg(CASE WHEN rank <= 30 THEN 1.0 ELSE 0 END), 6) AS recall_30, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM first")
def search_eval(t):
    """Recall and reciprocal rank of the lexical leg; gold is any document that holds the passage."""
    gold = gold_documents(t)
    found = lexical(t).select(F.col("qid").alias("q"), "id", "rank")
    first = gold.join(found, (F.col("qid") == F.col("q")) & (F.col("doc_id") == F.col("id")), "left").groupBy("qid").agg(F.min("rank").alias("rank"))
    return E.recall(first, "rank", [1, 10, 30])
