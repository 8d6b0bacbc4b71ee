"""Queries over joins (2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import filters as P
from corpusmill.operators import findings as FN
from corpusmill.operators import matching as X
from corpusmill.operators import vectors as V
from corpusmill.plans.registry import query


def scan_children(children, parents, *, parent_filter=None):
    """Children with their parents; the join is made only where a filter on the parent asks for it."""
    if parent_filter is None:
        return children
    return children.join(parents.where(parent_filter), "o_orderkey").select(*children.columns)


@query("j1_child_parent_scan", "SELECT l_orderkey AS o_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def j1(t):
    return scan_children(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), t.orders, parent_filter=F.col("o_orderstatus") == "F")


@query("j2_child_with_context", "SELECT l_orderkey, l_linenumber, o_orderpriority || chr(10) || chr(10) || l_returnflag AS enriched FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def j2(t):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", F.concat_ws("\n\n", "o_orderpriority", "l_returnflag").alias("enriched"))


@query("j3_orphan_demotion", "SELECT e.vec_id, CASE WHEN l.doc_id IS NULL THEN NULL ELSE d.doc_id END AS parent_id, l.doc_id IS NULL AS is_orphan FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j3(t):
    child = t.embeddings.select("vec_id").join(t.documents.select("doc_id"), F.col("vec_id") == F.col("doc_id"))
    joined = child.join(t.labels.select(F.col("doc_id").alias("parent")), F.col("doc_id") == F.col("parent"), "left")
    return joined.select("vec_id", F.when(F.col("parent").isNotNull(), F.col("doc_id")).alias("parent_id"), F.col("parent").isNull().alias("is_orphan"))


@query("j4_least_sampled_first", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def j4(t):
    counted = t.orders.groupBy("o_custkey").agg(F.count("*").alias("k"))
    return t.customer.join(counted, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("k", F.lit(0)).alias("n")).orderBy("n", "c_custkey")


@query("j5_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j5(t):
    return P.missing(t.customer.select("c_custkey"), t.orders, "c_custkey", "o_custkey")


@query("j6_exists_or_owner", "SELECT s_suppkey FROM supplier WHERE s_nationkey = 1 OR EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50)")
def j6(t):
    for name in ("supplier", "lineitem"):
        getattr(t, name).createOrReplaceTempView(f"j6_{name}")
    return t.spark.sql("SELECT s_suppkey FROM j6_supplier WHERE s_nationkey = 1 OR EXISTS (SELECT 1 FROM j6_lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50)")


@query("j7_duplicate_chain", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey > 8000 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey <= 8000))")
def j7(t):
    again = P.live(t.orders.where("o_orderkey > 8000"), t.orders.where("o_orderkey <= 8000"), "o_custkey", "o_custkey")
    return P.live(t.lineitem.select("l_orderkey", "l_linenumber"), again, "l_orderkey", "o_orderkey")


@query("j8_hydration", "SELECT i.id, text FROM (SELECT unnest([1, 5, 9, 77, 99999999]) AS id) i JOIN documents ON doc_id = id")
def j8(t):
    ids = t.spark.createDataFrame([(i,) for i in (1, 5, 9, 77, 99999999)], "id long")
    return t.documents.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("id", "text")


@query("j9_scoped_vector_search", "SELECT vec_id, round(s, 5) AS score FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings JOIN documents ON vec_id = doc_id WHERE lang = 'en') ORDER BY s DESC, vec_id LIMIT 10")
def j9(t):
    probe = t.embeddings.where("vec_id = 0").select(F.lit(0).alias("qid"), F.col("embedding").alias("q"))
    docs = t.embeddings.join(t.documents.where("lang = 'en'"), F.col("vec_id") == F.col("doc_id")).select("vec_id", "embedding")
    return V.vector_search(probe, docs, id_col="vec_id", vector_col="embedding", k=10, digits=10).select(F.col("id").alias("vec_id"), F.round("score", 5).alias("score"))


@query("j10_member_counts", "SELECT n_nationkey, count(s_suppkey) AS members FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1")
def j10(t):
    return t.nation.join(t.supplier, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_nationkey").agg(F.count("s_suppkey").alias("members"))


@query("j11_backfill_from_join", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 99 END, c_nationkey) AS org FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j11(t):
    org = F.when(F.col("o_orderkey") % 2 == 0, F.lit(99))
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce(org, "c_nationkey").alias("org"))


@query(
    "j15_proximity_join",
    """WITH parts AS (
  SELECT doc_id, kind, string_split(text, mark) AS p FROM documents, (VALUES ('contract', 'License'), ('parcel', 'Version')) AS m(kind, mark) WHERE contains(text, mark)
), marked AS (
  SELECT doc_id, kind, unnest(list_transform(range(1, len(p)), lambda k: (1 + 7 * (k - 1) + list_sum(list_transform(p[1:k], lambda x: length(x))))::BIGINT)) AS pos FROM parts
)
SELECT a.doc_id, a.pos AS contract_at, b.pos AS parcel_at FROM marked a JOIN marked b ON a.doc_id = b.doc_id AND a.kind = 'contract' AND b.kind = 'parcel' AND abs(a.pos - b.pos) < 2000""",
)
def j15(t):
    """License lines as contracts, versions as parcels: mentions within 2,000 characters."""
    return X.near_mentions(t.documents, "doc_id", "text", r"License", r"Version", most=2000).select("doc_id", F.col("left_at").alias("contract_at"), F.col("right_at").alias("parcel_at"))


@query("j17_gold_enrichment", "SELECT e.vec_id, coalesce(d.lang, 'unknown') AS lang, q.quality FROM embeddings e LEFT JOIN (SELECT doc_id, max_by(quality, toxic) AS quality FROM labels GROUP BY 1) q ON e.vec_id = q.doc_id LEFT JOIN documents d ON e.vec_id = d.doc_id AND d.source <> 'src0'")
def j17(t):
    last = t.labels.groupBy("doc_id").agg(F.max_by("quality", "toxic").alias("quality"))
    docs = t.documents.where("source <> 'src0'").select(F.col("doc_id").alias("d"), "lang")
    return t.embeddings.select("vec_id").join(last, F.col("vec_id") == F.col("doc_id"), "left").join(docs, F.col("vec_id") == F.col("d"), "left").select("vec_id", F.coalesce("lang", F.lit("unknown")).alias("lang"), "quality")


@query("j18_probe_baseline", "SELECT e.vec_id AS id, l.quality, 'probe' AS side FROM (SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0) e LEFT JOIN labels l ON e.vec_id = l.doc_id UNION ALL SELECT doc_id, quality, 'orphan' FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0)")
def j18(t):
    probes = t.embeddings.where("vec_id % 20 = 0").select("vec_id")
    told = probes.join(t.labels, F.col("vec_id") == F.col("doc_id"), "left").select(F.col("vec_id").alias("id"), "quality", F.lit("probe").alias("side"))
    return told.unionByName(P.missing(t.labels, probes, "doc_id", "vec_id").select(F.col("doc_id").alias("id"), "quality", F.lit("orphan").alias("side")))


@query(
    "f44_j19_topic_coverage",
    """WITH topics AS (
  SELECT n_nationkey AS contract, topic, critical, words FROM nation, (VALUES ('Promo', true, ['promo burnished', 'promo anodized']), ('steel', false, []), ('Blank', true, ['blank', 'void']), ('Tin', false, ['nickel', 'brushed tin'])) AS p(topic, critical, words)
), seen AS (
  SELECT p_partkey % 25 AS contract, lower(p_type) AS kind FROM part WHERE p_partkey % 3 = 0
)
SELECT contract, topic, CASE WHEN critical THEN 4 ELSE 3 END AS severity FROM topics t WHERE NOT EXISTS (SELECT 1 FROM seen s, (SELECT unnest(CASE WHEN len(words) > 0 THEN words ELSE [lower(topic)] END) AS w) WHERE s.contract = t.contract AND contains(kind, w))""",
)
def j19(t):
    """Topics that each contract's clauses should cover; nations as contracts, kinds of parts as clauses."""
    playbook = t.spark.createDataFrame([("Promo", True, ["promo burnished", "promo anodized"]), ("steel", False, []), ("Blank", True, ["blank", "void"]), ("Tin", False, ["nickel", "brushed tin"])], "topic string, critical boolean, synonyms array<string>")
    topics = t.nation.select(F.col("n_nationkey").cast("bigint").alias("contract")).crossJoin(F.broadcast(playbook))
    seen = t.part.where("p_partkey % 3 = 0").select((F.col("p_partkey") % 25).alias("contract"), F.col("p_type").alias("kind"))
    return FN.topic_gaps(topics, seen)


@query("j20_manifest_hydration", "SELECT d.doc_id, coalesce(quality, 0) AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j20(t):
    return t.labels.join(t.documents.select("doc_id"), "doc_id", "right").select("doc_id", F.coalesce("quality", F.lit(0)).alias("score"))
