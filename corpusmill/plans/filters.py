"""Queries over projections and filters (2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import filters as P
from corpusmill.plans.registry import phrase, query, sql_phrase


@query("p1_exclude_corpora", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NULL OR CAST(json_extract(props, '$.k') AS BIGINT) NOT IN (1, 2, 3)")
def p1(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t.events.where(P.exclude_values(k, [1, 2, 3])).select("event_id", k.alias("k"))


@query("p2_include_types", "SELECT p_partkey, p_type FROM part WHERE p_type IN (SELECT DISTINCT p_type FROM part ORDER BY p_type LIMIT 3)")
def p2(t):
    some = F.broadcast(t.part.select("p_type").distinct().orderBy("p_type").limit(3))
    return t.part.join(some, "p_type", "left_semi").select("p_partkey", "p_type")


@query("p3_unembedded_rows", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def p3(t):
    return P.missing(t.documents.select("doc_id"), t.embeddings, "doc_id", "vec_id")


@query("p4_unclassified_rows", "SELECT d.doc_id, l.quality IS NULL AS never FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL OR (quality = 1 AND toxic = 0)")
def p4(t):
    tags = F.when(F.col("quality").isNotNull(), F.filter(F.array(F.when(F.col("quality") == 0, F.lit("bad")), F.when(F.col("toxic") == 1, F.lit("toxic"))), lambda x: x.isNotNull()))
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left").withColumn("tags", tags)
    return joined.where(P.unclassified(F.col("tags"))).select("doc_id", F.col("quality").isNull().alias("never"))


@query("p5_optional_filter_page", "SELECT event_id, ts, event_type FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 20")
def p5(t):
    return P.page(t.events.select("event_id", "ts", "event_type", "user_id"), {"event_type": "click", "user_id": None}, [F.desc("ts"), F.desc("event_id")], 50, 20).select("event_id", "ts", "event_type")


@query("p6_half_open_range", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07'")
def p6(t):
    return t.events.where(P.within(F.col("ts"), "2024-01-05", "2024-01-07")).select("event_id", "ts")


@query("p7_tenant_visibility", "SELECT o_orderkey, o_custkey FROM orders o WHERE o_custkey = 7 OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_suppkey = 7)")
def p7(t):
    return P.visible_to(t.orders.select("o_orderkey", "o_custkey"), t.lineitem.select("l_orderkey", F.col("l_suppkey").cast("bigint").alias("who")), 7, key="o_orderkey", owner="o_custkey", share_key="l_orderkey", share_user="who")


BROKEN = ("", "/a214 ", "zzz qqq " * 20, "✗✘✙ ", "(((###***))) " * 12, "the und ")
#: Word edges are those of Unicode.
_EDGE_BEFORE, _EDGE_AFTER = (rf"({end}|[^\p{{L}}\p{{N}}_])" for end in ("^", "$"))
_EVERYDAY = P.EVERYDAY.split("(", 2)[2].split(")")[0]
_MARKS = P.READABLE_MARKS.replace("'", "''")
READABLE = f"""coalesce(trim(x) <> '' AND NOT regexp_matches(x, '/a\\d{{2,}}|[\\x{{2700}}-\\x{{27BF}}\\x{{2190}}-\\x{{21FF}}\\x{{2300}}-\\x{{23FF}}]{{3,}}|\\x{{FFFD}}')
  AND 1 - length(regexp_replace(x, '[\\p{{L}}\\p{{N}}\\s\\x0B{_MARKS}]', '', 'g')) / length(x) >= 0.7
  AND (length(x) <= 120 OR regexp_matches(x, '(?i){_EDGE_BEFORE}({_EVERYDAY}){_EDGE_AFTER}')), false)"""


@query("p8_readable_or_all", f"WITH given AS (SELECT conv_id, turn, {sql_phrase(BROKEN, 'conv_id + turn // 3')} || CASE WHEN turn % 3 > 0 THEN text ELSE '' END AS x FROM conversations), told AS (SELECT *, {READABLE} AS good FROM given) SELECT conv_id, turn FROM (SELECT *, bool_or(good) OVER (PARTITION BY conv_id) AS any_good FROM told) WHERE good OR NOT any_good")
def p8(t):
    """Readable passages of each conversation, or all if none is."""
    x = F.concat(phrase(BROKEN, F.col("conv_id") + F.expr("turn div 3")), F.when(F.col("turn") % 3 > 0, F.col("text")).otherwise(""))
    given = t.conversations.select("conv_id", "turn", x.alias("x"))
    return P.unless_none(given, P.readable(F.col("x")), ["conv_id"]).select("conv_id", "turn")


SAID = ("nicht enthalten.", "Keine Angabe", "not contained!", "too short", "Die Pacht ist nicht enthalten", "keine Angaben ...")


@query(
    "p9_contentless_findings",
    f"WITH given AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN '  ' || {sql_phrase(SAID, 'conv_id + 2 * turn')} ELSE text END AS x FROM conversations) SELECT conv_id, turn FROM given WHERE length(trim(x)) < 12 OR regexp_matches(lower(x), '^\\s*(not contained|nicht enthalten|keine angaben?)[.! ]*$')",
)
def p9(t):
    """A third of the messages say what findings without content say, or nearly that."""
    x = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.concat(F.lit("  "), phrase(SAID, F.col("conv_id") + 2 * F.col("turn")))).otherwise(F.col("text"))
    given = t.conversations.select("conv_id", "turn", x.alias("x"))
    return given.where((F.length(F.trim("x")) < 12) | F.lower("x").rlike(r"^\s*(not contained|nicht enthalten|keine angaben?)[.! ]*$")).select("conv_id", "turn")


@query("p10_length_gates", "SELECT doc_id, length(text) >= 20 AS any_text, length(text) >= 200 AS long_text, length(substr(text, 1, 10000)) AS cut FROM documents WHERE length(text) >= 50")
def p10(t):
    n = F.length("text")
    return t.documents.where(n >= 50).select("doc_id", (n >= 20).alias("any_text"), (n >= 200).alias("long_text"), F.length(F.substring("text", 1, 10000)).cast("bigint").alias("cut"))


@query(
    "p11_drop_reasons",
    """WITH records AS (
  SELECT conv_id AS shard, turn AS index, CASE WHEN conv_id % 3 = 0 THEN 'fr' WHEN turn % 4 = 3 THEN 'en' ELSE 'de' END AS language, ['caselaw', 'contracts', 'other'][turn % 3 + 1] AS type, ['DE', 'AT', 'CH'][conv_id % 3 + 1] AS law FROM conversations
), head AS (
  SELECT shard, count(DISTINCT language) = 1 AND max(language) <> 'de' AS skipped FROM records WHERE index < 5 GROUP BY 1
)
SELECT shard, coalesce(any_value(skipped), false) AS skipped, CASE WHEN coalesce(any_value(skipped), false) THEN 0 ELSE count(*) END AS seen,
  CASE WHEN coalesce(any_value(skipped), false) THEN 0 ELSE count(*) FILTER (language <> 'de') END AS wrong_language, CASE WHEN coalesce(any_value(skipped), false) THEN 0 ELSE count(*) FILTER (language = 'de' AND type = 'other') END AS wrong_type,
  CASE WHEN coalesce(any_value(skipped), false) THEN 0 ELSE count(*) FILTER (language = 'de' AND type <> 'other' AND law = 'CH') END AS wrong_jurisdiction,
  CASE WHEN coalesce(any_value(skipped), false) THEN 0 ELSE count(*) FILTER (language = 'de' AND type <> 'other' AND law <> 'CH') END AS kept
FROM records LEFT JOIN head USING (shard) GROUP BY shard""",
)
def p11(t):
    """Conversations as shards of records; every third is of another language from its head on."""
    conv, turn = F.col("conv_id"), F.col("turn")
    records = t.conversations.select(conv.alias("shard"), turn.alias("index"), F.when(conv % 3 == 0, "fr").when(turn % 4 == 3, "en").otherwise("de").alias("language"), phrase(("caselaw", "contracts", "other"), turn).alias("type"), phrase(("DE", "AT", "CH"), conv).alias("jurisdiction"))
    return P.shard_counts(records, ["de"], ["caselaw", "contracts"], ["DE", "AT"])


@query("p12_live_gold", "SELECT doc_id FROM labels WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def p12(t):
    return P.live(t.labels.select("doc_id"), t.embeddings, "doc_id", "vec_id")


@query("p13_gold_language_verdicts", "SELECT coalesce(CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN lang = 'de' THEN 'de' ELSE 'non_de' END, 'unknown') AS verdict, count(*) AS n FROM (SELECT vec_id * 2 AS gold FROM embeddings) e LEFT JOIN documents d ON e.gold = d.doc_id GROUP BY 1")
def p13(t):
    gold = t.embeddings.select((F.col("vec_id") * 2).alias("gold"))
    verdict = F.when(F.col("doc_id").isNull(), "missing").when(F.col("lang") == "de", "de").otherwise("non_de")
    return gold.join(t.documents.select("doc_id", "lang"), F.col("gold") == F.col("doc_id"), "left").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("p14_unexpired_cache", "SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN ts + INTERVAL 7 DAY END AS expires FROM events) WHERE expires IS NOT NULL AND expires > TIMESTAMP '2024-01-20'")
def p14(t):
    expires = F.when(F.col("event_id") % 5 != 0, F.col("ts") + F.expr("INTERVAL 7 DAYS"))
    return t.events.where(P.unexpired(expires, F.lit("2024-01-20").cast("timestamp"))).select("event_id")


@query("p15_plausible_cells", "SELECT p_partkey, CASE WHEN lower(trim(p_brand)) IN ('', '-', 'n/a', 'na', 'none', 'null', 'unbekannt', 'unknown', 'k.a.', 'keine angabe') THEN '?' ELSE trim(p_brand) END AS brand, CASE WHEN p_retailprice > 0 AND p_retailprice <= 10000 THEN p_retailprice END AS price FROM part")
def p15(t):
    return t.part.select("p_partkey", P.plausible_text(F.col("p_brand"), "?").alias("brand"), P.plausible_power(F.col("p_retailprice")).alias("price"))


TRIGRAMS = lambda x: f"list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
LIKENESS = lambda a, b: f"(len(list_intersect({TRIGRAMS(a)}, {TRIGRAMS(b)})) / greatest(len(list_distinct(list_concat({TRIGRAMS(a)}, {TRIGRAMS(b)}))), 1))"


@query(
    "p16_typeahead",
    f"""SELECT id, name, email, round(greatest({LIKENESS("lower(name)", "'customer 12'")}, {LIKENESS("email", "'customer 12'")}), 6) AS likeness FROM (
  SELECT c_custkey AS id, c_nationkey % 3 AS org, CASE WHEN c_custkey % 5 = 0 THEN 'locked' ELSE 'active' END AS status, replace(c_name, '#', ' ') AS name, 'customer ' || c_custkey % 130 || '@x' AS email FROM customer)
WHERE status = 'active' AND org = 1 AND id NOT IN (7, 11) AND (contains(lower(name), 'customer 12') OR contains(email, 'customer 12')) AND id NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey < 400) ORDER BY likeness DESC, name, id LIMIT 20""",
)
def p16(t):
    """Customers as users of three organisations; some are locked, some have it already."""
    k = F.col("c_custkey")
    users = t.customer.select(k.alias("id"), (F.col("c_nationkey") % 3).alias("org"), F.when(k % 5 == 0, "locked").otherwise("active").alias("status"), F.replace("c_name", F.lit("#"), F.lit(" ")).alias("name"), F.concat(F.lit("customer "), k % 130, F.lit("@x")).alias("email"))
    shared = t.orders.where("o_orderkey < 400").select(F.col("o_custkey").alias("id")).distinct()
    return P.share_targets(users, shared, caller=F.lit(7), owner=F.lit(11), org=F.lit(1), text=" Customer 12 ", limit=20)
