"""Queries over windows, sorts, sets and writes (2.5 - 2.8)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.operators import feed as M
from corpusmill.operators import filters as P
from corpusmill.operators import ranking as W
from corpusmill.operators import writes as X
from corpusmill.plans.registry import phrase, query, sql_phrase


@query("w1_rank_in_ranking", "SELECT qid, id, rank FROM (SELECT o_custkey AS qid, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5")
def w1(t):
    return W.top_per_group(t.orders.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"), "o_totalprice"), ["qid"], [F.desc("o_totalprice"), F.col("id")], 5).select("qid", "id", "rank")


@query("w2_fairness_pick", "SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, score DESC, id) AS pick FROM (SELECT l_suppkey AS qid, l_partkey AS doc, l_orderkey * 10 + l_linenumber AS id, l_extendedprice AS score, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS k FROM lineitem)) WHERE pick <= 10")
def w2(t):
    hits = t.lineitem.select(F.col("l_suppkey").alias("qid"), F.col("l_partkey").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("score"))
    return W.fair_pick(hits, "qid", "doc", "score", "id", 10).select("qid", "id")


@query("w3_section_carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'login' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events")
def w3(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.last(F.when(F.col("event_type") == "login", F.col("event_id")), ignorenulls=True).over(w).alias("section"))


@query("w4_gap_merge", "SELECT user_id, greatest(min(a) - 300, 0) AS a, max(b) + 300 AS b FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN prev IS NULL OR a - prev >= 20000 THEN 1 ELSE 0 END AS brk FROM (SELECT user_id, a, b, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (SELECT user_id, epoch(ts)::BIGINT - 1704067200 AS a, epoch(ts)::BIGINT - 1704067200 + 600 AS b FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events))))) GROUP BY user_id, island")
def w4(t):
    at = F.unix_timestamp("ts") - 1704067200
    return W.merge_intervals(t.events.select("user_id", at.alias("a"), (at + 600).alias("b")), ["user_id"], "a", "b", 20000, 300)


OPENERS = ("hello", " Danke ", "📎 vertrag.pdf hochgeladen", "ok", "test", "")
CHITCHAT = ", ".join(map(repr, W.CHITCHAT))


@query(
    "w5_conversation_title",
    f"""WITH said AS (
  SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN {sql_phrase(OPENERS, "conv_id")} ELSE text END AS text FROM conversations
), picks AS (
  SELECT conv_id, arg_min(substr(text, 1, 80), turn) FILTER (role = 'user' AND trim(text) <> '' AND substr(trim(text), 1, 1) <> '📎' AND length(trim(text)) >= 12 AND lower(trim(text)) NOT IN ({CHITCHAT})) AS good,
    arg_min(substr(text, 1, 80), turn) FILTER (role = 'user') AS anything FROM said GROUP BY conv_id
)
SELECT conv_id, coalesce(CASE WHEN conv_id % 10 = 0 THEN 'Mein Titel' END, good, CASE WHEN conv_id % 3 = 0 THEN 'file' || conv_id || '.pdf' END, anything, 'Untitled chat') AS title FROM picks""",
)
def w5(t):
    """Titles that users gave, first real questions, file names, and what else was said."""
    c = F.col("conv_id")
    said = t.conversations.select("conv_id", "turn", "role", F.when(F.col("turn") % 3 == 0, phrase(OPENERS, c)).otherwise(F.col("text")).alias("text"))
    named = t.conversations.select("conv_id").distinct().select("conv_id", F.when(c % 10 == 0, " Mein Titel ").otherwise(" ").alias("title"), F.when(c % 3 == 0, F.concat(F.lit("file"), c, F.lit(".pdf"))).alias("filename"))
    return W.display_titles(named, said, "conv_id").select("conv_id", F.col("display").alias("title"))


@query("w6_duplicate_titles", "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY lang || source ORDER BY doc_id DESC) > 1 THEN lang || source || ' (' || doc_id || ')' ELSE lang || source END AS title FROM documents")
def w6(t):
    """All but the newest of a title get a suffix; the newest is a maximum, so no title is sorted whole."""
    titled = t.documents.select("doc_id", F.concat("lang", "source").alias("title"))
    newest = titled.groupBy(F.col("title").alias("t")).agg(F.max("doc_id").alias("newest"))
    joined = titled.join(newest, F.col("title").eqNullSafe(F.col("t")))
    return joined.select("doc_id", F.when(F.col("doc_id") < F.col("newest"), F.concat("title", F.lit(" ("), F.col("doc_id").cast("string"), F.lit(")"))).otherwise(F.col("title")).alias("title"))


@query("w7_spiral_jitter", "SELECT c_custkey, round(0.003 * cos(2 * pi() * (j - 1) / n), 6) AS dx, round(0.003 * sin(2 * pi() * (j - 1) / n), 6) AS dy FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS j, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE n > 1")
def w7(t):
    points = t.customer.select("c_custkey", "c_nationkey")
    sizes = points.groupBy("c_nationkey").agg(F.count("*").alias("n")).where("n > 1")
    numbered = W.placed(points, ["c_nationkey"], [F.col("c_custkey")]).join(sizes, "c_nationkey")
    angle = 2 * F.pi() * (F.col("place") - 1) / F.col("n")
    return numbered.select("c_custkey", F.round(0.003 * F.cos(angle), 6).alias("dx"), F.round(0.003 * F.sin(angle), 6).alias("dy"))


@query("w9_last_messages", "SELECT conv_id, turn, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '[...truncated]' ELSE text END AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 4")
def w9(t):
    last = W.top_per_group(t.conversations, ["conv_id"], [F.desc("turn")], 4)
    return last.select("conv_id", "turn", F.when(F.length("text") > 2000, F.concat(F.substring("text", 1, 2000), F.lit("[...truncated]"))).otherwise(F.col("text")).alias("text"))


@query("w10_refresh_cadence", "SELECT conv_id, turn FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user') WHERE k % 3 = 0")
def w10(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.where("role = 'user'").withColumn("k", F.count("*").over(w)).where("k % 3 = 0").select("conv_id", "turn")


@query("w11_provenance_winner", "SELECT l_partkey AS field, l_orderkey AS source, l_quantity AS value FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag, l_discount DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def w11(t):
    return W.first_per_key(t.lineitem, ["l_partkey"], [F.col("l_returnflag"), F.desc("l_discount"), F.col("l_orderkey"), F.col("l_linenumber")]).select(F.col("l_partkey").alias("field"), F.col("l_orderkey").alias("source"), F.col("l_quantity").alias("value"))


@query("t6_rerank_top_n", "SELECT conv_id, turn, score FROM (SELECT conv_id, turn, length(text) AS score, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rn FROM conversations) WHERE rn <= 2")
def t6(t):
    return W.top_per_group(t.conversations.select("conv_id", "turn", F.length("text").cast("bigint").alias("score")), ["conv_id"], [F.desc("score"), F.col("turn")], 2).select("conv_id", "turn", "score")


@query("t7_newest_first", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def t7(t):
    return P.page(t.events.select("event_id", "ts"), {}, [F.desc("ts"), F.desc("event_id")], 100)


@query("t9_timeline_order", "SELECT o_orderkey, days FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN date_diff('day', DATE '1995-01-01', o_orderdate::DATE) END AS days FROM orders)")
def t9(t):
    days = F.when(F.col("o_orderkey") % 4 != 0, F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("bigint"))
    return t.orders.select("o_orderkey", days.alias("days")).orderBy(F.coalesce("days", F.lit(99999)), "o_orderkey")


@query("t10_keyset_scan", "SELECT o_orderkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 200")
def t10(t):
    return t.orders.where("o_orderkey > 1000").select("o_orderkey").orderBy("o_orderkey").limit(200)


@query("u2_priority_union", "SELECT printf('cp-%04d', row_number() OVER (ORDER BY k)) AS id, k, prio FROM (SELECT k, min(prio) AS prio FROM (SELECT c_nationkey AS k, 1 AS prio FROM customer UNION ALL SELECT s_nationkey, 2 FROM supplier UNION ALL SELECT n_nationkey, 3 FROM nation) GROUP BY k)")
def u2(t):
    parts = [t.customer.select(F.col("c_nationkey").alias("k"), F.lit(1).alias("prio")), t.supplier.select(F.col("s_nationkey").alias("k"), F.lit(2).alias("prio")), t.nation.select(F.col("n_nationkey").alias("k"), F.lit(3).alias("prio"))]
    first = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("k").agg(F.min("prio").alias("prio"))
    return M.numbered(first, None, [F.col("k")], "cp-%04d").select("id", "k", "prio")


@query("u3_set_difference", "SELECT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 1")
def u3(t):
    """Customers with an order of one kind and none of another."""
    kind = F.col("o_orderkey") % 3
    return t.orders.where(kind == 0).select(F.col("o_custkey").alias("k")).subtract(t.orders.where(kind == 1).select("o_custkey"))


@query(
    "u4_pairwise_intersection",
    "WITH h AS (SELECT DISTINCT lang, substr(sha256(substr(text, 1, 500)), 1, 16) AS h FROM documents), n AS (SELECT lang, count(*) AS n FROM h GROUP BY 1) SELECT a.lang AS a, b.lang AS b, round(100.0 * (SELECT count(*) FROM h x JOIN h y ON x.h = y.h WHERE x.lang = a.lang AND y.lang = b.lang) / a.n, 4) AS pct FROM n a, n b WHERE a.lang <> b.lang",
)
def u4(t):
    """Pairs of corpora come from the (few) corpora of each hash; the frame of all pairs is tiny."""
    h = t.documents.select("lang", F.substring(F.sha2(F.substring("text", 1, 500), 256), 1, 16).alias("h")).distinct()
    sizes = h.groupBy("lang").agg(F.count("*").alias("n"))
    shared = h.groupBy("h").agg(F.collect_set("lang").alias("ls")).where(F.size("ls") > 1)
    met = shared.select(F.explode("ls").alias("a"), "ls").select("a", F.explode("ls").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("k"))
    pairs = sizes.select(F.col("lang").alias("a"), "n").crossJoin(F.broadcast(sizes.select(F.col("lang").alias("b")))).where("a <> b")
    return pairs.join(met, ["a", "b"], "left").select("a", "b", F.round(100.0 * F.coalesce("k", F.lit(0)) / F.col("n"), 4).alias("pct"))


@query("u5_multi_source_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u5(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("m1_insert_ignore", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)")
def m1(t):
    o = t.orders.select("o_orderkey")
    return M.insert_ignore(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0"), "o_orderkey")


@query("m2_upsert", "SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def m2(t):
    e = t.events.select("user_id", "value", "event_id")
    return M.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "event_id")


@query("m3_replace_by_key", "SELECT l_orderkey, l_linenumber, 'old' AS side FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT o_orderkey, 0, 'new' FROM orders WHERE o_orderstatus = 'F'")
def m3(t):
    old = t.lineitem.select("l_orderkey", "l_linenumber", F.lit("old").alias("side"))
    new = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.lit("new").alias("side"))
    return M.replace(old, new, "l_orderkey")


@query("m4_prune_vanished", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01' OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 40)")
def m4(t):
    current = t.lineitem.where("l_quantity >= 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return M.prune(t.orders.select("o_orderkey", "o_orderdate"), current, "o_orderkey", "o_orderdate", F.lit("1995-06-01").cast("timestamp")).select("o_orderkey")


@query("m5_cascade_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT')")
def m5(t):
    return M.cascade(t.lineitem.select("l_orderkey", "l_linenumber"), t.orders.where("o_orderpriority <> '1-URGENT'"), "l_orderkey", "o_orderkey")


@query("m6_retention_purge", "SELECT event_id, NULL::BIGINT AS purged, NULL::BIGINT AS kept FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 10 DAY UNION ALL SELECT NULL, count(*) FILTER (ts < TIMESTAMP '2024-01-10'), count(*) FILTER (ts >= TIMESTAMP '2024-01-10') FROM events")
def m6(t):
    """The rows that stay, and a dry run's counts."""
    as_of = F.lit("2024-01-20").cast("timestamp")
    none = F.lit(None).cast("bigint")
    stay = X.purge(t.events, "ts", as_of, 10).select("event_id", none.alias("purged"), none.alias("kept"))
    return stay.unionByName(X.purge(t.events, "ts", as_of, 10, dry_run=True).select(none.alias("event_id"), "purged", "kept"))


@query("m7_orphan_reaper", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') AND ts < TIMESTAMP '2024-01-29 21:00:00' THEN 'failed' ELSE event_type END AS state FROM events")
def m7(t):
    stale = F.col("event_type").isin("click", "view") & (F.col("ts") < F.lit("2024-01-29 21:00:00").cast("timestamp"))
    return t.events.select("event_id", F.when(stale, "failed").otherwise(F.col("event_type")).alias("state"))


@query(
    "m8_request_reuse",
    """WITH asked AS (
  SELECT conv_id, 'u' || conv_id % 3 AS usr, sha256('u' || conv_id % 3 || '|' || array_to_string(list_sort(list(DISTINCT (turn % 4)::VARCHAR)), ',') || '|full|r' || conv_id % 2) AS fp FROM conversations GROUP BY conv_id
), reports AS (
  SELECT a.conv_id * 10 + k AS report, fp, usr, ['done', 'running', 'failed', 'queued'][(conv_id + k) % 4 + 1] AS status, TIMESTAMP '2024-01-20' - INTERVAL (conv_id % 5 + k) HOUR AS created, CASE WHEN conv_id % 2 = 0 THEN TIMESTAMP '2024-01-20' - INTERVAL (k) HOUR END AS started
  FROM asked a, (SELECT unnest([0, 1, 2]) AS k) WHERE conv_id % 7 <> 0
), live AS (
  SELECT fp, usr, max({'created': created, 'report': report, 'status': status}) AS r FROM reports WHERE status = 'done' OR status IN ('queued', 'running') AND coalesce(started, created) > TIMESTAMP '2024-01-20' - INTERVAL 2 HOUR GROUP BY 1, 2
)
SELECT conv_id, fp, r.report AS report, r.status AS status FROM asked LEFT JOIN live USING (fp, usr)""",
)
def m8(t):
    """Requests over sets of documents, and reports of earlier ones in all states."""
    c = F.col("conv_id")
    ids = t.conversations.groupBy("conv_id").agg(F.collect_set((F.col("turn") % 4).cast("string")).alias("ids"))
    user = F.concat(F.lit("u"), c % 3)
    asked = ids.select("conv_id", X.request_key(user, F.shuffle("ids"), F.lit(" FULL"), F.concat(F.lit("R"), c % 2)).alias("fp"), user.alias("user"))
    as_of = F.lit("2024-01-20").cast("timestamp")
    before = lambda hours: as_of - F.make_dt_interval(F.lit(0), hours.cast("int"))
    k = F.col("k")
    reports = asked.where(c % 7 != 0).select("*", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("k")).select(
        (c * 10 + k).alias("report"), "fp", "user", phrase(("done", "running", "failed", "queued"), c + k).alias("status"), before(c % 5 + k).alias("created"), F.when(c % 2 == 0, before(k)).alias("started")
    )
    return X.reusable(asked, reports, as_of).select("conv_id", "fp", "report", "status")


@query("m9_id_rebase", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id + 100000000 ELSE doc_id + 100000000 END AS id FROM documents WHERE doc_id % 3 <> 1 UNION ALL SELECT doc_id, doc_id + 100000000 FROM documents WHERE doc_id % 3 = 1")
def m9(t):
    """Ids missing in two of three rows; the others were rebased before, and doing it twice changes nothing."""
    rows = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 1, F.col("doc_id") + 100_000_000).alias("id"))
    return X.rebase(X.rebase(rows, "id", "doc_id"), "id", "doc_id")


@query(
    "m10_conditional_upsert",
    """WITH rows AS (
  SELECT user_id % 20 AS org, 'm' || user_id AS email, event_id AS invite, ts AS created, CASE WHEN event_type = 'purchase' THEN ts END AS accepted FROM events WHERE event_id % 2 = 0 AND event_type = 'purchase'
  UNION ALL
  SELECT user_id % 20, 'm' || user_id, max(event_id), arg_max(ts, event_id), NULL FROM events WHERE event_id % 2 = 0 AND event_type <> 'purchase' GROUP BY user_id
), asked AS (
  SELECT user_id % 20 AS org, 'm' || user_id AS email, max(event_id) AS invite, arg_max(ts, event_id) AS created, NULL::TIMESTAMP AS accepted FROM events WHERE event_id % 2 = 1 AND user_id % 4 = 0 GROUP BY user_id
)
SELECT * FROM rows WHERE accepted IS NOT NULL UNION ALL SELECT * FROM rows r WHERE accepted IS NULL AND NOT EXISTS (SELECT 1 FROM asked a WHERE a.org = r.org AND a.email = r.email) UNION ALL SELECT * FROM asked""",
)
def m10(t):
    """Invitations: accepted ones stay, open ones are replaced by the last request of the same address."""
    e = t.events.select((F.col("user_id") % 20).alias("org"), F.concat(F.lit("m"), "user_id").alias("email"), F.col("event_id").alias("invite"), F.col("ts").alias("created"), F.when(F.col("event_type") == "purchase", F.col("ts")).alias("accepted"), "user_id", "event_type")
    old = e.where("invite % 2 = 0")
    open_ = X.invite(old.where("false").drop("user_id", "event_type"), old.where("event_type <> 'purchase'").drop("user_id", "event_type"), ["org", "email"], "invite", "accepted")
    existing = old.where("event_type = 'purchase'").drop("user_id", "event_type").unionByName(open_)
    asked = e.where("invite % 2 = 1 and user_id % 4 = 0").withColumn("accepted", F.lit(None).cast("timestamp")).drop("user_id", "event_type")
    return X.invite(existing, asked, ["org", "email"], "invite", "accepted")


@query(
    "m11_single_use_consume",
    """WITH tokens AS (
  SELECT c_custkey AS hash, TIMESTAMP '2024-01-15' + INTERVAL (c_custkey % 10) DAY AS expires, CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '2024-01-01' END AS consumed FROM customer
), first AS (
  SELECT user_id AS hash, min({'ts': ts, 'request': event_id}) AS f FROM events GROUP BY 1
)
SELECT event_id AS request, coalesce(f.request = event_id AND consumed IS NULL AND expires > f.ts, false) AS granted
FROM events e LEFT JOIN first ON e.user_id = first.hash LEFT JOIN tokens ON e.user_id = tokens.hash""",
)
def m11(t):
    """Requests for tokens that are new, used, expired or not known."""
    k = F.col("c_custkey")
    tokens = t.customer.select(k.alias("hash"), (F.lit("2024-01-15").cast("timestamp") + F.make_dt_interval((k % 10).cast("int"))).alias("expires"), F.when(k % 5 == 0, F.lit("2024-01-01").cast("timestamp")).alias("consumed"))
    asked = t.events.select(F.col("event_id").alias("request"), F.col("user_id").alias("hash"), F.col("ts").cast("timestamp").alias("at"))
    return X.consume(tokens, asked, F.lit("2024-01-20").cast("timestamp"))[1]


@query(
    "m12_share_grant",
    """WITH owners AS (SELECT c_custkey AS session, c_custkey % 7 AS owner FROM customer), shares AS (SELECT c_custkey AS session, 3 AS who, c_custkey % 7 AS granted_by FROM customer WHERE c_custkey % 7 <> 3), asked AS (
  SELECT o_orderkey AS request, CASE WHEN o_orderkey % 4 = 0 THEN 'revoke' ELSE 'grant' END AS kind, o_custkey AS session, o_orderkey % 5 AS who, CASE WHEN o_orderkey % 9 = 0 THEN 6 ELSE o_custkey % 7 END AS by_whom FROM orders
), told AS (
  SELECT a.*, CASE WHEN owner IS NULL OR owner <> by_whom THEN 'refused' WHEN kind = 'grant' AND who = owner THEN 'own' ELSE kind END AS outcome FROM asked a LEFT JOIN owners USING (session)
), last AS (
  SELECT session, who, arg_max(kind, request) AS kind, arg_max(by_whom, request) AS by_whom FROM told WHERE outcome IN ('grant', 'revoke') GROUP BY 1, 2
)
SELECT session, who, granted_by FROM shares s WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.session = s.session AND l.who = s.who) UNION ALL SELECT session, who, by_whom FROM last WHERE kind = 'grant'""",
)
def m12(t):
    """Grants and revocations, some by others than the owner or to the owner."""
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    owners = t.customer.select(c.alias("session"), (c % 7).alias("owner"))
    shares = t.customer.where(c % 7 != 3).select(c.alias("session"), F.lit(3).cast("bigint").alias("user"), (c % 7).alias("granted_by"))
    asked = t.orders.select(o.alias("request"), o.alias("at"), F.when(o % 4 == 0, "revoke").otherwise("grant").alias("kind"), F.col("o_custkey").alias("session"), (o % 5).alias("user"), F.when(o % 9 == 0, 6).otherwise(F.col("o_custkey") % 7).alias("by"))
    return X.share(owners, shares, asked)[0].select("session", F.col("user").alias("who"), "granted_by")


@query(
    "u6_first_source",
    """WITH every AS (
  SELECT c_nationkey AS k, c_custkey AS row_id, 0 AS source FROM customer WHERE c_nationkey < 8 UNION ALL SELECT s_nationkey, s_suppkey, 1 FROM supplier WHERE s_nationkey < 16 UNION ALL SELECT n_nationkey, -n_nationkey, 2 FROM nation
)
SELECT k, min({'source': source, 'row_id': row_id}).source AS source, min({'source': source, 'row_id': row_id}).row_id AS row_id FROM every GROUP BY k""",
)
def u6(t):
    """Nations by customers, else by suppliers, else by themselves; a last resort that is not needed."""
    a = t.customer.where("c_nationkey < 8").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("row_id"))
    b = t.supplier.where("s_nationkey < 16").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("row_id"))
    c = t.nation.select(F.col("n_nationkey").alias("k"), (-F.col("n_nationkey")).alias("row_id"))
    return X.first_source([a, b, c], "k", only_if_none=c.select((F.col("k") + 100).alias("k"), "row_id"))


@query(
    "x4_expiring_cache",
    """WITH cache AS (SELECT event_id % 500 AS key, event_id AS value, CASE WHEN event_id % 5 <> 0 THEN ts + INTERVAL 7 DAY END AS expires FROM events WHERE event_id % 2 = 0), live AS (
  SELECT key, value, expires FROM cache WHERE expires > TIMESTAMP '2024-01-20'
), fetched AS (SELECT event_id % 500 AS key, max(event_id) AS value, TIMESTAMP '2024-01-20' + INTERVAL 90 DAY AS expires FROM events WHERE event_id % 7 = 3 AND event_id % 500 < 100 GROUP BY 1)
SELECT key, value, expires FROM live WHERE key NOT IN (SELECT key FROM fetched) UNION ALL SELECT * FROM fetched""",
)
def x4(t):
    """The cache after a fetch: live entries that were not fetched again, and the fetched for 90 days."""
    as_of = F.lit("2024-01-20").cast("timestamp")
    key = (F.col("event_id") % 500).alias("key")
    cache = t.events.where("event_id % 2 = 0").select(key, F.col("event_id").alias("value"), F.when(F.col("event_id") % 5 != 0, F.col("ts").cast("timestamp") + F.expr("INTERVAL 7 DAYS")).alias("expires"))
    fetched = t.events.where("event_id % 7 = 3 and event_id % 500 < 100").select(key, F.col("event_id").alias("value"))
    return X.cache_after(cache, fetched, as_of, 90)


@query("m13_fill_nulls_merge", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'NEW' END, c_mktsegment) AS c_mktsegment FROM customer")
def m13(t):
    old = t.customer.select("c_custkey", "c_mktsegment")
    new = old.where("c_custkey % 3 <> 1").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "NEW").otherwise("").alias("c_mktsegment"))
    return M.fill_nulls(old, new, "c_custkey", ["c_mktsegment"])


@query("x3_content_hash_changes", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'vanished' WHEN a.doc_id IS NULL THEN 'new' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS change FROM (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0) a FULL OUTER JOIN (SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN upper(text) ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0) b ON a.doc_id = b.doc_id")
def x3(t):
    old = t.documents.where("doc_id % 7 <> 0").select("doc_id", F.md5("text").alias("h"))
    new = t.documents.where("doc_id % 11 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 5 == 0, F.upper("text")).otherwise(F.col("text"))).alias("h"))
    return M.changes(old, new, "doc_id", "h")
