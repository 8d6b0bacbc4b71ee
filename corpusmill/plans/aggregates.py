"""Queries over aggregations (2.4)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import guard as U
from corpusmill.operators import audits as A
from corpusmill.operators import evaluation as E
from corpusmill.operators import tables as TB
from corpusmill.operators import writes as X
from corpusmill.plans.registry import phrase, query, sql_list, sql_phrase


@query("a1_progress_counters", "SELECT count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM documents")
def a1(t):
    return t.documents.agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"))


@query("a2_null_audit", "SELECT count(*) AS n, count(*) FILTER (quality IS NULL) AS unlabelled, min(d.doc_id) AS lo, max(d.doc_id) AS hi FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def a2(t):
    return t.documents.join(t.labels, "doc_id", "left").agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))


@query("a3_feed_status", "SELECT lang AS domain, count(*) AS n, coalesce(sum(n_chars), 0)::BIGINT AS sections FROM documents GROUP BY 1 ORDER BY n DESC, domain")
def a3(t):
    return t.documents.groupBy(F.col("lang").alias("domain")).agg(F.count("*").alias("n"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("sections")).orderBy(F.desc("n"), "domain")


_DOMAIN = "CASE " + " ".join(f"WHEN lower(slug) IN ({', '.join(map(repr, slugs))}) THEN '{d}'" for d, slugs in U.DOMAIN_SLUGS.items()) + " ELSE 'allgemein' END"
_REGISTRY = tuple(slug for slugs in U.DOMAIN_SLUGS.values() for slug in slugs)
_CONTENTS = f"SELECT CASE WHEN p_partkey % 4 = 0 THEN 'law' || p_partkey ELSE {sql_list(_REGISTRY)}[p_partkey % 20 + 1] END AS slug FROM part"


@query(
    "a4_toc_dry_run",
    f"WITH toc AS ({_CONTENTS}) SELECT 'domain' AS kind, {_DOMAIN} AS name, count(*) AS n FROM toc GROUP BY 1, 2 UNION ALL SELECT 'missing', slug, NULL FROM (SELECT unnest({sql_list(_REGISTRY)}) AS slug) WHERE slug NOT IN (SELECT slug FROM toc)",
)
def a4(t):
    """Statutes of a table of contents by domain, and which of the registry it lacks."""
    k = F.col("p_partkey")
    contents = t.part.select(F.when(k % 4 == 0, F.concat(F.lit("law"), k)).otherwise(phrase(_REGISTRY[:20], k)).alias("slug"))
    registry = t.spark.createDataFrame([(s,) for s in _REGISTRY], "slug string")
    counted, missing = A.domains_of_contents(contents, registry, U.statute_domain(F.col("slug")))
    return counted.select(F.lit("domain").alias("kind"), F.col("domain").alias("name"), "n").unionByName(missing.select(F.lit("missing").alias("kind"), F.col("slug").alias("name"), F.lit(None).cast("bigint").alias("n")))


RANKS = "SELECT l_orderkey AS qid, l_returnflag AS task, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber END AS rank FROM lineitem"


def _ranks(t):
    return t.lineitem.select(F.col("l_orderkey").alias("qid"), F.col("l_returnflag").alias("task"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber")).alias("rank"))


@query("a5_recall_mrr", f"SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM ({RANKS})")
def a5(t):
    return E.recall(_ranks(t), "rank", [1, 5])


@query("a6_bucketed_recall", f"SELECT CASE WHEN GROUPING(task) = 0 THEN 'task' ELSE 'half' END AS axis, coalesce(task, half) AS bucket, count(*) AS n, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5 FROM (SELECT *, CASE WHEN qid % 2 = 0 THEN 'even' ELSE 'odd' END AS half FROM ({RANKS})) GROUP BY GROUPING SETS ((task), (half))")
def a6(t):
    half = F.when(F.col("qid") % 2 == 0, "even").otherwise("odd")
    return E.bucketed_recall(_ranks(t).withColumn("half", half), "rank", ["task", "half"], 5)


@query("a7_failure_categories", f"SELECT label, count(*) AS n FROM (SELECT unnest([CASE WHEN rank IS NULL THEN 'absent' END, CASE WHEN rank > 5 THEN 'deep' END, CASE WHEN task = 'R' THEN 'returned' END]) AS label FROM ({RANKS}) WHERE rank IS NULL OR rank > 5) WHERE label IS NOT NULL GROUP BY 1")
def a7(t):
    return E.failure_labels(_ranks(t), "rank", 5, {"absent": F.col("rank").isNull(), "deep": F.col("rank") > 5, "returned": F.col("task") == "R"})


@query(
    "a8_corpus_stats",
    """SELECT lang, n, mean, median, CASE WHEN n <= 10 THEN longest ELSE floor(lo + (hi - lo) * frac + 0.000001) END AS p90, longest, round(short_rate, 6) AS short_rate FROM (
      SELECT lang, count(*) AS n, floor(avg(n_chars))::BIGINT AS mean, floor(median(n_chars))::BIGINT AS median, max(n_chars) AS longest, avg(CASE WHEN n_chars < 200 THEN 1.0 ELSE 0 END) AS short_rate,
             list_sort(list(n_chars))[floor(0.9 * (count(*) + 1))::BIGINT] AS lo, coalesce(list_sort(list(n_chars))[floor(0.9 * (count(*) + 1))::BIGINT + 1], max(n_chars)) AS hi, 0.9 * (count(*) + 1) - floor(0.9 * (count(*) + 1)) AS frac
      FROM documents GROUP BY lang)""",
)
def a8(t):
    return A.corpus_stats(t.documents, "lang", "n_chars", {"short": F.col("n_chars") < 200})


@query("a9_internal_dedup_rate", "SELECT source, round(1 - count(DISTINCT substr(sha256(substr(text, 1, 500)), 1, 16)) / count(*), 6) AS dup_rate FROM documents GROUP BY 1")
def a9(t):
    h = F.substring(F.sha2(F.substring("text", 1, 500), 256), 1, 16)
    return t.documents.groupBy("source").agg(F.round(1 - F.countDistinct(h) / F.count("*"), 6).alias("dup_rate"))


CITES = ("nach § 14 Abs. 2 und Art. 5", "siehe Nr. 7, Ziffer 3.2", "§§ 99 gilt, Klausel ab", "ohne alles hier", "Artikel 12 BauGB")
_REFS = "list_concat(list_transform(regexp_extract_all(a, '(?i)§{1,2}\\s*(\\d+[a-z]?)', 1), lambda x: '§ ' || x), list_transform(regexp_extract_all(a, '(?i)\\bArt(?:ikel|\\.)\\s*(\\d+[a-z]?)', 1), lambda x: 'Art ' || x), regexp_extract_all(a, '(?i)(?:Klausel|Nr\\.|Nummer|Ziffer|Ziff\\.)\\s+([A-Za-z]{1,3}|\\d+(?:\\.\\d+)?)', 1))"
_LONG = lambda x: f"list_distinct(list_filter(string_split_regex(lower({x}), '[^A-Za-zäöüÄÖÜß\\d]+'), lambda w: length(w) >= 4 AND NOT regexp_matches(w, '^\\d+$')))"


@query(
    "a10_f45_grounding_audit",
    f"""WITH given AS (
  SELECT ['qa', 'summarize', 'explain', 'draft'][turn % 4 + 1] AS task, {sql_phrase(CITES, "turn")} || ' ' || text AS a, {sql_phrase(CITES, "turn + conv_id")} || ' ' || text AS b FROM conversations
), told AS (
  SELECT task, len({_REFS}) AS ref_total, len(list_filter({_REFS}, lambda r: contains(replace(lower(b), ' ', ''), replace(lower(r), ' ', '')))) AS ref_found,
         round(CASE WHEN len({_LONG("a")}) > 0 THEN len(list_intersect({_LONG("a")}, {_LONG("b")})) / len({_LONG("a")}) ELSE 0 END, 3) AS word_overlap FROM given
)
SELECT task, count(*) AS n, sum(ref_total)::BIGINT AS ref_total, sum(ref_found)::BIGINT AS ref_found, round(avg(word_overlap), 3) AS avg_word_overlap,
  round(100 * count(*) FILTER (word_overlap < 0.2 AND task NOT IN ('summarize', 'explain')) / count(*), 2) AS low_overlap_pct, CASE WHEN sum(ref_total) > 0 THEN round(100 * sum(ref_found) / sum(ref_total), 2) END AS cited_pct
FROM told GROUP BY task""",
)
def a10(t):
    """Answers that cite, and passages of the same text that hold some of it."""
    turn, conv = F.col("turn"), F.col("conv_id")
    samples = t.conversations.select(phrase(("qa", "summarize", "explain", "draft"), turn).alias("task"), F.concat(phrase(CITES, turn), F.lit(" "), "text").alias("a"), F.concat(phrase(CITES, turn + conv), F.lit(" "), "text").alias("b"))
    return A.grounding_audit(samples, "task", "a", "b")


@query(
    "a11_group_facts",
    """SELECT p_brand AS park, count(*) AS n, round(sum(p_retailprice) / 1000, 4) AS mw, list_sort(list(DISTINCT p_size)) AS models,
              (SELECT p_type FROM (SELECT p_type, count(*) AS k, min(p_partkey) AS first FROM part q WHERE q.p_brand = p.p_brand GROUP BY 1) ORDER BY k DESC, first LIMIT 1) AS kind,
              arg_min(p_name, p_partkey) AS owner FROM part p GROUP BY p_brand""",
)
def a11(t):
    """The mode takes the value seen first among the commonest; only counts are shuffled for it."""
    kinds = t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("k"), F.min("p_partkey").alias("first"))
    mode = kinds.groupBy("p_brand").agg(F.max_by("p_type", F.struct("k", -F.col("first"))).alias("kind"))
    facts = t.part.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice") / 1000, 4).alias("mw"), F.array_sort(F.collect_set("p_size")).alias("models"), F.min_by("p_name", "p_partkey").alias("owner"))
    return facts.join(mode, "p_brand").select(F.col("p_brand").alias("park"), "n", "mw", "models", "kind", "owner")


@query(
    "a12_validation_report",
    """WITH parcels AS (
  SELECT CASE WHEN l_linenumber = 7 THEN '' ELSE (l_orderkey // 2)::VARCHAR || '/' || l_linenumber END AS id, ['secured', 'not_secured', 'uncertain', 'other'][l_suppkey % 4 + 1] AS class,
    CASE l_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN [[50.0, 9.0], [51.0, (l_partkey % 20)::DOUBLE]] ELSE [[48.0 + l_quantity / 5, 10.0]] END AS ring FROM lineitem
), bad AS (
  SELECT *, ring IS NULL OR len(list_filter(ring, lambda p: NOT (p[1] BETWEEN 47.0 AND 55.1 AND p[2] BETWEEN 5.5 AND 15.1))) > 0 AS wrong FROM parcels
)
SELECT count(*) AS total, count(*) FILTER (class = 'secured') AS secured, count(*) FILTER (class = 'not_secured') AS not_secured, count(*) FILTER (class = 'uncertain') AS uncertain, count(*) FILTER (class = 'other') AS unclassified,
  count(*) FILTER (id <> '') - count(DISTINCT id) FILTER (id <> '') AS duplicates, (SELECT count(*) FROM (SELECT id FROM parcels WHERE id <> '' GROUP BY id HAVING count(DISTINCT class) > 1)) AS conflicts,
  count(*) FILTER (wrong) AS geometry_errors, round(count(*) FILTER (class = 'secured') / count(*), 4) AS coverage FROM bad""",
)
def a12(t):
    """Rows of orders as parcels, some of them twice, in other classes, without a name or out of the country."""
    part = F.col("l_partkey")
    ring = F.when(part % 3 == 1, F.array(F.array(F.lit(50.0), F.lit(9.0)), F.array(F.lit(51.0), (part % 20).cast("double")))).when(part % 3 == 2, F.array(F.array(F.lit(48.0) + F.col("l_quantity") / 5, F.lit(10.0))))
    key = F.when(F.col("l_linenumber") == 7, "").otherwise(F.concat(F.expr("l_orderkey div 2"), F.lit("/"), "l_linenumber"))
    return A.parcel_validation(t.lineitem.select(key.alias("id"), phrase(("secured", "not_secured", "uncertain", "other"), F.col("l_suppkey")).alias("class"), ring.alias("ring")))


@query("a13_blind_tally", "SELECT CASE choice WHEN 2 THEN 'tie' ELSE CASE WHEN (choice = 0) = swapped THEN 'b' ELSE 'a' END END AS winner, count(*) AS n FROM (SELECT l_linenumber % 3 AS choice, l_orderkey % 2 = 0 AS swapped FROM lineitem) GROUP BY 1")
def a13(t):
    votes = t.lineitem.select((F.col("l_linenumber") % 3).alias("choice"), (F.col("l_orderkey") % 2 == 0).alias("swapped"))
    winner = F.when(F.col("choice") == 2, "tie").when((F.col("choice") == 0) == F.col("swapped"), "b").otherwise("a")
    return votes.groupBy(winner.alias("winner")).agg(F.count("*").alias("n"))


@query(
    "a14_probe_summary",
    """WITH probes AS (
  SELECT source AS category, lang AS language, text AS base, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, 'e', 'é') ELSE substr(text, 1, 50) END AS tuned FROM documents
)
SELECT category, count(*) AS n, count(*) FILTER (base = tuned) AS equal, round(avg(length(base)), 4) AS mean_base, round(avg(length(tuned)), 4) AS mean_tuned,
  round(avg(CASE WHEN language = 'de' THEN length(regexp_replace(tuned, '[^\\x00-\\x7F]', '', 'g')) / greatest(length(tuned), 1) - length(regexp_replace(base, '[^\\x00-\\x7F]', '', 'g')) / greatest(length(base), 1) END), 6) AS de_drift
FROM probes GROUP BY 1""",
)
def a14(t):
    k = F.col("doc_id") % 3
    tuned = F.when(k == 0, F.col("text")).when(k == 1, F.replace("text", F.lit("e"), F.lit("é"))).otherwise(F.substring("text", 1, 50))
    return A.probe_summary(t.documents.select(F.col("source").alias("category"), F.col("lang").alias("language"), F.col("text").alias("base"), tuned.alias("tuned")))


@query("a15_stratified_split", "SELECT doc_id, lang, rn <= greatest(1, floor(0.05 * n)) AS val FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)")
def a15(t):
    return E.stratified_split(t.documents.select("doc_id", "lang"), "lang", "doc_id", share=0.05, seed=7)


@query("a16_duration_estimate", "SELECT coalesce(list_sort(list(mins))[len(list(mins)) // 2 + 1], 2 + 2 * 4)::DOUBLE AS minutes FROM (SELECT l_quantity AS mins FROM lineitem WHERE abs(l_linenumber - 4) <= 2 ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 30)")
def a16(t):
    last = t.lineitem.where(F.abs(F.col("l_linenumber") - 4) <= 2).orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber").limit(30)
    middle = F.expr("try_element_at(sort_array(mins), int(size(mins) div 2 + 1))")
    return last.agg(F.collect_list("l_quantity").alias("mins")).select(F.coalesce(middle, F.lit(10.0)).alias("minutes"))


A17 = """WITH lines AS (
  SELECT l_orderkey, sum(round(l_extendedprice * 100)::BIGINT) AS cents FROM lineitem GROUP BY 1
), stated AS (
  SELECT o_orderkey AS k, cents / 100 AS net, floor(cents * CASE WHEN o_orderkey % 3 = 0 THEN 0.16 ELSE 0.19 END::DOUBLE + 0.5) / 100 AS vat, o_totalprice AS gross
  FROM orders JOIN lines ON o_orderkey = l_orderkey
), checks AS (
  SELECT k, 'sum_mismatch' AS kind, gross AS stated, net AS computed FROM stated
  UNION ALL
  SELECT k, CASE WHEN least(abs(vat / net - 0.19), abs(vat / net - 0.07)) > 0.005 THEN 'vat_mismatch' ELSE 'sum_mismatch' END, gross, round(net + vat, 2) FROM stated
), graded AS (
  SELECT *, round(stated - computed, 2) AS delta FROM checks
), banded AS (
  SELECT *, greatest(CASE WHEN abs(delta) > 100 THEN 3 WHEN abs(delta) > 5 THEN 2 WHEN abs(delta) > 0.5 THEN 1 ELSE 0 END,
    CASE WHEN abs(delta) / stated > 0.01 THEN 3 WHEN abs(delta) / stated > 0.005 THEN 2 WHEN abs(delta) / stated > 0.001 THEN 1 ELSE 0 END) AS band FROM graded
)
SELECT k AS "table", kind, stated, computed, delta, ['info', 'low', 'medium', 'high'][band + 1] AS severity FROM banded WHERE band > 0"""


@query("a17_table_reconciliation", A17)
def a17(t):
    """Invoices written as tables of German amounts: positions, net, tax and gross."""
    german = lambda x: F.concat(F.translate(F.format_number(x, 2), ",.", ".,"), F.lit(" €"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("table"), F.col("l_linenumber").alias("place"), F.array(F.concat(F.lit("Posten "), F.col("l_linenumber")), german("l_extendedprice")).alias("cells"))
    net = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"))
    sums = t.orders.join(net, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("net", F.col("cents") / 100).withColumn("vat", F.floor(F.col("cents") * F.when(F.col("o_orderkey") % 3 == 0, 0.16).otherwise(0.19) + 0.5) / 100)
    ends = [(F.lit("Netto"), "net"), (F.lit("zzgl. USt"), "vat"), (F.lit("Gesamt brutto"), "o_totalprice")]
    below = sums.select(F.col("o_orderkey").alias("table"), F.posexplode(F.array(*[F.array(label, german(c)) for label, c in ends])).alias("place", "cells"))
    return TB.findings(TB.totals(lines.unionByName(below.withColumn("place", F.col("place") + 100))))


_STATUS = ("queued", "processing", "done", "failed", "processing")


@query(
    "a18_state_counts",
    f"""WITH docs AS (SELECT user_id, {sql_phrase(_STATUS, "event_id")} AS status, event_id % 7 AS pages_done, CASE WHEN event_id % 4 <> 0 THEN event_id % 7 + 3 END AS pages_total FROM events)
SELECT user_id, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'done') AS done,
  coalesce(sum(pages_done) FILTER (status IN ('queued', 'processing')), 0)::BIGINT AS pages_done, coalesce(sum(coalesce(pages_total, 0)) FILTER (status IN ('queued', 'processing')), 0)::BIGINT AS pages_total FROM docs GROUP BY 1""",
)
def a18(t):
    e = F.col("event_id")
    return X.progress(t.events.select("user_id", phrase(_STATUS, e).alias("status"), (e % 7).alias("pages_done"), F.when(e % 4 != 0, e % 7 + 3).alias("pages_total")), "user_id")


@query(
    "a19_schema_audit",
    """WITH flat AS (
  SELECT unnest(['event_type', 'props', 'props.k', 'tags', 'note', 'none']) AS path, unnest(['str', 'dict', 'int', 'list', 'str', 'null']) AS type,
    unnest([false, false, false, event_id % 3 = 0, event_id % 5 = 0, true]) AS empty, unnest([event_type, NULL, NULL, NULL, CASE WHEN event_id % 5 = 0 THEN '' ELSE repeat('x', (event_id % 90)::INT) END, NULL]) AS text,
    unnest([true, true, true, true, true, event_id % 2 = 0]) AS there
  FROM events
), kept AS (
  SELECT * FROM flat WHERE there
), sized AS (
  SELECT path, list_sort(list(length(text))) AS lens FROM kept WHERE text IS NOT NULL GROUP BY 1
), vals AS (
  SELECT path, count(*) AS n_values, list_sum(list_slice(list_reverse_sort(list(k)), 1, 10)) AS top FROM (SELECT path, text, count(*) AS k FROM kept WHERE length(text) < 50 GROUP BY 1, 2) GROUP BY 1
)
SELECT c.*, lens[len(lens) // 2 + 1] AS p50, lens[floor(len(lens) * 0.95)::BIGINT + 1] AS p95, lens[len(lens)] AS longest, coalesce(n_values, 0) AS n_values, coalesce(n_values BETWEEN 3 AND 30 AND top >= present * 0.9, false) AS enum
FROM (SELECT path, count(*) AS present, count(*) FILTER (empty) AS empty, any_value(type) || ':' || count(*) AS types FROM kept GROUP BY 1) c LEFT JOIN sized USING (path) LEFT JOIN vals USING (path)""",
)
def a19(t):
    """Events as JSON with a nested object, a list that may be empty, and values that may be null or missing."""
    e = F.col("event_id")
    fields = F.concat_ws(
        ",", F.concat(F.lit('"event_type":"'), "event_type", F.lit('"')), F.concat(F.lit('"props":'), "props"),
        F.concat(F.lit('"tags":['), F.when(e % 3 != 0, F.concat(F.lit('"t'), e % 4, F.lit('","u"'))).otherwise(""), F.lit("]")),
        F.concat(F.lit('"note":"'), F.when(e % 5 != 0, F.repeat(F.lit("x"), (e % 90).cast("int"))).otherwise(""), F.lit('"')), F.when(e % 2 == 0, F.lit('"none":null')),
    )
    return A.schema_audit(t.events.select(F.concat(F.lit("{"), fields, F.lit("}")).alias("json")), "json")


@query("a20_manifest_histogram", "SELECT source, CASE WHEN n_chars < 1000 THEN 'small' WHEN n_chars < 5000 THEN 'medium' ELSE 'large' END AS size, count(*) AS n FROM documents GROUP BY 1, 2")
def a20(t):
    size = F.when(F.col("n_chars") < 1000, "small").when(F.col("n_chars") < 5000, "medium").otherwise("large")
    return t.documents.groupBy("source", size.alias("size")).agg(F.count("*").alias("n"))


_BOUNDS = (5, 10, 25, 50, 75, 100)
_CUMULATED = ", ".join(f"count(*) FILTER (value <= {b}) AS c{i}" for i, b in enumerate(_BOUNDS))


def _quantile(q: float) -> str:
    cases = " ".join(
        f"WHEN c{i} >= {q} * total THEN CASE WHEN c{i} - {f'c{i - 1}' if i else 0} > 0 THEN {_BOUNDS[i - 1] if i else 0} + {b - (_BOUNDS[i - 1] if i else 0)} * ({q} * total - {f'c{i - 1}' if i else 0}) / (c{i} - {f'c{i - 1}' if i else 0}) ELSE {_BOUNDS[i - 1] if i else 0} END" for i, b in enumerate(_BOUNDS)
    )
    return f"round(CASE WHEN total > 0 THEN CASE {cases} ELSE {_BOUNDS[-1]} END END, 6) AS p{round(100 * q)}"


@query("a21_rate_windows", f"SELECT start, n, error_rate, {', '.join(map(_quantile, (0.5, 0.95, 0.99)))} FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(count(*) FILTER (event_type = 'error') / greatest(count(*), 1e-9), 6) AS error_rate, count(value) AS total, {_CUMULATED} FROM events GROUP BY 1)")
def a21(t):
    return A.rate_panels(t.events, "ts", "value", "1 hour", _BOUNDS, F.col("event_type") == "error")


@query("a22_first_seen_distinct", "SELECT user_id, arg_min(event_id, ts) AS event_id FROM (SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1) GROUP BY 1")
def a22(t):
    return t.events.groupBy("user_id").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("event_id"))


@query("a23_latest_upsert", "SELECT user_id, event_type, arg_max(value, event_id) AS value, min(event_id) AS id FROM events GROUP BY 1, 2")
def a23(t):
    return t.events.groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.min("event_id").alias("id"))


@query("a24_json_array_lengths", "SELECT event_id, coalesce(json_array_length(doc, '$.f'), 0) + coalesce(json_array_length(doc, '$.g'), 0) AS n FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{\"f\": [1, 2, 3]}' ELSE '{\"f\": [1], \"g\": [4, 5]}' END AS doc FROM events)")
def a24(t):
    doc = F.when(F.col("event_id") % 3 == 0, '{"f": [1, 2, 3]}').otherwise('{"f": [1], "g": [4, 5]}')
    size = lambda path: F.coalesce(F.json_array_length(F.get_json_object(doc, path)), F.lit(0))
    return t.events.select("event_id", (size("$.f") + size("$.g")).cast("bigint").alias("n"))


@query(
    "a25_next_in_group",
    """WITH existing AS (
  SELECT conv_id AS session, turn + 1 AS doc_index, 'f' || turn || '.pdf' AS filename, CASE WHEN turn % 3 = 0 THEN 'failed' ELSE 'done' END AS status FROM conversations WHERE turn < 5
), new AS (
  SELECT DISTINCT session, filename, min(pos) OVER (PARTITION BY session, filename) AS pos FROM (
    SELECT conv_id AS session, 'f' || turn * 2 || '.pdf' AS filename, 100 - turn AS pos FROM conversations UNION ALL SELECT conv_id + 100000, 'a.pdf', turn FROM conversations)
), met AS (
  SELECT n.*, e.doc_index, e.status FROM new n LEFT JOIN (SELECT session, filename, max(doc_index) AS doc_index, any_value(status) AS status FROM existing GROUP BY 1, 2) e USING (session, filename)
)
SELECT session, filename, doc_index::BIGINT AS doc_index, CASE WHEN status = 'failed' THEN 'retry' ELSE 'existing' END AS outcome FROM met WHERE status IS NOT NULL
UNION ALL
SELECT session, filename, coalesce((SELECT max(doc_index) FROM existing e WHERE e.session = met.session), 0) + row_number() OVER (PARTITION BY session ORDER BY pos, filename), 'added' FROM met WHERE status IS NULL""",
)
def a25(t):
    """Files added to sessions: some are there, some failed before, some come with folders or twice."""
    c = t.conversations.select(F.col("conv_id").alias("session"), "turn")
    name = lambda n: F.concat(F.lit("f"), n, F.lit(".pdf"))
    old = c.where("turn < 5").distinct().select("session", (F.col("turn") + 1).alias("doc_index"), name(F.col("turn")).alias("filename"), F.when(F.col("turn") % 3 == 0, "failed").otherwise("done").alias("status"))
    new = c.select("session", F.concat(F.lit("x/y/"), name(F.col("turn") * 2)).alias("filename"), (F.lit(100) - F.col("turn")).alias("at"))
    return X.add_documents(old, new.unionByName(c.select((F.col("session") + 100_000).alias("session"), F.lit("a.pdf").alias("filename"), F.col("turn").alias("at"))))
