"""Queries over sources and streams (2.1, 2.12). A stream is run to its end over the table and its result read back."""

from __future__ import annotations

import uuid

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators import writes as W
from corpusmill.plans.registry import SQL, phrase, query, sql_phrase
from corpusmill.session import shared_folder
from corpusmill.sources import readers as S
from corpusmill.sources import remote as RM
from corpusmill.sources import sinks as K
from corpusmill.streaming import state as ST
from corpusmill.streaming import streams as X


PATHS = (
    "de/gesetzes/a.PDF", "de/TA Laerm.docx", "en/english/x.txt", "DD Reports/r.doc", "VDRs/x/y.zip", "Libary/b.jsonl", "rss/1.json", "legal_data/hf_cases/2.json", "legal_data/openlegaldata_dump.json", "legal_data/gerdalir/1.jsonl",
    "legal_data/german_ler.parquet", "legal_data/multilegalpile/de.jsonl", "misc/noext", "misc/.hidden", "a.b/c.htm", "x/HF_Cases/y.pdf",
)
_ROUTE = " ".join(f"WHEN starts_with(path, '{p}') THEN '{lang}/{kind}'" for p, lang, kind in S.ROUTES)
_NAMED = " ".join(f"WHEN contains(lower(path), '{n}') THEN '{n}'" for n in S.NAMED_CONVERTERS)
_EXT = " ".join(f"WHEN regexp_extract(lower(path), '[^/.][^/]*?(\\.[^./]*)$', 1) IN ({', '.join(map(repr, e))}) THEN '{c}'" for c, e in S.EXTENSIONS.items())


@query("s2_s3_routes", f"SELECT page_id, CASE {_ROUTE} ELSE 'de/document' END AS route, CASE {_NAMED} {_EXT} ELSE 'unsupported' END AS kind FROM (SELECT page_id, {sql_phrase(PATHS, 'page_id')} AS path FROM pages)")
def s2(t):
    path = phrase(PATHS, F.col("page_id"))
    route = S.language_and_type(path)
    return t.pages.select("page_id", F.concat(route["language"], F.lit("/"), route["doc_type"]).alias("route"), S.source_type(path).alias("kind"))


@query(
    "s8_case_dumps",
    """SELECT doc_id AS dump, pos, md5(trim(regexp_replace(replace(text, '[Picture]', ''), '\\n{3,}', chr(10) || chr(10), 'g'))) AS h, doc_id || '-' || pos AS case_id, CASE WHEN pos = 0 THEN 'BGH' END AS court_name
FROM (SELECT doc_id, unnest(CASE WHEN doc_id % 3 = 2 THEN [0] ELSE [0, 1] END) AS pos, regexp_replace(text, '[ $-]+', '_', 'g') AS text FROM documents) WHERE length(trim(regexp_replace(replace(text, '[Picture]', ''), '\\n{3,}', chr(10) || chr(10), 'g'))) >= 20""",
)
def s8(t):
    """Dumps as lists, under results, or a single case; texts plain or in Markdown."""
    text = F.regexp_replace("text", "[ $-]+", "_")
    case = lambda k, field: F.struct(F.concat("doc_id", F.lit(f"-{k}")).alias("id"), text.alias(field), F.struct(F.lit("BGH").alias("name")).alias("court") if k == 0 else F.lit("none").alias("court"))
    a, b = F.to_json(case(0, "markdown_content")), F.to_json(case(1, "text"))
    both = F.concat(F.lit("["), a, F.lit(", "), b, F.lit("]"))
    shape = F.col("doc_id") % 3
    body = F.when(shape == 0, F.concat(F.lit("junk"), F.lit('{"count": 2, "results": '), both, F.lit("}"))).when(shape == 1, F.concat(F.lit('{"results": '), both, F.lit("}"))).otherwise(a)
    dumps = t.documents.select(F.col("doc_id").alias("dump"), body.alias("body"))
    return S.case_records(dumps, "body").select("dump", "pos", F.md5("text").alias("h"), "case_id", "court_name")


@query(
    "s9_s10_line_records",
    """WITH lines AS (
  SELECT conv_id, turn, conv_id % 4 AS k, regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g') AS body, ['de', 'GERMAN', 'en', ''][turn % 4 + 1] AS language FROM conversations WHERE (conv_id + turn) % 7 <> 0
), read AS (
  SELECT conv_id, turn, ['multilegalpile', 'gerdalir', 'german_ler', 'generic'][k + 1] AS kind,
    CASE k WHEN 0 THEN CASE WHEN language = '' OR lower(language) IN ('de', 'german', 'deu') THEN trim(body) END WHEN 1 THEN trim(body) WHEN 2 THEN trim(body) || ', (x).' ELSE CASE WHEN length(trim(body)) > 20 THEN trim(body) END END AS text,
    CASE k WHEN 1 THEN 'T' || turn WHEN 2 THEN 'NER_Sentence' ELSE 'Content' END AS section FROM lines
)
SELECT conv_id, turn, kind, md5(text) AS h, section FROM read WHERE length(text) >= 20""",
)
def s9(t):
    """Lines of four collections; every seventh is broken."""
    body = F.regexp_replace("text", "[^A-Za-z0-9]+", " ")
    parts = []
    for k, kind in enumerate(("multilegalpile", "gerdalir", "german_ler", "generic")):
        given = {
            "multilegalpile": F.struct(body.alias("text"), phrase(("de", "GERMAN", "en", ""), F.col("turn")).alias("language")),
            "gerdalir": F.struct(body.alias("text"), F.concat(F.lit("T"), "turn").alias("title")),
            "german_ler": F.struct(F.concat(F.split(F.trim(body), " "), F.array(*map(F.lit, (",", "(", "x", ")", ".")))).alias("tokens")),
            "generic": F.struct(F.lit("short").alias("text"), body.alias("body")),
        }[kind]
        line = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.left(F.to_json(given), F.lit(9))).otherwise(F.to_json(given))
        mine = t.conversations.where(F.col("conv_id") % 4 == k).select("conv_id", "turn", line.alias("line"))
        parts.append(S.line_records(mine, "line", kind).select("conv_id", "turn", F.lit(kind).alias("kind"), F.md5("text").alias("h"), "section"))
    return reduce(DataFrame.unionByName, parts)


@query("s4_s5_json_bodies", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 2 AS lines FROM events")
def s4(t):
    content = F.concat(F.lit("\x01header\n"), "props")
    lines = S.json_lines(F.concat(content, F.lit("\n  "), "props", F.lit("\nnot json")))
    return t.events.select("event_id", F.get_json_object(S.json_body(content), "$.k").cast("bigint").alias("k"), F.size(lines).alias("lines"))


@query("s7_s10_first_text", "SELECT doc_id, CASE WHEN length(trim(lang)) > 20 THEN lang WHEN length(trim(text)) > 20 THEN text END IS NULL AS dropped FROM documents")
def s7(t):
    return t.documents.select("doc_id", S.first_text(F.col("lang"), F.col("text")).isNull().alias("dropped"))


@query("s12_markdown_tables", "SELECT n_nationkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_nationkey || ' | ' || n_name || ' |' AS md FROM nation")
def s12(t):
    rows = F.array(F.array(F.lit("key"), F.lit("name")), F.array(F.col("n_nationkey").cast("string"), F.col("n_name")))
    return t.nation.select("n_nationkey", S.markdown_table(rows).alias("md"))


@query("s14_law_sections", "SELECT n_nationkey, 'L' || n_nationkey AS law, '§ ' || k AS enbez FROM nation, (SELECT unnest([1, 2]) AS k)")
def s14(t):
    norm = lambda k: F.concat(F.lit("<norm><metadaten>"), F.when(F.lit(k == 1), F.concat(F.lit("<jurabk>L"), F.col("n_nationkey").cast("string"), F.lit("</jurabk>"))).otherwise(F.lit("")), F.lit(f"<enbez>§ {k}</enbez></metadaten><textdaten><text><Content>Text</Content></text></textdaten></norm>"))
    xml = F.concat(F.lit("<law>"), norm(1), norm(2), F.lit("<norm><metadaten></metadaten></norm></law>"))
    return S.law_sections(t.nation.select("n_nationkey", xml.alias("xml")), "xml").select("n_nationkey", "law", "enbez")


@query("s17_parcel_features", "SELECT n_nationkey, 'F' || n_nationkey AS number, 4::BIGINT AS corners, 50.0::DOUBLE AS lat FROM nation")
def s17(t):
    feature = F.concat(F.lit('{"type": "Feature", "properties": {"number": "F'), F.col("n_nationkey").cast("string"), F.lit('"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[9, 50], [9, 51], [8, 51]]], [[[9, 50], [9, 51], [8, 51], [8, 50]]]]}}'))
    out = S.parcel_feature(t.nation.select("n_nationkey", feature.alias("f")), "f")
    return out.select("n_nationkey", "number", F.size("ring").cast("bigint").alias("corners"), F.col("ring")[0][0].alias("lat"))


@query("s15_contents", "SELECT n_nationkey, 0 AS pos, 'Gesetz ' || n_name AS title, 'g' || n_nationkey AS slug, 'https://x.example/g' || n_nationkey || '/xml.zip' AS url FROM nation UNION ALL SELECT n_nationkey, 2, '', 'h', 'https://x.example/h/xml.zip' FROM nation")
def s15(t):
    item = lambda title, link: F.concat(F.lit("<item>"), title, F.lit("<link>"), link, F.lit("</link></item>"))
    key = F.col("n_nationkey").cast("string")
    first = item(F.concat(F.lit("<title>Gesetz "), "n_name", F.lit("</title>")), F.concat(F.lit("http://x.example/g"), key, F.lit("/xml.zip")))
    xml = F.concat(F.lit("<items>"), first, F.lit("<item><title>ohne</title></item>"), item(F.lit(""), F.lit("https://x.example/h/xml.zip/")), F.lit("</items>"))
    return S.contents(t.nation.select("n_nationkey", xml.alias("xml")), "xml").select("n_nationkey", "pos", "title", "slug", F.rtrim("url", F.lit("/")).alias("url"))


@query(
    "s18_parcels_of_gml",
    """SELECT o_orderkey, pos, CASE WHEN pos = 0 THEN (o_orderkey % 90)::VARCHAR || '/1' ELSE (o_orderkey % 7 + 1)::VARCHAR || '2' END AS number, CASE WHEN pos = 0 THEN o_totalprice ELSE 0 END AS area,
  CASE WHEN pos = 0 THEN 2 ELSE 0 END AS corners, CASE WHEN pos = 0 THEN (o_orderkey % 5)::DOUBLE END AS lng FROM (SELECT *, unnest([0, 1]) AS pos FROM orders)""",
)
def s18(t):
    """Answers with a parcel that has a label and one that has only a reference, under different prefixes."""
    k = F.col("o_orderkey")
    ring = F.concat(F.lit("<gml:posList> </gml:posList><gml:posList srsDimension='2'>50.5 9 x 51 "), (k % 5).cast("string"), F.lit(" 7</gml:posList>"))
    one = F.concat(F.lit("<cp:CadastralParcel gml:id='a'><cp:label>"), (k % 90).cast("string"), F.lit("/1</cp:label><cp:areaValue uom='m2'> "), F.col("o_totalprice").cast("string"), F.lit(" </cp:areaValue>"), ring, F.lit("</cp:CadastralParcel>"))
    two = F.concat(F.lit("<CadastralParcel><label> </label><nationalCadastralReference>DE-0312-000"), (k % 7 + 1).cast("string"), F.lit("2__</nationalCadastralReference><areaValue>?</areaValue></CadastralParcel>"))
    xml = F.concat(F.lit("<FeatureCollection>"), one, two, F.lit("</FeatureCollection>"))
    out = S.parcels_of_gml(t.orders.select("o_orderkey", xml.alias("xml")), "xml")
    return out.select("o_orderkey", "pos", "number", "area", F.size("ring").alias("corners"), F.get(F.get("ring", F.lit(1)), F.lit(1)).alias("lng"))


@query(
    "s11_document_tree",
    """WITH parts AS (
  SELECT conv_id, turn, role, trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')) AS body, turn % 5 AS kind FROM conversations
), shown AS (
  SELECT conv_id, turn, CASE kind WHEN 1 THEN 'Kapitel ' || turn WHEN 2 THEN '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || turn || ' | x |' WHEN 3 THEN 'k: ' || turn || '!!' ELSE body END AS text,
         CASE kind WHEN 1 THEN 'Kapitel ' || turn END AS header, CASE kind WHEN 2 THEN 'table' ELSE 'text' END AS type, kind FROM parts WHERE kind <> 4
), carried AS (
  SELECT *, coalesce(last_value(header IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 'General') AS section FROM shown
)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, text, section, CASE WHEN kind = 0 THEN turn END AS page_start, CASE WHEN kind = 0 THEN turn + 2 END AS page_end, type FROM carried WHERE length(text) >= 5""",
)
def s11_tree(t):
    """Conversations written as parsed documents: texts, headers, tables and pairs, every second part within two groups, and page footers."""
    body, turn = F.trim(F.regexp_replace("text", "[^A-Za-z0-9]+", " ")), F.col("turn")
    kind = turn % 5
    part = F.when(kind == 2, "tables").when(kind == 3, "key_value_items").otherwise("texts")
    cell = lambda c: F.struct(c.cast("string").alias("text"))
    row = lambda *cs: F.array(*map(cell, cs))
    item = F.struct(
        F.when(kind == 1, "section_header").when(kind == 4, "page_footer").otherwise("paragraph").alias("label"),
        F.when(kind == 1, F.concat(F.lit("Kapitel "), turn)).otherwise(body).alias("text"),
        F.when(kind == 2, F.struct(F.array(row(F.lit("a"), F.lit(" b")), row(turn, F.lit("x"))).alias("grid"))).alias("data"),
        F.when(kind == 3, cell(F.lit("k"))).alias("key"), F.when(kind == 3, cell(F.concat(turn, F.lit("!!")))).alias("value"),
        F.when(kind == 0, F.array(F.struct((turn + 2).alias("page_no")), F.struct(turn.alias("page_no")))).alias("prov"),
    )
    each = t.conversations.select("conv_id", "turn", part.alias("part"), item.alias("item"))
    each = each.withColumn("i", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn")) - 1)
    to = lambda ref: F.struct(ref.alias("$ref"))
    ref = to(F.concat(F.lit("#/"), "part", F.lit("/"), "i"))
    in_group = turn % 2 == 1
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("turn", c.alias("x"))))), lambda s: s["x"])
    group = F.row_number().over(Window.partitionBy("conv_id", in_group).orderBy("turn")) - 1
    each = each.withColumn("g", group).withColumn("ref", ref)
    outer, inner = F.struct(F.array(to(F.concat(F.lit("#/groups/"), F.col("g") * 2 + 1))).alias("children")), F.struct(F.array("ref").alias("children"))
    child = F.when(in_group, to(F.concat(F.lit("#/groups/"), F.col("g") * 2))).otherwise(F.col("ref"))
    lists = [ordered(F.when(F.col("part") == name, F.col("item"))).alias(name) for name in ("texts", "tables", "key_value_items")]
    groups = F.flatten(ordered(F.when(in_group, F.array(outer, inner)))).alias("groups")
    docs = each.groupBy("conv_id").agg(*lists, groups, F.struct(ordered(child).alias("children")).alias("body"))
    return S.document_tree(docs.select("conv_id", F.to_json(F.struct("texts", "tables", "key_value_items", "groups", "body")).alias("json")), "conv_id", "json")


@query("s11_html_segments_w3")
def s11(t):
    return t.pages.select("page_id", F.posexplode(S.html_segments(F.col("html"))).alias("pos", "s")).select("page_id", "pos", "s.*")


@query("s13_page_text_gate", "SELECT doc_id, CASE WHEN length(text) >= 40 AND length(regexp_replace(text, '[^\\p{L}\\p{N} \\t\\n\\x0B\\f\\r.,;:!?()§%/''\"-]', '', 'g')) / greatest(length(text), 1) >= 0.6 THEN 'embedded' ELSE 'ocr' END AS source FROM documents")
def s13(t):
    return t.documents.select("doc_id", S.page_text(F.col("text"), F.lit("x"))["source"].alias("source"))


@query(
    "x6_ingestion_states",
    """SELECT c_custkey AS key, CASE c_custkey % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'queued' ELSE 'processing' END AS state, CASE WHEN c_custkey % 4 = 1 THEN substr(repeat('e' || c_custkey, 200), 1, 500) END AS error,
  CASE c_custkey % 4 WHEN 0 THEN 9 WHEN 1 THEN 3 WHEN 2 THEN 0 ELSE 5 END::BIGINT AS pages_done, CASE WHEN c_custkey % 4 = 3 THEN 1 ELSE 0 END::BIGINT AS refused, c_custkey % 4 >= 2 AS enqueue FROM customer""",
)
def x6(t):
    """Customers as documents: done, failed, queued again after a failure, and one that was called done too early."""
    return W.ingestion(ingestion_events(t.customer))


def ingestion_events(customers):
    k = F.col("c_custkey")
    event = lambda n, state, pages=0: F.struct(F.lit(n).alias("ord"), F.lit(state).alias("state"), F.when(F.lit(state == "failed"), F.repeat(F.concat(F.lit("e"), k), F.lit(200))).alias("error"), F.lit(pages).alias("pages"))
    begun = (event(1, "queued"), event(2, "processing", 3))
    ways = (F.array(*begun, event(3, "done", 9)), F.array(*begun, event(3, "failed")), F.array(*begun, event(3, "failed"), event(4, "queued")), F.array(event(1, "queued"), event(2, "done", 7), event(3, "processing", 5)))
    mine = F.when(k % 4 == 0, ways[0]).when(k % 4 == 1, ways[1]).when(k % 4 == 2, ways[2]).otherwise(ways[3])
    return customers.select(k.alias("key"), F.inline(mine))


@query("x8_stale_uploads", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR")
def x8(t):
    return X.stale(t.events, "ts", F.lit("2024-01-20").cast("timestamp")).select("event_id")


@query("s25_file_sets", "SELECT CAST(k AS VARCHAR) AS stem, k % 2 = 0 AS pdf, k % 3 = 0 AS md, k % 5 = 0 AS json FROM (SELECT page_id AS k FROM pages) WHERE k % 2 = 0 OR k % 3 = 0 OR k % 5 = 0")
def s25(t):
    some = lambda n, ext: t.pages.where(F.col("page_id") % n == 0).select(F.concat(F.lit("b/x/"), F.col("page_id").cast("string"), F.lit(ext)).alias("path"))
    return S.file_sets(some(2, ".pdf"), some(3, ".md"), some(5, ".json"))


def _drained(t, stream):
    """Runs a stream over what is there. Its result, a row a window, is written to the shared folder batch by batch and read from there."""
    folder = f"{shared_folder(t.spark)}/streams/{uuid.uuid4().hex}"
    keep = lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/result")
    writer = stream.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    writer.start().awaitTermination()
    return t.spark.read.parquet(f"{folder}/result")


def _events(t):
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events.parquet*")


def _changes(t, stream, mode):
    """Runs a stream with state over what is there and returns what its batches gave."""
    folder = f"{shared_folder(t.spark)}/streams/{uuid.uuid4().hex}"
    keep = lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/result/batch={n}")
    with ST.rocksdb(t.spark):
        stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{folder}/result").drop("batch")


@query("x6_ingestion_stream", SQL["x6_ingestion_states"])
def x6_stream(t):
    """The same events as a stream; of each document its last row."""
    customers = t.spark.readStream.schema(t.customer.schema).parquet(f"{t.sf_dir}/customer.parquet*")
    events = ingestion_events(customers).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("ord")))
    return ST.latest(_changes(t, ST.ingestion(events), "update")).select("key", "state", "error", "pages_done", "refused", "enqueue")


@query("x9_cadence_stream", "SELECT session, unnest(range(3, n + 1, 3)) AS turns FROM (SELECT user_id AS session, count(*) AS n FROM events GROUP BY 1) WHERE n >= 3")
def x9_stream(t):
    """A row for every third event of a user."""
    return _changes(t, ST.cadence(_events(t).select(F.col("user_id").alias("session"))), "append").select("session", "turns")


@query(
    "x4_cache_stream",
    """WITH e AS (SELECT event_id % 50 AS key, ts, CASE WHEN event_id % 3 = 0 THEN 'v' || event_id END AS value, CASE WHEN event_id % 9 <> 0 THEN ts + INTERVAL 1 DAY END AS expires, event_id FROM events), f AS (
  SELECT key, ts, event_id, value, last_value(CASE WHEN value IS NOT NULL THEN {'v': value, 'x': expires} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, value IS NULL, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM e
) SELECT key, ts, CASE WHEN held.x > ts THEN held.v END AS value, coalesce(held.x > ts, false) AS hit FROM f WHERE value IS NULL""",
)
def x4_stream(t):
    """Every third event is an entry of its key, some without an expiry; the others are requests."""
    k = F.col("event_id")
    given = X.timed(_events(t)).select((k % 50).alias("key"), "ts", F.when(k % 3 == 0, F.concat(F.lit("v"), k)).alias("value"), F.when(k % 9 != 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expires"))
    return _changes(t, ST.expiring(given), "append").select("key", "ts", "value", "hit")


@query("x1_top_up", "SELECT event_type, count(*) AS n, max(event_id) AS mark FROM events GROUP BY 1")
def x1(t):
    """A table topped up by a stream, read by its ledger."""
    folder = f"{shared_folder(t.spark)}/top-up/{uuid.uuid4().hex}"
    table = X.TopUp(t.spark, f"{folder}/table", "event_id")
    table.run(_events(t).select("event_id", "event_type"), f"{folder}/state").awaitTermination()
    return table.rows("event_id bigint, event_type string").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("mark"))


@query("s19_law_store", "SELECT c_mktsegment AS slug, c_custkey AS seq, sha256(CASE WHEN c_mktsegment = 'BUILDING' THEN 'new ' ELSE '' END || c_name) AS sha256, CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END AS version FROM customer")
def s19(t):
    """Segments as laws, written twice; one of them has changed."""
    store = K.LawStore(t.spark, f"{shared_folder(t.spark)}/laws/{uuid.uuid4().hex}")
    text = lambda head: F.concat(F.when(F.col("c_mktsegment") == "BUILDING", head).otherwise(""), F.col("c_name"))
    given = lambda head: t.customer.select(F.col("c_mktsegment").alias("slug"), F.lit("x").alias("source"), F.col("c_custkey").alias("seq"), F.concat(F.lit("§ "), "c_custkey").alias("enbez"), F.lit(None).cast("string").alias("title"), text(head).alias("text"))
    store.write(given(""))
    store.write(given("new "))
    return store.sections().select("slug", "seq", "sha256", "version")


@query("s21_backup_and_restore", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'lost' END AS c_name FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def s21(t):
    """Customers of whom half are backed up; then names are lost and rows vanish."""
    path = f"{shared_folder(t.spark)}/backups/{uuid.uuid4().hex}"
    K.backup(t.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_name"), path)
    now = t.customer.where("c_custkey % 3 <> 0").select("c_custkey", F.lit("lost").alias("c_name"))
    return K.restore(now, path, ["c_custkey"], t.spark)


@query("s20_segments_once", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'first' ELSE 'second' END AS run FROM documents")
def s20(t):
    """Segments written in two runs; the second adds those that are not there yet."""
    path = f"{shared_folder(t.spark)}/segments/{uuid.uuid4().hex}"
    K.write_segments(t.documents.where("doc_id % 2 = 0").select("doc_id", F.lit("first").alias("run")), path, "doc_id")
    K.write_segments(t.documents.select("doc_id", F.lit("second").alias("run")), path, "doc_id")
    return t.spark.read.schema("doc_id bigint, run string").json(path)


@query("s22_portable_export", "SELECT o_orderkey, o_totalprice::DOUBLE AS o_totalprice, o_orderstatus FROM orders")
def s22(t):
    path, name = f"{shared_folder(t.spark)}/exports/{uuid.uuid4().hex}", f"orders_{uuid.uuid4().hex}"
    t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus").createOrReplaceTempView(name)
    K.export_tables(t.spark, [name], path)
    return t.spark.read.parquet(f"{path}/{name}")


@query("s23_audit_csv", "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, '[' || s_nationkey || ',' || s_suppkey || ']' AS keys FROM supplier")
def s23(t):
    path = f"{shared_folder(t.spark)}/audits/{uuid.uuid4().hex}"
    K.audit_csv(t.supplier.select("s_suppkey", "s_name", F.array("s_nationkey", "s_suppkey").alias("keys")), path, ["s_suppkey", "s_name", "keys"])
    return t.spark.read.option("header", "true").csv(path)


@query("s24_training_stats", "SELECT lang, count(*) FILTER (doc_id % 10 <> 0) AS train, count(*) FILTER (doc_id % 10 = 0) AS val, count(*) AS total FROM documents GROUP BY 1")
def s24(t):
    """The numbers that the training export writes beside its files."""
    path = f"{shared_folder(t.spark)}/training/{uuid.uuid4().hex}"
    K.train_val(t.documents.select("doc_id", "lang", "text", (F.col("doc_id") % 10 == 0).alias("val")), path, by="lang")
    return t.spark.read.schema("lang string, train bigint, val bigint, total bigint").json(f"{path}/stats")


@query("s16_answers_by_key", "SELECT c_custkey::VARCHAR AS key, '{\"key\": \"' || c_custkey || '\", \"found\": true}' AS answer FROM customer")
def s16(t):
    """A key table asked in the tasks; offline the answer is the stand-in's."""
    return RM.fetched(t.customer.select(F.col("c_custkey").alias("key")), "corpusmill.sources.remote:offline")


@query("x5_streaming_rates", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x5(t):
    return _drained(t, X.rates(_events(t), "1 day")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "x5_sliding_rates",
    """SELECT start, event_type, count(*) AS n, round(sum(value), 3) AS total
FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY 1, 2""",
)
def x5_sliding(t):
    """The same as a batch, in windows of an hour that begin every half."""
    return X.rates(t.events, "1 hour", "30 minutes").select("start", "event_type", "n", F.round("total", 3).alias("total"))


@query("x_sessions_extension", "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE >= ts THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY user_id, s")
def x_sessions(t):
    return X.sessions(t.events)
