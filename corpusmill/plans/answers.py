"""Queries over answer checks, findings and model interfaces (2.9, 2.10, 2.13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import guard as U
from corpusmill.functions import language as L
from corpusmill.functions import legal as G
from corpusmill.operators import findings as FN
from corpusmill.operators import models as O
from corpusmill.operators import retrieval as R
from corpusmill.plans.registry import phrase, query, sql_list, sql_phrase


#: Openings and endings of cells: defences, hedges and references in both languages.
CELLS = (
    "Die vorliegenden Kontextausschnitte enthalten keine Angaben", "Es gilt das Folgende [#1, 3]", "As an AI I can't say", "The value is perhaps of use and possibly in the list", "Der Wert ist vermutlich und gegebenenfalls von Dauer",
    "manual review required (findings extraction failed)", "Based on the supplied context it is so", "Es scheint, dass es der Fall ist [#2]", "Unable to tell", "Im vorliegenden Kontext finden sich keine Daten", "12 [#4] 13", "",
)
DEFENDS = "regexp_matches(substr(w, 1, 200), '(?i)" + "|".join(U.DEFENSIVE).replace("'", "''") + "') OR regexp_matches(substr(w, 1, 200), '(?i)" + U.EXTRACTION_FAILED + "')"
TOKENS = "regexp_extract_all(lower(w), '[a-zäöüß]+')"


def _hits(words) -> str:
    return f"len(list_filter({TOKENS}, lambda t: t IN ({', '.join(map(repr, words))})))"


CELL_LANGUAGE = f"""CASE WHEN len({TOKENS}) < 4 THEN CASE WHEN regexp_matches(w, '[äöüÄÖÜß]') AND len({TOKENS}) > 0 THEN 'de' ELSE 'unknown' END
  WHEN {_hits(L.CELL_DE)} + CASE WHEN regexp_matches(w, '[äöüÄÖÜß]') THEN 3 ELSE 0 END >= 2 AND {_hits(L.CELL_EN)} >= 2 THEN 'mixed'
  WHEN {_hits(L.CELL_DE)} + CASE WHEN regexp_matches(w, '[äöüÄÖÜß]') THEN 3 ELSE 0 END >= 2 THEN 'de' WHEN {_hits(L.CELL_EN)} >= 2 THEN 'en' ELSE 'unknown' END"""


def _without_hedges(language: str) -> str:
    """Nested replacements of the hedges of a language, or of both."""
    out = "w"
    for lang in ("de", "en") if language == "mixed" else (language,):
        for p in U.HEDGES[lang]:
            out = f"regexp_replace({out}, '(?i){p}', '', 'g')"
    return f"CASE WHEN {out} = w THEN w ELSE trim(regexp_replace({out}, '  +', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) END"


SCRUB = f"""WITH given AS (
  SELECT conv_id, turn, {sql_phrase(CELLS, "conv_id + turn")} || CASE WHEN (conv_id + turn) % 24 < 12 THEN ' ' || substr(text, 1, 60) ELSE '' END AS text,
         {sql_phrase(("green", "red"), "conv_id")} AS light, {sql_phrase(("", "Frist prüfen [#1]", "x"), "turn")} AS note,
         CASE WHEN turn % 3 = 0 THEN substr(text, 1, 30 + (conv_id % 60)::INT) ELSE '' END AS action, {sql_phrase(("Permits", "General", ""), "conv_id")} AS domain
  FROM conversations
), bare AS (
  SELECT *, regexp_replace(text, '{U.CHUNK_REF}', '', 'g') AS w FROM given
), told AS (
  SELECT *, {DEFENDS} AS defensive, CASE WHEN trim(w) = '' THEN 'unknown' ELSE {CELL_LANGUAGE} END AS language,
    CASE WHEN length(trim(action)) > 60 THEN rtrim(CASE WHEN regexp_extract(substr(trim(action), 1, 60), '(?s)^(.{{30,}}) [^ ]*$', 1) <> '' THEN regexp_extract(substr(trim(action), 1, 60), '(?s)^(.{{30,}}) [^ ]*$', 1) ELSE substr(trim(action), 1, 60) END, ' ,;:') || '…'
      WHEN length(trim(action)) > 0 THEN trim(action) WHEN lower(domain) IN ('', 'general') THEN '' ELSE domain END AS hint
  FROM bare
)
SELECT conv_id, turn, CASE WHEN defensive AND light = 'green' THEN 'yellow' ELSE light END AS light,
  CASE WHEN defensive THEN '{U.MISSING["de"]}' || CASE WHEN hint <> '' THEN ' — ' || hint ELSE '' END
    WHEN language = 'de' THEN {_without_hedges("de")} WHEN language = 'en' THEN {_without_hedges("en")} WHEN language = 'mixed' THEN {_without_hedges("mixed")} ELSE w END AS text,
  nullif(trim(regexp_replace(note, '{U.CHUNK_REF}', '', 'g')), '') AS note, defensive, language
FROM told"""


@query("f20_f21_f22_guardrail", SCRUB)
def f21(t):
    """Cells with references, defences and hedges, put before real texts."""
    by = F.col("conv_id") + F.col("turn")
    head = F.substring("text", 1, 60)
    text = F.concat(phrase(CELLS, by), F.when(by % 24 < 12, F.concat(F.lit(" "), head)).otherwise(""))
    action = F.when(F.col("turn") % 3 == 0, F.substring(F.col("text"), F.lit(1), F.lit(30) + (F.col("conv_id") % 60).cast("int"))).otherwise("")
    s = U.scrub(phrase(("green", "red"), F.col("conv_id")), text, phrase(("", "Frist prüfen [#1]", "x"), F.col("turn")), action, phrase(("Permits", "General", ""), F.col("conv_id")))
    return t.conversations.select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", "s.light", "s.text", "s.note", "s.defensive", "s.language")


#: Endings that name rules of states.
RULES = ("nach der 10H-Regelung", "gem. Art. 82 BayBO", "10 x H gilt", "laut NBauO zulässig", "LBO SH und BauO NRW", "10Hz", "ohne Regel", "Art. 82a BayBO, NBauO")


@query(
    "f29_jurisdiction",
    f"""WITH given AS (
  SELECT conv_id, turn, replace(substr(text, 1, 100), chr(10), ' ') || ' ' || {sql_phrase(RULES, "turn")} || ' ' || replace(text, chr(10), ' ') AS a, {sql_phrase(("bayern", "Hessen", "niedersachsen", ""), "conv_id")} AS state FROM conversations
), hits AS (
  SELECT conv_id, turn, state, a, unnest({sql_list([k for k, _, _ in U.STATE_RULES])}) AS belongs_to, unnest([{", ".join("coalesce(" + ", ".join(f"nullif(regexp_extract(a, '{p}'), '')" for p in ps) + ")" for _, _, ps in U.STATE_RULES)}]) AS hit FROM given
)
SELECT conv_id, turn, belongs_to, trim(substr(a, greatest(instr(a, hit) - 40, 1), instr(a, hit) - greatest(instr(a, hit) - 40, 1) + length(hit) + 40)) AS excerpt
FROM hits WHERE hit IS NOT NULL AND state <> '' AND lower(state) <> belongs_to""",
)
def f29(t):
    flat = F.regexp_replace("text", "\n", " ")
    answer = F.concat(F.substring(flat, 1, 100), F.lit(" "), phrase(RULES, F.col("turn")), F.lit(" "), flat)
    found = U.jurisdiction_warnings(answer, phrase(("bayern", "Hessen", "niedersachsen", ""), F.col("conv_id")))
    return t.conversations.select("conv_id", "turn", F.explode(found).alias("w")).select("conv_id", "turn", "w.belongs_to", "w.excerpt")


#: Answers of a model that labels texts.
LABELLED = ('["baurecht", "unsinn", "umweltrecht"]', '```json\n["energierecht"]\n```', 'Das ist: ["vertragsrecht"] (sicher)', "keine", '["nichts"]', '["prozessrecht", "allgemein"]')
SLUGS = ("bgb", "EEG_2014", "bimschg", "unbekannt", "zpo", "gbo", "arbzg")


@query(
    "f35_domains",
    f"""SELECT doc_id, CASE WHEN length(text) >= 50 AND kept <> '' THEN kept ELSE 'allgemein' END AS domains, {sql_phrase(("vertragsrecht", "energierecht", "immissionsschutzrecht", "allgemein", "prozessrecht", "grundstuecksrecht", "arbeitsrecht"), "doc_id")} AS statute
FROM (SELECT *, array_to_string(list_filter(regexp_extract_all(regexp_extract({sql_phrase(LABELLED, "doc_id")}, '(?s)\\[.*?\\]'), '"([^"]*)"', 1), lambda d: d IN ({", ".join(map(repr, U.DOMAINS))})), ',') AS kept FROM documents)""",
)
def f35(t):
    labels = U.domains(phrase(LABELLED, F.col("doc_id")), F.col("text"))
    return t.documents.select("doc_id", F.array_join(labels, ",").alias("domains"), U.statute_domain(phrase(SLUGS, F.col("doc_id"))).alias("statute"))


@query("f37_contents_tables", "SELECT l_orderkey, count(*) >= 3 AS toc FROM lineitem GROUP BY 1")
def f37(t):
    cells = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.col("l_linenumber").cast("string")).alias("cells"))
    return cells.select("l_orderkey", U.contents_table(F.lit("x"), F.col("cells")).alias("toc"))


DATED = ("permit_expiry", "Pachtvertrag Ablauf", "construction_milestone", "objection_period", "other", "Gewährleistung")


@query(
    "f39_derived_findings",
    f"""WITH timeline AS (
  SELECT o_custkey AS report, {sql_phrase(DATED, "o_orderkey")} AS kind, ['expired', 'urgent', 'soon', 'future'][o_orderkey % 4 + 1] AS urgency, o_orderpriority AS description FROM orders
)
SELECT report, 'deadline' AS kind, CASE WHEN urgency = 'expired' THEN 'red' ELSE 'yellow' END AS severity, CASE WHEN contains(kind, 'permit') OR contains(kind, 'objection') THEN 'Regulatory' ELSE 'General' END AS domain,
  CASE kind WHEN 'permit_expiry' THEN 'Permit Expiry' WHEN 'objection_period' THEN 'Objection Period' ELSE kind END || ': ' || description AS subject
FROM timeline WHERE urgency IN ('expired', 'urgent') AND kind NOT IN ('construction_milestone', 'other')
UNION ALL SELECT c_custkey, 'rueckbau', CASE WHEN c_custkey % 3 = 0 THEN 'red' ELSE 'yellow' END, 'Regulatory', CASE WHEN c_custkey % 3 = 0 THEN 'none' ELSE (c_custkey % 5)::VARCHAR END FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 3 = 1 AND c_custkey % 2 = 0
UNION ALL SELECT s_suppkey, 'grundbuch', 'red', 'Land', s_suppkey::VARCHAR FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 10 >= 5""",
)
def f39(t):
    """Orders as dates, customers as bonds, suppliers as owners of parcels."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    timeline = t.orders.select(F.col("o_custkey").alias("report"), phrase(DATED, F.col("o_orderkey")).alias("kind"), phrase(("expired", "urgent", "soon", "future"), F.col("o_orderkey")).alias("urgency"), F.col("o_orderpriority").alias("description"))
    bonds = t.customer.select(c.alias("report"), F.when(c % 3 != 0, c % 5).alias("amount"), F.when(c % 3 == 1, c % 2 == 1).alias("sufficient"))
    owners = t.supplier.select(s.alias("report"), s.alias("parcel"), F.when(s % 2 == 0, False).otherwise(F.lit(None).cast("boolean")).alias("owner_match"), ((s % 10) / 10).alias("confidence"))
    return FN.derived(timeline, bonds, owners)


SIZES = ("2 MW pro Einheit fuer 10 Einheiten", "20,5 MW Gesamtleistung", "Leistung unbekannt", "rund 12", "3.2 MW je WEA", "")
COUNTS = ("10 Anlagen", "nicht eindeutig", "12", "", "7 WEA")


@query(
    "f41_park_size",
    f"""WITH given AS (
  SELECT p_partkey, {sql_phrase(SIZES, "p_partkey")} AS cap, {sql_phrase(COUNTS, "p_partkey")} AS num, [10, 0, 12, 0, 7][p_partkey % 5 + 1] AS counted, (p_partkey % 14)::INT AS n_rows, p_size * 100 AS kw FROM part
), read AS (
  SELECT *, CASE WHEN contains(cap, '10 Einheiten') OR contains(num, '10 Anlagen') THEN 10 WHEN contains(num, '7 WEA') THEN 7 END AS stated_n, CASE WHEN contains(cap, '2 MW pro') THEN 2.0 WHEN contains(cap, '3.2 MW je') THEN 3.2 END AS per,
    CASE WHEN contains(cap, 'Gesamt') THEN 20.5 END AS total FROM given
), told AS (
  SELECT *, coalesce(n_rows > 0 AND counted > 0 AND abs(n_rows - counted) > greatest(2, round_even(counted * 0.25, 0)), false) AS far FROM read
)
SELECT p_partkey, CASE WHEN total IS NOT NULL THEN total WHEN stated_n IS NOT NULL AND per IS NOT NULL THEN round(stated_n * per, 3) WHEN contains(cap, 'unbekannt') THEN NULL ELSE round(kw / 1000, 3) END::DOUBLE AS total_mw,
  (CASE WHEN stated_n IS NOT NULL THEN stated_n WHEN contains(num, 'eindeutig') AND counted = 0 THEN 0 WHEN far THEN counted WHEN n_rows > 0 THEN n_rows ELSE counted END)::INT AS turbines, far AS diverges FROM told""",
)
def f41(t):
    k = F.col("p_partkey")
    counted = F.element_at(F.array(*map(F.lit, (10, 0, 12, 0, 7))), (k % 5).cast("int") + 1)
    size = FN.park_size(phrase(SIZES, k), phrase(COUNTS, k), counted, (k % 14).cast("int"), F.col("p_size") * 100)
    return t.part.select("p_partkey", size.alias("s")).select("p_partkey", "s.*")


@query("f43_contract_labels", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'STEEL' WHEN contains(lower(p_type), 'tin') THEN 'TIN' END AS label FROM part")
def f43(t):
    return t.part.select("p_partkey", U.first_label(F.col("p_type"), ["STEEL", "TIN"]).alias("label"))


@query(
    "f51_evidence_rows",
    """WITH given AS (
  SELECT doc_id, ['Wert', '', 'null', NULL][doc_id % 4 + 1] AS value, ['green', 'grün', 'red'][doc_id % 3 + 1] AS light, CASE doc_id % 5 WHEN 0 THEN [2, 9, 2, 1] WHEN 1 THEN [] WHEN 2 THEN NULL WHEN 3 THEN [0] ELSE [3] END AS cited,
    CASE WHEN doc_id % 7 = 0 THEN NULL ELSE ['a', 'b', 'c'] END AS reranked, CASE WHEN doc_id % 11 = 0 THEN repeat('fehler ', 20) END AS error FROM documents
), named AS (
  SELECT *, value IS NOT NULL AND value NOT IN ('', 'null') AS real, CASE WHEN reranked IS NULL THEN [] ELSE CASE doc_id % 5 WHEN 0 THEN ['b', 'a'] WHEN 4 THEN ['c'] ELSE [] END END AS good FROM given
)
SELECT doc_id AS row, CASE WHEN error IS NOT NULL THEN 'Could not extract' WHEN real THEN value ELSE 'Information not found in documents' END AS value, CASE WHEN error IS NOT NULL THEN 'red' WHEN light IN ('green', 'red') THEN light END AS light,
  CASE WHEN error IS NOT NULL THEN [] WHEN len(good) > 0 THEN good WHEN real AND reranked IS NOT NULL THEN ['a', 'b'] ELSE [] END AS evidence, CASE WHEN error IS NOT NULL THEN 'Error: ' || substr(error, 1, 80) END AS note FROM named""",
)
def f51(t):
    k = F.col("doc_id")
    ints = lambda *xs: F.array(*map(F.lit, xs)).cast("array<int>") if xs else F.array().cast("array<int>")
    cited = F.when(k % 5 == 0, ints(2, 9, 2, 1)).when(k % 5 == 1, ints()).when(k % 5 == 3, ints(0)).when(k % 5 == 4, ints(3))
    value = F.when(k % 4 == 0, "Wert").when(k % 4 == 1, "").when(k % 4 == 2, "null")
    passages = F.when(k % 7 != 0, F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    answers = t.documents.select(k.alias("row"), value.alias("value"), phrase(("green", "grün", "red"), k).alias("light"), cited.alias("cited"), passages.alias("reranked"), F.when(k % 11 == 0, "fehler " * 20).alias("error"))
    return FN.assembled(answers)


@query("f52_missing_types", "SELECT required, 'high' AS severity FROM (VALUES ('en'), ('pt'), ('de')) AS r(required) WHERE required NOT IN (SELECT lang FROM documents)")
def f52(t):
    return U.uncovered(t.spark.createDataFrame([("en",), ("pt",), ("de",)], "required string"), t.documents.select(F.col("lang").alias("kind")))


@query(
    "f53_table_rows",
    """SELECT o_orderkey AS "table", CASE WHEN o_orderkey % 2 = 0 THEN 'Liste ' || o_orderkey ELSE 'Tabelle' END AS title, n FROM orders JOIN (
  SELECT l_orderkey, list('{"Nr":"' || l_linenumber || '","Wert":"' || CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_returnflag END || '"}' ORDER BY l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_returnflag END) AS n FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linenumber = 1 AND l_orderkey % 5 = 0) = 0) ON o_orderkey = l_orderkey""",
)
def f53(t):
    """Orders as tables; every fifth has a row too wide."""
    k = F.col("l_orderkey")
    value = F.when(F.col("l_linenumber") % 3 == 0, F.when(k % 2 == 0, "NaN")).otherwise(F.col("l_returnflag"))
    values = F.array(F.col("l_linenumber").cast("string"), value)
    wide = (k % 5 == 0) & (F.col("l_linenumber") == 1)
    cells = t.lineitem.select(k.alias("table"), F.when(k % 2 == 0, F.concat(F.lit("Liste "), k)).otherwise("").alias("caption"), F.col("l_linenumber").alias("place"), F.array(F.lit("Nr"), F.lit("Wert")).alias("columns"), F.when(wide, F.concat(values, values)).otherwise(values).alias("values"))
    return FN.table_records(cells).select("table", "title", F.col("rows").alias("n"))


@query(
    "f54_cited_rows",
    """WITH rows AS (
  SELECT 's' || l_linenumber % 3 AS section, 'k' || l_orderkey AS label, l_suppkey AS doc, repeat('x', 60) || l_linenumber % 2 || l_returnflag AS excerpt, l_linenumber FROM lineitem
), cites AS (
  SELECT o_orderkey AS finding, unnest([0, 1, 2]) AS i, unnest(['s1', 's2', 's9']) AS section, 'k' || o_orderkey AS label FROM orders WHERE o_orderkey % 4 <> 0
), met AS (
  SELECT finding, doc, min(i) AS i FROM cites JOIN rows USING (section, label) GROUP BY 1, 2
), dropped AS (
  SELECT finding, count(*) FILTER (NOT EXISTS (SELECT 1 FROM rows r WHERE r.section = c.section AND r.label = c.label)) AS dropped FROM cites c GROUP BY 1
)
SELECT finding, ['red', 'yellow', 'yellow'][finding % 3 + 1] AS severity, coalesce((SELECT list_sort(list(doc)) FROM met m WHERE m.finding = d.finding), []) AS docs, dropped FROM dropped d""",
)
def f54(t):
    """Findings that cite rows by section and label; one of three labels names no row."""
    k = F.col("o_orderkey")
    label = F.concat(F.lit("k"), k)
    cite = lambda s: F.struct(F.lit(s).alias("section"), F.concat(F.lit(" "), label).alias("label"))
    found = t.orders.select(k.alias("finding"), F.when(k % 4 == 0, " ").otherwise("text").alias("text"), phrase(("red", "yellow", "orange"), k).alias("severity"), F.array(cite("s1"), cite("s2"), cite("s9")).alias("cited"))
    rows = t.lineitem.select(F.concat(F.lit("s"), F.col("l_linenumber") % 3).alias("section"), F.concat(F.lit("k"), "l_orderkey").alias("label"), F.col("l_suppkey").cast("bigint").alias("doc"), F.concat(F.lit("x" * 60), F.col("l_linenumber") % 2, "l_returnflag").alias("excerpt"))
    out = FN.cited_evidence(found, rows)
    return out.select("finding", "severity", F.array_sort(F.transform("evidence", lambda e: e["doc"])).alias("docs"), "dropped")


ASKED = ("Urteil des BGH zu § 5 BImSchG", "BauGB Stand 01.02.2020", "Beschluss vom 3.4.2021", "allgemein", "VG Berlin und EEG damals")
INTENTS = ("court_ruling", "historical_law", "current_law", "general")


@query(
    "f57_query_filters",
    f"""WITH q AS (SELECT item_id, {sql_phrase(ASKED, "item_id")} || ' ' || text AS x, {sql_phrase(INTENTS, "item_id")} AS intent FROM benchmark), read AS (
  SELECT *, list_sort(list_filter({sql_list(G.LAW_CODES)}, lambda c: CASE c {" ".join(f"WHEN '{c}' THEN regexp_matches(x, '\\b{c}\\b')" for c in G.LAW_CODES)} END)) AS codes, nullif(regexp_extract(x, '\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}}'), '') AS dated FROM q
)
SELECT item_id, nullif(array_to_string(codes, ','), '') AS law_refs, CASE WHEN intent = 'historical_law' THEN dated END AS effective_to, CASE WHEN intent <> 'historical_law' AND dated IS NOT NULL THEN true END AS current_only, CASE WHEN intent = 'court_ruling' THEN 'ruling' END AS doc_type,
  (regexp_matches(x, '(?i)(?:vergleich|unterschied|abgrenzung)')::INT + regexp_matches(x, '(?i)\\bund\\b.*\\bund\\b')::INT + regexp_matches(x, '§\\s*\\d+.*§\\s*\\d+')::INT + regexp_matches(x, '(?i)sowohl\\s.*\\sals auch')::INT + regexp_matches(x, '(?i)einerseits\\s.*\\sandererseits')::INT) AS complexity FROM read""",
)
def f57(t):
    """Filters that a parsed question asks for, and how many signs of a complex one it has."""
    q = t.benchmark.select("item_id", F.concat(phrase(ASKED, F.col("item_id")), F.lit(" "), "text").alias("x"), phrase(INTENTS, F.col("item_id")).alias("intent"))
    return q.select("item_id", G.search_filters(F.col("x"), F.col("intent")).alias("f"), G.complexity(F.col("x")).alias("complexity")).select("item_id", F.when(F.size("f.law_refs") > 0, F.array_join("f.law_refs", ",")).alias("law_refs"), "f.effective_to", "f.current_only", "f.doc_type", "complexity")


@query("r4_all_terms_rank", "SELECT conv_id, turn, list_sum([CASE WHEN w IN ('the', 'of') THEN 1 ELSE 0 END for w in regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')])::INT AS tf FROM conversations WHERE list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'the') AND list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'of')")
def r4(t):
    return t.conversations.select("conv_id", "turn", O.all_terms(F.lit("the of"), F.col("text"), R.tokens).alias("tf")).where("tf is not null")


@query("r10_rerank_stub", "SELECT conv_id, turn, round(len(list_filter(['the', 'of', 'and'], lambda w: list_contains(string_split_regex(lower(substr(text, 1, 2000)), '[\\s\\x0B]+'), w))) / 3, 6) AS score FROM conversations")
def r10(t):
    return t.conversations.select("conv_id", "turn", F.round(O.rerank_score(F.lit("the of and"), F.col("text")), 6).alias("score"))


@query("r11_batch_embedding")
def r11(t):
    return O.embed_table(t.documents, "doc_id", "text", O.hashed_embedding(), dims=64)
