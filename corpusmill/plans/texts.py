"""Queries over text, value and chunking functions (2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import json as J
from corpusmill.functions import language as L
from corpusmill.functions import legal as G
from corpusmill.functions import packing as PK
from corpusmill.functions import questions as Q
from corpusmill.functions import text as T
from corpusmill.functions import values as V
from corpusmill.operators import chunking as C
from corpusmill.operators import findings as FN
from corpusmill.operators.ranking import placed
from corpusmill.plans.registry import phrase, query, sql_list, sql_phrase


#: Letters that may follow a split word's hyphen: all but capitals and u, o and b.
JOINED = r"[ac-np-tv-zß-öø-ÿ\p{Lo}\p{Lm}\p{Nd}_]"


@query(
    "f1_clean_text",
    f"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, '[Picture]', ''),
  '\\n{{3,}}', chr(10) || chr(10), 'g'), ' {{3,}}', '  ', 'g'),
  '\\$ (\\d+[a-z]?) (Abs|Satz|Nr)\\.', '§ \\1 \\2.', 'g'),
  '([\\p{{L}}\\p{{M}}\\p{{Nd}}_]{{2,}})- ({JOINED})', '\\1\\2', 'g'))) AS h
FROM (SELECT doc_id, text || ' Wort- teil und- oder $ 12 Abs. ' || coalesce(lang, '') || '- ' || coalesce(source, '') AS text FROM documents)""",
)
def f1(t):
    """Every text, with an end to which the rules for split words and paragraph signs apply."""
    ended = F.concat("text", F.lit(" Wort- teil und- oder $ 12 Abs. "), F.coalesce("lang", F.lit("")), F.lit("- "), F.coalesce("source", F.lit("")))
    return t.documents.withColumn("text", ended).select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("h"))


@query("f2_sentences")
def f2(t):
    """How many sentences, and the hash of where they end; tests compare it with a plain version."""
    s = T.sentences(F.col("text"))
    return t.documents.select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "\n|\n")).alias("h"))


@query("f2_sentences_f7_chunks")
def f7(t):
    return C.chunk_table(t.documents)


@query("f4_f5_f6_parents_and_children")
def f4(t):
    return C.family_table(t.documents)


@query("f8_stride_windows", "SELECT doc_id, list_transform(range(1, greatest(length(text), 1) + 1, 800), lambda i: md5(substr(text, i, 1000))) AS windows FROM documents")
def f8(t):
    return t.documents.select("doc_id", F.transform(PK.stride_windows(F.col("text")), lambda w: F.md5(w)).alias("windows"))


@query("f8_f50_packets")
def f50(t):
    """Paragraphs packed, windows that end at empty lines, sections packed with overlap, and records; tests compare each with a plain version."""
    text = F.col("text")
    made = t.documents.select("doc_id", PK.clause_windows(text).alias("windows"), PK.section_packets(F.split(text, "\n")).alias("sections"), PK.ruling_record(F.col("doc_id").cast("string"), F.col("source"), text).alias("ruling"), PK.shard_record(F.lit("s"), F.col("doc_id").cast("string"), F.lit("caselaw"), text).alias("line"))
    return made.select("doc_id", F.size("windows").alias("windows"), F.size("sections").alias("sections"), "ruling", "line")


@query("f9_page_passages", "SELECT conv_id, count(*) AS n FROM (SELECT conv_id, unnest(string_split(text, chr(10))) AS p FROM conversations) WHERE length(trim(p)) >= 40 GROUP BY 1")
def f9(t):
    marked = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return t.conversations.select("conv_id", F.explode(T.page_passages(marked)).alias("p")).groupBy("conv_id").agg(F.count("*").alias("n"))


@query("f10_heading_sections", "SELECT conv_id, turn, role AS title, text AS body FROM conversations WHERE trim(text) <> ''")
def f10(t):
    doc = F.concat(F.lit("intro\n## "), "role", F.lit("\n"), "text")
    return t.conversations.select("conv_id", "turn", "text", F.explode(T.heading_sections(doc)).alias("s")).select("conv_id", "turn", F.col("s.title").alias("title"), F.col("text").alias("body"))


@query("f11_safe_ids", "SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g'), 1, 50) AS safe, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def f11(t):
    return t.pages.select("page_id", T.safe_id(F.col("url")).alias("safe"), T.slug(F.col("url")).alias("slug"))


@query(
    "f12_hash_keys",
    """SELECT doc_id, substr(md5(source || ':' || doc_id), 1, 16) AS key, substr(sha256(text), 1, 24) AS content,
  sha256(CASE WHEN lang = 'de' THEN '' ELSE lang || chr(10) END || source || chr(10) || text || chr(10) || '---' || chr(10) || '§ 2' || chr(10) || 'T' || chr(10) || chr(10) || '---' || chr(10)) AS law FROM documents""",
)
def f12(t):
    section = lambda a, b, c: F.struct(a.alias("enbez"), b.alias("titel"), c.alias("text"))
    sections = F.array(section(F.col("source"), F.lit(None).cast("string"), F.col("text")), section(F.lit("§ 2"), F.lit("T"), F.lit(None).cast("string")))
    law = T.law_hash(F.when(F.col("lang") != "de", F.col("lang")), sections)
    return t.documents.select("doc_id", T.doc_key(F.concat("source", F.lit(":"), F.col("doc_id").cast("string"))).alias("key"), F.substring(F.sha2("text", 256), 1, 24).alias("content"), law.alias("law"))


@query("f13_head_tail", "SELECT doc_id, md5(CASE WHEN length(text) > 4000 THEN substr(text, 1, 2000) || chr(10) || '[...]' || chr(10) || right(text, 2000) ELSE text END) AS h FROM documents")
def f13(t):
    return t.documents.select("doc_id", F.md5(T.head_tail(F.col("text"), 4000)).alias("h"))


@query("f14_embed_text", "SELECT doc_id, length(concat_ws(chr(10) || chr(10), lang, text)) AS n FROM documents")
def f14(t):
    return t.documents.select("doc_id", F.length(F.concat_ws("\n\n", "lang", "text")).cast("bigint").alias("n"))


@query("f15_ascii_ratio", "SELECT doc_id, round(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / greatest(length(text), 1), 6) AS ratio FROM documents")
def f15(t):
    return t.documents.select("doc_id", F.round(T.ascii_ratio(F.col("text")), 6).alias("ratio"))


SPANS = ("in 30 Jahren", "Frist: 14 Tage, weiß nicht", "nach 2 Wochen", "12 Monate; I don't know", "vier Wochen", "3Tage", "ab 5 Jahre alt", "")


@query(
    "f16_degenerate_answers",
    f"""SELECT doc_id, CASE WHEN length(x) < 30 THEN false ELSE len(list_distinct(g)) / len(g) < 0.2 END AS degenerate,
  regexp_matches(x, '(?i)\\b\\d+\\s+(jahre?n?|monate?n?|tage?n?|wochen?)\\b') AND NOT ({" OR ".join("contains(lower(x), '" + p.replace("'", "''") + "')" for p in T.NOT_KNOWN)}) AS invented
FROM (SELECT doc_id, x, list_transform(range(1, greatest(length(x) - 3, 2)), lambda i: substr(x, i, 5)) AS g FROM (
  SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN repeat('la ', 30) ELSE substr(text, 1, 300) END || ' ' || {sql_phrase(SPANS, "doc_id")} AS x FROM documents))""",
)
def f16(t):
    x = F.concat(F.when(F.col("doc_id") % 4 == 0, "la " * 30).otherwise(F.substring("text", 1, 300)), F.lit(" "), phrase(SPANS, F.col("doc_id")))
    return t.documents.select("doc_id", x.alias("x")).select("doc_id", T.degenerate(F.col("x")).alias("degenerate"), T.invented_deadline(F.col("x")).alias("invented"))


_BLOCKS = "(?i)</(p|div|li|h[1-6]|tr|table|section|article)>|<br\\s*/?>"
_BARE = f"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)>', '', 'g'), '{_BLOCKS}', chr(10), 'g'), '(?s)<[^>]*>', '', 'g')"
for _name, _char in T.ENTITIES.items():
    _BARE = "replace(" + _BARE + f", '{_name}', '" + _char.replace("'", "''") + "')"


@query("f17_html_to_text", f"SELECT page_id, trim(regexp_replace(regexp_replace({_BARE}, '[ \\t]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10)) AS text FROM pages")
def f17(t):
    return t.pages.select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query("f18_german_numbers", "SELECT o_orderkey, o_totalprice AS value FROM orders")
def f18(t):
    written = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    return t.orders.select("o_orderkey", V.german_number(F.concat(written, F.lit(" €"))).alias("value"))


@query("f19_currency", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency FROM part")
def f19(t):
    return t.part.select("p_partkey", V.currency(F.when(F.col("p_partkey") % 2 == 0, "$ 5").otherwise("5 €")).alias("currency"))


def _counted(words, letters: str = "a-zäöüß") -> str:
    return f"len(list_filter(regexp_extract_all(lower(text), '[{letters}]+'), lambda t: t IN ({', '.join(map(repr, words))})))"


LANGUAGES = f"""WITH hits AS (
  SELECT doc_id, text, len(regexp_extract_all(lower(text), '[a-zäöüß]+')) AS n, regexp_matches(lower(text), '[äöüß]') AS umlaut, regexp_matches(text, '[äöüÄÖÜß]') AS marked,
         {_counted(L.QUESTION_DE)} AS qde, {_counted(L.QUESTION_EN)} AS qen, {_counted(L.CELL_DE)} AS cde, {_counted(L.CELL_EN)} AS cen,
         len(regexp_extract_all(lower(text), '[a-zäöüßøåæ]+')) AS m, {_counted(L.PASSAGE_DE, "a-zäöüßøåæ")} AS pde, {_counted(L.PASSAGE_EN, "a-zäöüßøåæ")} AS pen,
         {_counted(L.PASSAGE_DA, "a-zäöüßøåæ")} AS pda, len(regexp_extract_all(lower(text), '[øåæ]')) AS danish
  FROM (SELECT doc_id, text || ' ' || {sql_phrase(("ist der Vertrag für die Anlage", "what is the permit", "vi har ikke det", "und the", ""), "doc_id")} AS text FROM documents)
)
SELECT doc_id,
  CASE WHEN n = 0 THEN NULL WHEN qde + CASE WHEN umlaut THEN 2 ELSE 0 END > qen THEN 'de' WHEN qen > qde + CASE WHEN umlaut THEN 2 ELSE 0 END THEN 'en' END AS question,
  CASE WHEN n < 4 THEN CASE WHEN marked AND n > 0 THEN 'de' ELSE 'unknown' END WHEN cde + CASE WHEN marked THEN 3 ELSE 0 END >= 2 AND cen >= 2 THEN 'mixed'
    WHEN cde + CASE WHEN marked THEN 3 ELSE 0 END >= 2 THEN 'de' WHEN cen >= 2 THEN 'en' ELSE 'unknown' END AS cell,
  CASE WHEN length(text) < 100 OR m < 20 THEN 'unknown' WHEN danish >= 3 OR pda >= 3 OR pen > pde AND NOT umlaut THEN 'non_de' WHEN pde >= 3 OR umlaut AND pde >= 1 THEN 'de' ELSE 'unknown' END AS passage,
  CASE WHEN doc_id % 3 = 0 THEN 'fr' WHEN n = 0 THEN NULL WHEN qde + CASE WHEN umlaut THEN 2 ELSE 0 END > qen THEN 'de' WHEN qen > qde + CASE WHEN umlaut THEN 2 ELSE 0 END THEN 'en' END AS answer
FROM hits"""


@query("f20_language", LANGUAGES)
def f20(t):
    """Four rules over every text, with an ending in one of three languages."""
    ended = F.concat("text", F.lit(" "), phrase(("ist der Vertrag für die Anlage", "what is the permit", "vi har ikke det", "und the", ""), F.col("doc_id")))
    text = F.col("text")
    rules = {"question": L.of_question(text), "cell": L.of_cell(text), "passage": L.of_passage(text), "answer": L.of_answer(F.when(F.col("doc_id") % 3 == 0, "fr").otherwise(""), text)}
    return t.documents.withColumn("text", ended).select("doc_id", *[c.alias(n) for n, c in rules.items()])


@query("f23_parcel_numbers", "SELECT o_orderkey, (o_orderkey % 90 + 1)::VARCHAR || '/' || (o_custkey % 9)::VARCHAR AS number FROM orders")
def f23(t):
    raw = F.concat(F.lpad((F.col("o_orderkey") % 90 + 1).cast("string"), 4, "0"), F.lit(" - "), (F.col("o_custkey") % 9).cast("string"))
    return t.orders.select("o_orderkey", V.parcel_number(raw).alias("number"))


@query("f26_f27_salvage", "SELECT conv_id, turn, md5(text) AS h, turn AS said, len(string_split(text, ' ')) AS n_words FROM conversations")
def f26(t):
    """Answers that come fenced, between prose, cut off within a string or with commas too many."""
    whole = F.to_json(F.struct(F.col("turn"), F.split("text", " ").alias("words"), F.struct(F.col("text")).alias("body")))
    kinds = [
        F.concat(F.lit("<think>{hm</think>```json\n"), whole, F.lit("\n```")),
        F.concat(F.lit("Sure, here: "), whole, F.lit(" - anything [else]?")),
        F.concat(F.lit("Answer: "), F.left(whole, F.length(whole) - 3), F.lit("<think>and {")),
        F.regexp_replace(whole, r"\}\}$", ", \n} , }"),
    ]
    dirty = F.element_at(F.array(*kinds), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)).cast("int") + 1)
    fixed = t.conversations.select("conv_id", "turn", J.salvage_json(T.strip_think(dirty)).alias("json"))
    get = lambda path: F.get_json_object("json", path)
    return fixed.select("conv_id", "turn", F.md5(get("$.body.text")).alias("h"), get("$.turn").cast("bigint").alias("said"), F.json_array_length(get("$.words")).cast("bigint").alias("n_words"))


@query(
    "f28_citation_validation",
    """SELECT conv_id, turn, list_concat(['[C-1]', '[C-9]'], list_filter(regexp_extract_all(text, '\\[[CM]-\\d+\\]'), lambda h: h NOT IN ('[C-1]', '[C-9]'))) AS cited, 'First point [C-1]. Second point (unbelegt). ' || text AS checked, true AS stable FROM conversations""",
)
def f28(t):
    answer = F.concat(F.lit("First point [C-1]. Second point [C-9]. "), "text")
    checked = V.drop_unknown_citations(answer, F.array(F.lit("[C-1]")))
    return t.conversations.select("conv_id", "turn", V.citations(answer).alias("cited"), checked.alias("checked"), (V.drop_unknown_citations(checked, F.array(F.lit("[C-1]"))) == checked).alias("stable"))


PLACES = ("in Hessen bei Kassel", "bei Hannover", "in München", "Gut Essenheim", "Sachsen-Anhalt", "Kiel und Berlin", "nirgends", "Halle")
BENCHES = ("Oberlandesgericht Köln", "Landgericht Hessen", "VG Berlin", "Bayerischer Verwaltungsgerichtshof", "Bundesgerichtshof", "Amtsgericht Jena")
RULINGS = ("Urteil", "Kammerbeschluss ", "Vorbescheid", "Gerichtsbescheid", "", "geb")
_FIRST_STATE = " ".join(f"WHEN {' OR '.join(f'contains(lower(x), {w!r})' for w in words)} THEN {name!r}" for name, words in G.STATE_WORDS.items())
_FIRST_COURT = " ".join(f"WHEN contains(court, '{c}') THEN '{c}'" for c in G.COURTS)
_JURISDICTION = " ".join(f"WHEN level IN ({', '.join(map(repr, levels))}) THEN '{j}'" for j, levels in G.JURISDICTIONS.items())
_DECISION = " ".join(f"WHEN lower(trim(ruling)) IN ({', '.join(map(repr, names))}) THEN '{kind}'" for kind, names in G.DECISIONS.items())


@query(
    "f30_f34_state_and_court",
    f"""SELECT *, CASE {_JURISDICTION} ELSE 'Unknown' END AS jurisdiction FROM (
  SELECT doc_id, CASE {_FIRST_STATE} END AS state, CASE WHEN doc_id % 5 = 0 THEN 'Landgericht' ELSE CASE {_FIRST_COURT} ELSE 'Unknown' END END AS level, CASE {_DECISION} ELSE 'sonstige' END AS decision
  FROM (SELECT doc_id, {sql_phrase(PLACES, "doc_id")} || ' ' || text AS x, {sql_phrase(BENCHES, "doc_id")} AS court, {sql_phrase(RULINGS, "doc_id")} AS ruling FROM documents))""",
)
def f30(t):
    """A place before every text; courts and kinds of decisions."""
    level = G.court_level(F.when(F.col("doc_id") % 5 == 0, "Landgericht").otherwise(""), phrase(BENCHES, F.col("doc_id")))
    found = t.documents.select("doc_id", G.state(F.concat(phrase(PLACES, F.col("doc_id")), F.lit(" "), "text")).alias("state"), level.alias("level"), G.decision_type(phrase(RULINGS, F.col("doc_id"))).alias("decision"))
    return found.withColumn("jurisdiction", G.jurisdiction(F.lit(""), F.col("level")))


CITING = ("vgl. § 5 Abs. 2 BImSchG und Art. 3 Abs. 1 GG", "§§ 14 bis 18 BauGB, BGH VIII ZR 123/45", "Artikel 12 S. 2", "§ 3a Nr. 4 SGB XII und EEG, BGB", "OVG Bf 12/99", "")
_CODES = " ".join(f"WHEN '{c}' THEN regexp_matches(text, '\\b{c}\\b')" for c in G.LAW_CODES)


@query(
    "f31_f55_legal_references",
    f"""SELECT doc_id, list_transform(regexp_extract_all(text, '{G.PARAGRAPH}', 0), lambda r: trim(r)) AS paragraphs, list_transform(regexp_extract_all(text, '{G.ARTICLE}', 0), lambda r: trim(r)) AS articles,
  list_transform(regexp_extract_all(text, '{G.DECISION}', 0), lambda r: trim(r)) AS decisions, list_sort(list_filter({sql_list(G.LAW_CODES)}, lambda c: CASE c {_CODES} END)) AS codes
FROM (SELECT doc_id, text || ' ' || {sql_phrase(CITING, "doc_id")} AS text FROM documents)""",
)
def f31(t):
    return t.documents.select("doc_id", G.references(F.concat("text", F.lit(" "), phrase(CITING, F.col("doc_id")))).alias("r")).select("doc_id", "r.*")


MENTIONS = (
    "Flurstück 0012/4, Gemarkung Hude, Flur 3 nach Nutzungsvertrag Nr. NV-2020", "Flur 7 Nr. 5-6 und Pachtvertrag vom 1.2.2020", "Gemarkung Lamstedt, Flur 2, Flurstück 9/1; 10 WEA im Windpark Zodel Nord",
    "insgesamt 12 Anlagen, Grundstücks Nr. 8/2, Windpark Ahaus,", "3 am Anfang", "Vertrag dated 03/04/21 für Parzelle 1/2 und Parzelle 001/2", "nichts",
)
_WRITTEN = lambda x: f"list_transform(string_split(regexp_replace({x}, '-', '/', 'g'), '/'), lambda p: CASE WHEN regexp_matches(p, '^0+\\d') THEN regexp_replace(p, '^0+(\\d)', '\\1') ELSE p END)"


@query(
    "f31_parcel_mentions",
    "WITH given AS (SELECT doc_id, " + sql_phrase(MENTIONS, "doc_id") + " || chr(10) || text AS text FROM documents), raw AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, unnest(range(len(a))) AS i, unnest(a) AS raw, unnest(b) AS district, unnest(c) AS field FROM (SELECT doc_id, {', '.join(f"regexp_extract_all(text, '{p.replace('(?iu)', '(?i)')}', {g}) AS {n}" for g, n in zip(groups, 'abc'))} FROM given)"
        for k, (p, groups) in enumerate(G.PARCELS)
    )
    + f"), named AS (SELECT doc_id, array_to_string({_WRITTEN('raw')}, '/') AS number, {{'k': k, 'i': i, 'district': coalesce(district, ''), 'field': coalesce(try_cast(field AS INT), 0)}} AS p FROM raw) "
    "SELECT doc_id, number, min(p).district AS district, min(p).field AS field FROM named GROUP BY 1, 2",
)
def f31_parcels(t):
    """A line with parcels before every text."""
    return G.parcel_mentions(t.documents.select("doc_id", F.concat(phrase(MENTIONS, F.col("doc_id")), F.lit("\n"), "text").alias("text")), "doc_id", "text")


@query("f31_contracts_and_parks")
def f31_contracts(t):
    """Contracts with their kind, turbines and parks; tests have the cases."""
    line = F.concat(phrase(MENTIONS, F.col("doc_id")), F.lit("\n"), "text")
    return t.documents.select("doc_id", G.contract_mentions(line).alias("contracts"), G.turbine_count(phrase(MENTIONS, F.col("doc_id"))).alias("turbines"), G.parks(line).alias("parks"))


ASKS = (
    "Hallo, ", "Was kann ich hier tun? ", "Welche Rückbaupflicht besteht? ", "Was sagt § 35 BauGB? ", "Wie lange läuft der Vertrag mit der Nordex SE? ", "What is market standard? ", "ok ", "How does this work ",
    "BGH VIII ZR 12/19 und Windpark Zodel ", "Nenne die Pacht nach Nr. 4 von 2019 ", "Gilt Art. 12? ", "",
)
_CONTAINS = lambda words: "(" + " OR ".join(f"contains(lower(q), '{w}')" for w in words) + ")"
_MATCHES = lambda p, q="q": f"regexp_matches({q}, '{p}')"
_IDLE = f"(length(trim(q)) < 4 OR {_MATCHES(Q.SMALL_TALK, 'trim(q)')} OR {_MATCHES('(?i)^\\s*(' + '|'.join(Q.ABOUT_PROGRAM) + ')\\b', 'trim(q)')})"
ROUTES = f"""WITH given AS (
  SELECT conv_id, turn, {sql_phrase(ASKS, "conv_id + turn")} || CASE WHEN turn % 2 = 0 THEN text ELSE '' END AS q, conv_id % 3 = 0 AS docs, {sql_phrase(("", "", "rag", "chat", ""), "conv_id")} AS forced FROM conversations
), told AS (
  SELECT *, {", ".join(f"{_MATCHES(p)} AS {name}" for name, p in Q.FEATURES.items())}, {_CONTAINS(Q.CORPUS_WORDS)} AS corpus, {_IDLE} AS idle,
    {_CONTAINS(Q.CORPUS_WORDS)} OR {_MATCHES(Q.STATUTES)} OR {_CONTAINS(Q.DOCTRINE_WORDS)} AS legal FROM given
), routed AS (
  SELECT *, docs AND NOT idle AS contract, CASE WHEN forced IN ('rag', 'chat') THEN forced = 'rag' WHEN docs AND NOT idle THEN legal ELSE NOT idle END AS search FROM told
)
SELECT conv_id, turn, length(q) AS length, {", ".join(Q.FEATURES)}, {" OR ".join(n for n in Q.FEATURES if n != "has_date")} AS is_specific, corpus, legal, idle,
  CASE WHEN search AND contract THEN 'rag+contract' WHEN search THEN 'rag' WHEN contract THEN 'contract' ELSE 'chat' END AS mode FROM routed"""


@query("f32_f33_question_features", ROUTES)
def f32(t):
    """Questions of all kinds, by themselves and before real texts."""
    by = F.col("conv_id") + F.col("turn")
    q = F.concat(phrase(ASKS, by), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(""))
    given = t.conversations.select("conv_id", "turn", q.alias("q"), (F.col("conv_id") % 3 == 0).alias("docs"), phrase(("", "", "rag", "chat", ""), F.col("conv_id")).alias("forced"))
    x = F.col("q")
    told = given.select("conv_id", "turn", Q.features(x).alias("f"), Q.wants_corpus(x).alias("corpus"), Q.is_legal(x).alias("legal"), Q.is_idle(x).alias("idle"), Q.mode(x, F.col("docs"), F.col("forced")).alias("mode"))
    return told.select("conv_id", "turn", "f.length", *[f"f.{n}" for n in Q.FEATURES], "f.is_specific", "corpus", "legal", "idle", "mode")


@query("f36_severity_bands", "SELECT o_orderkey, greatest(CASE WHEN d > 100 THEN 3 WHEN d > 5 THEN 2 WHEN d > 0.5 THEN 1 ELSE 0 END, CASE WHEN d / o_totalprice > 0.01 THEN 3 WHEN d / o_totalprice > 0.005 THEN 2 WHEN d / o_totalprice > 0.001 THEN 1 ELSE 0 END) AS severity FROM (SELECT *, abs(o_orderkey % 200 - 100) AS d FROM orders)")
def f36(t):
    return t.orders.select("o_orderkey", V.severity(F.col("o_orderkey") % 200 - 100, F.col("o_totalprice")).alias("severity"))


@query("f38_urgency", "SELECT o_orderkey, CASE WHEN d < 0 THEN 'expired' WHEN d <= 30 THEN 'urgent' WHEN d <= 180 THEN 'soon' WHEN d IS NOT NULL THEN 'future' END AS urgency FROM (SELECT o_orderkey, date_diff('day', DATE '1996-01-01', o_orderdate::DATE) AS d FROM orders)")
def f38(t):
    return t.orders.select("o_orderkey", V.urgency(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1996-01-01").cast("date"))).alias("urgency"))


@query("f40_divergence", "SELECT l_partkey, count(*) FILTER (abs(l_quantity - w) > 0 AND abs(l_quantity - w) / greatest(abs(w), 1) > 0.02) AS diverging FROM (SELECT *, first_value(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS w FROM lineitem) GROUP BY 1")
def f40(t):
    winner = t.lineitem.groupBy("l_partkey").agg(F.min_by("l_quantity", F.struct("l_orderkey", "l_linenumber")).alias("w"))
    return t.lineitem.join(winner, "l_partkey").groupBy("l_partkey").agg(F.count_if(V.diverges(F.col("l_quantity"), F.col("w"))).alias("diverging"))


@query(
    "f42_f49_quality_and_samples",
    """WITH graded AS (
  SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN CASE WHEN n_chars < 5000 THEN 'low' ELSE 'high' END WHEN n_chars / (doc_id % 4) < 1800 THEN 'low' WHEN n_chars / (doc_id % 4) < 2500 THEN 'medium' ELSE 'high' END AS quality, (doc_id % 3 + 2)::INT AS severity, n_chars FROM documents
)
SELECT doc_id, quality, CASE WHEN quality = 'low' THEN greatest(2, severity - 1) ELSE severity END AS severity, quality = 'low' AS low_confidence, CASE WHEN n_chars < 500 THEN 2 WHEN n_chars < 2000 THEN 3 WHEN n_chars < 4000 THEN 4 ELSE 5 END AS samples, 'rag_qa' AS first FROM graded""",
)
def f42(t):
    """Quality by pages, what it does to missing clauses, and the plan of samples."""
    quality = FN.extraction_quality(F.col("n_chars"), F.col("doc_id") % 4)
    plan = FN.sample_plan(F.col("n_chars"), F.col("doc_id"), ("rag_qa", "summarize", "explain", "draft", "compare", "extract"))
    made = t.documents.select("doc_id", quality.alias("quality"), (F.col("doc_id") % 3 + 2).cast("int").alias("s"), plan.alias("plan"))
    kept = F.filter("plan", lambda p: p != "refusal")
    return made.select("doc_id", "quality", FN.missing_clauses(F.col("quality"), F.col("s")).alias("m"), F.size(kept).alias("samples"), F.col("plan")[0].alias("first")).select("doc_id", "quality", "m.*", "samples", "first")


@query("f46_keyword_hits", "SELECT doc_id, contains(lower(text), 'license')::INT + contains(lower(text), 'the')::INT AS hits FROM documents")
def f46(t):
    return t.documents.select("doc_id", T.keyword_hits(["License", "the"], F.col("text")).alias("hits"))


@query("f47_evidence_resolution", "SELECT conv_id, n, CASE WHEN n >= 1 AND n <= len(parts) THEN parts[n] END AS excerpt FROM (SELECT conv_id, (conv_id % 6)::INT AS n, list(text ORDER BY turn) AS parts FROM conversations GROUP BY conv_id)")
def f47(t):
    """The n-th message of each conversation, as a whole; none where there are fewer."""
    n = F.regexp_replace(F.concat(F.lit("#"), (F.col("conv_id") % 6).cast("string")), r"\D", "").cast("int")
    named = placed(t.conversations.select("conv_id", "turn", "text"), ["conv_id"], [F.col("turn")]).withColumn("n", n)
    found = named.where(F.col("place") == F.col("n")).select("conv_id", F.col("text").alias("excerpt"))
    asked = named.select("conv_id", "n").distinct()
    return asked.join(found, "conv_id", "left").select("conv_id", "n", "excerpt")


@query("f48_approx_tokens", "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def f48(t):
    return t.documents.select("doc_id", T.approx_tokens(F.col("text")).alias("tokens"))


@query("f56_sanitise", "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t]+', ' ', 'g'))) AS h FROM documents")
def f56(t):
    return t.documents.select("doc_id", F.md5(T.sanitise(F.col("text"))).alias("h"))
