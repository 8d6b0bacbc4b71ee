"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe, chat, cotrain, decontam, hardneg, langid, lm, rules, secrets, simhash, tokencount, trie, urlfilter
from corpusmill.llm.common import id_bucket, table
from corpusmill.session import shared_folder


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), id_bucket("doc_id", 4) == 2
    return langid.predict(docs, langid.fit(docs, ~held_out), held_out)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(table(spark, sf_dir, "conversations"))


#: The same by plain grouping: passages are runs of lines of one level that no empty line parts.
OP3_SQL = """
WITH RECURSIVE lines AS (
  SELECT conv_id, turn, text, row_id, n,
         length(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]*)+)', 1), '[^>]', '', 'g')) AS level,
         regexp_replace(line, '^[ \t]*((?:>[ \t]*)+)', '') AS bare
  FROM (SELECT *, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n
        FROM (SELECT *, row_number() OVER () AS row_id FROM conversations))
), runs AS (
  SELECT *, sum(CASE WHEN trim(bare) = '' OR level IS DISTINCT FROM before OR trim(bare_before) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY n) AS run
  FROM (SELECT *, lag(level) OVER w AS before, lag(bare) OVER w AS bare_before FROM lines WINDOW w AS (PARTITION BY row_id ORDER BY n))
), passages AS (
  SELECT row_id, conv_id, turn, level, md5(trim(regexp_replace(lower(string_agg(bare, chr(10) ORDER BY n)), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS hash
  FROM runs WHERE trim(bare) <> '' GROUP BY row_id, conv_id, turn, level, run
), bodies AS (
  SELECT row_id, conv_id, turn, role, text,
         coalesce(trim(regexp_replace((SELECT string_agg(bare, chr(10) ORDER BY n) FROM lines l WHERE l.row_id = c.row_id AND level = 0), '\n\\s*\n\\s*', chr(10) || chr(10), 'g')), '') AS body
  FROM (SELECT *, row_number() OVER () AS row_id FROM conversations) c
), firsts AS (
  SELECT conv_id, hash, min(turn) AS original FROM (
    SELECT p.conv_id, p.turn, hash FROM passages p WHERE level = 0
    UNION ALL
    SELECT conv_id, turn, md5(trim(regexp_replace(lower(body), '[ \t\n\x0B\f\r]+', ' ', 'g'))) FROM bodies WHERE body <> ''
  ) GROUP BY conv_id, hash
), linked AS (
  SELECT p.row_id, p.conv_id, p.turn, level, original FROM passages p JOIN firsts f ON p.conv_id = f.conv_id AND p.hash = f.hash
  WHERE level > 0 AND original < p.turn
), replies AS (
  SELECT row_id, conv_id, turn, count(*) AS n_linked, arg_max(original, -level * 1000000000 + original) AS reply_to FROM linked GROUP BY row_id, conv_id, turn
), ups AS (
  SELECT conv_id, turn, min(reply_to) AS up FROM replies GROUP BY conv_id, turn
), climb AS (
  SELECT row_id, conv_id, reply_to AS above FROM replies
  UNION ALL
  SELECT c.row_id, c.conv_id, u.up FROM climb c JOIN ups u ON c.conv_id = u.conv_id AND c.above = u.turn
), told AS (
  SELECT row_id, count(*) AS n_quotes, max(level) AS quote_depth FROM passages WHERE level > 0 GROUP BY row_id
)
SELECT b.conv_id, b.turn, role, reply_to, coalesce((SELECT min(above) FROM climb c WHERE c.row_id = b.row_id), b.turn) AS thread,
       coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, coalesce(quote_depth, 0) AS quote_depth,
       body, '<|' || replace(coalesce(role, ''), '<|', '< |') || '|>' || chr(10) || replace(body, '<|', '< |') AS formatted
FROM bodies b LEFT JOIN replies r ON b.row_id = r.row_id LEFT JOIN told t ON b.row_id = t.row_id
"""


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cotrain.score(docs, cotrain.fit(docs, table(spark, sf_dir, "labels")))


#: Fixed values of the query: the rules, and domains of spam, betting, tracking and adult sites.
URL_RULES = [
    urlfilter.Rule("com", "/", "allow"),
    urlfilter.Rule("example.com", "/en/", "block"),
    urlfilter.Rule("www.example.com", "/en/", "allow"),
    urlfilter.Rule("net", "/es/", "block"),
    urlfilter.Rule("net", "/fr/", "block"),
]
LISTED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_TOPS = ("com", "net", "org")
#: Each name stands alone and with a number below this.
LISTED_NUMBERS = 200


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), listed_domains(spark), URL_RULES)


def listed_domains(spark: SparkSession) -> DataFrame:
    """3,618 domains: adult-x.example.com, adult-x-0.example.com and so on."""
    names = spark.createDataFrame([(n, t) for n in LISTED_NAMES for t in LISTED_TOPS], "name string, top string")
    numbers = F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(0), F.lit(LISTED_NUMBERS - 1)), lambda i: F.concat(F.lit("-"), i))))
    return names.select("name", "top", numbers.alias("number")).select(F.concat("name", "number", F.lit(".example."), "top").alias("key"))


OP5_SQL = f"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(rule_host, rule_path, ruled) AS (
  VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in URL_RULES)}
), fits AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(ruled, length(rule_host || rule_path)) AS ruled
  FROM (SELECT DISTINCT host, path FROM parts), rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
), domains AS (
  SELECT name || number || '.example.' || top AS domain
  FROM (VALUES {", ".join(f"('{n}')" for n in LISTED_NAMES)}) AS a(name), (VALUES {", ".join(f"('{t}')" for t in LISTED_TOPS)}) AS b(top),
       (SELECT '' AS number UNION ALL SELECT '-' || i FROM range({LISTED_NUMBERS}) AS r(i)) AS c
), seen AS (
  SELECT host, bool_or(host = domain OR ends_with(host, '.' || domain)) AS listed
  FROM (SELECT DISTINCT host FROM parts), domains
  GROUP BY host
)
SELECT page_id, p.host, p.path, rule, coalesce(ruled, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM parts p LEFT JOIN fits f ON p.host = f.host AND p.path = f.path JOIN seen s ON p.host = s.host
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), id_bucket("doc_id", 10) == 0)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.learn_from(docs, table(spark, sf_dir, "labels")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache stays in the shared folder, one for each input folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark)
    cache = f"{shared}/token-counts-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    return tokencount.count(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, number = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    label = F.when(number % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(vectors, number % 50 == 0, label=label)


#: The same by the scores of all rows with each anchor.
OP12_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))), false)
), scores AS (
  SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor, other AS positive, score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5
)
SELECT p.anchor AS anchor_id, positive AS positive_id, (row_number() OVER w)::INTEGER AS rank, other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON p.anchor = s.anchor AND NOT same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor, positive ORDER BY s.score DESC, other) QUALIFY row_number() OVER w <= 3
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.build(*trie.rebuilt(trie.ordered(table(spark, sf_dir, "conversations"))))


#: The same by the digests of all beginnings of all conversations.
OP13_SQL = """
WITH turns AS (
  SELECT conv_id, key, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS pos
  FROM (SELECT conv_id, turn, sha256(strlen(role) || ':' || role || text) AS key, length(text) AS n
        FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))
), ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
      list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), sizes AS (
  SELECT i.conv_id, base, h, (SELECT count(*) FROM turns t WHERE t.conv_id = base AND pos <= h) AS have FROM ids i
), rows AS (
  SELECT i.conv_id, pos AS depth, key, n FROM sizes i JOIN turns t ON t.conv_id = base WHERE pos <= h
  UNION ALL
  SELECT i.conv_id, pos - h + have, key, n FROM sizes i JOIN turns t ON t.conv_id = i.conv_id WHERE pos > h
), members AS (
  SELECT conv_id, depth, n, string_agg(key, '') OVER w AS path, coalesce(string_agg(key, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS above
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
  UNION ALL
  SELECT conv_id, 0, 0, '', NULL FROM ids
), nodes AS (
  SELECT path, depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS own FROM members GROUP BY path, depth
), tops AS (
  SELECT above AS path, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above
), pairs AS (
  SELECT DISTINCT a.path, b.path AS below FROM members a JOIN members b ON a.conv_id = b.conv_id AND b.depth >= a.depth
), sums AS (
  SELECT p.path, count(*) FILTER (n_children IS NULL) AS n_leaves, sum(own) AS saved FROM pairs p JOIN nodes n ON n.path = p.below LEFT JOIN tops t ON t.path = p.below GROUP BY p.path
), ends AS (
  SELECT path, sha256(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id)) AS hash
  FROM members m JOIN (SELECT conv_id, max(depth) AS size FROM members GROUP BY conv_id) s ON m.conv_id = s.conv_id AND m.depth = s.size GROUP BY path
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(hash, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes u ON u.path = n.above LEFT JOIN tops t ON t.path = n.path JOIN sums s ON s.path = n.path LEFT JOIN ends e ON e.path = n.path
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_language_id": op2_language_id,
        "op3_chat_formatting": op3_chat_formatting,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_url_filter": op5_url_filter,
        "op6_simhash": op6_simhash,
        "op7_secrets": op7_secrets,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_quality_rules": op9_quality_rules,
        "op10_decontamination": op10_decontamination,
        "op11_token_counts": op11_token_counts,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_chat_formatting": OP3_SQL,
        "op5_url_filter": OP5_SQL,
        "op12_hard_negatives": OP12_SQL,
        "op13_prefix_trie": OP13_SQL,
    }
