import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import queries, urlfilter
from corpusmill.llm.common import table
from tests.llm.oracle import compare, connect


def plain(url, listed, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text), default=None)
    hit = any(host == d or host.endswith("." + d) for d in listed)
    return host, path, best and best.text, best.verdict if best else "block" if hit else "allow"


URLS = [None, "", "no scheme/com/", "http://", "http:///x", "HTTP://WWW.Example.COM/en/1", "https://a.example.com/en/", "http://example.com/en", "x://com/", "x://com", "http://b.net/es/1?x#y", "http://net/fr/", "http://b.net/de/#a://c", "a://b://c.net/es/", "http://ÀB.org/Ü?q", "http://m.spam.org/x", "http://spam.org", "http://notspam.org", "http://.org/", "http://a..b.org/\nx", "http://x.org:80/p"]


def test_odd_urls(spark):
    listed = ["spam.org", "b.org", "x.org:80", "unseen.example"]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(URLS)] + [(5, URLS[5], "k")], "page_id long, url string, key string")
    frame = spark.createDataFrame([(d,) for d in [*listed, listed[0]]] + [(None,)], "key string")
    rows = urlfilter.judge(pages, frame, queries.URL_RULES).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == plain(URLS[r.page_id], listed, queries.URL_RULES), URLS[r.page_id]
    assert {r.verdict for r in urlfilter.judge(pages, frame.limit(0), []).collect()} == {"allow"}
    assert urlfilter.judge(pages.limit(0), frame, queries.URL_RULES).collect() == []


def test_hosts_of_many_labels(spark):
    import time

    host = ".".join(f"l{i % 7}" for i in range(100_000))
    urls = [f"http://{host}.{end}/p" for end in ("spam.org", "x.notspam.org", "spam.org.", "de")] + [f"http://{'x' * 500_000}.spam.org", "http://" + "." * 100_000 + "spam.org"]
    listed = ["spam.org", "spam.org.", "l3.l4.l5.de", f"{'l4.l5.l6.l0.l1.l2.l3.l4.' * 3}de"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    began = time.time()
    rows = urlfilter.judge(pages, spark.createDataFrame([(d,) for d in listed], "key string"), []).collect()
    assert time.time() - began < 60  # with all jobs of the cascade
    assert {r.page_id: r.verdict for r in rows} == {i: plain(u, listed, [])[3] for i, u in enumerate(urls)}
    assert {r.verdict for r in rows} == {"allow", "block"}


@pytest.mark.parametrize("rate", [0.5, 0.1, 0.001])
def test_cascade_is_exact_over_its_universe(spark, rate):
    rng = random.Random(rate)
    hosts = [f"h{rng.randint(0, 3000)}.d{rng.randint(0, 60)}.example.org" for _ in range(1500)]
    listed = sorted({".".join(h.split(".")[rng.randint(0, 1) :]) for h in rng.sample(hosts, 40)})
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, h in enumerate(hosts)], "page_id long, url string")
    got = urlfilter.judge(pages, spark.createDataFrame([(d,) for d in listed], "key string"), [], rate=rate)
    for r in got.collect():
        assert r.verdict == plain(f"http://{hosts[r.page_id]}/p", listed, [])[3]


def test_query_matches_its_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert compare(queries.op5_url_filter(spark, sf_dir), connect(sf_dir), queries.OP5_SQL) == 250


def test_levels_alternate(spark):
    sf_dir = "/root/testdata/sf0.001"
    hosts = table(spark, sf_dir, "pages").select(urlfilter.host_of(F.col("url")).alias("host")).distinct()
    universe = hosts.select(F.explode(urlfilter.keys_of(F.col("host"), 40))).distinct()
    cascade = urlfilter.build(universe, queries.listed_domains(spark))
    assert len(cascade.levels) >= 3 and cascade.levels[2].bits > cascade.levels[1].bits
    many = spark.range(20_000).selectExpr("concat('k', id, '.org')")
    deep = urlfilter.build(many, many.where("rand(3) < 0.3"), rate=0.5)
    assert len(deep.levels) > 10


def test_bounds_raise(spark):
    keys = spark.range(2_000).selectExpr("concat('k', id, '.org')")
    with pytest.raises(ValueError, match="bytes"):
        urlfilter.build(keys, keys.limit(1_000), most_bytes=100)
    with pytest.raises(ValueError, match="levels"):
        urlfilter.build(keys, keys.limit(1_000), rate=0.5, most_levels=2)
