import time

import pyspark.sql.functions as F
import pytest

from corpusmill.functions import json as J
from corpusmill.functions import legal as G
from corpusmill.functions import text as T
from corpusmill.functions import values as V
from corpusmill.operators import chunking as C
from corpusmill.sources import readers, sinks
from corpusmill.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw,want",
    [("12.500", 12500.0), ("1.234,56 €", 1234.56), ("1,234.56", 1234.56), ("0,5 %", 0.5), ("-3,25 EUR", -3.25), ("1.234.567", None), ("12.5", 12.5), ("keine", None), ("1,234,567", None), ("1 234,5 Euro", 1234.5), ("12 Prozent", 12.0), ("1,234,567.5", 1234567.5)],
)
def test_german_numbers(spark, raw, want):
    assert one(spark, V.german_number(F.lit(raw))) == want


def test_clean_text(spark):
    assert one(spark, T.clean_text(F.lit("a\n\n\n\nb    c [Picture] $ 12 Abs. 3 Wort- teil und Ober- und Unter- Haus "))) == "a\n\nb  c  § 12 Abs. 3 Wortteil und Ober- und Unter- Haus"


def test_clean_text_of_long_words_is_linear(spark):
    """As the pattern that takes the whole word before the hyphen, but without scanning the word from each of its letters."""
    texts = [*(f"{a}- {b}- {c}" for a in ("a", "ab", "ä_1") for b in ("d", "de", "def", "und", "Xy") for c in ("f", "fg")), "ab- c- de- fg", "x-- yz", "ab -  cd", "\U0001d41b\U0001d41b- \U0001d41b", "e\u0301- f- g"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.regexp_replace("t", r"(?U)(\w{2,})- (?![uob]|\p{Lu})(\w)", "$1$2")
    assert [r.t for r in rows.select("t", T.clean_text(F.col("t")).alias("x"), whole.alias("y")).where("x <> y").collect()] == []
    began = time.time()
    assert spark.range(1).select(F.length(T.clean_text(F.repeat(F.concat(F.lit("_a"), "id"), F.lit(100_000)))).alias("n")).first().n == 300_000
    assert time.time() - began < 20


def test_think_and_json(spark):
    assert one(spark, T.strip_think(F.lit("<think>x</think> a <think>open"))) == "a"
    assert one(spark, J.salvage_json(F.lit('see ```json\n{"a": [1, 2,], }\n```'))) == '{"a": [1, 2] }'


def test_parcels(spark):
    assert one(spark, V.parcel_number(F.lit("0012 - 3"))) == "12/3"
    assert one(spark, V.parcel_number(F.lit("12345"))) == "12/345"
    assert one(spark, V.parcel_id(F.lit("Gemarkung Foo"), F.lit("07"), F.lit("5_6"))) == "foo:7:5/6"


def test_citations(spark):
    fixed = one(spark, V.drop_unknown_citations(F.lit("Eins [C-1]. Zwei [C-7] [M-2]. Drei."), F.array(F.lit("[C-1]"), F.lit("[M-2]"))))
    assert fixed == "Eins [C-1]. Zwei [M-2] (unbelegt). Drei."
    assert one(spark, V.drop_unknown_citations(F.lit(fixed), F.array(F.lit("[C-1]"), F.lit("[M-2]")))) == fixed


def test_states(spark):
    assert one(spark, G.state(F.lit("in Hessen und Bayern"))) == "nordrhein-westfalen"  # "essen" stands in "Hessen"
    assert one(spark, G.state(F.lit("in Hessen und Bayern"), whole_words=True)) == "bayern"
    assert one(spark, G.state(F.lit("Sachsen-Anhalt"))) == "sachsen-anhalt"


def test_sentences_and_chunks():
    text = "Nach § 5 Abs. 2 gilt das z.B. hier. Der Satz endet. Am 3. Mai war es so! (Anm.) Ende"
    assert C.sentences(text) == ["Nach § 5 Abs. 2 gilt das z.B. hier.", "Der Satz endet.", "Am 3.", "Mai war es so!", "(Anm.) Ende"]
    long = " ".join(f"Dies ist der Satz mit der Zahl {i} und noch etwas mehr Text." for i in range(200))
    found = C.chunks(long)
    assert all(long[a:b] == t for _, t, a, b in found) and found[0][2] == 0 and found[-1][3] == len(long)
    assert all(b <= found[i + 1][3] and found[i + 1][2] <= b + 1 for i, (_, _, _, b) in enumerate(found[:-1]))
    assert max(len(t) for _, t, _, _ in found) <= C.CHUNKS.most + C.CHUNKS.overlap
    assert C.chunks("") == [] and C.children("") == [] and C.parents([("", "")]) == []
    kids = C.children(long)
    assert len(kids) > 1 and all(any(s in k for k in kids) for s in C.sentences(long))
    assert [s for s, _ in C.sections("x" * 60 + "\n§ 1 Eins\n§ 2 Zwei")] == ["Einleitung", "§ 1", "§ 2"]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "slug string, n int, t string")
    assert sinks.write_segments(df, str(tmp_path / "seg"), "slug").count() == 2
    more = df.unionByName(spark.createDataFrame([("c", 3, "z")], df.schema))
    sinks.write_segments(more, str(tmp_path / "seg"), "slug")
    assert spark.read.json(str(tmp_path / "seg")).count() == 3
    assert sinks.backup(df, str(tmp_path / "backup"))["rows"] == 2
    sinks.audit_csv(df.withColumn("s", F.struct("n")), str(tmp_path / "audit"), ["slug", "s"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "audit")).where("slug = 'a'").first().s == '{"n":1}'
    sinks.train_val(df.withColumn("val", F.col("n") == 1), str(tmp_path / "split"))
    assert spark.read.json(str(tmp_path / "split" / "val")).count() == 1
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.jsonl").write_text('{"id": 1}\nbroken\n')
    got = readers.read_records(spark, str(tmp_path / "raw"), "id int").collect()
    assert sorted((r.id or 0, r._corrupt is not None) for r in got) == [(0, True), (1, False)]
    assert readers.files(spark, str(tmp_path / "raw"), "*.jsonl").count() == 1


def test_top_up_stream(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    source = streams.files(spark, str(tmp_path / "in"), "id long")
    for _ in range(2):
        streams.top_up(source, lambda df, n: seen.extend(r.id for r in df.collect()), str(tmp_path / "check")).awaitTermination()
    assert sorted(seen) == [0, 1, 2, 3, 4]


def test_watcher(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.pdf", "b.pdf", "c.txt"):
        (tmp_path / "in" / name).write_text(name)
    seen = []
    done = lambda: spark.createDataFrame([("b",), *[(s,) for s in seen]], "stem string")
    go = lambda: streams.watch(spark, str(tmp_path / "in"), "*.pdf", done, lambda df: seen.extend(r.stem for r in df.collect()), str(tmp_path / "check")).awaitTermination()
    go()
    (tmp_path / "in" / "d.pdf").write_text("d")
    go()
    assert seen == ["a", "d"]


def shout(key):
    return key.upper()


def test_registry_source(spark):
    from corpusmill.sources.remote import Registry, with_retry

    spark.dataSource.register(Registry)
    assert {r.key for r in spark.read.format("registry").option("keys", "a,b,c").option("pertask", "2").load().collect()} == {"a", "b", "c"}
    loud = spark.read.format("registry").option("keys", "a,b").option("fetch", "tests.test_units:shout").option("persecond", "50").load()
    assert {r.answer for r in loud.collect()} == {"A", "B"}
    calls = []

    def flaky(key):
        calls.append(key)
        if len(calls) < 3:
            raise ConnectionError
        return "ok"

    assert with_retry(flaky)("k") == "ok" and len(calls) == 3


def test_html_segments(spark):
    html = "<nav><p>menu items here</p></nav><h1>Title one</h1><p>First <b>text</b> &amp; more</p><li>item text</li><h2>Second</h2><p>tiny</p><p>Last text"
    got = [(s.section, s.type, s.text) for s in one(spark, readers.html_segments(F.lit(html + "</p>")))]
    assert got == [("Title one", "section_header", "Title one"), ("Title one", "text", "First text & more"), ("Title one", "text", "item text"), ("Second", "section_header", "Second"), ("Second", "text", "Last text")]


def test_project_area(spark):
    from corpusmill.functions import geo

    none = F.array().cast("array<array<double>>")
    area = one(spark, geo.project_area(none, none, F.lit(50.0), F.lit(9.0)))
    assert (len(area.ring), area.source) == (32, "center_buffer")
    assert one(spark, geo.project_area(none, none, F.lit(None).cast("double"), F.lit(9.0))).source == "none"


def test_places_in_groups_of_any_size(spark):
    from corpusmill.operators import feed, ranking

    rows = [("hot" if i % 3 else None if i % 2 else f"g{i % 5}", (i * 7919) % 1009, i) for i in range(1200)]
    frame = spark.createDataFrame(rows, "g string, v int, i int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.i: r.place for r in ranking.placed(frame, ["g"], [F.desc("v"), F.col("i")]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for g in {r[0] for r in rows}:
        want |= {i: n for n, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1)}
    assert got == want
    named = feed.numbered(frame.where("g is not null"), "g", [F.col("i")], "x-%d").where("g = 'hot'")
    assert {r.id for r in named.collect()} == {f"x-{n}" for n in range(1, 801)}
