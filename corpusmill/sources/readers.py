"""Readers and converters to document records. Paths may be any that Spark reads; nothing is opened on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import clean_text, html_to_text
from corpusmill.session import checkpointed

#: Path prefixes, language and type; the first that fits wins.
ROUTES = (
    ("de/gesetzes/", "de", "gesetz"),
    ("de/TA ", "de", "technische_anleitung"),
    ("en/english/", "en", "regulation"),
    ("DD Reports/", "de", "dd_report"),
    ("VDRs/", "de", "vdr"),
    ("Libary/", "de", "fachbuch"),
    ("rss/", "de", "bgbl_update"),
    ("legal_data/hf_cases/", "de", "urteil"),
    ("legal_data/openlegaldata", "de", "urteil"),
    ("legal_data/gerdalir", "de", "legal_corpus"),
    ("legal_data/german_ler", "de", "ner_corpus"),
    ("legal_data/multilegalpile", "multi", "legal_corpus"),
)
#: Parts of a path that name a converter, in order, and then extensions.
NAMED_CONVERTERS = ("multilegalpile", "hf_cases", "openlegaldata", "gerdalir", "german_ler")
EXTENSIONS = {
    "docling": (".pdf", ".docx", ".pptx", ".xlsx", ".txt", ".md", ".html", ".htm"),
    "legacy": (".doc", ".ppt", ".xls"),
    "json_generic": (".json",),
    "jsonl_generic": (".jsonl",),
}


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files under a path, without folder marks."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return listed.where(~F.col("path").endswith("/.folder"))


def language_and_type(path: Column) -> Column:
    """By the first prefix that fits; German documents else."""
    hit = F.coalesce(*[F.when(path.startswith(p), F.struct(F.lit(lang).alias("language"), F.lit(kind).alias("doc_type"))) for p, lang, kind in ROUTES])
    return F.coalesce(hit, F.struct(F.lit("de").alias("language"), F.lit("document").alias("doc_type")))


def source_type(path: Column) -> Column:
    """The converter by a part of the path, or else by its extension; unsupported else (S3)."""
    low = F.lower(path)
    ext = F.regexp_extract(low, r"[^/.][^/]*?(\.[^./]*)$", 1)
    named = [F.when(low.contains(n), F.lit(n)) for n in NAMED_CONVERTERS]
    return F.coalesce(*named, *[F.when(ext.isin(*exts), F.lit(c)) for c, exts in EXTENSIONS.items()], F.lit("unsupported"))


def json_body(content: Column) -> Column:
    """From the first brace, or else bracket, on."""
    at = F.instr(content, "{")
    at = F.when(at > 0, at).otherwise(F.instr(content, "["))
    return F.when(at > 0, F.substring(content, at, F.length(content)))


def json_lines(content: Column) -> Column:
    """The lines that begin with a brace."""
    return F.filter(F.transform(F.split(content, "\n"), lambda line: F.ltrim(line)), lambda line: line.startswith("{"))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; broken ones have ``_corrupt`` set and no fields."""
    return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def first_text(*fields: Column, least: int = 20) -> Column:
    """The first field with enough characters."""
    return F.coalesce(*[F.when(F.length(F.trim(f)) > least, f) for f in fields])


def _case_text(item: Column) -> Column:
    """Markdown, or else HTML as text, or else plain text, cleaned, to be exploded: worked out once a row, none under 20 characters."""
    field = lambda name: F.get_json_object(item, f"$.{name}")
    given = lambda c: F.when(c != "", c)
    text = clean_text(F.coalesce(given(field("markdown_content")), given(F.regexp_replace(html_to_text(given(field("content"))), r"\s+", " ")), given(field("text"))))
    return F.explode(F.filter(F.array(text), lambda t: F.length(t) >= 20))


def case_record(df: DataFrame, json_col: str) -> DataFrame:
    """One court case a body to a document: its text, and its other fields that are single values as metadata."""
    body = json_body(F.col(json_col))
    fields = F.map_filter(F.from_json(body, "map<string,string>"), lambda k, v: ~k.isin("content", "markdown_content", "text", "results") & (v.isNull() | ~v.rlike(r"^\s*[\[{]")))
    return df.select(*df.columns, _case_text(body).alias("text"), F.lit("Content").alias("section"), fields.alias("metadata"))


def case_records(df: DataFrame, json_col: str) -> DataFrame:
    """A dump of court cases to documents: the items of a list, or of ``results``, or the one it is."""
    body = json_body(F.col(json_col))
    results = F.from_json(F.get_json_object(body, "$.results"), "array<string>")
    items = F.when(F.ltrim(body).startswith("["), F.from_json(body, "array<string>")).otherwise(F.coalesce(results, F.array(body)))
    each = df.select(*df.columns, F.posexplode(items).alias("pos", "item"))
    field = lambda path: F.get_json_object("item", path)
    court = F.when(field("$.court").rlike(r"^\s*\{"), field("$.court.name"))
    return each.select(*df.columns, "pos", _case_text(F.col("item")).alias("text"), F.coalesce(field("$.id"), F.lit("")).alias("case_id"), court.alias("court_name"), *[field(f"$.{n}").alias(n) for n in ("date", "file_number", "ecli")])


def line_records(lines: DataFrame, line_col: str, kind: str) -> DataFrame:
    """JSON lines of a collection to segments (text, section, metadata); what is broken, short or of another language goes."""
    line = F.col(line_col)
    field = lambda name: F.get_json_object(line, f"$.{name}")
    none = F.lit(None).cast("map<string,string>")
    empty = lambda name: F.coalesce(field(name), F.lit(""))
    if kind == "multilegalpile":
        ours = (empty("language") == "") | german(field("language"))
        text, section, more = F.when(ours, field("text")), F.lit("Content"), F.create_map(F.lit("jurisdiction"), empty("jurisdiction"), F.lit("mlp_type"), empty("type"))
    elif kind == "gerdalir":
        text, section, more = field("text"), F.coalesce(field("title"), F.lit("Content")), F.create_map(F.lit("original_id"), empty("id"))
    elif kind == "german_ler":
        text, section, more = detokenised(F.from_json(field("tokens"), "array<string>")), F.lit("NER_Sentence"), none
    elif kind == "generic":
        text, section, more = first_text(*map(field, ("text", "content", "body", "document_text"))), F.lit("Content"), none
    else:
        raise ValueError(f"no collection {kind}")
    cleaned = clean_text(text)
    parses = F.try_parse_json(line).isNotNull()
    out = lines.select(*lines.columns, F.when(parses, cleaned).alias("text"), section.alias("section"), more.alias("metadata"))
    return out.where(F.length("text") >= 20)


#: Parts of a parsed document, and what their text counts as.
PARTS = {"texts": "text", "tables": "table", "equations": "equation", "pictures": "picture", "key_value_items": "text"}


def document_tree(df: DataFrame, id_col: str, json_col: str, *, least: int = 5, most_depth: int = 64) -> DataFrame:
    """(id, place, text, section, page_start, page_end, type): a parsed document's segments in reading order.

    The body refers to parts and groups, groups to further ones. A join a level replaces groups by what they hold,
    until none is left; a document nested deeper, or in a circle, raises. Headers and footers of pages go, and the
    last section header counts for what follows it.
    """
    doc = F.col(json_col)
    refs = lambda c: F.from_json(c, "array<struct<`$ref`: string>>")
    items = lambda name: F.from_json(F.get_json_object(doc, f"$.{name}"), "array<string>")
    parts = {**{name: items(name) for name in (*PARTS, "groups")}, "body": F.array(F.get_json_object(doc, "$.body.children"))}
    # A document is read once for all its parts: a union of a pass for each would be read by one task.
    each = df.select(F.col(id_col).alias("id"), F.inline(F.array(*(F.struct(F.lit(name).alias("part"), found.alias("items")) for name, found in parts.items()))))
    each = each.select("id", "part", F.posexplode("items").alias("i", "item"))
    nodes = checkpointed(each.select("id", F.concat(F.lit("#/"), "part", F.lit("/"), "i").alias("ref"), "part", "item"))
    groups = nodes.where("part = 'groups'").select("id", "ref", F.posexplode(refs(F.get_json_object("item", "$.children"))).alias("k", "child"))
    groups = groups.select("id", "ref", "k", F.col("child.`$ref`").alias("child"))
    front = nodes.where("part = 'body'").select("id", F.posexplode(refs(F.col("item"))).alias("k", "child")).select("id", F.array("k").alias("path"), F.col("child.`$ref`").alias("ref"))
    leaves = front.where("ref not like '%/groups/%'")
    front = checkpointed(front.where("ref like '%/groups/%'"))
    depth = 0
    while not front.isEmpty():
        depth += 1
        if depth > most_depth:
            raise ValueError(f"groups within groups to over {most_depth} levels")
        inner = checkpointed(front.join(groups, ["id", "ref"]).select("id", F.concat("path", F.array("k")).alias("path"), F.col("child").alias("ref")))
        leaves, front = leaves.unionByName(inner.where("ref not like '%/groups/%'")), inner.where("ref like '%/groups/%'")
    found = leaves.join(nodes.where("part not in ('groups', 'body')"), ["id", "ref"])
    field = lambda path: F.coalesce(F.get_json_object("item", path), F.lit(""))
    label = field("$.label")
    grid = F.from_json(F.get_json_object("item", "$.data.grid"), "array<array<struct<text: string>>>")
    cells = F.transform(grid, lambda row: F.transform(row, lambda c: F.replace(F.trim(F.coalesce(c["text"], F.lit(""))), F.lit("\n"), F.lit(" "))))
    captions = F.transform(F.from_json(F.get_json_object("item", "$.captions"), "array<struct<text: string>>"), lambda c: F.coalesce(c["text"], F.lit("")))
    content = (
        F.when(F.col("part") == "tables", F.when(F.size(cells) > 0, markdown_table(cells)).otherwise("[Table]"))
        .when(F.col("part") == "pictures", F.array_join(F.coalesce(captions, F.array().cast("array<string>")), "\n"))
        .when(F.col("part") == "key_value_items", F.concat(field("$.key.text"), F.lit(": "), field("$.value.text")))
        .otherwise(field("$.text"))
    )
    pages = F.filter(F.transform(F.from_json(F.get_json_object("item", "$.prov"), "array<struct<page_no: int>>"), lambda p: p["page_no"]), lambda p: p.isNotNull())
    kind = F.coalesce(*[F.when(F.col("part") == n, F.lit(k)) for n, k in PARTS.items()])
    rows = found.where(~label.isin("page_header", "page_footer")).select("id", "path", clean_text(content).alias("text"), F.when((label == "section_header") & (F.trim(field("$.text")) != ""), F.trim(field("$.text"))).alias("header"), F.array_min(pages).alias("page_start"), F.array_max(pages).alias("page_end"), kind.alias("type"))
    before = Window.partitionBy("id").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.withColumn("section", F.coalesce(F.last("header", ignorenulls=True).over(before), F.lit("General"))).where(F.length("text") >= least)
    place = F.row_number().over(Window.partitionBy("id").orderBy("path"))
    return carried.select(F.col("id").alias(id_col), place.alias("place"), "text", "section", "page_start", "page_end", "type")


def markdown_table(rows: Column) -> Column:
    """A grid of cells to a Markdown table with a rule after the head."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(rows[0])))
    lines = F.concat(F.array(line(rows[0]), rule), F.transform(F.slice(rows, 2, 1 << 30), line))
    return F.when(F.size(rows) > 0, F.array_join(lines, "\n")).otherwise(F.lit("[Table]"))


LAW = "struct<norm: array<struct<metadaten: struct<jurabk: string, langue: string, enbez: string, titel: string>, textdaten: struct<text: struct<Content: string>>>>>"


def law_sections(df: DataFrame, xml_col: str) -> DataFrame:
    """Statutes in XML to sections; the first abbreviation and title count, empty sections go."""
    parsed = df.withColumn("__law", F.from_xml(F.col(xml_col), F.lit(LAW)))
    norms = F.col("__law.norm")
    first = lambda f: F.try_element_at(F.filter(F.transform(norms, lambda n: n["metadaten"][f]), lambda x: x.isNotNull()), F.lit(1))
    each = parsed.select(*df.columns, first("jurabk").alias("law"), first("langue").alias("title"), F.posexplode(norms).alias("pos", "n"))
    out = each.select(*df.columns, "law", "title", "pos", F.col("n.metadaten.enbez").alias("enbez"), F.col("n.metadaten.titel").alias("heading"), F.trim(F.col("n.textdaten.text.Content")).alias("content"))
    return out.where("coalesce(enbez, '') <> '' or coalesce(heading, '') <> '' or coalesce(content, '') <> ''")


def contents(df: DataFrame, xml_col: str) -> DataFrame:
    """A table of contents of statutes to (title, slug, url); items without a link go."""
    items = F.from_xml(F.col(xml_col), F.lit("struct<item: array<struct<title: string, link: string>>>"))["item"]
    each = df.select(*df.columns, F.posexplode(items).alias("pos", "i")).withColumn("link", F.trim("i.link")).where(F.col("link") != "")
    parts = F.split(F.rtrim("link", F.lit("/")), "/")
    slug = F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(parts[0])
    return each.select(*df.columns, "pos", F.coalesce(F.trim("i.title"), F.lit("")).alias("title"), slug.alias("slug"), F.regexp_replace("link", "http://", "https://").alias("url"))


def pos_list(text: Column) -> Column:
    """Coordinates in pairs; what is no number is skipped, an odd one at the end dropped."""
    numbers = F.filter(F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    return F.when(F.size(numbers) >= 2, F.transform(F.sequence(F.lit(1), F.floor(F.size(numbers) / 2).cast("int")), lambda i: F.array(F.element_at(numbers, i * 2 - 1), F.element_at(numbers, i * 2)))).otherwise(F.array().cast("array<array<double>>"))


def parcels_of_gml(df: DataFrame, xml_col: str) -> DataFrame:
    """Cadastral parcels of a GML answer, whatever the prefixes: number, reference, area and outer ring.

    The number is the label, or else the end of the national reference without leading zeros. The first position
    list with numbers is the ring. An answer without parcels, or none at all, gives no rows.
    """
    each = df.select(*df.columns, F.posexplode(F.regexp_extract_all(F.col(xml_col), F.lit(r"(?s)<(?:\w+:)?CadastralParcel\b[^>]*>.*?</(?:\w+:)?CadastralParcel>"), F.lit(0))).alias("pos", "__p"))
    child = lambda name: F.coalesce(F.trim(F.regexp_extract("__p", rf"(?s)<(?:\w+:)?{name}\b[^>]*>\s*([^<]*?)\s*<", 1)), F.lit(""))
    label, reference = child("label"), child("nationalCadastralReference")
    tail = F.regexp_extract(F.regexp_replace(reference, "_+$", ""), r"([^-]*)$", 1)
    bare = F.regexp_replace(tail, "^0+", "")
    rings = F.filter(F.transform(F.regexp_extract_all("__p", F.lit(r"(?s)<(?:\w+:)?posList\b[^>]*>([^<]*)<"), F.lit(1)), pos_list), lambda r: F.size(r) > 0)
    number = F.when(label != "", label).when(bare != "", bare).otherwise(tail)
    ring = F.coalesce(F.get(rings, F.lit(0)), F.array().cast("array<array<double>>"))
    return each.select(*df.columns, "pos", number.alias("number"), F.coalesce(child("areaValue").try_cast("double"), F.lit(0.0)).alias("area"), ring.alias("ring"), reference.alias("reference"))


def parcel_feature(df: DataFrame, json_col: str) -> DataFrame:
    """GeoJSON features to parcels: the first property present counts, of several rings the longest, latitude first."""
    props = lambda *names: F.coalesce(*[F.get_json_object(F.col(json_col), f"$.properties.{n}") for n in names])
    polygon = F.from_json(F.get_json_object(json_col, "$.geometry.coordinates"), "array<array<array<double>>>")
    multi = F.from_json(F.get_json_object(json_col, "$.geometry.coordinates"), "array<array<array<array<double>>>>")
    rings = F.when(F.get_json_object(json_col, "$.geometry.type") == "MultiPolygon", F.transform(multi, lambda p: p[0])).otherwise(F.slice(polygon, 1, 1))
    longest = F.element_at(F.array_sort(F.transform(rings, lambda r, i: F.struct(F.size(r).alias("n"), (-i).alias("o"), r.alias("r")))), -1)["r"]
    return df.select(*df.columns, props("flurstueck", "flstnrzae", "number").alias("number"), props("flur", "field").alias("field"), props("gemarkung", "district").alias("district"), F.transform(longest, lambda p: F.array(p[1], p[0])).alias("ring"))


def file_sets(pdf: DataFrame, md: DataFrame, js: DataFrame) -> DataFrame:
    """The union of stems of three sets of files, with what each has."""
    stem = lambda df, name: df.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), F.lit(True).alias(name)).distinct()
    joined = stem(pdf, "pdf").join(stem(md, "md"), "stem", "full_outer").join(stem(js, "json"), "stem", "full_outer")
    return joined.select("stem", *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("pdf", "md", "json")))


def detokenised(tokens: Column) -> Column:
    """Tokens to text: no blank before closing marks or after opening ones."""
    joined = F.array_join(tokens, " ")
    return F.regexp_replace(F.regexp_replace(joined, r" ([.,;:!?)\]])", "$1"), r"([(\[]) ", "$1")


def german(language: Column) -> Column:
    return F.lower(language).isin("de", "german", "deu")


def html_segments(html: Column, least: int = 5) -> Column:
    """(section, type, text) of a page's headings, paragraphs and items; the last heading carries forward, navigation goes."""
    body = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer)\b.*?</(script|style|nav|header|footer)>", "")
    block = r"(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)(?=</(?:h[1-6]|p|li)>|<(?:h[1-6]|p|li)\b)"
    pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(block), F.lit(1)).alias("tag"), F.regexp_extract_all(body, F.lit(block), F.lit(2)).alias("raw"))
    start = F.struct(F.lit("").alias("section"), F.array().cast("array<struct<section:string,type:string,text:string>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        text, heading = html_to_text(x["raw"]), F.lower(x["tag"]).startswith("h")
        section = F.when(heading, text).otherwise(acc["section"])
        kind = F.when(heading, "section_header").otherwise("text")
        grown = F.concat(acc["out"], F.array(F.struct(section.alias("section"), kind.alias("type"), text.alias("text"))))
        return F.struct(section.alias("section"), F.when(F.length(text) >= least, grown).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pairs, start, add, lambda acc: acc["out"])


def page_text(embedded: Column, recognised: Column, least: int = 40, readable: float = 0.6) -> Column:
    """Embedded text if it is long and readable enough, else recognised text, else none, with its source."""
    from corpusmill.functions.text import readable_ratio

    good = (F.length(embedded) >= least) & (readable_ratio(embedded) >= readable)
    return F.struct(F.when(good, embedded).when(F.length(recognised) > 0, recognised).otherwise("").alias("text"), F.when(good, "embedded").when(F.length(recognised) > 0, "ocr").otherwise("empty").alias("source"))
