"""Repair of JSON that a model wrote, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings (perhaps cut off), brackets, commas, white space, and all else.
TOKEN = r'(?s)"(?:[^"\\]|\\.)*+"?|[{}\[\]]|,|\s++|[^"{}\[\],\s]++'


def _tokens_from_start(text: Column) -> Column:
    return F.regexp_extract_all(F.regexp_extract(text, r"(?s)[{\[].*", 0), F.lit(TOKEN), F.lit(0))


def _ends(tokens: Column) -> Column:
    """(n, closers): tokens up to the partner of the first bracket, and what would close those still open.

    Every closing bracket counts as a partner for the end; only the right one closes what is open.
    """
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(False).alias("done"), F.lit("").alias("closers"))

    def step(acc: Column, token: Column) -> Column:
        opens, closes = token.isin("{", "["), token.isin("}", "]")
        depth = acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        closers = F.when(opens, F.concat(F.when(token == "{", "}").otherwise("]"), acc["closers"])).when(closes & (F.substring(acc["closers"], 1, 1) == token), F.substring(acc["closers"], 2, 1 << 30)).otherwise(acc["closers"])
        after = F.struct((acc["n"] + 1).alias("n"), depth.alias("depth"), (closes & (depth == 0)).alias("done"), closers.alias("closers"))
        return F.when(acc["done"], acc).otherwise(after)

    return F.aggregate(tokens, start, step)


def _repaired(tokens: Column) -> Column:
    end = F.transform(F.array(_ends(tokens)), lambda e: F.struct(F.slice(tokens, 1, e["n"]).alias("kept"), e["closers"].alias("closers")))

    def joined(x: Column) -> Column:
        kept = x["kept"]
        blank = lambda t: t.rlike(r"^\s+$")
        after = lambda i: F.when(blank(F.get(kept, i + 1)), F.get(kept, i + 2)).otherwise(F.get(kept, i + 1))
        out = F.filter(kept, lambda t, i: ~((t == ",") & F.coalesce(after(i).isin("}", "]"), F.lit(False))))
        last = F.try_element_at(kept, F.lit(-1))
        cut = last.startswith('"') & ~last.rlike(r'(?s)^"(?:[^"\\]|\\.)*+"$')
        return F.concat(F.array_join(out, ""), F.when(F.coalesce(cut, F.lit(False)), '"').otherwise(""), x["closers"])

    return F.transform(end, joined)[0]


def salvage_json(text: Column) -> Column:
    """JSON text that parses, or null.

    A single string, number or word stays. Else a fence around the whole goes; from the first bracket to its
    partner, commas before closing brackets go, and a string and brackets left open are closed. Strings are
    never changed, and nor is what is well-formed. Repeated keys of one object don't parse.
    """
    fenced = F.regexp_extract(text, r"(?s)^\s*```(?:json|JSON)?\s*\n?(.*?)\n?\s*```\s*$", 1)
    bare = F.when(text.rlike(r"(?s)^\s*```.*```\s*$"), fenced).otherwise(text)
    repaired = F.transform(F.array(_tokens_from_start(bare)), _repaired)[0]
    parses = lambda t: F.try_parse_json(t).isNotNull()
    single = text.rlike(r'(?s)^\s*(?:"(?:[^"\\]|\\.)*+"|-?\d[\d.eE+-]*|true|false|null)\s*$')
    return F.when(single, F.when(parses(text), text)).when(bare.rlike(r"[{\[]"), F.transform(F.array(repaired), lambda t: F.when(parses(t), t))[0])
