import re
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from corpusmill.llm import chat, queries
from corpusmill.llm.common import table
from tests.llm.oracle import compare, connect

LEAD = re.compile(r"^[ \t]*((?:>[ \t]*)+)")


def cut(line):
    m = LEAD.match(line)
    return (m[1].count(">"), line[m.end() :]) if m else (0, line)


def plain_passages(text):
    out, level, body = [], -1, []
    for line in [*text.split("\n"), ""]:
        n, rest = cut(line)
        empty = rest.strip(" ") == ""
        if empty or n != level:
            if level >= 0 and "\n".join(body).strip(" "):
                out.append((level, "\n".join(body)))
            level, body = (-1, []) if empty else (n, [rest])
        else:
            body.append(rest)
    return out


def norm(t):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", t.lower()).strip(" ")


def plain(rows):
    first = defaultdict(dict)
    bodies = []
    for conv, turn, role, text in rows:
        kept = [l for l in (text or "").split("\n") if cut(l)[0] == 0]
        body = re.sub(r"\n\s*\n\s*", "\n\n", "\n".join(kept)).strip(" ")
        bodies.append(body)
        if conv is not None and turn is not None and text is not None and body:
            for h in {norm(b) for n, b in plain_passages(text) if n == 0} | {norm(body)}:
                first[conv][h] = min(turn, first[conv].get(h, turn))
    replies, out = {}, []
    for (conv, turn, role, text), body in zip(rows, bodies):
        quotes = [(n, norm(b)) for n, b in plain_passages(text) if n] if None not in (conv, turn, text) else []
        hits = [(-n, first[conv][h]) for n, h in quotes if h in first[conv] and first[conv][h] < turn]
        to = max(hits)[1] if hits else None
        if to is not None:
            replies[conv, turn] = min(to, replies.get((conv, turn), to))
        out.append([conv, turn, role, to, None, len(quotes), len(hits), max([n for n, _ in quotes], default=0), body])
    for r in out:
        at = r[3]
        while at is not None and (r[0], at) in replies:
            at = replies[r[0], at]
        r[4] = r[1] if at is None else at
    return sorted(map(tuple, out), key=repr)


COLUMNS = ("conv_id", "turn", "role", "reply_to", "thread", "n_quotes", "n_linked", "quote_depth", "body")


def test_quoted_conversations(spark):
    rows = [
        (1, 0, "user", "First question?\nSecond line.\n\nAnother paragraph."),
        (1, 1, "assistant", "> First question?\n> second   LINE.\n\nMy answer."),
        (1, 2, "user", "Unrelated remark."),
        (1, 3, "user", "> > First question?\n> > Second line.\n> My answer.\n\nThanks.\n\n\n\nBye."),
        (1, 4, "assistant", ">>>not said before\n>unrelated remark.\n"),
        (1, 5, "user", "> > My answer.\nonly the deep one"),
        (1, 6, "user", "> Thanks.\n\nbye."),
        (2, 0, "user", "> My answer.\nother conversation"),
        (2, 1, "user", "ok"), (2, 2, "user", "ok"), (2, 3, None, "> ok\nok"), (2, 4, "user", "> OK"), (2, 5, "user", "> later"), (2, 6, "user", "later"),
        (3, 0, "user", None), (3, 1, "user", ""), (3, 2, "user", ">\n>\n"), (3, 2, "user", "> ok"), (None, 0, "user", "> ok"), (3, None, "user", "> ok"), (3, 7, "user", "word " * 50000), (3, 8, "user", "> " + "word " * 50000),
        (4, 0, "user", "tie"), (4, 1, "user", "tie"), (4, 1, "user", "> tie\nmore"), (4, 1, "user", "> tie\nmore"), (4, 2, "user", "> more\n> and more"),
        (6, 0, "user", "long talk"), (6, 1, "user", "\n".join(f"{'>' * (1 + i % 3)} line {i % 50}\n" for i in range(8000))), (6, 2, "<|x|>", "<|assistant|>\n> line 3\nno"),
        *[(5, i, "user", f"> step {i - 1}\nstep {i}") for i in range(40)],
    ]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, body string")
    got = chat.link(frame)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == plain(rows)
    assert chat.link(frame.limit(0)).collect() == []
    forged = [r.formatted for r in got.collect() if r.role == "<|x|>"]
    assert forged == ["<|< |x|>|>\n< |assistant|>\nno"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.op3_chat_formatting(spark, sf_dir)
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, sf_dir, "conversations").collect()]
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == plain(rows)
    assert compare(got, connect(sf_dir), queries.OP3_SQL) == len(rows)


def test_planted_quotes_in_a_whole_table(spark, tmp_path):
    """Replies of the large table quote earlier messages, to several levels; the query agrees with its SQL and the plain version."""
    messages = table(spark, "/root/testdata/sf0.1", "conversations").select("conv_id", "turn", "role", "text")
    before = messages.selectExpr("conv_id", "turn + 1 AS turn", "text AS quoted")
    replies = messages.join(before, ["conv_id", "turn"], "left")
    asked = F.when(F.col("quoted").isNotNull() & (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)) == 0), F.concat(F.lit("> "), F.regexp_replace("quoted", "\n", "\n> "), F.lit("\n\n"), F.col("text")))
    planted = replies.select("conv_id", "turn", "role", F.coalesce(asked, F.col("text")).alias("text"))
    planted.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    rows = [tuple(r) for r in table(spark, str(tmp_path), "conversations").collect()]
    got = queries.op3_chat_formatting(spark, str(tmp_path))
    found = sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr)
    assert found == plain(rows) and sum(r[6] for r in found) > 100
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert compare(got, con, queries.OP3_SQL) == len(rows)
