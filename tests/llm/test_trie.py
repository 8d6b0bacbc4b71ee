import hashlib
import random
import zlib

import pytest

from corpusmill.llm import trie
from corpusmill.llm.queries import OP13_SQL, op13_prefix_trie
from tests.llm.oracle import compare, connect


def key(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain_turns(rows):
    own = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, key(*r[2:]))):
        own.setdefault(conv, []).append((role or "", text or ""))
    return own


def plain_rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain_nodes(convs):
    """By all beginnings of all conversations, and recursion."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    out, sums = set(), {}
    for path in sorted(members, key=len, reverse=True):
        below = [sums[p] for p in children.get(path, [])]
        saved = ((len(members[path]) - 1) * len(path[-1][1]) if path else 0) + sum(s for _, s in below)
        sums[path] = (sum(n for n, _ in below) or 1, saved)
        ends = sorted(c for c in members[path] if len(convs[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.add((min(members[path]), len(path), parent, len(members[path]), len(below), *sums[path], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, depth int")


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def odd_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(95, 130), 200, 201, 205, 302, 303, 411, -5, -100, -103]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", None, "a"]), rng.choice(["", None, "é語", "yes", "no " * 40])))
    rows += [(700 + i, t, "user", f"copy {t}") for i in range(60) for t in range(9)]  # copies of one conversation
    rows += [(302, 3, "user", "again")] * 3 + [(None, 1, "user", "no id")] * 2
    rng.shuffle(rows)
    return rows


def test_odd_rows_and_hot_copies(spark):
    rows = odd_rows(1)
    turns = trie.ordered(frame(spark, rows))
    assert found(trie.build(*trie.rebuilt(turns))) == plain_nodes(plain_rebuilt(plain_turns(rows)))
    assert found(trie.build(turns, turns.where("depth = 1").select("conv_id"))) == plain_nodes(plain_turns(rows))


def test_deep_branches_by_bands(spark, monkeypatch):
    monkeypatch.setattr(trie, "_BAND", 3)
    monkeypatch.setattr(trie, "_UNION", 3)
    rows = [(c, t, "u", f"same {t}" if t < 8 + c or t == 11 else f"own {c}") for c in range(4) for t in range(12)]
    turns = trie.ordered(frame(spark, rows))
    assert found(trie.build(turns, turns.where("depth = 1").select("conv_id"))) == plain_nodes(plain_turns(rows))


def test_turns_of_one_conversation_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(trie, "_COPIES", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(5, i % 97, "u", "x" * (i % 13)) for i in range(1000)] + [(4, 0, "u", "first"), (6, 0, "u", "last")] + [(6, 1, "u", "rep")] * 40
    try:
        got = sorted(((r.conv_id, r.depth, bytes(r.key), r.n, r.upto) for r in trie.ordered(frame(spark, rows)).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for c, turns in plain_turns(rows).items():
        upto = 0
        for d, (role, text) in enumerate(turns, 1):
            upto += len(text)
            want.append((c, d, key(role, text), len(text), upto))
    assert got == sorted(want)


def test_long_lists_of_members_in_pieces(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = [(c, 0, "u", "same" if c % 3 else f"{c}") for c in range(1000)]
        turns = trie.ordered(frame(spark, rows))
        assert found(trie.build(turns, turns.where("depth = 1").select("conv_id"))) == plain_nodes(plain_turns(rows))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table(spark):
    turns = trie.ordered(frame(spark, []))
    assert trie.build(turns, turns.select("conv_id")).collect() == []


@pytest.mark.parametrize("folder", ["sf0.001"])
def test_sql(spark, folder):
    path = f"/root/testdata/{folder}"
    assert compare(op13_prefix_trie(spark, path), connect(path), OP13_SQL) > 40
