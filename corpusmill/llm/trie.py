"""A prefix trie of conversations, built level by level.

A node is a distinct sequence of first turns; its name is the least conversation that begins
with it, together with its depth. Level by level, live conversations are grouped by their
node and their next turn: every group is a node of the next level, named by its least
member. Then levels are joined upwards, each to the sums of its children: nodes, leaves and
saved tokens.

A conversation is live while its node's members still differ further down. Where all members
of a node go on alike (one member, or copies of one conversation) a chain without branches
follows; its nodes are those of one member's further turns and are written from these at once.
So there are as many levels as the deepest branching has turns, and a level's work is that
of the conversations that still branch.

Turns go by digests; no conversation and no node's members are gathered into one value or one
task. Groups are minima and counts, summed before the shuffle, joined back by plain equi-joins.
Numbers of turns come from sorted ranges, in which a conversation of any length may lie across
many. Digests of members are read in order from sorted ranges, in pieces; the pieces of one
node meet in one task, which holds one piece at a time, as a digest of one text must.

Defined results: a null role or text counts as empty; rows without a conversation take no
part. Turns of one number are ordered by the digest of role and text; repeated rows are as
many turns. A conversation without turns is a member of the root alone. An empty table has no
nodes. Turns of any length are digested whole; other columns are not read, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import checkpointed

#: Repeated rows that become turns at once.
_COPIES = 10_000
#: Levels read from one written band of turns, and frames that one union holds.
_BAND, _UNION = 16, 16


def ordered(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, depth, key, n, upto): each conversation's turns numbered from 1 in order, null turns first.

    key is the digest of role and text, n the text's code points, upto their sum so far.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = messages.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"), key.alias("key"), F.char_length(text).cast("bigint").alias("n"))
    distinct = rows.groupBy("conv_id", "turn", "key", "n").agg(F.count("*").alias("times"))
    ranges = checkpointed(distinct.repartitionByRange("conv_id", "turn", "key").withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("range", "conv_id").orderBy("turn", "key").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranges.withColumn("last", F.sum("times").over(inside)).withColumn("sum", F.sum(F.col("times") * F.col("n")).over(inside))
    sizes = ranges.groupBy("range", "conv_id").agg(F.sum("times").alias("rows"), F.sum(F.col("times") * F.col("n")).alias("total"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # Ranges lie side by side, so at most one conversation of a range began in an earlier one: no more rows than ranges.
    begun = sizes.withColumn("rows", F.sum("rows").over(earlier)).withColumn("total", F.sum("total").over(earlier)).where("rows > 0")
    found = placed.join(F.broadcast(begun), ["range", "conv_id"], "left").withColumns({"rows": F.coalesce("rows", F.lit(0)), "total": F.coalesce("total", F.lit(0))})
    found = found.withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"(times - 1) div {_COPIES}"))))
    copy = F.explode(F.sequence(F.col("block") * _COPIES, F.least(F.col("times"), (F.col("block") + 1) * _COPIES) - 1))
    found = found.withColumn("copy", copy).withColumn("left", F.col("times") - 1 - F.col("copy"))
    return found.select("conv_id", (F.col("rows") + F.col("last") - F.col("left")).alias("depth"), "key", "n", (F.col("total") + F.col("sum") - F.col("left") * F.col("n")).alias("upto"))


def merged(frames: list[DataFrame]) -> DataFrame:
    """The union of many frames, with a plan and a number of tasks that stay small."""
    parts = int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while len(frames) > _UNION:
        frames = [checkpointed(reduce(DataFrame.unionByName, frames[i : i + _UNION])).coalesce(parts) for i in range(0, len(frames), _UNION)]
    return reduce(DataFrame.unionByName, frames)


def _uniform() -> Column:
    """Whether all members of a group are one sequence: of one length, with the same turns."""
    return F.expr(" AND ".join(f"min({c}) = max({c})" for c in ("size", "mark", "mark2")))


def _levels(turns: DataFrame, members: DataFrame) -> list[DataFrame]:
    """For each depth a row for each live conversation: conv_id, size, total, marks, parent, node, n_convs, n, upto, uniform."""
    root = members.agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), _uniform().alias("uniform")).first()
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    level = checkpointed(members.withColumns({"parent": none, "n": zero, "upto": zero, "node": F.lit(root.node).cast("bigint"), "n_convs": F.lit(root.n_convs), "uniform": F.lit(root.uniform).cast("boolean")}))
    levels, rest, band = [level], turns, turns
    while True:
        depth = len(levels)
        live = level.where(~F.col("uniform") & (F.col("size") >= depth)).select("conv_id", "size", "total", "mark", "mark2", F.col("node").alias("parent"))
        if live.isEmpty():
            return levels
        if depth % _BAND == 0:
            rest = checkpointed(rest.where(F.col("depth") >= depth).join(live.select("conv_id"), "conv_id", "left_semi"))
            band = checkpointed(rest.where(F.col("depth") < depth + _BAND))
        step = live.join(band.where(F.col("depth") == depth).drop("depth"), "conv_id")
        groups = step.groupBy("parent", "key").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), _uniform().alias("uniform"))
        level = checkpointed(step.join(groups, ["parent", "key"]).drop("key"))
        levels.append(level)


def _rolled(levels: list[DataFrame]) -> list[DataFrame]:
    """Nodes of the levels with the sums of their subtrees, from the deepest level up."""
    out, below = [], None
    for depth in range(len(levels) - 1, -1, -1):
        heads = levels[depth].where("conv_id = node").select("conv_id", F.lit(depth).cast("bigint").alias("depth"), "parent", "n_convs", "n", "upto", "uniform", "size", "total")
        if below is None:
            below = heads.limit(0).select(F.col("parent").alias("above"), F.col("n").alias("children"), F.col("n").alias("leaves"), F.col("n").alias("saved"))
        joined = heads.join(below, heads.conv_id == below.above, "left")
        own = (F.col("n_convs") - 1) * F.col("n")
        alone = (F.col("n_convs") - 1) * (F.col("total") - F.col("upto") + F.col("n"))
        rolled = joined.select(
            "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs",
            F.when(F.col("uniform"), (F.col("size") > depth).cast("bigint")).otherwise(F.coalesce("children", F.lit(0))).alias("n_children"),
            F.when(F.col("uniform"), F.lit(1)).otherwise(F.coalesce("leaves", F.lit(1))).cast("bigint").alias("n_leaves"),
            F.when(F.col("uniform"), alone).otherwise(own + F.coalesce("saved", F.lit(0))).alias("saved_tokens"),
        )
        if depth:
            sums = rolled.groupBy(F.col("parent_conv_id").alias("above")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            below = checkpointed(sums)
        out.append(rolled)
    return out


def _chains(levels: list[DataFrame], turns: DataFrame) -> DataFrame:
    """The nodes under those whose members go on alike: the further turns of their least members."""
    heads = merged([x.where("uniform and conv_id = node").select("conv_id", F.lit(d).cast("bigint").alias("from"), "n_convs", "size", "total") for d, x in enumerate(levels)])
    below = heads.join(turns, "conv_id").where("depth > from")
    return below.select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), "n_convs", (F.col("depth") < F.col("size")).cast("bigint").alias("n_children"),
        F.lit(1).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * (F.col("total") - F.col("upto") + F.col("n"))).alias("saved_tokens"),
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, depth, conv_id) in order -> pieces of at most a batch: node, depth, the first conv_id, decimals joined by commas."""
    for batch in batches:
        nodes, depths, ids = (c.to_pylist() for c in batch.columns)
        out, start = [], 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or nodes[i] != nodes[start] or depths[i] != depths[start]:
                out.append((nodes[start], depths[start], ids[start], ",".join(map(str, ids[start:i]))))
                start = i
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())], names=["node", "depth", "first", "piece"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order -> a digest for each node."""
    at, state = None, None
    for batch in batches:
        out = []
        for node, depth, _, piece in zip(*(c.to_pylist() for c in batch.columns)):
            if (node, depth) == at:
                state.update(b"," + piece.encode())
                continue
            if at is not None:
                out.append((*at, state.hexdigest()))
            at, state = (node, depth), hashlib.sha256(piece.encode())
        yield _digests(out)
    if at is not None:
        yield _digests([(*at, state.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["node", "end", "ends_sha256"])


def _ends(levels: list[DataFrame]) -> DataFrame:
    """(node, end, ends_sha256) of the nodes at which conversations end."""
    ends = merged([x.where(F.col("uniform") | (F.col("size") == d)).select("node", F.col("size").alias("depth"), "conv_id") for d, x in enumerate(levels)])
    pieces = ends.repartitionByRange("node", "depth", "conv_id").sortWithinPartitions("node", "depth", "conv_id").mapInArrow(_pieces, "node bigint, depth bigint, first bigint, piece string")
    return pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(_hashed, "node bigint, end bigint, ends_sha256 string")


def build(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the trie, from turns as ``ordered`` gives them and conversations (conv_id), each once, with and without turns.

    Columns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    turns = checkpointed(turns)
    sizes = turns.groupBy("conv_id").agg(
        F.max("depth").alias("size"), F.max("upto").alias("total"), F.bit_xor(F.xxhash64("depth", "key")).alias("mark"), F.bit_xor(F.xxhash64(F.lit(7), "key", "depth")).alias("mark2")
    )
    zero = F.lit(0).cast("bigint")
    members = checkpointed(conversations.join(sizes, "conv_id", "left").select("conv_id", *(F.coalesce(c, zero).alias(c) for c in ("size", "total", "mark", "mark2"))))
    levels = _levels(turns, members)
    nodes = merged([*_rolled(levels), _chains(levels, turns)])
    ends = _ends(levels)
    found = nodes.join(ends, (nodes.conv_id == ends.node) & (nodes.depth == ends.end), "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def rebuilt(turns: DataFrame, *, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings, and their ids: each takes the first h turns of the first conversation of its ``every``, then its own after the first h; h is crc32 of its id modulo ``most``."""
    ids = turns.where("depth = 1").select("conv_id")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % F.lit(most)
    asking = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), taken.alias("h"))
    given = turns.where(F.col("depth") < most).withColumnRenamed("conv_id", "base")
    borrowed = checkpointed(asking.join(given, "base").where("depth <= h").select("conv_id", "depth", "key", "n", "upto"))
    before = borrowed.groupBy("conv_id").agg(F.count("*").alias("have"), F.sum("n").alias("gain"))
    own = turns.withColumn("h", taken)
    left = own.where("depth <= h").groupBy("conv_id").agg(F.sum("n").alias("loss"))
    shift = before.join(left, "conv_id", "full_outer").select("conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("have", "gain", "loss")))
    rest = own.where("depth > h").join(shift, "conv_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("have", "gain", "loss")})
    rest = rest.select("conv_id", (F.col("depth") - F.col("h") + F.col("have")).alias("depth"), "key", "n", (F.col("upto") - F.col("loss") + F.col("gain")).alias("upto"))
    return borrowed.unionByName(rest), ids
