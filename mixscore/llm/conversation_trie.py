"""The prefix trie of conversations, built as a burst trie.

Conversations are sequences of turn ids, hashes of role and text. Equal sequences are
merged into one with a weight. A container holds the suffixes below one trie
head; it starts as everything below the root. As long as a container holds
more than `CONTAINER_ROWS` turns of different sequences it bursts: its head
becomes a node, and its suffixes are dealt by their next turn id into
containers of the next depth. A round bursts several depths at once, so that
a prefix shared by very many long conversations needs few rounds. What
remains is small: shards take whole containers, sort their suffixes and sweep
them once, opening a node where a suffix leaves the one before and closing it with
its sums. A container of a single sequence is a chain that needs no sweep.

Nothing is gathered beyond a container. A conversation of any length is
dealt by segments of its turns, copies of any number are merged by partial sums,
and a head's members are only counted. Sums of subtrees flow up from the containers
through the rounds of heads, last round first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixscore.llm.common import checkpointed, column, partitions, ship, within_bound

#: Turns of different sequences that a container may hold without bursting, and that a shard holds on average.
CONTAINER_ROWS = 1 << 13

#: Depths that one round bursts, at most; rounds start with one and double.
MOST_DEPTHS = 32

#: Turns in a segment, as a power of two: joins deal long conversations by segments.
_SEGMENT = 12

#: Conversation ids in one joined text, as a power of two.
_ID_BLOCK = 12

_RANKED = "conv_id long, part int, rank long, id binary, size long"
_CLASS = "conv_id long, len long, weight long, sha string"
_NODE = (
    "head binary, conv_id long, depth long, parent_conv_id long, n_convs long,"
    " n_children long, n_leaves long, saved_tokens long, ends_here long"
)


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each conversation within a sorted partition."""
    last, counted = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_numpy()
        first = np.concatenate([[True], conv[1:] != conv[:-1]])
        start = np.flatnonzero(first)
        rank = np.arange(1, len(conv) + 1) - start[np.cumsum(first) - 1]
        if conv[0] == last:
            rank[: start[1] if len(start) > 1 else len(rank)] += counted
        last, counted = conv[-1], int(rank[-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(rank), batch.column(2), batch.column(3)],
            ["conv_id", "part", "rank", "id", "size"],
        )


def ordered_turns(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_id, pos from 1, id, size): the turns in order, with a hash of role and text and the text's UTF-8 bytes.

    Turns are ordered by number, null first; of equal numbers by role, the text's
    first 64 letters and the hash. Rows are sorted in ranges that may cut a
    conversation and numbered by counts of the ranges before.

    Defined cases: a null role or text counts as empty, rows without a
    conversation are left out, repeated rows are turns of their own, other columns are ignored.
    """
    spark = conversations.sparkSession
    ship(spark)
    role, text = (F.coalesce(column(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(column(conv_col).isNotNull()).select(
        column(conv_col).cast("long").alias("conv_id"),
        column(turn_col).cast("long").alias("turn"),
        role.alias("role"),
        F.substring(text, 1, 64).alias("start"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("id"),
        F.octet_length(text).cast("long").alias("size"),
    )
    order = ("conv_id", "turn", "role", "start")
    ranges = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "id")
    ranked = checkpointed(
        ranges.select("conv_id", F.spark_partition_id().alias("part"), "id", "size").mapInArrow(_rank, _RANKED)
    )
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cut = (  # the first conversation of each range at most
        ranked.groupBy("conv_id", "part")
        .agg(F.max("rank").alias("n"))
        .withColumn("before", F.sum("n").over(earlier))
        .where(F.col("before").isNotNull())
        .select("conv_id", "part", "before")
    )
    return ranked.join(F.broadcast(cut), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("pos"), "id", "size"
    )


def _segments(df: DataFrame, first: Column, last: Column) -> DataFrame:
    """A row for each segment of turns from ``first`` to ``last``."""
    return df.withColumn("segment", F.explode(F.sequence(F.shiftright(first, _SEGMENT), F.shiftright(last, _SEGMENT))))


def branched(turns: DataFrame, block: int, most: int, kept: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the first of their block, as (turns, conversations).

    ``turns`` as of `ordered_turns`. The first ``kept`` turns of a conversation
    (an expression of ``conv_id``, at most ``most``) are replaced by as many
    first ones of conversation ``conv_id - conv_id % block``: all if it has fewer,
    none if it is absent. Gives (conv_id, pos, id, size) and (conv_id, len).
    """
    turns = checkpointed(turns)
    counted = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    counted = counted.select(
        "conv_id", "n", kept.cast("int").alias("kept"), (F.col("conv_id") - F.col("conv_id") % block).alias("base")
    )
    first = (
        turns.where((F.col("conv_id") % block == 0) & (F.col("pos") <= most))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "id", "size"))).alias("first"))  # at most ``most``
    )
    lent = F.when(F.col("first").isNull(), F.array().cast("array<struct<pos:bigint,id:binary,size:bigint>>"))
    lent = lent.otherwise(F.slice("first", F.lit(1), F.col("kept")))
    info = checkpointed(
        counted.join(first, "base", "left")
        .withColumn("lent", lent)
        .withColumn("len", F.size("lent") + F.greatest(F.col("n") - F.col("kept"), F.lit(0)))
        .select("conv_id", "n", "kept", "lent", "len")
    )
    borrowed = info.select("conv_id", F.explode("lent").alias("t")).select("conv_id", "t.pos", "t.id", "t.size")
    moved = info.where((F.size("lent") < F.col("kept")) & (F.col("n") > F.col("kept")))
    moved = _segments(moved.select("conv_id", "n", (F.size("lent") - F.col("kept")).alias("shift")), F.lit(0).cast("long"), F.col("n"))
    own = (
        turns.where(F.col("pos") > kept)
        .withColumn("segment", F.shiftright("pos", _SEGMENT))
        .join(moved.select("conv_id", "segment", "shift"), ["conv_id", "segment"], "left")
        .select("conv_id", (F.col("pos") + F.coalesce("shift", F.lit(0))).alias("pos"), "id", "size")
    )
    return checkpointed(borrowed.unionByName(own)), info.select("conv_id", F.col("len").cast("long").alias("len"))


def _hash_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each class of equal sequences: its first member, their number and the hash of their ids.

    Blocks of a class come in order; the hash takes them one by one.
    """
    current, state, conv, weight = None, None, 0, 0

    def done() -> tuple:
        return conv, current[0], weight, state.hexdigest()

    for batch in batches:
        out = []
        for length, a, b, first, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if current != (length, a, b):
                if current is not None:
                    out.append(done())
                current, state, conv, weight = (length, a, b), hashlib.sha256(), first, 0
            else:
                state.update(b",")
            state.update(ids.encode())
            weight += n
        if out:
            yield _rows(out, _CLASS)
    if current is not None:
        yield _rows([done()], _CLASS)


_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(",")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields)], [name for name, _ in fields]
    )


def _classes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, len, weight, sha): conversations of equal turns as their smallest one."""
    digests = turns.groupBy("conv_id").agg(
        *(F.bit_xor(F.xxhash64(F.lit(seed), "pos", "id")).alias(name) for seed, name in ((1, "a"), (2, "b")))
    )
    hashed = convs.join(digests, "conv_id", "left").select(
        "len", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"), "conv_id"
    )
    blocks = hashed.groupBy("len", "a", "b", F.shiftright("conv_id", _ID_BLOCK).alias("block")).agg(
        F.min("conv_id").alias("first"),
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"),  # a block of ids at most
    )
    inorder = blocks.repartition("len", "a", "b").sortWithinPartitions("len", "a", "b", "block")
    return checkpointed(inorder.select("len", "a", "b", "first", "n", "ids").mapInArrow(_hash_members, _CLASS))


class _Open:
    """A node of the sweep whose subtree isn't complete."""

    __slots__ = ("size", "weight", "conv", "ends", "children", "leaves", "saved", "rows")

    def __init__(self, size: int) -> None:
        self.size, self.weight, self.conv, self.ends = size, 0, None, None
        self.children = self.leaves = self.saved = 0
        self.rows: list[int] = []  # the children's rows, which need this node's smallest member


def _sweep_container(suffixes: list[tuple], depth: int, head: bytes | None, out: list[list]) -> None:
    """Append the nodes of one container; ``suffixes`` are (ids, sizes, conv_id, weight), all with the same first id."""
    path: list[_Open] = []

    def close(length: int) -> None:
        while len(path) > length:
            node = path.pop()
            node.saved += (node.weight - 1) * node.size
            leaves = node.leaves or 1
            for i in node.rows:
                out[i][3] = node.conv
            row = [None, node.conv, depth + len(path), None, node.weight, node.children, leaves, node.saved, node.ends]
            if path:
                up = path[-1]
                up.weight += node.weight
                up.conv = node.conv if up.conv is None else min(up.conv, node.conv)
                up.children += 1
                up.leaves += leaves
                up.saved += node.saved
                up.rows.append(len(out))
            else:
                row[0] = head
            out.append(row)

    before: list = []
    for ids, sizes, conv, weight in sorted(suffixes, key=lambda s: s[0]):
        common = 0
        for x, y in zip(before, ids):
            if x != y:
                break
            common += 1
        close(common)
        path.extend(_Open(s) for s in sizes[common:])
        node = path[-1]
        node.weight += weight
        node.conv = conv if node.conv is None else min(node.conv, conv)
        node.ends = conv
        before = ids
    close(0)


def _sweep(key, table):  # without hints, which applyInArrow would have to know
    """The nodes of a shard's containers."""
    table = table.sort_by([("key", "ascending"), ("conv_id", "ascending"), ("pos", "ascending")])
    conv = table.column("conv_id").to_numpy()
    starts = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1, [len(conv)]]).tolist()
    ids, sizes = table.column("id").to_pylist(), table.column("size").to_pylist()
    firsts = table.take(pa.array(starts[:-1]))
    out: list[list] = []
    container, suffixes = None, []
    described = zip(*(firsts.column(c).to_pylist() for c in ("key", "head", "depth", "conv_id", "weight")))
    for (name, head, depth, c, weight), a, b in zip(described, starts[:-1], starts[1:]):
        if container is not None and container[0] != name:
            _sweep_container(suffixes, container[1], container[2], out)
            suffixes = []
        container = name, depth, head
        suffixes.append((ids[a:b], sizes[a:b], c, weight))
    _sweep_container(suffixes, container[1], container[2], out)
    return pa.Table.from_batches([_rows(out, _NODE)])


def _chains(rows: DataFrame, single: DataFrame) -> DataFrame:
    """The nodes of containers of one sequence, of any length."""
    held = _segments(single, F.col("depth"), F.col("len")).select("conv_id", "segment", "depth", "head")
    rows = (
        rows.withColumn("segment", F.shiftright("pos", _SEGMENT))
        .join(held, ["conv_id", "segment"])
        .where(F.col("pos") >= F.col("depth"))
        .withColumn("own", (F.col("weight") - 1) * F.col("size"))
    )
    copied = rows.where("weight > 1")
    later = Window.partitionBy("conv_id").orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)
    sums = copied.groupBy("conv_id", "segment").agg(F.sum("own").alias("all"))
    sums = sums.withColumn("later", F.coalesce(F.sum("all").over(later), F.lit(0))).drop("all")
    below = Window.partitionBy("conv_id", "segment").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    copied = copied.join(sums, ["conv_id", "segment"]).withColumn("saved", F.sum("own").over(below) + F.col("later"))
    rows = rows.where("weight = 1").withColumn("saved", F.lit(0).cast("long")).unionByName(copied.drop("later"))
    top = F.col("pos") == F.col("depth")
    end = F.col("pos") == F.col("len")
    return rows.select(
        F.when(top, F.col("head")).alias("head"),
        "conv_id",
        F.col("pos").alias("depth"),
        F.when(~top, F.col("conv_id")).alias("parent_conv_id"),
        F.col("weight").alias("n_convs"),
        F.when(end, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.when(end, F.col("conv_id")).alias("ends_here"),
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def prefix_trie(turns: DataFrame, convs: DataFrame, container_rows: int = CONTAINER_ROWS) -> DataFrame:
    """One row for each distinct sequence of first turns that conversations begin with, the empty one included.

    ``turns`` holds (conv_id, pos from 1, id, size), ``convs`` (conv_id, len) all
    conversations, also those without turns; give checkpointed tables. A node has
    conv_id (its smallest member), depth, parent_conv_id (the parent's conv_id, null
    for the root), n_convs (members), n_children, n_leaves (childless nodes of
    its subtree, itself included), saved_tokens (summed over its subtree:
    members beyond the first times the last turn's size) and ends_sha256 (of the ids
    of members that end there, ascending and joined by commas).

    Defined cases: no conversations give no nodes, conversations without any
    turn a root alone. Ids of two turns are equal only if the turns are.
    """
    spark = turns.sparkSession
    ship(spark)
    classes = _classes(turns, convs)
    root = F.unhex(F.lit("00"))
    weights = _segments(classes, F.lit(0).cast("long"), F.col("len")).select("conv_id", "segment", "len", "weight")
    kept = (
        turns.withColumn("segment", F.shiftright("pos", _SEGMENT))
        .join(weights, ["conv_id", "segment"])
        .select("conv_id", "pos", "id", "size", "len", "weight")
    )
    zero = F.lit(0).cast("long")
    kept = kept.unionByName(
        classes.select("conv_id", zero.alias("pos"), root.alias("id"), zero.alias("size"), "len", "weight")
    )
    rows = checkpointed(kept)

    held, number = classes.agg(F.sum(F.col("len") + 1), F.count(F.lit(1))).first()
    whole = classes.select(
        "conv_id", "len", "weight", root.alias("key"), F.lit(None).cast("binary").alias("head"), zero.alias("depth")
    )
    heads, assigned, head_ends = [], [], []
    if number <= 1 or held <= container_rows:
        assigned.append(whole)
    else:
        heads.append(
            classes.agg(F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs")).select(
                root.alias("key"), F.lit(None).cast("binary").alias("head"), F.array(root).alias("up"),
                zero.alias("depth"), zero.alias("size"), "conv_id", "n_convs",
            )
        )
        head_ends.append(whole.where("len = 0").select("key", "conv_id"))
        active, depth, depths = whole.where("len > 0").select("conv_id", "key"), 0, 1
        while True:
            entries = _entries(rows, active, depth, depths)
            over = checkpointed(
                entries.groupBy("key")
                .agg(
                    F.first("head").alias("head"), F.first("up").alias("up"), F.first("depth").alias("depth"),
                    F.first("size").alias("size"), F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"),
                    F.count(F.lit(1)).alias("sequences"), F.sum(F.col("len") - F.col("depth") + 1).alias("rows"),
                )
                .where((F.col("rows") > container_rows) & (F.col("sequences") > 1))
                .drop("rows", "sequences")
            )
            names = within_bound(checkpointed(over.select("key")))
            flagged = checkpointed(
                entries.drop("up", "size")
                .join(names.withColumn("burst", F.lit(True)), "key", "left")
                .join(names.select(F.col("key").alias("head"), F.lit(True).alias("below")), "head", "left")
                .select(
                    "conv_id", "len", "weight", "key", "head", "depth",
                    F.col("burst").isNotNull().alias("burst"),
                    (F.col("below").isNotNull() | (F.col("depth") == depth + 1)).alias("below"),
                )
            )
            assigned.append(
                flagged.where("below AND NOT burst").select("conv_id", "len", "weight", "key", "head", "depth")
            )
            heads.append(over)
            head_ends.append(flagged.where("burst AND len = depth").select("key", "conv_id"))
            depth += depths
            active = flagged.where(F.col("burst") & (F.col("depth") == depth) & (F.col("len") > depth))
            active = active.select("conv_id", "key")
            if not active.take(1):
                break
            depths = min(2 * depths, MOST_DEPTHS)

    assigned = checkpointed(_union(assigned))
    single = (
        assigned.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), *(F.min(c).alias(c) for c in ("conv_id", "len", "head", "depth")))
        .where("n = 1")
    )
    single = checkpointed(single.select("conv_id", "len", "head", "depth"))
    shared = assigned.join(single.select("conv_id"), "conv_id", "left_anti").select("conv_id", "key", "head", "depth")
    in_shared = rows.join(shared, "conv_id").where(F.col("pos") >= F.col("depth"))
    shards = max(1, -(-(held or 0) // container_rows))
    swept = (
        in_shared.select("key", "head", "depth", "conv_id", "pos", "id", "size", "weight")
        .withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(_sweep, _NODE)
    )
    nodes = checkpointed(swept.unionByName(_chains(rows, single)))
    if heads:
        nodes = _with_heads(nodes, heads, _union(head_ends))
    ends = classes.select(F.col("conv_id").alias("ends_here"), "sha")
    return nodes.join(ends, "ends_here", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def _entries(rows: DataFrame, active: DataFrame, depth: int, depths: int) -> DataFrame:
    """A row for each sequence of a burst container and each of its next ``depths`` turns, with the node it enters."""
    steps = (
        rows.where((F.col("pos") > depth) & (F.col("pos") <= depth + depths))
        .join(active, "conv_id")
        .groupBy("conv_id", "len", "weight", "key")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "id", "size"))).alias("steps"))  # at most ``depths``
    )
    path = F.expr(
        "aggregate(steps, array(key), (path, t) -> concat(path, array(unhex(md5(concat(element_at(path, -1), t.id))))))"
    )
    at = steps.select("conv_id", "len", "weight", path.alias("path"), "steps", F.explode(F.sequence(F.lit(1), F.size("steps"))).alias("j"))
    return checkpointed(
        at.select(
            "conv_id", "len", "weight",
            F.expr("path[j]").alias("key"), F.expr("path[j - 1]").alias("head"),
            F.expr("slice(path, 1, j + 1)").alias("up"),
            (F.col("j") + depth).cast("long").alias("depth"),
            F.expr("steps[j - 1].size").alias("size"),
        )
    )


def _with_heads(nodes: DataFrame, heads: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The containers' nodes with their parents, and the heads with the sums of all below them."""
    tops = nodes.where(F.col("head").isNotNull())
    below = checkpointed(
        tops.groupBy(F.col("head").alias("key")).agg(
            F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
        )
    )
    totals = []
    for burst in reversed(heads):
        sums = burst.join(below, "key", "left").select(
            F.explode("up").alias("key"),
            F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"),
            (F.coalesce("saved_tokens", F.lit(0)) + (F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"),
        )
        sums = sums.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        sums = checkpointed(sums)
        totals.append(sums.join(burst.select("key"), "key", "left_semi"))
        up = sums.join(burst.select("key"), "key", "left_anti").unionByName(below)
        below = checkpointed(
            up.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        )
    every = checkpointed(_union(heads).drop("up"))
    children = (
        tops.select("head").unionByName(every.where(F.col("head").isNotNull()).select("head"))
        .groupBy(F.col("head").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    )
    named = within_bound(checkpointed(every.select(F.col("key").alias("head"), F.col("conv_id").alias("above"))))
    burst = (
        every.join(_union(totals), "key").join(children, "key")
        .join(ends.select("key", F.col("conv_id").alias("ends_here")), "key", "left")
        .withColumn("parent_conv_id", F.lit(None).cast("long"))
        .select(nodes.columns)
    )
    return nodes.unionByName(burst).join(named, "head", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
