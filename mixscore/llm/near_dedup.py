"""Near-duplicate documents: MinHash with tensored banding, confirmed on full shingle sets.

1. Every document becomes its shingle set's size, a 128-bit hash of the set
   and two small collections of partial keys, each made of a few MinHashes.
2. Equal sets become one class, named by its smallest id, so thousands of exact
   copies are one row from here on.
3. Tables are keyed by pairs of partial keys, one of each collection: 16 and 10
   partial keys from 68 MinHashes make 160 tables, which would take 800
   MinHashes if each table had its own. A pair with similarity 0.8 shares a
   table with probability 0.99995, a pair with 0.85 with 0.999997.
4. In every table the classes of one key propose to the smallest of them, its
   hub: as many proposals as members, not all pairs.
5. The members of a hub are compared on their full sets, in blocks bounded in
   shingles and members: the hub with every member, and those that are not linked
   to it with the others that share one of their rarest shingles, which any
   link needs (prefix filter). So no link between members of a table is lost, and
   members that share frequent shingles alone are not compared. Only links that
   join something new leave a block.
6. Links become components by distributed star contraction.

A query's shuffle files go when it ends, as its result is kept: tables are dealt out
twice, and their files would be most of the disk at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixscore.llm import bytetext
from mixscore.llm.common import checkpointed, column, fresh_name, partitions, ship, shuffles_deleted, tidy, within_bound
from mixscore.llm.components import components

#: Partial keys and MinHashes in each, for the two collections.
FIRST = (16, 3)
SECOND = (10, 2)

#: Shingles (8 bytes each) of the members that one block compares at a time.
BLOCK_SHINGLES = 1 << 21

#: Members that one block compares at a time, on average.
BLOCK_MEMBERS = 1 << 16

#: Columns in which the rows of one class agree.
_SAME = ["mark1", "mark2", "n_shingles"]

_HASHES = FIRST[0] * FIRST[1] + SECOND[0] * SECOND[1]
_FACTORS = bytetext.stream(11, _HASHES) | np.uint64(1)
_TERMS = bytetext.stream(12, _HASHES)


def _sets(batch: pa.RecordBatch, words: int) -> list[np.ndarray]:
    hashes, begin = bytetext.words(*bytetext.utf8(batch.column(batch.schema.get_field_index("text"))))
    return bytetext.shingle_sets(hashes, begin, words)


def partial_keys(sets: list[np.ndarray]) -> np.ndarray:
    """The partial keys of both collections, a row for each of the non-empty sets."""
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    everything = np.concatenate(sets)
    low = [np.minimum.reduceat(everything * f + t, bounds) for f, t in zip(_FACTORS, _TERMS)]
    keys = []
    for count, width in (FIRST, SECOND):
        used, low = low[: count * width], low[count * width :]
        keys += [bytetext.combine(used[i * width : (i + 1) * width]) for i in range(count)]
    return np.stack(keys, axis=1)


def _signatures(words: int):
    width = FIRST[0] + SECOND[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytetext.slices(batch, "text"):
                sets = _sets(part, words)
                sizes = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(sizes)
                marks = np.zeros((2, len(sets)), np.uint64)
                keys = np.zeros((len(sets), width), np.uint64)
                if len(some):
                    filled = [sets[i] for i in some]
                    everything = np.concatenate(filled)
                    bounds = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                    marks[0, some] = np.add.reduceat(bytetext.mix(everything), bounds)
                    marks[1, some] = np.add.reduceat(bytetext.mix(everything ^ np.uint64(0x5DEECE66D)), bounds)
                    keys[some] = partial_keys(filled)
                flat = pa.array(keys.view(np.int64).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * width), flat)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes), *(pa.array(m.view(np.int64)) for m in marks), lists],
                    ["doc_id", "n_shingles", "mark1", "mark2", "keys"],
                )

    return run


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytetext.slices(batch, "text"):
                sets = [s.tobytes() for s in _sets(part, words)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["node", "shingles"])

    return run


class _Forest:
    """Union-find over the members of one block."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _common(some: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of ``some`` with each of ``others``."""
    if len(some) * len(others) <= 64:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in others] for a in some]).reshape(
            len(some), len(others)
        )
    vocabulary = np.unique(np.concatenate(some))
    out = np.zeros((len(some), len(others)), np.float32)
    spots = [np.searchsorted(vocabulary, a) for a in some]
    hits = []
    for b in others:
        at = np.minimum(np.searchsorted(vocabulary, b), len(vocabulary) - 1)
        hits.append(at[vocabulary[at] == b])
    step = max(256, (1 << 22) // max(len(some), len(others)))
    for low in range(0, len(vocabulary), step):
        high = min(low + step, len(vocabulary))

        def table(rows: list[np.ndarray]) -> np.ndarray:
            out = np.zeros((len(rows), high - low), np.float32)
            for i, r in enumerate(rows):
                a, b = np.searchsorted(r, (low, high))
                out[i, r[a:b] - low] = 1
            return out

        out += table(spots) @ table(hits).T
    return out.astype(np.int64)


def _linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    union = a[:, None] + b[None, :] - common
    return (100 * common >= percent * union) & (common > 0)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """Runs of equal keys in sorted batches: the key, whether it is new, the rows."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [*np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            key = tuple(c[a].item() for c in columns)
            yield key, key != last, batch.slice(a, b - a)
            last = key


_FOUND = pa.schema([("open", pa.bool_()), ("a", pa.int64()), ("b", pa.int64())])


def _found(rows: list[tuple[bool, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND)], schema=_FOUND)


def _members(rows: pa.RecordBatch) -> list[tuple[bool, int, np.ndarray]]:
    return [
        (first, node, np.frombuffer(s, np.uint64))
        for first, node, s in zip(
            rows.column(rows.schema.get_field_index("first")).to_pylist(),
            rows.column(rows.schema.get_field_index("node")).to_pylist(),
            rows.column(rows.schema.get_field_index("shingles")).to_pylist(),
        )
    ]


def _shared_prefixes(sets: list[np.ndarray], percent: int) -> Iterator[np.ndarray]:
    """Groups of sets that share one of their rarest shingles: every link lies in one of them.

    Sets linked at ``percent`` share at least that share of the larger one, so of the
    first ``n - ceil(share) + 1`` shingles of each, in one order, one is common.
    Sizes that differ too much never link; a group is sorted by size.
    """
    sizes = np.array([len(s) for s in sets])
    everything = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, which, spread = np.unique(everything, return_inverse=True, return_counts=True)
    alone = spread[which] == 1  # meets nothing, but counts as one of the rarest
    order = np.lexsort((which, spread[which], owner))
    begin = np.cumsum(sizes) - sizes
    prefix = sizes - -(-percent * sizes // 100) + 1
    rank = np.arange(len(order)) - begin[owner[order]]
    chosen = order[(rank < prefix[owner[order]]) & ~alone[order]]
    chosen = chosen[np.lexsort((sizes[owner[chosen]], which[chosen]))]
    shingle, member = which[chosen], owner[chosen]
    cuts = np.flatnonzero(shingle[1:] != shingle[:-1]) + 1
    for group in np.split(member, cuts):
        if len(group) > 1:
            yield group


def _link_rest(
    nodes: list[int], sets: list[np.ndarray], probe: np.ndarray, own: np.ndarray, forest: _Forest, percent: int
) -> list[tuple[bool, int, int]]:
    """Links of ``probe`` sets with ``own`` ones that join what ``forest`` has apart."""
    out = []
    sizes = np.array([len(s) for s in sets])
    for group in _shared_prefixes(sets, percent):
        seeking = group[probe[group]]
        for low in range(0, len(seeking), 256):
            some = seeking[low : low + 256]
            # sets of other sizes can't be linked with any of these
            least, most = sizes[some].min() * percent, sizes[some].max() * 100
            others = group[own[group] & (sizes[group] * 100 >= least) & (sizes[group] * percent <= most)]
            roots = {forest.find(nodes[i]) for i in some}
            others = np.array([j for j in others if len(roots) > 1 or forest.find(nodes[j]) not in roots], np.int64)
            if not len(others):
                continue
            links = _linked(_common([sets[i] for i in some], [sets[j] for j in others]), sizes[some], sizes[others], percent)
            for i, j in zip(*np.nonzero(links)):
                if forest.join(nodes[some[i]], nodes[others[j]]):
                    out.append((False, nodes[some[i]], nodes[others[j]]))
    return out


def _compare_block(percent: int):
    """Links inside one block of a hub's members, and the members not linked to the hub."""

    def compare(hub: int, rows: list[tuple[bool, int, np.ndarray]]) -> list[tuple[bool, int, int]]:
        out, forest = [], _Forest()
        hubs = [s for first, _, s in rows if first]
        nodes = [n for first, n, _ in rows if not first]
        sets = [s for first, _, s in rows if not first]
        if not sets or not hubs:
            return out
        sizes = np.array([len(s) for s in sets])
        near = _linked(_common(hubs, sets), np.array([len(h) for h in hubs]), sizes, percent).any(0)
        for i in np.flatnonzero(near):
            if forest.join(hub, nodes[i]):
                out.append((False, hub, nodes[i]))
        out += [(True, hub, nodes[i]) for i in np.flatnonzero(~near)]
        if not near.all():
            out += _link_rest(nodes, sets, ~near, np.ones(len(sets), bool), forest, percent)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, hub = [], 0
        for key, new, part in _groups(batches, ["hub", "block"]):
            if new and rows:
                if out := compare(hub, rows):
                    yield _found(out)
                rows = []
            hub = key[0]
            rows += _members(part)
        if rows and (out := compare(hub, rows)):
            yield _found(out)

    return run


def _compare_across(percent: int):
    """Links of a hub's open members with one block's members; ``first`` marks the block's own."""

    def compare(own: list, probes: list, forest: _Forest) -> list[tuple[bool, int, int]]:
        members = own + probes
        is_probe = np.arange(len(members)) >= len(own)
        return _link_rest([n for _, n, _ in members], [x for _, _, x in members], is_probe, ~is_probe, forest, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[bool, int, np.ndarray]] = []
        probes: list[tuple[bool, int, np.ndarray]] = []
        forest, held = _Forest(), 0

        def done() -> Iterator[pa.RecordBatch]:
            if own and probes and (out := compare(own, probes, forest)):
                yield _found(out)

        for _, new, part in _groups(batches, ["hub", "block"]):
            if new:
                yield from done()
                own, probes, forest, held = [], [], _Forest(), 0
            for row in _members(part):
                if row[0]:
                    own.append(row)
                    continue
                probes.append(row)
                held += len(row[2])
                if held > BLOCK_SHINGLES or len(probes) > BLOCK_MEMBERS:  # of any number of other blocks
                    yield from done()
                    probes, held = [], 0
        yield from done()

    return run


def _resolved(rows: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows' signatures, their classes of equal sets, and the component of every linked class."""
    signed = checkpointed(
        rows.mapInArrow(
            tidy(_signatures(words)), "doc_id long, n_shingles long, mark1 long, mark2 long, keys array<long>"
        )
    )
    classes = (
        signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        .groupBy(*_SAME)
        .agg(F.min("doc_id").alias("node"), F.any_value("keys").alias("keys"))
    )

    # A class becomes many rows here: in small partitions their first aggregation stays in memory.
    tables = (
        classes.repartition(4 * partitions(rows.sparkSession), "node").select(
            "node",
            F.posexplode(F.slice("keys", 1, FIRST[0])).alias("i", "one"),
            F.slice("keys", FIRST[0] + 1, SECOND[0]).alias("others"),
        )
        .select("node", "i", "one", F.posexplode("others").alias("j", "other"))
        .select("node", F.xxhash64("i", "one", "j", "other").alias("key"))
    )
    # Kept as a table, so that the join can split a key that very many classes share.
    hubs = checkpointed(
        tables.groupBy("key")
        .agg(F.min("node").alias("hub"), F.max("node").alias("last"))
        .where(F.col("hub") < F.col("last"))
        .select("key", "hub")
    )
    proposals = checkpointed(
        tables.join(hubs, "key")
        .where(F.col("node") != F.col("hub"))
        .select("hub", F.col("node").alias("node"))  # a name of its own, as it is joined with the classes
        .distinct()
    )

    sizes = classes.select("node", "n_shingles").groupBy("node").agg(F.sum("n_shingles").alias("n_shingles"))
    blocks = (
        proposals.join(sizes, "node")
        .groupBy("hub")
        .agg(
            F.ceil(F.greatest(F.sum("n_shingles") / BLOCK_SHINGLES, F.count(F.lit(1)) / BLOCK_MEMBERS)).cast("int").alias("blocks")
        )
    )
    placed = checkpointed(proposals.join(blocks, "hub"))
    sought = placed.select("node").unionByName(placed.select(F.col("hub").alias("node"))).distinct()
    full = checkpointed(
        rows.join(within_bound(checkpointed(sought)), F.col("doc_id") == F.col("node"), "left_semi")
        .mapInArrow(tidy(_full_sets(words)), "node long, shingles binary")
        .distinct()
    )
    own_block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = placed.select("hub", own_block.alias("block"), F.lit(False).alias("first"), "node")
    heads = placed.select("hub", "blocks").distinct().select(
        "hub",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.lit(True).alias("first"),
        F.col("hub").alias("node"),
    )
    found = checkpointed(
        members.unionByName(heads)
        .join(full, "node")
        .select("hub", "block", "first", "node", "shingles")
        .repartition("hub", "block")
        .sortWithinPartitions("hub", "block", F.col("first").desc())
        .mapInArrow(tidy(_compare_block(percent)), "open boolean, a long, b long")
    )
    links = found.where(~F.col("open")).select("a", "b")

    wide = placed.where(F.col("blocks") > 1)
    opened = (
        found.where("open").select(F.col("a").alias("hub"), F.col("b").alias("node")).distinct()
        .join(wide, ["hub", "node"])
        .select("hub", "node", own_block.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        .where(F.col("own") != F.col("block"))
        .select("hub", "block", F.lit(False).alias("first"), "node")
    )
    across = (
        wide.select("hub", own_block.alias("block"), F.lit(True).alias("first"), "node")
        .unionByName(opened)
        .join(full, "node")
        .select("hub", "block", "first", "node", "shingles")
        .repartition("hub", "block")
        .sortWithinPartitions("hub", "block", F.col("first").desc())
        .mapInArrow(tidy(_compare_across(percent)), "open boolean, a long, b long")
        .select("a", "b")
    )
    return signed, classes, components(links.unionByName(across))


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of ``docs``.

    A document's set holds its distinct shingles of ``words`` words, A to Z in
    lower case, words being runs without ASCII white space; with fewer words it
    holds the whole sequence as one. Documents whose sets' Jaccard similarity is
    at least ``percent`` percent are linked; ``component_id`` is the smallest id
    reachable over links, and ``kept`` marks the document with that id.

    Defined cases: a text without words, empty or null has an empty set, is
    linked with nothing and kept. Rows that repeat an id are one node, linked by
    any of their texts. A row with a null id takes the component of rows with an
    equal set, else null, and is kept in that case only. An empty table gives an
    empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    with shuffles_deleted(docs.sparkSession):
        signed, classes, member = _resolved(rows, words, percent)
    named = (
        classes.select(*_SAME, F.col("node").alias("own"))
        .join(member, F.col("own") == F.col("node"), "left")
        .select(*_SAME, F.coalesce("component", "own").alias("component"))
    )
    component = F.coalesce("component", "doc_id")
    return (
        signed.select("doc_id", *_SAME)
        .join(named, _SAME, "left")
        .select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each component; rows with a null id all stay."""
    gone = fresh_name(docs, "__gone")
    dropped = near_duplicates(docs, id_col=id_col, **options).where(~F.col("kept") & F.col("doc_id").isNotNull())
    dropped = within_bound(checkpointed(dropped.select(F.col("doc_id").alias(gone)).distinct()))
    return docs.join(dropped, column(id_col) == F.col(gone), "left_anti")
