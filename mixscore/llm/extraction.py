"""Main text of web pages by wrapper induction.

Pages of one host come from one template. Every page becomes a tree of its
block elements, like siblings folded into one. The trees of a host are aligned
by simple tree matching and merged into the host's wrapper, whose nodes are
the slots that its pages fill. Over all its pages, a slot's texts tell what it is:

* a text outside of an article that nearly every different page repeats in the
  same slot is part of the template,
* a slot outside of an article that a few texts fill, nearly all of them on a
  good share of the host's pages, is filled by the template in turn (adverts,
  notices), and
* slots that vary hold content; slots of elements that by the HTML standard or
  by name hold menus, forms, comments and the like do not count.

The main region is the wrapper's `article` or `main` where those hold half of
the text, or else the whole page: every slot that varies and isn't furniture.

A host's pages are never gathered: equal trees are merged by a grouping, so
only different trees meet, in buckets first, and the texts are counted as
hashes. Pages with the same content count once, so copies make no template.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixscore.llm import html_tree
from mixscore.llm.common import checkpointed, column, ship

#: Share of a host's different pages that repeat a text of the template, at the lower bound of what so many pages tell.
CONSTANT_SHARE = 0.75

#: Standard deviations of the bounds on shares.
SURE = 1.64

#: A text recurs if it is on this share of the host's different pages, and on so many at least, for small hosts.
RECURS_SHARE = 0.1
RECURS_ON = 5

#: Share of recurring text that makes a slot the template's, and distinct texts a page that it has at most,
#: at the upper bound of what so many pages tell.
RECURRING_SHARE = 0.9
FEW_TEXTS = 0.5

#: Buckets of a host's different trees that are merged on their own first.
_BUCKETS = 64

#: Bytes of all hosts' rules together that may be broadcast.
_BROADCAST_BYTES = 32 << 20

_PARSED = "host long, tree long, shape string, body long, nodes array<int>, texts array<long>, sizes array<int>"


def share_bound(on: float, pages: float, upper: bool = False) -> float:
    """The lower (or upper) Wilson bound of a share seen on ``on`` of ``pages``: few pages prove little."""
    p, z = on / pages, SURE * SURE / pages
    half = SURE * ((p * (1 - p) + z / 4) / pages) ** 0.5
    return (p + z / 2 + (half if upper else -half)) / (1 + z)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def host_of(url: Column) -> Column:
    """The hash of the address's host in lower case; null and odd addresses share the empty one."""
    return F.xxhash64(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 1000):
            part = batch.slice(low, 1000)
            rows = []
            for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                root, blocks = html_tree.parse(page or "")
                nodes = html_tree.fold(root).preorder()
                furniture = html_tree.spread_furniture(root, len(nodes))
                shape = root.text()
                found = [(e.found().number, t) for e, t in blocks]
                body = _hash("\n".join(t for n, t in found if not furniture[n]))
                rows.append(
                    (host, _hash(shape), shape, body, [n for n, _ in found], [_hash(t) for _, t in found], [len(t) for _, t in found])
                )
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            names = ["host", "tree", "shape", "body", "nodes", "texts", "sizes"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _merge(key, table):
    """One wrapper from a group's different trees, in a fixed order."""
    shapes = sorted(set(table.column("shape").to_pylist()), key=lambda s: (-len(s), s))
    wrapper = html_tree.read(shapes[0])
    for shape in shapes[1:]:
        html_tree.absorb(wrapper, html_tree.read(shape))
    return pa.table({"host": pa.array([key[0].as_py()], pa.int64()), "shape": pa.array([wrapper.text()])})


def _place(key, trees, wrappers):
    """For each tree of the host the wrapper's slot of every node."""
    out = []
    wrapper = html_tree.read(wrappers.column("shape")[0].as_py())
    wrapper.preorder()
    for tree, shape in zip(trees.column("tree").to_pylist(), trees.column("shape").to_pylist()):
        root = html_tree.read(shape)
        nodes = root.preorder()
        slots: dict[int, int] = {}
        html_tree.place(wrapper, root, slots)
        out.append((tree, [slots.get(i, -1) for i in range(len(nodes))]))
    return pa.table(
        {
            "host": pa.array([key[0].as_py()] * len(out), pa.int64()),
            "tree": pa.array([t for t, _ in out], pa.int64()),
            "slots": pa.array([s for _, s in out], pa.list_(pa.int32())),
        }
    )


def _decide(key, wrappers, slots):
    """The host's rules: its wrapper, the slots that hold content, and texts of the template among them."""
    shape = wrappers.column("shape")[0].as_py()
    stats = {r["slot"]: r for r in slots.to_pylist()}
    wrapper = html_tree.read(shape)
    rules = {"wrapper": json.loads(shape), "keep": keep_slots(wrapper, stats)}
    outside = set(rules["keep"]) - inside_articles(wrapper)
    # by slot: the article may repeat a text of the template
    rules["constant"] = {s: sorted(stats[s]["constant"]) for s in sorted(outside) if s in stats and stats[s]["constant"]}
    return pa.table({"host": pa.array([key[0].as_py()], pa.int64()), "rules": pa.array([json.dumps(rules)])})


def inside_articles(wrapper: html_tree.Node) -> set[int]:
    """The slots in an article or main element."""
    nodes = wrapper.preorder()
    furniture = html_tree.spread_furniture(wrapper, len(nodes))
    mains = [n for n in nodes if n.label.partition(" ")[0] in ("article", "main") and not furniture[n.number]]
    return {k.number for n in mains for k in _below(n)}


def keep_slots(wrapper: html_tree.Node, stats: dict[int, dict]) -> list[int]:
    """The slots of the main region that hold content."""
    nodes = wrapper.preorder()
    furniture = html_tree.spread_furniture(wrapper, len(nodes))
    inside = inside_articles(wrapper)
    own = [0] * len(nodes)
    for n in range(len(nodes)):
        s = stats.get(n)
        if s and not furniture[n]:
            turning = (
                n not in inside
                and s["recurring"] >= RECURRING_SHARE * s["chars"]
                and s["kinds"] <= s["pages"]
                and share_bound(s["kinds"], s["pages"], upper=True) <= FEW_TEXTS
            )
            own[n] = -1 if turning else s["chars"]
    held = [max(0, c) for c in own]
    for node in reversed(nodes):
        for kid in node.kids:
            held[node.number] += held[kid.number]
    total = held[0]
    mains = [n for n in nodes if n.label.partition(" ")[0] in ("article", "main") and not furniture[n.number] and held[n.number]]
    tops, covered = [], set()
    for n in mains:
        if n.number not in covered:
            tops.append(n)
            covered.update(k.number for k in _below(n))
    if tops and sum(held[n.number] for n in tops) >= 0.5 * total:
        articles = [n for n in tops if n.label.partition(" ")[0] == "main"] or tops
        inner = [a for m in articles for a in _below(m) if a.label.partition(" ")[0] == "article" and held[a.number]]
        if inner and sum(held[a.number] for a in inner if a not in articles) >= 0.5 * total:
            articles = inner
        region = {k.number for a in articles for k in _below(a)}
    else:
        region = range(len(nodes))  # title, intro and text may stand beside each other anywhere
    return [n for n in sorted(region) if not furniture[n] and own[n] >= 0]


def _below(node: html_tree.Node) -> list[html_tree.Node]:
    out, todo = [], [node]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(node.kids)
    return out


def _own_rules(root: html_tree.Node, found: list[tuple[int, str]]) -> list[int]:
    """The slots to keep where a page has no host's rules: by its own text."""
    stats: dict[int, dict] = {}
    for n, t in found:
        s = stats.setdefault(n, {"pages": 1, "kinds": 0, "recurring": 0, "chars": 0})
        s["chars"] += len(t)
    return keep_slots(root, stats)


def _extract(keep_columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            texts = []
            for page, rules in zip(batch.column("html").to_pylist(), batch.column("rules").to_pylist()):
                root, blocks = html_tree.parse(page or "")
                nodes = html_tree.fold(root).preorder()
                found = [(e.found().number, t) for e, t in blocks]
                if rules is None:
                    keep, constant = set(_own_rules(root, found)), {}
                else:
                    if rules not in known:
                        if len(known) > 2000:
                            known.clear()
                        told = json.loads(rules)
                        wrapper = html_tree.read(json.dumps(told["wrapper"]))
                        wrapper.preorder()
                        known[rules] = wrapper, set(told["keep"]), {int(k): set(v) for k, v in told["constant"].items()}, {}
                    wrapper, slots, fixed, seen = known[rules]
                    shape = root.text()
                    if shape not in seen:
                        at: dict[int, int] = {}
                        html_tree.place(wrapper, root, at)
                        kept = {i for i in range(len(nodes)) if at.get(i, -1) in slots}
                        seen[shape] = kept, {i: fixed[at[i]] for i in kept if at[i] in fixed}
                    keep, constant = seen[shape]
                texts.append(" ".join(t for n, t in found if n in keep and not (n in constant and _hash(t) in constant[n])))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep_columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [*keep_columns, "text"])

    return run


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every row of ``pages``.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined in page order by one space. Inline elements don't
    part words, line breaks do.

    Defined cases: a null or empty page has the empty text. A null address, or
    one without a host, belongs to the host with the empty name. A page cut off
    in the middle ends there; an unfinished tag is left out. Elements nested
    over a hundred deep are read as part of the hundredth. Repeated rows are
    extracted each. An empty table gives an empty result; other columns are ignored.
    """
    ship(pages.sparkSession)
    rows = pages.select(
        column(id_col).alias("page_id"), column(url_col).alias("url"), column(html_col).alias("html"),
        host_of(column(url_col)).alias("host"),
    )
    parsed = checkpointed(rows.select("host", "html").mapInArrow(_parse, _PARSED))
    trees = checkpointed(parsed.groupBy("host", "tree").agg(F.any_value("shape").alias("shape")))
    wrapper_type = "host long, shape string"
    partly = trees.withColumn("bucket", F.pmod("tree", F.lit(_BUCKETS))).groupBy("host", "bucket").applyInArrow(_merge, wrapper_type)
    wrappers = checkpointed(partly.groupBy("host").applyInArrow(_merge, wrapper_type))
    placed = trees.groupBy("host").cogroup(wrappers.groupBy("host")).applyInArrow(
        _place, "host long, tree long, slots array<int>"
    )
    different = parsed.groupBy("host", "body").agg(F.min(F.struct("tree", "nodes", "texts", "sizes")).alias("page")).select(
        "host", "page.*"
    )
    counted = (
        different.join(placed, ["host", "tree"])
        .select("host", "slots", F.explode(F.array_distinct(F.arrays_zip("nodes", "texts", "sizes"))).alias("t"))
        .select("host", F.get("slots", F.col("t.nodes")).alias("slot"), F.col("t.texts").alias("text"), F.col("t.sizes").alias("chars"))
        .where(F.col("slot") >= 0)
        .groupBy("host", "slot", "text")
        .agg(F.count(F.lit(1)).alias("on"), F.sum("chars").alias("chars"))
    )
    hosts = different.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    share = F.least("on", "pages") / F.col("pages")  # share_bound in SQL
    z = F.lit(SURE * SURE) / F.col("pages")
    half = SURE * F.sqrt((share * (1 - share) + z / 4) / F.col("pages"))
    constant = (share + z / 2 - half) / (1 + z) >= CONSTANT_SHARE
    recurs = F.col("on") >= F.greatest(F.lit(RECURS_ON), RECURS_SHARE * F.col("pages"))
    slots = (
        counted.join(hosts, "host")
        .groupBy("host", "slot")
        .agg(
            F.max("pages").alias("pages"),
            F.sum("chars").alias("chars"),
            F.count(F.lit(1)).alias("kinds"),
            F.sum(F.when(recurs, F.col("chars")).otherwise(0)).alias("recurring"),
            F.collect_list(F.when(constant, F.col("text"))).alias("constant"),
        )
    )
    rules = checkpointed(
        wrappers.groupBy("host").cogroup(slots.groupBy("host")).applyInArrow(_decide, "host long, rules string")
    )
    size = rules.agg(F.sum(F.octet_length("rules") + 8)).first()[0] or 0
    joined = rows.join(F.broadcast(rules) if size <= _BROADCAST_BYTES else rules, "host", "left").select("page_id", "url", "html", "rules")
    fields = [f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in ("page_id", "url")]
    texts = joined.mapInArrow(_extract(["page_id", "url"]), ", ".join([*fields, "text string"]))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
