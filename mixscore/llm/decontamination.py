"""Find benchmark items inside documents: size-partitioned MinHash containment search.

All of it is DataFrame expressions. An item of ``n`` distinct shingles that a
document contains to at least ``t`` misses at most ``floor((1 - t) n)`` of
them. So of the ``floor((1 - t) u) + 1`` shingles with the smallest hashes
(its bottom MinHash sketch) at least one is in the document, where ``u`` is
the largest size of the item's partition; items are partitioned by powers of
two of their size. The search therefore looks up only sketch hashes and loses
no document; long documents need no sketch of their own, whose chance to meet
a short item's would vanish. What it finds is verified on the shingles
themselves.

Documents are read with their own columns only and never shuffled: their
shingles are hashed and looked up in place. The sketches are broadcast while
they are counted to be few; beyond that Spark joins by shuffle on the hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixscore.llm.common import checkpointed, column, fresh_name, within_bound


def _words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.length(plain) > 0, F.split(plain, " "))


def _shingles(words: Column, size: int, make) -> Column:
    """An array of ``make(words of the shingle)``; null with fewer words than ``size``."""
    return F.when(
        F.size(words) >= size,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - size),
            lambda i: make(*[F.get(words, i + F.lit(k)) for k in range(size)]),
        ),
    )


def _joined(*words: Column) -> Column:
    return F.concat_ws(" ", *words)


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    words: int = 5,
    containment: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_item, n_found, containment): every item that a document contains.

    Words are lower-case runs of letters and digits, so case, punctuation and
    line breaks don't hide a passage. ``n_item`` counts an item's distinct
    shingles of ``words`` words, ``n_found`` those in the document; pairs with
    ``n_found >= containment * n_item`` are returned, one row for each.

    Defined cases: a null or empty text, and an item or document with fewer
    than ``words`` words, contains and is contained in nothing. Items with equal
    texts are found each by its id. Rows that repeat an id count as one document
    for each different text, and the best of them is returned. Null ids are kept
    as null. Empty tables give an empty result; other columns are ignored.
    """
    allowed = F.floor(F.lit(round(1 - containment, 12)) * F.col("n_item") + F.lit(1e-9))
    item = checkpointed(
        items.select(column(item_id_col).alias("item_id"), _words(column(item_text_col)).alias("w"))
        .select("item_id", F.array_distinct(_shingles(F.col("w"), words, _joined)).alias("shingles"))
        .where(F.col("shingles").isNotNull())
        .distinct()
        .select(
            F.xxhash64("item_id", "shingles").alias("item"), "item_id", "shingles",
            F.size("shingles").alias("n_item"),
            F.ceil(F.log2(F.size("shingles"))).alias("size_class"),
        )
    )
    largest = item.groupBy("size_class").agg(F.max(allowed).alias("most_missed"))
    sketch = (
        item.join(largest, "size_class")
        .select(
            "item",
            (F.least(F.col("most_missed") + 1, F.col("n_item")) - allowed).alias("needed"),
            F.explode(
                F.slice(
                    F.array_sort(F.array_distinct(F.transform("shingles", lambda s: F.xxhash64(F.split(s, " "))))),
                    F.lit(1),
                    (F.col("most_missed") + 1).cast("int"),
                )
            ).alias("h"),
        )
    )
    sketch = within_bound(checkpointed(sketch))

    text = column(text_col)
    rows = docs.select(column(id_col).alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))
    tokens = rows.select("doc", "version", _words(F.col("text")).alias("w"))
    hashes = tokens.select(
        "doc", "version", F.explode(_shingles(F.col("w"), words, lambda *w: F.xxhash64(F.array(*w)))).alias("h")
    )
    candidates = checkpointed(
        hashes.join(sketch, "h")
        .groupBy("doc", "version", "item")
        .agg(F.count_distinct("h").alias("hits"), F.first("needed").alias("needed"))
        .where(F.col("hits") >= F.col("needed"))
        .select("doc", "version", "item")
    )

    found_in = within_bound(candidates.select("doc", "version").distinct())
    again = rows.join(
        found_in.withColumnsRenamed({"doc": "cdoc", "version": "cversion"}),
        F.col("doc").eqNullSafe(F.col("cdoc")) & (F.col("version") == F.col("cversion")),
        "left_semi",
    )
    # The words are a column of their own: inside the shingles' expression they would be made anew for each.
    present = again.select("doc", "version", _words(F.col("text")).alias("w")).select(
        "doc", "version", F.explode(_shingles(F.col("w"), words, _joined)).alias("shingle")
    )
    sought = within_bound(item.select("item", F.explode("shingles").alias("shingle")))
    found = (
        present.join(sought, "shingle")
        .groupBy("doc", "version", "item")
        .agg(F.count_distinct("shingle").alias("n_found"))
    )
    verified = (
        found.withColumnsRenamed({"doc": "fdoc", "version": "fversion", "item": "fitem"})
        .join(
            candidates,
            F.col("fdoc").eqNullSafe(F.col("doc"))
            & (F.col("fversion") == F.col("version"))
            & (F.col("fitem") == F.col("item")),
        )
        .select("doc", "item", "n_found")
        .join(item.select("item", "item_id", "n_item"), "item")
        .where(F.col("n_found") >= F.col("n_item") - allowed)
    )
    return verified.groupBy(F.col("doc").alias("doc_id"), "item_id").agg(
        F.max("n_item").cast("long").alias("n_item"),
        F.max("n_found").cast("long").alias("n_found"),
        F.max(F.col("n_found") / F.col("n_item")).alias("containment"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without those that contain an item; a null id is never dropped by another's match."""
    hit = fresh_name(docs, "__hit")
    hits = contained_items(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias(hit)).distinct()
    return docs.join(within_bound(checkpointed(hits)), column(id_col) == F.col(hit), "left_anti")
