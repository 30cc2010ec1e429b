"""Drop lines that many documents share, keeping each in one document.

Lines are exploded, normalised and hashed; distinct documents are counted for
each hash; the lines of hashes over the threshold are dropped by position and
the documents put together again.

Only hashes are shuffled to be counted and looked up, never lines. Every (hash, document)
pair is made distinct before counting, so a line that a third of all documents
hold arrives as one row for each of them, spread by both columns, and its
count combines before the second shuffle.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from mixscore.llm.common import ASCII_BLANKS, ascii_lower, checkpointed, column, fresh_name, ship, within_bound


@pandas_udf(StringType())
def _without_lines(text: pd.Series, drop: pd.Series) -> pd.Series:
    """Each text without the lines at the given positions; null where nothing is to be dropped."""
    out = []
    for t, positions in zip(text, drop):
        if t is None:
            out.append(None)
            continue
        gone = set(positions)
        out.append("\n".join(line for i, line in enumerate(t.split("\n")) if i not in gone))
    return pd.Series(out, dtype=object)


def _keyed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, version, pos, k1, k2) of every line whose key is long enough to count.

    Two independent 64-bit hashes stand for a key. ``version`` is the hash of
    the whole text: rows that repeat an id with another text stay apart.
    """
    lines = docs.select(
        column(id_col).alias("doc"),
        F.xxhash64(column(text_col)).alias("version"),
        F.posexplode(F.split(column(text_col), "\n", -1)).alias("pos", "line"),
    ).where(F.length("line") >= min_chars)
    keys = lines.select(
        "doc", "version", "pos", ascii_lower(F.btrim(F.col("line"), F.lit(ASCII_BLANKS))).alias("key")
    ).where(F.length("key") >= min_chars)
    return keys.select(
        "doc", "version", "pos",
        F.xxhash64("key").alias("k1"),
        F.xxhash64(F.lit("second"), F.col("key")).alias("k2"),
    )


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    n_lines: str = "n_lines",
    n_dropped: str = "n_dropped",
    n_chars_col: str | None = None,
) -> DataFrame:
    """``docs`` with repeated lines dropped from ``text_col``, and two more columns of counts.

    A line's key is the line stripped of ASCII white space at both ends, A to Z
    in lower case. A key of at least ``min_chars`` code points found in at least
    ``min_docs`` distinct documents loses all its lines except those in the
    largest id that holds it. ``n_lines`` counts the lines before dropping.
    A column named by ``n_chars_col`` is set to the length of a text that lost a line.

    Defined cases: a null or empty text is one empty line and stays as it is.
    A line repeated inside one document counts one document; in the document
    that keeps it, all its repeats stay. Rows that repeat an id are one document
    for counting and each keeps its own row. A null id counts as one document,
    smaller than every other. An empty table gives an empty table. Other
    columns pass through; a counter whose name is taken gets an underscore.
    """
    ship(docs.sparkSession)
    n_lines, n_dropped = fresh_name(docs, n_lines), fresh_name(docs, n_dropped)
    keyed = _keyed_lines(docs, id_col, text_col, min_chars)
    common = (
        keyed.select("k1", "k2", "doc")
        .distinct()
        .groupBy("k1", "k2")
        .agg(F.count(F.lit(1)).alias("found_in"), F.max("doc").alias("keeper"))
        .where(F.col("found_in") >= min_docs)
        .select("k1", "k2", "keeper")
    )
    # Kept as a table, so that the join is by broadcast, or splits a key with very many lines.
    common = within_bound(checkpointed(common))
    doc, version, drop = (fresh_name(docs, n) for n in ("__doc", "__version", "__drop"))
    drops = (
        keyed.join(common, ["k1", "k2"])
        .where(~F.col("doc").eqNullSafe(F.col("keeper")))
        .groupBy("doc", "version")
        .agg(F.collect_set("pos").alias(drop))
        .withColumnsRenamed({"doc": doc, "version": version})
    )
    text = column(text_col)
    joined = docs.join(drops, column(id_col).eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(version)), "left")
    drop = F.col(drop)
    # Only texts that lose a line visit Python; the others pass as they are.
    cut = _without_lines(F.when(drop.isNotNull(), text), drop)
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    changed = {text_col: F.when(drop.isNull(), text).otherwise(cut)}
    if n_chars_col:
        changed[n_chars_col] = F.when(drop.isNull(), column(n_chars_col)).otherwise(F.length(cut))
    return joined.select(
        *[changed[c].alias(c) if c in changed else column(c) for c in docs.columns],
        F.coalesce(newlines + 1, F.lit(1)).cast("long").alias(n_lines),
        F.coalesce(F.size(drop), F.lit(0)).cast("long").alias(n_dropped),
    )
