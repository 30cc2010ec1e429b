"""Enrichment by a dictionary that stays a table: no key passes through the driver or a plan.

A text that contains a key contains every gram of it. Each key is filed under
one of its grams, the rarest among all keys, and the grams of the distinct
parts of texts are joined with those; a pair found that way counts only if the
part contains the whole key. A gram's length follows from the key's, so texts are
cut into grams of a few lengths whatever the number of keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixscore.functions.lookup import normalise_key
from mixscore.functions.text import quoted
from mixscore.sources.dictionary import DictionaryTable

#: Lengths of grams; a key has grams of the largest that isn't longer than the key.
GRAMS = (1, 2, 3, 4, 6, 8, 11, 16, 23, 32)

#: Grams that are taken from one piece of a text, since every gram is looked for from its piece's beginning.
PIECE = 256


def _grams(df: DataFrame, text: str, size: str) -> DataFrame:
    """A row ``gram`` (a hash) for every place where a gram of ``size`` letters begins in ``text``."""
    first = df.where(f"length({text}) >= {size}").withColumn(
        "__at", F.expr(f"explode(sequence(0, CAST((length({text}) - {size}) DIV {PIECE} AS INT)))")
    )
    pieces = first.withColumn("__piece", F.expr(f"substring({text}, __at * {PIECE} + 1, {PIECE} - 1 + {size})"))
    placed = pieces.withColumn("__at", F.expr(f"explode(sequence(1, length(__piece) - {size} + 1))"))
    return placed.withColumn("gram", F.expr(f"xxhash64(substring(__piece, __at, {size}))")).drop("__at", "__piece")


def _filed(keys: DataFrame) -> DataFrame:
    """``keys`` (key, low, entry) with the hash and the size of the gram each is filed under."""
    size = "CASE " + " ".join(f"WHEN length(low) >= {g} THEN {g}" for g in reversed(GRAMS)) + " END"
    grams = _grams(keys.select("key", "low").withColumn("size", F.expr(size)), "low", "size")
    grams = grams.select("key", "size", "gram").distinct()
    often = grams.groupBy("size", "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = grams.join(often, ["size", "gram"]).groupBy("key").agg(F.min(F.struct("n", "gram", "size")).alias("best"))
    return keys.join(rarest, "key").select("low", "entry", "best.gram", "best.size")


def enrich_by_table(df: DataFrame, dictionary: DictionaryTable, solvent: str = "Solvent") -> DataFrame:
    """What ``enrich`` appends, for a dictionary of any number of keys; Spark joins where ``enrich`` works row by row.

    Every distinct text is looked up once. Keys that differ in case only count as
    the first of them; equal places in the order are told apart by the key.
    """
    dictionary.check()
    text = "__mix_text"
    rows = df.withColumn(text, F.lower(normalise_key(F.col(quoted(solvent)))))
    values = [f"__mix_p{i}" for i in range(len(dictionary.properties))]
    entry = F.struct("ord", "key", *values)
    keys = dictionary.keyed().select("key", F.lower("key").alias("low"), entry.alias("entry"))

    texts = rows.select(text).distinct()
    split = texts.select(text, F.explode(F.split(text, "/")).alias("part")).withColumn("id", F.xxhash64("part"))
    parts = split.select("id", "part").distinct()
    filed = _filed(keys)
    # the sizes in use are at most as many as GRAMS, so texts are cut into no others
    sizes = sorted(r[0] for r in filed.select("size").distinct().collect())
    sized = parts.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    pairs = _grams(sized, "part", "size").select("id", "size", "gram").join(filed, ["size", "gram"])
    # parts of one id by chance are each held against the key
    found = (
        pairs.select("id", "low", "entry").join(parts, "id").where(F.contains("part", "low"))
        .groupBy("id", "part").agg(F.min("entry").alias("entry"))
    )
    # in dictionary order, as row-local enrichment adds them up
    hits = split.join(found, ["id", "part"]).groupBy(text).agg(F.sort_array(F.collect_list("entry")).alias("hits"))
    means = [
        f"aggregate(hits, 0.0D, (total, hit) -> total + hit.{v}) / size(hits) AS {v}" for v in values
    ]
    profiles = hits.selectExpr(text, "hits[0].key AS __mix_label", *means)
    default = dictionary.default_row()
    replaced = {c.lower() for c in ("Solvent_Main", *dictionary.properties)}
    own = [F.col(quoted(c)) for c in df.columns if c.lower() not in replaced]
    profile = [
        F.when(F.col("__mix_label").isNull(), F.lit(d).cast("double")).otherwise(F.col(v)).alias(p)
        for v, p, d in zip(values, dictionary.properties, default)
    ]
    return rows.join(profiles, text, "left").select(
        *own, F.coalesce("__mix_label", F.lit("Other")).alias("Solvent_Main"), *profile
    )
