"""Measurement and feature views that both sides derive from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixscore.sources.dictionary import DictionaryTable, PropertyDictionary, dictionary_from

# Solvent text of a part: entry p_partkey % 16; the empty text is a missing value.
SOLVENT_TEXTS = (
    "Water", "Ethanol", "methanol", "DMF", "DMSO", "Acetone", "acetonitrile",
    "Acetic_acid", "Ethyl_acetate", "Pyridine", "THF", "DMF/Water",
    "Ethanol/Water/water", "Toluene", "Toluene/THF", "",
)

# Numeric pass-through columns of the measurement view, the same text on both sides.
QUANTITIES = {
    "Quantum yield(%)": "CAST(p_size AS DOUBLE) * 2",
    "Ex(nm)": "CAST(p_size AS DOUBLE) + 300",
    "Em(nm)": "p_retailprice",
    "particle size(nm)": "CAST(p_size AS DOUBLE) / 4",
    "stoke (nm)": "p_retailprice - (CAST(p_size AS DOUBLE) + 300)",
}

LINE_FEATURES = ("l_quantity", "l_extendedprice", "l_discount")
LINE_FEATURES_4 = LINE_FEATURES + ("l_tax",)


# Columns the queries read; a known schema spares the inference job.
SCHEMAS = {
    "part": "p_partkey BIGINT, p_name STRING, p_size INT, p_retailprice DOUBLE",
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, "
        "l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING"
    ),
    "documents": "doc_id BIGINT, text STRING",
    "pages": "page_id BIGINT, html STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measurement table: every part with a solvent text."""
    texts = "array(" + ", ".join(f"'{s}'" for s in SOLVENT_TEXTS) + ")"
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS row_id",
        "p_name AS Name",
        f"nullif(get({texts}, CAST(p_partkey % 16 AS INT)), '') AS Solvent",
        *[f"{text} AS `{name}`" for name, text in QUANTITIES.items()],
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def gappy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with missing values: null discounts, NaN taxes, a constant column."""
    return lines(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
        F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_returnflag") == "R", F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("l_tax"),
        F.lit(0.1).alias("constant"),
    )


# One key for each part, and a text for each line item that names its part in one of four ways.
PART_KEY = "p_name || ' ' || p_partkey"
LINE_TEXT = (
    "CASE l_linenumber % 4 WHEN 0 THEN 'Lot of ' || upper(p_name) || ' ' || l_partkey "
    "WHEN 1 THEN p_name || ' ' || l_partkey || '/spare/' || p_name || ' ' || (l_partkey - l_partkey % 10) "
    "WHEN 2 THEN p_name || l_partkey ELSE p_name || ' ' || l_partkey || '0/' END"
)


def part_dictionary(spark: SparkSession, sf_dir: str) -> PropertyDictionary | DictionaryTable:
    """A dictionary of as many keys as there are parts, in the order of their numbers."""
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS ord", f"{PART_KEY} AS key", "CAST(p_size AS DOUBLE) AS size", "p_retailprice AS price"
    )
    return dictionary_from(rows, default_key=rows.orderBy("ord").first()["key"])


def line_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, l_partkey, t): line items with a text that names their part."""
    names = table(spark, sf_dir, "part").selectExpr("p_partkey AS l_partkey", "p_name")
    joined = lines(spark, sf_dir).join(names, "l_partkey")
    return joined.selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"{LINE_TEXT} AS t")
