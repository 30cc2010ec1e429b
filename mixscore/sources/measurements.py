"""Measurement scan: explicit schema, required columns, row identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixscore.functions.text import quoted

# Input columns of the measurement table.
MEASUREMENT_SCHEMA = T.StructType(
    [
        T.StructField("row_id", T.LongType(), False),
        T.StructField("Name", T.StringType()),
        T.StructField("Solvent", T.StringType()),
        T.StructField("Quantum yield(%)", T.DoubleType()),
        T.StructField("Ex(nm)", T.DoubleType()),
        T.StructField("Em(nm)", T.DoubleType()),
        T.StructField("particle size(nm)", T.DoubleType()),
        T.StructField("stoke (nm)", T.DoubleType()),
    ]
)

# Texts a spreadsheet reader takes for a missing cell.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def require_columns(df: DataFrame, names) -> None:
    """Fail early, naming every column that is absent."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"measurement table lacks columns: {', '.join(missing)}")


def scan_measurements(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
    add_row_id: bool = False,
) -> DataFrame:
    """Scan a measurement table from Parquet, ORC, JSON or CSV.

    CSV and JSON are read with ``schema`` (``MEASUREMENT_SCHEMA`` when none is
    given, without ``row_id`` under ``add_row_id``), so nothing is inferred;
    columns beyond it pass through when the given schema names them. In CSV
    texts that mean "missing" become null, and any other text in a numeric
    column is an error that names the column; a malformed JSON record is one as
    well. Parquet and ORC carry their schema. The known columns come out with
    the types of ``MEASUREMENT_SCHEMA`` from every format.

    Every row needs a unique ``row_id``; ``add_row_id`` numbers the rows by
    file name and position, see `with_row_id`.
    """
    reader = spark.read.format(fmt)
    if fmt in ("csv", "json") and schema is None:
        schema = T.StructType([f for f in MEASUREMENT_SCHEMA if not (add_row_id and f.name == "row_id")])
    if fmt == "csv":
        # as texts: the reader itself would turn what it can't parse into null
        texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
        reader = reader.schema(texts).option("header", True).option("enforceSchema", False)
    elif schema is not None:
        reader = reader.schema(schema)
    df = (reader.option("mode", "FAILFAST") if fmt == "json" else reader).load(path)
    if add_row_id:
        df = with_row_id(df, fmt)
    if fmt == "csv":
        types = {f.name: f.dataType for f in schema}
        df = df.select(*[_parsed(c, types[c]).alias(c) if c in types else _col(c) for c in df.columns])
    known = {f.name: f.dataType for f in MEASUREMENT_SCHEMA}
    df = df.select(
        *[
            _col(f.name).cast(known[f.name]).alias(f.name) if f.name in known and f.dataType != known[f.name] else _col(f.name)
            for f in df.schema
        ]
    )
    require_columns(df, MEASUREMENT_SCHEMA.names)
    return df


def _parsed(name: str, kind: T.DataType) -> Column:
    """A CSV cell in its type; null for a text that means missing, an error for one that can't be read."""
    text = F.when(~_col(name).isin(*MISSING_TEXTS), _col(name))
    if isinstance(kind, T.StringType):
        return text
    value = F.trim(text).try_cast(kind)
    problem = F.concat(F.lit(f"column {name}: not of type {kind.simpleString()}: "), text)
    return F.when(text.isNull() | value.isNotNull(), value).otherwise(F.raise_error(problem).cast(kind))


# Columns that exist between two selects only.
_FILE, _PLACE, _FIRST = "__scan_file", "__scan_place", "__scan_first"

# Files or splits whose numbers may be broadcast: about 200 bytes each.
BROADCAST_FILES = 50_000

# Rows that one partition may hold: as many as Spark counts within it.
PARTITION_ROWS = 1 << 33


def with_row_id(df: DataFrame, fmt: str) -> DataFrame:
    """Prepend ``row_id``: gapless from 0 by file name, then by position in the file. Nothing is written.

    Parquet rows know their position. In other formats rows are counted for each
    split of a file, which takes a pass that parses no column; splits are then
    put in order of file and offset. However the files are split, the ids are the same.
    """
    if fmt == "parquet":
        df = df.select(F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index").alias(_PLACE), "*")
        keys = [_FILE]
        sizes = df.groupBy(_FILE).agg((F.max(_PLACE) + 1).alias("__scan_rows"), F.lit(0).alias("__scan_start"))
    else:
        keys = [_FILE, "__scan_split"]
        df = df.select(
            F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(keys[1]),
            F.monotonically_increasing_id().bitwiseAND(F.lit(PARTITION_ROWS - 1)).alias(_PLACE), "*",
        )
        # a partition reads its splits one after the other and counts on
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__scan_rows"), F.min(_PLACE).alias("__scan_start"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)  # one row for each file or split
    first = F.coalesce(F.sum("__scan_rows").over(before), F.lit(0)) - F.col("__scan_start")
    firsts = sizes.select(*keys, first.alias(_FIRST))
    if len(df.inputFiles()) <= BROADCAST_FILES:
        firsts = F.broadcast(firsts)
    own = [_col(c) for c in df.columns if c not in (*keys, _PLACE)]
    return df.join(firsts, keys).select((F.col(_FIRST) + F.col(_PLACE)).alias("row_id"), *own)


def _col(name: str) -> Column:
    return F.col(quoted(name))
