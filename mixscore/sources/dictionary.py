"""The built-in dimensions: solvent properties, feature weights, display labels."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixscore.sources.shared import small_frame

# Property columns of the dictionary, then one row per key.
# The order of the rows is the lookup order.
_PROPERTIES = (
    "mw", "density", "mp", "bp", "eps", "dipole", "etn", "visc",
    "st", "hild", "hbd", "hba", "coord", "logp", "ri",
)
_ROWS = (
    ("Water", 18.02, 1.00, 0, 100, 80.10, 1.85, 1.00, 1.00, 72.80, 47.90, 1, 2, 0.5, -1.38, 1.333),
    ("Ethanol", 46.07, 0.789, -114.1, 78.37, 24.55, 1.69, 0.654, 1.20, 22.27, 26.50, 1, 1, 0.3, -0.31, 1.361),
    ("Methanol", 32.04, 0.792, -97.6, 64.7, 32.70, 1.70, 0.762, 0.55, 22.50, 29.60, 1, 1, 0.3, -0.77, 1.329),
    ("DMF", 73.09, 0.944, -61, 153, 38.25, 3.86, 0.404, 0.92, 37.10, 24.80, 0, 1, 0.8, -1.01, 1.430),
    ("DMSO", 78.13, 1.100, 18.5, 189, 46.45, 3.96, 0.444, 2.00, 43.00, 26.70, 0, 1, 0.9, -1.35, 1.479),
    ("Acetone", 58.08, 0.791, -94.7, 56.05, 20.70, 2.88, 0.355, 0.32, 23.70, 20.00, 0, 1, 0.4, -0.24, 1.359),
    ("Acetonitrile", 41.05, 0.786, -45, 82, 37.50, 3.92, 0.460, 0.35, 29.30, 24.40, 0, 1, 0.6, -0.34, 1.344),
    ("Acetic_acid", 60.05, 1.049, 16.6, 118.1, 6.20, 1.74, 0.648, 1.22, 27.60, 21.40, 1, 2, 0.3, -0.17, 1.372),
    ("Ethyl_acetate", 88.11, 0.902, -83.6, 77.1, 6.02, 1.78, 0.228, 0.45, 23.90, 18.60, 0, 2, 0.2, 0.73, 1.372),
    ("Pyridine", 79.10, 0.983, -41.6, 115.2, 12.40, 2.22, 0.302, 0.94, 38.00, 21.80, 0, 1, 0.7, 0.65, 1.509),
    ("THF", 72.11, 0.889, -108.4, 66, 7.58, 1.75, 0.207, 0.55, 26.40, 19.50, 0, 1, 0.6, 0.46, 1.407),
)

# Order of the PCA feature vector.
FEATURES = (
    "eps", "dipole", "etn", "visc", "st", "hild", "hbd", "hba",
    "coord", "logp", "bp", "density", "mw", "mp", "ri",
)

# Initial weight of each feature.
INITIAL_WEIGHTS = {
    "eps": 1.5, "dipole": 1.3, "etn": 1.8, "visc": 0.8, "st": 0.7,
    "hild": 1.0, "hbd": 1.4, "hba": 1.2, "coord": 1.6, "logp": 0.9,
    "bp": 0.6, "density": 0.5, "mw": 0.4, "mp": 0.3, "ri": 0.5,
}

# Label of each property in the written tables.
DISPLAY_LABELS = {
    "mw": "Molecular weight",
    "density": "Density (g mL$^{-1}$)",
    "mp": "Melting point (°C)",
    "bp": "Boiling point (°C)",
    "eps": "Dielectric constant",
    "dipole": "Dipole moment (D)",
    "etn": "Polarity parameter $E_T^N$",
    "visc": "Viscosity (cP)",
    "st": "Surface tension (dyn cm$^{-1}$)",
    "hild": "Hildebrand solubility",
    "hbd": "H-bond donor",
    "hba": "H-bond acceptor",
    "coord": "Coordination ability",
    "logp": "Hydrophobicity logP",
    "ri": "Refractive index",
}


#: Keys that a dictionary read from a table may hold.
MOST_KEYS = 100_000


@dataclass(frozen=True)
class PropertyDictionary:
    """Ordered keys with one value per property.

    A key is matched as a lower-cased substring of one ``/``-separated part, so
    keys must not hold a separator or blank edges. ``default_key`` names the
    row used when nothing matches. With ``match="first"`` every key inside a part
    counts and the first in dictionary order wins; with ``"longest"`` a key does
    not count where a longer one covers it, so ``methanol`` is no ``ethanol``.
    """

    properties: tuple[str, ...]
    keys: tuple[str, ...]
    rows: tuple[tuple[float | None, ...], ...]
    default_key: str
    match: str = "first"

    def __post_init__(self) -> None:
        if self.match not in ("first", "longest"):
            raise ValueError(f"match must be 'first' or 'longest', not {self.match!r}")
        if len(self.keys) != len(self.rows) or len(set(self.keys)) != len(self.keys):
            raise ValueError("dictionary needs one row per distinct key")
        for key, row in zip(self.keys, self.rows):
            if not key or key != key.strip() or "/" in key:
                raise ValueError(f"key {key!r} is empty, has blank edges or contains '/'")
            if len(row) != len(self.properties):
                raise ValueError(f"key {key!r} has {len(row)} values, expected {len(self.properties)}")
        if self.default_key not in self.keys:
            raise ValueError(f"default key {self.default_key!r} is not in the dictionary")

    @classmethod
    def from_rows(cls, properties, rows, default_key: str, match: str = "first") -> PropertyDictionary:
        """Build from ``(key, value, value, ...)`` tuples; ``None``/NaN means missing."""
        return cls(
            properties=tuple(properties),
            keys=tuple(r[0] for r in rows),
            rows=tuple(
                tuple(None if v is None or math.isnan(v) else float(v) for v in r[1:]) for r in rows
            ),
            default_key=default_key,
            match=match,
        )

    @classmethod
    def from_frame(
        cls, df: DataFrame, default_key: str, key: str = "key", order: str = "ord", match: str = "first"
    ) -> PropertyDictionary:
        """Build from a table: keys in the order of one column, a property for each other column.

        The table is collected, so it is counted first: over `MOST_KEYS` keys are an error.
        """
        if df.limit(MOST_KEYS + 1).count() > MOST_KEYS:
            raise ValueError(f"a dictionary holds at most {MOST_KEYS} keys")
        properties = [c for c in df.columns if c not in (key, order)]
        rows = df.orderBy(order).select(key, *properties).collect()
        return cls.from_rows(properties, [tuple(r) for r in rows], default_key, match)

    @property
    def default_index(self) -> int:
        return self.keys.index(self.default_key)

    def values(self, prop: str) -> list[float | None]:
        """Values of one property in lookup order."""
        i = self.properties.index(prop)
        return [row[i] for row in self.rows]

    def frame(self, spark: SparkSession) -> DataFrame:
        """The dictionary as a dimension table ``(ord, key, <properties>)``."""
        schema = pa.schema(
            [("ord", pa.int32()), ("key", pa.string())] + [(p, pa.float64()) for p in self.properties]
        )
        return small_frame(
            spark, [(i, k, *row) for i, (k, row) in enumerate(zip(self.keys, self.rows))], schema
        )


#: Blank edges of a key, as `str.strip` knows them.
_EDGES = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


@dataclass(frozen=True)
class DictionaryTable:
    """A dictionary of any number of keys that stays a table, with the rules of ``match="first"``.

    ``frame`` holds the keys, a column of their order and a property in each other column.
    """

    frame: DataFrame
    default_key: str
    key: str = "key"
    order: str = "ord"

    @property
    def properties(self) -> tuple[str, ...]:
        return tuple(c for c in self.frame.columns if c not in (self.key, self.order))

    def keyed(self) -> DataFrame:
        """(ord, key, __mix_p0, __mix_p1, ...): missing values are null."""
        named = {c: F.col("`" + c.replace("`", "``") + "`") for c in self.frame.columns}
        null = F.lit(None).cast("double")
        values = [F.nanvl(named[p].cast("double"), null).alias(f"__mix_p{i}") for i, p in enumerate(self.properties)]
        return self.frame.select(named[self.order].alias("ord"), named[self.key].alias("key"), *values)

    def check(self) -> None:
        """Refuse the keys that `PropertyDictionary` refuses."""
        key = F.col("key")
        bad = key.isNull() | (key == "") | F.contains(key, F.lit("/")) | key.rlike(f"^{_EDGES}|{_EDGES}\\z")
        keys = self.keyed().select("key")
        for row in keys.where(bad).limit(1).collect():
            raise ValueError(f"key {row[0]!r} is empty, has blank edges or contains '/'")
        if keys.groupBy("key").count().where("count > 1").limit(1).count():
            raise ValueError("dictionary needs one row per distinct key")

    def default_row(self) -> tuple[float | None, ...]:
        rows = self.keyed().where(F.col("key") == self.default_key).drop("ord", "key").limit(1).collect()
        if not rows:
            raise ValueError(f"default key {self.default_key!r} is not in the dictionary")
        return tuple(rows[0])


def dictionary_from(df: DataFrame, default_key: str, key: str = "key", order: str = "ord") -> PropertyDictionary | DictionaryTable:
    """The dictionary of a table: collected up to `MOST_KEYS` keys, beyond them left as a table."""
    if df.limit(MOST_KEYS + 1).count() > MOST_KEYS:
        return DictionaryTable(df, default_key, key, order)
    return PropertyDictionary.from_frame(df, default_key, key, order)


SOLVENTS = PropertyDictionary.from_rows(_PROPERTIES, _ROWS, default_key="Water")


def weights_frame(spark: SparkSession, weights: dict[str, float] = INITIAL_WEIGHTS) -> DataFrame:
    """Feature weights as ``(ord, property, weight)`` in feature order."""
    schema = pa.schema([("ord", pa.int32()), ("property", pa.string()), ("weight", pa.float64())])
    return small_frame(spark, [(i, p, float(w)) for i, (p, w) in enumerate(weights.items())], schema)


def labels_frame(spark: SparkSession, labels: dict[str, str] = DISPLAY_LABELS) -> DataFrame:
    """Display labels as ``(property, label)``."""
    schema = pa.schema([("property", pa.string()), ("label", pa.string())])
    return small_frame(spark, list(labels.items()), schema)
