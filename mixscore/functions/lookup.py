"""Keyword lookup against a property dictionary, as row-local expressions.

Nothing here shuffles or joins, so the same expressions serve batch and
streaming DataFrames. Short dictionaries never leave the JVM; long ones, whose
keys would be tried one by one, are matched by an automaton (see `automaton`).
Functions that read an intermediate result take the name of its column: it is
then computed once per row.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixscore.functions.automaton import matches
from mixscore.functions.text import numbers, quoted, string
from mixscore.sources.dictionary import PropertyDictionary

# Keys in one CASE expression, which stops at the first hit; longer dictionaries
# are several of them under a coalesce, which stops as well.
CASE_KEYS = 64

# Keys from which on the automaton is faster than trying them one by one.
AUTOMATON_KEYS = 256


def normalise_key(name: Column) -> Column:
    """Text of the key column; null and ``''`` become ``'Unknown'``.

    Blank-only texts are kept as they are.
    """
    return F.coalesce(F.nullif(name.cast("string"), F.lit("")), F.lit("Unknown"))


def _match(subject: str, dictionary: PropertyDictionary) -> str:
    """SQL text of the index of the first key that ``subject`` contains; else null."""
    if dictionary.match == "longest":
        return _longest(subject, dictionary)
    cases = [f"WHEN contains({subject}, {string(k.lower())}) THEN {i}" for i, k in enumerate(dictionary.keys)]
    blocks = [f"CASE {' '.join(cases[i : i + CASE_KEYS])} END" for i in range(0, len(cases), CASE_KEYS)]
    return blocks[0] if len(blocks) == 1 else f"coalesce({', '.join(blocks)})"


def _longest(subject: str, dictionary: PropertyDictionary) -> str:
    """The same of the keys that leftmost-longest matching finds: an alternation tries the longest first."""
    index: dict[str, int] = {}
    for i, k in enumerate(dictionary.keys):
        index.setdefault(k.lower(), i)
    pattern = "|".join(re.sub(r"([^\w\s])", r"\\\1", k) for k in sorted(index, key=len, reverse=True))
    cases = " ".join(f"WHEN {string(k)} THEN {i}" for k, i in index.items())
    found = f"regexp_extract_all({subject}, {string(pattern)}, 0)"
    return f"array_min(transform({found}, found -> CASE found {cases} END))"


def _by_automaton(dictionary: PropertyDictionary) -> bool:
    return len(dictionary.keys) > AUTOMATON_KEYS


def _literal(values: list, kind: str) -> str:
    """SQL text of a long constant array: one JSON text, read once when the query is planned."""
    return f"from_json({string(json.dumps(values))}, 'array<{kind}>')"


def first_match(lowered: str, dictionary: PropertyDictionary) -> Column:
    """Index of the first key, in dictionary order, contained in the lower-cased text; else null."""
    if _by_automaton(dictionary):
        return matches(F.col(quoted(lowered)), dictionary)["first"]
    return F.expr(_match(quoted(lowered), dictionary))


def label_of(first: str, dictionary: PropertyDictionary) -> Column:
    """Key at an index of ``first_match``, or ``'Other'``."""
    # get, unlike element_at, keeps a null index null.
    if len(dictionary.keys) > CASE_KEYS:
        keys = _literal(list(dictionary.keys), "string")
    else:
        keys = "array(" + ", ".join(string(k) for k in dictionary.keys) + ")"
    return F.expr(f"coalesce(get({keys}, {quoted(first)}), 'Other')")


def with_main_label(
    df: DataFrame, key: Column, dictionary: PropertyDictionary, label: str = "Solvent_Main"
) -> DataFrame:
    """Append the first key contained in the whole text, or ``'Other'``."""
    lowered, first = "__mix_lowered", "__mix_first"
    matched = df.withColumn(lowered, F.lower(key)).withColumn(first, first_match(lowered, dictionary))
    return matched.withColumn(label, label_of(first, dictionary)).drop(lowered, first)


def mixture_hits(lowered: str, dictionary: PropertyDictionary) -> Column:
    """Sorted dictionary indexes of the ``/``-separated parts, at most one per part.

    Repeated parts repeat, unmatched and empty parts vanish. A text without a
    separator is no mixture and has none: its index is ``first_match``.
    """
    if _by_automaton(dictionary):
        return matches(F.col(quoted(lowered)), dictionary)["hits"]
    text = quoted(lowered)
    found = f"transform(split({text}, '/'), part -> {_match('part', dictionary)})"
    return F.expr(f"CASE WHEN contains({text}, '/') THEN sort_array(array_compact({found})) END")


def mixture_profile(first: str, hits: str, dictionary: PropertyDictionary) -> Column:
    """Mean of every property over the matched parts, as an array in dictionary order.

    ``first`` and ``hits`` name columns of ``first_match`` and ``mixture_hits``.
    Without a match the default row is returned. A property missing for one of
    the parts is missing for the mixture.
    """
    if len(dictionary.keys) > CASE_KEYS:
        table = _literal([list(row) for row in dictionary.rows], "array<double>")
    else:
        table = "array(" + ", ".join(numbers(row) for row in dictionary.rows) + ")"
    zeros = numbers([0.0] * len(dictionary.properties))
    f, h = quoted(first), quoted(hits)
    return F.expr(
        f"CASE WHEN size({h}) > 0 THEN transform(aggregate({h}, {zeros}, (total, i) -> "
        f"zip_with(total, get({table}, i), (a, b) -> a + b)), total -> total / size({h})) "
        f"ELSE get({table}, coalesce({f}, {dictionary.default_index})) END"
    )
