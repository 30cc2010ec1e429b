"""All keys of a long dictionary in one pass over each text.

An Aho-Corasick automaton of the lower-cased keys reads a text once, whatever
the number of keys, and names every key that ends at each letter. The keys
travel with the function and every task builds the automaton once; texts come
and go in Arrow batches. Like the expressions for short dictionaries it is
row-local: no join, no shuffle, the same in batch and streaming.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from mixscore.sources.dictionary import PropertyDictionary

#: ``first``: index of the first key in the text; ``hits``: sorted first keys of the parts of a mixture.
MATCHES = "first int, hits array<int>"


def _finder(keys: tuple[str, ...], longest: bool) -> Callable:
    # Nested, so that it is sent by value and executors need not have this package.
    built = []

    def find(texts: pa.Array) -> pa.Array:
        if not built:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for i, key in enumerate(keys):
                if not automaton.exists(key):  # of keys that differ in case only, the first counts
                    automaton.add_word(key, i)
            automaton.make_automaton()
            built.append(automaton.iter)
        every, out = built[0], []

        def uncovered(text: str) -> list[tuple[int, int]]:
            """Matches from left to right, the longest at each place, that no earlier one overlaps."""
            at, lengths = 0, {}
            for end, i in every(text):
                start = end + 1 - len(keys[i])
                lengths[start] = max(lengths.get(start, (0, 0)), (len(keys[i]), i))
            taken = []
            for start in sorted(lengths):
                if start >= at:
                    size, i = lengths[start]
                    taken.append((start, i))
                    at = start + size
            return taken

        found = uncovered if longest else every
        for text in texts.to_pylist():
            if text is None:
                out.append((None, None))
            elif "/" in text:
                parts = (min((i for _, i in found(part)), default=None) for part in text.split("/"))
                hits = sorted(i for i in parts if i is not None)
                out.append((hits[0] if hits else None, hits))
            else:
                out.append((min((i for _, i in found(text)), default=None), None))
        first, hits = zip(*out) if out else ((), ())
        return pa.StructArray.from_arrays(
            [pa.array(first, pa.int32()), pa.array(hits, pa.list_(pa.int32()))], ["first", "hits"]
        )

    return find


@lru_cache(maxsize=16)
def _function(dictionary: PropertyDictionary, application: str):
    """One function for each dictionary and application, so that a plan calls it once for both results."""
    keys = tuple(k.lower() for k in dictionary.keys)
    return F.arrow_udf(_finder(keys, dictionary.match == "longest"), MATCHES)


def matches(lowered: Column, dictionary: PropertyDictionary) -> Column:
    """`MATCHES` of a lower-cased text: keys hold no ``/``, so the first key of the text is the least of its parts'."""
    return _function(dictionary, SparkContext.getOrCreate().applicationId)(lowered)
