"""Group spelling variants with an index of variable-length grams.

Two words are near if one inserted, deleted or replaced letter makes one of the
other. A gram starts at every letter of a word and ends with the first of its
beginnings that is rare in the vocabulary, or at the longest length allowed:
the dictionary holds the frequent grams alone, whose extensions are needed.
Whether a gram ends depends on its own letters only, so an edit changes no
gram that doesn't span it. At most ``affected`` grams of a word span any one
place; so of any word near it, all but that many of its grams are found there.

List merging follows that bound. Sorted by rarity, the first ``affected + 1``
grams of two near words share one that lies before the edit in both, or after
it in both. Before the edit, the words agree up to the end of the gram, after
it from its start on. Lists are therefore kept by gram and that context (one
key of 64 bits), which leaves few words in a list; what meets in one is verified.
No word is without a list, because the longest gram is shorter than any word.

The dictionary is a table of `BUCKETS` hashed counts, whatever the vocabulary's
size. Grams that share a bucket count as one in all words alike, which loses no pair.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixscore.llm import bytetext
from mixscore.llm.common import checkpointed, column, ship, within_bound

#: Hashed gram counts in the dictionary: 8 MB.
BUCKETS = 1 << 20

#: A gram in at most this many places of the vocabulary is rare and is not extended.
RARE = 64

SHORTEST_GRAM = 2

#: Words in a list that are compared pair by pair; longer lists are split by what their words have left.
SHORT_LIST = 32

#: Distinct words that a task adds up before it hands them on.
REMEMBERED_WORDS = 200_000

_U64 = np.uint64
_BASE = _U64(0x9E3779B97F4A7C15 | 1)
_BEFORE, _AFTER = _U64(0x5BF03635), _U64(0xA0761D64)


def _count_runs(least: int, spoil: int):
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def flushed(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            for part in bytetext.slices(batch, "text"):
                for doc, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                    seen = Counter(runs.findall((text or "").encode().lower().decode()))  # bytes lower only A to Z
                    if spoil:
                        start = zlib.crc32(f"{doc}:".encode())
                        hit = [w for w in seen if zlib.crc32(w.encode(), start) % spoil == 0]
                        for w in hit:
                            at = zlib.crc32(w.encode(), start) % len(w)
                            n = seen.pop(w)
                            if len(w) > least:
                                shorter = w[:at] + w[at + 1 :]
                                counts[shorter] = counts.get(shorter, 0) + n
                    for w, n in seen.items():
                        counts[w] = counts.get(w, 0) + n
                    if len(counts) > REMEMBERED_WORDS:
                        yield flushed(counts)
                        counts = {}
        yield flushed(counts)

    return run


def counted_runs(docs: DataFrame, least: int, spoil: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of Latin letters with A to Z in lower case, and how often each occurs.

    With ``spoil`` s over 0, a letter is deleted from every run whose CRC-32 of
    ``<id>:<run>`` is divisible by s: the one at that number's remainder by the
    length. Only results of ``least`` letters or more are counted. Tasks add
    up what they read, so a frequent word is a few rows when it is shuffled.

    Defined cases: a null text has no runs, a null id counts as empty text.
    """
    ship(docs.sparkSession)
    rows = docs.select(
        F.coalesce(column(id_col).cast("string"), F.lit("")).alias("id"), column(text_col).alias("text")
    )
    parts = rows.mapInArrow(_count_runs(least, spoil), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class Grams:
    """The variable-length grams of a batch of words, one for each letter."""

    def __init__(self, words: pa.Array, longest: int) -> None:
        codes = [np.frombuffer(w.encode("utf-32-le"), "<u4") for w in words.to_pylist()]
        self.length = np.array([len(c) for c in codes], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        flat = np.concatenate(codes) if codes else np.empty(0, np.uint32)
        self.word = np.repeat(np.arange(len(codes)), self.length)
        self.place = np.arange(len(flat)) - np.repeat(self.first, self.length)
        self.left = np.repeat(self.length, self.length) - self.place
        self.value = bytetext.mix(flat.astype(_U64) + _U64(1))
        # hashes[k]: of the k + 1 letters from here on; the word's end repeats as a letter 0
        padded = np.concatenate([self.value, np.zeros(longest, _U64)])
        h = self.value
        self.hashes = [h]
        for k in range(1, longest):
            letter = np.where(self.left > k, padded[k : k + len(flat)], _U64(0))
            h = bytetext.mix(h * _BASE + letter)
            self.hashes.append(h)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and how many grams of each length from `SHORTEST_GRAM` on fall there."""
        every = np.concatenate(self.hashes[SHORTEST_GRAM - 1 :])
        return np.unique(every % _U64(BUCKETS), return_counts=True)

    def decompose(self, frequency: np.ndarray, rare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each gram's length, hash and frequency."""
        size = np.full(len(self.value), SHORTEST_GRAM)
        h = self.hashes[SHORTEST_GRAM - 1].copy()
        often = frequency[(h % _U64(BUCKETS)).astype(np.int64)]
        for k in range(SHORTEST_GRAM, len(self.hashes)):
            longer = (often > rare) & (size == k)
            size[longer] = k + 1
            h[longer] = self.hashes[k][longer]
            often[longer] = frequency[(h[longer] % _U64(BUCKETS)).astype(np.int64)]
        return size, h, often

    def affected(self, size: np.ndarray) -> np.ndarray:
        """For each word the most grams that span one place, its end included."""
        change = np.zeros(len(self.value) + len(self.length), np.int64)  # a place more for each word: its end
        at = np.arange(len(self.value)) + self.word
        change[at] += 1
        stop = at + size
        inside = size <= self.left
        change -= np.bincount(stop[inside], minlength=len(change))
        # grams that span the end stop with the word
        spanning = np.bincount(self.word[~inside], minlength=len(self.length))
        begins = self.first + np.arange(len(self.length))
        change[begins[1:]] -= spanning[:-1]
        return np.maximum.reduceat(np.cumsum(change), begins) if len(begins) else spanning

    def lists(self, frequency: np.ndarray, rare: int) -> tuple[np.ndarray, ...]:
        """The lists that the words' rarest grams are in: key, number of the word, and the
        first and the number of the letters in which words of the list may differ."""
        size, h, often = self.decompose(frequency, rare)
        order = np.lexsort((self.place, h, often, self.word))
        needed = self.affected(size) + 1
        chosen = order[np.arange(len(order)) - self.first[self.word] < needed[self.word]]
        # polynomials of the letters up to each place, and from each place on
        powers = np.cumprod(np.full(int(self.length.max(initial=0)) + 1, _BASE, _U64))
        begin = np.cumsum(self.value * powers[self.place], dtype=_U64)
        until = begin - (begin[self.first] - self.value[self.first] * powers[0])[self.word]
        end = np.cumsum((self.value * powers[self.left - 1])[::-1], dtype=_U64)[::-1]
        after = np.append(end, _U64(0))[self.first + self.length]
        since = end - after[self.word]
        before = chosen[size[chosen] <= self.left[chosen]]  # a gram that spans the word's end has no edit after it
        keys = [
            bytetext.mix(bytetext.mix(h[before] ^ _BEFORE) + until[before + size[before] - 1]),
            bytetext.mix(bytetext.mix(h[chosen] ^ _AFTER) + since[chosen]),
        ]
        stop = self.place[before] + size[before]
        return (
            np.concatenate(keys),
            np.concatenate([self.word[before], self.word[chosen]]),
            np.concatenate([stop, np.zeros(len(chosen), np.int64)]),
            np.concatenate([self.length[self.word[before]] - stop, self.place[chosen]]),
        )


def _count_grams(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in bytetext.slices(batch, "word"):
                bucket, n = Grams(part.column("word"), longest).counts()
                table[bucket.astype(np.int64)] += n
        held = np.flatnonzero(table)
        for low in range(0, len(held), 50_000):
            some = held[low : low + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(table[some])], ["bucket", "n"])

    return run


def _list_words(longest: int, rare: int, dictionary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = dictionary.value
        for batch in batches:
            for part in bytetext.slices(batch, "word", 1 << 18):
                words = part.column("word")
                keys, which, start, left = Grams(words, longest).lists(frequency, rare)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.view(np.int64)),
                        words.take(pa.array(which)),
                        pa.array(start.astype(np.int32)),
                        pa.array(left.astype(np.int32)),
                    ],
                    ["key", "word", "start", "left"],
                )

    return run


def near_words(words: DataFrame, shortest: int, rare: int = RARE) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct ``word`` of ``words`` that are one edit apart.

    Give a checkpointed table of words of at least ``shortest`` letters (3 or more).
    """
    spark = words.sparkSession
    ship(spark)
    longest = shortest - 1
    only = words.select("word")
    counts = only.mapInArrow(_count_grams(longest), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(BUCKETS, np.int64)
    frequency[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    dictionary = spark.sparkContext.broadcast(frequency)
    lists = only.mapInArrow(_list_words(longest, rare, dictionary), "key long, word string, start int, left int")
    lists = checkpointed(lists)
    long = checkpointed(lists.groupBy("key").count().where(F.col("count") > SHORT_LIST).select("key"))
    long = within_bound(long)
    short = lists.join(long, "key", "left_anti").select("key", "word")
    rest = lists.join(long, "key", "left_semi").select(
        "key", "word", F.substring(F.col("word"), F.col("start") + 1, F.col("left")).alias("rest")
    )
    deleted = rest.select(
        "key", "word", "rest", F.explode(F.sequence(F.lit(0), F.length("rest"))).alias("at")
    ).where(  # of a run of equal letters, the first stands for all
        (F.col("at") <= 1) | (F.expr("substring(rest, at, 1)") != F.expr("substring(rest, at - 1, 1)"))
    ).select(
        # 0 deletes nothing
        F.xxhash64(
            "key", F.concat(F.expr("substring(rest, 1, at - 1)"), F.expr("substring(rest, at + 1, length(rest))"))
        ).alias("key"),
        "word",
    )
    return _verified(short).unionByName(_verified(deleted)).distinct()


def _verified(lists: DataFrame) -> DataFrame:
    """Words that are in one list and one edit apart."""
    sized = lists.select("key", "word", F.length("word").alias("size"))
    a = sized.select("key", F.col("word").alias("a"), F.col("size").alias("size_a"))
    b = sized.select("key", F.col("word").alias("b"), F.col("size").alias("size_b"))
    met = a.join(b, "key").where((F.col("a") < F.col("b")) & (F.abs(F.col("size_a") - F.col("size_b")) <= 1))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b")


def group_variants(words: DataFrame, shortest: int, ratio: int = 5, rare: int = RARE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``words`` (word, n), which are distinct.

    ``form`` is the near word of largest ``n`` (of equal ones the first in
    code-point order) if that is at least ``ratio`` (over 1) times the word's
    own, else null. ``root`` is the last word reached by following forms.

    Defined cases: words under ``shortest`` letters, null words and null counts
    are left out; an empty table gives an empty result; other columns are ignored.
    """
    words = checkpointed(
        words.select("word", F.col("n").cast("long").alias("n"))
        .where((F.length("word") >= shortest) & F.col("n").isNotNull())
    )
    pairs = checkpointed(near_words(words, shortest, rare))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("word").alias("b"), F.col("n").alias("m"))
    best = (
        both.join(other, "b")
        .groupBy(F.col("a").alias("word"))
        .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("m"), "b")).alias("best"))
        .select("word", "n_near", F.col("best.b").alias("form"), (-F.col("best.col1")).alias("form_n"))
    )
    formed = words.join(best, "word", "left")
    kept = F.col("form_n") >= ratio * F.col("n")
    formed = checkpointed(
        formed.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(kept, F.col("form")).alias("form"),
            F.when(kept, F.col("form_n")).alias("form_n"),
        )
    )
    # counts grow by the ratio along a chain, so the steps double over few words
    steps = checkpointed(formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        ahead = within_bound(steps).select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        next_steps = checkpointed(
            steps.join(ahead, "root", "left").select(
                "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")
            )
        )
        moved = next_steps.where("moved").limit(1).count()
        steps = next_steps.select("word", "root")
        if not moved:
            break
    return formed.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
