"""Pack tokenised documents into sequences of bounded length with little padding.

Documents are dealt at random (by hash) into groups. Each group is packed on
its own by first-fit decreasing: full-length pieces become sequences at once,
the remainders go, longest first, into the first sequence with room. A
tournament tree over the free room of the sequences finds that one in
logarithmic time.

The number of groups follows the number of documents, so a group stays of one
size at any scale: about `DOCS_PER_GROUP` documents, a few thousand
sequences. The hash mixes id and text, so neither a hot source nor repeated ids
gather in one group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixscore.llm.bytetext import slices, utf8
from mixscore.llm.common import column, release_memory, ship, tidy

#: Documents dealt into one group on average: enough for first-fit to waste little, a few MB of ids.
DOCS_PER_GROUP = 4096

#: Distinct pieces of text whose ids a worker remembers of late, and as many from before
#: that are forgotten if they don't come again (about 200 bytes each).
REMEMBERED_CHUNKS = 500_000

# White space as the pre-tokeniser knows it.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


# Bytes that end a piece or may: ASCII white space, other ASCII that is no letter, ASCII letters.
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_MARK = ~_BLANK & ~_LETTER & (np.arange(256) < 128)

# First bytes of letters of two and three bytes: of scripts whose letters have long been letters to every version of
# Unicode, and where (nearly) all that begins so is one.
_TWO = np.isin(np.arange(256), [*range(0xC3, 0xCA), 0xD0, 0xD1])
_THREE = np.isin(np.arange(256), range(0xE5, 0xE9))


def _piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks bytes of texts before which the byte-level pre-tokeniser always cuts, every text's first one among them.

    Of a run of ASCII white space it takes the last blank to the word that follows, and a
    last character that is no blank stands alone; at the end of a text a run stays whole. Further
    cuts are those between a known letter and another ASCII character, but not after an
    apostrophe. Nothing is cut beside other characters.
    """
    n = len(data)
    blank = _BLANK[data]
    before = np.zeros(n, bool)  # blank, and in the same text
    before[1:] = blank[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    before[first] = False
    cut = blank & ~before
    cut[first] = True
    ended = np.flatnonzero(before & ~blank)  # behind runs that words follow
    cut[ended - 1] = True
    cut[ended[data[ended - 1] != 32]] = True
    # letter, then mark
    at = np.flatnonzero(_MARK[data[1:]] & ~_MARK[data[:-1]] & ~blank[:-1]) + 1
    last, second, third = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    follows = last >= 0x80
    two = follows & _TWO[second] & ~((second == 0xC3) & ((last == 0x97) | (last == 0xB7)))  # the signs of products
    cut[at[_LETTER[last] | two | (follows & (second >= 0x80) & _THREE[third])]] = True
    # mark, then letter
    at = np.flatnonzero(_MARK[data[:-1]] & (data[:-1] != 39) & ~_MARK[data[1:]] & ~blank[1:]) + 1
    lead, second = data[at], data[np.minimum(at + 1, n - 1)]
    two = _TWO[lead] & ~((lead == 0xC3) & ((second == 0x97) | (second == 0xB7)))
    cut[at[_LETTER[lead] | two | _THREE[lead]]] = True
    return cut


class Encoder:
    """Token ids of texts, remembering the ids of their pieces.

    The byte-level pre-tokeniser cuts before every blank and between letters and
    others, and never joins what stands on both sides of a cut. So a text cut
    there into pieces has the ids of its pieces put together. Pieces are cut and
    told apart as whole Arrow columns, so Python handles the distinct ones of a slice alone. A text with
    unusual white space is cut at white space only. A run of letters is one word to the tokeniser's model, which is
    asked directly.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_CHUNKS) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        # scripts whose letters have long been letters to every version of Unicode
        self._letters = re.compile(" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u02af\u0400-\u0481\u4e00-\u9fa5]+").fullmatch
        cut = self._tokenizer.pre_tokenizer
        self._direct = (
            self._tokenizer.normalizer is None and isinstance(cut, ByteLevel) and cut.use_regex and not cut.add_prefix_space
        )
        # the letters that the byte-level vocabulary writes for bytes: the byte's own if it prints, else one from 256 on
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self._letter_of = np.arange(256, dtype="<u2")
        self._letter_of[hidden] = 256 + np.arange(len(hidden))
        self._rare = re.compile("|".join(c for c in _SPACES if c > "\x7f").encode())
        self._any = re.compile(f" ?[^{_SPACES}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]")
        self._remembered = remembered
        self._known: dict[bytes, bytes] = {}
        self._before: dict[bytes, bytes] = {}
        self._newline = self._tokenizer.encode("\n", add_special_tokens=False).ids[0]

    def _keep(self, pieces: list[str], ids: np.ndarray, ends: list[int], gap: int) -> None:
        data, start = ids.tobytes(), 0
        for p, end in zip(pieces, ends, strict=True):
            self._known[p.encode()] = data[4 * start : 4 * end]
            start = end + gap

    def _learn_words(self, words: list[str]) -> None:
        """Remember the ids of runs of letters, each a word of the model."""
        tokenize = self._tokenizer.model.tokenize
        for i in range(0, len(words), 5_000):
            part = words[i : i + 5_000]
            written = self._letter_of[np.frombuffer("\n".join(part).encode(), np.uint8)].tobytes().decode("utf-16-le")
            ids: list[int] = []
            ends = []
            for w in written.split(chr(self._letter_of[ord("\n")])):
                ids += [t.id for t in tokenize(w)]
                ends.append(len(ids))
            self._keep(part, np.array(ids, "<u4"), ends, 0)

    def _learn_whole(self, pieces: list[str]) -> None:
        """Remember the ids of pieces; many at a time as the lines of one text, which is cut at its newlines."""
        lines = [p for p in pieces if p[-1] not in _SPACES]
        for i in range(0, len(lines), 5_000):
            part = lines[i : i + 5_000]
            text = self._tokenizer.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0]
            ids = np.array(text.ids, "<u4")
            self._keep(part, ids, [*np.flatnonzero(ids == self._newline).tolist(), len(ids)], 1)
        for p in pieces:
            if p[-1] in _SPACES:
                ids = np.array(self._tokenizer.encode(p, add_special_tokens=False).ids, "<u4")
                self._keep([p], ids, [len(ids)], 0)

    def _learn(self, pieces: list[bytes]) -> None:
        """Remember the ids of pieces."""
        letters = self._letters if self._direct else lambda p: None
        words: list[str] = []
        whole: list[str] = []
        for p in map(bytes.decode, pieces):
            (words if letters(p) else whole).append(p)
        self._learn_words(words)
        self._learn_whole(whole)

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces."""
        if len(self._known) > self._remembered:
            self._before, self._known = self._known, {}
        known, before = self._known, self._before
        ids = list(map(known.get, pieces))
        new = [i for i, x in enumerate(ids) if x is None]
        if new:
            unknown = []
            for i in new:
                p = pieces[i]
                if p in before:
                    known[p] = before[p]
                else:
                    unknown.append(p)
            self._learn(unknown)
            for i in new:
                ids[i] = known[pieces[i]]
        return ids

    def encode_column(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """For each text its ids as little-endian unsigned 32-bit numbers, then ``end``; null counts as empty."""
        data, offsets = utf8(texts)
        starts = offsets[:0]
        if len(data):
            cut = _piece_starts(data, offsets)
            if self._rare.search(data):
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    if self._rare.search(data[a:b]):
                        lengths = [len(p.encode()) for p in self._any.findall(data[a:b].tobytes().decode())]
                        cut[a:b] = False
                        cut[a + np.cumsum([0, *lengths[:-1]])] = True
            starts = np.flatnonzero(cut)
        bounds = np.append(starts, len(data)).astype(np.int64)
        column_ = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        distinct = column_.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array([*self._ids(distinct), end], pa.large_binary())
        begin = np.searchsorted(starts, offsets)
        # every text's pieces, then the end
        order = np.insert(column_.indices.to_numpy().astype(np.int64), begin[1:], len(distinct))
        taken = ids.take(pa.array(order))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
        bounds = np.ascontiguousarray(ends[begin + np.arange(len(begin))])
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(bounds), taken.buffers()[2]])
        return out.cast(pa.binary())

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers."""
        return self.encode_column(pa.array(texts, pa.string())).to_pylist()


_encoders: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, remembered: int) -> Encoder:
    """The worker's encoder; it lives as long as the worker."""
    if (path, remembered) not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path, remembered] = Encoder(path, remembered)
    return _encoders[path, remembered]


class RoomTree:
    """A tournament tree over the free room of sequences; the winner of a match has more room."""

    def __init__(self, n: int) -> None:
        self.size = 1
        while self.size < max(1, n):
            self.size *= 2
        self.room = [0] * (2 * self.size)
        self.opened = 0

    def set(self, i: int, room: int) -> None:
        i += self.size
        tree = self.room
        tree[i] = room
        i //= 2
        while i:
            best = max(tree[2 * i], tree[2 * i + 1])
            if tree[i] == best:
                break
            tree[i] = best
            i //= 2

    def first(self, need: int) -> int | None:
        """The first sequence with at least ``need`` room."""
        tree = self.room
        if tree[1] < need:
            return None
        i = 1
        while i < self.size:
            i *= 2
            if tree[i] < need:
                i += 1
        return i - self.size


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length its sequence (from 0) and its offset there; lengths are 1 to ``capacity``."""
    which = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    tree = RoomTree(len(lengths))
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        j = tree.first(need)
        if j is None:
            j = tree.opened
            tree.opened += 1
            room = capacity
        else:
            room = tree.room[tree.size + j]
        which[i], offset[i] = j, capacity - room
        tree.set(j, room - need)
    return which, offset


def _tokenise(path: str, end_id: int, remembered: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, remembered)
        for batch in batches:
            for part in slices(batch, "text", 3 << 18):
                ids = encoder.encode_column(part.column("text"), end)
                yield pa.RecordBatch.from_arrays(
                    [part.column("pack_group"), part.column("doc_id"), ids],
                    ["pack_group", "doc_id", "ids"],
                )

    return run


def _pack_group(capacity: int):
    def run(key, table):  # without hints, which applyInArrow would have to know
        group = key[0].as_py()
        order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("ids", "ascending")], null_placement="at_end")
        table = table.take(order).combine_chunks()
        doc_id, ids = table.column("doc_id").chunk(0), table.column("ids").chunk(0)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
        total = np.diff(ends) // 4
        pieces = -(-total // capacity)
        doc = np.repeat(np.arange(len(total)), pieces)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
        lengths = np.minimum(capacity, total[doc] - start)
        full = lengths == capacity
        which, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        which[full] = np.arange(full.sum())
        which[~full], offset[~full] = first_fit_decreasing(lengths[~full], capacity)
        which[~full] += full.sum()
        # the pieces lie one after the other in the documents' own buffer
        cuts = np.append(ends[doc] + 4 * start, ends[-1]).astype(np.int32)
        piece_ids = pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(cuts), ids.buffers()[2]])
        release_memory()
        return pa.table(
            {
                "doc_id": doc_id.take(pa.array(doc)),
                "start": pa.array(start),
                "length": pa.array(lengths),
                "doc_tokens": pa.array(total[doc]),
                "sequence_id": pa.array(which + (group << 32)),
                "offset": pa.array(offset),
                "ids": piece_ids,
            }
        )

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 1024,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    docs_per_group: int = DOCS_PER_GROUP,
    remembered_chunks: int = REMEMBERED_CHUNKS,
) -> DataFrame:
    """One row for each piece of a document: where it lies in which sequence, and its token ids.

    Columns: doc_id, start (the document's ids before the piece), length,
    doc_tokens (all ids of the document, the end id included), sequence_id,
    offset (in the sequence, gapless from 0) and ids (little-endian unsigned
    32-bit numbers). ``tokenizer`` is the path of a tokenizers JSON file, there
    on every executor. A document is its ids without special tokens, then
    ``end_id``; only documents over ``capacity`` ids are cut. ``remembered_chunks``
    trades a worker's memory for time, not for results.

    Defined cases: a null or empty text is the end id alone. Rows that repeat an
    id are packed one by one and may carry equal pieces; a null id stays null.
    Ties in length keep the order of ids, then of token ids. An empty table gives an empty
    table. Other columns are left out.
    """
    groups = max(1, -(-docs.count() // docs_per_group))
    rows = docs.select(
        column(id_col).cast("long").alias("doc_id"),
        column(text_col).alias("text"),
        F.pmod(F.xxhash64(column(id_col), column(text_col)), F.lit(groups)).alias("pack_group"),
    )
    ship(docs.sparkSession)
    ids = rows.mapInArrow(tidy(_tokenise(tokenizer, end_id, remembered_chunks)), "pack_group long, doc_id long, ids binary")
    return ids.groupBy("pack_group").applyInArrow(_pack_group(capacity), PIECE)
