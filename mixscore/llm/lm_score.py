"""Score texts with a weighted backoff automaton of smoothed word n-grams.

The automaton has a state for every history of up to ``order - 1`` words seen
in training, and the root. A state's arcs are the words seen after it; every other word
follows the failure arc to the state without the first word, whose weight is
the probability kept for that. Weights are Dirichlet-smoothed: with ``c``
counts and ``m = strength``

    P(w | h) = (c(h w) + m P(w | h')) / (c(h) + m),

so an arc weighs this and a failure arc ``m / (c(h) + m)``. The root's
arcs are the add-0.1 unigrams, and one for all unknown words.

The automaton grows with the corpus and is never in one place. Units of
documents (see `exchange`) ask the shards for the counts of their own distinct
n-grams, which gives each unit the part of the automaton its texts can reach
(`Automaton`). Then one left-to-right traversal of every text carries the state and
adds the weights of the arcs it follows. Texts go side by side, one token at a time;
long ones in segments, each entered by the few tokens before it, which is
all that a state remembers. What is shuffled: the texts once, six bytes for each
distinct n-gram of a unit, and its count on the way back. There are as many
units and shards as the texts' bytes need.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixscore.llm import bytetext
from mixscore.llm.common import column, ship
from mixscore.llm.exchange import pack_keys, pack_numbers, range_bounds, unpack_keys, unpack_numbers

#: Observations that the shorter history's distribution is worth.
STRENGTH = 100.0

#: Bytes of text in a unit on average; a shard holds as many keys as a unit.
UNIT_BYTES = 8 << 20

#: Tokens of a text that one lane of the traversal scores.
SEGMENT = 1024

_END = np.uint64(0x0DDC0FFEEBADF00D)
_KIND = np.uint64(1)

ASK = "shard int, unit long, keys binary, counts binary"
ANSWER = "unit long, shard int, counts binary, tokens long, types long"
SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Tokens:
    """The tokens of a unit's documents, each document's followed by the end, and its n-gram keys."""

    def __init__(self, table: pa.Table, order: int) -> None:
        self.doc_id = table.column("doc_id").combine_chunks()
        self.held_out = np.asarray(table.column("held_out").to_numpy(), bool)
        parts, counts = [], []
        for batch in table.select(["text"]).combine_chunks().to_batches():
            for part in bytetext.slices(batch, "text"):
                h, begin = bytetext.words(*bytetext.utf8(part.column(0)))
                parts.append(np.insert(h, begin[1:], _END))
                counts.append(np.diff(begin) + 1)
        self.length = np.concatenate(counts) if counts else np.empty(0, np.int64)
        tokens = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        self.end = np.cumsum(self.length)
        self.place = np.arange(len(tokens)) - np.repeat(self.end - self.length, self.length)
        keys = [tokens & ~_KIND]
        grams = tokens
        for k in range(1, order):
            # of k + 1 tokens ending here; where the document has fewer, the unigram stands in and is not used
            grams = np.concatenate([tokens[:k], bytetext.combine([grams[:-1][k - 1 :], tokens[k:]])]) if len(tokens) > k else tokens
            keys.append(np.where(self.place >= k, grams | _KIND, keys[0]))
        self.keys, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        #: for each length less one and place, the n-gram that ends there
        self.where = inverse.reshape(order, -1)

    def train_counts(self) -> np.ndarray:
        train = np.repeat(~self.held_out, self.length)
        out = np.zeros(len(self.keys), np.int64)
        for k, where in enumerate(self.where):
            out += np.bincount(where[train & (self.place >= k)], minlength=len(out))
        return out

    def per_document(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.end - self.length) if len(values) else values


class Automaton:
    """The states and arcs that a unit's texts can reach.

    State 0 is the root; every other one is a history, an n-gram of fewer than
    ``order`` words seen in training. An arc belongs to a seen n-gram: it leaves
    the state of all but its last word, carries the log probability of that and enters
    the state of the longest history it ends with. Words that were never seen have an arc
    from the root to itself.
    """

    def __init__(self, tokens: Tokens, counts: np.ndarray, total: int, types: int, strength: float) -> None:
        order, size = tokens.where.shape
        grams = len(tokens.keys)
        counts = counts.astype(np.float64)
        self.seen = counts > 0
        p = (counts + 0.1) / (total + 0.1 * (types + 1))  # of single words; longer n-grams follow
        state = np.zeros(grams, np.int64)
        self.enters = np.zeros(grams, np.int64)
        self.depth, self.fails, self.fail_weight = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1)]
        states = 1
        for k, where in enumerate(tokens.where):
            # one place where each n-gram of k + 1 words ends
            places = np.flatnonzero(tokens.place >= k)
            found, first = np.unique(where[places], return_index=True)
            at = places[first]
            at, found = at[self.seen[found]], found[self.seen[found]]
            if k:
                history, ending = tokens.where[k - 1][at - 1], tokens.where[k - 1][at]
                p[found] = (counts[found] + strength * p[ending]) / (counts[history] + strength)
            if k + 1 < order:
                state[found] = np.arange(states, states + len(found))
                states += len(found)
                self.depth.append(np.full(len(found), k + 1))
                self.fails.append(state[ending] if k else np.zeros(len(found), np.int64))
                self.fail_weight.append(np.log10(strength / (counts[found] + strength)))
                self.enters[found] = state[found]
            elif k:
                self.enters[found] = state[ending]
        self.depth, self.fails, self.fail_weight = map(np.concatenate, (self.depth, self.fails, self.fail_weight))
        self.weight = np.log10(p)


def traverse(tokens: Tokens, automaton: Automaton) -> np.ndarray:
    """The sum of the weights on the way of each document's tokens through the automaton."""
    order = len(tokens.where)
    begin = tokens.end - tokens.length
    # lanes: segments of documents, longest first, each with the tokens that lead into it
    pieces = -(-tokens.length // SEGMENT)
    doc = np.repeat(np.arange(len(pieces)), pieces)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SEGMENT
    stop = np.minimum(start + SEGMENT, tokens.length[doc])
    lead = np.minimum(start, order - 1)
    length = stop - start + lead
    lanes = np.argsort(-length, kind="stable")
    doc, length, lead, at = doc[lanes], length[lanes], lead[lanes], (begin[doc] + start - lead)[lanes]
    state, sums = np.zeros(len(doc), np.int64), np.zeros(len(doc))
    active = len(doc)
    for t in range(int(length.max(initial=0))):
        active = int(np.searchsorted(-length[:active], -t, side="left"))  # lanes of more than t tokens
        here, current = at[:active] + t, state[:active]
        cost = np.zeros(active)
        waiting = np.arange(active)
        for _ in range(order):
            s = current[waiting]
            gram = tokens.where[automaton.depth[s], here[waiting]]
            follows = automaton.seen[gram] | (s == 0)
            goes, stays = waiting[follows], waiting[~follows]
            cost[goes] += automaton.weight[gram[follows]]
            current[goes] = automaton.enters[gram[follows]]
            if not len(stays):
                break
            s = s[~follows]
            cost[stays] += automaton.fail_weight[s]
            current[stays] = automaton.fails[s]
            waiting = stays
        sums[:active] += np.where(t >= lead[:active], cost, 0.0)
    return np.bincount(doc, weights=sums, minlength=len(tokens.length))


def score_positions(tokens: Tokens, counts: np.ndarray, total: int, types: int) -> dict[str, np.ndarray]:
    """What the unigram model tells of each document."""
    seen = counts[tokens.where[0]].astype(np.float64)
    return {
        "n_known": tokens.per_document((seen > 0).astype(np.int64)),
        "base_score": tokens.per_document(np.log10((seen + 0.1) / (total + 0.1 * (types + 1)))),
    }


def _ask(order: int, shards: int):
    def run(key, table):
        tokens = Tokens(table, order)
        counts = tokens.train_counts().astype("<u8")
        bounds = range_bounds(tokens.keys, shards)
        pieces = [(tokens.keys[a:b], counts[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        return pa.table(
            {
                "shard": pa.array(np.arange(shards, dtype=np.int32)),
                "unit": pa.array([key[0].as_py()] * shards, pa.int64()),
                "keys": pa.array([pack_keys(k) for k, _ in pieces], pa.binary()),
                "counts": pa.array([pack_numbers(c) for _, c in pieces], pa.binary()),
            }
        )

    return run


def _answer(key, table):
    asked = [unpack_keys(k) for k in table.column("keys").to_pylist()]
    added = [unpack_numbers(c, "<u8") for c in table.column("counts").to_pylist()]
    keys, where = np.unique(np.concatenate(asked), return_inverse=True)
    counts = np.zeros(len(keys), "<u8")
    np.add.at(counts, where, np.concatenate(added))
    word = (keys & _KIND) == 0
    ends = np.cumsum([len(a) for a in asked])
    answers = [pack_numbers(counts[where[e - len(a) : e]]) for a, e in zip(asked, ends)]
    n = table.num_rows
    return pa.table(
        {
            "unit": table.column("unit"),
            "shard": table.column("shard"),
            "counts": pa.array(answers, pa.binary()),
            "tokens": pa.array([int(counts[word].sum())] * n, pa.int64()),
            "types": pa.array([int((counts[word] > 0).sum())] * n, pa.int64()),
        }
    )


def _score(order: int, strength: float):
    def run(key, docs, answers):
        tokens = Tokens(docs, order)
        answers = answers.sort_by("shard")
        total = sum(answers.column("tokens").to_pylist())
        types = sum(answers.column("types").to_pylist())
        counts = np.concatenate([unpack_numbers(c, "<u8") for c in answers.column("counts").to_pylist()])
        scored = score_positions(tokens, counts, total, types)
        scored["score"] = traverse(tokens, Automaton(tokens, counts, total, types, strength))
        return pa.table(
            {
                "doc_id": tokens.doc_id,
                "held_out": pa.array(tokens.held_out),
                "n_tokens": pa.array(tokens.length),
                "n_known": pa.array(scored["n_known"]),
                "train_tokens": pa.array([total] * len(tokens.length), pa.int64()),
                "base_score": pa.array(scored["base_score"]),
                "score": pa.array(scored["score"]),
            }
        )

    return run


def score_texts(
    docs: DataFrame,
    held_out: Column,
    order: int = 2,
    strength: float = STRENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Token counts and log10 probabilities of every text, one row for each row of ``docs``.

    Tokens are runs without ASCII white space, A to Z in lower case, then one
    end. The model learns from rows where ``held_out`` is false. ``base_score``
    is the unigram model's log10 probability, ``score`` the automaton's.

    Defined cases: a null or empty text is the end token alone; a null
    ``held_out`` counts as false. Repeated rows are learned and scored each;
    null ids stay. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    size = docs.select(F.sum(F.octet_length(column(text_col)) + 1)).first()[0] or 0
    units = shards = max(1, -(-size // UNIT_BYTES))
    rows = docs.select(
        F.pmod(F.xxhash64(column(id_col), column(text_col)), F.lit(units)).alias("unit"),
        column(id_col).cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        column(text_col).alias("text"),
    )
    asked = rows.groupBy("unit").applyInArrow(_ask(order, shards), ASK)
    answered = asked.groupBy("shard").applyInArrow(_answer, ANSWER)
    return rows.groupBy("unit").cogroup(answered.groupBy("unit")).applyInArrow(_score(order, strength), SCORE)
