"""Toxicity with a convolutional network over hashed word embeddings.

A word's vector is the sum of the embeddings of its hash and of the hashes of
its beginnings of 3 to 7 bytes, so an inflected form of a known word is known.
Filters of several widths pass over the words of the whole text, each filter's
largest answer is kept (max pooling), and a logistic layer makes a score of those. The
network learns from every labelled text: shards of them take stochastic gradient steps
in Spark's tasks, and after each round the shards' weights are averaged where they were
touched. A quarter of the labelled texts, at the labels' own rate, isn't learned from; all of it
turns the network's output into a probability (Platt) and gives each language the threshold that
separates best there.

A text is read whole, in slices of words, where it lies: filters run over the
distinct words of a slice once, and its windows add up their answers.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixscore.llm import bytetext
from mixscore.llm.common import checkpointed, column, shuffles_deleted, ship, within_bound

#: Labelled rows of a shard on average, until there are `MOST_SHARDS`; then shards grow, which are read as a stream.
SHARD_DOCS = 4096
MOST_SHARDS = 128

#: Bytes of text up to which a shard is held for several passes in one round.
HELD_BYTES = 1 << 26

#: Cells of scores that are counted to find thresholds.
CELLS = 4096

#: Buckets of word hashes, and how many of them have an embedding of their own, at most.
BUCKETS = 1 << 22
ROWS = (1 << 16) - 1

#: Learned texts that a bucket must occur in to have an embedding; others are unknown words without any.
LEAST_TEXTS = 3

DIMENSIONS = 16
WIDTHS = (1, 2, 3)
FILTERS = 12
BEGINNINGS = (3, 4, 5, 6, 7)

#: Rounds over the learned texts, and steps that are made at least, which takes a small table more passes.
EPOCHS = 4
STEPS = 300
BATCH = 64
RATE = 0.1
DECAY = 1e-4

#: Calibrating texts of a language that weigh as much as the threshold of all languages.
PRIOR_TEXTS = 100

_RESULT = "doc_id long, held_out boolean, lang string, score double"
_WEIGHTS = "part int, row int, shard int, weights binary"
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of the distinct words (a row each, whole and beginnings; -1 for none),
    each word's row in order, and where each text's words begin."""
    low = bytetext.lowered(data)
    spaced = np.where(_WORD[low], low, 32).astype(np.uint8)
    starts, ends, begin = bytetext.word_spans(spaced, offsets)
    _, first, inverse = np.unique(bytetext.span_hashes(spaced, starts, ends), return_index=True, return_inverse=True)
    order = np.argsort(first)  # spans are hashed in order of place
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    starts, ends = starts[first[order]], ends[first[order]]
    out = np.full((len(order), 1 + len(BEGINNINGS)), -1, np.int32)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    out[:, 0] = (bytetext.span_hashes(spaced, starts, ends) >> shift).astype(np.int32)
    for i, k in enumerate(BEGINNINGS, 1):
        long = ends - starts >= k
        h = bytetext.span_hashes(spaced, starts[long], starts[long] + k)
        out[long, i] = (bytetext.mix(h + np.uint64(1)) >> shift).astype(np.int32)
    return out, place[inverse].astype(np.int32), begin


@dataclass
class Network:
    """Weights; ``row_of`` gives a bucket's embedding, 0 for none."""

    row_of: np.ndarray
    embedding: np.ndarray
    filters: list[np.ndarray]  # for each width: width x DIMENSIONS x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    base: float
    scale: float = 1.0
    shift: float = 0.0

    def known(self, buckets: np.ndarray) -> np.ndarray:
        """Rows of embeddings of words, 0 where there is none."""
        return np.where(buckets < 0, 0, self.row_of[buckets]).astype(np.int32)

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        return self.embedding[rows].sum(1)

    def windows(self, words: np.ndarray, tokens: np.ndarray, i: int) -> np.ndarray:
        """The answers of the filters of width ``WIDTHS[i]`` at every place; -1 in ``tokens`` is padding."""
        width = WIDTHS[i]
        padded = np.concatenate([tokens, np.full(width - 1, -1)])
        out = np.zeros((len(tokens), FILTERS), np.float32)
        blank = np.zeros((1, FILTERS), np.float32)
        for j in range(width):
            out += np.concatenate([words @ self.filters[i][j], blank])[padded[j : j + len(tokens)]]
        return out

    def outputs(self, rows: np.ndarray, tokens: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The logistic layer's outputs for padded texts that begin at ``begin``."""
        words = self.vectors(rows)
        ends = np.append(begin[1:], len(tokens))
        pooled = []
        for i, width in enumerate(WIDTHS):
            inside = np.stack([begin, ends - width + 1], 1).reshape(-1)  # windows that end within their text
            answers = np.concatenate([self.windows(words, tokens, i), np.zeros((1, FILTERS), np.float32)])
            pooled.append(np.maximum(np.maximum.reduceat(answers, inside)[::2] + self.bias[i], 0))
        return np.concatenate(pooled, 1) @ self.out + self.base

    def scores(self, outputs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * outputs.astype(np.float64) + self.shift, -30, 30)))


def padded(tokens: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with the padding that keeps windows inside: as long as the widest filter less one, one more if empty."""
    length = np.diff(begin)
    room = max(WIDTHS) - 1 + (length == 0)
    starts = np.cumsum(length + room) - (length + room)
    out = np.full(int((length + room).sum()), -1)
    out[np.arange(len(tokens)) + np.repeat(starts - begin[:-1], length)] = tokens
    return out, starts


def texts_with(buckets: np.ndarray, tokens: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The number of texts each bucket occurs in; words, and beginnings of one length, are other
    strings than those of another."""
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    number = np.zeros(BUCKETS, np.int32)
    for column_ in buckets.T:
        held = column_[tokens].astype(np.int64)
        held = np.unique((text * BUCKETS + held)[held >= 0])
        np.add.at(number, held % BUCKETS, 1)
    return number


def fresh(name: np.ndarray, seed: int = 3) -> tuple[Network, list[np.ndarray]]:
    """A network that knows the buckets ``name`` and hasn't learned, and Adagrad's memory of it."""
    random = np.random.default_rng(seed)
    row_of = np.zeros(BUCKETS, np.uint16)
    row_of[name] = np.arange(1, len(name) + 1)
    embedding = random.normal(0, 0.1, (len(name) + 1, DIMENSIONS)).astype(np.float32)
    embedding[0] = 0
    filters = [random.normal(0, 0.5 / np.sqrt(w), (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
    net = Network(
        row_of, embedding, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        random.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), 0.0,
    )
    shapes = [net.embedding.shape, net.out.shape, *(f.shape for f in net.filters), *(b.shape for b in net.bias), (1,)]
    return net, [np.full(shape, 1e-4, np.float32) for shape in shapes]


def train(buckets: np.ndarray, tokens: np.ndarray, begin: np.ndarray, toxic: np.ndarray, seed: int = 3) -> Network:
    """A network fitted on texts at hand, as one shard; texts of both labels are needed."""
    number = texts_with(buckets, tokens, begin)
    name = np.flatnonzero(number >= LEAST_TEXTS)
    name = name[np.lexsort((name, -number[name]))][:ROWS]
    net, memory = fresh(name, seed)
    random = np.random.default_rng(seed)
    share = toxic.mean()
    weight = np.where(toxic == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(max(EPOCHS, -(-STEPS // -(-len(toxic) // BATCH)))):
        descend(net, memory, net.known(buckets), tokens, begin, toxic, weight, random, np.zeros(len(net.embedding), bool))
    return net


def descend(net, memory, rows, tokens, begin, toxic, weight, random, touched_rows) -> None:
    """Stochastic gradient steps with Adagrad, a pass over the texts; marks the embeddings it changes."""
    order = random.permutation(len(toxic))
    for low in range(0, len(order), BATCH):
        some = order[low : low + BATCH]
        parts = [tokens[begin[i] : begin[i + 1]] for i in some]
        near = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        used, local = np.unique(np.concatenate(parts), return_inverse=True)
        toks, starts = padded(local, near)
        bounds = [*starts.tolist(), len(toks)]
        words = net.vectors(rows[used])
        places, pooled = [], []
        for i in range(len(WIDTHS)):
            answers = net.windows(words, toks, i)
            last = WIDTHS[i] - 1
            at = np.stack([a + answers[a : b - last].argmax(0) for a, b in zip(bounds[:-1], bounds[1:])])
            places.append(at)
            pooled.append(np.take_along_axis(answers, at, 0) + net.bias[i])
        hidden = np.maximum(np.concatenate(pooled, 1), 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.base, -30, 30)))
        wrong = (weight[some] * (p - toxic[some]) / len(some)).astype(np.float32)
        back = (wrong[:, None] * net.out) * (hidden > 0)
        gradient_words = np.zeros_like(words)
        gradients = []
        for i, width in enumerate(WIDTHS):
            mine = back[:, i * FILTERS : (i + 1) * FILTERS]
            gradient = np.zeros_like(net.filters[i])
            for j in range(width):
                at = toks[places[i] + j]
                there = at >= 0
                which, f = at[there], np.nonzero(there)[1]
                g = mine[there]
                np.add.at(gradient_words, which, g[:, None] * net.filters[i][j].T[f])
                np.add.at(gradient[j].T, f, g[:, None] * words[which])
            gradients.append((gradient, mine.sum(0)))
        touched = np.flatnonzero(np.abs(gradient_words).sum(1))
        flat = rows[used[touched]]
        name, where = np.unique(flat, return_inverse=True)
        gradient_rows = np.zeros((len(name), DIMENSIONS), np.float32)
        np.add.at(gradient_rows, where.reshape(-1), np.repeat(gradient_words[touched], flat.shape[1], 0))
        real = name > 0
        name, gradient_rows = name[real], gradient_rows[real] + DECAY * net.embedding[name[real]]
        memory[0][name] += gradient_rows**2
        touched_rows[name] = True
        net.embedding[name] -= RATE * gradient_rows / np.sqrt(memory[0][name])
        parameters = [net.out, *net.filters, *net.bias]
        slopes = [hidden.T @ wrong, *(g for g, _ in gradients), *(b for _, b in gradients)]
        for k, (value, slope) in enumerate(zip(parameters, slopes), 1):
            slope = slope + DECAY * value
            memory[k] += slope**2
            value -= RATE * slope / np.sqrt(memory[k])
        memory[-1] += wrong.sum() ** 2
        net.base -= RATE * float(wrong.sum() / np.sqrt(memory[-1][0]))


def _rows_of(net: Network, memory: list[np.ndarray]) -> np.ndarray:
    """All weights, each with its memory: `DIMENSIONS` of either in a row, embeddings first."""

    def in_rows(embedding, rest):
        flat = np.concatenate([np.ravel(r) for r in rest])
        return np.concatenate([embedding, np.resize(flat, (-(-len(flat) // DIMENSIONS), DIMENSIONS))])

    rest = [net.out, *net.filters, *net.bias, np.array([net.base])]
    return np.concatenate([in_rows(net.embedding, rest), in_rows(memory[0], memory[1:])], 1).astype("<f4")


def _put_rows(net: Network, memory: list[np.ndarray], rows: np.ndarray, values: np.ndarray) -> None:
    """Replace rows of `_rows_of`."""
    every = _rows_of(net, memory)
    every[rows] = values
    n = len(net.embedding)
    base = np.zeros(1, np.float32)
    for half, embedding, rest in (
        (every[:, :DIMENSIONS], net.embedding, [net.out, *net.filters, *net.bias, base]),
        (every[:, DIMENSIONS:], memory[0], memory[1:]),
    ):
        embedding[:] = half[:n]
        flat, at = half[n:].ravel(), 0
        for r in rest:
            r[...] = flat[at : at + r.size].reshape(r.shape)
            at += r.size
    net.base = float(base[0])


def _count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in bytetext.slices(batch, "text"):
            number += texts_with(*word_buckets(*bytetext.utf8(part.column("text"))))
    found = np.flatnonzero(number)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(number[found])], ["bucket", "n"])


def _learn(state, passes: int, weights: tuple[float, float], seed: tuple[int, ...]):
    """A task's passes over its shard; yields the weights that it touched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        net, memory = copy.deepcopy(state.value)
        random = np.random.default_rng((*seed, shard))
        touched = np.zeros(len(net.embedding), bool)
        held, steps = [], 0
        for batch in batches:
            for part in bytetext.slices(batch, "text"):
                buckets, tokens, begin = word_buckets(*bytetext.utf8(part.column("text")))
                toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
                texts = net.known(buckets), tokens, begin, toxic, np.where(toxic == 1, weights[1], weights[0])
                descend(net, memory, *texts, random, touched)
                steps += len(toxic)
                if passes > 1:
                    held.append(texts)
        for _ in range(passes - 1):
            for texts in held:
                descend(net, memory, *texts, random, touched)
        if not steps:
            return
        every = _rows_of(net, memory)
        rows = np.concatenate([np.flatnonzero(touched), np.arange(len(touched), len(every))]).astype(np.int32)
        chosen = [r.tobytes() for r in every[rows]]
        for i in range(0, len(rows), 8192):
            some = rows[i : i + 8192]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some % 32), pa.array(some), pa.array(np.full(len(some), shard, np.int32)), pa.array(chosen[i : i + 8192])],
                ["part", "row", "shard", "weights"],
            )

    return run


def _mean(table):  # without hints, which applyInArrow would have to know
    """The mean of each row's weights over the shards that touched it."""
    row = table.column("row").to_numpy()
    order = np.lexsort((table.column("shard").to_numpy(), row))
    values = np.frombuffer(b"".join(table.column("weights").to_pylist()), "<f4").reshape(len(row), -1)[order]
    name, first, n = np.unique(row[order], return_index=True, return_counts=True)
    means = (np.add.reduceat(values.astype(np.float64), first) / n[:, None]).astype("<f4")
    return pa.table({"row": pa.array(name.astype(np.int32)), "weights": pa.array([m.tobytes() for m in means], pa.binary())})


def fit(texts: DataFrame, toxic: int, clean: int, size: int, shards: int, seed: int = 3) -> Network:
    """A network that learned from ``texts`` (text, toxic), whose partitions are the shards.

    There are ``toxic`` and ``clean`` texts of ``size`` bytes; both labels weigh the same.
    """
    spark = texts.sparkSession
    counts = texts.mapInArrow(_count_texts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    known = counts.where(F.col("n") >= LEAST_TEXTS).orderBy(F.desc("n"), "bucket").limit(ROWS)
    net, memory = fresh(np.array([r[0] for r in known.select("bucket").collect()], np.int64), seed)
    n = toxic + clean
    rounds, passes = EPOCHS, max(1, round(STEPS * BATCH * shards / (EPOCHS * n)))
    if passes > 1 and size > HELD_BYTES * shards:
        rounds, passes = rounds * passes, 1
    for k in range(rounds):
        state = spark.sparkContext.broadcast((net, memory))
        learn = _learn(state, passes, (n / (2 * clean), n / (2 * toxic)), (seed, k))
        means = texts.mapInArrow(learn, _WEIGHTS).groupBy("part").applyInArrow(_mean, "row int, weights binary").toArrow()
        values = np.frombuffer(b"".join(means.column("weights").to_pylist()), "<f4").reshape(means.num_rows, -1)
        _put_rows(net, memory, means.column("row").to_numpy(), values)
        state.destroy()
    return net


def _probability(scale: float, shift: float) -> Column:
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("output") * scale + shift))
    return 1 / (1 + F.exp(-z))


def calibrate(net: Network, held: DataFrame) -> None:
    """Set the scale and shift that make the outputs (toxic, output) probabilities, with Platt's smoothed targets."""
    yes, no = held.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    target = F.when(F.col("toxic") == 1, (yes + 1) / (yes + 2)).otherwise(1 / (no + 2))
    x = F.col("output")
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = _probability(*map(float, w))
        each = held.select(x, (p - target).alias("d"), (p * (1 - p)).alias("c"))
        sums = each.agg(F.sum(x * F.col("d")), F.sum("d"), F.sum(x * x * F.col("c")), F.sum(x * F.col("c")), F.sum("c")).first()
        slope = np.array(sums[:2]) + 1e-3 * w
        curve = np.array([[sums[2], sums[3]], [sums[3], sums[4]]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-7:
            break
    # sums may be added up in another order another time
    net.scale, net.shift = round(float(max(w[0], 1e-3)), 6), round(float(w[1]), 6)


def best_threshold(
    scores: np.ndarray, toxic: np.ndarray, otherwise: float, n: np.ndarray | None = None, width: float = 0.0
) -> float:
    """The cut of the largest F1, midway between neighbouring scores; ``otherwise`` without a toxic text.

    A score may stand for ``n`` texts, ``toxic`` of them toxic, from it to it plus ``width``.
    """
    if not toxic.sum():
        return otherwise
    order = np.argsort(-scores, kind="stable")
    found = np.cumsum(toxic[order])
    f1 = 2 * found / (np.cumsum(np.ones(len(order)) if n is None else n[order]) + toxic.sum())
    s = scores[order]
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(f1.argmax())
    return float((s[k] + s[k + 1] + width) / 2) if k + 1 < len(s) else float(s[k])


def thresholds(
    scores: np.ndarray, toxic: np.ndarray, lang: list[str | None], otherwise: float, n: np.ndarray | None = None, width: float = 0.0
) -> dict[str | None, float]:
    """A threshold for each language, drawn towards that of all (key None) the fewer texts it has."""
    n = np.ones(len(scores), np.int64) if n is None else n
    overall = best_threshold(scores, toxic, otherwise, n, width)
    out: dict[str | None, float] = {None: overall}
    names = np.array(lang, object)
    for name in {v for v in lang if v is not None}:
        mine = names == name
        own, number = best_threshold(scores[mine], toxic[mine], overall, n[mine], width), int(n[mine].sum())
        out[name] = (number * own + PRIOR_TEXTS * overall) / (number + PRIOR_TEXTS)
    return out


def _output(network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = network.value
        for batch in batches:
            for part in bytetext.slices(batch, "text"):
                output = pa.array(_outputs(net, part.column("text")).astype(np.float64))
                yield pa.RecordBatch.from_arrays([part.column("toxic"), part.column("lang"), output], ["toxic", "lang", "output"])

    return run


def _score(network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = network.value
        for batch in batches:
            for part in bytetext.slices(batch, "text"):
                scores = net.scores(_outputs(net, part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), part.column("lang"), pa.array(scores)],
                    ["doc_id", "held_out", "lang", "score"],
                )

    return run


def _outputs(net: Network, texts: pa.Array) -> np.ndarray:
    buckets, tokens, begin = word_buckets(*bytetext.utf8(texts))
    if not len(begin) - 1:
        return np.empty(0)
    return net.outputs(net.known(buckets), *padded(tokens, begin))


def _learned(
    rows: DataFrame, labels: DataFrame, held_out: Column, threshold: float, id_col: str, label_col: str
) -> tuple[Network | None, dict[str | None, float], float]:
    """The calibrated network and the thresholds of languages; None and the share of toxic labels if there is nothing to learn."""
    spark = rows.sparkSession
    marks = (
        labels.where(column(id_col).isNotNull() & column(label_col).isin(0, 1) & ~held_out)
        .groupBy(column(id_col).cast("long").alias("doc_id"))
        .agg(F.min(column(label_col)).alias("toxic"), F.max(column(label_col)).alias("most"))
        .where("toxic = most")
    )
    calibrating = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(4)) == 0
    marks = checkpointed(marks.select("doc_id", F.col("toxic").cast("int").alias("toxic"), calibrating.alias("apart")))
    shards = min(MOST_SHARDS, max(1, -(-marks.where("NOT apart").count() // SHARD_DOCS)))
    texts = rows.join(within_bound(marks), "doc_id").where("text IS NOT NULL")
    texts = texts.select("doc_id", "toxic", "apart", "lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"))
    texts = texts.repartition(shards, "shard").dropDuplicates(["shard", "doc_id"])
    texts = checkpointed(texts.sortWithinPartitions(F.xxhash64("doc_id", F.lit("order")), "doc_id"))
    counted = texts.groupBy("apart", "toxic").agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).collect()
    number = {(apart, toxic): n for apart, toxic, n, _ in counted}
    toxic, clean = number.get((False, 1), 0), number.get((False, 0), 0)
    if not toxic or not clean:
        share = marks.agg(F.avg("toxic")).first()[0] or 0.0
        return None, {None: threshold}, float(share)
    size = sum(size or 0 for apart, _, _, size in counted if not apart)
    net = fit(texts.where("NOT apart").select("text", "toxic"), toxic, clean, size, shards)
    both = (True, 0) in number and (True, 1) in number  # else calibrate by all there is
    held = texts.where("apart") if both else texts
    network = spark.sparkContext.broadcast(net)
    held = checkpointed(held.select("toxic", "lang", "text").mapInArrow(_output(network), "toxic int, lang string, output double"))
    network.destroy()
    calibrate(net, held)
    cell = F.floor(_probability(net.scale, net.shift) * CELLS).cast("int").alias("cell")
    cells = held.groupBy("lang", cell).agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).toArrow()
    low, of, n = (cells.column(c).to_numpy() for c in ("cell", "toxic", "n"))
    cuts = thresholds(low / CELLS, of, cells.column("lang").to_pylist(), threshold, n, 1 / CELLS)
    return net, cuts, 0.0


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column,
    threshold: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    label_col: str = "toxic",
) -> DataFrame:
    """(doc_id, held_out, score, predicted, lang_threshold, flagged): one row for each row of ``docs``.

    Learns from rows of ``labels`` (the id column and ``label_col``, 0 or 1) for
    which ``held_out``, an expression of the id, is false. ``score`` is the
    probability of label 1, ``predicted`` 1 where it reaches ``threshold``, and
    ``flagged`` true where it reaches the language's own threshold, which only
    looks up the language after the text alone was scored.

    Defined cases: a null or empty text is scored as a text without words. Ids with
    labels of both kinds, null labels or null ids aren't learned from. Without labels of
    both kinds to learn from, every score is the learned labels' share of toxic
    ones (0 without any). Rows repeated in ``docs`` are scored each and learned
    from once. A null ``held_out`` counts as true for learning and false in the
    result; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(
        column(id_col).cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        column(lang_col).cast("string").alias("lang"),
        column(text_col).cast("string").alias("text"),
    )
    with shuffles_deleted(spark):
        net, cuts, share = _learned(rows, labels, held_out, threshold, id_col, label_col)
    if net is None:
        scored = rows.select("doc_id", "held_out", "lang", F.lit(share).alias("score"))
    else:
        scored = rows.mapInArrow(_score(spark.sparkContext.broadcast(net)), _RESULT)
    overall = cuts.pop(None)
    own = spark.createDataFrame(sorted(cuts.items()), "lang string, own double")
    cut = F.coalesce("own", F.lit(overall))
    return scored.join(F.broadcast(own), "lang", "left").select(
        "doc_id",
        "held_out",
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        cut.alias("lang_threshold"),
        (F.col("score") >= cut).alias("flagged"),
    )
