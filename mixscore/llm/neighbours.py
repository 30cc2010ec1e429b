"""Approximate nearest neighbours by learned partitions.

1. A bounded sample of the vectors (`SAMPLE`) gets its graph of nearest
   neighbours, and the graph a balanced partitioning that cuts few edges.
2. A small classifier (one hidden layer) learns from a vector the parts that
   its neighbours lie in.
3. Every vector of the table is indexed under its most probable part. A query
   goes to its `probes` most probable parts and is ranked there on the original
   vectors in double precision. The number of probes is the least that finds
   `TARGET` of the sample's true neighbours.

Parts are cut into blocks of bounded size, and the queries of a part as well, so
a part that holds very many equal vectors is many tasks. Nothing but the sample
and one count for each part comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixscore.llm.common import checkpointed, column, hashed_sample, ship

#: Vectors that the partitioning and the classifier are fitted on, at most.
SAMPLE = 4096

#: Neighbours of a sampled vector in the graph.
GRAPH_NEIGHBOURS = 10

#: Share of the sample's true neighbours that the probed parts have to hold.
TARGET = 0.95

#: Vectors, and queries, in one block at most (about).
BLOCK = 8192

_HIDDEN = 96
_INDEXED = "vec_id long, vector array<double>, part int, probed array<int>"
_NEAR = "query_id long, vec_id long, score double"


def parts_for(rows: int) -> int:
    """A power of two near an eighth of the root of the number of rows, from 1 to 256."""
    return int(2 ** np.clip(np.round(np.log2(max(1.0, np.sqrt(rows) / 8))), 0, 8))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest others of each unit vector."""
    out = np.empty((len(x), k), np.int64)
    for low in range(0, len(x), 512):
        near = x[low : low + 512] @ x.T
        near[np.arange(len(near)), np.arange(low, low + len(near))] = -2
        out[low : low + 512] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def partition(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A balanced partitioning of the graph: halved along main directions, then refined by moves that save cut edges."""
    label = np.zeros(len(x), np.int64)
    random = np.random.default_rng(3)
    size = 1
    while size < parts:
        for p in range(size):
            rows = np.flatnonzero(label == p)
            centred = x[rows] - x[rows].mean(0)
            direction = random.standard_normal(x.shape[1])
            for _ in range(15):
                direction = centred.T @ (centred @ direction)
                direction /= np.linalg.norm(direction) + 1e-300
            order = np.argsort(centred @ direction, kind="stable")
            label[rows[order[len(rows) // 2 :]]] += size
        size *= 2
    ends = np.concatenate([near.reshape(-1), np.repeat(np.arange(len(x)), near.shape[1])])
    starts = np.concatenate([np.repeat(np.arange(len(x)), near.shape[1]), near.reshape(-1)])
    mean = len(x) / parts
    sizes = np.bincount(label, minlength=parts)
    for _ in range(rounds):
        votes = np.bincount(starts * parts + label[ends], minlength=len(x) * parts).reshape(len(x), parts)
        best = votes.argmax(1)
        gain = votes.max(1) - votes[np.arange(len(x)), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < 1.1 * mean and sizes[label[i]] > 0.9 * mean:
                sizes[label[i]] -= 1
                sizes[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


class Router:
    """Probabilities of the parts for unit vectors: one hidden layer, trained by Adam on soft targets."""

    def __init__(self, x: np.ndarray, target: np.ndarray, steps: int = 250) -> None:
        random = np.random.default_rng(4)
        width = x.shape[1]
        self.weights = [
            random.standard_normal((width, _HIDDEN)) * np.sqrt(2.0),
            np.zeros(_HIDDEN),
            random.standard_normal((_HIDDEN, target.shape[1])) * np.sqrt(1.0 / _HIDDEN),
            np.zeros(target.shape[1]),
        ]
        first = [np.zeros_like(w) for w in self.weights]
        second = [np.zeros_like(w) for w in self.weights]
        for step in range(1, steps + 1):
            hidden = np.maximum(0, x @ self.weights[0] + self.weights[1])
            p = self._softmax(hidden @ self.weights[2] + self.weights[3])
            wrong = (p - target) / len(x)
            back = (wrong @ self.weights[2].T) * (hidden > 0)
            slopes = [x.T @ back, back.sum(0), hidden.T @ wrong, wrong.sum(0)]
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                rate = 0.02 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                self.weights[i] = self.weights[i] - rate * first[i] / (np.sqrt(second[i]) + 1e-10)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return self._softmax(np.maximum(0, x @ a + b) @ c + d)


def learn(x: np.ndarray, parts: int) -> tuple[Router | None, int]:
    """The router and the number of parts to probe, from the sample's vectors."""
    if parts <= 1 or len(x) <= max(2 * parts, GRAPH_NEIGHBOURS + 1):
        return None, 1
    x = _unit(x)
    near = graph(x, GRAPH_NEIGHBOURS)
    label = partition(x, near, parts)
    share = np.eye(parts)[label] * 0.5 + np.eye(parts)[label[near]].mean(1) * 0.5
    # Fitted on all but every fourth vector, whose neighbours then tell how many parts to probe.
    tested = np.arange(len(x)) % 4 == 0
    router = Router(x[~tested], share[~tested])
    p = router(x)
    place = np.argsort(np.argsort(-p, axis=1, kind="stable"), axis=1, kind="stable")
    own = p.argmax(1)
    ranks = place[np.flatnonzero(tested)[:, None], own[near[tested][:, :]]]
    probes = 1 + int(np.searchsorted(np.cumsum(np.bincount(ranks.reshape(-1), minlength=parts)) / ranks.size, TARGET))
    return router, min(parts, probes)


def _vectors(column_: pa.Array) -> np.ndarray:
    rows = len(column_)
    flat = column_.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def _index(router: Router | None, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                vectors = part.column(part.schema.get_field_index("vector"))
                if router is None:
                    order = np.zeros((part.num_rows, 1), np.int64)
                else:
                    order = np.argsort(-router(_unit(_vectors(vectors))), axis=1, kind="stable")[:, :probes]
                asks = np.asarray(part.column(part.schema.get_field_index("asks")).to_numpy(zero_copy_only=False), bool)
                probed = [o.tolist() if a else None for o, a in zip(order, asks)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(part.schema.get_field_index("vec_id")),
                        vectors,
                        pa.array(order[:, 0].astype(np.int32)),
                        pa.array(probed, pa.list_(pa.int32())),
                    ],
                    ["vec_id", "vector", "part", "probed"],
                )

    return run


def nearest(query: np.ndarray, query_id: int, near: np.ndarray, ids: np.ndarray, x: np.ndarray, norms: np.ndarray, k: int):
    """The ``k`` nearest of a block, ties to the smaller id; ``ids`` rise, ``near`` are cosines up to rounding.

    The exact cosines of the leaders are computed row by row, so that equal
    vectors have equal scores wherever they lie.
    """
    others = np.flatnonzero(ids != query_id)
    if len(others) > k:
        bar = np.partition(near[others], len(others) - k)[len(others) - k]
        others = others[near[others] >= bar - 1e-9]
    score = (x[others] * query).sum(1) / (norms[others] * np.sqrt((query * query).sum()))
    best = np.argsort(-score, kind="stable")[:k]
    return ids[others[best]], score[best]


def _rank(k: int):
    def run(key, index, queries):
        found: list[tuple] = []
        if index.num_rows and queries.num_rows:
            index = index.sort_by("vec_id")
            ids = index.column("vec_id").to_numpy()
            x = _vectors(index.column("vector").combine_chunks())
            norms = np.sqrt((x * x).sum(1))
            unit = x / norms[:, None]
            query_ids = queries.column("query_id").to_numpy()
            q = _vectors(queries.column("vector").combine_chunks())
            for low in range(0, len(q), 256):
                near = _unit(q[low : low + 256]) @ unit.T
                for i, row in enumerate(near, low):
                    some, score = nearest(q[i], query_ids[i], row, ids, x, norms, k)
                    found.append((np.full(len(some), query_ids[i]), some, score))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64)] * 2 + [np.empty(0)]
        return pa.table(
            {"query_id": pa.array(columns[0]), "vec_id": pa.array(columns[1]), "score": pa.array(columns[2].astype(np.float64))}
        )

    return run


def nearest_neighbours(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the ``k`` nearest found, by cosine.

    ``queries`` marks the query rows; candidates are all rows but those with the
    query's id. Ties go to the smaller id. All candidates come back if there are fewer than ``k``
    in the probed parts.

    Defined cases: vectors that are null, empty or zero, or hold null or
    non-finite components, take no part, nor do null ids, nor vectors of another
    length than the most frequent one. Rows that repeat an id are candidates each. An empty table
    gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = column(vector_col)
    sound = (
        column(id_col).isNotNull()
        & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(v, lambda x: x != 0)
    )
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(
        column(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks")
    )
    widths = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == widths[0]["width"])
    total = widths[0]["count"]
    sample = hashed_sample(rows, F.xxhash64("vec_id", "vector"), SAMPLE, total).select("vector").toArrow()
    router, probes = learn(_vectors(sample.column("vector").combine_chunks()), parts_for(total))

    index = checkpointed(rows.mapInArrow(_index(router, probes), _INDEXED))
    asked = index.where(F.col("probed").isNotNull()).select(
        F.col("vec_id").alias("query_id"), "vector", F.explode("probed").alias("part")
    )
    held = index.groupBy("part").count().collect()  # one row for each part
    sought = asked.groupBy("part").count().collect()
    blocks = _by_part({r["part"]: -(-r["count"] // BLOCK) for r in held})
    shifts = _by_part({r["part"]: -(-r["count"] // BLOCK) for r in sought})
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    keys = ["part", "block", "shift"]
    placed = index.select(
        "part", F.pmod(F.xxhash64("vec_id"), blocks).cast("int").alias("block"), "vec_id", "vector",
        each(shifts).alias("shift"),
    )
    probing = asked.select(
        "part", F.pmod(F.xxhash64("query_id"), shifts).cast("int").alias("shift"), "query_id", "vector",
        each(blocks).alias("block"),
    )
    found = (
        placed.groupBy(*keys)
        .cogroup(probing.groupBy(*keys))
        .applyInArrow(_rank(k), _NEAR)
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _by_part(counts: dict[int, int]) -> Column:
    """The part's number of blocks, 1 at least."""
    size = max(counts, default=0) + 1
    return F.get(F.array(*[F.lit(max(1, counts.get(p, 1))) for p in range(size)]), F.col("part"))
