"""Keep documents whose perplexity under a model of trusted text is usual for their language.

The model is an interpolated modified Kneser-Ney model of bytes: raw counts of
the longest n-grams, continuation counts of the shorter ones, three discounts
for each order from its counts of counts. Bytes keep the number of n-grams far
below that of words, so unknown words still get a fair probability.

Tasks count the trusted n-grams where the texts lie and send packed counts to
shards, where they meet. Continuation counts, totals, discounts and
probabilities are joins and groupings of the count tables. A model that is
counted to be small is then broadcast. Beyond that its shards meet the distinct
n-grams of units of documents (see `exchange`), and the texts are shuffled once.

A quarter of the trusted documents, by hash, is not learned from but calibrates:
a document is rejected if its cross-entropy lies above its language's limit, a
high quantile of that language's calibrating documents. Limits from the learned documents would be too low,
most of all with little text to learn from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixscore.llm import bytetext
from mixscore.llm.common import checkpointed, column, fresh_name, partitions, ship, tidy, within_bound
from mixscore.llm.exchange import pack_keys, unpack_keys

#: Bytes in the longest n-gram; 7 at most, so that an n-gram is one number.
ORDER = 5

#: Bytes of the language's median cross-entropy that are added to every document, for short ones.
PRIOR_BYTES = 100.0

#: Of so many trusted documents one calibrates.
CALIBRATION = 4

#: A language with fewer calibrating documents takes the limit of all.
LEAST_CALIBRATING = 50

_COUNTED = "shard int, grams binary, counts binary"
_GRAM = "shard int, gram long, n long"
_ASK = "shard int, unit long, grams binary"
_ANSWER = "unit long, shard int, grams binary, logp binary, logg binary"
_SCORE = "doc_id long, source_row long, n_bytes long, log10_p double"
_PRIME = 1_000_003

#: Bytes of text in one slice, and n-grams that a task gathers before it sends them on.
_SLICE = 1 << 19
_MOST_KEYS = 1 << 19

#: A model of at most so many n-grams (16 bytes each, 16 MB) is broadcast; a larger one stays in shards.
BROADCAST_GRAMS = 1_000_000


def _shard(grams: np.ndarray, shards: int) -> np.ndarray:
    return (grams % np.uint64(_PRIME) % np.uint64(shards)).astype(np.int64)


class Grams:
    """All n-grams of a unit's texts: for each order the distinct ones, and each position's.

    An n-gram of order ``k`` is the number its ``k`` bytes spell. Order by
    order, the n-gram ending at a position is numbered by the one before it and
    its last byte, so counting needs no sort.
    """

    def __init__(self, texts: pa.Array, order: int) -> None:
        self.data, self.offsets = bytetext.utf8(texts)
        n = len(self.data)
        place = np.arange(n) - np.repeat(self.offsets[:-1], np.diff(self.offsets))
        self.grams: list[np.ndarray] = []
        self.where: list[np.ndarray] = []
        symbols, symbol = _distinct(self.data.astype(np.int64), 256)
        self.grams.append(symbols.astype(np.uint64))
        self.where.append(symbol.astype(np.int32))
        for k in range(1, order):
            at = np.flatnonzero(place >= k)
            code = self.where[-1][at - 1].astype(np.int64) * len(symbols) + symbol[at]
            codes, number = _distinct(code, len(self.grams[-1]) * len(symbols))
            where = np.full(n, -1, np.int32)
            where[at] = number
            self.grams.append((self.grams[-1][codes // len(symbols)] << np.uint64(8)) | symbols[codes % len(symbols)].astype(np.uint64))
            self.where.append(where)


def _slices(table: pa.Table, order: int) -> Iterator[tuple[pa.RecordBatch, Grams]]:
    """A unit's documents in slices of bounded bytes, with their n-grams."""
    for batch in table.combine_chunks().to_batches():
        for part in bytetext.slices(batch, "text", _SLICE):
            yield part, Grams(part.column(part.schema.get_field_index("text")), order)


def _distinct(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the number of each entry's; codes lie under ``size``."""
    if size > 1 << 25:
        return np.unique(codes, return_inverse=True)
    present = np.zeros(size, bool)
    present[codes] = True
    number = np.cumsum(present, dtype=np.int32) - 1
    return np.flatnonzero(present), number[codes]


def _count(order: int, shards: int):
    """A task's counts of its longest n-grams, packed by shard; sent early where they are very many."""

    def packed(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        counts = counts.astype("<u4")
        rows = _by_shard(keys, shards)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([s for s, _ in rows], pa.int32()),
                pa.array([pack_keys(keys[at]) for _, at in rows], pa.binary()),
                pa.array([counts[at].tobytes() for _, at in rows], pa.binary()),
            ],
            ["shard", "grams", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, some, counted = np.empty(0, np.uint64), np.empty(0, np.int64), [], []
        for batch in batches:
            for part in bytetext.slices(batch, "text", _SLICE):
                grams = Grams(part.column(part.schema.get_field_index("text")), order)
                where = grams.where[-1]
                some.append(grams.grams[-1])
                counted.append(np.bincount(where[where >= 0], minlength=len(some[-1])))
                if sum(map(len, some)) > _MOST_KEYS:
                    keys, counts = _summed([keys, *some], [counts, *counted])
                    some, counted = [], []
                    if len(keys) > _MOST_KEYS:
                        yield packed(keys, counts)
                        keys, counts = keys[:0], counts[:0]
        keys, counts = _summed([keys, *some], [counts, *counted])
        if len(keys):
            yield packed(keys, counts)

    return run


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of several lists and the sums of their counts."""
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(where, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)


def _by_shard(grams: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """For each shard that has some, the places of its n-grams in rising order."""
    shard = _shard(grams, shards)
    order = np.lexsort((grams, shard))
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    return [(s, order[a:b]) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]


def _merge(key, table):
    grams = [unpack_keys(g) for g in table.column("grams").to_pylist()]
    keys, n = _summed(grams, [np.frombuffer(c, "<u4") for c in table.column("counts").to_pylist()])
    return pa.table(
        {
            "shard": pa.array(np.full(len(keys), key[0].as_py(), np.int32)),
            "gram": pa.array(keys.view(np.int64)),
            "n": pa.array(n),
        }
    )


def _kneser_ney(counts: DataFrame, order: int) -> DataFrame:
    """(k, gram, logp, logg) of the model from the counts of its longest n-grams.

    ``logp`` is the log10 probability of an n-gram's last byte after the others,
    null if the model has only its use as a history; ``logg`` the log10 weight
    that the n-gram as a history leaves to the shorter one.
    """
    tables = {order: checkpointed(counts.select("gram", "n"))}
    for k in range(order - 1, 0, -1):
        # how many different bytes come before: continuation counts
        mask = F.lit((1 << (8 * k)) - 1)
        tables[k] = tables[k + 1].groupBy(F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    tables = {k: checkpointed(t) for k, t in tables.items()}

    lower, model, weights = None, None, None
    for k in range(1, order + 1):
        table = tables[k]
        few = table.agg(*[F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)])
        discounts = _discounts(few.first())
        discount = F.when(F.col("n") == 1, discounts[0]).when(F.col("n") == 2, discounts[1]).otherwise(discounts[2])
        cut = table.select(F.shiftright("gram", 8).alias("history"), "gram", "n", F.lit(discount).alias("d"))
        totals = cut.groupBy("history").agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
        rates = cut.join(totals, "history").select(
            "gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("own"), (F.col("left") / F.col("total")).alias("g")
        )
        if lower is None:
            smoothed = rates.select("gram", (F.col("own") + F.col("g") / 256).alias("p"))
        else:
            mask = F.lit((1 << (8 * (k - 1))) - 1)
            smoothed = (
                rates.withColumn("shorter", F.col("gram").bitwiseAND(mask))
                .join(lower.select(F.col("gram").alias("shorter"), F.col("p").alias("q")), "shorter")
                .select("gram", (F.col("own") + F.col("g") * F.col("q")).alias("p"))
            )
        lower = checkpointed(smoothed)
        history = totals.select(F.lit(k - 1).alias("k"), F.col("history").alias("gram"), F.log10(F.col("left") / F.col("total")).alias("logg"))
        scored = lower.select(F.lit(k).alias("k"), "gram", F.log10("p").alias("logp"))
        model = scored if model is None else model.unionByName(scored)
        weights = history if weights is None else weights.unionByName(history)
    return model.join(weights, ["k", "gram"], "full")


def _discounts(few) -> tuple[float, float, float]:
    """The three discounts from the numbers of n-grams counted once to four times."""
    n1, n2, n3, n4 = (few[f"n{i}"] or 0 for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1))


def _ask(order: int, shards: int):
    def run(key, table):
        found: list[list[np.ndarray]] = [[np.empty(0, np.uint64)] for _ in range(order)]
        for _, grams in _slices(table, order):
            for some, new in zip(found, grams.grams):
                some.append(new)
                if sum(map(len, some)) > _MOST_KEYS:
                    some[:] = [np.unique(np.concatenate(some))]
        distinct = [np.unique(np.concatenate(some)) for some in found]
        rows = []
        for k, some in enumerate(distinct, 1):
            rows += [(s, pack_keys(some[at] | np.uint64(k << 56))) for s, at in _by_shard(some, shards)]
        return pa.table(
            {
                "shard": pa.array([s for s, _ in rows], pa.int32()),
                "unit": pa.array([key[0].as_py()] * len(rows), pa.int64()),
                "grams": pa.array([g for _, g in rows], pa.binary()),
            }
        )

    return run


def _answer(key, asked, model):
    """For every n-gram asked for, its two numbers; NaN where the model has none."""
    keys, logp, logg = _arrays(model)
    found_p, found_g = [], []
    for grams in asked.column("grams").to_pylist():
        grams = unpack_keys(grams)
        p, g = np.full(len(grams), np.nan, "<f4"), np.full(len(grams), np.nan, "<f4")
        if len(keys):
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            hit = keys[at] == grams
            p[hit], g[hit] = logp[at[hit]], logg[at[hit]]
        found_p.append(p.tobytes())
        found_g.append(g.tobytes())
    return pa.table(
        {
            "unit": asked.column("unit"),
            "shard": asked.column("shard"),
            "grams": asked.column("grams"),
            "logp": pa.array(found_p, pa.binary()),
            "logg": pa.array(found_g, pa.binary()),
        }
    )


def _log_probabilities(grams: Grams, keys: np.ndarray, logp: np.ndarray, logg: np.ndarray) -> np.ndarray:
    """Log10 probability of each byte of a slice, from n-grams and histories sorted by key."""
    own, weight = [], []
    for k, g in enumerate(grams.grams, 1):
        g = g | np.uint64(k << 56)
        at = np.minimum(np.searchsorted(keys, g), max(0, len(keys) - 1))
        hit = keys[at] == g if len(keys) else np.zeros(len(g), bool)
        p, w = np.full(len(g), np.nan), np.zeros(len(g))
        p[hit], w[hit] = logp[at[hit]], np.nan_to_num(logg[at[hit]], nan=0.0)
        own.append(p)
        weight.append(w)
    where = grams.where
    lp = own[0][where[0]]
    lp = np.where(np.isnan(lp), -np.log10(256.0), lp)
    for k in range(1, len(where)):
        at = np.flatnonzero(where[k] >= 0)
        arc = own[k][where[k][at]]
        lp[at] = np.where(np.isnan(arc), lp[at] + weight[k - 1][where[k - 1][at - 1]], arc)
    return lp


def _sums(part: pa.RecordBatch, grams: Grams, lp: np.ndarray) -> pa.RecordBatch:
    sums = np.concatenate([[0.0], np.cumsum(lp)])
    return pa.RecordBatch.from_arrays(
        [
            part.column(part.schema.get_field_index("doc_id")),
            part.column(part.schema.get_field_index("source_row")),
            pa.array(np.diff(grams.offsets)),
            pa.array(sums[grams.offsets[1:]] - sums[grams.offsets[:-1]]),
        ],
        ["doc_id", "source_row", "n_bytes", "log10_p"],
    )


def _score_here(order: int, model):
    """Scores with the whole model, a broadcast of sorted keys and their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logp, logg = model.value
        for batch in batches:
            for part in bytetext.slices(batch, "text", _SLICE):
                grams = Grams(part.column(part.schema.get_field_index("text")), order)
                yield _sums(part, grams, _log_probabilities(grams, keys, logp, logg))

    return run


def _score_unit(order: int):
    """Scores of a unit's documents with the answers to its own n-grams."""

    def run(key, docs, answers):
        columns = [answers.column(c).to_pylist() for c in ("grams", "logp", "logg")]
        keys = np.concatenate([np.empty(0, np.uint64), *map(unpack_keys, columns[0])])
        known = np.argsort(keys)
        keys = keys[known]
        logp, logg = (
            np.concatenate([np.empty(0, "<f4"), *(np.frombuffer(x, "<f4") for x in c)])[known] for c in columns[1:]
        )
        return pa.Table.from_batches(
            [_sums(part, grams, _log_probabilities(grams, keys, logp, logg)) for part, grams in _slices(docs, order)]
        )

    return run


def _arrays(model: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model's keys in order, with their log probabilities and history weights."""
    grams = model.column("gram").to_numpy().astype(np.int64).view(np.uint64)
    keys = grams | (model.column("k").to_numpy().astype(np.uint64) << np.uint64(56))
    order = np.argsort(keys)
    return keys[order], *(model.column(c).to_numpy()[order].astype("<f4") for c in ("logp", "logg"))


def _score_sharded(rows: DataFrame, model: DataFrame, order: int, shards: int) -> DataFrame:
    """Scores where the model is too large to be in one place: units ask its shards for their own n-grams."""
    identity = F.coalesce(F.xxhash64("doc_id"), F.lit(0)).bitwiseXOR(F.col("source_row"))
    rows = rows.withColumn("unit", F.pmod(identity, F.lit(shards)))
    sharded = model.select(((F.col("gram") % _PRIME) % shards).cast("int").alias("shard"), "k", "gram", "logp", "logg")
    asked = rows.groupBy("unit").applyInArrow(_ask(order, shards), _ASK)
    answered = asked.groupBy("shard").cogroup(sharded.groupBy("shard")).applyInArrow(_answer, _ANSWER)
    return rows.groupBy("unit").cogroup(answered.groupBy("unit")).applyInArrow(_score_unit(order), _SCORE)


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    order: int = ORDER,
    quantile: float = 0.995,
    broadcast_grams: int = BROADCAST_GRAMS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """(doc_id, text_hash, lang, n_bytes, perplexity, highest, kept) of every row.

    ``labels`` holds (doc_id, quality, toxic); the text of documents with
    quality 1 that aren't toxic is trusted: learned from, or calibrating. ``perplexity`` is that of a byte.
    For the decision, `PRIOR_BYTES` of the language's median are added, so that
    a few odd words in a short text prove nothing. The limit is the
    ``quantile`` of the language's calibrating documents itself.

    Defined cases: a null or empty text has perplexity null and is kept. A null
    language, or one with fewer than `LEAST_CALIBRATING` calibrating documents, is
    judged by the limit of all of them; without any, everything is kept. Rows that repeat an id
    are judged each (``text_hash`` tells them apart); a null id is not trusted.
    Empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    shards = partitions(spark)
    text = column(text_col)
    rows = docs.select(
        column(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("source_row"), text.alias("text")
    )
    trusted = checkpointed(
        labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id"))
        .distinct()
    )
    calibrating = F.pmod(F.xxhash64(F.lit("calibrate"), F.col("doc_id")), F.lit(CALIBRATION)) == 0
    learned = within_bound(checkpointed(trusted.where(~calibrating)))
    counted = rows.join(learned, "doc_id", "left_semi").select("text").mapInArrow(tidy(_count(order, shards)), _COUNTED)
    merged = counted.groupBy("shard").applyInArrow(_merge, _GRAM)
    model = checkpointed(_kneser_ney(merged, order))
    if model.limit(broadcast_grams + 1).count() <= broadcast_grams:
        scored = rows.mapInArrow(tidy(_score_here(order, spark.sparkContext.broadcast(_arrays(model.toArrow())))), _SCORE)
    else:
        scored = _score_sharded(rows, model, order, shards)

    lang = docs.select(
        column(id_col).cast("long").alias("lid"), F.xxhash64(text).alias("lrow"), column(lang_col).alias("lang")
    ).distinct()
    per_byte = F.when(F.col("n_bytes") > 0, -F.col("log10_p") / F.col("n_bytes"))
    judged = checkpointed(
        scored.distinct()
        .join(lang, F.col("doc_id").eqNullSafe(F.col("lid")) & (F.col("source_row") == F.col("lrow")))
        .join(trusted.where(calibrating).select(F.col("doc_id").alias("tid")), F.col("doc_id") == F.col("tid"), "left")
        .select("doc_id", F.col("source_row").alias("text_hash"), "lang", "n_bytes", per_byte.alias("bits"), F.col("tid").isNotNull().alias("calibrates"))
    )
    return _decide(judged, quantile)


def _decide(judged: DataFrame, quantile: float) -> DataFrame:
    good = judged.where("calibrates AND bits IS NOT NULL").select(
        "n_bytes", "bits", F.explode(F.array(F.struct(F.lit(True).alias("every"), F.lit(None).cast("string").alias("lang")), F.struct(F.lit(False).alias("every"), "lang"))).alias("of")
    ).select("of.*", "n_bytes", "bits").where("every OR lang IS NOT NULL")
    middle = good.groupBy("every", "lang").agg(F.percentile_approx("bits", 0.5, 10000).alias("median"))
    padded = lambda bits, n, median: (bits * n + F.lit(PRIOR_BYTES) * median) / (n + F.lit(PRIOR_BYTES))
    pad = good.join(
        middle.withColumnsRenamed({"every": "e", "lang": "l"}),
        (F.col("every") == F.col("e")) & F.col("lang").eqNullSafe(F.col("l")),
    ).withColumn("padded", padded(F.col("bits"), F.col("n_bytes"), F.col("median")))
    bands = pad.groupBy("every", "lang").agg(
        F.first("median").alias("median"), F.count(F.lit(1)).alias("n"), F.percentile_approx("padded", quantile, 10000).alias("highest")
    )
    bands = checkpointed(bands)
    every = bands.where("every").first()  # one row: the limit of all
    any_band = F.lit(None).cast("struct<median:double,highest:double>")
    if every is not None:
        any_band = F.struct(F.lit(every["median"]).alias("median"), F.lit(every["highest"]).alias("highest"))
    own = bands.where(~F.col("every") & (F.col("n") >= LEAST_CALIBRATING)).select(
        F.col("lang").alias("blang"), F.struct("median", "highest").alias("band")
    )
    joined = judged.join(own, F.col("lang") == F.col("blang"), "left").withColumn("band", F.coalesce("band", any_band))
    bits = padded(F.col("bits"), F.col("n_bytes"), F.col("band.median"))
    inside = bits <= F.col("band.highest")
    return joined.select(
        "doc_id", "text_hash", "lang", "n_bytes",
        F.pow(F.lit(10.0), "bits").alias("perplexity"),
        F.pow(F.lit(10.0), "band.highest").alias("highest"),
        F.coalesce(inside, F.lit(True)).alias("kept"),
    )


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rejected ones."""
    doc, version = fresh_name(docs, "__out"), fresh_name(docs, "__hash")
    judged = judge_quality(docs, labels, id_col=id_col, text_col=text_col, **options)
    out = judged.where(~F.col("kept")).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(version)).distinct()
    return docs.join(
        within_bound(checkpointed(out)),
        column(id_col).eqNullSafe(F.col(doc)) & (F.xxhash64(column(text_col)) == F.col(version)),
        "left_anti",
    )
