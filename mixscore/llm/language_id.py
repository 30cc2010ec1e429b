"""Language identification with error-correcting output codes.

Every language has a codeword of bits. One binary classifier for each bit,
logistic regression on hashed byte n-grams, predicts that bit of a text's
language. Decoding weighs each bit by its loss: the language whose codeword
has the smallest summed logistic loss wins, so a few wrong bits are
corrected. Where the runner-up is about as near, the text is flagged as
ambiguous.

The classifiers are fitted on a bounded sample of labelled documents
(`SAMPLE_DOCS` in all, evenly over languages, chosen by a hash of the id),
whole and as a snippet each, so short texts are learned too. Every language with
a text to learn from has a codeword, whose bits grow with the logarithm of their number. The model has
`FEATURES` weights for each bit; every text is read whole, once, where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixscore.llm import bytetext
from mixscore.llm.common import column, ship

#: Labelled documents that the classifiers are fitted on, at most; with very many languages `LEAST_DOCS` of each.
SAMPLE_DOCS = 1024
LEAST_DOCS = 4

#: Hashed n-grams; bytes in the longest.
FEATURES = 8192
LONGEST = 3

#: A runner-up with at least this share of the winner's probability makes a text ambiguous.
AMBIGUOUS = 0.5

_SNIPPET = 80
_RESULT = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"


def codewords(languages: int) -> np.ndarray:
    """A row of signs for each language: all splits of up to seven, else the best of random ones."""
    if languages <= 1:
        return np.ones((languages, 0))
    if languages <= 7:
        bits = 2 ** (languages - 1) - 1
        return np.array([[1.0 if (b + 1) >> i & 1 else -1.0 for b in range(bits)] for i in range(languages)])
    bits = int(np.ceil(12 * np.log2(languages)))
    random = np.random.default_rng(5)
    best, most = None, -1
    for _ in range(200 if languages <= 128 else 20):  # long random words are far apart anyway
        code = random.choice([-1.0, 1.0], (languages, bits))
        apart = (bits - code @ code.T) / 2
        nearest = apart[~np.eye(languages, dtype=bool)].min()
        if nearest > most and (abs(code.sum(0)) < languages).all():
            best, most = code, nearest
    return best


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unit vectors of the square roots of hashed byte n-gram counts, a row for each text."""
    rows = len(offsets) - 1
    data = bytetext.lowered(data).astype(np.int64)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    out = np.zeros(rows * FEATURES, np.float32)
    for n in range(1, LONGEST + 1):
        if len(data) < n:
            break
        code = data[: len(data) - n + 1].copy()
        for i in range(1, n):
            code = code * 257 + data[i : len(data) - n + 1 + i]
        inside = row[: len(code)] == row[n - 1 :]
        bucket = ((code[inside] * 2654435761 + n * 40503) >> 13) % FEATURES
        out += np.bincount(row[: len(code)][inside] * FEATURES + bucket, minlength=len(out)).astype(np.float32)
    out = np.sqrt(out).reshape(rows, FEATURES)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fit(x: np.ndarray, signs: np.ndarray, steps: int = 200, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of one logistic regression for each column of ``signs``."""
    signs = signs.astype(np.float32)  # else every product would be made in double precision
    w = np.zeros((x.shape[1], signs.shape[1]), np.float32)
    b = np.zeros(signs.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        wrong = -signs / (1 + np.exp(np.clip(signs * (x @ w + b), -30, 30))) / np.float32(len(x))
        vw = 0.9 * vw - 4.0 * (x.T @ wrong + ridge * w)
        vb = 0.9 * vb - 4.0 * wrong.sum(0)
        w, b = (w + vw).astype(np.float32), (b + vb).astype(np.float32)
    return w, b


def decode(margins: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Probabilities of the languages from the bits' margins: the smaller the summed loss, the likelier."""
    margins = margins.astype(np.float64)
    # of a bit's two losses, the one that the codeword has there
    loss = np.logaddexp(0, -margins) @ (code > 0).T + np.logaddexp(0, margins) @ (code < 0).T
    p = np.exp(loss.min(1, keepdims=True) - loss)
    return p / p.sum(1, keepdims=True)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in bytetext.slices(batch, "text", 2 << 20):
        for low in range(0, part.num_rows, 512):
            yield part.slice(low, 512)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of each sampled text and of a snippet from somewhere in it."""
    for batch in batches:
        for part in _parts(batch):
            texts = part.column("text").to_pylist()
            ids = part.column("doc_id").to_pylist()
            starts = [(i * 7919) % max(1, len(t) - _SNIPPET) for i, t in zip(ids, texts)]
            texts += [t[s : s + _SNIPPET] for s, t in zip(starts, texts)]
            x = features(*bytetext.utf8(pa.array(texts, pa.string()))).astype(np.float16)
            lang = part.column("lang").to_pylist() * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"]
            )


def _predict(languages: list[str], code: np.ndarray, weights: np.ndarray, intercepts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(languages, object)
        for batch in batches:
            for part in _parts(batch):
                x = features(*bytetext.utf8(part.column(part.schema.get_field_index("text"))))
                p = decode(x @ weights + intercepts, code)
                first = p.argmax(1)
                score = p[np.arange(len(p)), first]
                second = np.sort(p, axis=1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
                lettered = np.asarray(part.column("lettered").to_numpy(zero_copy_only=False), bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("held_out"),
                        pa.array(np.where(lettered, names[first], "und"), pa.string()),
                        pa.array(np.where(lettered, score, 0.0)),
                        pa.array(lettered & (second > AMBIGUOUS * score)),
                    ],
                    ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
                )

    return run


def identify_languages(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous): one row for each row of ``docs``.

    Learns from text and language of rows where ``held_out`` is false and the
    language isn't null. ``score`` is the probability of the predicted language
    among the learned ones.

    Defined cases: a text that is null or has no letter is `und` with score 0,
    and is not learned from. With one learned language that one is predicted
    with score 1, with none all is `und`. A null ``held_out`` counts as true for
    learning and as false in the result. Repeated rows are predicted each;
    an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    text = column(text_col)
    rows = docs.select(
        column(id_col).cast("long").alias("doc_id"),
        held_out.alias("apart"),
        text.alias("text"),
        column(lang_col).alias("lang"),
        F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
    )
    labelled = rows.where(~F.col("apart") & F.col("lang").isNotNull() & F.col("lettered") & F.col("doc_id").isNotNull())
    languages = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())  # names only
    if not languages:
        return rows.select(
            "doc_id", F.coalesce("apart", F.lit(False)).alias("held_out"), F.lit("und").alias("lang_pred"),
            F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"),
        )
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        labelled.select("doc_id", "lang")
        .withColumn("rank", F.row_number().over(by_hash))
        .where(F.col("rank") <= max(LEAST_DOCS, SAMPLE_DOCS // len(languages)))
        .select("doc_id")
        .distinct()
    )
    sample = (
        labelled.join(F.broadcast(chosen), "doc_id", "left_semi")  # at most SAMPLE_DOCS rows, or LEAST_DOCS a language
        .select("doc_id", "lang", "text")
        .dropDuplicates(["doc_id"])
        .mapInArrow(_sample_features, "lang string, x binary")
        .toArrow()
    )
    x = np.stack([np.frombuffer(v, np.float16) for v in sample.column("x").to_pylist()]).astype(np.float32)
    place = {v: i for i, v in enumerate(languages)}
    label = np.array([place[v] for v in sample.column("lang").to_pylist()])
    code = codewords(len(languages))
    weights, intercepts = fit(x, code[label])
    return rows.select(
        "doc_id", F.coalesce("apart", F.lit(False)).alias("held_out"), "text", "lettered"
    ).mapInArrow(_predict(languages, code, weights, intercepts), _RESULT)
