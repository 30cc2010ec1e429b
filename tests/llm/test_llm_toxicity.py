import glob
import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mixscore.llm import toxicity
from mixscore.llm.bytetext import utf8
from mixscore.llm.toxicity import padded, score_toxicity, word_buckets

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, toxic int, quality int"


def corpus(n, seed=1):
    """Texts of random words; toxic ones hold a word of one of two stems, as whole words or inflected."""
    random.seed(seed)
    words = ["".join(random.choices("abcdefgh", k=random.randint(3, 8))) for _ in range(3000)]
    rows, labels = [], []
    for i in range(n):
        text = random.choices(words, k=random.randint(5, 120))
        toxic = int(random.random() < 0.3)
        if toxic:
            word = "zorgul" if i % 2 else "quixab" + random.choice(["on", "ing", "ed", "s", "ly", "ous"])
            text.insert(random.randrange(len(text)), random.choice([word, word.upper(), word + "!"]))
        rows.append((i, " ".join(text), "de" if i % 3 else "en"))
        labels.append((i, toxic, 1))
    return rows, labels


def outputs_by_hand(net, texts):
    """The network's outputs, a window at a time."""
    out = []
    for text in texts:
        buckets, tokens, _ = word_buckets(*utf8(pa.array([text], pa.string())))
        vectors = [net.embedding[[r for r in net.known(buckets[t : t + 1])[0]]].sum(0) for t in tokens]
        blank = np.zeros(toxicity.DIMENSIONS)
        vectors = (vectors or [blank]) + [blank] * 2
        pooled = []
        for i, width in enumerate(toxicity.WIDTHS):
            answers = [
                sum(vectors[t + j] @ net.filters[i][j] for j in range(width)) for t in range(len(vectors) - width + 1)
            ]
            pooled.append(np.maximum(np.max(answers, 0) + net.bias[i], 0))
        out.append(np.concatenate(pooled) @ net.out + net.base)
    return np.array(out)


def test_words_and_beginnings_are_found_in_any_slice():
    texts = ["Zorgul, zorguling x", None, "", "zorgul", "éa éa"]
    buckets, tokens, begin = word_buckets(*utf8(pa.array(texts, pa.string())))
    assert np.diff(begin).tolist() == [3, 0, 0, 1, 2]
    assert tokens[0] == tokens[3] and tokens[4] == tokens[5]
    assert (buckets[tokens[0], 1:5] == buckets[tokens[1], 1:5]).all() and buckets[tokens[0], 0] != buckets[tokens[1], 0]
    assert (buckets[tokens[2], 1:] == -1).all()
    toks, starts = padded(tokens, begin)
    assert np.diff([*starts, len(toks)]).tolist() == [5, 3, 3, 3, 4]


def test_outputs_equal_the_network_a_window_at_a_time():
    rows, labels = corpus(200)
    texts = [t for _, t, _ in rows]
    net = toxicity.train(*word_buckets(*utf8(pa.array(texts))), np.array([y for _, y, _ in labels]))
    some = [*texts[:20], "", None, "zorgul", "zorgul quixabing", "word " * 5000]
    got = toxicity._outputs(net, pa.array(some, pa.string()))
    assert np.allclose(got, outputs_by_hand(net, some), atol=1e-4)


def test_held_out_toxic_texts_are_found_and_clean_ones_left(spark):
    rows, labels = corpus(1500)
    docs, marks = spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(labels, LABELS)
    got = score_toxicity(docs, marks, F.col("doc_id") % 4 == 2).collect()
    assert len(got) == len(rows)
    truth = {i: y for i, y, _ in labels}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == set(range(2, 1500, 4))
    caught = [r["predicted"] for r in held if truth[r["doc_id"]]]
    alarms = [r["predicted"] for r in held if not truth[r["doc_id"]]]
    assert np.mean(caught) > 0.9 and np.mean(alarms) < 0.05
    flagged = [r["flagged"] for r in held if truth[r["doc_id"]]]
    assert np.mean(flagged) > 0.85
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)


def test_scores_read_the_text_alone(spark):
    rows, labels = corpus(300)
    marks = spark.createDataFrame(labels, LABELS)
    held = F.col("doc_id") >= 200
    once = {r["doc_id"]: r["score"] for r in score_toxicity(spark.createDataFrame(rows, DOCS), marks, held).collect()}
    moved = [(i, t, "xx" if i >= 200 else lang) for i, t, lang in rows]
    others = spark.createDataFrame([(i, 1 - y if i >= 200 else y, q) for i, y, q in labels], LABELS)
    again = {r["doc_id"]: r["score"] for r in score_toxicity(spark.createDataFrame(moved, DOCS), others, held).collect()}
    assert once == again


def test_defined_cases(spark):
    rows, labels = corpus(200)
    rows += [(900, None, None), (901, "", "en"), (902, "zorgul " * 20000, "en"), (None, "zorgul", "en"), (902, "again", "de")]
    labels += [(3, 0, 1), (3, 1, 1), (None, 1, 1), (7, None, 1), (8000, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], DOCS + ", toxic int, score string")
    got = score_toxicity(docs, spark.createDataFrame(labels, LABELS), F.col("doc_id") % 4 == 2).collect()
    assert len(got) == len(rows) and all(r["score"] is not None for r in got)
    empty = [r["score"] for r in got if r["doc_id"] in (900, 901)]
    assert empty[0] == empty[1]
    marks = spark.createDataFrame(labels, LABELS)
    assert score_toxicity(docs.limit(0), marks, F.col("doc_id") % 4 == 2).collect() == []
    none = score_toxicity(docs, marks.limit(0), F.col("doc_id") % 4 == 2).collect()
    assert {(r["score"], r["predicted"], r["flagged"]) for r in none} == {(0.0, 0, False)}
    one = score_toxicity(docs, marks.where("toxic = 1"), F.col("doc_id") % 4 == 2).collect()
    assert {r["score"] for r in one} == {1.0}


def test_thresholds_by_language_lean_on_all_texts():
    scores = np.array([0.1, 0.2, 0.8, 0.9] * 100)
    toxic = np.array([0, 0, 1, 1] * 100)
    lang = ["en"] * 396 + ["fr", "fr", "fr", None]
    cuts = toxicity.thresholds(scores, toxic, lang, 0.3)
    assert cuts[None] == pytest.approx(0.5) and cuts["en"] == pytest.approx(0.5)
    assert abs(cuts["fr"] - 0.5) < 0.02
    assert toxicity.best_threshold(scores, 0 * toxic, 0.3) == 0.3


def test_every_labelled_text_is_learned_from(spark, monkeypatch):
    """More labelled texts than an earlier sample took, texts of over 16 KB among them."""
    rows, labels = corpus(9000, seed=5)
    rows[13] = (13, rows[13][1] + " lengthword" * 3000, "en")
    rows[17] = (17, "lengthword " * 3000, "en")
    rows[21] = (21, "lengthword " * 3000, "en")
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda texts, *more: seen.append((texts, more)) or fit(texts, *more))
    docs, marks = spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(labels, LABELS)
    got = score_toxicity(docs, marks, F.col("doc_id") % 4 == 2).collect()
    ((texts, (toxic, clean, size, shards)),) = seen
    assert texts.count() == toxic + clean and shards == 2 and texts.rdd.getNumPartitions() == 2
    apart = spark.range(9000).where("id % 4 <> 2").where(F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(4)) != 0)
    assert toxic + clean == apart.count() > 2 * 2000  # what an earlier sample took at most
    assert size == sum(len(rows[r[0]][1]) for r in apart.collect())
    truth = {i: y for i, y, _ in labels}
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] for r in held if truth[r["doc_id"]]]) > 0.9
    assert np.mean([r["predicted"] for r in held if not truth[r["doc_id"]]]) < 0.05


def test_shards_weights_are_averaged_where_they_were_touched():
    net, memory = toxicity.fresh(np.arange(5))
    every = toxicity._rows_of(net, memory)
    assert every.shape[1] == 2 * toxicity.DIMENSIONS
    table = pa.table({
        "part": [1, 1, 1], "row": [3, 1, 3], "shard": [0, 0, 1],
        "weights": [np.full(32, v, "<f4").tobytes() for v in (1.0, 7.0, 2.0)],
    })
    mean = toxicity._mean(table).to_pydict()
    assert mean["row"] == [1, 3] and [np.frombuffer(w, "<f4")[0] for w in mean["weights"]] == [7.0, 1.5]
    out = net.out.copy()
    toxicity._put_rows(net, memory, np.array(mean["row"]), np.array([np.frombuffer(w, "<f4") for w in mean["weights"]]))
    assert (net.embedding[3] == 1.5).all() and (memory[0][1] == 7.0).all() and (net.out == out).all()
    assert np.allclose(toxicity._rows_of(net, memory)[[0, 2]], every[[0, 2]])


def test_thresholds_of_counted_cells():
    low = np.array([0.25, 0.5, 0.75])
    n, toxic = np.array([100, 10, 50]), np.array([0, 10, 50])
    assert toxicity.best_threshold(low, toxic, 0.3, n, 0.25) == 0.5
    assert toxicity.thresholds(low, toxic, ["a"] * 3, 0.3, n, 0.25) == {None: 0.5, "a": 0.5}


def test_learning_leaves_no_shuffle_files(spark):
    folder = os.environ.get("SPARK_LOCAL_DIRS") or spark.sparkContext.getConf().get("spark.local.dir", "/tmp")
    files = lambda: set(glob.glob(f"{folder}/**/blockmgr-*/*/shuffle_*.data", recursive=True))
    before = files()
    assert spark.range(1000).repartition(3).groupBy().sum().first()[0] == 499500
    mine = {os.path.dirname(os.path.dirname(f)) for f in files() - before}
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert len(mine) == 1 and spark.conf.get(setting) == "false"
    before = files()
    rows, labels = corpus(400)
    got = score_toxicity(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS), F.col("doc_id") % 4 == 2)
    assert spark.conf.get(setting) == "false"
    left = lambda: {f for f in files() - before if os.path.dirname(os.path.dirname(f)) in mine}
    for _ in range(100):  # they are deleted in the background
        if not left():
            break
        time.sleep(0.2)
    assert not left()
    assert got.count() == 400
