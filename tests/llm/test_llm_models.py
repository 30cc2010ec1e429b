import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mixscore.llm import exchange, language_id, license_scan, lm_score, neighbours, quality
from mixscore.llm.lm_score import score_texts
from mixscore.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_packed_keys_and_numbers_come_back():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        assert exchange.unpack_keys(exchange.pack_keys(keys)).tolist() == keys.tolist()
        numbers = rng.integers(0, 2**31, n).astype("<u4")
        assert exchange.unpack_numbers(exchange.pack_numbers(numbers), "<u4").tolist() == numbers.tolist()
    bounds = exchange.range_bounds(np.array([0, 2**62, 2**63, 2**64 - 1], np.uint64), 4)
    assert bounds == [0, 1, 2, 3, 4]


def scores_by_hand(rows, order, strength):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [(h, [*WORD.findall((t or "").translate(low)), None]) for h, t in rows]
    counts = Counter(tuple(t[i : i + k]) for h, t in tokens if not h for k in range(1, order + 1) for i in range(len(t) - k + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1)
    types = sum(len(g) == 1 for g in counts)
    out = []
    for h, t in tokens:
        base = score = 0.0
        for i, w in enumerate(t):
            p = (counts[(w,)] + 0.1) / (total + 0.1 * (types + 1))
            base += math.log10(p)
            for k in range(1, order):
                history = tuple(t[max(0, i - k) : i])
                if len(history) == k and counts[history]:
                    p = (counts[(*history, w)] + strength * p) / (counts[history] + strength)
            score += math.log10(p)
        out.append((h, len(t), sum(counts[(w,)] > 0 for w in t), total, pytest.approx(base, rel=1e-9), pytest.approx(score, rel=1e-9)))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_the_formula(spark, order):
    rng = random.Random(3)
    rows = [(rng.random() < 0.3, " ".join(rng.choices("the of A b C d e f".split(), k=rng.randint(0, 30)))) for _ in range(40)]
    rows += [(False, None), (True, ""), (False, "long " * 30000), (True, "never seen words"), rows[0], rows[0]]
    df = spark.createDataFrame([(i, h, t, i) for i, (h, t) in enumerate(rows)], "doc_id long, apart boolean, text string, unit int")
    got = sorted(score_texts(df, F.col("apart"), order=order, strength=5.0).collect())
    assert [tuple(r[1:]) for r in got] == scores_by_hand(rows, order, 5.0)


def test_the_automaton_in_segments_equals_the_formula(monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choices("a b c d e f g".split(), k=rng.randint(0, 60))) for _ in range(30)] + [None, "x y"]
    held = [i % 4 == 0 for i in range(len(texts))]
    table = pa.table({"doc_id": list(range(len(texts))), "held_out": held, "text": texts})
    for order in (1, 2, 3, 4):
        want = scores_by_hand(list(zip(held, texts)), order, 3.0)
        tokens = lm_score.Tokens(table, order)
        counts = tokens.train_counts()
        words = (tokens.keys & lm_score._KIND) == 0
        total, types = int(counts[words].sum()), int((counts[words] > 0).sum())
        automaton = lm_score.Automaton(tokens, counts, total, types, 3.0)
        assert (automaton.depth[automaton.fails[1:]] == automaton.depth[1:] - 1).all()
        for segment in (1, 2, 7, 1000):
            monkeypatch.setattr(lm_score, "SEGMENT", segment)
            assert [w[5] for w in want] == lm_score.traverse(tokens, automaton).tolist()


def test_counts_over_32_bits():
    ask = {"shard": [0, 0], "unit": [1, 2], "keys": [exchange.pack_keys(np.array([2, 4], np.uint64))] * 2}
    ask["counts"] = [exchange.pack_numbers(np.array([3_000_000_000, 5], "<u8"))] * 2
    answer = lm_score._answer(None, pa.table(ask))
    assert answer.column("tokens").to_pylist() == [6_000_000_010] * 2
    assert exchange.unpack_numbers(answer.column("counts")[0].as_py(), "<u8").tolist() == [6_000_000_000, 10]


def test_scores_of_null_ids_repeats_and_nothing(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], DOCS)
    got = score_texts(df, F.col("doc_id") == 5).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "None"] and {r["train_tokens"] for r in got} == {9}
    assert {r["held_out"] for r in got} == {False}
    assert score_texts(df.limit(0), F.lit(False)).collect() == []
    assert {r["n_known"] for r in score_texts(df, F.lit(True)).collect()} == {0}


def test_held_out_documents_are_likelier_than_under_unigrams(spark, sf_dir):
    rows = QUERIES["op7_lm_score"](spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


# --- quality -------------------------------------------------------------------


def perplexity_by_hand(texts, trusted, order):
    """Interpolated modified Kneser-Ney over bytes, with dictionaries."""
    texts = [(t or "").encode() for t in texts]
    table = {order: Counter(t[i : i + order] for t, ok in zip(texts, trusted) if ok for i in range(len(t) - order + 1))}
    for k in range(order - 1, 0, -1):
        table[k] = Counter(g[1:] for g in table[k + 1])
    p, weight = {}, {}
    for k in range(1, order + 1):
        c = Counter(table[k].values())
        d1, d2, d3 = quality._discounts({f"n{i}": c[i] for i in (1, 2, 3, 4)})
        d = lambda n: d1 if n == 1 else d2 if n == 2 else d3  # noqa: B023, E731
        total, left = Counter(), Counter()
        for g, n in table[k].items():
            total[g[:-1]] += n
            left[g[:-1]] += d(n)
        for h in total:
            weight[h] = left[h] / total[h]
        for g, n in table[k].items():
            lower = p[g[1:]] if k > 1 else 1 / 256
            p[g] = (n - d(n)) / total[g[:-1]] + weight[g[:-1]] * lower
    out = []
    for t in texts:
        bits = 0.0
        for i in range(len(t)):
            value = p.get(t[i : i + 1], 1 / 256)
            for k in range(2, min(order, i + 1) + 1):
                g = t[i - k + 1 : i + 1]
                value = p[g] if g in p else weight.get(g[:-1], 1.0) * value
            bits -= math.log10(value)
        out.append(10 ** (bits / len(t)) if t else None)
    return out


@pytest.fixture(scope="module")
def judged(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return {n: {r["doc_id"]: r for r in quality.judge_quality(documents, labels, broadcast_grams=n).collect()} for n in (10**6, 5)}


def test_perplexities_equal_the_model_by_hand(spark, documents, sf_dir, judged):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")
    apart = F.pmod(F.xxhash64(F.lit("calibrate"), F.col("doc_id")), F.lit(quality.CALIBRATION)) == 0
    learned = {r["doc_id"] for r in good.where(~apart).collect()}
    rows = documents.select("doc_id", "text").collect()
    want = perplexity_by_hand([r["text"] for r in rows], [r["doc_id"] in learned for r in rows], quality.ORDER)
    got = judged[10**6]
    assert len(got) == len(rows)
    for r, p in zip(rows, want):
        assert got[r["doc_id"]]["perplexity"] == pytest.approx(p, rel=1e-4)


def test_shards_and_broadcast_agree(judged):
    a, b = judged[10**6], judged[5]
    assert a.keys() == b.keys()
    assert all(a[i]["kept"] == b[i]["kept"] and a[i]["perplexity"] == pytest.approx(b[i]["perplexity"], rel=1e-6) for i in a)


def test_noise_goes_and_labelled_good_text_stays(spark, documents, sf_dir, judged):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
    got = judged[10**6]
    good = [got[i]["kept"] for i, q in labels.items() if q == 1]
    assert np.mean(good) > 0.95
    noise = [got[i]["kept"] for i, t in texts.items() if t.count("***") > 5 or t.count("!!") > 5]
    assert noise and not any(noise)


def test_the_limit_is_the_quantile_itself(spark):
    rows = [(i, i, "en", 10**9, 1 + i / 1000, True) for i in range(200)] + [(900, 0, "en", 10**9, 1.1975, False), (901, 0, "en", 10**9, 1.25, False)]
    df = spark.createDataFrame(rows, "doc_id long, text_hash long, lang string, n_bytes long, bits double, calibrates boolean")
    got = {r["doc_id"]: r["kept"] for r in quality._decide(df, 0.995).collect()}
    assert got[900] and not got[901] and [i for i in range(200) if not got[i]] == [199]


def test_labelled_junk_goes_repeated_words_included(spark):
    """All rows labelled 0 of the middle table: how many stay, and of those that mostly repeat the word before."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"]: r["kept"] for r in quality.judge_quality(docs, labels).collect()}
    label = {r["doc_id"]: r["quality"] for r in labels.where("coalesce(toxic, 0) = 0 OR quality = 0").collect()}
    words = {r["doc_id"]: r["text"].split() for r in docs.where("text IS NOT NULL").collect()}
    junk = [i for i, q in label.items() if q == 0 and i in kept]
    repeated = [i for i in junk if np.mean([a == b for a, b in zip(words[i], words[i][1:])] or [0]) > 0.5]
    good = [i for i, q in label.items() if q == 1 and i in kept]
    assert len(junk) > 20 and len(repeated) > 5
    assert np.mean([kept[i] for i in junk]) < 0.04 and np.mean([kept[i] for i in repeated]) < 0.35
    assert np.mean([kept[i] for i in good]) > 0.98


def test_quality_defined_cases(spark):
    good = "plain words in a plain order make a plain text. " * 8
    rows = [(i, good[i:] + f"{i}", "en", i) for i in range(30)] + [(90, None, "en", 1), (91, "", None, 2), (92, "#$%&" * 200, None, 3)]
    rows += [(93, good, "xx", 4), (None, good, "en", 5), (92, good, "en", 6), (94, good * 3000, "en", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, __out int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(None, 1, 0), (90, None, None)], "doc_id long, quality int, toxic int")
    got = {(r["doc_id"], r["n_bytes"]): r for r in quality.judge_quality(df, labels).collect()}
    assert len(got) == len(rows)
    assert got[(90, 0)]["perplexity"] is None and got[(90, 0)]["kept"] and got[(91, 0)]["kept"]
    assert not got[(92, 800)]["kept"] and got[(92, len(good))]["kept"] and got[(93, len(good))]["kept"]
    left = quality.drop_low_quality(df, labels)
    assert left.columns == df.columns and left.where("doc_id = 92").count() == 1 and left.count() == len(rows) - 1
    assert quality.judge_quality(df.limit(0), labels).collect() == []
    assert all(r["kept"] for r in quality.judge_quality(df, labels.limit(0)).collect())


# --- language ------------------------------------------------------------------


def test_codewords_are_far_apart():
    for n in range(3, 8):
        code = language_id.codewords(n)
        assert min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i]) >= 2 ** (n - 2)
    code = language_id.codewords(20)
    assert min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i]) > 12


def test_a_wrong_bit_is_corrected():
    code = language_id.codewords(4)
    margins = 4 * code.copy()
    margins[:, 2] *= -1
    assert language_id.decode(margins, code).argmax(1).tolist() == [0, 1, 2, 3]


def test_held_out_languages_are_found(spark, documents, sf_dir):
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    rows = QUERIES["op5_language_id"](spark, sf_dir).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in rows if r["held_out"]]) > 0.97


def test_decoding_equals_the_loss_of_each_word_bit_by_bit():
    rng = np.random.default_rng(3)
    code = language_id.codewords(150)
    margins = rng.normal(0, 3, (20, code.shape[1]))
    for m, p in zip(margins, language_id.decode(margins, code)):
        loss = [sum(math.log1p(math.exp(-x * c)) for x, c in zip(m, word)) for word in code]
        weights = [math.exp(min(loss) - v) for v in loss]
        assert p == pytest.approx([w / sum(weights) for w in weights], rel=1e-9)


def test_two_hundred_languages_are_all_learned(spark):
    rng = random.Random(7)
    rows = []
    for k in range(200):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöüéñ", k=rng.randint(2, 7))) for _ in range(12)]
        rows += [(len(rows) + i, " ".join(rng.choices(words, k=40)), f"l{k:03d}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify_languages(df, F.col("doc_id") % 6 == 5).collect()
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r["held_out"]]
    assert len(held) == 200 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98


def test_language_defined_cases(spark):
    rows = [(i, t * 20, lang, "x") for i, (t, lang) in enumerate([("the and of with ", "en"), ("der die und nicht ", "de")] * 10)]
    rows += [(50, None, "en", "x"), (51, "", None, "x"), (52, "123 !? ²", "en", "x"), (53, "the of and " * 30000, None, "x"), (None, "die und der", "fr", "x"), (54, "und die", None, "x"), (54, "und die", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lettered string")
    got = language_id.identify_languages(df, F.col("doc_id") == 0).collect()
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert len(got) == len(rows)
    assert by_id[50] == by_id[51] == by_id[52] == ("und", 0.0)
    assert by_id[53][0] == "en" and by_id[54][0] == "de" and by_id[None][0] == "de"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language_id.identify_languages(df.limit(0), F.lit(False)).collect() == []
    assert {r["lang_pred"] for r in language_id.identify_languages(df, F.lit(True)).collect()} == {"und"}
    one = language_id.identify_languages(df.where("lang = 'en' OR lang IS NULL"), F.lit(False)).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("en", 1.0), ("und", 0.0)}


# --- licences ------------------------------------------------------------------


def test_every_template_is_found_and_prose_is_not(spark):
    phrases = [(f, p) for f, ps in license_scan.TEMPLATES.items() for p in ps]
    prose = ["The licence of the old mill was granted by the town.", "All rights come with duties, and all are reserved for later.", "A plain line of text."]
    rows = [(i, f"{random.Random(i).choice(prose)}\n{p}\nmore text") for i, (_, p) in enumerate(phrases)]
    rows += [(200 + i, p) for i, p in enumerate(prose)]
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in license_scan.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(i, 1): f for i, (f, _) in enumerate(phrases)}


def test_every_template_is_found_amid_300_words(spark, sf_dir):
    prose = " ".join(r["text"].replace("\n", " ") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 400").orderBy("doc_id").limit(40).collect()).split()
    for lines in license_scan.TEMPLATES.values():
        prose = [w for w in prose if not any(w in line.split() for line in lines)]
    phrases = [(f, p) for f, ps in license_scan.TEMPLATES.items() for p in ps]
    around = [(" ".join(prose[40 * i : 40 * i + 150]), " ".join(prose[40 * i + 150 : 40 * i + 300])) for i in range(len(phrases))]
    rows = [(i, f"{a} {p} {b}") for i, ((_, p), (a, b)) in enumerate(zip(phrases, around))]
    rows += [(100 + i, f"{a} {b}") for i, (a, b) in enumerate(around)]
    got = {r["doc_id"]: r["family"] for r in license_scan.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: f for i, (f, _) in enumerate(phrases)}


def test_licence_defined_cases(spark):
    mit = "Released under the MIT License."
    rows = [(1, None, 1), (2, "", 1), (3, f"\n{mit}\n\n{mit}", 1), (None, mit, 1), (4, mit, 1), (4, mit, 1), (5, "a b c\n" * 50000 + mit.upper(), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, family int")
    got = sorted(((r["doc_id"] or -1, r["paragraph"], r["family"]) for r in license_scan.scan_licenses(df).collect()))
    assert got == [(-1, 0, "mit"), (3, 1, "mit"), (3, 3, "mit"), (4, 0, "mit"), (4, 0, "mit"), (5, 50000, "mit")]
    assert license_scan.scan_licenses(df.limit(0)).collect() == []


def test_planted_licences_of_the_table(spark, documents, sf_dir):
    lines = {"Licensed under CC BY-NC 4.0.": "cc-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "All rights reserved.": "all-rights-reserved"}
    want = {(r["doc_id"], n, lines[x]) for r in documents.collect() for n, x in enumerate(r["text"].split("\n")) if x in lines}
    assert {(r["doc_id"], r["paragraph"], r["family"]) for r in QUERIES["op4_license_scan"](spark, sf_dir).collect()} == want


# --- neighbours ----------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>"


def nearest_by_hand(rows, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        score = (x @ x[i]) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[i]))
        score[ids == ids[i]] = -2
        out[int(ids[i])] = ids[np.lexsort((ids, -score))[:k]].tolist()
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 24))
    rows = [(i, (centres[rng.integers(40)] + 0.6 * rng.standard_normal(24)).astype(np.float32).tolist()) for i in range(30000)]
    got = neighbours.nearest_neighbours(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0).collect()
    want = nearest_by_hand(rows)
    found = {}
    for r in sorted(got):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert {len(v) for v in found.values()} == {5}
    assert np.mean([len(set(found[q]) & set(want[q])) / 5 for q in want]) >= 0.9
    assert sorted({r["rank"] for r in got}) == [1, 2, 3, 4, 5]


def test_partitions_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(7)
    x = neighbours._unit(rng.standard_normal((32, 16))[rng.integers(0, 32, 2000)] + 0.3 * rng.standard_normal((2000, 16)))
    near = neighbours.graph(x, 10)
    label = neighbours.partition(x, near, 8)
    sizes = np.bincount(label, minlength=8)
    assert sizes.max() <= 1.1 * 250 + 1 and sizes.min() >= 0.9 * 250 - 1
    assert (label[near] == label[:, None]).mean() > 0.7


def test_neighbour_ties_odd_vectors_and_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0], "q") for i in range(12)] + [(100, [2.0, 4.0], "q"), (150, [-1.0, 0.5], "q")]
    odd = [(200, None, "q"), (250, [0.0, 0.0], "q"), (300, [nan, 1.0], "q"), (350, [inf, 1.0], "q"), (400, [None, 1.0], "q"), (450, [], "q"), (500, [1.0], "q"), (None, [1.0, 2.0], "q")]
    df = spark.createDataFrame(rows + odd, f"{VECTORS}, part string")
    got = sorted(neighbours.nearest_neighbours(df, F.col("vec_id") % 50 == 0).collect())
    found = {q: [r["vec_id"] for r in got if r["query_id"] == q] for q in {r["query_id"] for r in got}}
    assert found == {0: [1, 2, 3, 4, 5], 100: [0, 1, 2, 3, 4], 150: [0, 1, 2, 3, 4]}
    assert all(r["score"] == pytest.approx(1.0, abs=1e-15) for r in got if r["query_id"] == 0)
    assert neighbours.nearest_neighbours(df.limit(0), F.lit(True)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], VECTORS)
    assert [tuple(r) for r in neighbours.nearest_neighbours(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 0.0)]
