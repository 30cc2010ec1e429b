import glob
import os
import random
import re
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixscore.llm import near_dedup
from mixscore.llm.bytetext import shingle_sets, utf8, words
from mixscore.llm.components import components
from mixscore.llm.decontamination import contained_items, drop_contaminated
from mixscore.llm.near_dedup import drop_near_duplicates, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components_by_hand(rows, size):
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def edited(words_, share, rng):
    return [w if rng.random() > share else f"n{rng.random()}" for w in words_]


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(8, 150))
        rows += [" ".join(edited(base, rng.choice([0, 0.02, 0.05, 0.1]), rng)) for _ in range(rng.randint(1, 25))]
    rows += ["", "one", "one", "ONE", "one two", None, " \t\n", "x " * 30000, "x " * 29999]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("size", [2, 5])
def test_components_equal_all_pairs(spark, size):
    rows = corpus()
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=size).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == components_by_hand(rows, size)


def test_blocks_of_a_large_group_lose_no_link(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(edited(base, rng.choice([0.02, 0.05, 0.08]), rng))) for i in range(120)]
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 700)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == components_by_hand(rows, 2)


def test_matrix_and_merge_intersections_agree():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 500, rng.integers(1, 300)).astype(np.uint64)) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert near_dedup._common(sets, sets).tolist() == want


def test_pairs_at_the_limit_share_a_table():
    """200,000 pairs of sets at exactly 0.8: 9 misses are expected of 160 tables, 29 of 126."""
    n = 200_000
    own = np.random.default_rng(8).integers(0, 2**64, (n, 10), np.uint64)
    a, b = (near_dedup.partial_keys(list(own[:, columns])) for columns in ([*range(8), 8], [*range(8), 9]))
    same, cut = a == b, near_dedup.FIRST[0]
    missed = n - int((same[:, :cut].any(1) & same[:, cut:].any(1)).sum())
    assert near_dedup.FIRST[0] * near_dedup.SECOND[0] >= 160 and missed <= 18


def test_near_rows_without_id_repeats_and_nothing(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame(
        [(4, text, 1), (4, text, 2), (7, text, 3), (None, text, 4), (None, "alone here", 5), (9, None, 6)],
        "doc_id long, text string, node int",
    )
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(4, 4, True), (4, 4, True), (7, 4, False), (None, 4, False), (None, None, True), (9, 9, True)], key=str)
    assert sorted(r["node"] for r in drop_near_duplicates(df).collect()) == [1, 2, 4, 5, 6]
    assert near_duplicates(df.limit(0)).collect() == []


def test_near_duplicates_leave_no_shuffle_files(spark):
    folder = os.environ.get("SPARK_LOCAL_DIRS") or spark.sparkContext.getConf().get("spark.local.dir", "/tmp")
    files = lambda: set(glob.glob(f"{folder}/**/blockmgr-*/*/shuffle_*.data", recursive=True))
    before = files()
    assert spark.range(1000).repartition(3).groupBy().sum().first()[0] == 499500
    mine = {os.path.dirname(os.path.dirname(f)) for f in files() - before}
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert len(mine) == 1 and spark.conf.get(setting) == "false"
    before, rows = files(), corpus(4)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2)
    assert spark.conf.get(setting) == "false"
    left = lambda: {f for f in files() - before if os.path.dirname(os.path.dirname(f)) in mine}
    for _ in range(100):  # they are deleted in the background
        if not left():
            break
        time.sleep(0.2)
    assert not left()
    for _ in range(2):  # what is returned can be run again
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()} == components_by_hand(rows, 2)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(500, i) for i in range(300, 340)]
    links = [p if rng.random() < 0.5 else p[::-1] for p in chain + star] + [(7, 7), (101, 100)]
    rng.shuffle(links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 300 for i in [*range(300, 340), 500]}}


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    texts = ["A b\tc", "a  b c ", "ab c", "", None, "Éa b", "éa b", "x" * 3_000_000 + " y"]
    h, begin = words(*utf8(pa.array(texts)))
    by_text = [h[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])]
    assert by_text[0] == by_text[1] and len(by_text[0]) == 3 and by_text[2] != by_text[0]
    assert by_text[3] == by_text[4] == [] and by_text[5] != by_text[6] and len(by_text[7]) == 2
    sets = shingle_sets(h, begin, 2)
    assert [len(s) for s in sets] == [2, 2, 1, 0, 0, 1, 1, 1]


ITEMS = [(0, "The quick brown fox jumps over the lazy dog, twice a day."), (1, "too short here"), (2, None), (3, "")]


def contained_by_hand(docs, items, size=5):
    def grams(text):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}

    out = set()
    for d, t in docs:
        for i, u in items:
            own = grams(u)
            if own and 5 * len(own & grams(t)) >= 4 * len(own):
                out.add((d, i, len(own), len(own & grams(t))))
    return out


def test_contained_items_equal_all_pairs(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    items = ITEMS + [(10 + i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 60)))) for i in range(30)]
    items += [(90, items[5][1]), (91, items[6][1].upper() + "!")]
    docs = []
    for i in range(80):
        text = rng.choices(vocabulary, k=rng.randint(0, 400))
        for _ in range(rng.randint(0, 2)):
            passage = edited((rng.choice(items)[1] or "").split(), rng.choice([0, 0, 0.04, 0.2]), rng)
            at = rng.randint(0, len(text))
            text[at:at] = passage
        docs.append((i, rng.choice([" ", "\n", ", "]).join(text)))
    docs += [(200, None), (201, ""), (202, "The QUICK brown-fox\njumps over the lazy dog twice a day"), (203, "z " * 50000)]
    got = contained_items(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    found = {(r["doc_id"], r["item_id"], r["n_item"], r["n_found"]) for r in got}
    assert found == contained_by_hand(docs, items) and len(found) > 30
    assert (202, 0) in {f[:2] for f in found}


def test_contamination_nulls_repeats_and_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = spark.createDataFrame(
        [(1, f"so: {ITEMS[0][1]}", 1), (1, f"so: {ITEMS[0][1]}", 2), (None, ITEMS[0][1], 3), (5, "clean text of more than five words", 4), (6, None, 5)],
        "doc_id long, text string, __hit int",
    )
    assert {(r["doc_id"], r["item_id"]) for r in contained_items(df, items).collect()} == {(1, 0), (None, 0)}
    assert sorted(r["__hit"] for r in drop_contaminated(df, items).collect()) == [3, 4, 5]
    assert contained_items(df.limit(0), items).collect() == [] == contained_items(df, items.limit(0)).collect()


def test_contamination_runs_no_python(spark, sf_dir):
    from mixscore.llm.queries import op3_decontamination

    plan = op3_decontamination(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_prefixes_lose_no_link_between_sets():
    rng = np.random.default_rng(4)
    for percent in (80, 50):
        base = [np.unique(rng.integers(0, 60, rng.integers(1, 30))).astype(np.uint64) for _ in range(60)]
        sets = base + [np.unique(np.append(b[: max(1, len(b) - k % 3)], rng.integers(0, 90, k % 4)).astype(np.uint64)) for k, b in enumerate(base * 2)]
        nodes = rng.permutation(len(sets)).tolist()
        probe = rng.random(len(sets)) < 0.6
        found = near_dedup._link_rest(nodes, sets, probe, np.ones(len(sets), bool), near_dedup._Forest(), percent)
        got, want = near_dedup._Forest(), near_dedup._Forest()
        for _, a, b in found:
            got.join(a, b)
        for i, j in combinations(range(len(sets)), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            if (probe[i] or probe[j]) and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                want.join(nodes[i], nodes[j])
        assert [got.find(n) for n in nodes] == [want.find(n) for n in nodes] and len(found) > 20


def test_very_many_short_documents_that_share_a_shingle(spark):
    df = spark.range(6000, numPartitions=8).selectExpr("id AS doc_id", "concat('same words w', id % 5000) AS text")
    got = near_duplicates(df, words=2)
    small = got.where("component_id <> doc_id").collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in small) == [(5000 + i, i) for i in range(1000)]
    assert got.where("n_shingles = 2").count() == 6000
