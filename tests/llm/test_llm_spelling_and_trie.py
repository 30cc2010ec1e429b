import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mixscore.llm import spelling
from mixscore.llm.common import checkpointed
from mixscore.llm.conversation_trie import branched, ordered_turns, prefix_trie
from mixscore.llm.spelling import Grams, counted_runs, group_variants, near_words

DOCS = "doc_id long, text string"
TURNS = "conv_id long, turn long, role string, text string"


def vocabulary(n, seed=4, letters="abcé", least=6, most=12):
    rng = random.Random(seed)
    syllables = ["".join(rng.choices(letters, k=rng.randint(1, 3))) for _ in range(12)]
    words = set()
    while len(words) < n:
        w = "".join(rng.choices(syllables, k=rng.randint(3, 6)))[:most]
        if len(w) >= least:
            words.add(w)
    return sorted(words)


def near_by_hand(words):
    have, letters, out = set(words), sorted(set("".join(words))), set()
    for w in words:
        around = {w[:i] + w[i + 1 :] for i in range(len(w))}
        around |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        out |= {(min(w, v), max(w, v)) for v in around & have if v != w}
    return out


@pytest.mark.parametrize("rare, short_list", [(0, 32), (3, 1), (10**9, 32)])
def test_near_words_equal_brute_force(spark, monkeypatch, rare, short_list):
    monkeypatch.setattr(spelling, "SHORT_LIST", short_list)
    words = vocabulary(600) + ["x" * 300, "x" * 301, "y" + "x" * 300, "zzzzzz", "zzzzzzz"]
    frame = checkpointed(spark.createDataFrame([(w,) for w in words], "word string"))
    got = {(r["a"], r["b"]) for r in near_words(frame, 6, rare).collect()}
    want = near_by_hand([w for w in words if len(w) < 100])
    want |= {("x" * 300, "x" * 301), ("x" * 300, "y" + "x" * 300), ("x" * 301, "y" + "x" * 300)}
    assert len(want) > 100 and got == want


@pytest.mark.parametrize("rare", [0, 5, 50])
def test_an_edit_changes_at_most_the_affected_grams(rare):
    rng, words = random.Random(5), vocabulary(300)
    frequency = np.zeros(spelling.BUCKETS, np.int64)
    bucket, n = Grams(pa.array(words), 5).counts()
    frequency[bucket.astype(np.int64)] = n

    def grams(w):
        one = Grams(pa.array([w]), 5)
        size, h, _ = one.decompose(frequency, rare)
        return Counter(h.tolist()), int(one.affected(size)[0]), size

    for w in words:
        i, c = rng.randrange(len(w)), rng.choice("abcé")
        mine, bound, size = grams(w)
        spans = [sum(p <= i <= p + s - 1 for p, s in enumerate(size)) for i in range(len(w) + 1)]
        assert bound == max(spans) < len(w)
        for v in (w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:], w + c):
            other, _, _ = grams(v)
            assert sum((mine - other).values()) <= bound


def test_runs_are_spoilt_and_counted_as_told(spark):
    rows = [(1, "Straße Straße, ÉTÉTÉT x etetet\nabcdefg"), (2, None), (3, ""), (None, "abcdefg"), (4, "abcdefg abcdefg " * 4000), (4, "÷×÷×÷×")]
    rows += [(i, "abcdefg") for i in range(5, 400)]
    want = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6}
    docs = spark.createDataFrame([(*r, 7) for r in rows], DOCS + ", word int")
    got = {r["word"]: r["n"] for r in counted_runs(docs, 6, 199).collect()}
    assert got == want and any(len(w) == 6 and w != "straße" for w in got)
    plain = {r["word"]: r["n"] for r in counted_runs(docs, 6).collect()}
    assert plain["abcdefg"] == 2 + 8000 + 395


def test_forms_chains_and_defined_cases(spark):
    rows = [("abcdef", 1000), ("abcdeg", 100), ("abcdhg", 10), ("abcihg", 2), ("abcdxx", 1000), ("abcdex", 200)]
    rows += [("abcdfx", 200), ("short", 9), (None, 9), ("nnnnnn", None), ("lonely", 5)]
    got = {r["word"]: r for r in group_variants(spark.createDataFrame(rows, "word string, n int"), 6).collect()}
    assert set(got) == {"abcdef", "abcdeg", "abcdhg", "abcihg", "abcdxx", "abcdex", "abcdfx", "lonely"}
    chain = [(got[w]["form"], got[w]["root"], got[w]["n_near"], got[w]["form_n"]) for w in ("abcdef", "abcdeg", "abcdhg", "abcihg")]
    assert chain == [(None, "abcdef", 2, None), ("abcdef", "abcdef", 3, 1000), ("abcdeg", "abcdef", 2, 100), ("abcdhg", "abcdef", 1, 10)]
    # two near words with a thousand each: the first in code-point order
    assert (got["abcdex"]["form"], got["abcdex"]["form_n"]) == ("abcdef", 1000)
    assert tuple(got["lonely"]) == ("lonely", None, "lonely", 5, 0, None)
    assert group_variants(spark.createDataFrame([], "word string, n int"), 6).collect() == []


def trie_by_hand(sequences):
    """The nodes of {conv_id: turns}; a turn ends with its text."""
    members = defaultdict(list)
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][-1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(sequences[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def rebuilt_by_hand(rows, block=5, most=9):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    out = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % most
        out[c] = own.get(c - c % block, [])[:h] + seq[h:]
    return out


def conversations(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(2000), n):
        length = rng.choice([1, 1, 2, 3, 5, 8, 12, 25])
        text = (lambda t: "hello é") if rng.random() < 0.4 else (lambda t: rng.choice(["a", "bé", "ccc"]))
        rows += [(c, t, "user" if t % 2 else None, text(t)) for t in range(length)]
    rows += [(5000, t, "user", f"x{t}" if t == 60 else "same") for t in range(70)]
    rows += [(5000 + i, t, "user", f"y{i}" if t == 40 + i else "same") for i in (5, 10, 15) for t in range(60)]
    rows += [(c, t, "user", "copy") for c in range(7000, 7200) for t in range(4)]
    rows += [(9000, None, "user", "first"), (9000, 3, None, None), (9000, 3, None, None), (9000, None, "a", None), (9003, 1, "", "")]
    rows += [(None, 1, "user", "nobody"), (9990, 0, "user", "w" * 200_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("container", [40, 10**6])
def test_trie_equals_brute_force(spark, container):
    rows = conversations(6)
    frame = spark.createDataFrame([(*r, 1) for r in rows], TURNS + ", pos int").repartition(6)
    kept = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    turns, convs = branched(ordered_turns(frame), 5, 8, kept)
    want = rebuilt_by_hand(rows)
    assert {(r["conv_id"], r["len"]) for r in convs.collect()} == {(c, len(s)) for c, s in want.items()}
    assert any(not s for s in want.values())
    got = sorted(repr(tuple(r)) for r in prefix_trie(turns, convs, container).collect())
    assert got == trie_by_hand(want)


def test_trie_of_plain_conversations_and_of_nothing(spark):
    rows = [(-7, 1, "u", "a"), (3, 1, "u", "a"), (3, 2, "u", "b")]
    frame = spark.createDataFrame(rows, TURNS)
    turns = checkpointed(ordered_turns(frame))
    convs = checkpointed(turns.groupBy("conv_id").agg(F.max("pos").alias("len")))
    got = sorted(repr(tuple(r)) for r in prefix_trie(turns, convs).collect())
    assert got == trie_by_hand({-7: [("u", "a")], 3: [("u", "a"), ("u", "b")]})
    assert prefix_trie(turns.limit(0), convs.limit(0)).collect() == []
    assert ordered_turns(frame.limit(0)).collect() == []
    alone = spark.createDataFrame([(4, 0), (5, 0)], "conv_id long, len long")
    root = prefix_trie(turns.limit(0), alone).collect()
    assert [tuple(r)[:7] for r in root] == [(4, 0, None, 2, 0, 1, 0)]
    assert root[0]["ends_sha256"] == hashlib.sha256(b"4,5").hexdigest()


def test_turns_are_ranked_across_ranges(spark):
    rows = [(1, t, "u", str(t)) for t in range(5000)] + [(2, t, "u", "x") for t in range(3)] + [(0, 1, "u", "x")]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, TURNS).repartition(7)
    got = ordered_turns(frame).collect()
    assert sorted((r["conv_id"], r["pos"]) for r in got) == sorted((c, t + 1 - (c == 0)) for c, t, _, _ in rows)
