import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mixscore.llm.line_dedup import dedup_lines
from mixscore.llm.packing import Encoder, first_fit_decreasing, pack_documents
from mixscore.llm.queries import byte_bpe

LONG = "This line is long enough to count, it has over forty letters."
SCHEMA = "doc_id long, text string"


def lines_by_hand(rows, min_docs=5):
    """The contract, read literally."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(
        str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )
    found = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                found[key(line)].add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [len(found[key(x)]) >= min_docs and i != max(found[key(x)]) if key(x) in found else False for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out[i] = (len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_lines_equal_the_rule_read_literally(spark):
    random.seed(1)
    pool = [LONG, f"  {LONG.upper()}\t", "É" * 40, "é" * 40, "x" * 39, "y" * 40 + "\r", "", "short", "\x0b" + "z" * 41, "\xa0" + "w" * 40]
    rows = [(i, "\n".join(random.choices(pool, k=random.randint(0, 6)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, "\n".join([LONG] * 5000))]
    got = dedup_lines(spark.createDataFrame(rows, SCHEMA)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)
    )
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == lines_by_hand(rows)


def test_lines_keep_rows_and_columns(spark):
    rows = [(i, LONG, "a", 5 + i) for i in range(4)] + [(9, f"{LONG}\nown", None, 1), (9, f"{LONG}\nother", "b", 2), (None, LONG, "c", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, __drop int")
    got = dedup_lines(df)
    assert got.columns == ["doc_id", "text", "n_lines", "__drop", "n_lines_", "n_dropped"]
    # five different ids and the null one: 9 is the largest and keeps its lines in both of its rows
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"], r["__drop"]) for r in got.collect()) == sorted(
        [(-1, "", 3), *[(i, "", 5 + i) for i in range(4)], (9, f"{LONG}\nown", 1), (9, f"{LONG}\nother", 2)]
    )
    assert dedup_lines(df.limit(0)).count() == 0


def test_chunks_have_the_ids_of_the_whole_text():
    random.seed(2)
    own = Encoder(byte_bpe())
    alphabet = list(" \t\n\r\xa0 \x1cab'sté1²½,.!​中\U0001f600") + ["<|endoftext|>", "it's", "  ", "\n\n", " \n"]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 30))) for _ in range(5000)]
    texts += [" ".join(random.choices(alphabet, k=9)) for _ in range(3000)] + ["word " * 30000, "a" * 5000]
    want = [np.array(e.ids, "<u4").tobytes() for e in own._tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want


def first_fit_by_hand(lengths, capacity):
    room, where = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        j = next((j for j, r in enumerate(room) if r >= lengths[i]), len(room))
        if j == len(room):
            room.append(capacity)
        where[i] = (j, capacity - room[j])
        room[j] -= lengths[i]
    return [where[i] for i in range(len(lengths))]


@pytest.mark.parametrize("seed", range(4))
def test_the_tournament_tree_is_first_fit_decreasing(seed):
    lengths = np.random.default_rng(seed).integers(1, 101, 300)
    which, offset = first_fit_decreasing(lengths, 100)
    assert list(zip(which.tolist(), offset.tolist())) == first_fit_by_hand(lengths.tolist(), 100)


def test_packing_is_a_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "x y " * 9000), (None, "no id")], SCHEMA)
    rows = pack_documents(docs.unionByName(odd), byte_bpe(), docs_per_group=50).collect()
    own = Encoder(byte_bpe())
    texts = {r["doc_id"]: r["text"] for r in docs.unionByName(odd).collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 1 <= r["length"] <= 1024 and len(r["ids"]) == 4 * r["length"]
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == texts.keys()
    for doc, text in texts.items():
        own_pieces = sorted(pieces[doc], key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in own_pieces) == own.encode([text or ""])[0] + bytes(4)
        assert [r["start"] for r in own_pieces] == np.cumsum([0, *[r["length"] for r in own_pieces]])[:-1].tolist()
        assert {r["doc_tokens"] for r in own_pieces} == {sum(r["length"] for r in own_pieces)}
    for some in sequences.values():
        some.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in some] == np.cumsum([0, *[r["length"] for r in some]])[:-1].tolist()
        assert sum(r["length"] for r in some) <= 1024
    assert len(sequences) * 1024 < 1.1 * sum(r["length"] for r in rows)


def test_packing_repeated_rows_ties_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b c", 7)] * 3 + [(2, "a b c", 8)], "doc_id long, text string, ids int")
    rows = pack_documents(df, byte_bpe()).collect()
    assert Counter(r["doc_id"] for r in rows) == {1: 3, 2: 1}
    assert sorted(r["offset"] for r in rows) == [0, 4, 8, 12] and len({r["sequence_id"] for r in rows}) == 1
    assert pack_documents(df.limit(0), byte_bpe()).collect() == []
    assert not re.search("long", str(dict(df.dtypes)["ids"]))


def test_chunks_with_marks_are_put_together_from_runs_of_letters():
    from mixscore.llm.packing import Encoder
    from mixscore.llm.queries import byte_bpe

    encoder = Encoder(byte_bpe(), 4)  # forgets at once
    whole = []
    learn = encoder._learn_whole
    encoder._learn_whole = lambda chunks: (whole.extend(chunks), learn(chunks))
    texts = ["one, two; (three) ñandú.\nÉté", "one two. three, don't!", "", "a\0b \0", "x² one,", "ﬁn one. \U0001f600, Жук: 漢字"] * 3
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids == np.array(encoder._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
    assert not {"one", " two", " three", " ñandú", "Été"} & set(whole)


def test_letters_between_marks_are_runs_of_their_own():
    encoder = Encoder(byte_bpe())
    whole = []
    learn = encoder._learn_whole
    encoder._learn_whole = lambda pieces: (whole.extend(pieces), learn(pieces))
    texts = ["(one) two-three 4five6 «seven»", "(zwölf) Жук! (漢字)  x\t(y)", "don't 'tis x×(y)÷z α(β)γ é́(a)", "\n(a)\n\n(b) ", "x²y (ß)"]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids == np.array(encoder._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
    assert {"-", "(", "!"} <= set(whole)
    assert not [p for p in whole if re.search("one|two|three|five|zwölf|Жук|漢字", p)]


def test_columns_of_any_code_points_have_the_ids_of_the_whole_texts():
    random.seed(4)
    encoder = Encoder(byte_bpe(), 50)
    kinds = [(32, 128), (0x80, 0x300), (0x300, 0x2100), (0x3000, 0xD800), (0xE000, 0x11000), (0x4DB0, 0x4E10), (0x9FA0, 0x9FFF)]
    one = lambda: random.choice(["a", " ", "'", "\n", "(", chr(random.randrange(*random.choice(kinds)))])
    texts = ["".join(one() for _ in range(random.randint(0, 15))) for _ in range(20_000)]
    texts[5:8] = [None, "", " "]
    end = np.array([7], "<u4").tobytes()
    got = encoder.encode_column(pa.array(texts, pa.string()).slice(3), end).to_pylist()
    want = encoder._tokenizer.encode_batch([t or "" for t in texts[3:]], add_special_tokens=False)
    assert got == [np.array([*e.ids, 7], "<u4").tobytes() for e in want]
    assert encoder.encode([]) == []
