import random
from dataclasses import replace

import pytest
from conftest import plan_text
from pyspark.sql import functions as F

from mixscore.functions.lookup import (
    first_match,
    label_of,
    mixture_hits,
    mixture_profile,
    normalise_key,
    with_main_label,
)
from mixscore.plans import enrich, fit_profile_pca, score_rows
from mixscore.sources import dictionary as dictionary_module
from mixscore.sources.dictionary import FEATURES, SOLVENTS, DictionaryTable, PropertyDictionary, dictionary_from


def expected(text, dictionary):
    """Row-at-a-time statement of the lookup rules, for checking only."""
    text = text or "Unknown"
    found = []
    for piece in text.lower().split("/"):
        indexes = [i for i, k in enumerate(dictionary.keys) if k.lower() in piece]
        if indexes:
            found.append(min(indexes))
    whole = [k for k in dictionary.keys if k.lower() in text.lower()]
    rows = [dictionary.rows[i] for i in found] or [dictionary.rows[dictionary.default_index]]
    profile = [
        None if any(r[j] is None for r in rows) else sum(r[j] for r in rows) / len(rows)
        for j in range(len(dictionary.properties))
    ]
    return (whole[0] if whole else "Other"), sorted(found), profile


def lookup(spark, texts, dictionary):
    """(label, label again, matched parts, profile) per text."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    key = normalise_key(F.col("t"))
    lowered = with_main_label(df, key, dictionary, "label").withColumn("low", F.lower(key))
    matched = lowered.select(
        "id", "label", first_match("low", dictionary).alias("f"), mixture_hits("low", dictionary).alias("h")
    )
    out = matched.select(
        "id", "label", label_of("f", dictionary).alias("label2"), "f", "h",
        mixture_profile("f", "h", dictionary).alias("p"),
    )
    rows = []
    for _, label, again, first, hits, profile in out.orderBy("id").collect():
        if hits is None:
            hits = [] if first is None else [first]
        rows.append((label, again, hits, profile))
    return rows


@pytest.mark.parametrize(
    "text, parts, eps, label",
    [
        ("Water", 1, 80.1, "Water"),
        ("methanol", 1, 24.55, "Ethanol"),
        ("DMF/Water", 2, 59.175, "Water"),
        ("Ethyl acetate", 0, 80.1, "Other"),
        ("Water/Water/Ethanol", 3, 61.583333333333336, "Water"),
        ("Foo/DMF", 1, 38.25, "DMF"),
        ("a/b", 0, 80.1, "Other"),
        (None, 0, 80.1, "Other"),
        ("", 0, 80.1, "Other"),
        ("   ", 0, 80.1, "Other"),
        ("2-MeTHF", 1, 7.58, "THF"),
        ("Ethanol-water/DMF", 2, 59.175, "Water"),
        ("Ethanol/", 1, 24.55, "Ethanol"),
        ("/", 0, 80.1, "Other"),
        (" DMSO / ACETONE ", 2, 33.575, "DMSO"),
        ("Acetic_acid", 1, 6.2, "Acetic_acid"),
        ("Acetonitrile", 1, 37.5, "Acetonitrile"),
    ],
)
def test_edge_cases(spark, text, parts, eps, label):
    ((got, derived, hits, profile),) = lookup(spark, [text], SOLVENTS)
    assert (got, derived, len(hits)) == (label, label, parts)
    assert profile[SOLVENTS.properties.index("eps")] == pytest.approx(eps, abs=1e-12)


def test_random_texts_agree_with_the_rules(spark):
    rng = random.Random(7)
    pieces = list(SOLVENTS.keys) + ["water", "ETHANOL", "foo", "", " ", "meth", "Δ", "tHf", "Acet", "one"]
    texts = [
        "/".join("".join(rng.choices(pieces, k=rng.randint(0, 3))) for _ in range(rng.randint(1, 5)))
        for _ in range(400)
    ]
    for text, (label, derived, hits, profile) in zip(texts, lookup(spark, texts, SOLVENTS)):
        want_label, want_hits, want_profile = expected(text, SOLVENTS)
        assert (label, derived, hits) == (want_label, want_label, want_hits), text
        assert profile == pytest.approx(want_profile, abs=1e-12), text


def test_long_dictionaries_use_the_same_rules(spark):
    rng = random.Random(3)
    keys = [f"k{i}x" for i in range(150)]
    rng.shuffle(keys)
    big = PropertyDictionary.from_rows(("a", "b"), [(k, i, -i) for i, k in enumerate(keys)], keys[5])
    texts = ["/".join(rng.choices(keys + ["none", ""], k=rng.randint(1, 4))) + rng.choice(["", keys[0]]) for _ in range(100)]
    for text, (label, derived, hits, profile) in zip(texts, lookup(spark, texts, big)):
        want_label, want_hits, want_profile = expected(text, big)
        assert (label, derived, hits) == (want_label, want_label, want_hits), text
        assert profile == pytest.approx(want_profile), text


def test_missing_property_is_missing_for_the_mixture(spark):
    d = PropertyDictionary.from_rows(("a", "b"), [("one", 1, None), ("two", 3, float("nan")), ("six", 6, 6)], "six")
    rows = lookup(spark, ["one", "one/two", "two/six", "zzz"], d)
    assert [r[3] for r in rows] == [[1.0, None], [2.0, None], [4.5, None], [6.0, 6.0]]


def test_numbers_are_matched_as_text(spark):
    d = PropertyDictionary.from_rows(("a",), [("12", 1), ("3", 2)], "3")
    df = spark.createDataFrame([(312.5,), (None,), (float("nan"),)], "t double")
    labels = [r["l"] for r in with_main_label(df, normalise_key(F.col("t")), d, "l").collect()]
    assert labels == ["12", "Other", "Other"]


def test_null_index_never_wraps_around(spark):
    df = spark.createDataFrame([("toluene",)], "t string").withColumn("f", first_match("t", SOLVENTS))
    assert df.select("f", label_of("f", SOLVENTS)).first()[:] == (None, "Other")


def test_keys_with_quotes_and_backslashes(spark):
    d = PropertyDictionary.from_rows(("a",), [("O'x\\y", 1), ('"q"', 2), ("\\n", 3), ("50%", 4)], "50%")
    rows = lookup(spark, ["o'X\\y", 'a "Q" b', "x\\N", "new\nline", "50%/\\n"], d)
    assert [r[0] for r in rows] == ["O'x\\y", '"q"', "\\n", "Other", "\\n"]
    assert rows[4][2] == [2, 3]


def test_enrich_keeps_columns_and_rows(spark):
    df = spark.createDataFrame([(1, "DMF/Water", 5), (2, None, 6)], "row_id long, Solvent string, `odd (name)` int")
    out = enrich(df)
    assert out.columns == ["row_id", "Solvent", "odd (name)", "Solvent_Main", *SOLVENTS.properties]
    first, second = out.orderBy("row_id").collect()
    assert (first["Solvent_Main"], first["odd (name)"], first["hba"]) == ("Water", 5, 1.5)
    assert (second["Solvent_Main"], second["Solvent"], second["mw"]) == ("Other", None, 18.02)


@pytest.mark.parametrize(
    "rows, default",
    [
        ([("a", 1), ("a", 2)], "a"),
        ([("a/b", 1)], "a/b"),
        ([(" a", 1)], " a"),
        ([("", 1)], ""),
        ([("a", 1, 2)], "a"),
        ([("a", 1)], "b"),
    ],
)
def test_bad_dictionaries_are_refused(rows, default):
    with pytest.raises(ValueError):
        PropertyDictionary.from_rows(("p",), rows, default)


def long_dictionary(rng, n, match="first"):
    """Keys that contain, overlap and begin one another, in a random order."""
    keys = set()
    while len(keys) < n:
        keys.add("".join(rng.choices("abA é", k=rng.randint(1, 7))).strip() or "a")
    keys = rng.sample(sorted(keys), n)
    rows = [(k, i, None if i % 97 == 0 else -i) for i, k in enumerate(keys)]
    return PropertyDictionary.from_rows(("a", "b"), rows, keys[3], match)


def odd_texts(rng, keys, n):
    pick = lambda: rng.choice([*rng.sample(keys, 5), "".join(rng.choices("abcA é", k=rng.randint(0, 9)))])
    return ["/".join(pick() for _ in range(rng.choice([1, 1, 2, 4]))) for _ in range(n)] + ["", None, "/", "//", "zz", "ab" * 5000]


def test_the_automaton_gives_what_the_expressions_give(spark):
    rng = random.Random(8)
    d = long_dictionary(rng, 700)
    texts = odd_texts(rng, d.keys, 300)
    for text, (label, again, hits, profile) in zip(texts, lookup(spark, texts, d)):
        want_label, want_hits, want_profile = expected(text, d)
        assert (label, again, hits) == (want_label, want_label, want_hits), text
        assert profile == pytest.approx(want_profile), text


def test_one_pass_of_the_automaton_serves_label_and_parts(spark):
    d = long_dictionary(random.Random(1), 400)
    df = spark.createDataFrame([(1, "a/b")], "row_id long, Solvent string")
    plan = plan_text(enrich(df, d))
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
    assert "Python" not in plan_text(enrich(df))


def longest_by_hand(text, dictionary):
    """Leftmost-longest occurrences from left to right; of those the first key in dictionary order, part by part."""
    index = {}
    for i, k in enumerate(dictionary.keys):
        index.setdefault(k.lower(), i)
    found = []
    for part in (text or "Unknown").lower().split("/"):
        at, here = 0, []
        while at < len(part):
            fits = [k for k in index if part.startswith(k, at)]
            if fits:
                best = max(fits, key=len)
                here.append(index[best])
                at += len(best)
            else:
                at += 1
        found += [min(here)] if here else []
    return found


@pytest.mark.parametrize("n", [8, 300])
def test_longest_match_equals_a_scan_by_hand(spark, n):
    rng = random.Random(n)
    d = long_dictionary(rng, n, "longest")
    texts = odd_texts(rng, d.keys, 200)
    for text, (label, again, hits, _) in zip(texts, lookup(spark, texts, d)):
        want = longest_by_hand(text, d)
        assert hits == sorted(want), text
        assert label == again == (d.keys[min(want)] if want else "Other"), text


def test_methanol_under_the_option_only(spark):
    longest = replace(SOLVENTS, match="longest")
    assert [lookup(spark, [t], longest)[0][0] for t in ("methanol", "methanol, ethanol", "2-MeTHF")] == ["Methanol", "Ethanol", "THF"]
    assert lookup(spark, ["methanol"], SOLVENTS)[0][0] == "Ethanol"
    with pytest.raises(ValueError):
        replace(SOLVENTS, match="shortest")


def test_a_dictionary_from_a_table(spark, monkeypatch):
    table = spark.createDataFrame([(2, "b", 1.0, None), (1, "a", 2.0, 3.0)], "ord int, key string, p double, q double")
    d = PropertyDictionary.from_frame(table, "b", match="longest")
    assert (d.properties, d.keys, d.rows, d.match) == (("p", "q"), ("a", "b"), ((2.0, 3.0), (1.0, None)), "longest")
    monkeypatch.setattr(dictionary_module, "MOST_KEYS", 1)
    with pytest.raises(ValueError, match="at most 1 keys"):
        PropertyDictionary.from_frame(table, "b")


@pytest.mark.parametrize("n", [5, 700])
def test_a_dictionary_table_gives_what_the_expressions_give(spark, monkeypatch, n):
    rng = random.Random(n)
    d = long_dictionary(rng, n)
    more = [("abé a long key of over thirty-two letters, and its end", 1.5, -2.5), ("B" * 300 + "a", 2.5, float("nan"))]
    d = PropertyDictionary.from_rows(d.properties, [*((k, *r) for k, r in zip(d.keys, d.rows)), *more], d.default_key)
    texts = [*odd_texts(rng, d.keys, 300), "x" * 250 + more[0][0].upper() + "/" + "b" * 700 + "A", "Unknown", more[1][0]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, Solvent string")
    keys = [(i, k, *r) for i, (k, r) in enumerate(zip(d.keys, d.rows))]
    table = spark.createDataFrame(keys, "ord int, key string, a double, b double")
    want = {r["row_id"]: r for r in enrich(df, d).collect()}
    monkeypatch.setattr(dictionary_module, "MOST_KEYS", 3)
    beyond = dictionary_from(table, d.default_key)
    assert isinstance(beyond, DictionaryTable)
    got = enrich(df, beyond)
    assert got.columns == ["row_id", "Solvent", "Solvent_Main", "a", "b"]
    assert {r["row_id"]: r for r in got.collect()} == want


def test_more_keys_than_are_collected_are_looked_up(spark, sf_dir, monkeypatch):
    from mixscore_checks.queries import long_dictionary as query

    want = sorted(query(spark, sf_dir).collect())
    monkeypatch.setattr(dictionary_module, "MOST_KEYS", 199)
    assert sorted(query(spark, sf_dir).collect()) == want


@pytest.mark.parametrize("keys", [["a", "a"], ["a", "b/c"], ["a", " b"], ["a", "b\u2003"], ["a", ""], ["a", None], ["b", "c"]])
def test_bad_dictionary_tables_are_refused(spark, keys):
    table = spark.createDataFrame([(i, k, 1.0) for i, k in enumerate(keys)], "ord int, key string, p double")
    df = spark.createDataFrame([("a",)], "Solvent string")
    with pytest.raises(ValueError):
        enrich(df, DictionaryTable(table, "a"))


def test_a_long_dictionary_fits_and_scores(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS row_id", "p_name || p_partkey AS Solvent")
    d = PropertyDictionary.from_rows(
        FEATURES, [(f"k{i}" if i % 2 else f"g{i}", *((i * (j + 3)) % 17 + j for j in range(len(FEATURES)))) for i in range(300)], "g0"
    )
    texts = rows.selectExpr("row_id", "concat('k', row_id % 50 * 2 + 1, '/g', row_id % 30 * 2) AS Solvent")
    model = fit_profile_pca(texts, d, search=False)
    short = PropertyDictionary.from_rows(FEATURES, [(k, *r) for k, r in zip(d.keys[:200], d.rows)], "g0")
    other = fit_profile_pca(texts, short, search=False)
    assert model.fit.eigenvalues == pytest.approx(other.fit.eigenvalues)
    got = {r["row_id"]: r["Solvent_PC1"] for r in score_rows(texts, model).collect()}
    want = {r["row_id"]: r["Solvent_PC1"] for r in score_rows(texts, other).collect()}
    assert got == pytest.approx(want)
    model.release()
    other.release()
