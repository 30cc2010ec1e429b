import pytest

import __spark_entry__ as contract
import corpus_pipeline
from mixscore.llm.queries import ORACLE, QUERIES
from mixscore_checks.compare import connect

CONTRACTS = {
    "op1_line_dedup": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
    "op2_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op5_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op7_lm_score": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op8_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op9_neighbours": {"query_id", "rank", "vec_id", "score"},
    "op10_html_extraction": {"page_id", "url", "text", "n_chars"},
    "op11_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op12_spelling_variants": {"word", "form", "root", "n", "n_near", "form_n"},
    "op13_conversation_trie": {
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    },
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = connect(sf_dir)
    result = con.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    want = sorted(result.fetchall(), key=repr)
    got = sorted((tuple(r) for r in QUERIES[name](spark, sf_dir).select(*columns).collect()), key=repr)
    con.close()
    assert got == want


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_columns_of_the_contracts(spark, sf_dir, name):
    assert CONTRACTS[name] <= set(QUERIES[name](spark, sf_dir).columns)


def test_thirteen_operators_and_the_pipeline_are_registered():
    names = contract.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and set(ORACLE) <= set(contract.oracle_sql())


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Every stage's result for the documents and some odd rows with an extra column."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    passage = benchmark.orderBy("item_id").first()["text"]
    good = docs.where("doc_id = 1").first()["text"]
    odd = spark.createDataFrame(
        [(9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, f"{good} {passage}", "en", "s", 1), (9003, good, "en", "s", 2), (None, good + " extra", "en", "s", 3), (9004, good.upper() + " !!" * 80, "en", None, 4)],
        docs.schema,
    )
    out, current = {"input": docs.unionByName(odd).collect()}, docs.unionByName(odd).coalesce(2)
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, current, sf_dir)
        assert name == "packing" or result.columns == docs.columns
        out[name] = result.collect()
        current = spark.createDataFrame(out[name], result.schema)
    return out, passage


def test_each_stage_takes_effect_on_what_the_last_kept(stages):
    out, passage = stages
    ids = {name: {r["doc_id"] for r in rows} for name, rows in out.items()}
    assert 9004 in ids["input"] - ids["quality"]
    assert {9000, 9001, 9003, None} <= ids["quality"]
    assert ids["line_dedup"] == ids["quality"]
    assert 9003 in ids["line_dedup"] - ids["near_dedup"]
    assert 9002 in ids["line_dedup"] - ids["decontamination"]
    assert all(passage not in (r["text"] or "") for r in out["decontamination"])
    assert ids["packing"] == ids["decontamination"]
    lengths = {r["doc_id"]: r["n_chars"] for r in out["line_dedup"] if r["text"]}
    before = {r["doc_id"]: r for r in out["quality"]}
    changed = [r for r in out["line_dedup"] if r["text"] and r["text"] != before[r["doc_id"]]["text"]]
    assert all(lengths[r["doc_id"]] == len(r["text"]) for r in changed)


def test_the_pipeline_runs_and_takes_nothing(spark, sf_dir, stages):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.count() > 100
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        result = stage(spark, empty, sf_dir)
        assert result.collect() == []
        empty = result if result.columns == empty.columns else empty
