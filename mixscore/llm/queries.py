"""The operators as registered queries, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixscore.llm.conversation_trie import branched, ordered_turns, prefix_trie
from mixscore.llm.decontamination import contained_items
from mixscore.llm.extraction import extract_main_text
from mixscore.llm.language_id import identify_languages
from mixscore.llm.license_scan import scan_licenses
from mixscore.llm.line_dedup import dedup_lines
from mixscore.llm.lm_score import score_texts
from mixscore.llm.near_dedup import near_duplicates
from mixscore.llm.neighbours import nearest_neighbours
from mixscore.llm.packing import pack_documents
from mixscore.llm.quality import judge_quality
from mixscore.llm.spelling import counted_runs, group_variants
from mixscore.llm.sql import OP12, OP13
from mixscore.llm.toxicity import score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def byte_bpe() -> str:
    """The path of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(_documents(spark, sf_dir))
    return docs.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(_documents(spark, sf_dir), byte_bpe())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_documents(spark, sf_dir))


def _crc_remainder(n: int) -> Column:
    """The remainder by ``n`` of the CRC-32 of the document's id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify_languages(docs, held_out=_crc_remainder(3) == 1)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_documents(spark, sf_dir), held_out=_crc_remainder(10) == 0)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), words=2)


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 50 == 0)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return score_toxicity(docs, _table(spark, sf_dir, "labels"), held_out=_crc_remainder(4) == 2)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = counted_runs(_documents(spark, sf_dir), least=6, spoil=199).where(F.col("n") >= 5)
    return group_variants(words, shortest=6)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = ordered_turns(_table(spark, sf_dir, "conversations"))
    kept = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    return prefix_trie(*branched(turns, block=5, most=8, kept=kept))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_packing": op2_packing,
    "op3_decontamination": op3_decontamination,
    "op4_license_scan": op4_license_scan,
    "op5_language_id": op5_language_id,
    "op6_quality": op6_quality,
    "op7_lm_score": op7_lm_score,
    "op8_near_dedup": op8_near_dedup,
    "op9_neighbours": op9_neighbours,
    "op10_html_extraction": op10_html_extraction,
    "op11_toxicity": op11_toxicity,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLE: dict[str, str] = {
    "op1_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents
        ), keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ), common AS (
            SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
            GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ), marked AS (
            SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS dropped
            FROM keyed k LEFT JOIN common c ON k.key = c.key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op3_decontamination": r"""
        WITH texts AS (
            SELECT doc_id AS id, 'd' AS kind, text FROM documents
            UNION ALL SELECT item_id, 'i', text FROM benchmark
        ), tokens AS (
            SELECT kind, id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w
            FROM texts WHERE text IS NOT NULL
        ), places AS (
            SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS i FROM tokens WHERE len(w) >= 5
        ), shingles AS (
            SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS shingle FROM places
        ), sizes AS (
            SELECT id, count(*) AS n_item FROM shingles WHERE kind = 'i' GROUP BY id
        )
        SELECT d.id AS doc_id, i.id AS item_id, max(s.n_item) AS n_item, count(*) AS n_found,
               count(*) / max(s.n_item) AS containment
        FROM shingles i JOIN shingles d ON d.kind = 'd' AND i.kind = 'i' AND d.shingle = i.shingle
        JOIN sizes s ON s.id = i.id
        GROUP BY d.id, i.id HAVING 5 * count(*) >= 4 * max(s.n_item)
    """,
    "op8_near_dedup": r"""
        WITH RECURSIVE tokens AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, w[i:i + 1] AS shingle
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM tokens) WHERE len(w) > 0
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
            FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM shared JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b
            WHERE 100 * common >= 80 * (sa.n + sb.n - common)
        ), reach(a, b) AS (
            SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), lowest AS (
            SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a
        )
        SELECT t.doc_id, coalesce(n, 0) AS n_shingles, least(t.doc_id, coalesce(low, t.doc_id)) AS component_id,
               t.doc_id <= coalesce(low, t.doc_id) AS kept
        FROM tokens t LEFT JOIN sizes s ON s.doc_id = t.doc_id LEFT JOIN lowest w ON w.doc_id = t.doc_id
    """,
    "op12_spelling_variants": OP12,
    "op13_conversation_trie": OP13,
}
