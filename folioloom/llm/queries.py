"""Queries of this subpackage, and the SQL that DuckDB answers the same questions with where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm import equal_looking, mixing, mojibake, names, sentences, split, survivor, tokenize
from folioloom.session import table


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    tables = {"script_segments": (table(spark, d, "script_segments"), "seg_key"), "chapters": (table(spark, d, "chapters"), "chapter_id")}
    return split.split_long(split.limited(tables, table(spark, d, "split_limits")), ["tbl", "row_key"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("piece_no = 0").select("tbl", "row_key")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.cast_survivors(table(spark, d, "cast_members"), table(spark, d, "profile_trust"))


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivor.surviving_records(table(spark, d, "cast_members"), table(spark, d, "profile_trust"))


def p2_by_weight(spark: SparkSession, d: str) -> DataFrame:
    return survivor.cast_by_weight(table(spark, d, "cast_members"), table(spark, d, "profile_trust"))


def p3_sentences(spark: SparkSession, d: str) -> DataFrame:
    chapters = table(spark, d, "chapters").select(F.lit("chapters").alias("tbl"), F.col("chapter_id").alias("row_key"), "text")
    segments = table(spark, d, "script_segments").select(F.lit("script_segments").alias("tbl"), F.col("seg_key").alias("row_key"), "text")
    texts = chapters.unionByName(segments)
    return sentences.sentences(texts, ["tbl", "row_key"], heading=F.col("tbl") == "chapters")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_sentences(spark, d).select("tbl", "row_key", "start_pos")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_person_pairs(table(spark, d, "cast_members"))


def p4_persons(spark: SparkSession, d: str) -> DataFrame:
    return names.same_persons(table(spark, d, "cast_members"))


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        ("script_segments", table(spark, d, "script_segments"), "seg_key", "text"),
        ("cast_members", table(spark, d, "cast_members"), "entry_id", "name"),
        ("pronunciations", table(spark, d, "pronunciations"), "pron_id", "name"),
        ("pronunciations", table(spark, d, "pronunciations"), "pron_id", "respelling"),
    ]
    values = equal_looking.book_values(parts, table(spark, d, "books"))
    return equal_looking.with_canonical(values, ["tbl", "row_key", "field"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_canonical(spark, d).select("tbl", "row_key").distinct()


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_documents(table(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return mix.records().withColumnRenamed("key", "doc_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets")).shares()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.find_garbled(table(spark, d, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.find_garbled(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_survivors, p2_by_weight, p3_found, p3_sentences, p4_found, p4_persons, p5_found, p5_canonical, p6_ids, p7_mix, p7_shares, p8_found, p8_restored)
}

ORACLE: dict[str, str] = {
    "p1_found": """
        SELECT 'script_segments' AS tbl, seg_key AS row_key FROM script_segments
        WHERE length(text) > (SELECT max_chars FROM split_limits WHERE tbl = 'script_segments')
        UNION ALL
        SELECT 'chapters', chapter_id FROM chapters
        WHERE length(text) > (SELECT max_chars FROM split_limits WHERE tbl = 'chapters')
    """,
    "p2_found": """
        WITH said AS (
            SELECT c.book_id, c.id, c.entry_id, c.updated_at, coalesce(t.trust, -1) AS trust,
                len(list_distinct(list_filter(list_transform(coalesce(aliases, []), lambda x: trim(x)),
                    lambda x: x IS NOT NULL AND lower(x) NOT IN ('', 'none', 'unknown', 'not stated', 'n/a', 'na', 'null', '-', '?')))) AS aliases_n,
                len(list_filter(list_transform(coalesce(evidence, []), lambda x: trim(regexp_replace(x, '^\\s*ch\\d+:\\s*', ''))),
                    lambda x: x IS NOT NULL AND lower(x) NOT IN ('', 'none', 'unknown', 'not stated', 'n/a', 'na', 'null', '-', '?'))) AS evidence_n,
                len(list_filter(map_values(coalesce(notes, MAP {})), lambda v: len(list_filter(coalesce(v, []),
                    lambda x: x IS NOT NULL AND lower(trim(x)) NOT IN ('', 'none', 'unknown', 'not stated', 'n/a', 'na', 'null', '-', '?'))) > 0)) AS notes_n,
                CASE WHEN json_valid(persona) AND json_type(CASE WHEN json_valid(persona) THEN persona END) = 'OBJECT'
                    THEN len(list_filter(json_extract_string(persona, '$.*'), lambda x: x IS NOT NULL
                        AND lower(trim(x)) NOT IN ('', 'none', 'unknown', 'not stated', 'n/a', 'na', 'null', '-', '?'))) ELSE 0 END AS persona_n
            FROM cast_members c LEFT JOIN profile_trust t ON c.profile = t.profile
            WHERE (c.book_id, c.id) IN (SELECT (book_id, id) FROM cast_members GROUP BY book_id, id HAVING count(*) > 1)
        ), fields AS (
            SELECT book_id, id, 'aliases' AS field, entry_id, updated_at, aliases_n AS score FROM said WHERE aliases_n > 0
            UNION ALL SELECT book_id, id, 'evidence', entry_id, updated_at, 0 FROM said WHERE evidence_n > 0
            UNION ALL SELECT book_id, id, 'notes', entry_id, updated_at, notes_n FROM said WHERE notes_n > 0
            UNION ALL SELECT book_id, id, 'persona', entry_id, updated_at, trust FROM said WHERE persona_n > 0
        )
        SELECT book_id, id, field, entry_id FROM fields
        QUALIFY row_number() OVER (PARTITION BY book_id, id, field ORDER BY score DESC, updated_at DESC, entry_id DESC) = 1
    """,
}
