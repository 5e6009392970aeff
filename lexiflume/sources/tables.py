"""Tables by name, and the chunk view that retrieval works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_chunks(documents: DataFrame) -> DataFrame:
    """Documents as chunks with legal metadata derived from their ids."""
    return documents.selectExpr(
        "doc_id",
        "cast(doc_id as string) as chunk_id",
        "text as content",
        "lang",
        "source",
        "concat('Chương ', doc_id % 9 + 1) as chapter",
        "case when doc_id % 4 = 0 then null when doc_id % 4 = 1 then '' else concat('Mục ', doc_id % 5 + 1) end as section",
        "concat('Điều ', doc_id % 50 + 1, '. ', lang) as article",
        "cast(doc_id % 50 + 1 as int) as article_no",
        "cast(doc_id % 9 + 1 as int) as chapter_no",
        "cast(case when doc_id % 4 < 2 then null else doc_id % 5 + 1 end as int) as section_no",
        "array_distinct(array(cast(doc_id % 7 + 1 as int), cast(doc_id % 3 + 1 as int))) as clause_nos",
        "array_remove(array_distinct(array(cast(doc_id * 7 % 50 + 1 as int), cast(doc_id * 3 % 50 + 1 as int))), cast(doc_id % 50 + 1 as int)) as ref_article_nos",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_chunks(table(spark, sf_dir, "documents"))


#: The same view for DuckDB, as a common table expression.
CHUNKS = """chunks as (select doc_id, cast(doc_id as varchar) as chunk_id, text as content, lang, source,
    'Chương ' || (doc_id % 9 + 1) as chapter,
    case when doc_id % 4 = 0 then null when doc_id % 4 = 1 then '' else 'Mục ' || (doc_id % 5 + 1) end as section,
    'Điều ' || (doc_id % 50 + 1) || '. ' || lang as article,
    cast(doc_id % 50 + 1 as int) as article_no, cast(doc_id % 9 + 1 as int) as chapter_no,
    cast(case when doc_id % 4 < 2 then null else doc_id % 5 + 1 end as int) as section_no,
    case when doc_id % 7 = doc_id % 3 then [cast(doc_id % 7 + 1 as int)] else [cast(doc_id % 7 + 1 as int), cast(doc_id % 3 + 1 as int)] end as clause_nos,
    list_filter(case when doc_id * 7 % 50 = doc_id * 3 % 50 then [cast(doc_id * 7 % 50 + 1 as int)] else [cast(doc_id * 7 % 50 + 1 as int), cast(doc_id * 3 % 50 + 1 as int)] end, lambda x: x <> doc_id % 50 + 1) as ref_article_nos
    from documents)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries with legal filters and ground truth derived from their ids."""
    return table(spark, sf_dir, "benchmark").selectExpr(
        "item_id as query_id",
        "text as query",
        "cast(item_id % 50 + 1 as int) as gt_article",
        "case when item_id % 3 = 0 then array() else array(cast(item_id % 7 + 1 as int)) end as gt_clauses",
        "case item_id % 4 when 0 then 'factual' when 1 then 'listing' when 2 then 'definition' end as question_type",
    )


QUESTIONS = """questions as (select item_id as query_id, text as query, cast(item_id % 50 + 1 as int) as gt_article,
    case when item_id % 3 = 0 then cast([] as int[]) else [cast(item_id % 7 + 1 as int)] end as gt_clauses,
    case item_id % 4 when 0 then 'factual' when 1 then 'listing' when 2 then 'definition' end as question_type from benchmark)"""


#: Filter fields of an index over the chunk view, by their columns.
FIELDS = {"article_no": "article_no", "chapter_no": "chapter_no", "section_no": "section_no", "clause_nos": "clause_nos", "lang": "lang"}


def indexed(documents: DataFrame) -> DataFrame:
    """The chunk view with the text that is indexed."""
    return as_chunks(documents).withColumn("text", F.col("content"))


_ASKED = """case item_id % 8 when 0 then concat(text, ' (Điều ', item_id % 60 + 1, ')') when 1 then concat('chương ', item_id % 9 + 1, ', article ', item_id % 50 + 1, ': ', text) when 2 then concat(text, ' Section ', item_id % 5 + 1)
    when 3 then case when item_id % 16 = 3 then ' ' else '?! ...' end else text end"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of which some name an article, chapter or section (not all of these exist), and some hold no word."""
    return questions(spark, sf_dir).drop("query").join(table(spark, sf_dir, "benchmark").selectExpr("item_id as query_id", f"{_ASKED} as query"), "query_id")


#: The same for DuckDB, with the filters that the texts name.
ASKED = f"""asked_questions as (select item_id as query_id, {_ASKED} as query, case item_id % 8 when 0 then item_id % 60 + 1 when 1 then item_id % 50 + 1 end as f_article, case when item_id % 8 = 1 then item_id % 9 + 1 end as f_chapter,
    case when item_id % 8 = 2 then item_id % 5 + 1 end as f_section, item_id % 8 <> 3 as has_words from benchmark)"""
