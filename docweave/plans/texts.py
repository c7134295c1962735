"""Queries on texts, chunks and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions import text as fx
from docweave.operators import chunking, state
from docweave.tables import table

_INDEX_STOP = ", ".join(f"'{w}'" for w in fx.INDEX_STOPWORDS)
_KEY_STOP = ", ".join(f"'{w}'" for w in fx.KEYWORD_STOPWORDS)
#: SQL of the index tokens of a text column.
INDEX_TOKENS = (
    "list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), "
    f"lambda t: length(t) > 1 and t not in ({_INDEX_STOP}))"
)


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens of every document."""
    return table(spark, d, "documents").select("doc_id", fx.token_count("text").alias("tokens"))


TOKEN_COUNTS = "select doc_id, cast(case when coalesce(length(text), 0) = 0 then 0 else greatest(1, length(text) // 4) end as integer) as tokens from documents"


def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of every document with a text."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(fx.sentences("text")).alias("sentences"))


SENTENCE_COUNTS = "select doc_id, cast(len(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1))) as integer) as sentences from documents where text is not null"


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of every source document's content, and whether the stored one is right."""
    found = F.sha2("content", 256)
    docs = table(spark, d, "source_documents").where("content is not null")
    return docs.select("id", found.alias("sha256"), (F.lower("content_hash") == found).alias("stored_right")).distinct()


CONTENT_HASHES = "select distinct id, sha256(content) as sha256, lower(content_hash) = sha256(content) as stored_right from source_documents where content is not null"


def query_keys(spark: SparkSession, d: str) -> DataFrame:
    """Normal form and cache key of every asked query."""
    q = fx.normal_query("query")
    return table(spark, d, "query_results").select("query_id", q.alias("normal"), fx.cache_key("session_id", q, F.lit(5)).alias("cache_key")).distinct()


QUERY_KEYS = """
with n as (select distinct query_id, session_id, regexp_replace(regexp_replace(lower(query), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '^ | $', '', 'g') as normal from query_results)
select distinct query_id, normal, sha256(concat_ws(':', session_id, normal, '5')) as cache_key from n
"""


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Texts that several documents have: the first id and their number."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


EXACT_DUPLICATES = "select sha256(text) as sha256, min(doc_id) as first_id, count(*) as copies from documents where text is not null group by 1 having count(*) > 1"


def prefix_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Documents without those that begin like one with a smaller id (200 characters)."""
    docs = table(spark, d, "documents").where("text is not null")
    head = F.lower(F.trim(F.substring("text", 1, 200)))
    return docs.groupBy(F.sha2(head, 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


PREFIX_DISTINCT = "select min(doc_id) as doc_id, count(*) as copies from documents where text is not null group by lower(trim(substr(text, 1, 200), ' '))"


def keywords(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most frequent keywords of every document; ties by the word."""
    docs = table(spark, d, "documents").select("doc_id", fx.keyword_tokens("text").alias("words"))
    counts = docs.select("doc_id", F.size("words").alias("total"), F.explode("words").alias("word")).groupBy("doc_id", "total", "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "word"))
    return counts.withColumn("place", place).where("place <= 10").select("doc_id", "word", F.round(F.col("n") / F.col("total"), 9).alias("tf"), "place")


KEYWORDS = f"""
with w as (select doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{3,}}'), lambda t: t not in ({_KEY_STOP})) as words from documents),
e as (select doc_id, len(words) as total, unnest(words) as word from w),
c as (select doc_id, word, count(*) as n, any_value(total) as total from e group by doc_id, word),
r as (select *, row_number() over (partition by doc_id order by n desc, word) as place from c)
select doc_id, word, round(n / total, 9) as tf, cast(place as integer) as place from r where place <= 10
"""


def top_terms_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency of the 20 most frequent index terms per language label."""
    terms = table(spark, d, "documents").where("lang is not null").select("lang", F.explode(F.array_distinct(fx.index_tokens("text"))).alias("term"))
    counts = terms.groupBy("lang", "term").agg(F.count("*").alias("docs"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("docs"), "term"))
    return counts.withColumn("place", place).where("place <= 20")


TOP_TERMS_BY_LABEL = f"""
with e as (select lang, unnest(list_distinct({INDEX_TOKENS.format('text')})) as term from documents where lang is not null),
c as (select lang, term, count(*) as docs from e group by lang, term)
select lang, term, docs, cast(place as integer) as place from (select *, row_number() over (partition by lang order by docs desc, term) as place from c) where place <= 20
"""


def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    """Header sections of every document."""
    docs = table(spark, d, "documents").where("text is not null")
    found = chunking.markdown_sections(docs, "doc_id", "text")
    return found.select("doc_id", F.col("section_no").cast("int").alias("section_no"), "title", "level", "n_lines", F.md5("text").alias("md5"))


MARKDOWN_SECTIONS = """
with l as (select doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) as ls from documents where text is not null),
e as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as line_no from l),
m as (select *, regexp_extract(line, '^(#{1,6})[ \\t\\n\\x0B\\f\\r]+[^\\r\\n]+$', 1) as marks from e),
s as (select *, sum(case when marks <> '' then 1 else 0 end) over (partition by doc_id order by line_no) as section_no from m)
select doc_id, cast(section_no as integer) as section_no,
  trim(max(case when marks <> '' then regexp_extract(line, '^#{1,6}[ \\t\\n\\x0B\\f\\r]+([^\\r\\n]+)$', 1) end), ' ') as title,
  cast(max(length(marks)) as integer) as level, count(*) as n_lines, md5(string_agg(line, chr(10) order by line_no)) as md5
from s group by doc_id, section_no
"""


def table_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Runs of two or more table rows in documents."""
    return chunking.table_blocks(table(spark, d, "documents").where("text is not null"), "doc_id", "text")


TABLE_BLOCKS = """
with l as (select doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) as ls from documents where text is not null),
e as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as line_no from l),
r as (select *, line_no - row_number() over (partition by doc_id order by line_no) as island from e
  where length(line) - length(replace(line, '|', '')) >= 2 or length(line) - length(replace(line, chr(9), '')) >= 2
  or (len(regexp_extract_all(trim(line, ' '), '[^ \\t\\n\\x0B\\f\\r] {2,}')) >= 2 and len(list_filter(regexp_split_to_array(line, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) >= 3))
select doc_id, cast(min(line_no) as integer) as first_line, count(*) as n_rows from r group by doc_id, island having count(*) > 1
"""


def part_row_groups(spark: SparkSession, d: str) -> DataFrame:
    """Parts rendered as `column: value` rows, 50 per group, by brand."""
    found = chunking.row_groups(table(spark, d, "part"), "p_partkey", ["p_name", "p_brand", "p_type", "p_size"], within="p_brand")
    return found.select("p_brand", "group_no", "n_rows", F.md5("text").alias("md5"))


PART_ROW_GROUPS = """
with n as (select *, (row_number() over (partition by p_brand order by p_partkey) - 1) // 50 as group_no,
  concat_ws(' | ', 'p_name: ' || p_name, 'p_brand: ' || p_brand, 'p_type: ' || p_type, 'p_size: ' || p_size) as rendered from part),
g as (select p_brand, group_no, count(*) as n_rows, substr(string_agg(rendered, chr(10) order by p_partkey), 1, 25000) as text from n group by 1, 2)
select p_brand, cast(group_no as integer) as group_no, cast(n_rows as integer) as n_rows, md5(text) as md5 from g where length(text) > 20
"""


def file_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Chunk strategy of every source document by its name."""
    return table(spark, d, "source_documents").select("id", "name", chunking.strategy_of(F.col("name")).alias("strategy")).distinct()


FILE_STRATEGIES = (
    "select distinct id, name, case lower(regexp_extract(name, '(\\.[^.]*)$', 1)) "
    + " ".join(f"when '{s}' then '{v}'" for s, v in chunking.STRATEGIES.items())
    + " else 'semantic' end as strategy from source_documents"
)


def chunk_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Per strategy: chunks, wrong character counts, mean estimated tokens; each chunk once."""
    once = table(spark, d, "chunks").groupBy("chunk_id").agg(*(F.max(c).alias(c) for c in ("strategy", "text", "char_count")))
    wrong = F.coalesce(F.col("char_count") != F.length("text"), F.lit(True))
    return once.groupBy("strategy").agg(F.count("*").alias("chunks"), F.count_if(wrong).alias("wrong_counts"), F.round(F.avg(fx.token_count("text")), 6).alias("mean_tokens"))


CHUNK_STATISTICS = """
with o as (select chunk_id, max(strategy) as strategy, max(text) as text, max(char_count) as char_count from chunks group by chunk_id)
select strategy, count(*) as chunks, count(*) filter (coalesce(char_count <> length(text), true)) as wrong_counts,
  round(avg(case when coalesce(length(text), 0) = 0 then 0 else greatest(1, length(text) // 4) end), 6) as mean_tokens from o group by strategy
"""


def missing_from_index(spark: SparkSession, d: str) -> DataFrame:
    """Source documents whose hash is not in the hash index, in any case of letters."""
    docs = table(spark, d, "source_documents").where("hash is not null").select("id", F.lower("hash").alias("hash")).distinct()
    return state.without(docs, table(spark, d, "hash_index").select(F.lower("hash").alias("hash")), ["hash"])


MISSING_FROM_INDEX = "select distinct id, lower(hash) as hash from source_documents where hash is not null and lower(hash) not in (select lower(hash) from hash_index where hash is not null)"


def document_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Per file type of loaded source documents: number, pages, bytes; each id once, its latest row."""
    newest = state.latest(table(spark, d, "source_documents"), ["id"], [F.desc_nulls_last("loaded_at"), F.desc_nulls_last("batch_no")])
    loaded = newest.where("lower(status) in ('loaded', 'ready')")
    return loaded.groupBy("file_type").agg(F.count("*").alias("documents"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.sum("file_size").alias("bytes"), F.round(F.coalesce(F.avg("pages"), F.lit(0.0)), 6).alias("mean_pages"))


DOCUMENT_STATISTICS = """
with n as (select *, row_number() over (partition by id order by loaded_at desc nulls last, batch_no desc nulls last) as r from source_documents)
select file_type, count(*) as documents, cast(coalesce(sum(pages), 0) as bigint) as pages, cast(sum(file_size) as bigint) as bytes, round(coalesce(avg(pages), 0.0), 6) as mean_pages
from n where r = 1 and lower(status) in ('loaded', 'ready') group by file_type
"""

QUERIES = {
    "token_counts": (token_counts, TOKEN_COUNTS),
    "sentence_counts": (sentence_counts, SENTENCE_COUNTS),
    "content_hashes": (content_hashes, CONTENT_HASHES),
    "query_keys": (query_keys, QUERY_KEYS),
    "exact_duplicates": (exact_duplicates, EXACT_DUPLICATES),
    "prefix_distinct": (prefix_distinct, PREFIX_DISTINCT),
    "keywords": (keywords, KEYWORDS),
    "top_terms_by_label": (top_terms_by_label, TOP_TERMS_BY_LABEL),
    "markdown_sections": (markdown_sections, MARKDOWN_SECTIONS),
    "table_blocks": (table_blocks, TABLE_BLOCKS),
    "part_row_groups": (part_row_groups, PART_ROW_GROUPS),
    "file_strategies": (file_strategies, FILE_STRATEGIES),
    "chunk_statistics": (chunk_statistics, CHUNK_STATISTICS),
    "missing_from_index": (missing_from_index, MISSING_FROM_INDEX),
    "document_statistics": (document_statistics, DOCUMENT_STATISTICS),
}
