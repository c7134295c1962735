"""The registered queries of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import history, langs, leaks, neardups, pieces, scans, tokens, vectors
from docweave.session import staged
from docweave.tables import table


def p1_defects(spark: SparkSession, d: str) -> DataFrame:
    """Every defect of every line, with what is read there and what it should be."""
    ids, _, found = scans.find(table(spark, d, "source_documents"))
    return found.join(ids, "text_key").select("id", "line_no", "kind", "seen", "fixed")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are furniture, end in a hyphenated word or hold a misread word."""
    ids, _, found = scans.find(table(spark, d, "source_documents"))
    return found.select("text_key", "line_no", "kind").distinct().join(ids, "text_key").select("id", "line_no", "kind")


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every source document as continuous paragraphs."""
    return scans.repair(table(spark, d, "source_documents"))


def p2_checked(spark: SparkSession, d: str) -> DataFrame:
    """Rejected documents of new batches with every accepted one they repeat, and the likeness."""
    docs = table(spark, d, "source_documents").where("id is not null").groupBy("id").agg(F.min("batch_no").alias("batch_no"), F.max("content").alias("content"))
    return history.check_batches(docs)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a rejected and an accepted document, smaller id first."""
    pairs = p2_checked(spark, d)
    return pairs.select(F.least("rejected", "accepted").alias("doc_id_a"), F.greatest("rejected", "accepted").alias("doc_id_b")).distinct()


def vector_items(spark: SparkSession, d: str) -> DataFrame:
    """(id, key, group, vector) of stored vectors and asked queries; id is a 64-bit hash of the key."""
    stored = table(spark, d, "vector_metadata").select(F.col("chunk_id").alias("key"), F.col("embedding_model").alias("group"), F.col("embedding").alias("vector"))
    asked = table(spark, d, "query_results").select(F.col("query_id").alias("key"), F.col("embedding_model").alias("group"), F.col("query_embedding").alias("vector"))
    return stored.unionByName(asked).where("key is not null").select(F.xxhash64("key").alias("id"), "*")


def p3_similar(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar items of every item, by their keys."""
    items = vector_items(spark, d)
    found = vectors.most_similar(items, tie_col="key")
    names = items.select("id", "key").distinct()
    own, other = names.select("id", "key"), names.select(F.col("id").alias("neighbour"), F.col("key").alias("neighbour_key"))
    return found.join(own, "id").join(other, "neighbour").select("key", "neighbour_key", "cosine", "rank")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of items that are among each other's 10 most similar, with a cosine of 0.9 or more."""
    items = vector_items(spark, d)
    pairs = vectors.mutual(vectors.most_similar(items, least=0.9, tie_col="key"), 0.9)
    keys = items.select("id", "key")
    some = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    named = keys.join(some, "id", "left_semi").distinct()
    a, b = (named.select(F.col("id").alias(s), F.col("key").alias(f"key_of_{s}")) for s in "ab")
    both = pairs.join(a, "a").join(b, "b")
    return both.select(F.least("key_of_a", "key_of_b").alias("key_a"), F.greatest("key_of_a", "key_of_b").alias("key_b"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks with a likeness of 0.5 or more, smaller id first."""
    pairs = neardups.expanded(*neardups.near_duplicates(table(spark, d, "chunks")))
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with a likeness set, its group (of linked sets) and its number of linked sets."""
    members, links = neardups.near_duplicates(table(spark, d, "chunks"))
    members, links = staged(members, "members"), staged(links, "links")
    label = neardups.components(members.select(F.col("set_key").alias("node")), links.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")))
    names = members.join(label, F.col("set_key") == F.col("node")).groupBy("component").agg(F.min("id").alias("group_id"))
    degree = links.select(F.explode(F.array("key_a", "key_b")).alias("set_key")).groupBy("set_key").agg(F.count("*").alias("links"))
    of = members.join(label, F.col("set_key") == F.col("node")).join(names, "component").join(degree, "set_key", "left")
    return of.select(F.col("id").alias("chunk_id"), "group_id", F.coalesce("links", F.lit(0)).alias("links"))


def p5_pieces(spark: SparkSession, d: str, oversized_only: bool = False) -> DataFrame:
    """Pieces of every document and chunk, each key once."""
    docs = table(spark, d, "source_documents").select(F.lit("document").alias("item_kind"), F.col("id").alias("item_id"), F.col("content").alias("body"))
    parts = table(spark, d, "chunks").select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), F.col("text").alias("body"))
    found = pieces.split_oversized(docs.unionByName(parts), ["item_kind", "item_id"], "body", 400, 40, oversized_only)
    return found.dropDuplicates(["item_kind", "item_id", "piece_no"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Oversized documents and chunks, and whether they had to be cut by force."""
    return (
        p5_pieces(spark, d, oversized_only=True)
        .groupBy("item_kind", "item_id")
        .agg(F.when(F.max("forced"), "forced").otherwise("natural").alias("cut"))
    )


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Texts decoded from the token ids of every document."""
    return tokens.decode(tokens.encode(table(spark, d, "documents")), tokens.token_bytes(spark))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every document that shares a masked window of words with an evaluation text."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least 13 consecutive words of an evaluation text."""
    return p7_leaks(spark, d).where("equal_words >= 13").select("doc_id", "item_id")


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    """Main language, confidence and segments of every document that has words of a language."""
    model = langs.train(table(spark, d, "lang_samples"))
    return langs.document_languages(langs.language_segments(table(spark, d, "documents"), model, keep=("lang",)))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Missing and wrong labels, and other languages with a stretch of 12 or more words."""
    found = p8_languages(spark, d)
    label = langs.label_code(F.col("lang"))
    wrong = found.where(label.isNull() | (label != F.col("main_lang"))).select("doc_id", F.lit("label").alias("kind"), F.col("main_lang").alias("lang"))
    other = F.filter("segments", lambda s: (s["lang"] != F.col("main_lang")) & (s["end_word"] - s["first_word"] >= 12))
    mixed = found.select("doc_id", F.lit("segment").alias("kind"), F.explode(F.array_distinct(F.transform(other, lambda s: s["lang"]))).alias("lang"))
    return wrong.unionByName(mixed)


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_defects, p1_repaired, p2_found, p2_checked, p3_found, p3_similar, p4_found, p4_groups, p5_found, p5_pieces, p6_ids, p6_decoded, p7_found, p7_leaks, p8_found, p8_languages)}


#: Brute force over all pairs, for small tables only.
P3_FOUND = """
with i as (select chunk_id as key, embedding_model as g, embedding as e from vector_metadata union all select query_id, embedding_model, query_embedding from query_results),
o as (select key, any_value(g) as g, cast(any_value(e) as double[]) as e from i where key is not null and len(e) = 64 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0 group by key),
p as (select a.key as ka, b.key as kb, list_cosine_similarity(a.e, b.e) as c from o a join o b on a.g = b.g and a.key <> b.key),
r as (select ka, kb, c, row_number() over (partition by ka order by c desc, kb) as n from p where c >= 0.9)
select x.ka as key_a, x.kb as key_b from r x join r y on x.ka = y.kb and x.kb = y.ka where x.n <= 10 and y.n <= 10 and x.ka < x.kb
"""

P4_FOUND = """
with w as (select chunk_id, regexp_extract_all(lower(any_value(text)), '[\\p{L}\\p{N}]+') as ws from chunks where text is not null group by chunk_id),
g as (select distinct chunk_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) as gram from w where len(ws) >= 20),
n as (select chunk_id, count(*) as n from g group by chunk_id),
p as (select a.chunk_id as x, b.chunk_id as y, count(*) as both_have from g a join g b on a.gram = b.gram and a.chunk_id < b.chunk_id group by 1, 2)
select x as chunk_id_a, y as chunk_id_b from p join n a on a.chunk_id = x join n b on b.chunk_id = y where both_have >= 0.5 * (a.n + b.n - both_have)
"""

P5_FOUND = """
with i as (select 'document' as item_kind, id as item_id, any_value(content) as t from source_documents where content is not null group by id
  union all select 'chunk', chunk_id, any_value(text) from chunks where text is not null group by chunk_id),
w as (select *, len(regexp_extract_all(t, '[^ \\t\\n\\r\\f\\v]+')) as n from i)
select item_kind, item_id, case when list_max(list_transform(regexp_split_to_array(t, '[\\n\\r\\f\\v.!?;]'), lambda s: len(regexp_extract_all(s, '[^ \\t\\n\\r\\f\\v]+')))) > 400 then 'forced' else 'natural' end as cut
from w where n > 400
"""

P6_DECODED = "select doc_id, coalesce(text, '') as text from documents"

_PLAIN_WORDS = "regexp_extract_all(lower(regexp_replace(strip_accents({0}), '[\\p{{Cf}}\\p{{Mn}}]', '', 'g')), '[\\p{{L}}\\p{{N}}]+')"
_RUNS = "unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i : i + 12], ' '))) as run"
P7_FOUND = f"""
with d as (select doc_id, {_PLAIN_WORDS.format('text')} as ws from documents where text is not null),
b as (select item_id, {_PLAIN_WORDS.format('text')} as ws from benchmark where text is not null),
x as (select distinct doc_id, {_RUNS} from d where len(ws) >= 13),
y as (select distinct item_id, {_RUNS} from b where len(ws) >= 13)
select distinct doc_id, item_id from x join y using (run)
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_FOUND.strip(), "p4_found": P4_FOUND.strip(), "p5_found": P5_FOUND.strip(), "p6_decoded": P6_DECODED, "p7_found": P7_FOUND.strip()}
