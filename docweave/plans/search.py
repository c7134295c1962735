"""Queries that search: BM25, vectors, fusion and what follows them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions import text as fx
from docweave.operators import planning, retrieval, state
from docweave.plans.texts import INDEX_TOKENS
from docweave.tables import table


def _text_queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: evaluation texts whose id is divisible by 20."""
    return table(spark, d, "benchmark").where("item_id % 20 = 0")


def bm25_documents(spark: SparkSession, d: str) -> DataFrame:
    """The 30 best documents by BM25 for each query text."""
    found = retrieval.bm25(table(spark, d, "documents"), _text_queries(spark, d), "doc_id", "text", "item_id", "text", 30)
    return found.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


BM25 = f"""
with t as (select doc_id, {INDEX_TOKENS.format('text')} as tokens from documents),
p as (select doc_id, term, any_value(n) as dl, count(*) as tf from (select doc_id, len(tokens) as n, unnest(tokens) as term from t) group by doc_id, term),
s as (select count(*) as docs, avg(len(tokens)) as avg_len from t),
w as (select term, ln(any_value(docs) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from p, s group by term),
i as (select term, case when raw < 0 then 0.25 * (select avg(raw) from w) else raw end as idf from w),
q as (select item_id, term, count(*) as times from (select item_id, unnest({INDEX_TOKENS.format('text')}) as term from benchmark where item_id % 20 = 0) group by 1, 2),
x as (select item_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))) as score from q join p using (term) join i using (term), s group by 1, 2)
select item_id, doc_id, round(score, 6) as score, cast(rank as integer) as rank
from (select *, row_number() over (partition by item_id order by round(score, 9) desc, doc_id) as rank from x where score > 0) where rank <= 30
"""


def term_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and weight of every index term."""
    docs = table(spark, d, "documents")
    found = retrieval.term_weights(retrieval.postings(docs, "doc_id", "text"), retrieval.corpus_stats(docs, "text"))
    return found.select("term", "df", F.round("idf", 6).alias("idf"))


TERM_STATISTICS = f"""
with t as (select doc_id, {INDEX_TOKENS.format('text')} as tokens from documents),
p as (select term, count(*) as df from (select doc_id, unnest(list_distinct(tokens)) as term from t) group by term),
w as (select term, df, ln((select count(*) from t) - df + 0.5) - ln(df + 0.5) as raw from p)
select term, df, round(case when raw < 0 then 0.25 * (select avg(raw) from w) else raw end, 6) as idf from w
"""


def corpus_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Documents, terms and mean length of the corpus."""
    s = retrieval.corpus_stats(table(spark, d, "documents"), "text")
    return s.select("docs", F.round("avg_len", 6).alias("avg_len"), "terms")


CORPUS_STATISTICS = f"with t as (select len({INDEX_TOKENS.format('text')}) as n from documents) select count(*) as docs, round(avg(n), 6) as avg_len, cast(sum(n) as bigint) as terms from t"


def _nearest(metric: str, by_label: bool = False, most: float | None = None):
    def query(spark: SparkSession, d: str) -> DataFrame:
        v = table(spark, d, "embeddings")
        q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
        label = F.col("label") if by_label else None
        found = retrieval.nearest(v, q, "vec_id", "embedding", "query_id", "q", 10, metric, label, label, most)
        return found.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")

    query.__doc__ = f"The 10 nearest vectors ({metric}) of every vector whose id is divisible by 20" + (", of its label." if by_label else ".")
    return query


def _nearest_sql(metric: str, by_label: bool = False, most: float | None = None) -> str:
    a, b = "cast(q.embedding as double[])", "cast(v.embedding as double[])"
    distance = f"greatest(1 - list_cosine_similarity({a}, {b}), 0)" if metric == "cosine" else f"greatest(pow(list_distance({a}, {b}), 2), 0)"
    return f"""
with x as (select q.vec_id as query_id, v.vec_id, round({distance}, 9) as distance from embeddings q, embeddings v where q.vec_id % 20 = 0{' and q.label = v.label' if by_label else ''}),
r as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from x{f' where distance <= {most}' if most else ''})
select query_id, vec_id, round(distance, 6) as distance, cast(rank as integer) as rank from r where rank <= 10
"""


def chunk_texts(spark: SparkSession, d: str, *kept: str) -> DataFrame:
    """(chunk_id, text, *kept), each chunk once."""
    return table(spark, d, "chunks").where("chunk_id is not null").groupBy("chunk_id").agg(*(F.max(c).alias(c) for c in ("text", *kept)))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The asked queries, each as it was asked last."""
    return state.latest(table(spark, d, "query_results").where("query_id is not null"), ["query_id"], [F.desc_nulls_last("asked_at")])


def _hybrid(spark: SparkSession, d: str, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fused ranking of chunks, chunk texts) for the asked queries."""
    texts = chunk_texts(spark, d)
    vectors = table(spark, d, "vector_metadata").select("chunk_id", "embedding_model", "embedding")
    vectors = vectors.join(texts.select("chunk_id"), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    dense = retrieval.nearest(vectors, asked, "chunk_id", "embedding", "query_id", "query_embedding", 30, "l2", F.col("embedding_model"), F.col("embedding_model"))
    sparse = retrieval.bm25(texts, asked.select("query_id", "query"), "chunk_id", "text", "query_id", "query", 30)
    return retrieval.fuse(dense, sparse, "query_id", "chunk_id", 10), texts


def hybrid_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The 10 best chunks by vectors and BM25, fused by reciprocal rank, for each stated query: those whose number, from the id's first digits, is divisible by 20."""
    stated = _asked(spark, d).where(F.conv(F.substring("query_id", 3, 4), 16, 10).cast("int") % 20 == 0)
    fused, _ = _hybrid(spark, d, stated)
    return fused.select("query_id", "chunk_id", F.round("rrf", 9).alias("rrf"), "dense_rank", "sparse_rank", "rank")


HYBRID = f"""
with a as (select * from (select *, row_number() over (partition by query_id order by asked_at desc nulls last) as n from query_results where query_id is not null)
  where n = 1 and cast('0x' || substr(query_id, 3, 4) as integer) % 20 = 0),
c as (select chunk_id, max(text) as text from chunks where chunk_id is not null group by 1),
v as (select * from (select chunk_id, embedding_model, embedding, row_number() over (partition by chunk_id order by added_at) as n from vector_metadata where chunk_id in (select chunk_id from c)) where n = 1),
fv as (select chunk_id, embedding_model, cast(embedding as double[]) as e from v where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
fa as (select query_id, embedding_model, cast(query_embedding as double[]) as e from a where len(query_embedding) = 64 and len(list_filter(query_embedding, lambda x: x is null or not isfinite(x))) = 0),
dx as (select query_id, chunk_id, round(greatest(pow(list_distance(fa.e, fv.e), 2), 0), 9) as distance from fa join fv using (embedding_model)),
dense as (select query_id, chunk_id, rank from (select *, row_number() over (partition by query_id order by distance, chunk_id) as rank from dx) where rank <= 30),
t as (select chunk_id, {INDEX_TOKENS.format('text')} as tokens from c),
p as (select chunk_id, term, any_value(n) as dl, count(*) as tf from (select chunk_id, len(tokens) as n, unnest(tokens) as term from t) group by 1, 2),
s as (select count(*) as docs, avg(len(tokens)) as avg_len from t),
w as (select term, ln(any_value(docs) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from p, s group by term),
i as (select term, case when raw < 0 then 0.25 * (select avg(raw) from w) else raw end as idf from w),
q as (select query_id, term, count(*) as times from (select query_id, unnest({INDEX_TOKENS.format('query')}) as term from a) group by 1, 2),
x as (select query_id, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))) as score from q join p using (term) join i using (term), s group by 1, 2),
sparse as (select query_id, chunk_id, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from x where score > 0) where rank <= 30),
f as (select query_id, chunk_id, dense.rank as dense_rank, sparse.rank as sparse_rank, coalesce(1 / (60 + dense.rank), 0) + coalesce(1 / (60 + sparse.rank), 0) as rrf from dense full outer join sparse using (query_id, chunk_id))
select query_id, chunk_id, round(rrf, 9) as rrf, cast(dense_rank as integer) as dense_rank, cast(sparse_rank as integer) as sparse_rank, cast(rank as integer) as rank
from (select *, row_number() over (partition by query_id order by round(rrf, 12) desc, dense_rank nulls last, sparse_rank nulls last, chunk_id) as rank from f) where rank <= 10
"""


def answer_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The context of each asked query: fused chunks, first of those that begin alike, reranked, within 2,000 characters."""
    asked = _asked(spark, d)
    fused, texts = _hybrid(spark, d, asked)
    rows = fused.join(texts, "chunk_id").join(asked.select("query_id", "query"), "query_id")
    rows = retrieval.first_by_prefix(rows, "query_id", "text")
    rows = retrieval.early_exit(rows, "query_id", 1 - F.col("distance"))
    rows = retrieval.overlap_rerank(rows, "query_id", "query", "text")
    return retrieval.context(retrieval.within_budget(rows, "query_id", "text", 2000), "query_id", "text")


def stored_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean and best stored retrieval score of each asked query; 0 where there is none."""
    q = state.latest(table(spark, d, "query_results"), ["query_id"], [F.desc_nulls_last("asked_at")])
    total = F.aggregate(F.filter("retrieval_scores", lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)
    n = F.size(F.filter("retrieval_scores", lambda x: x.isNotNull()))
    mean = F.when(n > 0, total / n).otherwise(0.0)
    return q.select("query_id", F.round(mean, 9).alias("mean_score"), F.coalesce(F.array_max("retrieval_scores"), F.lit(0.0)).alias("best"), (mean < 0.4).alias("low"))


STORED_SCORES = """
with n as (select *, row_number() over (partition by query_id order by asked_at desc nulls last) as r from query_results)
select query_id, round(coalesce(list_avg(retrieval_scores), 0.0), 9) as mean_score, coalesce(list_max(retrieval_scores), 0.0) as best, coalesce(list_avg(retrieval_scores), 0.0) < 0.4 as low from n where r = 1
"""


def retrieved_texts(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved chunks of asked queries that are there, with place and length (left out: chunks that are gone)."""
    q = table(spark, d, "query_results").where("retrieved_chunks is not null").select("query_id", "retrieved_chunks").dropDuplicates(["query_id"])
    rows = q.select("query_id", F.posexplode("retrieved_chunks").alias("place", "chunk_id"))
    texts = table(spark, d, "chunks").groupBy("chunk_id").agg(F.max("text").alias("text"))
    return rows.join(texts, "chunk_id").select("query_id", "place", "chunk_id", F.length("text").alias("chars"))


RETRIEVED_TEXTS = """
with q as (select query_id, any_value(retrieved_chunks) as r from query_results where retrieved_chunks is not null group by query_id),
e as (select query_id, unnest(r) as chunk_id, unnest(range(len(r))) as place from q),
t as (select chunk_id, max(text) as text from chunks group by chunk_id)
select query_id, cast(place as integer) as place, chunk_id, cast(length(text) as integer) as chars from e join t using (chunk_id)
"""


def query_plans(spark: SparkSession, d: str) -> DataFrame:
    """Class and route of every asked query."""
    q = table(spark, d, "query_results").select("query_id", "query").dropDuplicates(["query_id"])
    found = planning.routed(q.withColumn("query_class", planning.query_class("query")))
    return found.select("query_id", "query_class", "decision", "top_k", "pool", "force_rerank")


def _any(phrases: list[str]) -> str:
    return "(" + " or ".join(f"contains(q, '{p}')" for p in phrases) + ")"


_CLASSES = f"""case when regexp_matches(trim(query, ' '), '{planning.TRIVIAL}') then 'trivial'
  when words <= 7 and regexp_matches(q, '{planning.FOLLOW_UP}') then 'follow_up' when {_any(planning.PROCEDURAL)} then 'procedural'
  when words <= 8 and {_any(planning.AMBIGUOUS)} then 'ambiguous' when {_any(planning.COMPARATIVE)} then 'comparative'
  when {_any(planning.SUMMARIZATION)} then 'summarization' when {_any(planning.ANALYTICAL)} then 'analytical' else 'factual' end"""
_VALUES = ", ".join(f"('{c}', '{dec}', {k or 'null'}, {p or 'null'}, {str(f).lower()})" for c, dec, k, p, f, *_ in planning.ROUTES)
QUERY_PLANS = f"""
with b as (select query_id, any_value(query) as query from query_results group by query_id),
n as (select *, lower(trim(query, ' ')) as q, len(list_filter(regexp_split_to_array(coalesce(query, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) as words from b),
c as (select query_id, {_CLASSES} as query_class from n),
r(query_class, decision, top_k, pool, force_rerank) as (values {_VALUES})
select query_id, query_class, decision, cast(top_k as integer) as top_k, cast(pool as integer) as pool, force_rerank from c left join r using (query_class)
"""


def follow_ups(spark: SparkSession, d: str) -> DataFrame:
    """Every asked query of a session, expanded by the one before where it is a short follow-up."""
    q = state.latest(table(spark, d, "query_results").where("session_id is not null"), ["query_id"], [F.desc_nulls_last("asked_at")])
    found = planning.expanded_follow_up(q, "session_id", ["asked_at", "query_id"], "query")
    return found.select("query_id", F.md5("expanded").alias("md5"), (F.col("expanded") != F.trim("query")).alias("is_follow_up"))


FOLLOW_UPS = f"""
with l as (select * from (select *, row_number() over (partition by query_id order by asked_at desc nulls last) as r from query_results where session_id is not null) where r = 1),
p as (select *, lag(trim(query, ' ')) over (partition by session_id order by asked_at nulls first, query_id) as prior,
  len(list_filter(regexp_split_to_array(coalesce(query, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) as words from l),
e as (select *, case when words <= 12 and regexp_matches(trim(query, ' '), '{planning.FOLLOW_UP_STARTS}') and length(prior) > 0 then substr(prior, 1, 400) || ' | Follow-up: ' || trim(query, ' ') else trim(query, ' ') end as expanded from p)
select query_id, md5(expanded) as md5, expanded <> trim(query, ' ') as is_follow_up from e
"""


def escalations(spark: SparkSession, d: str) -> DataFrame:
    """Why documents' first words, taken as queries with a confidence from their length, go to a human."""
    docs = table(spark, d, "documents").where("text is not null")
    confidence = F.length("text") % 100 / 100
    reason = planning.escalation("text", F.col("doc_id") % 7 != 0, confidence)
    return docs.groupBy(reason.alias("reason")).agg(F.count("*").alias("documents"))


ESCALATIONS = f"""
select case when regexp_matches(text, '{planning.SENSITIVE}') then 'sensitive' when doc_id % 7 = 0 then 'not_grounded' when length(text) % 100 / 100.0 < 0.4 then 'low_confidence' end as reason, count(*) as documents
from documents where text is not null group by 1
"""


def session_history(spark: SparkSession, d: str) -> DataFrame:
    """The last 6 asked queries of every session."""
    q = state.latest(table(spark, d, "query_results").where("session_id is not null"), ["query_id"], [F.desc_nulls_last("asked_at")])
    return planning.last_turns(q, "session_id", [F.desc_nulls_last("asked_at"), F.col("query_id")], 6).select("session_id", "query_id", "back")


SESSION_HISTORY = """
with l as (select * from (select *, row_number() over (partition by query_id order by asked_at desc nulls last) as r from query_results where session_id is not null) where r = 1),
b as (select *, row_number() over (partition by session_id order by asked_at desc nulls last, query_id) as back from l)
select session_id, query_id, cast(back as integer) as back from b where back <= 6
"""


def embedding_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Per embedding model: asked queries, and how many distinct normal forms an embedding cache would compute."""
    q = table(spark, d, "query_results").dropDuplicates(["query_id"])
    return q.groupBy("embedding_model").agg(F.count("*").alias("asked"), F.countDistinct(fx.normal_query("query")).alias("computed"))


EMBEDDING_REUSE = """
with b as (select query_id, any_value(query) as query, any_value(embedding_model) as embedding_model from query_results group by query_id)
select embedding_model, count(*) as asked, count(distinct regexp_replace(regexp_replace(lower(query), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '^ | $', '', 'g')) as computed from b group by 1
"""

QUERIES = {
    "bm25_documents": (bm25_documents, BM25),
    "term_statistics": (term_statistics, TERM_STATISTICS),
    "corpus_statistics": (corpus_statistics, CORPUS_STATISTICS),
    "nearest_l2": (_nearest("l2"), _nearest_sql("l2")),
    "nearest_cosine": (_nearest("cosine"), _nearest_sql("cosine")),
    "nearest_of_label": (_nearest("l2", True), _nearest_sql("l2", True)),
    "nearest_within": (_nearest("l2", False, 1.6), _nearest_sql("l2", False, 1.6)),
    "hybrid_chunks": (hybrid_chunks, HYBRID),
    "answer_contexts": (answer_contexts, None),
    "stored_scores": (stored_scores, STORED_SCORES),
    "retrieved_texts": (retrieved_texts, RETRIEVED_TEXTS),
    "query_plans": (query_plans, QUERY_PLANS),
    "follow_ups": (follow_ups, FOLLOW_UPS),
    "escalations": (escalations, ESCALATIONS),
    "session_history": (session_history, SESSION_HISTORY),
    "embedding_reuse": (embedding_reuse, EMBEDDING_REUSE),
}
