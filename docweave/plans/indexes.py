"""Queries on stored indexes and tables, and hybrid retrieval by each query's route."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import metrics, planning, retrieval, state, stores
from docweave.plans import search
from docweave.plans.search import QUERY_PLANS
from docweave.plans.texts import INDEX_TOKENS
from docweave.session import scratch_path
from docweave.tables import table


def bm25_stored(spark: SparkSession, d: str) -> DataFrame:
    """The 30 best documents of each query text from an index that was written in two batches and opened again."""
    docs, path = table(spark, d, "documents"), scratch_path(spark, "bm25")
    for part in (0, 1):
        stores.Bm25Index(spark, path).add(docs.where(F.col("doc_id") % 2 == part), "doc_id", "text")
    found = stores.Bm25Index(spark, path).search(table(spark, d, "benchmark").where("item_id % 20 = 0"), "doc_id", "item_id", "text", 30)
    return found.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def stored_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by model after two upserts, and the deletion of those whose chunk is gone: number and mean length of text."""
    rows = state.latest(table(spark, d, "vector_metadata").where("vector_id is not null"), ["vector_id"], [F.desc_nulls_last("added_at"), F.desc_nulls_last("text_length")])
    store = stores.TableStore(spark, scratch_path(spark, "vectors"), ["vector_id"])
    store.upsert(rows.where("text_length % 2 = 0").withColumn("text_length", F.lit(-1)))
    store.upsert(rows)
    store.delete(state.without(rows.select("vector_id", "chunk_id"), table(spark, d, "chunks").select("chunk_id"), ["chunk_id"]))
    kept = stores.TableStore(spark, store.path, ["vector_id"]).load()
    return kept.groupBy("embedding_model").agg(F.count("*").alias("n"), F.round(F.avg("text_length"), 6).alias("mean_length"), F.count("embedding").alias("vectors"))


STORED_VECTORS = """
with l as (select *, row_number() over (partition by vector_id order by added_at desc nulls last, text_length desc nulls last) as r from vector_metadata where vector_id is not null)
select embedding_model, count(*) as n, round(avg(text_length), 6) as mean_length, count(embedding) as vectors from l
where r = 1 and (chunk_id is null or chunk_id in (select chunk_id from chunks where chunk_id is not null)) group by 1
"""


def stored_documents(spark: SparkSession, d: str) -> DataFrame:
    """Source documents upserted batch by batch; failed ones deleted at the end, with their chunks: what is left by status."""
    rows = table(spark, d, "source_documents").where("id is not null").groupBy("id", "batch_no").agg(F.max("status").alias("status"), F.max("file_size").alias("file_size"))
    store = stores.TableStore(spark, scratch_path(spark, "documents"), ["id"])
    for part in ("batch_no = 0", "batch_no > 0"):
        newest = state.latest(rows.where(part), ["id"], [F.desc("batch_no")])
        store.upsert(newest)
    store.delete(rows.where("lower(status) = 'failed'"))
    left = store.compact(scratch_path(spark, "compact")).load()
    parts = table(spark, d, "chunks").where("chunk_id is not null").groupBy("chunk_id").agg(F.max("document_id").alias("id"))
    counted = parts.groupBy("id").agg(F.count("*").alias("chunks"))
    return left.join(counted, "id", "left").groupBy(F.lower("status").alias("status")).agg(F.count("*").alias("documents"), F.sum("file_size").alias("bytes"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


STORED_DOCUMENTS = """
with g as (select id, batch_no, max(status) as status, max(file_size) as file_size from source_documents where id is not null and batch_no is not null group by 1, 2),
l as (select *, row_number() over (partition by id order by batch_no desc) as r from g),
c as (select document_id as id, count(distinct chunk_id) as chunks from (select chunk_id, max(document_id) as document_id from chunks where chunk_id is not null group by 1) group by 1)
select lower(status) as status, count(*) as documents, cast(sum(file_size) as bigint) as bytes, cast(coalesce(sum(chunks), 0) as bigint) as chunks from l left join c using (id)
where r = 1 and id not in (select id from g where lower(status) = 'failed') group by 1
"""


def ivf_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many of the 10 nearest vectors of the stated queries a search of 6 of 16 clusters finds, by place."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    near = stores.ivf_nearest(v, q, "vec_id", "embedding", "query_id", "q", 10, 16, 6).select("query_id", "vec_id", F.lit(1).alias("found"))
    exact = retrieval.nearest(v, q, "vec_id", "embedding", "query_id", "q", 10)
    return exact.join(near, ["query_id", "vec_id"], "left").groupBy("rank").agg(F.count("*").alias("asked"), F.count("found").alias("found"))


def _latest_queries(spark: SparkSession, d: str) -> DataFrame:
    return state.latest(table(spark, d, "query_results").where("query_id is not null"), ["query_id"], [F.desc_nulls_last("asked_at")])


def _routed(spark: SparkSession, d: str) -> DataFrame:
    q = _latest_queries(spark, d).where(F.conv(F.substring("query_id", 3, 4), 16, 10).cast("int") % 20 == 0)
    routed = planning.routed(q.withColumn("query_class", planning.query_class("query")))
    return routed.where("decision <> 'direct_llm'").withColumn("top_k", F.coalesce("top_k", F.lit(5)))


def hybrid_routed(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid retrieval for the stated queries (ids whose number is divisible by 20) among semantic chunks, with the
    pool, rerank and size of each query's route."""
    found = search.chunk_texts(spark, d, "strategy")
    texts = retrieval.filtered(found, strategy="semantic").select("chunk_id", "text")
    vectors = table(spark, d, "vector_metadata").select("chunk_id", "embedding_model", "embedding").join(texts.select("chunk_id"), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    rows = retrieval.hybrid(vectors, texts, _routed(spark, d), "chunk_id", "embedding", "text", "query_id", "query_embedding", "query", group="embedding_model")
    return rows.select("query_id", "chunk_id", F.round("rrf", 9).alias("rrf"), "dense_rank", "sparse_rank", F.round("reranker", 9).alias("reranker"), "rank")


_PLANS = QUERY_PLANS.replace("with b as", "with recursive b as").rsplit("select query_id, query_class", 1)[0]
HYBRID_ROUTED = f"""
{_PLANS.rstrip().rstrip(',')},
o(query_class, rerank_k) as (values {", ".join(f"('{r[0]}', {r[5] or 'cast(null as integer)'})" for r in planning.ROUTES)}),
pl as (select query_id, coalesce(top_k, 5) as k, least(100, coalesce(top_k, 5) * coalesce(pool, 1)) as pool_size, force_rerank as force, rerank_k as most
  from c left join r using (query_class) left join o using (query_class) where decision <> 'direct_llm'),
a as (select * from (select *, row_number() over (partition by query_id order by asked_at desc nulls last) as n from query_results where query_id is not null)
  where n = 1 and cast('0x' || substr(query_id, 3, 4) as integer) % 20 = 0 and query_id in (select query_id from pl)),
ct as (select chunk_id, max(text) as text from chunks where chunk_id is not null group by 1 having max(strategy) = 'semantic'),
v as (select * from (select chunk_id, embedding_model, embedding, row_number() over (partition by chunk_id order by added_at) as n from vector_metadata where chunk_id in (select chunk_id from ct)) where n = 1),
fv as (select chunk_id, embedding_model, cast(embedding as double[]) as e from v where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
fa as (select query_id, embedding_model, cast(query_embedding as double[]) as e from a where len(query_embedding) = 64 and len(list_filter(query_embedding, lambda x: x is null or not isfinite(x))) = 0),
dx as (select query_id, chunk_id, round(greatest(pow(list_distance(fa.e, fv.e), 2), 0), 9) as distance from fa join fv using (embedding_model)),
dense as (select query_id, chunk_id, rank from (select *, row_number() over (partition by query_id order by distance, chunk_id) as rank from dx) join pl using (query_id) where rank <= pool_size),
t as (select chunk_id, {INDEX_TOKENS.format('text')} as tokens from ct),
p as (select chunk_id, term, any_value(n) as dl, count(*) as tf from (select chunk_id, len(tokens) as n, unnest(tokens) as term from t) group by 1, 2),
s as (select count(*) as docs, avg(len(tokens)) as avg_len from t),
w as (select term, ln(any_value(docs) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from p, s group by term),
i as (select term, case when raw < 0 then 0.25 * (select avg(raw) from w) else raw end as idf from w),
qt as (select query_id, list_distinct({INDEX_TOKENS.format('query')}) as terms, {INDEX_TOKENS.format('query')} as every from a),
qx as (select query_id, term, count(*) as times from (select query_id, unnest(every) as term from qt) group by 1, 2),
x as (select query_id, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))) as score from qx join p using (term) join i using (term), s group by 1, 2),
sparse as (select query_id, chunk_id, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from x where score > 0) join pl using (query_id) where rank <= pool_size),
f as (select query_id, chunk_id, dense.rank as dense_rank, sparse.rank as sparse_rank, coalesce(1 / (60 + dense.rank), 0) + coalesce(1 / (60 + sparse.rank), 0) as rrf from dense full outer join sparse using (query_id, chunk_id)),
fr as (select *, row_number() over (partition by query_id order by round(rrf, 12) desc, dense_rank nulls last, sparse_rank nulls last, chunk_id) as place from f),
fx as (select fr.*, k, force, most, count(*) over (partition by query_id) as m, len(list_intersect(terms, tokens)) / greatest(len(terms), 1) as share
  from fr join pl using (query_id) join t using (chunk_id) join qt using (query_id) where place <= pool_size),
z as (select *, case when (m > 8 or force) and (most is null or place <= most) then share end as reranker from fx),
y as (select *, row_number() over (partition by query_id order by reranker desc nulls last, place) as rank from z)
select query_id, chunk_id, round(rrf, 9) as rrf, cast(dense_rank as integer) as dense_rank, cast(sparse_rank as integer) as sparse_rank, round(reranker, 9) as reranker, cast(rank as integer) as rank from y where rank <= k
"""


def route_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Asked queries by route."""
    q = _latest_queries(spark, d)
    return planning.routed(q.withColumn("query_class", planning.query_class("query"))).groupBy("decision", "query_class").agg(F.count("*").alias("n"))


ROUTE_DISTRIBUTION = f"select decision, query_class, count(*) as n from ({QUERY_PLANS}) group by 1, 2"


def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per embedding model: asked queries, mean tokens, all retrieval scores, queries without, and their routes."""
    q = _latest_queries(spark, d)
    q = planning.routed(q.withColumn("query_class", planning.query_class("query"))).withColumn("tokens", F.floor(F.length("query") / 4))
    found = metrics.log_summary(q, "embedding_model", "tokens", "retrieval_scores", "decision")
    return found.select("embedding_model", "n", F.round("mean_tokens", 6).alias("mean_tokens"), F.round("mean_score", 6).alias("mean_score"), "best_score", "no_scores", "routes")


METRIC_SUMMARY = f"""
with p as ({QUERY_PLANS}),
l as (select *, row_number() over (partition by query_id order by asked_at desc nulls last) as r from query_results where query_id is not null),
q as (select query_id, embedding_model, length(query) // 4 as tokens, list_filter(coalesce(retrieval_scores, []), lambda x: x is not null) as s, decision from l join p using (query_id) where r = 1),
g as (select embedding_model, coalesce(decision, 'none') as route, count(*) as n from q group by 1, 2),
rr as (select embedding_model, string_agg(route || ':' || n, ',' order by route) as routes from g group by 1),
m as (select embedding_model, count(*) as n, round(avg(case when tokens > 0 then tokens end), 6) as mean_tokens, round(sum(list_sum(s)) / sum(len(s)), 6) as mean_score, max(list_max(s)) as best_score,
  count(*) filter (len(s) = 0) as no_scores from q group by 1)
select m.embedding_model, n, mean_tokens, mean_score, best_score, no_scores, routes from m join rr on m.embedding_model is not distinct from rr.embedding_model
"""

QUERIES = {
    "bm25_stored": (bm25_stored, search.BM25),
    "stored_vectors": (stored_vectors, STORED_VECTORS),
    "stored_documents": (stored_documents, STORED_DOCUMENTS),
    "ivf_recall": (ivf_recall, None),
    "hybrid_routed": (hybrid_routed, HYBRID_ROUTED),
    "route_distribution": (route_distribution, ROUTE_DISTRIBUTION),
    "metric_summary": (metric_summary, METRIC_SUMMARY),
}
