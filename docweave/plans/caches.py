"""Queries on caches, checks of texts and answers, histories, and what hangs on documents."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions import text as fx
from docweave.operators import metrics, planning, state
from docweave.plans.search import QUERY_PLANS
from docweave.session import scratch_path
from docweave.tables import table


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return state.latest(table(spark, d, "query_results").where("query_id is not null"), ["query_id"], [F.desc_nulls_last("asked_at")])


_LATEST = "l as (select * from (select *, row_number() over (partition by query_id order by asked_at desc nulls last) as r from query_results where query_id is not null) where r = 1)"
_NORMAL = "regexp_replace(regexp_replace(lower(query), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '^ | $', '', 'g')"


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the retrieval and the answer cache: they differ by session, normal form, model, size of the route, and context."""
    q = planning.routed(_queries(spark, d).withColumn("query_class", planning.query_class("query")))
    normal, k = fx.normal_query("query"), F.coalesce("top_k", F.lit(5))
    context = F.md5(F.array_join(F.coalesce("retrieved_chunks", F.array().cast("array<string>")), ","))
    return q.select("query_id", fx.cache_key("session_id", normal, k, "embedding_model").alias("retrieval_key"), fx.cache_key(normal, k, "style", context).alias("answer_key"))


CACHE_KEYS = f"""
with {_LATEST}, p as ({QUERY_PLANS}),
n as (select query_id, session_id, embedding_model, {_NORMAL} as normal, coalesce(top_k, 5) as k, case when query_class = 'ambiguous' then 'structured_scenarios' end as style,
  md5(array_to_string(coalesce(retrieved_chunks, []), ',')) as context from l join p using (query_id))
select query_id, sha256(concat_ws(':', session_id, normal, k, embedding_model)) as retrieval_key, sha256(concat_ws(':', normal, k, style, context)) as answer_key from n
"""


def embedding_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Embedding cache: later half of the queries against the normal forms of the first, by model; a form of another model is a miss."""
    q = _queries(spark, d).select("query_id", "embedding_model", "asked_at", fx.normal_query("query").alias("normal"))
    bounds = q.agg((F.min("asked_at") + (F.max("asked_at") - F.min("asked_at")) / 2).alias("middle"))
    q = q.crossJoin(F.broadcast(bounds))  # one row
    cached = q.where("asked_at <= middle").select("normal", F.col("embedding_model").alias("model")).distinct()
    late = q.where("asked_at > middle")
    same = cached.select("normal", F.col("model").alias("embedding_model"), F.lit(True).alias("hit"))
    other = cached.select("normal").distinct().withColumn("there", F.lit(True))
    found = late.join(same, ["normal", "embedding_model"], "left").join(other, "normal", "left")
    return found.groupBy("embedding_model").agg(F.count("*").alias("asked"), F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull() & F.col("there").isNotNull()).alias("other_model"))


EMBEDDING_LOOKUP = f"""
with {_LATEST}, n as (select query_id, embedding_model, asked_at, {_NORMAL} as normal from l), b as (select min(asked_at) + (max(asked_at) - min(asked_at)) / 2 as middle from n),
c as (select distinct normal, embedding_model from n, b where asked_at <= middle),
x as (select n.*, exists (select 1 from c where c.normal = n.normal and c.embedding_model = n.embedding_model) as hit, exists (select 1 from c where c.normal = n.normal) as there from n, b where asked_at > middle)
select embedding_model, count(*) as asked, count(*) filter (hit) as hits, count(*) filter (not hit and there) as other_model from x group by 1
"""


def answer_replays(spark: SparkSession, d: str) -> DataFrame:
    """Queries asked before in any session: the query whose answer is replayed, if it is at most 20 days old."""
    q = _queries(spark, d).where("asked_at is not null").withColumn("normal", fx.normal_query("query"))
    w = Window.partitionBy("normal").orderBy("asked_at", "query_id")
    before = F.lag("query_id").over(w), F.lag("asked_at").over(w)
    q = q.select("query_id", before[0].alias("replayed"), (F.col("asked_at") - before[1] <= F.expr("interval 20 days")).alias("fresh"))
    return q.where("replayed is not null").select("query_id", "replayed", "fresh")


ANSWER_REPLAYS = f"""
with {_LATEST}, n as (select query_id, asked_at, {_NORMAL} as normal from l where asked_at is not null),
w as (select query_id, lag(query_id) over v as replayed, asked_at - lag(asked_at) over v <= interval 20 days as fresh from n window v as (partition by normal order by asked_at, query_id))
select query_id, replayed, fresh from w where replayed is not null
"""


def approved_answers(spark: SparkSession, d: str) -> DataFrame:
    """For every query an answer with a score of 0.85 or more to the same normal form: of its session first, else of any."""
    q = _queries(spark, d).withColumn("normal", fx.normal_query("query"))
    good = q.where(F.array_max("retrieval_scores") >= 0.85)
    own = good.where("session_id is not null").groupBy("session_id", "normal").agg(F.min("query_id").alias("own"))
    any_ = good.groupBy("normal").agg(F.min("query_id").alias("any"))
    return q.join(own, ["session_id", "normal"], "left").join(any_, "normal", "left").select("query_id", F.coalesce("own", "any").alias("approved"), F.col("own").isNotNull().alias("of_session"))


APPROVED_ANSWERS = f"""
with {_LATEST}, n as (select *, {_NORMAL} as normal from l), g as (select * from n where list_max(retrieval_scores) >= 0.85),
o as (select session_id, normal, min(query_id) as own from g where session_id is not null group by 1, 2), y as (select normal, min(query_id) as any_one from g group by 1)
select query_id, coalesce(own, any_one) as approved, own is not null as of_session from n left join o on n.session_id = o.session_id and n.normal = o.normal left join y on n.normal = y.normal
"""


def query_checks(spark: SparkSession, d: str) -> DataFrame:
    """Texts taken as queries: why they are refused, and their first 2,000 characters with a mark."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", fx.query_error("text").alias("error"), F.md5(fx.shortened("text", 2000, " [...]")).alias("prompt"))


QUERY_CHECKS = """
select doc_id, case when n = 0 then 'empty' when n < 3 then 'too_short' when n > 5000 then 'too_long' end as error, md5(case when length(text) > 2000 then substr(text, 1, 2000) || ' [...]' else text end) as prompt
from (select *, length(trim(coalesce(text, ''), ' ')) as n from documents)
"""


def text_parts(spark: SparkSession, d: str) -> DataFrame:
    """Question lines, parts between dashes, and the shown beginning of every document."""
    docs = table(spark, d, "documents").where("text is not null")
    asked, parts = fx.question_lines("text", 5), fx.summary_parts("text", 3)
    return docs.select("doc_id", F.size(asked).alias("questions"), F.md5(F.array_join(asked, "|")).alias("asked"), F.md5(F.array_join(parts, "|")).alias("parts"), F.md5(fx.shortened("text", 200)).alias("shown"), F.md5(F.substring("text", 1, 30000)).alias("embedded"))


TEXT_PARTS = r"""
with t as (select doc_id, text, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^[ \t]*([-*•]|[0-9]+[.)])?[ \t]*', ''), '[ \t\r]+$', '')) as ls,
  list_transform(string_split(text, '---'), lambda x: regexp_replace(x, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')) as ps from documents where text is not null),
q as (select *, list_filter(ls, lambda x: x like '%?')[1:5] as asked from t)
select doc_id, cast(len(asked) as integer) as questions, md5(array_to_string(asked, '|')) as asked, md5(array_to_string(list_concat(ps, ['', '', ''])[1:3], '|')) as parts,
  md5(case when length(text) > 200 then substr(text, 1, 200) || '...' else text end) as shown, md5(substr(text, 1, 30000)) as embedded from q
"""


def judged_answers(spark: SparkSession, d: str) -> DataFrame:
    """Overall score from fenced JSON verdicts that hold a query's stored scores; missing ones count 0.5, all are kept within 0..1."""
    q = _queries(spark, d)
    s = lambda i: F.get("retrieval_scores", F.lit(i))
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct(s(0).alias("relevance"), (s(1) * 2).alias("faithfulness"), s(2).alias("completeness"))), F.lit("\n```"))
    v = q.select("query_id", fx.verdict(answer).alias("v"))
    return v.select("query_id", F.round(metrics.judged(F.col("v.relevance"), F.col("v.faithfulness"), F.col("v.completeness")), 9).alias("overall"))


JUDGED_ANSWERS = f"""
with {_LATEST}, s as (select query_id, coalesce(retrieval_scores[1], 0.5) as a, coalesce(retrieval_scores[2] * 2, 0.5) as b, coalesce(retrieval_scores[3], 0.5) as c from l)
select query_id, round(0.3 * greatest(0.0, least(1.0, a)) + 0.5 * greatest(0.0, least(1.0, b)) + 0.2 * greatest(0.0, least(1.0, c)), 9) as overall from s
"""


def retrieved_sections(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved chunks with their section where it is known, and their length from the chunk or else from its vector."""
    q = _queries(spark, d).where("retrieved_chunks is not null").select("query_id", F.posexplode("retrieved_chunks").alias("place", "chunk_id"))
    once = table(spark, d, "chunks").where("chunk_id is not null").groupBy("chunk_id").agg(F.max("section_title").alias("section"), F.max(F.length("text")).alias("chars"))
    sections = once.where("section is not null").select("chunk_id", "section")  # the filter is on the joined side: no retrieved chunk is lost
    vectors = table(spark, d, "vector_metadata").where("chunk_id is not null").groupBy("chunk_id").agg(F.max("text_length").alias("length"))
    rows = q.join(sections, "chunk_id", "left").join(once.select("chunk_id", "chars"), "chunk_id", "left").join(vectors, "chunk_id", "left")
    return rows.select("query_id", "place", "chunk_id", "section", F.coalesce("chars", "length").alias("chars"))


RETRIEVED_SECTIONS = f"""
with {_LATEST}, e as (select query_id, unnest(retrieved_chunks) as chunk_id, unnest(range(len(retrieved_chunks))) as place from l where retrieved_chunks is not null),
o as (select chunk_id, max(section_title) as section, max(length(text)) as chars from chunks where chunk_id is not null group by 1),
v as (select chunk_id, max(text_length) as length from vector_metadata where chunk_id is not null group by 1)
select query_id, cast(place as integer) as place, chunk_id, section, cast(coalesce(chars, length) as integer) as chars from e left join o using (chunk_id) left join v using (chunk_id)
"""


def document_digests(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 chunks of every document, joined, up to 8,000 characters: what a summary is made of."""
    once = table(spark, d, "chunks").where("chunk_id is not null and document_id is not null").groupBy("document_id", "chunk_id").agg(F.max("chunk_index").alias("i"), F.max("text").alias("text"))
    first = once.withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("i").asc_nulls_last(), "chunk_id"))).where("n <= 20")
    listed = first.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("n", F.coalesce("text", F.lit("")).alias("text")))).alias("parts"))
    return listed.select("document_id", F.size("parts").alias("chunks"), F.md5(F.substring(F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n"), 1, 8000)).alias("digest"))


DOCUMENT_DIGESTS = """
with o as (select document_id, chunk_id, max(chunk_index) as i, max(text) as text from chunks where chunk_id is not null and document_id is not null group by 1, 2),
n as (select *, row_number() over (partition by document_id order by i nulls last, chunk_id) as n from o)
select document_id, cast(count(*) as integer) as chunks, md5(substr(string_agg(coalesce(text, ''), chr(10) || chr(10) order by n), 1, 8000)) as digest from n where n <= 20 group by 1
"""


def merged_history(spark: SparkSession, d: str) -> DataFrame:
    """The last 8 turns of every session from two sources: asked queries, and what the best retrieved chunk answered."""
    q = _queries(spark, d).where("session_id is not null")
    asked = q.select("session_id", "asked_at", "query_id", F.lit("user").alias("role"), F.md5("query").alias("said"))
    told = q.where(F.size("retrieved_chunks") > 0).select("session_id", "asked_at", "query_id", F.lit("assistant").alias("role"), F.md5(F.get("retrieved_chunks", F.lit(0))).alias("said"))
    return planning.last_turns(asked.unionByName(told).distinct(), "session_id", [F.desc_nulls_last("asked_at"), F.col("query_id"), F.col("role")], 8).select("session_id", "query_id", "role", "said", "back")


MERGED_HISTORY = f"""
with {_LATEST}, u as (select session_id, asked_at, query_id, 'user' as role, md5(query) as said from l where session_id is not null
  union select session_id, asked_at, query_id, 'assistant', md5(retrieved_chunks[1]) from l where session_id is not null and len(retrieved_chunks) > 0),
b as (select *, row_number() over (partition by session_id order by asked_at desc nulls last, query_id, role) as back from u)
select session_id, query_id, role, said, cast(back as integer) as back from b where back <= 8
"""


def last_turns(spark: SparkSession, d: str) -> DataFrame:
    """The most recent query of every session, and the most recent one with an answer."""
    q = _queries(spark, d).where("session_id is not null")
    key = F.struct(F.coalesce("asked_at", F.lit("1970-01-01").cast("timestamp_ntz")), "query_id")
    return q.groupBy("session_id").agg(F.max_by("query_id", key).alias("last_query"), F.max_by(F.when(F.size("retrieved_chunks") > 0, F.col("query_id")), F.when(F.size("retrieved_chunks") > 0, key)).alias("last_answered"))


LAST_TURNS = f"""
with {_LATEST}, s as (select session_id, query_id, len(retrieved_chunks) > 0 as answered, coalesce(asked_at, timestamp '1970-01-01') as asked from l where session_id is not null),
n as (select *, row_number() over (partition by session_id order by asked desc, query_id desc) as r, row_number() over (partition by session_id, coalesce(answered, false) order by asked desc, query_id desc) as ra from s)
select session_id, max(case when r = 1 then query_id end) as last_query, max(case when answered and ra = 1 then query_id end) as last_answered from n group by 1
"""


def cascade_counts(spark: SparkSession, d: str) -> DataFrame:
    """What goes with each session that failed: its documents, their chunks and vectors."""
    s = table(spark, d, "sessions").where("lower(status) = 'failed' or error_message is not null").select("session_id").distinct()
    docs = table(spark, d, "source_documents").where("id is not null").select("session_id", F.col("id").alias("document_id")).distinct().join(s, "session_id", "left_semi")
    parts = table(spark, d, "chunks").where("chunk_id is not null").select("document_id", "chunk_id").distinct().join(docs, "document_id")
    vectors = table(spark, d, "vector_metadata").where("vector_id is not null").select("chunk_id", "vector_id").distinct().join(parts, "chunk_id")
    counts = [x.groupBy("session_id").agg(F.countDistinct(c).alias(n)) for x, c, n in ((docs, "document_id", "documents"), (parts, "chunk_id", "chunks"), (vectors, "vector_id", "vectors"))]
    out = s
    for c in counts:
        out = out.join(c, "session_id", "left")
    return out.na.fill(0, ["documents", "chunks", "vectors"])


CASCADE_COUNTS = """
with s as (select distinct session_id from sessions where session_id is not null and (lower(status) = 'failed' or error_message is not null)),
x as (select s.session_id, t.id, c.chunk_id, v.vector_id from s left join source_documents t on t.session_id = s.session_id left join chunks c on c.document_id = t.id left join vector_metadata v on v.chunk_id = c.chunk_id)
select session_id, count(distinct id) as documents, count(distinct chunk_id) as chunks, count(distinct vector_id) as vectors from x group by 1
"""


def chunk_json(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written as JSON, parted by strategy, and read again: number, tokens and pages by strategy."""
    path = scratch_path(spark, "chunk-json")
    once = table(spark, d, "chunks").where("chunk_id is not null").groupBy("chunk_id").agg(*(F.max(c).alias(c) for c in ("document_id", "text", "token_count", "page_number", "strategy")))
    once.withColumn("strategy", F.coalesce("strategy", F.lit("none"))).write.partitionBy("strategy").json(path)
    back = spark.read.schema(once.schema).json(path)
    return back.groupBy("strategy").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.max("page_number").alias("pages"), F.sum(F.length("text")).alias("chars"))


CHUNK_JSON = """
with o as (select chunk_id, max(text) as text, max(token_count) as token_count, max(page_number) as page_number, max(strategy) as strategy from chunks where chunk_id is not null group by 1)
select coalesce(strategy, 'none') as strategy, count(*) as chunks, cast(sum(token_count) as bigint) as tokens, max(page_number) as pages, cast(sum(length(text)) as bigint) as chars from o group by 1
"""


def earliest_documents(spark: SparkSession, d: str) -> DataFrame:
    """The 100 source documents loaded first."""
    docs = table(spark, d, "source_documents").where("id is not null and loaded_at is not null").groupBy("id").agg(F.min("loaded_at").alias("loaded_at"))
    return docs.orderBy("loaded_at", "id").limit(100)


EARLIEST_DOCUMENTS = "select id, min(loaded_at) as loaded_at from source_documents where id is not null and loaded_at is not null group by id order by 2, 1 limit 100"


def document_names(spark: SparkSession, d: str) -> DataFrame:
    """What a source document is shown as: its path, name or id, the first that says something; and how many share it."""
    docs = table(spark, d, "source_documents").where("id is not null").groupBy("id").agg(F.max("path").alias("path"), F.max("name").alias("name"))
    return docs.groupBy(fx.first_of("path", "name", "id").alias("shown")).agg(F.count("*").alias("documents"))


DOCUMENT_NAMES = """
with o as (select id, max(path) as path, max(name) as name from source_documents where id is not null group by 1)
select coalesce(case when trim(path, ' ') <> '' then path end, case when trim(name, ' ') <> '' then name end, case when trim(id, ' ') <> '' then id end) as shown, count(*) as documents from o group by 1
"""

QUERIES = {
    "cache_keys": (cache_keys, CACHE_KEYS),
    "embedding_lookup": (embedding_lookup, EMBEDDING_LOOKUP),
    "answer_replays": (answer_replays, ANSWER_REPLAYS),
    "approved_answers": (approved_answers, APPROVED_ANSWERS),
    "query_checks": (query_checks, QUERY_CHECKS),
    "text_parts": (text_parts, TEXT_PARTS),
    "judged_answers": (judged_answers, JUDGED_ANSWERS),
    "retrieved_sections": (retrieved_sections, RETRIEVED_SECTIONS),
    "document_digests": (document_digests, DOCUMENT_DIGESTS),
    "merged_history": (merged_history, MERGED_HISTORY),
    "last_turns": (last_turns, LAST_TURNS),
    "cascade_counts": (cascade_counts, CASCADE_COUNTS),
    "chunk_json": (chunk_json, CHUNK_JSON),
    "earliest_documents": (earliest_documents, EARLIEST_DOCUMENTS),
    "document_names": (document_names, DOCUMENT_NAMES),
}
