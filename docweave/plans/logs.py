"""Queries on sessions, events and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.operators import metrics, state
from docweave.session import scratch_path
from docweave.streaming import streams
from docweave.tables import table


def event_latency(spark: SparkSession, d: str) -> DataFrame:
    """Number, mean, bounds and 95th percentile of the values of each event type."""
    found = metrics.latency_summary(table(spark, d, "events"), "event_type", "value")
    return found.select("event_type", "n", F.round("mean", 6).alias("mean"), "least", "most", "p95")


EVENT_LATENCY = """
select event_type, count(value) as n, round(avg(value), 6) as mean, min(value) as least, max(value) as most, list_sort(list(value))[cast(floor(count(value) * 0.95) as integer) + 1] as p95
from events where value is not null group by event_type
"""


def event_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per user: events, share of views, grounded rate (purchases against errors), mean of the number in the properties."""
    e = table(spark, d, "events")
    base = e.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("event_type") == "view", 1.0).otherwise(0.0)), 9).alias("view_share"), F.round(F.avg(F.get_json_object("props", "$.k").cast("int")), 6).alias("mean_k"))
    known = e.where("event_type in ('purchase', 'error')")
    rate = metrics.grounded_rate(known, "user_id", F.col("event_type") == "purchase")
    return base.join(rate.select("user_id", F.round("rate", 9).alias("grounded_rate")), "user_id", "left")


EVENT_RATES = """
select user_id, count(*) as n, round(avg(case when event_type = 'view' then 1.0 else 0.0 end), 9) as view_share, round(avg(cast(json_extract(props, '$.k') as integer)), 6) as mean_k,
  round(count(*) filter (event_type = 'purchase') / nullif(count(*) filter (event_type in ('purchase', 'error')), 0), 9) as grounded_rate from events group by user_id
"""


def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of each type per hour."""
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


HOURLY_EVENTS = "select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2"


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parque[t]"  # a glob, as a stream of one file needs it
    return streams.table_stream(spark, path, spark.read.parquet(path).schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _appended(spark: SparkSession, counted: DataFrame, *times: str) -> DataFrame:
    """What a stream appends over what is there, with its times as in the tables."""
    out = scratch_path(spark, "appended")
    streams.run_available(counted, out, scratch_path(spark, "stream-state"))
    rows = spark.read.schema(counted.schema).parquet(out)
    return rows.withColumns({t: F.col(t).cast("timestamp_ntz") for t in times})


def hourly_events_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events of each type per hour by Structured Streaming, once the watermark of a day has passed the hour."""
    counted = streams.windowed_counts(_event_stream(spark, d), "ts", "event_type", "value", late="1 day")
    return _appended(spark, counted, "window_start").withColumn("total", F.round("total", 4))


HOURLY_EVENTS_STREAM = """
select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2
having date_trunc('hour', ts) + interval 1 hour <= (select max(ts) from events) - interval 1 day
"""


def sliding_events_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events of each type in windows of six hours, one beginning every two hours, by Structured Streaming."""
    counted = streams.windowed_counts(_event_stream(spark, d), "ts", "event_type", "value", "6 hours", "1 day", "2 hours")
    return _appended(spark, counted, "window_start").withColumn("total", F.round("total", 4))


SLIDING_EVENTS_STREAM = """
with w as (select *, unnest([0, 2, 4]) as back from events),
s as (select *, time_bucket(interval 2 hours, ts, timestamp '2000-01-01') - to_hours(back) as window_start from w)
select window_start, event_type, count(*) as n, round(sum(value), 4) as total from s group by 1, 2
having window_start + interval 6 hours <= (select max(ts) from events) - interval 1 day
"""


def session_events_stream(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a user's events without a gap of six hours, once the watermark has passed them, by Structured Streaming."""
    return _appended(spark, streams.session_counts(_event_stream(spark, d), "ts", "user_id", "6 hours", "1 day"), "started", "ended")


SESSION_EVENTS_STREAM = """
with g as (select *, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as gap from events),
r as (select *, sum(case when gap >= 21600000000 then 1 else 0 end) over (partition by user_id order by ts, event_id) as run from g)
select user_id, min(ts) as started, max(ts) + interval 6 hours as ended, count(*) as n from r group by user_id, run
having max(ts) + interval 6 hours <= (select max(ts) from events) - interval 1 day
"""


def late_events_stream(spark: SparkSession, d: str) -> DataFrame:
    """The hourly counts where every third event comes after all others: those later than a day are left out.

    A batch is held against the watermark before the last batch's, so the second of three loses none.
    """
    source = scratch_path(spark, "late-source")
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (0, 1, 2):
        events.where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(source)
    counted = streams.windowed_counts(streams.table_stream(spark, source, events.schema, 1), "ts", "event_type", "value", late="1 day")
    return _appended(spark, counted, "window_start").withColumn("total", F.round("total", 4))


LATE_EVENTS_STREAM = """
with k as (select * from events where event_id % 3 < 2 or date_trunc('hour', ts) + interval 1 hour > (select max(ts) from events where event_id % 3 = 0) - interval 1 day)
select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from k group by 1, 2
having date_trunc('hour', ts) + interval 1 hour <= (select max(ts) from events) - interval 1 day
"""


def first_seen_stream(spark: SparkSession, d: str) -> DataFrame:
    """Users by the stream that sees each of them first, over two runs with one checkpoint: number and least id."""
    source, out, state_at = (scratch_path(spark, n) for n in ("seen-source", "seen", "seen-state"))
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "ts", "event_type")
    for part in ("user_id % 3 = 0", "true"):  # the second run meets all users of the first again
        events.where(part).write.mode("append").parquet(source)
        seen = streams.table_stream(spark, source, events.schema).select("user_id", "event_type").dropDuplicates()
        streams.run_available(seen, out, state_at)
    return spark.read.schema("user_id long, event_type string").parquet(out).groupBy("event_type").agg(F.count("*").alias("users"), F.min("user_id").alias("first_user"))


FIRST_SEEN_STREAM = "select event_type, count(distinct user_id) as users, min(user_id) as first_user from events group by 1"


def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a user's events without a gap of six hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("gap", F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w))
    e = e.withColumn("run", F.sum(F.when(F.col("gap") > 6 * 3600 * 1_000_000, 1).otherwise(0)).over(w))
    return e.groupBy("user_id", "run").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))


USER_SESSIONS = """
with g as (select *, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as gap from events),
r as (select *, sum(case when gap > 21600000000 then 1 else 0 end) over (partition by user_id order by ts, event_id) as run from g)
select user_id, cast(run as bigint) as run, min(ts) as started, max(ts) as ended, count(*) as n from r group by user_id, run
"""


def event_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Whether each event would be let through at 3 a day per user; refused events don't count."""
    return state.rate_limited(table(spark, d, "events"), "user_id", "ts", "event_id", 86_400, 3)


def expired_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions idle for an hour or older than two, as of the newest access of all."""
    s = table(spark, d, "sessions")
    now = s.agg(F.max("last_accessed").alias("now"))
    return state.expired(s.crossJoin(F.broadcast(now)), F.col("now")).select("session_id").distinct()


EXPIRED_SESSIONS = "with n as (select max(last_accessed) as now from sessions) select distinct session_id from sessions, n where last_accessed < now - interval 1 hour or created_at < now - interval 2 hour"


def session_quota(spark: SparkSession, d: str) -> DataFrame:
    """Source documents of each session beyond 3, in order of loading."""
    docs = table(spark, d, "source_documents").where("session_id is not null").groupBy("id", "session_id").agg(F.min("loaded_at").alias("loaded_at"))
    return state.quota(docs, "session_id", ["loaded_at", "id"], 3).where("not admitted").select("id", "session_id", "place")


SESSION_QUOTA = """
with d as (select id, session_id, min(loaded_at) as loaded_at from source_documents where session_id is not null group by 1, 2),
p as (select *, row_number() over (partition by session_id order by loaded_at nulls first, id) as place from d)
select id, session_id, cast(place as integer) as place from p where place > 3
"""


def status_progress(spark: SparkSession, d: str) -> DataFrame:
    """Ready, failed and pending source documents of each session; each id once, its latest row."""
    docs = state.latest(table(spark, d, "source_documents").where("session_id is not null"), ["id"], [F.desc_nulls_last("loaded_at"), F.desc_nulls_last("batch_no")])
    return state.status_counts(docs, "session_id")


STATUS_PROGRESS = """
with l as (select *, lower(coalesce(status, 'pending')) as s, row_number() over (partition by id order by loaded_at desc nulls last, batch_no desc nulls last) as r from source_documents where session_id is not null)
select session_id, count(*) as total, count(*) filter (s in ('ready', 'loaded')) as ready, count(*) filter (s in ('failed', 'error')) as failed,
  count(*) filter (s not in ('ready', 'loaded', 'failed', 'error')) as pending, count(*) filter (s in ('ready', 'loaded', 'failed', 'error')) as processed from l where r = 1 group by session_id
"""


def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Newest entry of each query key, and whether it lives 30 days before the newest query of all."""
    q = table(spark, d, "query_results")
    now = q.agg(F.max("asked_at").alias("now"))
    rows = q.crossJoin(F.broadcast(now))
    found = rows.groupBy(F.sha2("query", 256).alias("key")).agg(F.max("asked_at").alias("at"), F.max("now").alias("now"))
    return found.select("key", "at", (F.col("at") + F.expr("interval 30 days") > F.col("now")).alias("live"))


CACHE_HITS = "with n as (select max(asked_at) as now from query_results) select sha256(query) as key, max(asked_at) as at, max(asked_at) + interval 30 day > any_value(now) as live from query_results, n group by 1"


def free_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of source documents, made different within a session."""
    docs = table(spark, d, "source_documents").where("session_id is not null").select("id", "session_id", "name").distinct()
    return state.free_names(docs, "session_id", "name", ["id"]).select("id", "session_id", "free_name")


FREE_NAMES = """
with d as (select distinct id, session_id, name from source_documents where session_id is not null),
n as (select *, row_number() over (partition by session_id, name order by id) as n from d)
select id, session_id, case when n = 1 then name else regexp_extract(name, '^(.*?)(\\.[^.]*)?$', 1) || ' (' || n || ')' || regexp_extract(name, '^(.*?)(\\.[^.]*)?$', 2) end as free_name from n
"""


def orphan_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose source document is gone, and vectors whose chunk is gone, per embedding model or strategy."""
    docs = table(spark, d, "source_documents").select(F.col("id").alias("document_id"))
    c = table(spark, d, "chunks")
    lost = state.without(c.select("document_id", "chunk_id", "strategy").distinct(), docs, ["document_id"]).groupBy(F.lit("chunk").alias("kind"), F.col("strategy").alias("of")).agg(F.count("*").alias("n"))
    v = state.without(table(spark, d, "vector_metadata").select("chunk_id", "vector_id", "embedding_model").distinct(), c, ["chunk_id"])
    return lost.unionByName(v.groupBy(F.lit("vector").alias("kind"), F.col("embedding_model").alias("of")).agg(F.count("*").alias("n")))


ORPHAN_CHUNKS = """
select 'chunk' as kind, strategy as of, count(*) as n from (select distinct document_id, chunk_id, strategy from chunks c where not exists (select 1 from source_documents s where s.id = c.document_id)) group by 2
union all select 'vector', embedding_model, count(*) from (select distinct chunk_id, vector_id, embedding_model from vector_metadata v where not exists (select 1 from chunks c where c.chunk_id = v.chunk_id)) group by 2
"""


def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    """Line items by flag and status."""
    li = table(spark, d, "lineitem")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.count("*").alias("n"))


PRICING_SUMMARY = "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as mean_discount, count(*) as n from lineitem group by 1, 2"


def nation_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Revenue per region and nation of the customer: four joins."""
    c, o, li = (table(spark, d, t) for t in ("customer", "orders", "lineitem"))
    per_order = li.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = per_order.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name", "n_name").agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.count("*").alias("orders"))


NATION_REVENUE = """
select r_name, n_name, round(sum(revenue), 2) as revenue, count(*) as orders
from (select l_orderkey, sum(l_extendedprice * (1 - l_discount)) as revenue from lineitem group by 1) join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2
"""

QUERIES = {
    "event_latency": (event_latency, EVENT_LATENCY),
    "event_rates": (event_rates, EVENT_RATES),
    "hourly_events": (hourly_events, HOURLY_EVENTS),
    "hourly_events_stream": (hourly_events_stream, HOURLY_EVENTS_STREAM),
    "sliding_events_stream": (sliding_events_stream, SLIDING_EVENTS_STREAM),
    "session_events_stream": (session_events_stream, SESSION_EVENTS_STREAM),
    "late_events_stream": (late_events_stream, LATE_EVENTS_STREAM),
    "first_seen_stream": (first_seen_stream, FIRST_SEEN_STREAM),
    "user_sessions": (user_sessions, USER_SESSIONS),
    "event_rate_limit": (event_rate_limit, None),
    "expired_sessions": (expired_sessions, EXPIRED_SESSIONS),
    "session_quota": (session_quota, SESSION_QUOTA),
    "status_progress": (status_progress, STATUS_PROGRESS),
    "cache_hits": (cache_hits, CACHE_HITS),
    "free_names": (free_names, FREE_NAMES),
    "orphan_chunks": (orphan_chunks, ORPHAN_CHUNKS),
    "pricing_summary": (pricing_summary, PRICING_SUMMARY),
    "nation_revenue": (nation_revenue, NATION_REVENUE),
}
