"""Chunks of source documents by every strategy; greedy packing as SQL is a recursion over the parts of each text."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import chunking
from docweave.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "source_documents").where("id is not null and content is not null")
    return docs.groupBy("id").agg(F.max("content").alias("content"), F.max("name").alias("name"))


def _chunked(strategy: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        found = chunking.chunks(_docs(spark, d), "id", "content", strategy)
        return found.withColumn("text", F.md5("text"))

    query.__doc__ = f"Chunks of every source document by the {strategy} strategy."
    return query


def chunks_routed(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every source document by the strategy of its name."""
    return chunking.routed_chunks(_docs(spark, d), "id", "content", "name").withColumn("text", F.md5("text"))


def routed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the strategy that their name gives them."""
    return _docs(spark, d).groupBy(chunking.strategy_of(F.col("name")).alias("strategy")).agg(F.count("*").alias("documents"))


def json_rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their lines as JSON documents, flattened again to key paths: values by path."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"), F.count("*").alias("n"))).alias("body"))
    found = chunking.chunks(lines, "key", "body", "json", least_chars=1)
    return found.select(F.explode(F.split("text", "\n")).alias("line")).select(F.split("line", ": ", 2).alias("p")).groupBy(F.element_at("p", 1).alias("path")).agg(F.count("*").alias("n"), F.sum(F.element_at("p", 2).cast("long")).alias("total"))


JSON_ROWS = """
with l as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) - 1 as i from lineitem)
select 'lines[' || i || '].l_linenumber' as path, count(*) as n, cast(sum(l_linenumber) as bigint) as total from l group by i
union all select 'lines[' || i || '].l_partkey', count(*), cast(sum(l_partkey) as bigint) from l group by i
union all select 'n', count(*), cast(sum(n) as bigint) from (select count(*) as n from lineitem group by l_orderkey)
"""

_SRC = "select id, max(content) as t from source_documents where id is not null and content is not null group by id"
_SPACE = r"[ \t\n\r\f\v\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{001C}-\x{001F}]"
_WORDS = "regexp_extract_all(t, '" + _SPACE.replace("[", "[^", 1) + "+')"
_OUT = f"""
o as (select id, chunk_index, text, start_char, end_char from c where length(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g')) >= 50)
select id, id || '_chunk_' || lpad(cast(chunk_index as varchar), 5, '0') as chunk_id, cast(chunk_index as integer) as chunk_index, md5(text) as text, cast(start_char as integer) as start_char,
  cast(end_char as integer) as end_char, cast(greatest(1, length(text) // 4) as integer) as token_count, '{{strategy}}' as strategy from o
"""


def _packed(strategy: str, parts: str, repeat: str = "0", base: str = "0", glue: str = "glue", by: str = "id") -> str:
    """SQL of greedy packing. `parts` gives (id, mode, glue, ps, part sizes as ns); `repeat` how many of `k` parts begin the next chunk."""
    return f"""
with recursive src as ({_SRC}), pl as ({parts}),
x as (select {by}, mode, unnest(ps) as p, unnest(ns) as n, unnest(range(len(ps))) as i from pl),
s as materialized (select *, sum(n) over (partition by {by} order by i) as upto from x),
r as (select {by}, i, cast(0 as bigint) as first, cast(0 as hugeint) as base, cast(null as bigint) as done from s where i = 0
  union all select v.{by}, v.i, v.nf, f.upto - f.n, case when v.cut then v.first end
  from (select a.{by}, a.i, r.first, a.upto - r.base > 500 and a.i > r.first as cut,
      case when a.upto - r.base > 500 and a.i > r.first then a.i - ({repeat.format(k='(a.i - r.first)')}) else r.first end as nf
    from r join s a on a.{by} = r.{by} and a.i = r.i + 1) v join s f on f.{by} = v.{by} and f.i = v.nf),
z as (select {by}, done as a, i - 1 as b from r where done is not null
  union all select {by}, first, i from r where ({by}, i) in (select {by}, max(i) from r group by {by})),
q as (select pl.*, z.a, z.b from z join pl using ({by})),
g as (select *, case mode when 'w' then array_to_string(list_slice(ps, a + 1, b + 1), ' ') when 'l' then array_to_string(list_slice(ps, a + 1, b + 1), chr(10)) else array_to_string(list_slice(ps, a + 1, b + 1), chr(10) || chr(10)) end as text,
  coalesce(list_sum(list_transform(list_slice(ps, 1, a), lambda w: length(w) + length(glue))), 0) + {base} as start_char from q),
c as (select id, row_number() over (partition by id order by {'' if by == 'id' else 'section_no, '}a, b) - 1 as chunk_index, text, start_char, start_char + length(text) as end_char from g),
{_OUT.replace('{strategy}', strategy)}"""


_SIZES = "list_transform({ps}, lambda w: greatest(1, (length(w) + 1) // 4))"
_TOKENS = "list_transform({ps}, lambda w: case when length(w) = 0 then 0 else greatest(1, length(w) // 4) end)"
FIXED = _packed(
    "fixed",
    f"""select id, mode, case when mode = 'l' then chr(10) else ' ' end as glue, ps, {_SIZES.format(ps='ps')} as ns
    from (select id, case when contains(t, chr(10)) then 'l' else 'w' end as mode, case when contains(t, chr(10)) then string_split(t, chr(10)) else {_WORDS} end as ps from src where t <> '')""",
    "case when a.mode = 'l' then greatest(1, {k} // 2) else 0 end",
)
PARAGRAPH = _packed("paragraph", f"select id, 'p' as mode, chr(10) || chr(10) as glue, ps, {_TOKENS.format(ps='ps')} as ns from (select id, string_split(t, chr(10) || chr(10)) as ps from src where t <> '')")
SLIDING = f"""
with recursive src as ({_SRC}), pl as (select id, {_WORDS} as ps from src),
x as (select id, unnest(ps) as p, unnest(range(len(ps))) as i from pl),
s as materialized (select id, i, length(p) // 4 + 1 as n, sum(length(p) // 4 + 1) over (partition by id order by i) as upto from x),
r as (select id, cast(-1 as bigint) as i, cast(0 as bigint) as first, cast(0 as hugeint) as base, cast(null as bigint) as done from s where i = 0
  union all select v.id, v.i, v.nf, coalesce(f.upto, 0), case when v.cut then v.first end
  from (select a.id, a.i, r.first, a.upto - r.base >= 500 as cut, case when a.upto - r.base >= 500 then greatest(r.first + 1, a.i - ((a.i + 1 - r.first) * 50 // 500) + 1) else r.first end as nf
    from r join s a on a.id = r.id and a.i = r.i + 1) v left join s f on f.id = v.id and f.i = v.nf - 1),
z as (select id, done as a, i as b from r where done is not null union all select id, first, i from r where (id, i) in (select id, max(i) from r group by id) and first <= i),
q as (select pl.*, z.a, z.b from z join pl using (id)),
g as (select *, array_to_string(list_slice(ps, a + 1, b + 1), ' ') as text, coalesce(list_sum(list_transform(list_slice(ps, 1, a), lambda w: length(w) + 1)), 0) as start_char from q),
c as (select id, row_number() over (partition by id order by a, b) - 1 as chunk_index, text, start_char, start_char + length(text) as end_char from g),
{_OUT.replace('{strategy}', 'sliding')}"""
ROUTED_COUNTS = (
    "with n as (select id, case lower(regexp_extract(max(name), '(\\.[^.]*)$', 1)) "
    + " ".join(f"when '{s}' then '{v}'" for s, v in chunking.STRATEGIES.items())
    + " else 'semantic' end as strategy from source_documents where id is not null and content is not null group by id) select strategy, count(*) as documents from n group by 1"
)

QUERIES = {
    "chunks_fixed": (_chunked("fixed"), FIXED),
    "chunks_sliding": (_chunked("sliding"), SLIDING),
    "chunks_paragraph": (_chunked("paragraph"), PARAGRAPH),
    "chunks_semantic": (_chunked("semantic"), None),
    "chunks_markdown": (_chunked("markdown"), None),
    "chunks_routed": (chunks_routed, None),
    "routed_counts": (routed_counts, ROUTED_COUNTS),
    "json_rows": (json_rows, JSON_ROWS),
}
