"""The operators' queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm import chat, codes, decontam, funnel, langid, media, mixing, passages, simhash, tokens, topk, toxicity, urlfilter

URL_RULES = ("block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/")

FUNNELS = [
    funnel.Funnel("A", ("view", "click", "view", "purchase"), ("error",)),
    funnel.Funnel("B", ("signup", "view", "click", "purchase"), ("error",)),
    funnel.Funnel("C", ("click", "click", "purchase", "view"), ("signup",)),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.group_near_duplicates(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id",
        F.col("_sw_size").alias("size"),
        F.col("_sw_source_size").alias("source_size"),
        F.col("_sw_target").alias("target"),
        (F.col("_sw_size") * F.col("_sw_copies")).alias("taken"),
    )


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.list_passages(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages"), map(urlfilter.parse_rule, URL_RULES))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe_texts(_table(spark, sf_dir, "documents"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op12_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.count_funnels(_table(spark, sf_dir, "clicks"), FUNNELS)


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_toxicity,
        op2_simhash,
        op3_language,
        op4_mixing,
        op5_tokens,
        op6_chat,
        op7_passages,
        op8_decontamination,
        op9_urls,
        op10_media,
        op11_topk,
        op12_funnels,
        op13_codes,
    )
    return {f.__name__: f for f in found}


OP4_SQL = """
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
    coalesce(doc_id::varchar, '') || '|' || coalesce(source, '') || '|' || md5(coalesce(text, '')) as key from documents
), by_source as (
  select source, sum(size)::bigint as source_size from sized group by source
), ranked as (
  select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight, source_size * 2 as cap
  from by_source
), sums as (
  select *, sum(source_size) over () as all_words,
    coalesce(sum(cap) over o, 0) as full_words,
    sum(weight) over () - coalesce(sum(weight) over o, 0) as rest
  from ranked
  window o as (order by cap::double / weight, source nulls last rows between unbounded preceding and 1 preceding)
), levels as (
  select *, (1.5::double * all_words::double - full_words::double) / rest::double as level from sums
), water as (
  select level as water from levels where level * weight <= cap order by full_words, rest desc limit 1
), planned as (
  select source, source_size,
    case when water is null or water * weight > cap then cap::double else water * weight end as target
  from levels left join water on true
), drawn as (
  select doc_id, source, size,
    ('0x' || substr(md5('mix-1|' || key || '|' || row_number() over (partition by key)), 1, 13))::bigint / 4503599627370496::double as u
  from sized
)
select doc_id, size, source_size, target,
  (size * case when source_size > 0
    then floor(target / source_size) + (u < target / source_size - floor(target / source_size))::int else 0 end)::bigint as taken
from drawn join planned on drawn.source is not distinct from planned.source
"""

OP6_SQL = """
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, case when conv_id is null then row_number() over () end as r from conversations
), whole as (
  select conv_id, list({'role': role, 'text': text} order by turn nulls first, role, text) as turns from rows group by conv_id, r
), firsts as (
  select turns, min(conv_id) as conv_id, count(*) as n_copies from whole group by turns
), shorter as (
  select distinct turns[1:n] as turns from (select turns, unnest(range(1, len(turns))) as n from firsts)
)
select conv_id, len(turns)::bigint as n_turns, n_copies::bigint as n_copies,
  list_aggregate(list_transform(turns, lambda t: '<|im_start|>' || replace(replace(t.role || chr(10) || t.text,
    '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' || chr(10)), 'string_agg', '') as rendered
from firsts where turns not in (select turns from shorter)
"""

OP8_SQL = """
with doc_words as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents
), items as (
  select coalesce(item_id::varchar, '') as item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from benchmark
), item_windows as (
  select distinct item, least(len(w), 10) as n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') as win
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from items where len(w) > 0)
), lengths as (
  select distinct n from item_windows
), doc_windows as (
  select r, s, n, array_to_string(w[s:s + n - 1], ' ') as win
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as s from doc_words, lengths where len(w) >= n)
), hits as (
  select r, s, d.n, item from doc_windows d join item_windows i on d.n = i.n and d.win = i.win
), hit_words as (
  select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + n)) as p from (select distinct r, s, n from hits)) group by r
), hit_items as (
  select r, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256 from (select distinct r, item from hits) group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc_words left join hit_words using (r) left join hit_items using (r)
"""

OP9_SQL = """
with parts as (
  select page_id, case when contains(coalesce(url, ''), '://') then url[strpos(url, '://') + 3:] else '' end as rest from pages
), split as (
  select page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts
), rules(verdict, rule_host, rule_path) as (
  values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits as (
  select page_id, host, path, verdict, rule_host || rule_path as rule,
    row_number() over (partition by split.page_id, host, path order by length(rule_host || rule_path) desc, length(rule_host) desc) as place
  from split join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from split s left join (select distinct * from fits where place = 1) f
  on s.page_id is not distinct from f.page_id and s.host = f.host and s.path = f.path
"""

OP11_SQL = """
with kept as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.r as qr, q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from kept q join kept c on q.vec_id % 100 = 0 and q.r <> c.r and len(q.v) = len(c.v)
), ranked as (
  select *, row_number() over (partition by qr order by score desc, vec_id nulls last)::int as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""

OP12_SQL = """
with e as (
  select distinct client_id, kind, ts from clicks where client_id is not null and kind is not null and ts is not null
), funnels(funnel, s1, s2, s3, s4, x) as (
  values ('A', 'view', 'click', 'view', 'purchase', 'error'), ('B', 'signup', 'view', 'click', 'purchase', 'error'),
    ('C', 'click', 'click', 'purchase', 'view', 'signup')
), a1 as (
  select funnel, client_id, ts as p1, s2, s3, s4, x from e join funnels on kind = s1
), e_next as (
  select * from e
), b2 as (
  select a.*, n.ts as p2 from a1 a asof left join e_next n on a.client_id = n.client_id and a.s2 = n.kind and a.p1 < n.ts
), c2 as (
  select b.*, n.ts as q2 from b2 b asof left join e_next n on b.client_id = n.client_id and b.x = n.kind and b.p1 < n.ts
), a2 as (
  select *, p2 is not null and p2 <= p1 + interval 15 minute and (q2 is null or q2 > p2) as r2 from c2
), b3 as (
  select a.*, n.ts as p3 from a2 a asof left join e_next n on a.client_id = n.client_id and a.s3 = n.kind and a.p2 < n.ts
), c3 as (
  select b.*, n.ts as q3 from b3 b asof left join e_next n on b.client_id = n.client_id and b.x = n.kind and b.p2 < n.ts
), a3 as (
  select *, r2 and p3 is not null and p3 <= p2 + interval 15 minute and (q3 is null or q3 > p3) as r3 from c3
), b4 as (
  select a.*, n.ts as p4 from a3 a asof left join e_next n on a.client_id = n.client_id and a.s4 = n.kind and a.p3 < n.ts
), c4 as (
  select b.*, n.ts as q4 from b4 b asof left join e_next n on b.client_id = n.client_id and b.x = n.kind and b.p3 < n.ts
), a4 as (
  select *, r3 and p4 is not null and p4 <= p3 + interval 15 minute and (q4 is null or q4 > p4) as r4 from c4
), counted as (
  select funnel, client_id, count(*)::bigint as n1, count(*) filter (r2)::bigint as n2, count(*) filter (r3)::bigint as n3,
    count(*) filter (r4)::bigint as n4,
    list_sort(list(epoch_us(p2) - epoch_us(p1)) filter (r2)) as d2, list_sort(list(epoch_us(p3) - epoch_us(p2)) filter (r3)) as d3,
    list_sort(list(epoch_us(p4) - epoch_us(p3)) filter (r4)) as d4
  from a4 group by funnel, client_id
), told as (
  select *, (case when n4 > 0 then 4 when n3 > 0 then 3 when n2 > 0 then 2 else 1 end)::int as deepest from counted
)
select funnel, client_id, n1, n2, n3, n4, deepest, d2[(n2 + 1) // 2] as t2, d3[(n3 + 1) // 2] as t3, d4[(n4 + 1) // 2] as t4,
  count(*) over (partition by funnel, deepest)::bigint as same_depth
from told
"""


def _lloyd_sql(rounds: int) -> str:
    """Codebooks b0 to b<rounds>, and a<i>, the parts as assigned to b<i>."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} as materialized (
  select r, p, any_value(part) as part, min(struct_pack(d := list_inner_product(part, part) - 2 * list_inner_product(part, entry) + list_inner_product(entry, entry), e := e)) as best
  from parts join b{i} using (p) group by r, p
)""")
        if i < rounds:
            steps.append(f"""b{i + 1} as materialized (
  select b.p, b.e, coalesce(m.entry, b.entry) as entry from b{i} b left join (
    select p, e, list(floor(s / n)::double order by j) as entry from (
      select p, best.e as e, j, sum(part[j]) as s, count(*) as n from (select *, unnest(range(1, len(part) + 1)) as j from a{i}) group by all
    ) group by p, e
  ) m on b.p = m.p and b.e = m.e
)""")
    return ", ".join(steps)


OP13_SQL = f"""
with kept as materialized (
  select row_number() over (order by vec_id nulls last, embedding) - 1 as r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as materialized (
  select r, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] as part from kept, range(4) as t(p)
), b0 as materialized (
  select p, r as e, part as entry from parts where r < 256
), {_lloyd_sql(4)}, told as (
  select r, string_agg(format('{{:02x}}', best.e), '' order by p) as code, sum(best.d)::bigint as error from a4 group by r
), digest as (
  select sha256(string_agg(x::bigint::varchar, ',' order by p, e, j)) as h from (select p, e, unnest(entry) as x, unnest(range(1, len(entry) + 1)) as j from b4)
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, h as codebooks_sha256
from kept join told using (r), digest
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": OP4_SQL, "op6_chat": OP6_SQL, "op8_decontamination": OP8_SQL, "op9_urls": OP9_SQL, "op11_topk": OP11_SQL, "op12_funnels": OP12_SQL, "op13_codes": OP13_SQL}
