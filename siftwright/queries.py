"""Queries of the data set operators over the driver's tables, and their SQL.

Records come from the documents table by ``records_from_documents``; every query runs over all of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions import obfuscation as ob
from siftwright.functions import text as tx
from siftwright.operators import augment, balance, dedup, leakage, reports, subsets, validation
from siftwright.operators import records as rec
from siftwright.shared import written
from siftwright.sources.records import records_from_documents, snapshot_id, spread

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_from_documents(spread(_table(spark, sf_dir, "documents")))


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# The adapter and the cleaning rules as SQL; NFKC changes only what the adapter adds.
RECORDS = r"""records as (
  select doc_id as row_idx, case when doc_id % 10 < 8 then 'train' when doc_id % 10 = 8 then 'validation' else 'test' end as split,
    case when doc_id % 73 = 0 then text || ' ＡＢＣ ﬁ %41%42 слово' else text end as text, source,
    case when doc_id % 53 = 0 then 9 else l end::int as label, case when doc_id % 53 = 0 then 9 else l end::int as intent_label,
    case when doc_id % 67 = 0 then 3 when (l > 0) <> (doc_id % 41 = 0) then 1 else 0 end as binary_label,
    case when doc_id % 43 = 0 then 'invalid' else ['benign', 'direct_injection', 'system_extraction', 'role_hijack', 'obfuscation', 'tool_abuse', 'indirect_injection'][l + 1] end as intent,
    case when doc_id % 47 = 0 then 0 when l = 0 and doc_id % 59 = 0 then 5 when l = 0 then 1 + doc_id % 2 else 3 + doc_id % 8 end::int as severity,
    case when doc_id % 61 = 0 then '' else ['none', 'instruction_override', 'prompt_leak', 'role-play', 'encoding', 'tool_abuse', 'context_injection'][l + 1] end as technique,
    doc_id % 7 = 0 as ambiguity
  from (select *, (case when b < 8 then 0 when b < 12 then 1 when b < 15 then 2 when b < 17 then 3 else b - 13 end)::int as l
        from (select *, (doc_id // 10) % 20 as b from documents))
), cleaned as (
  select *, text as text_original,
    trim(regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), 'ＡＢＣ ﬁ', 'ABC fi'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]', '', 'g'), '[\x{200b}-\x{200d}\x{feff}\x{2060}\x{180e}]', '', 'g'), '[\s\p{Z}]+', ' ', 'g')) as text_clean
  from records
)"""
EXACT = RECORDS + """, exact_kept as (
  select *, sha256(lower(text_clean)) as text_fingerprint from cleaned
  qualify row_number() over (partition by split, sha256(lower(text_clean)) order by row_idx) = 1
)"""
SHINGLES = r"""words as (
  select split, row_idx, regexp_extract_all(lower(text_clean), '[a-z0-9]+') as w from {source}
), shingles as (
  select split, row_idx, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    when len(w) > 0 then [array_to_string(w, ' ')] else ['<none>'] end) as s from words
), spread as (
  select split, row_idx, len(s) as n, unnest(s) as h from shingles
)"""
ISSUES = """found as (
  select split, row_idx, [x for x in [
    case when text is null or text = '' then ['text', 'error'] end,
    case when label is null then ['label', 'error'] end,
    case when binary_label is null then ['binary_label', 'error'] end,
    case when intent is null or intent = '' then ['intent', 'error'] end,
    case when intent_label is null then ['intent_label', 'error'] end,
    case when (technique is null or technique = '') and intent_label is distinct from 0 then ['technique', 'error'] end,
    case when severity is null then ['severity', 'error'] end,
    case when trim(text_clean) = '' then ['text', 'error'] end,
    case when intent_label not between 0 and 6 then ['intent_label', 'error'] end,
    case when intent <> ['benign', 'direct_injection', 'system_extraction', 'role_hijack', 'obfuscation', 'tool_abuse', 'indirect_injection'][intent_label + 1] then ['intent', 'error'] end,
    case when binary_label not in (0, 1) then ['binary_label', 'error'] end,
    case when binary_label in (0, 1) and binary_label <> (intent_label <> 0)::int then ['binary_label', 'error'] end,
    case when severity not between 1 and 10 then ['severity', 'error'] end,
    case when intent_label = 0 and severity > 2 then ['severity', 'warning'] end,
    case when intent_label <> 0 and trim(technique) = '' then ['technique', 'error'] end
  ] if x is not null] as issues from {source}
)"""
DRAW = "('0x' || substr(md5({0}), 1, 15))::bigint"


def _unique_sets(source: str) -> str:
    return SHINGLES.replace("{source}", source)


@_query(f"with {RECORDS} select row_idx, text_clean, text_original from cleaned")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.clean_records(_records(spark, sf_dir)).select("row_idx", "text_clean", "text_original")


@_query(f"with {RECORDS} select row_idx, sha256(lower(text_clean)) as text_fingerprint from cleaned")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("row_idx", tx.fingerprint_digest(F.col("text")).alias("text_fingerprint"))


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.clean_records(_records(spark, sf_dir))


def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_deduplicate(_cleaned(spark, sf_dir), cleaned=True)


@_query(f"with {EXACT} select split, row_idx, text_fingerprint from exact_kept")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact(spark, sf_dir).select("split", "row_idx", "text_fingerprint")


@_query(
    f"""with {RECORDS} select split, count(*) as input_rows, count(distinct lower(text_clean)) as output_rows,
    count(*) - count(distinct lower(text_clean)) as exact_removed from cleaned group by split"""
)
def exact_dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_report(_cleaned(spark, sf_dir), cleaned=True)


@_query(
    f"""with {RECORDS}, {_unique_sets("cleaned")} select row_idx, shingle from
    (select row_idx, unnest(s) as shingle from shingles) where shingle <> '<none>'"""
)
def token_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir).select("row_idx", F.explode(tx.token_shingles(F.col("text_clean"))).alias("shingle"))


PAIRS = (
    EXACT
    + ", "
    + _unique_sets("exact_kept")
    + """, first_sets as (
  select split, row_idx, list_sort(s) as s from shingles qualify row_number() over (partition by split, list_sort(s) order by row_idx) = 1
), singles as (
  select split, row_idx, len(s) as n, unnest(s) as h from first_sets
), pairs as (
  select a.split, a.row_idx as l_row, b.row_idx as r_row, count(*)::double / (any_value(a.n) + any_value(b.n) - count(*)) as jaccard
  from singles a join singles b on a.split = b.split and a.h = b.h and a.row_idx < b.row_idx
    and least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) - 1e-9
  group by all having count(*)::double / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.85 - 1e-12
)"""
)


# Greedy in row order: a walk over the rows with an earlier neighbour drops those of which one is kept, however long a chain is.
GREEDY = (
    PAIRS
    + """, greedy as (
  with recursive placed as materialized (
    select r_row, list(l_row) as earlier, row_number() over (order by r_row) as k from pairs group by r_row
  ), walk(k, dropped) as (
    select 0::bigint, []::bigint[]
    union all
    select p.k, case when len([e for e in p.earlier if not list_contains(w.dropped, e)]) > 0 then list_append(w.dropped, p.r_row) else w.dropped end
    from walk w join placed p on p.k = w.k + 1
  )
  select split, row_idx from first_sets where row_idx not in (select unnest(dropped) from (select dropped from walk order by k desc limit 1))
)"""
)


@_query(f"with {PAIRS} select split, l_row, r_row, round(jaccard, 9) as jaccard from pairs")
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicate_pairs(_cleaned(spark, sf_dir)).withColumn("jaccard", F.round("jaccard", 9))


@_query(
    f"with {GREEDY} select split, row_idx from greedy"
)
def near_dedup_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_deduplicate(_cleaned(spark, sf_dir)).select("split", "row_idx")


def _lsh_sql() -> str:
    """Bands of the same MinHash as list expressions; greedy as a walk over the rows that have an earlier neighbour."""
    bands, rows = dedup.band_layout(dedup.THRESHOLD)
    minima = ", ".join(f"min((x * {a} + {b}) % {dedup._PRIME})" for a, b in zip(*(v.tolist() for v in dedup.permutations_of(bands * rows)), strict=True))
    return f"""with recursive {EXACT}, {_unique_sets("exact_kept")}, numbers as (
  select split, row_idx, case when h = '<none>' then {dedup.NO_SHINGLE} else ('0x' || substr(md5(h), 1, 8))::bigint >> 1 end as x from spread
), signed as (
  select split, row_idx, [{minima}] as s from numbers group by split, row_idx
), bands as (
  select split, row_idx, j, array_to_string(s[j * {rows} + 1:(j + 1) * {rows}], ',') as band from (select *, unnest(range({bands})) as j from signed)
), met as (
  select b.row_idx, list(distinct a.row_idx) as earlier from bands a join bands b on a.split = b.split and a.j = b.j and a.band = b.band and a.row_idx < b.row_idx
  group by b.row_idx
), placed as (
  select *, row_number() over (order by row_idx) as k from met
), walk(k, dropped) as (
  select 0::bigint, []::bigint[]
  union all
  select p.k, case when len([e for e in p.earlier if not list_contains(w.dropped, e)]) > 0 then list_append(w.dropped, p.row_idx) else w.dropped end
  from walk w join placed p on p.k = w.k + 1
)
select split, row_idx from exact_kept where row_idx not in (select unnest(dropped) from walk)"""


@_query(_lsh_sql())
def near_dedup_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_deduplicate(_cleaned(spark, sf_dir), mode="lsh").select("split", "row_idx")


@_query(
    f"""with {PAIRS}, hits as (
      select split, r_row as row_idx, min(l_row) as matched_row from pairs p
      where not exists (select 1 from pairs q where q.split = p.split and q.r_row = p.l_row) group by split, r_row
      qualify row_number() over (partition by split order by r_row) <= 10)
    select split, row_idx, matched_row, substr(text_clean, 1, 120) as duplicate_text_preview from hits join cleaned using (split, row_idx)"""
)
def near_dedup_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicate_examples(_cleaned(spark, sf_dir))


@_query(
    f"""with {RECORDS}, {ISSUES.replace("{source}", "cleaned")}, placed as (
      select *, row_number() over (partition by split order by row_idx) - 1 as row_index from found)
    select split, row_idx, row_index, i - 1 as place, issues[i][1] as field, issues[i][2] as severity
    from (select *, unnest(range(1, len(issues) + 1)) as i from placed)"""
)
def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validation.issue_table(_cleaned(spark, sf_dir)).drop("message")
    return found.withColumn("place", F.col("place").cast("long"))


@_query(
    f"""with {EXACT}, {ISSUES.replace("{source}", "exact_kept")}
    select split, count(*) as total_rows, count(*) filter (not ok) as invalid_rows, count(*) filter (ok) as valid_rows, sum(len(issues))::bigint as issue_count
    from (select *, len([x for x in issues if x[2] = 'error']) = 0 as ok from found) group by split"""
)
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validation_report(_exact(spark, sf_dir))


@_query(
    f"""with {EXACT}, {ISSUES.replace("{source}", "exact_kept")}
    select split, row_idx from found where len([x for x in issues if x[2] = 'error']) = 0"""
)
def valid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.valid_records(_exact(spark, sf_dir)).select("split", "row_idx")


@_query(
    f"""with {EXACT}, {ISSUES.replace("{source}", "exact_kept")}, ok as (
      select split, count(*) as n from found where len([x for x in issues if x[2] = 'error']) = 0 group by split)
    select c.split, count(*) as input_rows, any_value(e.n) as after_dedup_rows, any_value(ok.n) as output_rows, count(*) - any_value(e.n) as removed
    from cleaned c join (select split, count(*) as n from exact_kept group by split) e using (split) join ok using (split) group by c.split"""
)
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = _cleaned(spark, sf_dir)
    kept = dedup.exact_deduplicate(cleaned, cleaned=True)
    return reports.split_report(cleaned, kept, validation.valid_records(kept))


@_query(
    f"""with {EXACT}
    select split, dimension, value, count(*) as n from (
      select split, 'intent_label' as dimension, intent_label::varchar as value from exact_kept
      union all select split, 'intent', coalesce(intent, 'unknown') from exact_kept
      union all select split, 'binary_label', binary_label::varchar from exact_kept
      union all select split, 'technique', coalesce(technique, 'unknown') from exact_kept
      union all select split, 'severity', severity::varchar from exact_kept
      union all select split, 'ambiguity', case when ambiguity then 'True' else 'False' end from exact_kept
      union all select split, 'intent_label_named', coalesce(['benign', 'direct_injection', 'system_extraction', 'role_hijack', 'obfuscation', 'tool_abuse', 'indirect_injection'][intent_label + 1], intent_label::varchar) from exact_kept
      union all select split, 'row_count', 'all' from exact_kept) group by all"""
)
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.class_distribution(_exact(spark, sf_dir))


BUCKETS = """case when severity between 1 and 2 then 'low_1_2' when severity between 3 and 4 then 'moderate_3_4'
  when severity between 5 and 6 then 'high_5_6' when severity between 7 and 10 then 'critical_7_10' else 'unknown' end as severity_bucket"""


@_query(f"with {RECORDS} select split, {BUCKETS}, count(*) as n from records group by all")
def severity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.severity_buckets(_records(spark, sf_dir))


@_query(f"with {RECORDS} select split, intent_label, {BUCKETS}, count(*) as n from records group by all")
def intent_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.intent_by_severity(_records(spark, sf_dir))


@_query(
    f"""with {RECORDS}, b as (select split, intent_label, {BUCKETS} from records)
    select split, intent_label::varchar as intent_label, severity_bucket, count(*) as n from b group by all
    union all select split, 'all', severity_bucket, count(*) from b group by all"""
)
def severity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.coalesce(F.col("intent_label").cast("string"), F.lit("all"))
    return reports.severity_report(_records(spark, sf_dir)).withColumn("intent_label", label)


@_query(f"with {RECORDS} select split, row_idx from records where ambiguity")
def ambiguity_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ambiguity_subset(_records(spark, sf_dir)).select("split", "row_idx")


@_query(f"with {RECORDS} select split, count(*) filter (ambiguity) as n from records group by split")
def ambiguity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ambiguity_counts(_records(spark, sf_dir))


SUBSETS = """subset_rows as (
  select 'encoding' as subset, split, row_idx from records where regexp_matches(lower(technique), 'encoding|obfuscation|base64|hex|unicode|cipher|encoded') or intent_label = 4
  union all select 'role_play', split, row_idx from records where regexp_matches(lower(technique), 'role|persona|character|jailbreak') or intent_label = 3
  union all select 'tool_abuse', split, row_idx from records where regexp_matches(lower(technique), 'tool|function|api|call|plugin') or intent_label = 5
)"""


@_query(f"with {RECORDS}, {SUBSETS} select subset, split, row_idx from subset_rows")
def technique_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subsets.technique_subsets(_records(spark, sf_dir)).select("subset", "split", "row_idx")


@_query(f"with {RECORDS}, {SUBSETS} select subset, split, count(*) as n from subset_rows group by all")
def technique_subset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subsets.technique_subset_counts(_records(spark, sf_dir))


FLAGS = r"""flags as (
  select row_idx, text_clean as t,
    regexp_matches(text_clean, '(?:[A-Za-z0-9+/]{4}){2,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?') as base64,
    regexp_matches(text_clean, '(?:^|[^\p{L}\p{N}_])(?:0x)?[0-9a-fA-F]{8,}(?:$|[^\p{L}\p{N}_])') as hex,
    regexp_matches(text_clean, '(?:%[0-9a-fA-F]{2})+') as url_encoding,
    regexp_matches(text_clean, '[134570][^\n]*[a-zA-Z]') as leetspeak,
    regexp_matches(text_clean, '[\x{0400}-\x{04FF}\x{0600}-\x{06FF}\x{4E00}-\x{9FFF}\x{0590}-\x{05FF}]') as mixed_script,
    len(list_filter(range(1, len(c) - 2), lambda i: c[i] = c[i + 1] and c[i] = c[i + 2] and c[i] = c[i + 3])) > 0 as char_repetition
  from (select *, string_split(text_clean, '') as c from cleaned)
)"""


@_query(f"with {RECORDS}, {FLAGS} select row_idx, base64, hex, url_encoding, leetspeak, mixed_script, char_repetition from flags")
def obfuscation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = _cleaned(spark, sf_dir)
    return cleaned.select("row_idx", *(ob.obfuscation_flag(F.col("text_clean"), k).alias(k) for k in ob.KINDS))


@_query(
    f"""with {RECORDS}, {FLAGS} select row_idx, array_to_string([x for x in [
      case when base64 then 'base64' end, case when hex then 'hex' end, case when url_encoding then 'url_encoding' end,
      case when leetspeak then 'leetspeak' end, case when mixed_script then 'mixed_script' end,
      case when char_repetition then 'char_repetition' end] if x is not null], ',') as obfuscation_types,
      base64 or hex or url_encoding or leetspeak or mixed_script or char_repetition as obfuscation_detected from flags"""
)
def obfuscation_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = rec.add_obfuscation_columns(_cleaned(spark, sf_dir), cleaned=True)
    return marked.select("row_idx", "obfuscation_types", "obfuscation_detected")


# Printable as Python has it: Unicode 15.1; the three ranges are what RE2's tables (15.0) lack.
FRAGMENTS = r"""matches as (
  select row_idx, text_clean, list_transform(regexp_extract_all(text_clean, '(?:[A-Za-z0-9+/]{4}){2,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?'),
    lambda m: try(decode(from_base64(rpad(m, (4 * ceil(len(m) / 4))::int, '='))))) as d from cleaned
), fragments as (
  select row_idx, text_clean, [x for x in d if x is not null and x <> '' and (regexp_full_match(x, '(?:[\p{L}\p{M}\p{N}\p{P}\p{S}\x{2ffc}-\x{2fff}\x{31ef}\x{2ebf0}-\x{2ee5d}]| )*') or contains(x, ' '))] as f
  from matches
)"""


@_query(f"with {RECORDS}, {FRAGMENTS} select row_idx, f[i] as fragment, i - 1 as place from (select *, unnest(range(1, len(f) + 1)) as i from fragments)")
def base64_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _cleaned(spark, sf_dir).select("row_idx", F.posexplode(ob.base64_fragments(F.col("text_clean"))).alias("place", "fragment"))
    return found.withColumn("place", F.col("place").cast("long"))


@_query(
    f"""with {RECORDS}, {FRAGMENTS}, firsts as (
      select *, [x for x, i in f if list_position(f, x) = i][1:2] as shown from fragments)
    select row_idx, case when len(f) > 0 then text_clean || ' [decoded_context: ' || array_to_string(shown, ' | ') || ']' else text_clean end as text_obfuscation_aware,
      len(f)::int as obfuscation_decoded_count from firsts"""
)
def obfuscation_aware_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = rec.add_obfuscation_columns(_cleaned(spark, sf_dir), cleaned=True)
    return marked.select("row_idx", "text_obfuscation_aware", "obfuscation_decoded_count")


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir).filter("split = 'train'")


TARGETS = """counts as (
  select intent_label, count(*) as n from cleaned where split = 'train' group by 1
), stats as (
  select floor(median(n))::bigint as median, max(n) as most, arg_max(intent_label, n * 1000 - intent_label) as majority from counts
), targets as (
  select intent_label, n, case when intent_label <> majority and greatest(n, median) > 2 * n then 2 * n else greatest(n, median) end::bigint as target
  from counts, stats
)"""


@_query(f"with {RECORDS}, {TARGETS} select intent_label, n, target from targets")
def balance_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.balance_targets(_train(spark, sf_dir))


BALANCED = (
    TARGETS
    + f""", numbered as (
  select *, row_number() over (partition by intent_label order by row_idx) as number from cleaned where split = 'train'
), draws as (
  select intent_label, k, 1 + {DRAW.format("'42|' || intent_label || '|' || k")} % n as number
  from (select *, unnest(range(1, target - n + 1)) as k from targets)
), balanced as (
  select * exclude (number), false as is_balanced_duplicate from numbered
  union all select numbered.* exclude (number), true from draws join numbered using (intent_label, number)
)"""
)


@_query(f"with {RECORDS}, {BALANCED} select row_idx, intent_label, is_balanced_duplicate from balanced")
def balanced_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.balance_classes(_train(spark, sf_dir)).select("row_idx", "intent_label", "is_balanced_duplicate")


@_query(f"with {RECORDS}, {TARGETS} select intent_label, n as before_rows, target as after_rows, target - n as added_rows from targets")
def balance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = balance.balance_classes(_train(spark, sf_dir)).groupBy("intent_label")
    added = F.sum(F.col("is_balanced_duplicate").cast("long"))
    return made.agg((F.count("*") - added).alias("before_rows"), F.count("*").alias("after_rows"), added.alias("added_rows"))


def _key_draw(*parts: str) -> str:
    """SQL of a draw for a row of augmented_train; parts are SQL texts."""
    return DRAW.format(" || '|' || ".join(["'42'", "row_idx", "'false'", "'1'", *parts]))


_UNIT = "/ 1152921504606846976::double"
# Words as str.split() has them; RE2's \s lacks some of its white space, which decoded fragments may hold.
AUGMENTED = (
    TARGETS
    + ", "
    + FRAGMENTS
    + f""", aware as (
  select row_idx, case when len(f) > 0 then text_clean || ' [decoded_context: ' || array_to_string([x for x, i in f if list_position(f, x) = i][1:2], ' | ') || ']' else text_clean end as t
  from fragments
), rows as (
  select c.row_idx, t, intent_label, (1 + {_key_draw("'method'").replace("row_idx", "c.row_idx")} % 3)::int as method,
    {_key_draw("'gate'").replace("row_idx", "c.row_idx")} {_UNIT} as gate
  from cleaned c join aware using (row_idx) where split = 'train'
), minor as (
  select * from rows where intent_label in (select intent_label from counts where n < 0.75 * (select max(n) from counts))
), split_words as (
  select *, [x for x in regexp_split_to_array(t, '[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+') if x <> ''] as w from minor
), terms as (
  select *, list_transform(w, lambda x: regexp_replace(lower(x), '^[.,!?]+|[.,!?]+$', '', 'g')) as bare from split_words
), synonyms as (
  select map {{'ignore': ['disregard', 'override', 'bypass'], 'instruction': ['directive', 'command', 'prompt'], 'system': ['internal', 'core', 'hidden'],
    'prompt': ['instruction', 'query', 'input'], 'reveal': ['expose', 'leak', 'disclose'], 'secret': ['hidden', 'confidential', 'private'],
    'admin': ['root', 'superuser', 'privileged']}} as s
), placed as (
  select terms.*, s, [i for i in range(len(w)) if len(s[bare[i + 1]]) > 0] as spots from terms, synonyms
), chosen as (
  select *, case when len(spots) > 0 then list_sort([{{'u': {_key_draw("'place'", "i")} {_UNIT}, 'i': i}} for i in spots])[1].i end as p from placed
), replaced as (
  select *, case when p is null then t else array_to_string(w[1:p] || [s[bare[p + 1]][(1 + {_key_draw("'synonym'", "p")} % 3)::int]] || w[p + 2:], ' ') end as synonym from chosen
), swaps as (
  select *, [x for x in regexp_split_to_array(synonym, '[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+') if x <> ''] as v, {_key_draw("'swaps'")} {_UNIT} as swap_draw from replaced
), swapped as (
  select *, 1 + ({_key_draw("'swap'")} % greatest(len(v) - 1, 1))::int as q from swaps
), made as (
  select row_idx, t, method, case
    when method = 1 and gate < 0.25 then synonym
    when method = 2 and gate < 0.10 then array_to_string([case when regexp_matches(c, '\\p{{L}}') and {_key_draw("'noise'", "i - 1")} {_UNIT} < 0.04 then c || c else c end for c, i in string_split(t, '')], '')
    when method = 3 and swap_draw < 0.5 and len(v) >= 3 then array_to_string(v[1:q - 1] || [v[q + 1], v[q]] || v[q + 2:], ' ')
    when method = 3 then synonym else t end as new
  from swapped
)"""
)


@_query(
    f"""with {RECORDS}, {AUGMENTED}
    select row_idx, text_clean as text, false as is_augmented, 'none' as augment_method, null::varchar as text_original_aug_source from cleaned where split = 'train'
    union all select row_idx, new, true, ['synonym', 'noise', 'paraphrase'][method], t from made where new <> t"""
)
def augmented_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(rec.add_obfuscation_columns(_train(spark, sf_dir), cleaned=True), "train")  # read twice, cleaned once
    return augment.augment_training(rows).select("row_idx", "text", "is_augmented", "augment_method", "text_original_aug_source")


@_query(
    f"""with {RECORDS}, wrappers(for_label, templates) as (values
      (1, ['For testing purposes, {{text}}', 'In a hypothetical scenario, {{text}}', 'As an exercise, please {{text}}']),
      (2, ['To verify configuration, {{text}}', 'For debugging only, {{text}}', 'As a security audit, {{text}}']),
      (3, ['You are now in developer mode. {{text}}', 'Pretend you are an unrestricted assistant. {{text}}', 'Act as DAN and {{text}}']),
      (4, ['Decode and execute: {{text}}', 'Hidden instruction embedded below: {{text}}', 'Process the following encoded request: {{text}}']),
      (5, ['Using available tools, {{text}}', 'Call the appropriate function to {{text}}', 'Invoke system tools and {{text}}']),
      (6, ['Based on the retrieved context, {{text}}', 'Following external document guidance, {{text}}', 'The webpage says to {{text}}'])
    ), base as (select * from cleaned where split = 'train')
    select row_idx, text_clean as text, false as is_adversarial_paraphrase, null::varchar as text_original_adv_source from base
    union all
    select row_idx, replace(templates[(1 + {DRAW.format("'42|' || row_idx || '|1|wrapper'")} % 3)::int], '{{text}}', regexp_replace(text_clean, '\\.$', '')), true, text_clean
    from base join wrappers on intent_label = for_label"""
)
def adversarial_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = augment.augment_paraphrases(_train(spark, sf_dir))
    return made.select("row_idx", "text", "is_adversarial_paraphrase", "text_original_adv_source")


ORDERED = """ordered(split, place) as (values ('train', 0), ('validation', 1), ('test', 2))"""
EXACT_LEAKS = (
    RECORDS
    + f""", {ORDERED}, prints as (
  select distinct split, place, lower(text_clean) as p from cleaned join ordered using (split) where trim(text_clean) <> ''
), exact_leaks as (
  select a.split as source_split, b.split as target_split, count(*) as n from prints a join prints b on a.p = b.p and a.place < b.place group by all
)"""
)


@_query(f"with {EXACT_LEAKS} select source_split, target_split, n from exact_leaks")
def leakage_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.exact_leakage(_cleaned(spark, sf_dir), cleaned=True)


NEAR_LEAKS = (
    EXACT_LEAKS
    + ", "
    + _unique_sets("cleaned")
    + """, near_leaks as (
  select source_split, target_split, count(distinct l_row) as n from (
    select a.split as source_split, b.split as target_split, a.row_idx as l_row, b.row_idx as r_row
    from (select * from spread join ordered using (split)) a join (select * from spread join ordered using (split)) b
      on a.h = b.h and a.place < b.place and least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) - 1e-9
    group by all having count(*)::double / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.85 - 1e-12)
  group by all
)"""
)


@_query(f"with {NEAR_LEAKS} select source_split, target_split, n from near_leaks")
def leakage_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.near_leakage(_cleaned(spark, sf_dir), limit=None)


@_query(
    f"""with {NEAR_LEAKS}, kinds as (select 'exact' as kind, n from exact_leaks union all select 'near', n from near_leaks)
    select count(*) = 0 as passed, count(*) filter (kind = 'exact') as exact_leak_pairs, count(*) filter (kind = 'near') as near_leak_pairs,
      coalesce(sum(n) filter (kind = 'exact'), 0)::bigint as total_exact_overlaps, coalesce(sum(n) filter (kind = 'near'), 0)::bigint as total_near_overlaps
    from kinds"""
)
def leakage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leakage_summary(_cleaned(spark, sf_dir), limit=None, cleaned=True)


@_query(
    """with c as (select quality as t, toxic as p, count(*) as n from labels where quality is not null and toxic is not null group by all),
    k as (select distinct t as c from c union select distinct p from c),
    s as (select k.c, coalesce(sum(n) filter (t = k.c), 0) as a, coalesce(sum(n) filter (p = k.c), 0) as g, coalesce(sum(n) filter (t = k.c and p = k.c), 0) as h from k, c group by k.c)
    select round(sum(h)::double / sum(a), 9) as accuracy, round(avg(case when a + g > 0 then 2 * h::double / (a + g) else 0 end), 9) as f1_macro,
      round(avg(case when g > 0 then h::double / g else 0 end), 9) as precision_macro, round(avg(case when a > 0 then h::double / a else 0 end), 9) as recall_macro from s"""
)
def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = reports.macro_metrics(_table(spark, sf_dir, "labels"), "quality", "toxic")
    return scored.select(*(F.round(c, 9).alias(c) for c in scored.columns))


@_query(
    f"""with {RECORDS}, c as (select split, count(*) as n from records group by split)
    select 'tm-' || substr(sha256('{{"dataset_config": "multiclass", "dataset_name": "documents", "seed": 42, "split_counts": {{' ||
      string_agg('"' || split || '": ' || n, ', ' order by split) || '}}}}'), 1, 12) as snapshot_id from c"""
)
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = {r["split"]: r["count"] for r in _records(spark, sf_dir).groupBy("split").count().collect()}
    return spark.createDataFrame([(snapshot_id("documents", "multiclass", 42, counts),)], "snapshot_id string")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
