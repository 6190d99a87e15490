"""Queries of sources, sinks and phases: what they write is read back, with SQL over the driver's tables beside it.

The three phases run once a session and folder, over all records, into the shared folder, as far as a query reads.
"""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwright import queries as core
from siftwright.config import Phase1Config, Phase2Config, Phase3Config
from siftwright.operators import augment, balance, leakage, validation
from siftwright.operators import records as rec
from siftwright.plans import phases
from siftwright.schema import RECORD
from siftwright.shared import _forget, shared_dir, written
from siftwright.sources import records as src
from siftwright.sources import sinks
from siftwright.sources.files import Files
from siftwright.streaming.records import first_rows, write_first_rows

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_DONE: dict[tuple[str, str], tuple[str, int]] = {}


def _query(sql: str):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, sf_dir: str, phase: int = 3) -> str:
    """The data folder over the records of sf_dir, with what the phases up to this one write there; 0 is the snapshot."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _DONE:
        folder = f"{shared_dir(spark)}/phases-{uuid.uuid4().hex}"
        atexit.register(_forget, spark, folder)
        _DONE[key] = folder, -1
    folder, done = _DONE[key]
    records = core._records(spark, sf_dir)
    steps = (
        lambda: phases.take_snapshot(spark, records, Phase1Config(data_dir=folder)),
        lambda: phases.prepare(spark, records, Phase1Config(data_dir=folder)),
        lambda: phases.enrich(spark, Phase2Config(data_dir=folder)),
        lambda: phases.finalize(spark, Phase3Config(data_dir=folder, docs_dir=f"{folder}/docs")),
    )
    for step in range(max(done + 1, min(phase, 1)), phase + 1):  # phase 1 takes the snapshot itself
        steps[step]()
        _DONE[key] = folder, step
    return folder


def _json(spark: SparkSession, sf_dir: str, name: str, phase: int = 3) -> dict:
    return Files(spark).read_json(f"{_folder(spark, sf_dir, phase)}/{name}")


UNIQUE = (
    core.GREEDY
    + """, unique_rows as (
  select e.* from exact_kept e join greedy using (split, row_idx)
), """
    + core.ISSUES.replace("{source}", "unique_rows")
    + """, valid_rows as (
  select u.* from unique_rows u join found using (split, row_idx) where len([x for x in issues if x[2] = 'error']) = 0
)"""
)


@_query(f"with {core.RECORDS} select row_idx, split, text, intent_label, severity, technique from records")
def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = spark.read.schema(RECORD).json(f"{_folder(spark, sf_dir, 0)}/raw/records")
    return read.select("row_idx", "split", "text", "intent_label", "severity", "technique")


@_query(f"with {core.RECORDS} select split, count(*) as n from records group by split")
def snapshot_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(_json(spark, sf_dir, "raw/snapshot_metadata.json", 0)["splits"].items()), "split string, n long")


@_query(
    f"""with {UNIQUE}, sizes as (
      select split, count(*) as input_rows, (select count(*) from exact_kept e where e.split = c.split) as exact_rows,
        (select count(*) from unique_rows u where u.split = c.split) as after_dedup_rows, (select count(*) from valid_rows v where v.split = c.split) as output_rows,
        (select sum(len(issues)) from found f where f.split = c.split)::bigint as issue_count
      from cleaned c group by split)
    select split, input_rows, after_dedup_rows, output_rows, input_rows - exact_rows as exact_duplicates_removed,
      exact_rows - after_dedup_rows as near_duplicates_removed, issue_count from sizes"""
)
def phase1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _json(spark, sf_dir, "processed/metadata.json", 1)["splits"]
    dedup = _json(spark, sf_dir, "processed/reports/dedup_report.json", 1)
    names = ("input_rows", "after_dedup_rows", "output_rows")
    rows = [
        (s, *(r[n] for n in names), dedup[s]["exact_duplicates_removed"], dedup[s]["near_duplicates_removed"], r["validation"]["issue_count"])
        for s, r in told.items()
    ]
    return spark.createDataFrame(rows, ", ".join(["split string", *(f"{n} long" for n in (*names, "exact_duplicates_removed", "near_duplicates_removed", "issue_count"))]))


@_query(f"with {UNIQUE} select split, row_idx, {core.BUCKETS}, ambiguity from valid_rows")
def processed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.read_splits(spark, f"{_folder(spark, sf_dir, 1)}/processed/processed").select("split", "row_idx", "severity_bucket", "ambiguity")


@_query(
    f"""with {UNIQUE}, placed as (select f.*, row_number() over (partition by split order by row_idx) - 1 as row_index from found f),
    listed as (
      select split, row_index, issues[i][1] as field, issues[i][2] as severity, row_number() over (partition by split order by row_index, i) as place
      from (select *, unnest(range(1, len(issues) + 1)) as i from placed))
    select split, row_index, field, severity, place from listed where place <= 100"""
)
def validation_report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _json(spark, sf_dir, "processed/reports/validation_report.json", 1)
    rows = [(s, i["row_index"], i["field"], i["severity"], n) for s, r in told.items() for n, i in enumerate(r["issues"], 1)]
    return spark.createDataFrame(rows, "split string, row_index long, field string, severity string, place long")


@_query(
    f"""with {UNIQUE}
    select split, dimension, value, count(*) as n from (
      select split, 'binary_label' as dimension, binary_label::varchar as value from valid_rows
      union all select split, 'technique', coalesce(technique, 'unknown') from valid_rows
      union all select split, 'severity', severity::varchar from valid_rows
      union all select split, 'row_count', 'all' from valid_rows) group by all"""
)
def distribution_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _json(spark, sf_dir, "processed/reports/class_distribution.json", 1)
    rows = [(s, d, v, n) for s, own in told.items() for d in ("binary_label", "technique", "severity") for v, n in own[d].items()]
    rows += [(s, "row_count", "all", own["row_count"]) for s, own in told.items()]
    return spark.createDataFrame(rows, "split string, dimension string, value string, n long")


@_query(f"with {UNIQUE} select split, {core.BUCKETS}, count(*) as n from valid_rows group by all")
def severity_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _json(spark, sf_dir, "processed/reports/severity_buckets.json", 2)
    return spark.createDataFrame([(s, b, n) for s, own in told.items() for b, n in own["by_bucket"].items()], "split string, severity_bucket string, n long")


@_query(f"with {UNIQUE} select split, row_idx from valid_rows where ambiguity")
def ambiguity_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{_folder(spark, sf_dir, 2)}/processed/subsets/ambiguity").select("split", "row_idx")


@_query(f"with {UNIQUE}, {core.SUBSETS.replace('from records', 'from valid_rows')} select subset, split, row_idx from subset_rows")
def technique_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{_folder(spark, sf_dir)}/processed/subsets/technique").select("subset", "split", "row_idx")


@_query(
    f"""with {UNIQUE}, {core.TARGETS.replace('from cleaned', 'from valid_rows')}
    select intent_label, false as is_balanced_duplicate, n from targets union all select intent_label, true, target - n from targets where target > n"""
)
def balanced_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = spark.read.parquet(f"{_folder(spark, sf_dir, 2)}/processed/train_balanced")
    return read.groupBy("intent_label", "is_balanced_duplicate").agg(F.count("*").alias("n"))


@_query(f"with {core.RECORDS}, {core.AUGMENTED} select ['synonym', 'noise', 'paraphrase'][method] as augment_method, count(*) as n from made where new <> t group by all")
def augment_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(rec.add_obfuscation_columns(core._train(spark, sf_dir), cleaned=True), "train")
    return augment.augment_counts(augment.augment_training(rows))


_AWARE = (
    UNIQUE
    + ", "
    + core.FRAGMENTS.replace("from cleaned", "from valid_rows")
    + """, aware as (
  select row_idx, case when len(f) > 0 then text_clean || ' [decoded_context: ' || array_to_string([x for x, i in f if list_position(f, x) = i][1:2], ' | ') || ']' else text_clean end as t
  from fragments
)"""
)


@_query(
    f"""with {_AWARE}, {core.ORDERED}, prints as (
      select distinct split, place, lower(trim(regexp_replace(regexp_replace(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]', '', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))) as p
      from aware join valid_rows using (row_idx) join ordered using (split) where trim(t) <> '')
    select a.split as source_split, b.split as target_split, count(*) as n from prints a join prints b on a.p = b.p and a.place < b.place group by all"""
)
def leakage_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _json(spark, sf_dir, "processed/reports/leakage_audit.json")["exact_leakage"]
    return spark.createDataFrame([(r["source_split"], r["target_split"], r["n"]) for r in told], "source_split string, target_split string, n long")


@_query(
    f"""with {core.NEAR_LEAKS.replace('words as (', 'sampled as (select * from cleaned qualify row_number() over (partition by split order by row_idx) <= 150), words as (').replace("lower(text_clean), '[a-z0-9]+') as w from cleaned", "lower(text_clean), '[a-z0-9]+') as w from sampled")}
    select source_split, target_split, n from near_leaks"""
)
def leakage_near_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample limit is the operator's own parameter."""
    return leakage.near_leakage(core._cleaned(spark, sf_dir), limit=150)


@_query(f"with {UNIQUE} select split, count(*) as n from valid_rows group by split")
def package_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = _json(spark, sf_dir, "processed/reports/package_manifest.json")
    return spark.read.parquet(f"{manifest['package_dir']}/processed").groupBy("split").agg(F.count("*").alias("n"))


@_query(f"with {UNIQUE} select count(*) as n_rows, 4::bigint as n_commands, true as has_hashes from valid_rows")
def reproducibility_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _json(spark, sf_dir, "processed/reports/reproducibility_manifest.json")
    n = int(told["content_hashes"]["rows"].split(":")[0])
    right = bool(told["artifact_hashes_sha256"]) and all(len(h) == 64 for h in told["artifact_hashes_sha256"].values())
    return spark.createDataFrame([(n, len(told["commands"]), right)], "n_rows long, n_commands long, has_hashes boolean")


@_query(
    f"""with {UNIQUE}, counted as (
      select 'rows_raw_' || split as metric, count(*) as n from records group by split union all select 'rows_processed_' || split, count(*) from valid_rows group by split)
    select phase, metric, n from counted, (select unnest(['phase2', 'phase3']) as phase)"""
)
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = sinks.runs(spark, f"{_folder(spark, sf_dir)}/processed").select(F.col("params")["phase"].alias("phase"), F.explode("metrics").alias("metric", "n"))
    return told.filter(F.col("metric").startswith("rows_raw_") | F.col("metric").startswith("rows_processed_"))


@_query(
    f"""with {UNIQUE}, c as (select split, count(*) as n from records group by split)
    select 'tm-' || substr(sha256('{{"dataset_config": "multiclass", "dataset_name": "records", "seed": 42, "split_counts": {{' ||
      string_agg('"' || split || '": ' || n, ', ' order by split) || '}}}}'), 1, 12) as dataset_snapshot_id, 'records' as dataset_name,
      'multiclass' as dataset_config, (select count(*) from valid_rows where split = 'train') as dataset_train_rows from c"""
)
def dataset_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = sinks.dataset_version(spark, f"{_folder(spark, sf_dir, 1)}/processed")
    names = ("dataset_snapshot_id", "dataset_name", "dataset_config", "dataset_train_rows")
    return spark.createDataFrame([tuple(told[n] for n in names)], "dataset_snapshot_id string, dataset_name string, dataset_config string, dataset_train_rows long")


@_query(
    """select (doc_id % 64)::int as part, sha256(string_agg(replace(coalesce(text, ''), chr(10), ' ') || chr(10), '' order by doc_id)) as sha256 from documents group by 1"""
)
def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' texts in 64 text files, found and hashed again."""
    folder = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, folder)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    line = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")).alias("line")
    parts = docs.select("doc_id", (F.col("doc_id") % 64).cast("int").alias("part"), line).repartition(64, "part").sortWithinPartitions("part", "doc_id")
    parts.select("line", "part").write.partitionBy("part").text(folder)
    found = sinks.artifact_hashes(spark, folder, "*.txt")
    return found.select(F.regexp_extract("path", r"/part=(\d+)/", 1).cast("int").alias("part"), "sha256")


@_query(f"with {UNIQUE} select split, row_idx, true as digests from valid_rows")
def package_zip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processed rows as the package's archive has them; digests: every file in it has the digest that it lists."""
    manifest = _json(spark, sf_dir, "processed/reports/package_manifest.json")
    folder = f"{shared_dir(spark)}/unzipped-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, folder)
    files = Files(spark)
    found: dict[str, str] = {}
    names = set(files.unzip(manifest["zip_path"], folder, lambda name: name.startswith("processed/") or name == "digests.json", found))
    listed = files.read_json(f"{folder}/digests.json")
    right = names == {*listed, "digests.json"} and all(found[name] == digest for name, digest in listed.items())
    return spark.read.parquet(f"{folder}/processed").select("split", "row_idx", F.lit(right).alias("digests"))


@_query(f"with {core.RECORDS} select row_idx, label as intent_label from records")
def aliased_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.normalize_fields(core._records(spark, sf_dir).drop("intent_label")).select("row_idx", "intent_label")


@_query(
    """select page_id as row_idx, coalesce(nullif(regexp_extract(url, '[?#](.*)$', 1), '') is not null, false) as ambiguity from pages"""
)
def truth_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth of a text column, the query or fragment of each page's url: any text but the empty one is true."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = pages.select(F.col("page_id").alias("row_idx"), F.regexp_extract("url", "[?#](.*)$", 1).alias("ambiguity"), F.lit(1).alias("severity"))
    return rec.add_derived_columns(rows).select("row_idx", "ambiguity")


@_query(
    """with texts as (select stamp_id as row_idx, raw as v from stamps)
    select row_idx, coalesce(case when regexp_full_match(trim(v), '[+-]?[0-9]+') then try_cast(trim(v) as int) end::varchar, 'none') as value from texts"""
)
def integer_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers in a text column, the raw stamps: some are seconds, most are no number."""
    rows = spark.read.parquet(f"{sf_dir}/stamps.parquet").select(F.col("stamp_id").alias("row_idx"), F.col("raw").alias("severity"))
    return rows.select("row_idx", F.coalesce(validation.as_int("severity").cast("string"), F.lit("none")).alias("value"))


NEAR_MATCHES = core.NEAR_LEAKS + """, leak_pairs as (
  select a.split as source_split, b.split as target_split, a.row_idx as row_idx, b.row_idx as matched_row,
    count(*)::double / (any_value(a.n) + any_value(b.n) - count(*)) as jaccard
  from (select * from spread join ordered using (split)) a join (select * from spread join ordered using (split)) b
    on a.h = b.h and a.place < b.place and least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) - 1e-9
  group by all having count(*)::double / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.85 - 1e-12
), first_leaks as (
  select source_split, target_split, row_idx, matched_row, round(jaccard, 4) as jaccard from leak_pairs
  qualify row_number() over (partition by source_split, target_split, row_idx order by matched_row) = 1
)"""


@_query(f"with {NEAR_MATCHES} select source_split, target_split, row_idx, matched_row, jaccard from first_leaks")
def leakage_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.near_matches(core._cleaned(spark, sf_dir), limit=None)


@_query(
    f"""with {NEAR_MATCHES}, listed as (
      select *, row_number() over (partition by source_split, target_split order by row_idx)::int as place from first_leaks)
    select source_split, target_split, row_idx, matched_row, place, substr(a.text_clean, 1, 80) as source_preview, substr(b.text_clean, 1, 80) as target_preview
    from listed join cleaned a using (row_idx) join cleaned b on b.row_idx = matched_row where place <= 5"""
)
def leakage_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = leakage.near_examples(core._cleaned(spark, sf_dir), limit=None)
    return shown.select("source_split", "target_split", "row_idx", "matched_row", "place", "source_preview", "target_preview")


@_query(
    f"""with {UNIQUE}, counted as (select split, severity::varchar as value, count(*) as n from valid_rows group by all)
    select split, value, n, row_number() over (partition by split order by n desc, value) as by_count, row_number() over (partition by split order by value::int) as by_number from counted"""
)
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severities as the reports list them: by rows in the JSON file, by number in the Markdown file."""
    folder = f"{_folder(spark, sf_dir, 1)}/processed/reports"
    told, rows = Files(spark).read_json(f"{folder}/class_distribution.json"), []
    split, part, shown = None, None, {}
    for line in Files(spark).read(f"{folder}/class_distribution.md").decode().splitlines():
        if line.startswith("## "):
            split = line[3:]
        elif found := re.match(r"\| (.*) \| rows \|$", line):
            part = found[1]
        elif part == "severity" and (found := re.match(r"\| (-?\d+) \| \d+ \|$", line)):
            shown.setdefault(split, []).append(found[1])
    for split, own in told.items():
        rows += [(split, value, n, i, shown[split].index(value) + 1) for i, (value, n) in enumerate(own["severity"].items(), 1)]
    return spark.createDataFrame(rows, "split string, value string, n long, by_count long, by_number long")


@_query(
    f"""with {core.RECORDS}, {core.BALANCED}
    select row_idx, is_balanced_duplicate, row_number() over (order by {core.DRAW.format("'42|' || row_idx || '|' || is_balanced_duplicate")}, row_idx) as place
    from (select distinct row_idx, is_balanced_duplicate from balanced)"""
)
def shuffled_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the seeded order of the balanced training rows, by what was written before: partition by partition."""
    rows = balance.balance_classes(core._train(spark, sf_dir)).select("row_idx", "is_balanced_duplicate").distinct()
    path = f"{shared_dir(spark)}/shuffled-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    balance.shuffled(rows).write.json(path)
    read = spark.read.schema("row_idx long, is_balanced_duplicate boolean").json(path)
    block = ["file_path", "file_block_start"]
    placed = read.select("*", *(f"_metadata.{c}" for c in block), F.monotonically_increasing_id().alias("at"))
    sizes = placed.groupBy(*block).agg(F.count("*").alias("k"), F.min("at").alias("start"))
    before = sizes.withColumn("before", F.coalesce(F.sum("k").over(W.orderBy(*block).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row a block
    return placed.join(before, block).select("row_idx", "is_balanced_duplicate", (F.col("before") + F.col("at") - F.col("start") + 1).alias("place"))


@_query(f"with {core.EXACT} select split, row_idx, text_fingerprint from exact_kept")
def streamed_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records as a stream of three shuffled batches, the stream started anew for each."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, folder)
    records = core._records(spark, sf_dir).select("split", "row_idx", "text")
    for i in range(3):
        part = F.pmod(F.xxhash64("row_idx"), F.lit(3)) == i
        records.filter(part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(records.schema).parquet(f"{folder}/in")
        write_first_rows(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return first_rows(spark, f"{folder}/out").select("split", "row_idx", "text_fingerprint")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
