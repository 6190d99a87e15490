import hashlib
import json
import zipfile
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siftwright import cli, phase_queries
from siftwright.config import Config, Phase1Config, RunLogConfig, config_from, load_config
from siftwright.plans import phases
from siftwright.shared import shared_dir
from siftwright.sources import records as src
from siftwright.sources import sinks
from siftwright.sources.files import Files
from siftwright.streaming.records import dedup_stream, enrich_stream


def test_phases_end_to_end(spark, sf_dir, tmp_path):
    table = src.records_from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = Config()
    one = phases.prepare(spark, table, replace(base.phase1, data_dir=str(tmp_path)))
    assert one["snapshot"]["splits"] == {"train": 160, "validation": 20, "test": 20}
    again, snapshot = src.ingest(table, name="records")
    assert snapshot.snapshot_id == one["snapshot"]["snapshot_id"] and snapshot.snapshot_id.startswith("tm-")
    processed = tmp_path / "processed"
    kept = src.read_splits(spark, str(processed / "processed"))
    assert {"text_original", "text_clean", "text_fingerprint", "severity_bucket"} <= set(kept.columns)
    two = phases.enrich(spark, replace(base.phase2, data_dir=f"file:{tmp_path}"))
    assert two["augmentation"]["output_rows"] == spark.read.parquet(str(processed / "train_augmented")).count()
    assert src.train_source(spark, str(processed)).endswith("train_augmented")
    three = phases.finalize(spark, replace(base.phase3, data_dir=f"file://{tmp_path}", docs_dir=str(tmp_path / "docs")))
    assert {"passed", "summary", "exact_leakage", "near_leakage"} <= set(three["leakage_audit"])
    assert {"commands", "artifact_hashes_sha256", "content_hashes"} <= set(three["manifest"])
    assert three["adversarial_paraphrase"]["generated_rows"] > 0
    metadata = json.loads((processed / "metadata.json").read_text())
    assert {"snapshot", "config", "distribution_summary", "phase2", "phase3"} <= set(metadata)
    assert {"leakage_audit", "reproducibility_manifest", "package", "artifacts"} <= set(metadata["phase3"])
    with zipfile.ZipFile(processed / "package.zip") as packed:
        assert packed.testzip() is None and "phase3" in json.loads(packed.read("metadata.json"))
        digests = json.loads(packed.read("digests.json"))
        assert {n for n in packed.namelist() if n != "digests.json"} == set(digests)
        assert all(hashlib.sha256(packed.read(n)).hexdigest() == d for n, d in digests.items())
        assert any(n.startswith("processed/part-") and n.endswith(".parquet") for n in digests)
    runs = sinks.read_runs(spark, str(processed))
    assert [r["params"]["phase"] for r in runs] == ["phase2", "phase3"] and runs[1]["params"]["leakage_passed"] == str(three["leakage_audit"]["passed"])
    assert runs[0]["metrics"]["rows_train_augmented"] == two["augmentation"]["output_rows"]
    assert sinks.dataset_version(spark, str(processed))["dataset_train_rows"] == one["distribution_summary"]["train"]
    reports = {p.name for p in (processed / "reports").iterdir()}
    assert {"class_distribution.md", "validation_report.json", "dedup_report.json", "severity_buckets.json", "leakage_audit.json", "reproducibility_manifest.json"} <= reports


def test_snapshot_files_are_bounded_and_in_order(spark, tmp_path):
    n, most = 5000, 400
    rows = spark.range(n).select(F.expr("(id * 7919) % 5000").alias("row_idx"), F.expr("if(id % 10 < 8, 'train', 'test')").alias("split"), F.lit("x").alias("text"))
    sinks.write_snapshot(rows, str(tmp_path / "raw"), n, most)
    seen = {}
    for folder in sorted((tmp_path / "raw").glob("split=*")):
        for file in sorted(folder.glob("part-*")):
            own = [json.loads(line)["row_idx"] for line in file.read_text().splitlines()]
            assert 0 < len(own) <= most
            seen.setdefault(folder.name, []).extend(own)
    assert {k: len(v) for k, v in seen.items()} == {"split=train": 4000, "split=test": 1000}
    assert all(v == sorted(v) for v in seen.values())
    tasks = {f.name[5:10] for f in (tmp_path / "raw").glob("split=*/part-*")}
    assert len(tasks) >= n // most


def test_digests_and_archives_go_through_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "PIECE", 1000)
    data = {"a.bin": bytes(range(256)) * 5000, "b b%20.txt": b"x", "deep/c.json": b"{}\n"}
    for name, content in data.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")  # so no file can be one cell
    try:
        got = {r["path"].rpartition("/in/")[2]: r["sha256"] for r in sinks.artifact_hashes(spark, str(tmp_path / "in")).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {k: hashlib.sha256(v).hexdigest() for k, v in data.items()}
    files = Files(spark)
    assert files.sha256(f"{tmp_path}/in/a.bin") == hashlib.sha256(data["a.bin"]).hexdigest()
    files.zip(f"{tmp_path}/x.zip", [("a.bin", f"{tmp_path}/in/a.bin"), ("sub/note.txt", b"hello")])
    assert files.unzip(f"{tmp_path}/x.zip", f"{tmp_path}/out") == ["a.bin", "sub/note.txt"]
    assert (tmp_path / "out" / "a.bin").read_bytes() == data["a.bin"] and (tmp_path / "out" / "sub" / "note.txt").read_bytes() == b"hello"
    files.zip(f"{tmp_path}/y.zip", [("../evil", b"x")])
    with pytest.raises(ValueError, match="outside"):
        files.unzip(f"{tmp_path}/y.zip", f"{tmp_path}/out")


def test_a_killed_run_goes_on(spark, sf_dir, tmp_path, monkeypatch):
    source = src.records_from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 60"))
    config, calls = Phase1Config(data_dir=str(tmp_path)), []
    tables = ("write_snapshot", "write_table")
    for name in tables:
        monkeypatch.setattr(sinks, name, lambda df, path, *a, f=getattr(sinks, name): calls.append(path.rpartition("/")[2]) or f(df, path, *a))
    made = lambda: [c for c in calls if c != "class_distribution"]

    def prepared(source, config):
        calls.clear()
        return phases.prepare(spark, source, config)["distribution_summary"]

    whole = prepared(source, config)
    assert made() == ["records", "unique", "processed"]
    assert prepared(source, config) == whole and made() == []
    files = Files(spark)
    files.write_json({}, f"{tmp_path}/ledger/processed.json")  # killed while it wrote the last table
    assert prepared(source, config) == whole and made() == ["processed"]
    assert prepared(source, replace(config, drop_invalid_rows=False)) != whole and made() == ["processed"]
    assert prepared(source.filter("row_idx < 30"), config) != whole and made() == ["records", "unique", "processed"]
    in_memory = spark.createDataFrame(source.collect(), source.schema)
    assert prepared(in_memory, config) == whole and made() == ["records", "unique", "processed"]
    assert prepared(in_memory, config) == whole and made() == ["records", "unique", "processed"]  # no files, no state


def test_two_writers_of_runs(spark, tmp_path):
    assert sinks.read_runs(spark, str(tmp_path)) == [] and sinks.log_run(spark, str(tmp_path)) is None
    Files(spark).write_json({"snapshot": {"snapshot_id": "tm-1", "splits": {"train": 3}}}, f"{tmp_path}/metadata.json")
    with ThreadPoolExecutor(2) as pool:
        ids = set(pool.map(lambda n: sinks.log_run(spark, str(tmp_path), n), ("a", "b")))
    table = sinks.runs(spark, str(tmp_path))
    assert {r["run_id"] for r in table.collect()} == ids and len(ids) == 2
    assert {(r["name"], r["metrics"]["rows_raw_train"]) for r in table.collect()} == {("a", 3), ("b", 3)}


def test_reports_of_free_text_are_bounded(spark, tmp_path):
    rows = spark.range(5000).selectExpr("'train' as split", "id as row_idx", "1 as intent_label", "concat('t', if(id < 3000, id, 7)) as technique")
    told = sinks.write_distribution_reports(rows, str(tmp_path))
    assert len(told["train"]["technique"]) == sinks.VALUES and told["train"]["technique"]["t7"] == 2001
    assert told["train"]["others"] == {"technique": {"values": 2000, "rows": 2000}} and told["train"]["row_count"] == 5000
    table = spark.read.parquet(f"{tmp_path}/class_distribution").filter("dimension = 'technique'")
    assert table.count() == 3000 and table.agg(F.sum("n")).first()[0] == 5000


def test_missing_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        src.read_table(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        src.train_source(spark, str(tmp_path))
    with pytest.raises(SystemExit):
        cli.main(["--phase", "1"])


def test_config_defaults():
    config = config_from({"seed": 7, "data": {"lowercase": True}, "phase2": {"mlflow": {"enabled": False}}})
    assert config.phase1.seed == 7 and config.phase1.cleaning.lowercase
    assert not config.phase3.run_log.enabled
    assert config_from(None) == Config()
    file = load_config(Path(__file__).parent.parent / "configs" / "data.yaml")
    assert (file.phase1.seed, file.phase1.near_duplicate_threshold, file.phase2.balancing_strategy, file.phase3.leakage_sample_limit) == (42, 0.85, "oversample_median", 2000)
    log = config_from({"phase2": {"mlflow": {"experiment_name": "two"}}, "phase3": {"mlflow": {"enabled": False}, "leakage_sample_limit": None}})
    assert log.phase2.run_log == RunLogConfig(True, "two") and log.phase3.run_log == RunLogConfig(False) and log.phase3.leakage_sample_limit is None
    assert config_from({"dedup": {"near_duplicate_mode": "lsh"}, "data": {"data_dir": "x/"}}).phase1 == Phase1Config(near_duplicate_mode="lsh", data_dir="x")
    with pytest.raises(ValueError, match="near_duplicate_mode"):
        config_from({"dedup": {"near_duplicate_mode": "other"}})


def test_streams(spark, sf_dir, tmp_path):
    table = src.records_from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).selectExpr("*", "timestamp'2024-01-01 00:00:00' as at")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = enrich_stream(dedup_stream(stream, "at")).writeStream.format("memory").queryName("enriched").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("enriched")
    assert got.count() == table.selectExpr("split", "lower(trim(text)) as t").distinct().count()
    assert {"issues", "obfuscation_types", "text_clean"} <= set(got.columns)


def test_queries_run_the_phases_only_as_far_as_they_read(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(phase_queries, "_DONE", {})
    ran = []
    for name in ("take_snapshot", "prepare", "enrich", "finalize"):
        monkeypatch.setattr(phases, name, lambda *a, name=name, step=getattr(phases, name): (ran.append(name), step(*a))[1])
    assert phase_queries.raw_records(spark, sf_dir).count() == 200 and phase_queries.snapshot_splits(spark, sf_dir).count() == 3
    assert ran == ["take_snapshot"]
    held = {p.name for p in Path(shared_dir(spark)).iterdir()}
    assert phase_queries.validation_report_file(spark, sf_dir).count() > 0
    assert ran[1] == "prepare" and set(ran) == {"take_snapshot", "prepare"}
    assert {p.name for p in Path(shared_dir(spark)).iterdir()} == held  # no table of dedup is left behind


def test_tables_take_little_space(spark, sf_dir, tmp_path):
    source = src.records_from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = Config()
    phases.prepare(spark, source, replace(base.phase1, data_dir=str(tmp_path)))
    raw, processed = tmp_path / "raw" / "records", tmp_path / "processed"
    size = lambda folder, pattern="*": sum(p.stat().st_size for p in folder.rglob(pattern) if p.is_file())
    assert {p.name.rpartition(".")[2] for p in raw.glob("split=*/part-*")} == {"gz"}
    back = spark.read.schema(source.schema).json(str(raw)).select(source.columns)
    assert back.exceptAll(source).isEmpty() and back.count() == source.count()
    assert spark.read.parquet(str(processed / "unique")).columns == ["split", "row_idx"]
    names = [p.name for t in ("unique", "processed") for p in (processed / t).rglob("*.parquet")]
    assert names and all(".zstd." in n for n in names)
    phases.enrich(spark, replace(base.phase2, data_dir=str(tmp_path)))
    phases.finalize(spark, replace(base.phase3, data_dir=str(tmp_path), docs_dir=str(tmp_path / "docs")))
    for name in ("processed", "train_augmented"):  # the package has the tables' files, once
        files = {p.name: p.stat().st_ino for p in (processed / name).glob("*.parquet")}
        assert files and {p.name: p.stat().st_ino for p in (processed / "package" / name).glob("*.parquet")} == files
    adversarial, augmented = (spark.read.parquet(str(processed / t)) for t in ("train_adversarial", "train_augmented"))
    base_rows = adversarial.filter("not is_adversarial_paraphrase").select(augmented.columns)
    assert base_rows.exceptAll(augmented).isEmpty() and base_rows.count() == augmented.count()
    assert adversarial.count() > 1.3 * augmented.count()
    assert size(processed / "train_adversarial", "*.parquet") < 1.6 * size(processed / "train_augmented", "*.parquet")


def test_tables_that_cannot_be_linked_are_copied(spark, tmp_path):
    files = Files(spark)
    spark.range(10).withColumn("split", F.lit("train")).write.partitionBy("split").parquet(str(tmp_path / "processed"))
    files.write_json({}, f"{tmp_path}/metadata.json")
    assert not files.link(f"{tmp_path}/processed", f"{tmp_path}/package/processed")  # the split is a folder's name
    sinks.package_dataset(spark, str(tmp_path), archive=False)
    assert spark.read.parquet(str(tmp_path / "package" / "processed")).count() == 10
    assert not list((tmp_path / "package" / "processed").glob("split=*"))


def test_archives_are_read_without_being_written(spark, tmp_path):
    files, found = Files(spark), {}
    files.zip(f"{tmp_path}/x.zip", [("a/1", b"one"), ("b/2", b"two")])
    assert files.unzip(f"{tmp_path}/x.zip", f"{tmp_path}/out", lambda name: name.startswith("a/"), found) == ["a/1", "b/2"]
    assert found == {"a/1": hashlib.sha256(b"one").hexdigest(), "b/2": hashlib.sha256(b"two").hexdigest()}
    assert [p.name for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.endswith(".crc")] == ["1"]
