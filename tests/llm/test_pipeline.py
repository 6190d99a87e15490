"""The pipeline's stages, one after the other, against brute force on planted documents."""

import random

import corpus_pipeline
import pytest

from siftwright.llm import decontam, mixing


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(8)
    make = lambda n, of: " ".join(f"{of}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}" + rng.choice("bcdfg") * (rng.random() < 0.7) + str(rng.randrange(9)) * 0 + rng.choice("aeiouy") for _ in range(n))
    rows = []
    for i in range(120):
        lang = ("en", "de")[i % 2]
        rows.append((i, make(rng.randint(60, 200), "th" if lang == "en" else "sch"), lang, f"s{i % 3}"))
    passage = make(70, "th")
    item = make(15, "th")
    for i in (10, 40):
        rows[i] = (i, rows[i][1] + " " + passage, *rows[i][2:])
    rows[50] = (50, rows[50][1] + " " + item, *rows[50][2:])
    rows[60] = (60, rows[20][1], *rows[60][2:])
    rows[70] = (70, "12345 !!", "en", "s1")
    path = str(tmp_path_factory.mktemp("tables"))
    df = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, passage, item


def test_stages(spark, planted):
    path, rows, passage, item = planted
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    everything = set(range(120))
    names = [n for n, _ in corpus_pipeline.STAGES]
    stage = dict(corpus_pipeline.STAGES)
    assert names == ["language", "near_duplicates", "repeated_passages", "benchmark_leaks", "source_mix"]
    one = stage["language"](spark, docs, path)
    assert ids(one) == everything - {70} and one.columns == columns
    two = stage["near_duplicates"](spark, one, path)
    assert ids(two) == everything - {70, 60} and two.columns == columns
    three = stage["repeated_passages"](spark, two, path)
    texts = {r["doc_id"]: r for r in three.collect()}
    assert three.columns == columns and set(texts) == everything - {70, 60}
    assert passage in texts[10]["text"] and passage not in texts[40]["text"]
    assert texts[40]["n_chars"] == len(texts[40]["text"])
    assert all(texts[i]["text"] == rows[i][1] for i in texts if i != 40)
    four = stage["benchmark_leaks"](spark, three, path)
    assert ids(four) == everything - {70, 60, 50} and four.columns == columns
    five = stage["source_mix"](spark, four, path).collect()
    wanted = {(r["doc_id"], k + 1) for r in mixing.mix(four).collect() for k in range(r["_sw_copies"])}
    assert {(r["doc_id"], r["mix_copy"]) for r in five} == wanted
    got = {(r["doc_id"], r["mix_copy"], r["text"]) for r in corpus_pipeline.run(spark, path).collect()}
    assert got == {(r["doc_id"], r["mix_copy"], r["text"]) for r in five}
    assert decontam.judge(four, spark.read.parquet(f"{path}/benchmark.parquet")).filter("contaminated").count() == 0


def test_empty_tables(spark, planted):
    path = planted[0]
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    assert docs.count() == 0


def test_run_goes_on_from_finished_stages(spark, planted, tmp_path, monkeypatch):
    path, *_ = planted
    rows = lambda d: sorted((r["doc_id"], r["mix_copy"], r["text"]) for r in d.collect())
    whole = rows(corpus_pipeline.run(spark, path))
    calls = []
    counted = [(n, lambda s, d, f, n=n, stage=stage: calls.append(n) or stage(s, d, f)) for n, stage in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", counted)
    folder = str(tmp_path / "run")
    assert rows(corpus_pipeline.run(spark, path, folder)) == whole and len(calls) == 5
    assert rows(corpus_pipeline.run(spark, path, folder)) == whole and calls[5:] == ["source_mix"]
    (tmp_path / "run" / "repeated_passages" / "_SUCCESS").unlink()
    assert rows(corpus_pipeline.run(spark, path, folder)) == whole and calls[6:] == ["repeated_passages", "source_mix"]
