"""Tables whose own columns are named like working columns; null and repeated ids in the mix."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from siftwright.llm import decontam, mixing, passages, simhash

#: Working names of the operators, and names that their results have.
NAMES = (
    *("_sw_id", "_sw_hash", "_sw_rows", "_sw_row", "_sw_key", "_sw_own", "_sw_text", "_sw_mark", "_sw_spans", "_sw_language", "_sw_copy"),
    *("_sw_size", "_sw_source", "_sw_rate", "_sw_target", "_sw_copies", "row", "key", "own", "cut", "id", "hash", "place", "salt", "told", "whole"),
    *("copies", "copy", "size", "source_size", "target", "again", "at", "of", "mix_copy", "fp", "component_id", "windows", "item_id", "a.b"),
)


def sentence(rng, n):
    return " ".join("th" + "".join(rng.choice("aeioulmnrst") for _ in range(5)) for _ in range(n))


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(4)
    passage = sentence(rng, 70)
    texts = [sentence(rng, 60) for _ in range(30)]
    texts[3] += " " + passage
    texts[7] += " " + passage
    texts[9] = texts[2]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in NAMES)), rows, passage


def own_columns(rows):
    return all(r[n] == f"{n}:{r['doc_id']}" for r in rows for n in NAMES)


def test_operators_keep_columns_of_any_name(spark, clashing):
    df, rows, passage = clashing
    kept = simhash.keep_one_of_each(df).collect()
    assert {r["doc_id"] for r in kept} == set(range(30)) - {9} and own_columns(kept)
    twice = simhash.keep_one_of_each(df.unionByName(df.filter("doc_id = 5"))).collect()
    assert sorted(r["doc_id"] for r in twice) == sorted(set(range(30)) - {9}) and own_columns(twice)
    cut = passages.drop_passages(df.filter("doc_id <> 9")).collect()
    by = {r["doc_id"]: r for r in cut}
    assert set(by) == set(range(30)) - {9} and own_columns(cut)
    assert passage in by[3]["text"] and passage not in by[7]["text"] and by[7]["n_chars"] == len(by[7]["text"])
    bench = spark.createDataFrame([(1, " ".join(rows[11][1].split()[:12]))], "item_id long, text string")
    clean = decontam.drop_contaminated(df, bench).collect()
    assert {r["doc_id"] for r in clean} == set(range(30)) - {11} and own_columns(clean)
    taken = mixing.taken_rows_of(df).collect()
    assert own_columns(taken) and {r["mix_copy_"] for r in taken} <= {1, 2}
    assert {c for c in df.columns} <= set(mixing.mix(df).columns)


def test_pipeline_stages_keep_columns_of_any_name(spark, clashing, tmp_path):
    df = clashing[0]
    spark.createDataFrame([(1, "no such words at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        assert own_columns(out.collect()), name
    assert own_columns(corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).collect())


def sums(rows):
    by = {}
    for r in rows:
        taken, _ = by.get(r["source"], (0, 0))
        by[r["source"]] = taken + r["_sw_size"] * r["_sw_copies"], r["_sw_target"]
    return by


@pytest.mark.parametrize("kind", ["no ids", "one id", "equal rows", "few texts"])
def test_targets_are_met_without_ids(spark, kind):
    rng = random.Random(6)
    rows = []
    for i in range(1500):
        text = "one two three" if kind == "equal rows" else " ".join("w" * rng.randint(1, 3 if kind == "few texts" else 40))
        rows.append((7 if kind == "one id" else None, text, ("a", "b", "c")[i % 3]))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    for taken, target in sums(got).values():
        assert abs(taken - target) < 0.1 * target
    result = lambda d: sorted((str(r["source"]), r["text"], r["_sw_copies"]) for r in d)
    assert result(mixing.mix(df.repartition(5)).collect()) == result(got)


def test_draws_of_rows_with_other_columns_differ(spark):
    df = spark.createDataFrame([(1, "a b c", "s", i) for i in range(900)], "doc_id long, text string, source string, k long")
    taken, target = sums(mixing.mix(df).collect())["s"]
    assert abs(taken - target) < 0.1 * target


def test_a_folder_of_another_input_is_made_anew(spark, clashing, tmp_path, monkeypatch):
    df = clashing[0].select("doc_id", "text", "lang", "source", "n_chars")
    for name, part in (("one", df), ("two", df.filter("doc_id < 12"))):
        part.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, "no such words at all")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    ids = lambda name: sorted({r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/{name}", f"{tmp_path}/run").collect()})
    alone = lambda name: sorted({r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()})
    first, second = ids("one"), ids("two")
    assert first == alone("one") and second == alone("two") and first != second
    calls = []
    counted = [(n, lambda s, d, f, n=n, stage=stage: calls.append(n) or stage(s, d, f)) for n, stage in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", counted)
    assert ids("two") == second and calls == ["source_mix"]
    monkeypatch.setattr(corpus_pipeline, "state", lambda *a: "other code")
    assert ids("two") == second and len(calls) == 6
