"""Exact joins of similar sets, greedy along chains, and first matches between splits, against brute force."""

import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwright.functions.text import shingle_hashes
from siftwright.operators import components, dedup, leakage, records, similarity
from siftwright.shared import shared_dir

SCHEMA = "row_idx long, split string, text string"


def grams(text):
    w = text.split()
    return set(zip(w, w[1:], w[2:], strict=False)) or {tuple(w)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def clusters(seed, n, copies, edits, splits=("train", "validation", "test"), common=0):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        base = [f"c{c}t{i}" for i in range(40)]
        for _ in range(copies):
            w = [f"all{i}" for i in range(common)] + base
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return [(i * 3, rng.choice(splits), t) for i, t in enumerate(rows)]


def test_similar_pairs_by_lists(spark):
    rows = clusters(1, 8, 7, 4, splits=("train", "test"), common=12)
    sets = {r: grams(t) for r, _, t in rows}
    wanted = {(a, b) for a, s, _ in rows for b, u, _ in rows if a < b and s == u and jaccard(sets[a], sets[b]) >= 0.7}
    found = similarity.similar_pairs(similarity.shingle_sets(spark.createDataFrame(rows, SCHEMA)), 0.7).collect()
    assert {(r["l_row"], r["r_row"]) for r in found} == wanted and wanted
    assert all(abs(r["jaccard"] - jaccard(sets[r["l_row"]], sets[r["r_row"]])) < 1e-12 for r in found)


def first_of(rows, threshold):
    order = {"train": 0, "validation": 1, "test": 2}
    sets = {r: grams(t) for r, _, t in rows}
    out = set()
    for a, s, _ in rows:
        for target in order:
            found = [b for b, u, _ in rows if u == target and order[s] < order[u] and jaccard(sets[a], sets[b]) >= threshold]
            if found:
                out.add((s, target, a, min(found), round(jaccard(sets[a], sets[min(found)]), 4)))
    return out


@pytest.mark.parametrize("offered, common", [(8, 0), (2, 15)])
def test_first_matches_equal_brute_force(spark, monkeypatch, offered, common):
    monkeypatch.setattr(similarity, "OFFERED", offered)
    monkeypatch.setattr(similarity, "BLOCK", 40)
    rows = clusters(2, 9, 9, 7, common=common)
    rows += [(1000 + i, s, t) for i, (_, s, t) in enumerate(rows[:9])]  # equal sets in any split
    got = leakage.near_matches(spark.createDataFrame(rows, SCHEMA), 0.8, None).collect()
    assert {tuple(r) for r in got} == first_of(rows, 0.8)


def test_a_cluster_costs_a_verification_a_row(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(120)] = f"own{i}"
        rows.append((i, ("train", "test")[i % 2], " ".join(w)))
    counted = []

    def counting(candidates, lists, verified=similarity.verified):
        counted.append(candidates.count())
        return verified(candidates, lists)

    monkeypatch.setattr(similarity, "verified", counting)
    got = leakage.near_matches(spark.createDataFrame(rows, SCHEMA), 0.85, None)
    assert got.count() == 200
    assert sum(counted) <= 3 * 400  # pairs would be 40,000


def test_a_chain_takes_few_jobs(spark):
    words = [f"w{i}" for i in range(700)]
    rows = [(i, "train", " ".join(words[2 * i : 2 * i + 100])) for i in range(300)]  # each is similar to the next ones only
    sets = {i: grams(t) for i, _, t in rows}
    kept = []
    for i, _, _ in rows:
        if all(jaccard(sets[i], sets[k]) < 0.95 for k in kept[-5:]):
            kept.append(i)
    assert jaccard(sets[0], sets[1]) >= 0.95 > jaccard(sets[0], sets[2]) and len(kept) == 150
    tracker = spark.sparkContext.statusTracker()
    jobs = []
    for n in (75, 300):
        spark.sparkContext.setJobGroup(f"chain-{n}", "")
        got = dedup.near_deduplicate(spark.createDataFrame(rows[:n], SCHEMA), 0.95).select("row_idx").collect()
        jobs.append(len(tracker.getJobIdsForGroup(f"chain-{n}")))
        assert sorted(r["row_idx"] for r in got) == [k for k in kept if k < n]
    assert jobs[1] < jobs[0] + 60  # rounds as long as the chain would be some hundred


def test_components_too_large_for_a_task_go_on_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(dedup, "COMPONENT", 10)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, "train", " ".join(words[2 * i : 2 * i + 100])) for i in range(20)]
    got = dedup.near_deduplicate(spark.createDataFrame(rows, SCHEMA), 0.95).select("row_idx").collect()
    assert sorted(r["row_idx"] for r in got) == list(range(0, 20, 2))


def test_star_forest_of_structs(spark):
    edges = [(1, 2), (2, 3), (3, 3), (9, 8), (8, 9), (20, 21)]
    node = lambda c: F.struct(F.lit("s").alias("split"), F.col(c).alias("row_idx"))
    df = spark.createDataFrame(edges, "x long, y long").select(node("x").alias("a"), node("y").alias("b"))
    got = {(r["a"]["row_idx"], r["b"]["row_idx"]) for r in components.star_forest(df).collect()}
    assert got == {(2, 1), (3, 1), (9, 8), (21, 20)}
    assert components.star_forest(df.limit(0)).count() == 0


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert dedup.near_deduplicate(df).count() == 0 and dedup.near_duplicate_pairs(df).count() == 0
    assert leakage.near_matches(df, 0.85, None).count() == 0 and dedup.near_deduplicate(df, mode="lsh").count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.85, 0.95, 1.0])
def test_similar_sets_share_a_signature(threshold):
    rng = np.random.default_rng(5)
    for n in [*range(1, 60), 100, 333, 1000] * 4:
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        gone = rng.integers(0, n)
        for less, more in ((int(n * (1 - threshold) + 1e-9), 0), (0, int(n / threshold + 1e-9) - n), (gone, max(0, int((n - gone) / threshold + 1e-9) - n))):
            if less < n and (n - less) / (n + more) >= threshold - 1e-12:
                b = np.concatenate([a[less:], rng.integers(0, 2**64, more, dtype=np.uint64)])
                row, signature = similarity.part_signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), threshold)
                assert set(signature[row == 0]) & set(signature[row == 1])


def test_lists_across_splits_hold_no_signature_of_one_split(spark):
    rows = clusters(4, 12, 6, 3)
    sets = similarity.collapsed(similarity.shingle_sets(spark.createDataFrame(rows, SCHEMA)))[0]
    by = lambda lists: {(r["h"], r["split"]) for r in lists.prefix.collect()}
    every, across = by(similarity.inverted_lists(sets, 0.8)), by(similarity.inverted_lists(sets, 0.8, across=True))
    several = {h for h, _ in every if len({s for k, s in every if k == h}) > 1}
    assert across == {(h, s) for h, s in every if h in several} and len(across) < len(every)


def test_buckets_too_large_to_sort_at_once(monkeypatch):
    rng, rows = np.random.default_rng(6), []
    for _ in range(200):
        h = np.unique(rng.integers(0, 300, 4).astype(np.uint64))
        rows.append((rng.choice(["a", "b"]), h, rng.integers(0, 10**6, len(h)), np.full(len(h), 7, np.int32)))
    packed = [pa.array([x[i].tobytes() for x in rows], pa.binary()) for i in (1, 2, 3)]
    batches = pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows]), *packed], names=["split", "h", "row", "n"])
    wanted = [(s, i, 7, k) for s, h, row, _ in rows for k, i in zip(h.tolist(), row.tolist(), strict=True)]
    uses = Counter(k for *_, k in wanted)
    wanted = sorted(x for x in wanted if uses[x[3]] > 1)
    for held in (1, 50, 10**6):
        monkeypatch.setattr(similarity, "HELD", held)
        got = [tuple(r.values()) for b in similarity._met(iter([batches.slice(0, 70), batches.slice(70)]), False) for r in b.to_pylist()]
        assert sorted(got) == wanted


def test_hashes_of_texts_are_sets_of_word_3_grams():
    rng = random.Random(7)
    long = "x" * 64
    texts = ["", "a", "a b", "b a", "ab", "a b c", "a b c a b c", "é a-b c", f"{long} {long}y {long}yz", f"{long} {long}y {long}yy", "abcdefgh abcdefghi a", ""]
    texts += [" ".join(rng.choice(["u", "vv", "w3", "xyzxyzxyz", "..", "ßa"]) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    data = [t.encode() for t in texts]
    values, n = shingle_hashes(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(t) for t in data]))
    of, at = {}, 0
    for text, k in zip(texts, n.tolist(), strict=True):
        words = re.findall("[a-z0-9]+", text)
        grams = {tuple(words[i : i + 3]) for i in range(len(words) - 2)} or {tuple(words)}
        hashes = values[at : at + k].tolist()
        assert len(hashes) == len(grams) and hashes == sorted(set(hashes))
        assert of.setdefault(frozenset(grams), hashes) == hashes
        at += k
    assert len({tuple(h) for h in of.values()}) == len(of) and at == len(values)
    each = {}  # a 3-gram has one hash, wherever it stands
    for grams, hashes in of.items():
        for g in grams:
            each[g] = each.get(g, set(hashes)) & set(hashes)
    assert all(each.values())


def test_signatures_of_the_same_rows_are_listed_once(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(i, "train", " ".join([*words[:150], f"own{i}", *words[150:]])) for i in range(2)]
    lists = similarity.inverted_lists(similarity.shingle_sets(spark.createDataFrame(rows, SCHEMA)), 0.85)
    assert lists.prefix.count() == 2  # some fifty parts are alike
    assert similarity.verified(similarity.candidates(lists), lists).count() == 1


def test_summary_reads_texts_once(spark):
    rows = [*clusters(5, 4, 6, 3), (901, "train", "One and the same"), (902, "test", "one and  the same"), (903, "test", " "), (904, "train", "  ")]
    df, seen = spark.createDataFrame(rows, SCHEMA), spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    got = leakage.leakage_summary(df.withColumn("text", F.udf(read, "string").asNondeterministic()("text")), limit=None).first()
    assert seen.value == len(rows)
    exact, near = leakage.exact_leakage(df).collect(), leakage.near_leakage(df, limit=None).collect()
    assert (got["exact_leak_pairs"], got["total_exact_overlaps"]) == (len(exact), sum(r["n"] for r in exact)) and exact
    assert (got["near_leak_pairs"], got["total_near_overlaps"]) == (len(near), sum(r["n"] for r in near)) and near


def test_exact_leakage_shuffles_digests(spark):
    df = spark.createDataFrame([(1, "train", "long " * 50_000), (2, "test", "long " * 50_000), (3, "test", "")], SCHEMA)
    assert [tuple(r) for r in leakage.exact_leakage(df).collect()] == [("train", "test", 1)]
    shared = leakage.shared_fingerprints(df).collect()
    assert [tuple(r) for r in shared] == [("long " * 49_999 + "long", "train", "test")]
    plan = leakage.exact_leakage(df)._jdf.queryExecution().executedPlan().toString()
    assert "sha2" in plan and "collect_set" not in plan


def test_summary_normalizes_once_more(spark):
    texts = [(1, "train", "Caf\u00e9 one two three"), (2, "test", "cafe\u200b\u0301 ONE two three"), (3, "validation", "cafe\u200b\u0301 one two three"), (4, "test", "cafe one two three")]
    df = records.clean_records(spark.createDataFrame(texts, SCHEMA))
    got = leakage.leakage_summary(df, limit=None, cleaned=True)
    assert (got.first()["exact_leak_pairs"], got.first()["total_exact_overlaps"]) == (3, 3)
    assert leakage.exact_leakage(df, cleaned=True).count() == 3


def test_sets_are_never_written_whole(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, ("train", "test")[i % 2], " ".join(f"w{rng.randrange(500)}" for _ in range(2000))) for i in range(60)]
    rows += [(100, "train", rows[0][2] + " end"), (101, "test", rows[1][2] + " end"), (102, "test", rows[0][2])]
    df, folder, seen = spark.createDataFrame(rows, SCHEMA), Path(shared_dir(spark)), []
    held = lambda: {p: p.stat().st_size for p in folder.rglob("*.parquet")}
    before = held()

    def watched(df, name, *a, f=similarity.written, **options):
        table = f(df, name, *a, **options)
        seen.append(sum(n for p, n in held().items() if p not in before))
        return table

    monkeypatch.setattr(similarity, "written", watched)
    monkeypatch.setattr(leakage, "written", watched, raising=False)
    assert [(r["l_row"], r["r_row"]) for r in dedup.near_duplicate_pairs(df).orderBy("l_row").collect()] == [(0, 100), (1, 101)]
    assert dedup.near_deduplicate(df).count() == 61
    assert {(r["row_idx"], r["matched_row"]) for r in leakage.near_matches(df, 0.85, None).collect()} == {(0, 102), (100, 102)}
    assert max(seen) < 0.7 * 8 * 2000 * len(rows)  # a table of all hashes


def test_signatures_are_packed_in_few_bytes(spark):
    rng = random.Random(8)
    ids = [-(1 << 63), -5, *range(0, 4000, 10), (1 << 63) - 1]
    rows = [(i, rng.choice(["train", "test", None]), " ".join(f"w{rng.randrange(9999)}" for _ in range(rng.choice([0, 1, 40, 300, 4000 if i < 200 else 5])))) for i in ids]
    sets = spark.createDataFrame(rows, SCHEMA).transform(similarity.shingle_sets).repartition(3)
    wanted = []
    for r in sets.collect():
        _, h = similarity.part_signatures(np.array(r["hashes"]).view(np.uint64), np.array([r["n"]]), 0.85)
        h = h.view(np.uint64)
        wanted += [(r["split"], r["row_idx"], r["n"], int(x) & ((1 << 40) - 1), ((int(x) >> 32) * 7) >> 32) for x in h]
    packed = similarity.signatures(sets, 0.85, 7).toArrow()
    got = []
    for b in similarity._unpacked(iter(packed.to_batches())):
        r = b.to_pylist()[0]
        h, row, n = (np.frombuffer(r[c], t).tolist() for c, t in (("h", np.uint64), ("row", np.int64), ("n", np.int32)))
        got += [(r["split"], *x[1:], x[0] & ((1 << 40) - 1), x[0] >> 40) for x in zip(h, row, n, strict=True)]
    text = lambda rows: sorted(map(str, rows))
    assert text(got) == text(wanted)
    plain = similarity.signatures(sets.filter("row_idx between 0 and 5000"), 0.85, 7).select(F.expr("sum(length(h) + length(row) + length(n)) / sum(length(h) / 5)")).first()[0]
    assert plain <= 10


def test_pairs_are_verified_in_pieces(spark, monkeypatch):
    rows = [(i, s, t) for i, s, t in clusters(9, 8, 7, 6)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = lambda: sorted(map(tuple, dedup.near_duplicate_pairs(df, 0.8).collect()))
    whole = found()
    monkeypatch.setattr(similarity, "ONCE", 50)
    assert whole and found() == whole
