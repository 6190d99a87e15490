import random
import re

import numpy as np
import pytest
import xxhash

from siftwright.llm import common, components, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest index reachable over links of 4 or fewer bits."""
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(prints))]


def test_fingerprint():
    for text in (None, "", " \t", "One", "a b c", "A b c d", "é ü X Y z z z z z z", "w " * 40_000, "x\x85y\u00a0z q r s"):
        assert simhash.fingerprint(text) == brute_print(text)


def test_code_covers_and_replicas_meet():
    home, _, _ = simhash._near_words()
    assert len(simhash._hamming_words()) == 2048
    assert max((int(h) ^ i).bit_count() for i, h in enumerate(home)) == 1
    rng = random.Random(3)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), rng.randint(1, 4)):
            y ^= 1 << bit
        anchor, owner, is_home = simhash.anchors_of(np.array([x, y], np.uint64))
        homes = set(anchor[(owner == 0) & is_home].tolist())
        assert homes & set(anchor[owner == 1].tolist())


@pytest.mark.parametrize("heavy", [1, 9, 10_000])
def test_groups_equal_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    monkeypatch.setattr(common, "LIGHT", 2)
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", "  ", None]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 8)):
            other = list(base)
            for _ in range(rng.randint(0, 4)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            texts.append(" ".join(other).upper() if rng.random() < 0.2 else " ".join(other))
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, component_id string")
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.group_near_duplicates(df).collect()}
    prints = [brute_print(t) for t in texts]
    wanted = brute_components(prints)
    assert [got[i] for i in range(len(texts))] == list(zip(prints, wanted, strict=True))
    assert len(set(wanted)) < len(set(prints))
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(wanted))


def test_dense_and_hot_cells(spark, monkeypatch):
    rng = random.Random(2)
    seed = rng.getrandbits(64)
    prints = {seed}
    while len(prints) < 250:  # a ball of near fingerprints, and others
        x = rng.choice(sorted(prints)) if rng.random() < 0.8 else rng.getrandbits(64)
        for bit in rng.sample(range(64), rng.randint(1, 3)):
            x ^= 1 << bit
        prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    wanted = brute_components(prints)
    for cell, dense in ((4096, 4096), (16, 64)):
        monkeypatch.setattr(simhash, "CELL", cell)
        monkeypatch.setattr(simhash, "DENSE", dense)
        label = {p: i for i, p in enumerate(prints)}
        links = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in simhash.near_links(df).collect()]
        assert all(0 < (a ^ b).bit_count() <= 4 for a, b in links)
        parent = list(range(len(prints)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in links:
            x, y = sorted((root(label[a]), root(label[b])))
            parent[y] = x
        assert [root(i) for i in range(len(prints))] == wanted


def test_repeated_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "b", "p"), (1, "b", "q"), (None, "zz yy", "r"), (None, "zz yy", "s"), (2, "B", "t"), (1, "", "u"), (0, " ", "v"), (None, "other words here too", "w")], "doc_id long, text string, x string")
    kept = simhash.keep_one_of_each(df).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, " "), (0, "other words here too"), (0, "zz yy"), (1, "b")]
    assert simhash.keep_one_of_each(df.limit(0)).count() == 0


@pytest.mark.parametrize("light", [2, 1000])
def test_components(spark, monkeypatch, light):
    monkeypatch.setattr(common, "LIGHT", light)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    stars = components.star_forest(spark.createDataFrame(edges, "a long, b long"))
    got = {r["a"]: r["b"] for r in stars.collect()}
    parent = {v: v for e in edges for v in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert {v: got.get(v, v) for v in parent} == {v: root(v) for v in parent}
    assert components.star_forest(spark.createDataFrame([], "a long, b long")).count() == 0
