import random
import re

import pytest
from pyspark.sql import functions as F

from siftwright.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items):
    windows = {}
    for i, text in items:
        w = words(text)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    sizes = {len(x) for x in windows}
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (x := tuple(w[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[x]
        out.append((len(w), len(hit), len(found)))
    return out


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_judge_equals_brute_force(spark, monkeypatch, bits):
    field = decontam.bit_field
    monkeypatch.setattr(decontam, "bit_field", lambda hashes: field(hashes, bits))
    rng = random.Random(5)
    make = lambda n: [rng.choice("abcd") + str(rng.randrange(6)) for _ in range(n)]
    items = [(i, " ".join(make(rng.choice([0, 1, 3, 4, 5, 9, 10, 11, 30])))) for i in range(25)] + [(99, None), (3, "x y")]
    texts = [None, "", "--"]
    for _ in range(60):
        w = make(rng.randint(0, 80))
        source = words(rng.choice(items)[1])
        if source:
            at = rng.randint(0, len(w))
            w[at:at] = source[: rng.randint(1, len(source))]
        texts.append(rng.choice([" ", ", ", "\n"]).join(w).upper())
    docs = spark.createDataFrame([(i // 2 if i % 5 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontam.judge(docs.withColumn("hits", F.lit(1)), bench).collect())
    wanted = brute(texts, items)
    assert got == sorted((*x, x[1] > 0) for x in wanted)
    docs = docs.withColumns({"row": F.lit("r"), "windows": F.lit(1), "_id": F.lit(0)})
    left = decontam.drop_contaminated(docs, bench)
    assert left.count() == sum(x[1] == 0 for x in wanted) and left.columns == docs.columns
    assert decontam.judge(docs.limit(0), bench).count() == 0
    clean = decontam.judge(docs, bench.limit(0))
    assert clean.filter("contaminated").count() == 0 and clean.count() == len(texts)


def test_lower_is_ascii_only(spark):
    texts = ["ÀB É", "ABC", "İX", "ΣΑΣ", "ß Ⓐ", "ǅA", None]
    got = [r["x"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(decontam.ascii_lower(F.col("t")).alias("x")).collect()]
    assert got == [t and re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in texts]


def test_winnow_keeps_a_common_hash(spark):
    rng = random.Random(9)
    for _ in range(20):
        common = [f"c{rng.randrange(99)}" for _ in range(10)]
        both = [(i, [f"w{rng.randrange(99)}" for _ in range(rng.randint(0, 30))] + common + [f"w{rng.randrange(99)}"]) for i in range(2)]
        kept = [set(r["k"]) for r in spark.createDataFrame(both, "i int, w array<string>").select(decontam.winnow(F.col("w")).alias("k")).collect()]
        assert kept[0] & kept[1]
