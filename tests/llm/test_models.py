"""Language and toxicity: held-out accuracy, folds, nulls and empty tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from siftwright.llm import langid, toxicity

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_language_on_held_out(spark, docs):
    got = langid.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    rows = [(0, "le la les", "fr"), (1, "the and of", "en"), (3, None, "en"), (4, "123 !?", "fr"), (5, "", None), (None, "the of", None), (1, "the and of", "en"), (6, "of the " * 300_000, "en")]
    rows += [(7, "\u00b2 \u00bd", None), (8, "\u2460 \u2167 \u0663 _", None), (9, "\u00b2 the \u00bd of", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as score", "1 as lang_pred")
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.predict_languages(df).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (0, "fr"), (1, "en"), (None, "en"), (6, "en"), (7, "und"), (8, "und"), (9, "en")} == got
    assert langid.predict_languages(df.limit(0)).count() == 0
    nobody = langid.predict_languages(df.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r["lang_pred"] for r in nobody} == {"und"}


def plain_letters(text):
    out = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    return f" {' '.join(out.split())} " if any(c.isalpha() for c in (text or "")) else ""


def plain_grams(text):
    """Buckets of n-grams, one at a time."""
    letters = plain_letters(text)
    return [int(langid.buckets_of(letters[i : i + n])[-1]) for n in langid.ORDERS for i in range(len(letters) - n + 1)]


def test_language_equals_plain_naive_bayes(spark, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 50)
    rng = random.Random(3)
    syllables = {"aa": ["lo", "mi", "ra"], "bb": ["kur", "ze", "mi"], "cc": ["\u00e9a", "ti", "ra"]}
    rows = [(i, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(rng.randint(1, 60))) + rng.choice(["", " 12 \u00bd", ". X"]), lang) for i in range(90) for lang in [rng.choice("aabbcc")  * 2]]
    rows += [(200, None, "aa"), (201, "?", "bb"), (202, "lomira", None)]
    counts, sizes = {}, Counter()
    for i, text, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 4 != 2:
            sizes[lang] += 1
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    total = {lang: sum(c.values()) + langid.SMOOTHING * langid.BUCKETS for lang, c in counts.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = {r["doc_id"]: r for r in langid.predict_languages(df).collect()}
    for i, text, _ in rows:
        grams = plain_grams(text)
        if not grams:
            assert (told[i]["lang_pred"], told[i]["score"]) == ("und", 0.0)
            continue
        sums = {lang: math.log(sizes[lang] / sizes.total()) + sum(math.log((counts[lang][g] + langid.SMOOTHING) / total[lang]) for g in grams) for lang in sorted(counts)}
        best = max(sums, key=sums.get)
        assert told[i]["lang_pred"] == best
        assert abs(told[i]["score"] - 1 / sum(math.exp(v - sums[best]) for v in sums.values())) < 1e-3


def test_languages_are_bounded(spark):
    rows = [(i, f"word{i % 7}x", f"l{i % 7}") for i in range(70)] + [(100 + i, "common", "main") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(df, most_languages=1).languages == ("main",)
    assert len(langid.fit(df).languages) == 8


def test_language_never_learns_from_the_fold(spark, docs):
    other = docs.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 'zz' else lang end as lang")
    assert "zz" not in {r["lang_pred"] for r in langid.predict_languages(other).select("lang_pred").distinct().collect()}


def test_toxicity_on_held_out(spark):
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = toxicity.score_documents(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    toxic, clean = [r for r in got if r["toxic"] == 1], [r for r in got if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) >= 0.75 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.03 * len(clean)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "fine words", 9), (None, "vile words", 9), (3, "fine words", 9)], "doc_id long, text string, score int")
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.score_documents(docs, empty).collect()} == {0}
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, None), (77, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_toxicity_sample_ignores_absent_and_repeated_documents(spark):
    words = lambda i: f"plain talk number{i} " + ("vile" if i % 4 == 0 else "kind")
    docs = spark.createDataFrame([(i, words(i)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int")
    plain = toxicity.fit(docs, labels, per_class=10)
    noise = labels.union(spark.createDataFrame([(1000 + i, 1) for i in range(3000)], "doc_id long, toxic int"))
    again = docs.union(docs.filter("doc_id = 4").crossJoin(spark.range(500)).select("doc_id", "text"))
    other = toxicity.fit(again, noise, per_class=10)
    assert np.array_equal(plain.buckets, other.buckets) and np.allclose(plain.embeddings, other.embeddings) and np.allclose(plain.bias, other.bias)
    assert len(toxicity.bag_of(" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)), 100)) == 100


def test_toxicity_equals_plain_python():
    """The model of one training step and scores, by loops over documents, words and subwords."""
    rng = random.Random(6)
    names = ["vile", "vilest", "kind", "kinder", "garden", "stone", "river"]
    bags = [(i % 2, sorted(set(rng.choices(names[2 * (i % 2) :], k=4)))) for i in range(40)]
    steps, toxicity.STEPS = toxicity.STEPS, 3
    try:
        model = toxicity.train(bags, 0.3)
        toxicity.STEPS = 2
        before = toxicity.train(bags, 0.3)
    finally:
        toxicity.STEPS = steps
    grams = {n: toxicity.subwords([n])[0].tolist() for n in names}
    uses = Counter(g for _, own in bags for n in own for g in grams[n])
    active = sorted(g for g, n in uses.items() if n >= max(2, toxicity.MIN_SHARE * len(bags)))
    assert model.buckets.tolist() == active
    place = {g: i for i, g in enumerate(active)}
    shift = toxicity.ODDS_POWER * math.log(0.3 / 0.7)

    def margins(m, own):
        total, n = [0.0] * toxicity.DIM, 0
        for name in own:
            for g in grams[name]:
                n += 1
                for d in range(toxicity.DIM):
                    total[d] += float(m.embeddings[d, place[g]]) if g in place else 0.0
        return [sum(float(m.softmax[c, d]) * total[d] / n for d in range(toxicity.DIM)) for c in (0, 1)], n

    for _, own in bags:
        (a, b), _ = margins(model, own)
        wanted = 1 / (1 + math.exp(a + float(model.bias[0]) - b - float(model.bias[1])))
        assert abs(model.scorer().score(" ".join(own)) - wanted) < 1e-5
    # the bias' gradient at the second step's state is what the third step follows
    slope, sizes = [0.0, 0.0], Counter(label for label, _ in bags)
    for label, own in bags:
        (a, b), _ = margins(before, own)
        p = 1 / (1 + math.exp(a + float(before.bias[0]) - b - (float(before.bias[1]) - shift)))
        for c, q in ((0, 1 - p), (1, p)):
            slope[c] += (q - (label == c)) * 0.5 / sizes[label]
    moved = (model.bias - before.bias).tolist()
    assert abs(slope[0] + slope[1]) < 1e-9 and moved[0] * moved[1] < 0


def test_training_follows_the_loss_gradient():
    """A first step's direction against finite differences of the loss, computed by plain loops."""
    bags = [(0, ["kind", "stone"]), (0, ["kind"]), (1, ["vile", "stone"]), (1, ["vile"])]
    steps, toxicity.STEPS = toxicity.STEPS, 1
    try:
        model = toxicity.train(bags, 0.5)
    finally:
        toxicity.STEPS = steps
    rng = np.random.default_rng(7)
    first = rng.normal(0, 0.01, model.embeddings.shape).astype(np.float32).astype(float)
    softmax = rng.normal(0, 3.0, (2, toxicity.DIM)).astype(np.float32).astype(float)
    grams = {n: toxicity.subwords([n])[0].tolist() for n in ("kind", "stone", "vile")}
    place = {g: i for i, g in enumerate(model.buckets.tolist())}

    def loss(embeddings):
        out = 0.0
        for label, own in bags:
            all_grams = [g for n in own for g in grams[n]]
            mean = sum((embeddings[:, place[g]] for g in all_grams if g in place), np.zeros(toxicity.DIM)) / len(all_grams)
            logits = softmax @ mean
            out += 0.25 * (math.log(sum(math.exp(v) for v in logits)) - logits[label])
        return out

    moved = model.embeddings - first * (1 - toxicity.DECAY)
    for at in range(0, moved.shape[1], 3):
        for d in range(toxicity.DIM):
            up, low = first.copy(), first.copy()
            up[d, at] += 1e-4
            low[d, at] -= 1e-4
            slope = (loss(up) - loss(low)) / 2e-4
            assert abs(slope) < 1e-6 or np.sign(moved[d, at]) == -np.sign(slope)


def test_misspellings_share_ngrams():
    clean = [(0, ["kind", "gentle", "garden", f"word{i}"]) for i in range(40)]
    toxic = [(1, ["kind", "horrible", "horribly", f"word{i}"]) for i in range(40)]
    scorer = toxicity.train(clean + toxic, 0.5).scorer()
    assert scorer.score("a horribble garden") > scorer.score("a gentle garden")
