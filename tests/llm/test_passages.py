import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwright.llm import passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=7, n=60):
    """Documents with planted passages: exact, edited, nested, repeated; and clean ones."""
    rng = random.Random(seed)
    make = lambda k: [f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(k)]
    shared = [make(rng.randint(52, 140)) for _ in range(5)]
    texts, holds = [], []
    for i in range(n):
        words, held = make(rng.randint(0, 300)), None
        if i % 3 == 0:
            held = i // 3 % 5
            inside = list(shared[held])
            if i % 2:
                inside[len(inside) // 2] = "edited"
            at = rng.randint(0, len(words))
            words[at:at] = inside
        texts.append(" ".join(words))
        holds.append(held)
    return texts, holds


def test_word_hashes_are_those_of_the_words():
    texts = ["A b\tc", None, "", " é  B a", "x" * 5000 + " " + "y" * 9000 + "x", "\x0b\x1c a", "b", "\n", "日本 " * 40]
    for piece in (passages.PIECE, 7):
        passages.PIECE, before = piece, passages.PIECE
        hashes, first = passages.words_of(pa.array(["dropped", *texts, "also"])[1:-1])
        passages.PIECE = before
        words = [w.lower() if w.isascii() else w for t in texts for w in WORD.findall(t or "")]
        assert first.tolist() == np.cumsum([0] + [len(WORD.findall(t or "")) for t in texts]).tolist()
        assert [words[i] for i in np.unique(hashes, return_index=True)[1]] == [words[words.index(words[i])] for i in np.unique(hashes, return_index=True)[1]]
        assert len(set(hashes.tolist())) == len(set(words)) and all((a == b) == (x == y) for a, x in zip(hashes, words, strict=True) for b, y in zip(hashes, words, strict=True))
    assert passages.words_of(pa.array([], pa.string()))[1].tolist() == [0]


def test_seeds_equal_plain_minimizers():
    rng = random.Random(9)
    texts = [[f"w{rng.randrange(9 if i % 2 else 500)}" for _ in range(rng.choice([0, 3, 39, 40, 60, 200]))] for i in range(60)]
    texts += [["the"] * 90, [f"w{i}" for i in range(50)] + ["a", "b"] * 40]
    words, first = passages.words_of(pa.array([" ".join(t) for t in texts]))
    seed, text, place, fresh = passages.seeds_of(words, first)
    got = [set() for _ in texts]
    for s, t, p in zip(seed.tolist(), text.tolist(), place.tolist(), strict=True):
        got[t].add((s, p))
    for i, t in enumerate(texts):
        own, own_first = passages.words_of(pa.array([" ".join(t)]))
        alone = passages.seeds_of(own, own_first)
        assert got[i] == set(zip(alone[0].tolist(), alone[2].tolist(), strict=True))
        places = {p for _, p in got[i]}
        assert all(len(set(t[p : p + 5])) > 2 for p in places) and (len(t) >= 40 or not places)
        if len(set(t)) > 400:
            assert all(any(w <= p < w + 8 for p in places) for w in range(len(t) - 11))
    assert fresh.sum() == len({(s, t) for s, t in zip(seed.tolist(), text.tolist(), strict=True)})


def test_chain_prefers_collinear_blocks():
    blocks = [(0, 100, 10), (12, 112, 10), (30, 20, 10), (40, 142, 10)]
    best = passages.chain(blocks)[0]
    assert best == [(0, 100, 10), (12, 112, 10), (40, 142, 10)]
    assert passages.chain([(0, 0, 5), (900, 900, 5)]) == [[(0, 0, 5)], [(900, 900, 5)]]


def test_chain_equals_quadratic_search():
    rng = random.Random(11)
    for _ in range(60):
        blocks = sorted({(rng.randrange(80), rng.randrange(80), rng.randint(3, 12)) for _ in range(rng.randint(2, 14))})
        best: dict[int, float] = {}
        for i in sorted(range(len(blocks)), key=lambda i: blocks[i]):
            x, r, n = blocks[i]
            before = [best[j] - passages.GAP_COST * (x - blocks[j][0] - blocks[j][2] + r - blocks[j][1] - blocks[j][2]) for j in best
                      if blocks[j][0] + blocks[j][2] <= x and blocks[j][1] + blocks[j][2] <= r]
            best[i] = n + max([0.0, *before])
        line = passages.chain(blocks)[0]
        score = line[0][2]
        for (px, pr, pn), (x, r, n) in zip(line[:-1], line[1:], strict=True):
            score += n - passages.GAP_COST * (x - px - pn + r - pr - pn)
        assert abs(score - max(best.values())) < 1e-9


def test_every_exact_passage_is_found(spark):
    texts, _ = corpus()
    df = spark.createDataFrame([(i, t, 0, "e") for i, t in enumerate(texts)], "doc_id long, text string, id int, seed string")
    found: dict[int, set] = {}
    for r in passages.list_passages(df).collect():
        assert r["n_words"] >= passages.MIN_WORDS and r["ref_doc_id"] < r["doc_id"]
        found.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    seen, wanted = {}, {}
    for i, text in enumerate(texts):
        words = WORD.findall(text)
        grams = [tuple(words[s : s + 50]) for s in range(len(words) - 49)]
        for s, g in enumerate(grams):
            if g in seen:
                wanted.setdefault(i, set()).update(range(s, s + 50))
        for g in grams:
            seen.setdefault(g, i)
    assert wanted
    for i, places in wanted.items():
        assert places <= found[i]


def test_fuzzy_passages_and_clean_documents(spark):
    texts, holds = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"] for r in passages.list_passages(df).collect()}
    first = {h: i for i, h in reversed(list(enumerate(holds))) if h is not None}
    assert found == {i for i, h in enumerate(holds) if h is not None and first[h] != i}
    left = {r["doc_id"]: r["text"] for r in passages.drop_passages(df).collect()}
    assert all(left[i] == texts[i] for i in range(len(texts)) if i not in found)
    assert all(len(WORD.findall(left.get(i, ""))) < len(WORD.findall(texts[i])) - 45 for i in found)


def test_repeat_in_the_gap_of_a_longer_chain_is_found(spark):
    make = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    one, two, gap, other = make("a", 400), make("b", 400), make("q", 100), make("r", 100)
    rows = [(1, f"{one} {gap} {two}"), (2, f"{make('c', 30)} {other} {make('d', 30)}"), (3, f"{one} {other} {two}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r["doc_id"], r["start_word"], r["end_word"]) for r in passages.list_passages(df).collect()] == [(3, 0, 900)]
    assert {r["doc_id"] for r in passages.drop_passages(df).collect()} == {1, 2}


def test_edited_passage_with_a_single_seed_is_found():
    make = lambda name, n: [f"{name}{i}" for i in range(n)]
    one, two = make("a", 80) + make("p", 60) + make("b", 80), make("c", 80) + make("p", 60) + make("d", 80)
    for i in (83, 92, 97, 109, 114, 120, 127, 133):
        two[i] = "edited"
    two.insert(104, "more")
    x, r = (passages.words_of(pa.array([" ".join(t)]))[0].astype("uint32") for t in (two, one))
    found = passages.merge([(*p, 1) for p in passages.align(x, r, [(98, 98, 5)])])
    assert [(s, e) for s, e, _ in found] == [(80, 141)]
    assert passages._extend(x[:0], r[:9]) == (0, 0, 0)


def test_classes_join_holders_that_do_not_list_each_other(spark):
    shared = [f"p{i}" for i in range(320)]
    make = lambda i, n: [f"{i}x{j}" for j in range(n)]
    pieces = [shared[12 * i : 12 * i + 32] for i in range(25)]
    rows = [(i, " ".join(make(i, 40) + piece + make(i + 1000, 40))) for i, piece in enumerate(pieces)]
    rows += [(i, " ".join(make(i, 50) + shared + make(i + 1000, 50))) for i in (100, 101)]
    rows += [(i, " ".join(make(200, 80) + make(i, 50))) for i in (200, 201, 202)]
    got = {r["doc_id"]: r for r in passages.list_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {100, 101, 201, 202}
    assert got[100]["class_id"] == got[101]["class_id"] < 25 and got[101]["end_word"] - got[101]["start_word"] == 320
    assert {got[i]["class_id"] for i in (201, 202)} == {200}


def test_no_chain_is_too_short_for_alignment(spark):
    shared = [f"p{i}" for i in range(60)]
    edited = [w if i % 8 else "edited" for i, w in enumerate(shared)]
    rows = [(i, " ".join([f"{i}x{j}" for j in range(60)] + t + [f"{i}y{j}" for j in range(60)])) for i, t in enumerate([shared, edited])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r["doc_id"], r["n_words"] >= 50) for r in passages.list_passages(df).collect()] == [(1, True)]


def test_shuffled_frequent_lines(spark):
    rng = random.Random(2)
    lines = [[f"l{i}w{j}" for j in range(rng.randint(6, 12))] for i in range(6)]
    texts = [" ".join(w for line in rng.sample(lines, rng.randint(1, 2)) for w in line) for _ in range(60)]
    texts += [" ".join(w for _ in range(rng.randint(6, 14)) for w in rng.choice(lines)) for _ in range(60)]
    got: dict[int, set] = {}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in passages.list_passages(df).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    seen: set = set()
    for i, text in enumerate(texts):
        words = text.split()
        grams = [tuple(words[s : s + 50]) for s in range(len(words) - 49)]
        assert all(set(range(s, s + 50)) <= got.get(i, set()) for s, g in enumerate(grams) if g in seen)
        seen.update(grams)


def test_edges(spark):
    long = " ".join(f"v{i}" for i in range(80))
    again, junk = "spam and eggs " * 300, "spam spam " * 300
    rows = [(None, long), (1, long), (1, long), (2, None), (3, ""), (4, " \n "), (5, "x " + long + " y"), (6, again), (7, again), (8, "w " * 100_000), (9, junk), (10, junk), (11, long + " " + junk + long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) as n_chars", "1 as mark", "'b' as block")
    got = {(r["doc_id"], r["ref_doc_id"]) for r in passages.list_passages(df).collect()}
    assert got == {(1, None), (5, None), (7, 6), (10, 9), (11, None)}
    kept = passages.drop_passages(df)
    assert kept.columns == df.columns
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()}
    assert left[None][0] == long and 1 not in left and left[5] == ("x y", 3) and left[6][0] == again and left[2] == (None, None)
    assert passages.drop_passages(df.limit(0)).count() == 0


@pytest.mark.parametrize(("share", "least"), [(0.05, 0.98), (0.1, 0.98), (0.15, 0.95), (0.2, 0.9)])
def test_edited_passages_by_share_of_edits(spark, share, least):
    rng = random.Random(int(share * 100))
    make = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows, n = [], 60
    for i in range(n):
        shared = make(100)
        edited = list(shared)
        for at in rng.sample(range(100), round(100 * share)):
            edited[at] = ("", f"e{at}", f"{edited[at]} e{at}")[rng.randrange(3)]
        rows += [(i, " ".join(make(80) + shared + make(80))), (n + i, " ".join(make(80) + edited + make(80)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in passages.list_passages(df).collect()}
    assert all(i >= n and found[i]["ref_doc_id"] == i - n for i in found)
    assert len(found) >= least * n
    inside = sum(r["end_word"] - r["start_word"] for r in found.values())
    assert inside <= 1.1 * 110 * n


def test_cut_words():
    assert passages.cut_words("a  b\tc\nd", [(1, 3)]) == "a  d"
    assert passages.cut_words("é b", [(0, 1)]) == "b"
    assert passages.cut_words("a b", [(0, 9)]) == ""
    assert passages.cut_words(" a b ", []) == " a b "


def test_repeats_of_low_complexity_text(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    plain = lambda n: " ".join(word() for _ in range(n))
    chant = " ".join(["hey", "ho"] * 100)
    coin = " ".join(" ".join([x] * 4) for x in rng.choices(["yes", "no"], k=60))  # runs of one word or the other, in no period
    rows = [
        *((i, f"{plain(70)} {chant} {plain(70)}") for i in (1, 2, 3)),
        *((i, f"{plain(30)} {coin} {plain(30)}") for i in (4, 5)),
        (6, " ".join(["hey", "ho"] * 24)),  # fewer words than a passage
        (7, " ".join(["la"] * 500)),  # a repeat within one text
        (8, plain(200)),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages.list_passages(df).collect()
    covered = {}
    for r in got:
        words = dict(rows)[r["doc_id"]].split()
        covered.setdefault(r["doc_id"], []).extend(words[r["start_word"] : r["end_word"]])
    assert set(covered) == {2, 3, 5}
    assert covered[2] == chant.split() == covered[3] and covered[5] == coin.split()
    assert all(r["ref_doc_id"] in (1, 4) and r["class_id"] in (1, 4) for r in got)
    kept = {r["doc_id"]: r["text"] for r in passages.drop_passages(df.withColumn("n_chars", F.length("text"))).collect()}
    assert chant in kept[1] and "hey ho" not in kept[2] and "hey ho" not in kept[3] and coin in kept[4] and "yes" not in kept[5]
