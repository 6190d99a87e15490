"""Toxicity scores from subword-bag embeddings under a linear softmax.

A text is the bag of its distinct words' subwords: each word with its ends marked, and its character n-grams of 3 to 5. All
share one table of embeddings, so a misspelling or an inflection that was never seen still has the n-grams of its
word. The mean of the bag goes through a linear softmax; embeddings and softmax are trained jointly in numpy by
full-batch gradient descent with Adam, on a bounded sample of labelled documents (whole texts): ``per_class`` of each
class at most, those whose ids hash lowest, and of a text with more than ``words_per_doc`` distinct words those that hash
lowest; so what reaches the driver is bounded. The bias is then moved a part of the way towards
the odds of all labelled rows.

Since the softmax is linear, a word adds the same amount to the margin in every text: scoring sums what its subwords
add. Only texts and labels go in; language, source and id are no inputs.

Defined results: a null text is empty; a text without words scores by the bias alone; a document labelled more than
once counts once, as toxic if any label says so; labels that are null or of unknown documents are left out before the
sample is taken; of rows that repeat an id one is learned from, the text that hashes lowest; without both classes every
score is the share of toxic labels (0 without labels); repeated rows score alike; extra columns, of whatever names,
change nothing.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.llm.common import fold, id_text, slices
from siftwright.shared import written

FOLDS, HELD_OUT = 5, 0
PER_CLASS = 1_500  #: documents of each class that are learned from
BUCKETS = 1 << 18
ORDERS = (3, 4, 5)
ODDS_POWER = 0.2  #: of the labelled rows' log-odds that the bias takes; the classes weigh the same in training
WORDS_PER_DOC = 20_000  #: distinct words of a sampled document that are learned from
MIN_SHARE = 1 / 150  #: of the sampled documents: occurrences that a subword needs to have an embedding, two at least
DIM = 4
STEPS, RATE, DECAY, FLOOR = 100, 0.5, 0.01, 0.02
WORDS_AT_ONCE = 100_000  #: words whose n-grams are hashed in one go
LONGEST = 40  #: characters of a word; a longer run of letters is cut into words of this length

_WORD = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def bag_of(text: str | None, most: int = WORDS_PER_DOC) -> list[str]:
    """A text's distinct words in order; of more than most, those that hash lowest."""
    own = set(words_of(text))
    if len(own) > most:
        own = heapq.nsmallest(most, own, key=lambda w: (xxhash.xxh64_intdigest(w.encode("utf-8", "replace")), w))
    return sorted(own)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of its word) of all marked words and their n-grams, hashed by numpy."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    owner, end = np.repeat(np.arange(len(words)), lengths), np.repeat(ends, lengths)
    place = np.arange(len(codes))
    inside = (place - (end - lengths[owner])).astype(np.uint32)
    whole = np.add.reduceat((codes + np.uint32(7)) * (inside * np.uint32(0x9E3779B1) | np.uint32(1)), ends - lengths, dtype=np.uint32)
    buckets, owners = [_mixed(whole, len(ORDERS) + 1)], [np.arange(len(words))]
    rolled = codes.copy()
    for order in range(2, max(ORDERS) + 1):
        if len(codes) < order:
            break
        rolled = rolled[:-1] * np.uint32(0x85EBCA77) + codes[order - 1 :]
        if order in ORDERS:
            fits = place[: len(rolled)] + order <= end[: len(rolled)]
            buckets.append(_mixed(rolled[fits], order))
            owners.append(owner[: len(rolled)][fits])
    return np.concatenate(buckets), np.concatenate(owners)


def _mixed(hashes: np.ndarray, salt: int) -> np.ndarray:
    out = (hashes + np.uint32(salt)) * np.uint32(0xC2B2AE3D)
    out = (out ^ (out >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    return ((out ^ (out >> np.uint32(13))) & np.uint32(BUCKETS - 1)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray  # sorted buckets that have an embedding
    embeddings: np.ndarray  # one column each
    softmax: np.ndarray  # 2 x DIM
    bias: np.ndarray  # 2

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.margin = np.zeros(BUCKETS, np.float64)
        self.margin[model.buckets] = (model.softmax[1] - model.softmax[0]).astype(np.float64) @ model.embeddings
        self.bias = float(model.bias[1] - model.bias[0])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        words: list[str] = []
        rows: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal words, rows, size
            bucket, owner = subwords(words)
            row = np.array(rows, np.int64)[owner]
            total[:] += np.bincount(row, self.margin[bucket], len(texts))
            n[:] += np.bincount(row, minlength=len(texts))
            words, rows, size = [], [], 0

        for i, text in enumerate(texts):
            own = sorted(set(words_of(text)))
            for at in range(0, len(own), WORDS_AT_ONCE):
                part = own[at : at + WORDS_AT_ONCE]
                words += part
                rows += [i] * len(part)
                size += len(part)
                if size >= WORDS_AT_ONCE:
                    flush()
        flush()
        margin = self.bias + np.divide(total, n, out=np.zeros(len(texts)), where=n > 0)
        return 1 / (1 + np.exp(-np.clip(margin, -60, 60)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


class _Sums:
    """Sums of columns by group, as a gather and a segmented sum; both directions are prepared once."""

    def __init__(self, group: np.ndarray, member: np.ndarray, groups: int, members: int):
        self.ways = []
        for to, source, n in ((group, member, groups), (member, group, members)):
            order = np.argsort(to, kind="stable")
            keys, starts = np.unique(to[order], return_index=True)
            self.ways.append((source[order], keys, starts, n))

    def _apply(self, way: int, columns: np.ndarray) -> np.ndarray:
        source, keys, starts, n = self.ways[way]
        out = np.zeros((len(columns), n), np.float32)
        if len(source):
            for line, into in zip(columns, out, strict=True):
                into[keys] = np.add.reduceat(line[source], starts)
        return out

    def up(self, members: np.ndarray) -> np.ndarray:
        return self._apply(0, members)

    def down(self, groups: np.ndarray) -> np.ndarray:
        return self._apply(1, groups)


def train(bags: list[tuple[int, list[str]]], toxic_share: float, seed: int = 7) -> Model:
    """bags: (label, distinct words) of each sampled document."""
    vocabulary: dict[str, int] = {}
    doc = np.repeat(np.arange(len(bags)), [len(own) for _, own in bags])
    word = np.array([vocabulary.setdefault(name, len(vocabulary)) for _, own in bags for name in own], np.int64)
    names = list(vocabulary)
    found = [subwords(names[at : at + WORDS_AT_ONCE]) for at in range(0, len(names), WORDS_AT_ONCE)] or [subwords([])]
    bucket = np.concatenate([b for b, _ in found]).astype(np.int32)
    owner = np.concatenate([o + i * WORDS_AT_ONCE for i, (_, o) in enumerate(found)]).astype(np.int32)
    del found
    sizes = np.bincount(owner, minlength=len(names))
    seen = np.bincount(bucket, np.bincount(word, minlength=len(names))[owner], BUCKETS)
    buckets = np.flatnonzero(seen >= max(2, MIN_SHARE * len(bags)))
    place = np.full(BUCKETS, -1, np.int32)
    place[buckets] = np.arange(len(buckets))
    active = place[bucket] >= 0
    spelled = _Sums(owner[active], place[bucket[active]], len(names), len(buckets))
    bag = _Sums(doc, word, len(bags), len(names))
    total = np.maximum(np.bincount(doc, sizes[word], len(bags)), 1).astype(np.float32)
    labels = np.array([label for label, _ in bags])
    wanted = np.eye(2, dtype=np.float32)[labels].T
    weight = np.array([0.5 / max(1, (labels == c).sum()) for c in (0, 1)], np.float32)[labels]

    rng = np.random.default_rng(seed)
    state = {
        "embeddings": rng.normal(0, 0.01, (DIM, len(buckets))).astype(np.float32),
        "softmax": rng.normal(0, 3.0, (2, DIM)).astype(np.float32),
        "bias": np.zeros((2, 1), np.float32),
    }
    first = {k: np.zeros_like(v) for k, v in state.items()}
    second = {k: np.zeros_like(v) for k, v in state.items()}
    for step in range(1, STEPS + 1):
        mean = bag.up(spelled.up(state["embeddings"])) / total
        logits = state["softmax"] @ mean + state["bias"]
        odds = np.exp(logits - logits.max(axis=0))
        error = (odds / odds.sum(axis=0) - wanted) * weight
        slopes = {
            "embeddings": spelled.down(bag.down(state["softmax"].T @ error / total)),
            "softmax": error @ mean.T,
            "bias": error.sum(axis=1, keepdims=True),
        }
        for k, g in slopes.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            scale = np.sqrt(second[k] / (1 - 0.99**step))
            if k == "embeddings":
                state[k] *= 1 - DECAY
                scale += FLOOR * scale.max(initial=0)  # what is rare or inconsistent moves less than what is frequent
            state[k] -= np.float32(RATE) * (first[k] / (1 - 0.9**step)) / (scale + 1e-12)
    share = min(max(toxic_share, 1e-6), 1 - 1e-6)
    shift = np.array([0.0, np.log(share / (1 - share))])  # the classes weighed the same
    return Model(buckets, state["embeddings"], state["softmax"], state["bias"][:, 0] + ODDS_POWER * shift)


def _constant(share: float) -> Model:
    share = min(max(share, 1e-9), 1 - 1e-9)
    return Model(np.zeros(0, np.int64), np.zeros((DIM, 0), np.float32), np.zeros((2, DIM), np.float32), np.array([0.0, np.log(share / (1 - share))]))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label_id: str = "doc_id",
    label: str = "toxic",
    per_class: int = PER_CLASS,
    words_per_doc: int = WORDS_PER_DOC,
) -> Model:
    """Learn from labelled rows outside the held-out fold."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    marked = labels.select(F.col(label_id).alias("id"), (F.col(label) > 0).cast("int").alias("label")).dropna()
    marked = marked.filter(fold("id", FOLDS) != HELD_OUT).groupBy("id").agg(F.max("label").alias("label"))
    marked = written(marked.join(rows.select("id"), "id", "left_semi"), "toxic-labels")
    sizes = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return _constant(float(sum(k * n for k, n in sizes.items()) > 0))
    first = (F.xxhash64(id_text("id")), F.col("id"))
    chosen = [marked.filter(F.col("label") == c).orderBy(*first).limit(per_class) for c in (0, 1)]
    sample = F.broadcast(chosen[0].union(chosen[1]))  # 2 x per_class rows at most
    rows = rows.join(sample, "id").groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("label", "text")

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [bag_of(t, words_per_doc) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(found, pa.list_(pa.string()))], names=["label", "words"]
            )

    bags = rows.mapInArrow(bag, "label int, words array<string>").toArrow()
    made = sorted(zip(*(bags.column(c).to_pylist() for c in ("label", "words")), strict=True))
    share = sizes[1] / (sizes[0] + sizes[1])
    if len({label for label, _ in made}) < 2:
        return _constant(share)
    return train(made, share)


def add_scores(docs: DataFrame, model: Model, *, text: str = "text", into: str = "score") -> DataFrame:
    """docs with the score of each whole text; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = held.value.scorer()
        for batch in texts:
            yield pd.Series(scorer.scores(list(batch)), dtype="float64")

    return docs.withColumn(into, F.pandas_udf(scored, "double").asNondeterministic()(F.col(text).cast("string")))


def score_documents(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = fit(docs, labels, doc_id=doc_id, text=text, **options)
    told = add_scores(docs.select(F.col(doc_id), F.col(text).alias("_sw_text")), model, text="_sw_text", into="_sw_score")
    return told.select(
        doc_id,
        (fold(doc_id, FOLDS) == HELD_OUT).alias("held_out"),
        F.col("_sw_score").alias("score"),
        (F.col("_sw_score") >= 0.5).cast("int").alias("predicted"),
    )
