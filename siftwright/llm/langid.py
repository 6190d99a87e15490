"""Language identification by multinomial naive Bayes over hashed character n-grams.

Letters (Unicode's categories L) are lower-cased, everything else is one space; n-grams of one to three characters are
hashed to buckets. Counts come from a bounded sample of labelled rows, ``per_language`` documents of each language in
expectation (chosen by a hash of the id, whole texts) and the ``most_languages`` languages with the most rows; they
are summed on the executors, and what reaches the driver is one row for each language and bucket at most. The
log-probability matrix (buckets x languages, float32) is broadcast; a batch
of documents is a sparse matrix of bucket indices and row ends, scored by a gather and a segmented sum.

Defined results: a null text, or one without a letter, is ``und`` with score 0 (numbers such as \u00b2, \u00bd and \u2167 are no
letters); a tie goes to the first language by
name; without any labelled row every text is ``und``; repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.llm.common import fold, id_text, slices

UND = "und"
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
PER_LANGUAGE = 5_000  #: documents of each language that are learned from, in expectation
MOST_LANGUAGES = 256  #: that are learned, those with the most rows: bounds the matrix, however dirty the column is
SMOOTHING = 0.5
FOLDS, HELD_OUT = 4, 2

#: Numbers that are word characters but neither digits nor letters, such as superscripts, fractions and Roman numerals.
_NUMBERS = {i: " " for i in range(sys.maxunicode + 1) if chr(i).isnumeric() and not chr(i).isalpha() and not chr(i).isdecimal()}
_IS_NUMBER = np.zeros(sys.maxunicode + 1, bool)
_IS_NUMBER[list(_NUMBERS)] = True
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
#: Characters hashed at once; a longer document takes as many rounds as it needs.
BLOCK = 1 << 17
GATHERED = 1 << 18  #: n-grams whose rows of the matrix are summed at once


def plain(text: str | None) -> str:
    """Lower-case letters with one space between and around runs; empty if there is no letter."""
    if text and not text.isascii() and _IS_NUMBER[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)].any():
        text = text.translate(_NUMBERS)
    if not text or not _LETTER.search(text):
        return ""
    return f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} "


def blocks_of(letters: str) -> Iterator[str]:
    """Pieces of BLOCK characters, each with the characters that n-grams beginning in it go on to."""
    for at in range(0, len(letters), BLOCK):
        yield letters[at : at + BLOCK + max(ORDERS) - 1]


def buckets_of(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of each n-gram that begins in the first BLOCK characters, all orders one after the other."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    parts, rolled = [], None
    for order in range(1, max(ORDERS) + 1):
        if len(codes) < order:
            break
        ahead = codes[order - 1 :]
        rolled = ahead + np.uint32(1) if rolled is None else rolled[: len(ahead)] * _MULTIPLIERS[1] + ahead + np.uint32(order)
        mixed = (rolled ^ (rolled >> np.uint32(15))) * _MULTIPLIERS[0]
        parts.append(((mixed ^ (mixed >> np.uint32(13))) * _MULTIPLIERS[2] >> shift)[:BLOCK])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_probs: np.ndarray  # buckets x languages
    prior: np.ndarray

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Best language and its posterior for each text."""
        totals = np.tile(self.prior.astype(np.float64), (len(texts), 1))
        known = np.zeros(len(texts), bool)
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            if held:
                rows = np.array([r for r, _ in held])
                ends = np.cumsum([0] + [len(b) for _, b in held][:-1])
                found = self.log_probs[np.concatenate([b for _, b in held])]
                np.add.at(totals, rows, np.add.reduceat(found, ends, axis=0, dtype=np.float64))
            held, size = [], 0

        for row, text in enumerate(texts):
            letters = plain(text)
            if not letters:
                continue
            known[row] = True
            for block in blocks_of(letters):
                found = buckets_of(block, len(self.log_probs))
                held.append((row, found))
                size += len(found)
                if size >= GATHERED:
                    flush()
        flush()
        if not self.languages:
            return [UND] * len(texts), np.zeros(len(texts))
        best = totals.argmax(axis=1)
        odds = np.exp(totals - totals.max(axis=1, keepdims=True))
        top = np.where(known, 1 / odds.sum(axis=1), 0.0)
        return [self.languages[b] if k else UND for b, k in zip(best, known, strict=True)], top


def fit(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = PER_LANGUAGE,
    most_languages: int = MOST_LANGUAGES,
    buckets: int = BUCKETS,
) -> Model:
    """Learn from rows outside the held-out fold whose language is known."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & (fold("id", FOLDS) != HELD_OUT))
    ranked = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages)
    sizes = {r["lang"]: r["count"] for r in ranked.collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros((buckets, 0), np.float32), np.zeros(0))
    rates = docs.sparkSession.createDataFrame([(name, min(1.0, per_language / n)) for name, n in sizes.items()], "lang string, rate double")
    draw = F.pmod(F.xxhash64(id_text("id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(F.broadcast(rates), "lang").filter(draw < F.col("rate")).select("lang", "text")  # most_languages rows at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            for name, value in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                letters = plain(value)
                for block in blocks_of(letters):
                    found = np.bincount(buckets_of(block, buckets), minlength=buckets)
                    sums[name] = sums[name] + found if name in sums else found
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    counted = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.full((buckets, len(languages)), SMOOTHING)
    found = counted.toPandas()
    place = {name: i for i, name in enumerate(languages)}
    table[found["bucket"].to_numpy(np.int64), found["lang"].map(place).to_numpy(np.int64)] += found["n"].to_numpy(np.float64)
    log_probs = np.log(table / table.sum(axis=0)).astype(np.float32)
    total = sum(sizes.values())
    return Model(languages, log_probs, np.log(np.array([sizes[name] / total for name in languages])))


def identify(docs: DataFrame, model: Model, *, text: str = "text", into: str = "_sw_language") -> DataFrame:
    """docs with a struct column of lang_pred and score; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            names, scores = held.value.scores(list(batch))
            yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": scores})

    return docs.withColumn(into, scored.asNondeterministic()(F.col(text).cast("string")))


def predict_languages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text."""
    model = fit(docs, doc_id=doc_id, text=text, lang=lang, **options)
    rows = docs.select(F.col(doc_id), F.col(text).alias("_sw_text"))
    told = identify(rows, model, text="_sw_text")
    return told.select(doc_id, (fold(doc_id, FOLDS) == HELD_OUT).alias("held_out"), "_sw_language.*")
