"""Exact and near-duplicate removal within splits; the first row in order stays.

Near-duplicates have two modes. "verified" drops a row if an earlier kept row has an exact Jaccard similarity of the
threshold or more. "lsh" drops a row that shares a MinHash band with an earlier kept row, without verification.

Both are greedy in row order, which is neither connected components nor "any earlier neighbour": in a chain a-b-c
without a-c, a and c stay. Greedy is resolved in a few rounds, in which a row is kept once no undecided row comes before it
among its neighbours, and dropped once a kept one does; the chains that are left are walked through by component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwright.functions.text import fingerprint_digest, let, token_shingles
from siftwright.operators.components import star_forest
from siftwright.operators.records import text_column
from siftwright.operators.similarity import Lists, candidates, fits, lists_of, promising, sent, shingle_sets, similar_pairs, verified  # noqa: F401
from siftwright.shared import written

THRESHOLD = 0.85
PERMUTATIONS = 128
SEED = 1
NO_SHINGLE = 1 << 30  #: stands for a text without tokens
ROUNDS = 3  #: rounds of greedy before what is left is resolved by component
COMPONENT = 200_000  #: memberships of a component that one task walks through
HOT = 64  #: rows of a bucket above which rows meet its first row only, round by round
SLICE = 16_384  #: values that are hashed at once, about, so that they stay in a core's cache
SIGNED = 512  #: rows that are signed at once
_PRIME = (1 << 61) - 1


def exact_deduplicate(df: DataFrame, cleaned: bool = False) -> DataFrame:
    """First row of each (split, fingerprint), with text_fingerprint; cleaned: text_clean went through all steps.

    Each text is cleaned and hashed once, and what is written and joined are digests. The first row's index is a partial
    aggregate, so thousands of copies are no hot window.
    """
    first = text_digests(df, cleaned).groupBy("split", "text_fingerprint").agg(F.min("row_idx").alias("row_idx"))
    return df.join(first, ["split", "row_idx"]).select(*df.columns, "text_fingerprint")


def text_digests(df: DataFrame, cleaned: bool = False) -> DataFrame:
    """split, row_idx and text_fingerprint of every row as a written table."""
    name = text_column(df, "text_clean", "text")
    digest = fingerprint_digest(F.col(name), cleaned and name == "text_clean")
    return written(df.select("split", "row_idx", digest.alias("text_fingerprint")), "digests")


def exact_report(df: DataFrame, cleaned: bool = False) -> DataFrame:
    name = text_column(df, "text_clean", "text")
    marked = df.select("split", fingerprint_digest(F.col(name), cleaned and name == "text_clean").alias("digest"))
    counted = marked.groupBy("split", "digest").agg(F.count("*").alias("n")).groupBy("split")
    counted = counted.agg(F.sum("n").alias("input_rows"), F.count("*").alias("output_rows"))
    return counted.withColumn("exact_removed", F.col("input_rows") - F.col("output_rows"))


def near_duplicate_pairs(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of different sets; rows with equal sets stand behind their first row."""
    lists, _ = lists_of(df, threshold)
    pairs = verified(candidates(lists), lists)
    return pairs.select(F.col("l_split").alias("split"), "l_row", "r_row", "jaccard")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Greedy over memberships sorted by component and row: a row is kept if no kept row has one of its buckets."""
    component, taken, row, own = None, set(), None, []

    def closed(kept: list) -> None:
        if row is not None and taken.isdisjoint(own):
            taken.update(own)
            kept.append(row)

    for batch in batches:
        kept: list = []
        for at, split, row_idx, bucket in zip(*(batch.column(c).to_pylist() for c in ("component", "split", "row_idx", "bucket")), strict=True):
            if (split, row_idx) != row or at != component:
                closed(kept)
                if at != component:
                    component, taken = at, set()
                row, own = (split, row_idx), []
            own.append(bucket)
        yield pa.RecordBatch.from_pydict({"split": pa.array([s for s, _ in kept], pa.string()), "row_idx": pa.array([i for _, i in kept], pa.int64())})
    kept = []
    closed(kept)
    yield pa.RecordBatch.from_pydict({"split": pa.array([s for s, _ in kept], pa.string()), "row_idx": pa.array([i for _, i in kept], pa.int64())})


def _walked(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rest): what greedy keeps of the components of at most COMPONENT memberships, and the memberships of the others."""
    first = left.groupBy("split", "bucket").agg(F.min("row_idx").alias("first"))
    node = lambda c: F.struct("split", F.col(c).alias("row_idx"))
    edges = left.join(first, ["split", "bucket"]).select(node("row_idx").alias("a"), node("first").alias("b"))
    root = star_forest(edges, "greedy-components").select("a.split", "a.row_idx", F.col("b.row_idx").alias("root"))
    held = left.join(root, ["split", "row_idx"], "left").withColumn("component", F.xxhash64("split", F.coalesce("root", "row_idx")))
    held = written(held.drop("root"), "greedy-held")
    large = written(held.groupBy("component").agg(F.count("*").alias("k")).filter(F.col("k") > COMPONENT).select("component"), "greedy-large")
    small = held.join(large, "component", "left_anti").select("component", "split", "row_idx", "bucket")
    walked = small.repartition("component").sortWithinPartitions("component", "split", "row_idx").mapInArrow(_walk, "split string, row_idx long")
    return written(walked, "greedy-kept"), held.join(large, "component", "left_semi").select("split", "bucket", "row_idx")


def greedy_kept(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """(split, row_idx) that greedy keeps: no earlier kept row is in a bucket with it.

    rows: split, row_idx. buckets: split, bucket, row_idx; a pair is a bucket of two. A round needs the first undecided
    row of each bucket (a partial aggregate), never the pairs of a bucket. What ROUNDS rounds leave, chains, is resolved by
    component in one pass; only components too large for a task go on in rounds.
    """
    key = ["split", "row_idx"]
    left, kept = written(buckets.select("split", "bucket", "row_idx"), "greedy"), []
    rounds = 0
    while not left.isEmpty():
        if rounds == ROUNDS:
            chosen, rest = _walked(left)
            left = written(rest, "greedy")
        else:
            first = left.groupBy("split", "bucket").agg(F.min("row_idx").alias("first"))
            seen = written(left.join(first, ["split", "bucket"]), "greedy-first")
            chosen = seen.groupBy(*key).agg(F.min(F.expr("first = row_idx")).alias("all_first")).filter("all_first").select(*key)
            chosen = written(chosen, "greedy-kept")
            hit = seen.join(chosen.withColumnRenamed("row_idx", "first"), ["split", "first"], "left_semi")
            gone = hit.select(*key).distinct().unionByName(chosen).distinct()
            left = written(left.join(gone, key, "left_anti"), "greedy")
        kept.append(chosen)
        if len(kept) > ROUNDS + 1:  # few tables, however long the rounds of a large component go on
            kept = [written(reduce(DataFrame.unionByName, kept), "greedy-kept")]
        rounds += 1
    free = rows.select(*key).join(buckets.select(*key).distinct(), key, "left_anti")
    return reduce(DataFrame.unionByName, kept, free)


def band_layout(threshold: float, permutations: int = PERMUTATIONS) -> tuple[int, int] | None:
    """(bands, rows) with the least sum of false positives and negatives; None where no layout has two bands."""
    if not 0 <= threshold <= 1:
        return None
    below = np.linspace(0, threshold, 1001) if threshold > 0 else np.zeros(2)
    above = np.linspace(threshold, 1, 1001)
    trapezoid = lambda y, x: float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())
    best = None
    for bands in range(1, permutations + 1):
        for rows in range(1, permutations // bands + 1):
            error = trapezoid(1 - (1 - below**rows) ** bands, below) + trapezoid((1 - above**rows) ** bands, above)
            if best is None or error < best[0]:
                best = (error, bands, rows)
    return best[1:] if best[1] >= 2 else None


def permutations_of(n: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Factors and offsets of n universal hashes modulo 2^61 - 1."""
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 1 << 31, n, dtype=np.uint64), rng.integers(0, _PRIME, n, dtype=np.uint64)


def minhash(values: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of every universal hash (rows) over each run of 31-bit values (columns); runs aren't empty.

    One permutation at a time over slices of whole runs: memory is a few times the values', however long a run is. The
    remainder by 2^61 - 1 takes no division: what is above 61 bits is added below, and the lesser of that and it less the prime
    (which wraps around, if it is negative) is left.
    """
    values, prime, above = values.astype(np.uint64), np.uint64(_PRIME), np.uint64(61)
    cuts = [0, *(np.flatnonzero(np.diff(starts // SLICE)) + 1).tolist(), len(starts)] if len(starts) else [0]
    made = []
    for i, j in zip(cuts, cuts[1:], strict=False):
        some = values[starts[i] : starts[j] if j < len(starts) else len(values)]
        own, minima = starts[i:j] - starts[i], np.empty((len(a), j - i), np.int64)
        for k, (x, y) in enumerate(zip(a, b, strict=True)):
            hashed = some * x + y
            hashed = (hashed & prime) + (hashed >> above)
            minima[k] = np.minimum.reduceat(np.minimum(hashed, hashed - prime), own)
        made.append(minima)
    return np.concatenate(made, axis=1) if made else np.empty((len(a), 0), np.int64)


def minhash_signatures(sets: DataFrame, permutations: int = PERMUTATIONS) -> DataFrame:
    """(split, row_idx, s): the signature of each row's numbers, 31 bits of eight hexadecimal digits each, one at least."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations_of(permutations)
        for batch in batches:
            for at in range(0, batch.num_rows, SIGNED):
                part = batch.slice(at, SIGNED)
                numbers = part.column("numbers").to_pylist()
                values = np.frombuffer(bytes.fromhex("".join(numbers)), ">u4") >> 1
                starts = np.cumsum([0, *(len(n) // 8 for n in numbers[:-1])])
                minima = minhash(values, starts, a, b)
                whole = pa.FixedSizeListArray.from_arrays(pa.array(minima.T.reshape(-1)), permutations).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("split"), part.column("row_idx"), whole], names=["split", "row_idx", "s"])

    return sets.select("split", "row_idx", "numbers").mapInArrow(signed, "split string, row_idx long, s array<long>")


def lsh_buckets(df: DataFrame, threshold: float, permutations: int = PERMUTATIONS) -> DataFrame | None:
    """(split, row_idx, bucket): a bucket is a band's number and minima as text; None where no layout has two bands.

    A shingle's number is the first 31 bits of its MD5 digest, which SQL engines reproduce exactly.
    """
    layout = band_layout(threshold, permutations)
    if layout is None:
        return None
    bands, rows = layout
    grams = token_shingles(F.col(text_column(df, "text_clean", "text")))
    digits = lambda s: F.substring(F.md5(s.cast("binary")), 1, 8)
    numbers = let(grams, lambda g: F.when(F.size(g) > 0, F.array_join(F.transform(g, digits), "")).otherwise(F.lit(f"{NO_SHINGLE << 1:08x}")))
    signed = minhash_signatures(df.select("split", "row_idx", numbers.alias("numbers")), permutations)
    band = (F.md5(F.concat(F.lit(f"{i}:"), F.array_join(F.slice("s", i * rows + 1, rows), ",")).cast("binary")) for i in range(bands))
    return written(signed.select("split", "row_idx", F.explode(F.array(*band)).alias("bucket")), "bands")


def _verified_kept(lists: Lists, members: DataFrame) -> DataFrame:
    """(split, row_idx) that greedy keeps by exact similarity, of different sets.

    While buckets of signatures are large, their rows meet the first one only: what comes first in all of its
    buckets is kept, and what is similar to it goes. So a cluster of n near copies costs n comparisons, not n * n. Once
    buckets are small or a round gains little, the rest is decided by its similar pairs.
    """
    key = ["split", "row_idx"]
    left, before = lists.prefix, None
    rows = members.filter("first = row_idx").select(*key)
    while True:
        crowded = left.groupBy("split", "h").agg(F.count("*").alias("uses")).filter(F.col("uses") > HOT).agg(F.sum("uses")).first()[0] or 0
        if not crowded or (before is not None and crowded > 0.7 * before):
            break
        before = crowded
        least = F.min(F.struct("row_idx", "n")).alias("first")
        first = written(left.groupBy("split", "h").agg(least), "near-first")
        own = left.select(F.col("split").alias("l_split"), "h", *(F.col(c).alias(f"r_{to}") for c, to in (("row_idx", "row"), ("n", "n"))))
        told = first.select(F.col("split").alias("l_split"), "h", *(F.col(f"first.{c}").alias(f"l_{to}") for c, to in (("row_idx", "row"), ("n", "n"))))
        seen = written(own.join(told, ["l_split", "h"]).withColumn("r_split", F.col("l_split")), "near-seen")
        chosen = seen.groupBy(F.col("r_split").alias("split"), F.col("r_row").alias("row_idx")).agg(F.min(F.expr("l_row = r_row")).alias("all_first"))
        chosen = written(chosen.filter("all_first").select(*key), "near-chosen")
        met = seen.join(chosen.toDF("l_split", "l_row"), ["l_split", "l_row"], "left_semi").filter((F.col("l_row") < F.col("r_row")) & fits(lists.threshold))
        gone = verified(promising(met), lists).select(F.col("r_split").alias("split"), F.col("r_row").alias("row_idx")).distinct()
        gone = written(gone, "near-gone")
        rows = rows.join(gone, key, "left_anti")
        left = written(left.join(gone.unionByName(chosen), key, "left_anti"), "prefixes")
    pairs = verified(candidates(lists, left), lists)
    named = pairs.select(F.col("l_split").alias("split"), F.xxhash64("l_split", "l_row", "r_row").alias("bucket"), F.explode(F.array("l_row", "r_row")).alias("row_idx"))
    return greedy_kept(rows, written(named, "near-pairs"))


def near_kept(df: DataFrame, threshold: float = THRESHOLD, mode: str = "verified") -> DataFrame | None:
    """(split, row_idx) that stay; None for all, in lsh mode with a threshold too extreme for bands.

    Rows with equal fingerprints have equal sets, of which the first stays: exact duplicates needn't be removed before.
    """
    if mode == "lsh":
        buckets = lsh_buckets(df, threshold)
        return None if buckets is None else greedy_kept(df, buckets)
    return _verified_kept(*lists_of(df, threshold))


def near_deduplicate(df: DataFrame, threshold: float = THRESHOLD, mode: str = "verified") -> DataFrame:
    """df without near-duplicates."""
    kept = near_kept(df, threshold, mode)
    return df if kept is None else df.join(kept, ["split", "row_idx"], "left_semi")


def kept_rows(df: DataFrame, threshold: float = THRESHOLD, mode: str = "verified", cleaned: bool = False) -> DataFrame:
    """(split, row_idx) of df without exact and near-duplicates."""
    kept = near_kept(df, threshold, mode)
    return exact_deduplicate(df, cleaned).select("split", "row_idx") if kept is None else kept


def with_fingerprint(df: DataFrame, cleaned: bool = False) -> DataFrame:
    """df with text_fingerprint, of cleaned texts; cleaned: text_clean went through all steps."""
    name = text_column(df, "text_clean", "text")
    return df.withColumn("text_fingerprint", fingerprint_digest(F.col(name), cleaned and name == "text_clean"))


def deduplicate_records(df: DataFrame, threshold: float = THRESHOLD, mode: str = "verified", cleaned: bool = False) -> DataFrame:
    """df without exact and near-duplicates, with text_fingerprint."""
    return with_fingerprint(df.join(kept_rows(df, threshold, mode, cleaned), ["split", "row_idx"], "left_semi"), cleaned)


def near_duplicate_examples(df: DataFrame, threshold: float = THRESHOLD, most: int = 10) -> DataFrame:
    """For each split the first dropped rows, with a preview and the smallest kept neighbour."""
    pairs = written(near_duplicate_pairs(df, threshold), "pairs")
    named = pairs.select("split", F.xxhash64("split", "l_row", "r_row").alias("bucket"), F.explode(F.array("l_row", "r_row")).alias("row_idx"))
    kept = greedy_kept(df, named).withColumnRenamed("row_idx", "l_row")
    hits = pairs.join(kept, ["split", "l_row"], "left_semi").groupBy("split", F.col("r_row").alias("row_idx")).agg(F.min("l_row").alias("matched_row"))
    place = F.row_number().over(W.partitionBy("split").orderBy("row_idx"))
    shown = hits.withColumn("place", place).filter(F.col("place") <= most).drop("place")
    text = F.col(text_column(df, "text_clean", "text"))
    return shown.join(df, ["split", "row_idx"]).select("split", "row_idx", "matched_row", F.substring(text, 1, 120).alias("duplicate_text_preview"))
