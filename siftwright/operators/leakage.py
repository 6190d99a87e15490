"""Leakage between splits: shared fingerprints, and source rows with a similar target row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwright.functions.text import cleaning_fingerprint, recleaned, unstable
from siftwright.operators.dedup import THRESHOLD
from siftwright.operators.records import text_column
from siftwright.operators.similarity import DENSE, Lists, collapsed, first_matches, hashed, inverted_lists, words_of
from siftwright.schema import SPLITS
from siftwright.shared import discard, written

EXAMPLES = 5
SAMPLE = 2000


def _fingerprint(df: DataFrame, cleaned: bool) -> Column:
    """The cleaned, lower-cased text of a row; null if it is blank or null.

    cleaned: text_clean went through all cleaning steps, and no other text column stands before it.
    """
    name = text_column(df)
    text = F.col(name)
    if cleaned and name == "text_clean":
        fingerprint = F.lower(recleaned(F.nullif(text, F.lit(""))))
    else:
        fingerprint = F.when(text.rlike(r"(?U)\S"), cleaning_fingerprint(text))
    return F.nullif(fingerprint, F.lit(""))


def _digest(fingerprint: Column) -> Column:
    """32 bytes that stand for a fingerprint where texts aren't shown, so that these aren't shuffled."""
    return F.unhex(F.sha2(fingerprint.cast("binary"), 256))


def _shared(rows: DataFrame) -> DataFrame:
    """(fingerprint, source_split, target_split), in the order of SPLITS, of fingerprints that rows of both splits have."""
    met = rows.groupBy("fingerprint").agg(*(F.bool_or(F.col("split") == s).alias(s) for s in SPLITS)).filter(F.col("fingerprint").isNotNull())
    pairs = [(a, b) for i, a in enumerate(SPLITS) for b in SPLITS[i + 1 :]]
    found = (F.when(F.col(a) & F.col(b), F.struct(F.lit(a).alias("source_split"), F.lit(b).alias("target_split"))) for a, b in pairs)
    return met.select("fingerprint", F.inline(F.filter(F.array(*found), lambda p: p.isNotNull())))


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("source_split", "target_split").agg(F.count("*").alias("n"))


def shared_fingerprints(df: DataFrame, cleaned: bool = False) -> DataFrame:
    """(fingerprint, source_split, target_split) of texts in both splits; one shuffle. Blank and null texts are left out.

    cleaned: as in _fingerprint().
    """
    return _shared(df.filter(F.col("split").isin(*SPLITS)).select("split", _fingerprint(df, cleaned).alias("fingerprint")))


def exact_leakage(df: DataFrame, cleaned: bool = False) -> DataFrame:
    """(source_split, target_split, n) of distinct shared fingerprints; only pairs that have some. Digests are shuffled, not texts."""
    marked = df.filter(F.col("split").isin(*SPLITS)).select("split", _fingerprint(df, cleaned).alias("fingerprint"))
    return _counted(_shared(marked.select("split", _digest(F.col("fingerprint")).alias("fingerprint"))))


def exact_examples(df: DataFrame, most: int = EXAMPLES, shared: DataFrame | None = None) -> DataFrame:
    """shared: of shared_fingerprints(), if it is there already."""
    place = F.row_number().over(W.partitionBy("source_split", "target_split").orderBy("fingerprint"))
    return (shared_fingerprints(df) if shared is None else shared).withColumn("place", place).filter(F.col("place") <= most)


def first_rows(df: DataFrame, limit: int | None = SAMPLE) -> DataFrame:
    """The first rows of each split in order, of those with a text; None takes all."""
    rows = df.filter(F.col("split").isin(*SPLITS) & F.col(text_column(df)).isNotNull())
    if limit is None:
        return rows
    parts = [rows.filter(F.col("split") == s).orderBy("row_idx").limit(limit) for s in SPLITS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _lists(df: DataFrame, threshold: float, limit: int | None, **also: Column) -> tuple[Lists, DataFrame]:
    """Lists of rows by their splits' places in SPLITS, which is text order, and collapsed()'s rows; columns of also go along with these.

    A text of a column unstable gets NFKC and replaces the digest in the column fingerprint.
    """
    order = F.create_map(*(F.lit(x) for i, s in enumerate(SPLITS) for x in (s, str(i))))
    split, text = F.element_at(order, F.col("split")).alias("split"), F.col(text_column(df)).alias("text")
    rows = first_rows(df, limit).select(split, "row_idx", text, *(c.alias(n) for n, c in also.items()))
    words = written(words_of(rows, *also), "words", **DENSE)
    sets = hashed(words, "unstable" if "unstable" in also else None)
    if "unstable" in also:
        sets = sets.withColumn("fingerprint", F.coalesce(_digest(F.lower("unstable")), "fingerprint")).drop("unstable")
    sets, members = collapsed(sets, words)
    lists = inverted_lists(sets, threshold, across=True, words=words, members=members)
    discard(words)
    return lists, members


def _named(column: str) -> Column:
    return F.element_at(F.array(*map(F.lit, SPLITS)), F.col(column).cast("int") + 1)


def _spread(lists: Lists, members: DataFrame) -> DataFrame:
    """near_matches() of what _lists() made."""
    found = first_matches(lists)
    spread = found.join(members.select(F.col("split").alias("l_split"), "row_idx", F.col("first").alias("l_row")), ["l_split", "l_row"])
    shown = F.round("jaccard", 4).alias("jaccard")
    return spread.select(_named("l_split").alias("source_split"), _named("r_split").alias("target_split"), "row_idx", F.col("r_row").alias("matched_row"), shown)


def near_matches(df: DataFrame, threshold: float = THRESHOLD, limit: int | None = SAMPLE) -> DataFrame:
    """(source_split, target_split, row_idx, matched_row, jaccard) of each source row with a similar target row.

    The match is the first target row, and similarity is exact. Rows of a split with one and the same set of shingles are
    matched once and expanded by their set.
    """
    return _spread(*_lists(df, threshold, limit))


def near_leakage(df: DataFrame, threshold: float = THRESHOLD, limit: int | None = SAMPLE) -> DataFrame:
    """(source_split, target_split, n) of source rows with a similar target row: not symmetric."""
    return _counted(near_matches(df, threshold, limit))


def near_examples(df: DataFrame, threshold: float = THRESHOLD, limit: int | None = SAMPLE, most: int = EXAMPLES, matches: DataFrame | None = None) -> DataFrame:
    """matches: of near_matches(), if they are there already."""
    place = F.row_number().over(W.partitionBy("source_split", "target_split").orderBy("row_idx"))
    matches = near_matches(df, threshold, limit) if matches is None else matches
    shown = matches.withColumn("place", place).filter(F.col("place") <= most)
    texts = df.select("row_idx", F.substring(text_column(df), 1, 80).alias("preview"))
    shown = shown.join(texts.withColumnRenamed("preview", "source_preview"), "row_idx")
    return shown.join(texts.toDF("matched_row", "target_preview"), "matched_row").orderBy("source_split", "target_split", "place")


def leakage_summary(df: DataFrame, threshold: float = THRESHOLD, limit: int | None = SAMPLE, cleaned: bool = False) -> DataFrame:
    """One row: passed, pairs with exact and near leaks, and their totals.

    Without a limit, one pass over the texts makes both sets and digests, which stay beside the rows of the sets.
    """
    if limit is None:
        text = F.col(text_column(df))
        if cleaned and text_column(df) == "text_clean":  # _fingerprint(), without Python workers of its own
            also = {"fingerprint": _digest(F.nullif(F.lower(text), F.lit(""))), "unstable": unstable(text)}
        else:
            also = {"fingerprint": _digest(_fingerprint(df, cleaned))}
        lists, members = _lists(df, threshold, None, **also)
        exact = _counted(_shared(members.select(_named("split").alias("split"), "fingerprint")))
        near = _counted(_spread(lists, members))
    else:
        exact, near = exact_leakage(df, cleaned), near_leakage(df, threshold, limit)
    kinds = exact.withColumn("kind", F.lit("exact")).unionByName(near.withColumn("kind", F.lit("near")))
    pairs = lambda k: F.coalesce(F.sum((F.col("kind") == k).cast("long")), F.lit(0).cast("long"))
    total = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0).cast("long"))
    return kinds.agg(
        (F.count("*") == 0).alias("passed"),
        pairs("exact").alias("exact_leak_pairs"),
        pairs("near").alias("near_leak_pairs"),
        total("exact").alias("total_exact_overlaps"),
        total("near").alias("total_near_overlaps"),
    )
