"""Mixing sources to target weights by repetition rates.

Sizes are summed per source (a partial aggregate, so a hot source is no hot task); each source's repetition rate is
its target over its size; a document is taken floor(rate) times, plus one Bernoulli copy whose draw is a hash of seed
and id and whose probability is the rate's fraction. A draw depends on nothing but the row, so reruns and lost
executors change nothing. Since the rate is 2 at most, so is the number of copies.

Defined results: a null text has size 0; null is a source of its own, after all others; rows with equal ids, or none, draw
by their source, text and other columns, and rows that are equal in all draw by their number among themselves (which of
them has which number makes no difference); an empty table gives an empty mix; a source of size 0 has target 0 and is taken
0 times (there is nothing in it to take). mix() replaces own columns that are named like those it adds; taken_rows_of()
keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwright.llm.common import WORD, id_text
from siftwright.shared import written

WEIGHTS = (5, 2, 1)  #: by the source's rank, repeating
SHARE = 1.5
MOST = 2
SEED = "mix-1"
SALTS = 1024  #: parts of a repeated key whose rows are numbered apart


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def unit_draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of md5(seed, key)."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(
    sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """source, source_size, target and rate from (source, size) rows.

    A target is its weight's part of share x all sizes, most x the source's size at most; what is above goes to the
    rest by weight. Water-filling in closed form: in the order of cap over weight, sources are full up to the first
    whose part of what is left stays below its cap. The windows run over one row a source, in one task: the README has its
    time for two million sources.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    sums = ranked.withColumns(
        {
            "all_words": F.sum("source_size").over(everything),
            "full": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "rest": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    sums = sums.withColumn("level", (F.lit(float(share)) * F.col("all_words") - F.col("full")) / F.col("rest"))
    open_from = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("full", "rest", "level")))
    sums = sums.withColumn("water", open_from.over(everything)["level"])
    part = F.col("water") * F.col("weight")
    target = F.when(F.col("water").isNull() | (part > F.col("cap")), F.col("cap").cast("double")).otherwise(part)
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return sums.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def copies(rate: Column, key: Column, seed: str = SEED) -> Column:
    whole = F.floor(rate)
    return (whole + (unit_draw(key, seed) < rate - whole).cast("long")).cast("int")


def _numbered(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """rows with place: 1, or for rows of a repeated key their number among those.

    Repeated rows are written once with a number of their own, then counted by salted parts of their key, so a key with any
    share of the rows is no hot task.
    """
    told = rows.join(repeats, "key", "left")
    several = written(told.filter("again").drop("again").withColumn("at", F.monotonically_increasing_id()), "mix-repeated")
    salted = several.withColumn("salt", F.col("at") % SALTS)
    inside = F.row_number().over(W.partitionBy("key", "salt").orderBy("at"))
    before = F.sum("k").over(W.partitionBy("key").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    counts = salted.groupBy("key", "salt").agg(F.count("*").alias("k")).select("key", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    placed = salted.withColumn("inside", inside).join(counts, ["key", "salt"]).withColumn("place", F.col("before") + F.col("inside"))
    single = told.filter(F.col("again").isNull()).drop("again").withColumn("place", F.lit(1).cast("long"))
    return single.unionByName(placed.select(single.columns))


def mixed_rows(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **targets
) -> DataFrame:
    """(row, size, source_size, target, copies), row being a struct of all columns of docs.

    Sizes and keys of all rows are written first. The join to sources is null-safe; the side with one row a source is small
    beside the documents, and Spark broadcasts it only if its size says so. Otherwise the skewed join is split by AQE.
    """
    others = [c for c in docs.columns if c not in (doc_id, text, source)]
    rest = [F.xxhash64(*(F.col(f"`{c}`") for c in others)).cast("string")] if others else []
    parts = [id_text(doc_id), id_text(source), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")), *rest]
    key = F.concat_ws("|", *parts)
    slim = written(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"), key.alias("key")), "mix-sizes")
    plan = source_targets(slim.select("source", "size"), **targets).select("source_size", "target", "rate", F.col("source").alias("of"))
    plan = written(plan, "mix-plan")  # so that the planner knows its size before it shuffles texts
    repeats = written(slim.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key", F.lit(True).alias("again")), "mix-repeats")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(whole, F.col(source).alias("source"), word_count(F.col(text)).alias("size"), key.alias("key"))
    rows = rows.withColumn("place", F.lit(1).cast("long")) if repeats.isEmpty() else _numbered(rows, repeats)
    joined = rows.join(plan, rows["source"].eqNullSafe(plan["of"]), "left")
    drawn = F.concat_ws("|", "key", F.col("place").cast("string"))
    return joined.select("row", "size", "source_size", "target", copies(F.col("rate"), drawn, seed).alias("copies"))


def mix(docs: DataFrame, **columns) -> DataFrame:
    """Each row of docs with _sw_size, _sw_source_size, _sw_target and _sw_copies beside its own columns."""
    added = ("size", "source_size", "target", "copies")
    own = [F.col(f"row.`{c}`") for c in docs.columns if c not in {f"_sw_{a}" for a in added}]
    return mixed_rows(docs, **columns).select(*own, *(F.col(a).alias(f"_sw_{a}") for a in added))


def taken_rows_of(docs: DataFrame, number: str = "mix_copy", **columns) -> DataFrame:
    """The mix of docs: all columns of docs, a row for each copy, numbered from 1 in the column number.

    Where docs has a column of that name, underscores are added to the number's until it has none.
    """
    while number in docs.columns:
        number += "_"
    taken = mixed_rows(docs, **columns).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*", F.col("copy").alias(number))


def taken_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each copy, numbered from 1 in _sw_copy."""
    return mixed.filter("_sw_copies > 0").withColumn("_sw_copy", F.explode(F.sequence(F.lit(1), F.col("_sw_copies"))))
