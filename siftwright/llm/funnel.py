"""Ordered funnel counting over one table of successor edges.

``successor_edges`` makes, once for any number of funnels, a written table with a row for each event and pair of kinds: the
client's earliest later event of the pair's second kind, if it lies within the limit, and which of the excluded kinds lie
between. ``count_funnels`` composes it: all funnels go one step a round; attempts that share a target collapse into one
weighted row; a step's times are weighted histograms, out of which the percentile is found by digits.

No key gathers in one task. A successor lies in its event's time cell, which is as wide as the limit, or in the next one, so
edges are made by (client, cell); joins are by (client, time); a percentile looks at 1,000 sums of a client at most. Every
round is a written table: a lost executor costs a re-read.

Defined results: rows with a null client, kind or time take no part; repeated (client, kind, time) rows count once; events
of the same time don't follow one another; an excluded event at the next step's time is not after it and blocks; an empty
table gives an empty result; other columns of any name are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from siftwright.shared import discard, written

WITHIN_US = 15 * 60 * 1_000_000
PERCENT = 50
#: Digits of a time, in microseconds: a client has no more than 1,000 sums at any of them, up to limits of 1,000 seconds.
DIGITS = (1_000_000, 1_000, 1)


@dataclass(frozen=True)
class Funnel:
    name: str
    steps: tuple[str, ...]
    excluding: tuple[str, ...] = ()

    @property
    def pairs(self) -> list[tuple[str, str]]:
        return list(zip(self.steps, self.steps[1:], strict=False))


def micros(events: DataFrame, column: str) -> Column:
    """Microseconds since 1970; a timestamp without a zone is taken as it reads, whatever zone the session has."""
    ts = F.col(column)
    if isinstance(events.schema[column].dataType, TimestampType):
        return F.unix_micros(ts)
    seconds = F.unix_date(ts.cast("date")).cast("long") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def _blocks(excluded: list[str], among: tuple[str, ...]) -> int:
    return sum(1 << i for i, kind in enumerate(excluded) if kind in among)


def successor_edges(
    events: DataFrame,
    pairs: set[tuple[str, str]],
    excluded: list[str],
    *,
    client: str = "client_id",
    kind: str = "kind",
    ts: str = "ts",
    within_us: int = WITHIN_US,
) -> DataFrame:
    """A written table (client, src, dst, ts, next, blocked): a row for each event and pair (src, dst) of its kind.

    next is null without a successor within the limit; blocked has bit i set if an event of kind excluded[i] lies after ts
    and not after next.
    """
    sought = sorted({dst for _, dst in pairs} | set(excluded))
    rows = events.select(F.col(client).alias("client"), F.col(kind).alias("kind"), micros(events, ts).alias("ts"))
    rows = rows.filter(F.col("client").isNotNull() & F.col("ts").isNotNull() & F.col("kind").isin(sorted({src for src, _ in pairs} | set(sought))))
    cell = F.col("ts") - F.pmod(F.col("ts"), F.lit(within_us))
    # each event is also seen from the cell before its own
    rows = rows.withColumn("cell", F.explode(F.array(cell, cell - within_us))).repartition("client", "cell").distinct()
    later = W.partitionBy("client", "cell").orderBy(F.col("ts").desc()).rangeBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({f"next_{i}": F.min(F.when(F.col("kind") == k, F.col("ts"))).over(later) for i, k in enumerate(sought)})
    after = {k: F.col(f"next_{i}") for i, k in enumerate(sought)}

    def edge(dst: str) -> Column:
        reached = after[dst] - F.col("ts") <= within_us
        bits = [F.when(after[k] <= after[dst], 1 << i).otherwise(0) for i, k in enumerate(excluded)]
        blocked = reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0))
        return F.struct(F.lit(dst).alias("dst"), F.when(reached, after[dst]).alias("next"), F.when(reached, blocked).alias("blocked"))

    edges = F.lit(None)
    for src in sorted({src for src, _ in pairs}):
        found = F.array(*(edge(dst) for dst in sorted(d for s, d in pairs if s == src)))
        edges = F.when(F.col("kind") == src, found).otherwise(edges)
    own = rows.filter((F.col("ts") >= F.col("cell")) & (F.col("ts") < F.col("cell") + within_us))
    made = own.select("client", F.col("kind").alias("src"), "ts", F.explode(edges).alias("e")).select("client", "src", "ts", "e.*")
    return written(made, "successor-edges")


def _step(edges: DataFrame, funnels: list[Funnel], excluded: list[str], k: int) -> DataFrame:
    """The edges of the k-th pair (from 0) of every funnel that has one, with the funnel and whether its exclusions let pass."""
    wanted = [(f.name, *f.pairs[k], _blocks(excluded, f.excluding)) for f in funnels if k < len(f.pairs)]
    asked = edges.sparkSession.createDataFrame(wanted, "funnel string, src string, dst string, mask int")
    among = reduce(or_, ((F.col("src") == s) & (F.col("dst") == d) for s, d in sorted({w[1:3] for w in wanted})))
    passed = F.col("next").isNotNull() & (F.col("blocked").bitwiseAND(F.col("mask")) == 0)
    rows = edges.filter(among).join(F.broadcast(asked), ["src", "dst"])  # a row for each funnel
    return rows.select("funnel", "client", "ts", F.when(passed, F.col("next")).alias("next"))


def _percentiles(times: DataFrame, percent: int) -> DataFrame:
    """(funnel, client, step, n, t) from (funnel, client, step, dt, w): n = sum of w, t = ceil(percent * n / 100)-th smallest dt.

    One digit of t a round: of the histogram of the digit, the first entry whose running sum reaches the rank; then the same
    for what this entry holds. A histogram has 1,000 entries a client at most, summed before they meet.
    """
    group = ["funnel", "client", "step"]
    order = W.partitionBy(*group).orderBy("digit")
    left, known = times.withColumns({"rest": F.col("dt"), "rank": F.lit(None).cast("long"), "n": F.lit(None).cast("long"), "t": F.lit(0).cast("long")}), None
    for i, unit in enumerate(DIGITS):
        entry = F.expr(f"rest div {unit}").alias("digit")
        sums = left.groupBy(*group, "rank", "n", "t", entry).agg(F.sum("w").alias("w"))
        upto = sums.withColumn("upto", F.sum("w").over(order.rowsBetween(W.unboundedPreceding, 0)))
        if i == 0:
            total = F.sum("w").over(W.partitionBy(*group))
            upto = upto.withColumn("n", total).withColumn("rank", F.expr(f"({percent} * n + 99) div 100"))
        picked = upto.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("w") < F.col("rank")))
        rank = F.col("rank") - F.col("upto") + F.col("w")
        known = picked.select(*group, "n", rank.alias("rank"), (F.col("t") + F.col("digit") * unit).alias("t"), "digit")
        if unit > 1:
            inside = left.select(*group, entry, F.expr(f"rest % {unit}").alias("rest"), "w")
            left = inside.join(known, [*group, "digit"]).drop("digit")
    return known.select(*group, "n", "t")


def count_funnels(
    events: DataFrame,
    funnels: list[Funnel],
    *,
    client: str = "client_id",
    kind: str = "kind",
    ts: str = "ts",
    within_us: int = WITHIN_US,
    percent: int = PERCENT,
) -> DataFrame:
    """A row for each funnel and client with attempts.

    Columns: funnel, the client's column, n1 to nK (attempts that reach each step), deepest, t2 to tK (the percentile of the
    microseconds from the step before; null if none), same_depth (clients of equal funnel and deepest). K is the steps of
    the longest funnel; a shorter one has 0 and null there.
    """
    excluded = sorted({k for f in funnels for k in f.excluding})
    pairs = {p for f in funnels for p in f.pairs}
    most = max(len(f.steps) for f in funnels)
    edges = successor_edges(events, pairs, excluded, client=client, kind=kind, ts=ts, within_us=within_us)

    first = _step(edges, funnels, excluded, 0)
    starts = first.groupBy("funnel", "client").agg(F.count("*").alias("n1"))
    reached = []
    for k in range(most - 1):
        if k:
            arrived = reached[-1].groupBy("funnel", "client", F.col("next").alias("ts")).agg(F.sum("w").alias("w"))
            moves = _step(edges, funnels, excluded, k).filter(F.col("next").isNotNull()).join(arrived, ["funnel", "client", "ts"])
        else:
            moves = first.filter(F.col("next").isNotNull()).withColumn("w", F.lit(1).cast("long"))
        reached.append(written(moves.select("funnel", "client", "ts", "next", "w"), f"funnel-step-{k + 2}"))
    times = reduce(DataFrame.unionByName, (r.select("funnel", "client", F.lit(k + 2).alias("step"), (F.col("next") - F.col("ts")).alias("dt"), "w") for k, r in enumerate(reached)))
    times = written(times.groupBy("funnel", "client", "step", "dt").agg(F.sum("w").alias("w")), "funnel-times")
    found = _percentiles(times, percent)

    later = range(2, most + 1)
    at = lambda column, k: F.max(F.when(F.col("step") == k, F.col(column)))
    wide = found.groupBy("funnel", "client").agg(*(at("n", k).alias(f"n{k}") for k in later), *(at("t", k).alias(f"t{k}") for k in later))
    rows = starts.join(wide, ["funnel", "client"], "left")
    rows = rows.withColumns({f"n{k}": F.coalesce(F.col(f"n{k}"), F.lit(0).cast("long")) for k in later})
    deepest = F.greatest(F.lit(1), *(F.when(F.col(f"n{k}") > 0, k).otherwise(1) for k in later))
    rows = written(rows.withColumn("deepest", deepest), "funnel-rows")
    discard(edges, times, *reached)
    depths = rows.groupBy("funnel", "deepest").agg(F.count("*").alias("same_depth"))  # a row for each funnel and step at most
    names = ["funnel", F.col("client").alias(client), *(f"n{k}" for k in range(1, most + 1)), "deepest", *(f"t{k}" for k in later), "same_depth"]
    return rows.join(F.broadcast(depths), ["funnel", "deepest"]).select(*names)
