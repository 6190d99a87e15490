"""Funnels against a plain walk over each client's events."""

import datetime as dt
import random

import pytest

from siftwright.llm import funnel, queries

BASE = dt.datetime(2024, 3, 31, 1, 50)  # spans a change of clocks in many zones
SCHEMA = "click_id long, ts timestamp_ntz, client_id long, kind string, next string, funnel string"


def walked(rows, funnels, within=funnel.WITHIN_US):
    """{(funnel, client): (n1.., deepest, t2..)} by walking every attempt."""
    by = {}
    for client, kind, ts in {(r[2], r[3], r[1]) for r in rows if None not in (r[1], r[2], r[3])}:
        by.setdefault(client, []).append(((ts - BASE) // dt.timedelta(microseconds=1), kind))
    out = {}
    for f in funnels:
        for client, events in by.items():
            times = [[] for _ in f.steps]
            for start, kind in events:
                if kind != f.steps[0]:
                    continue
                at = start
                times[0].append(0)
                for k, step in enumerate(f.steps[1:], 1):
                    later = [t for t, what in events if what == step and t > at]
                    if not later or min(later) - at > within or any(at < t <= min(later) for t, what in events if what in f.excluding):
                        break
                    times[k].append(min(later) - at)
                    at = min(later)
            if times[0]:
                n = [len(t) for t in times]
                out[f.name, client] = (*n, max(k + 1 for k, x in enumerate(n) if x), *(sorted(t)[(len(t) + 1) // 2 - 1] if t else None for t in times[1:]))
    same, steps = {}, {f.name: len(f.steps) for f in funnels}
    depth = lambda name, x: (name, x[steps[name]])
    for (name, _), x in out.items():
        same[depth(name, x)] = same.get(depth(name, x), 0) + 1
    return {k: (*x, same[depth(k[0], x)]) for k, x in out.items()}


def counted(spark, rows, funnels=queries.FUNNELS, parts=3):
    got = funnel.count_funnels(spark.createDataFrame(rows, SCHEMA).repartition(parts), funnels).collect()
    return {(r["funnel"], r["client_id"]): tuple(r[n] for n in ("n1", "n2", "n3", "n4", "deepest", "t2", "t3", "t4", "same_depth")) for r in got}


def events(seed, n, clients, span_s, step_us=1):
    rng = random.Random(seed)
    kinds = ["view"] * 5 + ["click"] * 4 + ["purchase"] * 3 + ["signup"] + ["error", None, "other"]
    # a third of the rows has one client; times repeat
    pick = lambda: BASE + dt.timedelta(microseconds=rng.randrange(0, span_s * 1_000_000, step_us))
    return [(i, None if rng.random() < 0.02 else pick(), None if rng.random() < 0.02 else rng.choice([7, rng.randrange(clients), rng.randrange(clients)]), rng.choice(kinds), "x", "y") for i in range(n)]


@pytest.mark.parametrize("seed, span_s, step_us", [(1, 7200, 1), (2, 9000, 60_000_000), (3, 40_000, 1_000_000)])
def test_equals_a_walk(spark, seed, span_s, step_us):
    rows = events(seed, 600, 12, span_s, step_us)
    rows += rows[:40]  # repeated rows
    assert counted(spark, rows) == walked(rows, queries.FUNNELS)


def test_limits_and_ties(spark):
    at = lambda us: BASE + dt.timedelta(microseconds=us)
    w = funnel.WITHIN_US
    row = lambda i, us, client, kind: (i, at(us), client, kind, None, None)
    rows = [
        *[row(i, us, 1, kind) for i, (us, kind) in enumerate([(0, "view"), (w, "click"), (w, "view"), (2 * w + 1, "view")])],  # exactly the limit, then over it
        *[row(10 + i, us, 2, kind) for i, (us, kind) in enumerate([(0, "view"), (5, "error"), (5, "click")])],  # blocked by a tie with the next step
        *[row(20 + i, us, 3, kind) for i, (us, kind) in enumerate([(0, "error"), (0, "view"), (5, "click"), (6, "view"), (6, "error")])],  # not blocked by one with the step
        *[row(30 + i, us, 4, kind) for i, (us, kind) in enumerate([(-3, "view"), (0, "view"), (2, "view"), (9, "click"), (9, "view"), (10, "view"), (11, "purchase")])],  # shared targets
    ]
    got = counted(spark, rows)
    assert got == walked(rows, queries.FUNNELS)
    assert got["A", 1][:4] == (3, 1, 0, 0) and got["A", 2][:4] == (1, 0, 0, 0) and got["A", 3][:4] == (1 + 1, 1, 0, 0)
    assert got["A", 4] == (5, 3, 3, 3, 4, 9, 1, 1, 1)


def test_partitions_change_nothing(spark):
    rows = events(5, 400, 6, 5000)
    assert counted(spark, rows, parts=1) == counted(spark, rows, parts=9)


def test_empty_and_shorter_funnels(spark):
    assert counted(spark, []) == {}
    assert counted(spark, [(1, None, 1, "view", None, None), (2, BASE, None, "view", None, None), (3, BASE, 1, None, None, None)]) == {}
    rows = events(6, 300, 5, 3000)
    short = [funnel.Funnel("S", ("view", "click")), *queries.FUNNELS]
    got = counted(spark, rows, short)
    want = walked(rows, [funnel.Funnel("S", ("view", "click"))])
    assert {k: (*v[:2], v[4], v[5]) for k, v in got.items() if k[0] == "S"} == {k: (*v[:2], v[2], v[3]) for k, v in want.items()}
    assert all(v[2:4] == (0, 0) and v[6:8] == (None, None) for k, v in got.items() if k[0] == "S")


def test_edges_are_made_once_for_all_pairs(spark):
    rows = events(7, 300, 4, 3000)
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = {("view", "click"), ("click", "click")}
    edges = funnel.successor_edges(df, pairs, ["error", "signup"]).collect()
    own = {(r[2], r[3], r[1]) for r in rows if None not in (r[1], r[2], r[3])}
    assert len(edges) == sum(1 for _, kind, _ in own if kind == "view") + sum(1 for _, kind, _ in own if kind == "click")
    assert {(e["src"], e["dst"]) for e in edges} == pairs
