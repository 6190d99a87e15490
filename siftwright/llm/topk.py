"""Exact top-k search by inner product with a KD-tree per shard.

Vectors are dealt to shards of bounded size by a hash of the row, and each shard's tree is built once and written as a row
of an index table: median splits along the widest axis, down to leaves of ``LEAF`` vectors, a tight bounding box a node.
Queries come in blocks of bounded size; a task holds one block and the shards of one group, and searches one shard after
the other, best node first: a node's bound is the largest inner product that its box allows, and a node is opened only if
the bound beats the query's kth score so far (or equals it, and the node has a smaller id). The kth scores go from shard to
shard; before all others, every query meets one shard, whose kth score it takes along to all its tasks.

The search is exact whatever the bounds prune: in many dimensions boxes say little, and then all leaves are scored, as
matrix products. No task holds more than a block, a group of shards and k rows a query, however many rows are equal.

Defined results: vectors that are null or hold null or non-finite components take no part; a row is no candidate of its own
query, but a repeated row with the same id is, and is a query of its own; vectors of other lengths aren't compared; ties go
to the smaller id, null last (an id of 2**63 - 1 counts as null); fewer candidates than k give all; an empty table gives an
empty result; other columns aren't read. Scores beyond 64 bits are an OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwright.llm.common import group_starts
from siftwright.llm.vectors import integer_vectors, lists, products
from siftwright.shared import written

K = 10
LEAF = 64
SHARD = 2048  #: vectors, about
SHARDS_PER_TASK = 4
BLOCK = 8192  #: queries, about
NO_ID = np.iinfo(np.int64).max
NONE = np.iinfo(np.int64).min  #: a score below all others

_ROWS = "row long, id long, dim int, vector array<long>"
_TREE = "dim int, shard int, rows array<long>, ids array<long>, vectors array<long>, low array<long>, high array<long>, left array<int>, start array<int>, stop array<int>"
_FOUND = "query_row long, query_id long, vec_id long, score long"


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        at, lengths, values = integer_vectors(batch.column("vector"))
        ids = batch.column("id").take(pa.array(at))
        yield pa.RecordBatch.from_arrays([pa.array(row + at), ids, pa.array(lengths, pa.int32()), lists(values, lengths)], ["row", "id", "dim", "vector"])
        row += batch.num_rows


class Tree:
    """A shard's vectors in leaf order and its nodes, the root first; a node's right child follows its left one."""

    def __init__(self, rows, ids, vectors, low=None, high=None, left=None, start=None, stop=None):
        self.rows, self.ids, self.vectors = rows, ids, vectors
        self.low, self.high, self.left, self.start, self.stop = low, high, left, start, stop
        self.least_id = None if start is None else np.array([ids[a:b].min() for a, b in zip(start, stop, strict=True)])

    @classmethod
    def build(cls, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.argsort(ids, kind="stable")
        low, high, left, start, stop = [], [], [], [0], [len(ids)]
        for node in range(2 * len(ids)):
            if node == len(start):
                break
            a, b = start[node], stop[node]
            own = vectors[order[a:b]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            if b - a <= leaf:
                left.append(-1)
                order[a:b] = order[a:b][np.argsort(ids[order[a:b]], kind="stable")]
                continue
            spread = high[-1] - low[-1]
            if spread.any():  # else all are equal, and halves by id still have the smaller ids first
                order[a:b] = order[a:b][np.argsort(own[:, spread.argmax()], kind="stable")]
            middle = (a + b) // 2
            left.append(len(start))
            start += [a, middle]
            stop += [middle, b]
        return cls(rows[order], ids[order], vectors[order], np.array(low), np.array(high), np.array(left), np.array(start), np.array(stop))

    @classmethod
    def of(cls, record: dict[str, np.ndarray], dim: int) -> Tree:
        n, m = len(record["ids"]), len(record["left"])
        square = lambda name, k: record[name].reshape(k, dim)
        return cls(record["rows"], record["ids"], square("vectors", n), square("low", m), square("high", m), record["left"], record["start"], record["stop"])


def search(tree: Tree, queries: np.ndarray, own: np.ndarray, scores: np.ndarray, ids: np.ndarray, floor: np.ndarray) -> None:
    """Best-first search of all queries at once; scores and ids (k columns, best first) are what each has found, in place.

    floor: a score that each query's kth best is known to reach.
    """
    k = scores.shape[1]
    bound = products(np.maximum(queries, 0), tree.high.T) + products(np.minimum(queries, 0), tree.low.T)
    open_ = np.full(bound.shape, NONE)
    open_[:, 0] = bound[:, 0]
    active = np.arange(len(queries))
    while len(active):
        node = open_[active].argmax(axis=1)
        best = open_[active, node]
        kth = scores[active, k - 1]
        more = (best != NONE) & (best >= np.maximum(kth, floor[active]))
        active, node, best, kth = active[more], node[more], best[more], kth[more]
        open_[active, node] = NONE
        useful = (best > kth) | (tree.least_id[node] < ids[active, k - 1])
        at, node = active[useful], node[useful]
        inner = tree.left[node] >= 0
        for child in (0, 1):
            to = tree.left[node[inner]] + child
            open_[at[inner], to] = bound[at[inner], to]
        at, node = at[~inner], node[~inner]
        order = np.argsort(node, kind="stable")
        at, node = at[order], node[order]
        cuts = group_starts(node)
        for a, b in zip(cuts, np.append(cuts[1:], len(at)), strict=True) if len(at) else ():
            q, part = at[a:b], slice(tree.start[node[a]], tree.stop[node[a]])
            got = products(queries[q], tree.vectors[part].T)
            got[tree.rows[part][None, :] == own[q][:, None]] = NONE
            hit = got.max(axis=1) >= scores[q, k - 1]
            q, got = q[hit], got[hit]
            both = np.concatenate([scores[q], got], axis=1)
            names = np.concatenate([ids[q], np.broadcast_to(tree.ids[part], got.shape)], axis=1)
            top = np.lexsort((names, ~both), axis=1)[:, :k]
            scores[q], ids[q] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), dim)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy()


def _trees(table: pa.Table, dim: int) -> Iterator[Tree]:
    for i in range(table.num_rows):
        yield Tree.of({n: table.column(n)[i].values.to_numpy() for n in ("rows", "ids", "vectors", "low", "high", "left", "start", "stop")}, dim)


def _build(table: pa.Table) -> pa.Table:
    dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
    tree = Tree.build(table.column("row").to_numpy(), _ids(table.column("id")), _matrix(table.column("vector"), dim))
    long, short = pa.list_(pa.int64()), pa.list_(pa.int32())
    made = {"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "rows": pa.array([tree.rows], long), "ids": pa.array([tree.ids], long)}
    made |= {n: pa.array([x.ravel()], long) for n, x in (("vectors", tree.vectors), ("low", tree.low), ("high", tree.high))}
    return pa.table(made | {n: pa.array([x.astype(np.int32)], short) for n, x in (("left", tree.left), ("start", tree.start), ("stop", tree.stop))})


def build_index(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """The written rows (row, id, dim, vector) and the written index, a row a shard."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector")).mapInArrow(_integers, _ROWS)
    rows = written(rows, "topk-rows")
    n = max(1, -(-rows.count() // shard))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))
    return rows, written(dealt.groupBy("dim", "shard").applyInArrow(_build, _TREE), "topk-index")


def top_k(
    vectors: DataFrame,
    asked,
    *,
    k: int = K,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    shard: int = SHARD,
    block: int = BLOCK,
    shards_per_task: int = SHARDS_PER_TASK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id meets asked (a function of its column), the k best other rows."""
    rows, index = build_index(vectors, vec_id=vec_id, vector=vector, shard=shard)
    queries = rows.filter(asked(F.col("id")))
    blocks = max(1, -(-queries.count() // block))
    firsts = {r["dim"]: r.asDict() for r in index.filter("shard = 0").orderBy("dim").limit(4).collect()}  # a few shards at most

    def search_all(trees: Iterator[Tree], table: pa.Table, dim: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scores, ids = np.full((table.num_rows, k), NONE), np.full((table.num_rows, k), NO_ID)
        asked, own = _matrix(table.column("vector"), dim), table.column("row").to_numpy()
        for tree in trees:
            search(tree, asked, own, scores, ids, floor)
        return scores, ids

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = {d: Tree.of({n: np.array(x) for n, x in r.items() if n not in ("dim", "shard")}, d) for d, r in firsts.items()}
        for batch in batches:
            floor = np.full(batch.num_rows, NONE)
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                if dim in trees:
                    at = np.flatnonzero(dims == dim)
                    own = pa.Table.from_batches([batch.take(pa.array(at))])
                    floor[at] = search_all(iter([trees[dim]]), own, int(dim), floor[at])[0][:, -1]
            yield batch.append_column("floor", pa.array(floor))

    def of_group(key: tuple, shards: pa.Table, table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        if not table.num_rows or not shards.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_row", "query_id", "vec_id", "score")})
        scores, ids = search_all(_trees(shards, dim), table, dim, table.column("floor").to_numpy())
        at, rank = np.nonzero(scores != NONE)
        names = ids[at, rank]
        taken = lambda name: table.column(name).take(pa.array(at))
        return pa.table({"query_row": taken("row"), "query_id": taken("id"), "vec_id": pa.array(names, mask=names == NO_ID), "score": pa.array(scores[at, rank])})

    groups = F.sequence(F.lit(0), F.expr(f"{max(0, index.agg(F.max('shard')).first()[0] or 0)} div {shards_per_task}").cast("int"))
    asked_rows = queries.mapInArrow(floors, _ROWS + ", floor long").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    left = index.withColumn("group", F.expr(f"shard div {shards_per_task}").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked_rows.withColumn("group", F.explode(groups))
    key = ["dim", "group", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(of_group, _FOUND)
    best = W.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
