"""Product quantization: codebooks by heap Lloyd, and the codes of all vectors.

Vectors are cut into PARTS consecutive parts, and each part position has a codebook of its own. Lloyd rounds keep, for each
part, the slack between a lower bound of the distance to its second nearest entry and an upper bound of that to its own.
The slacks of the parts of one entry form a heap, local to a chunk of vectors, keyed by slack plus the drift that the entry
had gathered so far. A round moves the entries, adds to each one's cumulative drift how far it and the farthest other one
moved, and pops only parts whose key the drift has reached; these are measured exactly against all entries and pushed to
the heap of their nearest. All others still have the nearest entry they had.

A heap is kept as an ascending run of keys (which is a heap): what a round pops is a prefix, and pushes are merged in.

Chunks are rows of a table: vectors, heaps and each entry's sums. A round reads the table, writes the next one and sums the
chunks' sums, first within a task; the codebooks, whose size is fixed, are all that reaches the driver. A lost executor
costs a re-read of the last table.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; a null id is kept, after all
others; repeated rows are rows of their own; ties go to the lower index; fewer vectors than ENTRIES give as many entries;
an empty table gives an empty result; extra columns are not read. Vectors of different lengths, or of a length that PARTS
doesn't divide, are a ValueError; sums beyond 64 bits an OverflowError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.llm.common import group_starts, join_heavy
from siftwright.llm.vectors import integer_vectors, products
from siftwright.shared import discard, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
CHUNK = 8192
#: Slack that floating-point bounds may be wrong by, relative to their size.
MARGIN = 1e-9

#: Of each part position: the parts in heap order (entry, key), their entries, their keys.
_CHUNK = "ids array<long>, labels array<string>, vectors array<long>, members array<int>, entries array<int>, keys array<double>, sums array<long>, counts array<long>, rescanned long"


@dataclass(frozen=True)
class Books:
    """Codebooks (parts, entries, width) and the drift that each entry has gathered since the first round."""

    entries: np.ndarray
    drift: np.ndarray

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Books:
        """Entries at the floor of their parts' means; an entry's drift grows by its own way and the longest of the others'."""
        used = counts[..., None] > 0
        entries = np.where(used, sums // np.maximum(counts[..., None], 1), self.entries)
        way = np.sqrt(((entries - self.entries).astype(np.float64) ** 2).sum(axis=2))
        if way.shape[1] > 1:
            order = np.argsort(way, axis=1)
            first, second = (np.take_along_axis(way, order[:, -i, None], 1) for i in (1, 2))
            others = np.where(np.arange(way.shape[1])[None, :] == order[:, -1, None], second, first)
        else:
            others = np.zeros_like(way)
        return Books(entries, self.drift + way + others)


def distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all parts to all entries, exactly."""
    norm = lambda x: (x * x).sum(axis=1)
    return norm(parts)[:, None] - 2 * products(parts, entries.T) + norm(entries)[None, :]


def scan(parts: np.ndarray, books: Books, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part, and its key: slack plus the entry's drift."""
    squared = distances(parts, books.entries[p])
    nearest = squared.argmin(axis=1)
    upper = np.sqrt(squared[np.arange(len(parts)), nearest].astype(np.float64))
    if squared.shape[1] == 1:
        return nearest, np.full(len(parts), np.inf)
    lower = np.sqrt(np.partition(squared, 1, axis=1)[:, 1].astype(np.float64))
    slack = lower - upper - MARGIN * (1 + lower)
    return nearest, slack + books.drift[p, nearest]


def popped(members: np.ndarray, entries: np.ndarray, keys: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """True for what is popped: of each entry's heap the prefix of keys that its drift has reached."""
    out = np.zeros(len(members), bool)
    starts = group_starts(entries)
    for a, b in zip(starts, np.append(starts[1:], len(entries)), strict=True) if len(entries) else ():
        reached = drift[entries[a]]
        out[a : a + np.searchsorted(keys[a:b], reached + MARGIN * (1 + reached), side="right")] = True
    return out


def lloyd_round(parts: np.ndarray, heap: tuple | None, books: Books, p: int) -> tuple[tuple, int]:
    """The heaps of one part position of a chunk after a round, and how many parts were measured."""
    if heap is None:
        members, (entries, keys) = np.arange(len(parts)), scan(parts, books, p)
        n = len(members)
    else:
        members, entries, keys = heap
        out = popped(*heap, books.drift[p])
        n = int(out.sum())
        if not n:
            return heap, 0
        again = members[out]
        near, slack = scan(parts[again], books, p)
        members, entries, keys = (np.concatenate([x[~out], y]) for x, y in ((members, again), (entries, near), (keys, slack)))
    order = np.lexsort((keys, entries))
    return (members[order], entries[order], keys[order]), n


def entry_sums(parts: np.ndarray, heap: tuple, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and count of each entry's parts, from their order in the heaps."""
    members, of, _ = heap
    sums, counts = np.zeros((entries, parts.shape[1]), np.int64), np.zeros(entries, np.int64)
    starts = group_starts(of)
    if len(of):
        sums[of[starts]] = np.add.reduceat(parts[members], starts, axis=0)
        counts[of[starts]] = np.diff(np.append(starts, len(of)))
    return sums, counts


def _cut(vectors: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(vectors, parts, axis=1)


def _chunks(dim: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(held: list) -> pa.RecordBatch:
            ids, labels, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
            whole = {"ids": pa.array([ids.tolist()], pa.list_(pa.int64())), "labels": pa.array([labels.tolist()], pa.list_(pa.string())), "vectors": pa.array([vectors], pa.list_(pa.int64()))}
            return pa.RecordBatch.from_pydict(whole)

        held, n = [], 0
        for batch in batches:
            at, lengths, values = integer_vectors(batch.column("vector"))
            if (lengths != dim).any():
                raise ValueError(f"vectors of {dim} and {lengths[lengths != dim][0]} components")
            columns = [batch.column(c).take(pa.array(at)) for c in ("id", "label")]
            ids, labels = (np.array(c.to_pylist(), object) for c in columns)
            for i in range(0, len(at), chunk):
                held.append((ids[i : i + chunk], labels[i : i + chunk], values[i * dim : (i + chunk) * dim]))
                n += len(held[-1][0])
                if n >= chunk:
                    yield row(held)
                    held, n = [], 0
        if n:
            yield row(held)

    return run


def _round(books: Books, dim: int):
    parts_n, entries_n, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                of = lambda name: batch.column(name)[i].values.to_numpy()  # noqa: B023, E731
                vectors = of("vectors").reshape(-1, dim)
                heaps = None
                if "members" in batch.schema.names:
                    heaps = [np.split(of(name), parts_n) for name in ("members", "entries", "keys")]
                made, sums, counts, scanned = [], [], [], 0
                for p, parts in enumerate(_cut(vectors, parts_n)):
                    heap, again = lloyd_round(parts, None if heaps is None else tuple(h[p] for h in heaps), books, p)
                    s, c = entry_sums(parts, heap, entries_n)
                    made.append(heap)
                    sums.append(s.ravel())
                    counts.append(c)
                    scanned += again
                flat = lambda k, kind: pa.array([np.concatenate([h[k] for h in made]).astype(kind)])  # noqa: B023, E731
                kept = [batch.column(c).slice(i, 1) for c in ("ids", "labels", "vectors")]
                new = [flat(0, np.int32), flat(1, np.int32), flat(2, np.float64), pa.array([np.concatenate(sums)]), pa.array([np.concatenate(counts)]), pa.array([scanned])]
                yield pa.RecordBatch.from_arrays(kept + new, [x.split(" ")[0] for x in _CHUNK.split(", ")])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums and counts end to end, one row."""
    total = None
    for batch in batches:
        for i in range(batch.num_rows):
            own = np.concatenate([batch.column(c)[i].values.to_numpy() for c in ("sums", "counts")])
            total = own if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "n"])


def first_books(vectors: DataFrame, *, vec_id: str, vector: str, parts: int, entries: int) -> Books | None:
    """The parts of the vectors with the smallest ids; None without any vector. What the driver takes is bounded by entries."""
    x = lambda c: c.cast("double")
    whole = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < float("inf")))
    kept = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector")).filter(F.col("vector").isNotNull() & whole)
    rows = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).toArrow()
    if not rows.num_rows:
        return None
    _, lengths, values = integer_vectors(rows.column("vector").combine_chunks())
    dim = int(lengths[0])
    if (lengths != dim).any() or dim % parts or not dim:
        raise ValueError(f"vectors of {sorted(set(lengths.tolist()))} components and {parts} parts")
    cut = np.stack(_cut(values.reshape(-1, dim), parts))
    return Books(cut, np.zeros(cut.shape[:2]))


def fit(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, chunk: int = CHUNK) -> tuple[Books | None, DataFrame | None, list[int]]:
    """The codebooks, the written chunks as assigned to them, and how many parts each round measured."""
    books = first_books(vectors, vec_id=vec_id, vector=vector, parts=parts, entries=entries)
    if books is None:
        return None, None, []
    dim = books.entries.shape[0] * books.entries.shape[2]
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"))
    held = written(rows.mapInArrow(_chunks(dim, chunk), "ids array<long>, labels array<string>, vectors array<long>"), "codes-vectors")
    measured = []
    for i in range(rounds + 1):
        before, held = held, written(held.mapInArrow(_round(books, dim), _CHUNK), f"codes-round-{i}")
        discard(before)
        measured.append(held.agg(F.sum("rescanned")).first()[0])
        if i < rounds:
            added = held.select("sums", "counts").mapInArrow(_add_up, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
            total = added.toPandas().set_index("at")["n"].sort_index().to_numpy()  # as many numbers as the codebooks have
            cut = books.entries.size
            books = books.moved(total[:cut].reshape(books.entries.shape), total[cut:].reshape(books.entries.shape[:2]))
    return books, held, measured


def _codes(books: Books, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                of = lambda name: batch.column(name)[i].values  # noqa: B023, E731
                vectors = of("vectors").to_numpy().reshape(-1, dim)
                code, error = np.zeros((len(vectors), len(books.entries)), np.int64), np.zeros(len(vectors), np.int64)
                members, entries = (np.split(of(c).to_numpy(), len(books.entries)) for c in ("members", "entries"))
                for p, parts in enumerate(_cut(vectors, len(books.entries))):
                    code[members[p], p] = entries[p]
                    error += ((parts - books.entries[p][code[:, p]]) ** 2).sum(axis=1)
                text = pa.array(["".join(f"{x:02x}" for x in row) for row in code.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([of("ids"), of("labels"), text, pa.array(error)], ["id", "label", "code", "error"])

    return run


def digest(books: Books | None) -> str:
    """SHA-256 of all entries' decimal components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.entries.ravel().tolist() if books else [])).encode()).hexdigest()


def compress(vectors: DataFrame, *, vec_id: str = "vec_id", label: str = "label", **how) -> DataFrame:
    """A row for each kept vector: its id, code, error, label_error (of all rows of its label) and codebooks_sha256."""
    books, held, _ = fit(vectors, vec_id=vec_id, label=label, **how)
    if books is None:
        kind = vectors.schema[vec_id].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"`{vec_id}` {kind}, code string, error long, label_error long, codebooks_sha256 string")
    parts, _, width = books.entries.shape
    rows = written(held.mapInArrow(_codes(books, parts * width), "id long, label string, code string, error long"), "codes-rows")
    discard(held)
    key = F.coalesce(F.concat(F.lit("l"), F.col("label")), F.lit(""))
    rows = rows.withColumn("key", key)
    by_label = written(rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "codes-labels")
    met = join_heavy(rows, by_label, "key", by_label.agg(F.sum("_n")).first()[0])
    return met.select(F.col("id").cast(vectors.schema[vec_id].dataType).alias(vec_id), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
