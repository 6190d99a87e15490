"""SimHash fingerprints of word shingles, and near-duplicate groups by anchor-point covering.

Two fingerprints at 4 or fewer differing bits agree, in one of three bit blocks at least, up to one bit. The anchors
of a block are the words of a covering code: the perfect Hamming code of length 15 (every 15-bit word is within
one bit of a code word) times all words of the block's other bits. A fingerprint's home is the code word within the
covering radius; it is replicated to every anchor within radius plus threshold that a fingerprint at one bit's
distance can have as its home. So each linked pair meets at the home of either, and is compared there on all 64 bits.

Only distinct fingerprints are replicated (about 42 rows each), so exact copies cost nothing here. An anchor with
many fingerprints is cut into cells of bounded size, each pair of cuts being a task's unit of its own; a large cell
gives a spanning forest of its links instead of all pairs, which keeps every component.

Defined results: a null or white-space text has fingerprint zero, which links like any other; the component of rows
that all lack an id has a null id; repeated rows are one component; a long text is hashed whole, some shingles at a time;
extra columns, of whatever names, change nothing; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.llm.common import HEAVY, WORD_BYTES, ascii_lower, join_heavy
from siftwright.llm.components import star_forest
from siftwright.shared import written

SHINGLE = 4
SEED = 42
MOST_BITS = 4
#: (first bit, bits beside the code's 15) of each block: 15 + 7, 15 + 6 and 15 + 6 bits.
BLOCKS = ((0, 7), (22, 6), (43, 6))
CODE_BITS = 15
CELL = 4096  #: fingerprints of an anchor that are compared in one unit
DENSE = 4096  #: pairs in a cell above which a forest is emitted
AT_ONCE = 1 << 20  #: pairs compared by one numpy call
HASHES = 1 << 15  #: shingles hashed before their bits are summed


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits that over half of the shingles' XXH64 have set, as an unsigned number."""
    words = WORD_BYTES.findall(ascii_lower((text or "").encode("utf-8")))
    if not words:
        return 0
    plain = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    ends = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(plain)]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, HASHES):
        some = [plain[a:b] for a, b in zip(starts[at : at + HASHES], ends[at : at + HASHES], strict=True)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, some, repeat(SEED)), np.uint64, len(some))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t) for t in batch], np.uint64).view(np.int64))


def fingerprint_of(text: Column) -> Column:
    """The fingerprint as a long (two's complement)."""
    return F.pandas_udf(_fingerprints, "long")(text.cast("string"))


def _hamming_words() -> np.ndarray:
    """The 2,048 words of 15 bits whose set positions (1 to 15) xor to zero."""
    words = np.arange(1 << CODE_BITS)
    syndrome = np.zeros(len(words), np.int64)
    for position in range(1, CODE_BITS + 1):
        syndrome ^= np.where(words >> (position - 1) & 1, position, 0)
    return words[syndrome == 0]


def _near_words() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every 15-bit word: its home, and a padded table of the other code words within two bits."""
    words, code = np.arange(1 << CODE_BITS), _hamming_words()
    is_code = np.zeros(len(words), bool)
    is_code[code] = True
    single = [1 << i for i in range(CODE_BITS)]
    steps = [0, *single, *(a | b for i, a in enumerate(single) for b in single[:i])]
    home = np.full(len(words), -1)
    for step in steps[: CODE_BITS + 1]:
        home[is_code[words ^ step]] = (words ^ step)[is_code[words ^ step]]
    others = np.stack([np.where(is_code[words ^ s] & ((words ^ s) != home), words ^ s, -1) for s in steps], axis=1)
    others = -np.sort(-others, axis=1)
    width = int((others >= 0).sum(axis=1).max())
    return home, others[:, :width], (others >= 0).sum(axis=1)


_TABLES: list = []


def anchors_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index of the fingerprint, is its home) for uint64 fingerprints."""
    if not _TABLES:
        _TABLES.append(_near_words())
    home, others, _ = _TABLES[0]
    anchors, owners, homes = [], [], []

    def add(block: int, code: np.ndarray, rest: np.ndarray, index: np.ndarray, is_home: bool) -> None:
        anchors.append((np.int64(block) << 40) | (code.astype(np.int64) << 8) | rest)
        owners.append(index)
        homes.append(np.full(len(index), is_home))

    every = np.arange(len(prints))
    for block, (first, extra) in enumerate(BLOCKS):
        bits = (prints >> np.uint64(first)).astype(np.int64)
        code, rest = bits & ((1 << CODE_BITS) - 1), bits >> CODE_BITS & ((1 << extra) - 1)
        add(block, home[code], rest, every, True)
        for bit in range(extra):
            add(block, home[code], rest ^ (1 << bit), every, False)
        for column in others[code].T:
            there = column >= 0
            add(block, column[there], rest[there], every[there], False)
    return np.concatenate(anchors), np.concatenate(owners), np.concatenate(homes)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("fp").to_numpy(zero_copy_only=False)
        anchor, owner, home = anchors_of(prints.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(prints[owner]), pa.array(home)], names=["anchor", "fp", "home"])


def _forest(prints: np.ndarray, home: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Breadth-first forest of a cell's links between homes and members: real links, one less than nodes a tree."""
    left, right = [], []
    waiting = {True: np.flatnonzero(home), False: np.flatnonzero(member)}  # by side: not reached yet
    while len(waiting[True]):
        queue = [(int(waiting[True][0]), True)]
        waiting[True] = waiting[True][1:]
        while queue:
            node, is_home = queue.pop()
            side = waiting[not is_home]
            near = np.bitwise_count(prints[side] ^ prints[node]) <= MOST_BITS
            found = side[near].tolist()
            waiting[not is_home] = side[~near]
            left += [node] * len(found)
            right += found
            queue += [(i, not is_home) for i in found]
    a, b = prints[np.array(left, np.int64)], prints[np.array(right, np.int64)]
    return a[a != b], b[a != b]


def links_in_cells(cells: np.ndarray, prints: np.ndarray, home: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows that are sorted by cell (complete cells only)."""
    starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(cells)]]))
    homes = np.add.reduceat(home.astype(np.int64), starts)
    found_a, found_b = [], []
    dense = homes * sizes > DENSE
    for s, n in zip(starts[dense].tolist(), sizes[dense].tolist(), strict=True):
        a, b = _forest(prints[s : s + n], home[s : s + n], member[s : s + n])
        found_a.append(a)
        found_b.append(b)
    row_start, row_size = np.repeat(starts, sizes), np.repeat(np.where(dense, 0, sizes), sizes)
    left = np.flatnonzero(home & (row_size > 1))
    if len(left):
        ends = np.cumsum(row_size[left])
        at = 0
        while at < len(left):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
            some = left[at:to]
            counts = row_size[some]
            right = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(row_start[some], counts)
            a, b = prints[np.repeat(some, counts)], prints[right]
            near = (np.bitwise_count(a ^ b) <= MOST_BITS) & (a != b) & member[right]
            found_a.append(a[near])
            found_b.append(b[near])
            at = to
    empty = [np.zeros(0, np.uint64)]
    return np.concatenate(found_a or empty), np.concatenate(found_b or empty)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, i, j): complete cells are compared, the last one waits for the next batch."""
    held: list[tuple[np.ndarray, ...]] = []

    def linked(parts: list[np.ndarray]) -> pa.RecordBatch:
        change = np.zeros(len(parts[0]), bool)
        for keys in parts[:3]:
            change[1:] |= keys[1:] != keys[:-1]
        a, b = links_in_cells(np.cumsum(change), parts[3].view(np.uint64), parts[4], parts[5])
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "i", "j", "fp", "home", "member")))
        parts = [np.concatenate(x) for x in zip(*held, strict=True)]
        same = np.ones(len(parts[0]), bool)
        for keys in parts[:3]:
            same &= keys == keys[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        held = [tuple(x[cut:] for x in parts)]
        if cut:
            yield linked([x[:cut] for x in parts])
    if held:
        yield linked(list(held[0]))


def near_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp, long) that keep every component.

    Pairs of small cells all come; of a dense cell, a spanning forest.
    """
    rows = prints.select("fp").mapInArrow(_replicate, "anchor long, fp long, home boolean")
    hot = rows.groupBy("anchor").count().filter(F.col("count") > CELL)
    # written, so that the planner knows its size before it shuffles the replicas
    hot = written(hot.select("anchor", F.ceil(F.col("count") / CELL).cast("int").alias("cuts")), "simhash-hot")
    dealt = rows.join(hot, "anchor", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("cuts").cast("long")).cast("int"))
    others = F.sequence(F.lit(0), F.col("cuts") - 1)
    as_member = F.transform(others, lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), (F.col("home") & (i == F.col("own"))).alias("home"), F.lit(True).alias("member")))
    as_home = F.transform(
        F.filter(others, lambda j: F.col("home") & (j != F.col("own"))),
        lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(True).alias("home"), F.lit(False).alias("member")),
    )
    cells = dealt.select("anchor", "fp", F.inline(F.concat(as_member, as_home))).select("anchor", "i", "j", "fp", "home", "member")
    cells = cells.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    return cells.mapInArrow(_compare, "a long, b long")


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) of every row."""
    t = F.col(text).cast("string")
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(t).alias("text_hash"), fingerprint_of(t).alias("fp"))


def group_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint as a long), component_fp and component_id of every row."""
    rows = written(fingerprints(docs, doc_id=doc_id, text=text), "simhash")
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    first = written(first, "simhash-distinct")
    stars = star_forest(near_links(first), "simhash-links")
    tree = stars.select(F.col("a").alias("fp"), F.col("b").alias("root")).union(stars.select("b", "b").distinct())
    joined = tree.join(first, "fp")
    roots = joined.groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked = joined.select("fp", "root").join(roots, "root")
    ids = first.join(linked, "fp", "left").select(
        "fp",
        F.col("n").alias("_n"),
        F.coalesce("root", "fp").alias("component_fp"),
        F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("least_id")).alias("component_id"),
    )
    ids = written(ids, "simhash-ids")
    total = first.agg(F.sum("n")).first()[0] or 0
    return join_heavy(rows, ids, "fp", total, HEAVY).select("doc_id", "text_hash", "fp", "component_fp", "component_id")


def fingerprint_hex(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def keep_one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest id stays.

    Of rows that repeat that id, the one with the smallest hash of its text stays, then of its whole row; of rows
    without any id, likewise. What stays grows with the documents, so the join to them is never a broadcast.
    """
    groups = group_near_duplicates(docs, doc_id=doc_id, text=text).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    texts = groups.groupBy("component_fp", "text_hash", "doc_id").agg(F.count("*").alias("rows"))
    best = texts.groupBy("component_fp").agg(F.min(F.struct("text_hash", "doc_id", "rows")).alias("best"))
    kept = best.select(F.col("best.doc_id").alias("_sw_id"), F.col("best.text_hash").alias("_sw_hash"), F.col("best.rows").alias("_sw_rows"))
    kept = written(kept, "simhash-kept")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(doc_id).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("hash"))
    rows = rows.join(kept.hint("merge"), rows["id"].eqNullSafe(kept["_sw_id"]) & (rows["hash"] == kept["_sw_hash"]), "inner")
    if kept.filter("_sw_rows > 1").isEmpty():
        return rows.select("row.*")
    once = rows.filter("_sw_rows = 1").select("row.*")
    more = rows.filter("_sw_rows > 1").groupBy("_sw_id", "_sw_hash").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return once.unionByName(more.select("row.*"))
