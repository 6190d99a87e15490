"""Substring dedup: repeated passages across documents by collinear chaining, fuzzy ones included.

1. Seeds. Of the hashes of five consecutive words, the smallest of each window of eight is kept (with its place), so
   documents that share 12 consecutive words share a seed. Five words of which two at most are distinct ("the the the")
   are low-complexity text, as sequence aligners mask it, and no seeds.
2. Matches. Each seed's first place (smallest id, then place) is a partial aggregate; every other place joins it. A
   seed that thousands of documents share gives one match each, never pairs among them.
3. Chains. A document's matches are at most its seeds. Those on one diagonal merge; blocks with one earlier document
   are chained in order of both texts with linear gap costs, the best predecessor coming from a Fenwick tree of prefix
   maxima. Every chain is aligned: edits can leave a passage a single seed.
4. Alignment. The words around each chain are fetched in blocks of hashes, gaps are aligned word by word, and ends
   are extended by up to ``MARGIN`` words, over inserted and deleted ones as well. Parts with 0.8 or more of their
   words aligned stay.
5. Passages. A document's aligned parts are merged; merged stretches of ``MIN_WORDS`` or more are its passages.
6. Windows. A seed meets its first place only, which may hold nothing but a line of the passage. Where all seeds of
   ``MIN_WORDS`` words are repeated ones, but their first places don't lie on one diagonal of one document, the words have an
   anchor, their least seed. The anchors of such words that no passage holds are gathered; all such words with these
   anchors give hashes of their whole windows, and each hash's first place is joined. Windows of nothing but low-complexity
   text, which have no seed, all do. So an exact repeat of ``MIN_WORDS`` words is found whoever else holds its seeds, if it is
   of either kind throughout.

Words are white-space separated, A-Z lower-cased. A repeat within one document is none. Defined results: null, empty
and short texts have no passage; rows that share id and text are one document; rows that share an id alone are told
apart by their text; a null id comes before all others; an empty table gives no row. Ids are integers.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.llm.common import WORD_BYTES, group_starts, slices, whole_groups
from siftwright.llm.components import star_forest
from siftwright.shared import discard, written

K = 5
WINDOW = 8
MIN_WORDS = 50
MIN_PART = 16  #: words of an aligned part that counts
SIMILARITY = 0.8
LEAST = int(MIN_WORDS * SIMILARITY)  #: words that a text needs to hold its part of a passage
LEAST_DISTINCT = 3  #: distinct words of a k-mer that is no low-complexity text
GAP_COST = 0.25  #: of a word that a chain skips in either text
MARGIN = 48  #: words fetched beyond a chain's ends
BLOCK = 64  #: words of a fetched block
JOINED = 2  #: words between parts that are still one passage
LOOK = 12  #: words searched in each text for the place where a broken off extension goes on
WIDE_GAP = 64  #: words of a gap that is aligned by dynamic programming; a wider one is compared word by word, or splits the part
NO_ID = -(1 << 63)

_POWERS = np.cumprod(np.full(MIN_WORDS, 0x9E3779B97F4A7C15, np.uint64))
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)

#: A number for each byte: A-Z as a-z, white space none.
_BYTES = np.random.default_rng(41).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTES[_SPACE] = 0
_PLACES = np.cumprod(np.full(4096, 0xD6E8FEB86659FD93, np.uint64))
PIECE = 1 << 18  #: bytes hashed by one numpy call; a longer word is a piece of its own
SLICE = 400_000  #: characters of the texts whose words are held at once; a longer text is alone


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(29))
    values *= np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and the first word of each text and the end: no Python object a word.

    A word's hash is the sum of a number for each byte times a power for its place, mixed.
    """
    texts = texts.fill_null("")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    buffers = texts.buffers()
    if not len(texts) or buffers[2] is None:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    ends = np.frombuffer(buffers[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    word = ~_SPACE[data]
    fresh = np.ones(len(data), bool)
    fresh[1:] = ~word[:-1]
    fresh[ends[:-1][ends[:-1] < len(data)]] = True  # a text's first byte
    starts = np.flatnonzero(word & fresh)
    first = np.searchsorted(starts, ends)
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + PIECE)))
        begin, end = int(starts[at]), int(starts[to]) if to < len(starts) else len(data)
        own = starts[at:to] - begin
        inside = np.arange(end - begin, dtype=np.int32) - np.repeat(own, np.diff(own, append=end - begin)).astype(np.int32)
        hashes[at:to] = np.add.reduceat(_BYTES[data[begin:end]] * _PLACES[inside & 4095], own)
        at = to
    return _mixed(hashes), first


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each window of width values."""
    done, out = 1, values
    while done * 2 <= width:
        out = best(out[:-done], out[done:])
        done *= 2
    return out if done == width else best(out[: len(out) - (width - done)], out[width - done :])


def _distinct(words: np.ndarray) -> np.ndarray:
    """Number of distinct words of each K consecutive ones."""
    n = len(words) - K + 1
    equal = [None, *(words[:-d] == words[d:] for d in range(1, K))]
    out = np.ones(n, np.int8)
    for j in range(1, K):
        seen = equal[1][j - 1 : j - 1 + n].copy()
        for d in range(2, j + 1):
            seen |= equal[d][j - d : j - d + n]
        out += ~seen
    return out


def _long(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts that have as many words as a passage must agree in, their words, and the first word of each and the end."""
    sizes = np.diff(first)
    long = sizes >= LEAST
    return np.flatnonzero(long), words[np.repeat(long, sizes)], np.concatenate([[0], np.cumsum(sizes[long])])


def low_windows(texts: np.ndarray, words: np.ndarray, first: np.ndarray, low: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, text, place) of the windows of MIN_WORDS words that are nothing but low-complexity text, some at a time."""
    inside = MIN_WORDS - K + 1
    if len(low) < inside:
        return
    upto = np.concatenate([[0], np.cumsum(low)])
    starts = np.flatnonzero(upto[inside:] - upto[:-inside] == inside)
    row = np.searchsorted(first, starts, "right") - 1
    fits = starts + MIN_WORDS <= first[row + 1]
    starts, row = starts[fits], row[fits]
    for at, own in zip(*(np.array_split(x, len(starts) // 50_000 + 1) for x in (starts, row)), strict=True):
        yield window_hashes(words, at), texts[own], at - first[own]


def window_hashes(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the MIN_WORDS words from each start."""
    window = np.zeros(len(starts), np.uint64)
    for j in range(MIN_WORDS):
        own = words[starts + j]
        window += (own ^ (own >> np.uint64(31))) * _POWERS[j]
    return window ^ (window >> np.uint64(32))


def seeds_of(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place, is the text's first with this hash) of the kept k-mers of texts' word hashes.

    k-mers of two distinct words or one are low-complexity text and never kept; texts of fewer words than a passage
    must agree in have none.
    """
    return _seeds(*(held := _long(words, first)), _low(held[1]))


def _low(words: np.ndarray) -> np.ndarray:
    """For each K consecutive words, whether they are low-complexity text."""
    return _distinct(words) < LEAST_DISTINCT if len(words) else np.zeros(0, bool)


def _seeds(texts: np.ndarray, words: np.ndarray, first: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if not len(texts):
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 2, np.zeros(0, bool)
    n = len(words) - K + 1
    mixed = np.zeros(n, np.uint64)
    for j in range(K):
        mixed += words[j : j + n] * _SPREAD[j]
    mixed = _mixed(mixed)
    mixed[low | (mixed == 0)] = _MOST
    cut = lambda width: (first[1:-1, None] - np.arange(1, width)).ravel()  # noqa: E731  those that go over a text's end
    mixed[cut(K)] = _MOST
    least = _sliding(mixed, WINDOW, np.minimum)
    least[least == _MOST] = 0
    least[cut(K + WINDOW - 1)] = 0
    pad = np.zeros(WINDOW - 1, np.uint64)
    at = np.flatnonzero(mixed == _sliding(np.concatenate([pad, least, pad]), WINDOW, np.maximum))
    if not len(at):
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 2, np.zeros(0, bool)
    row = np.searchsorted(first, at, "right") - 1
    order = np.lexsort((at, mixed[at]))
    at, row = at[order], row[order]
    held = np.zeros(len(at), bool)  # the same k-mer in the same text
    held[1:] = (mixed[at[1:]] == mixed[at[:-1]]) & (row[1:] == row[:-1])
    # where one k-mer comes again and again, a place a window is enough
    close = held.copy()
    close[1:] &= at[1:] - at[:-1] < WINDOW
    starts = np.flatnonzero(~close)
    lap = (at - np.repeat(at[starts], np.diff(starts, append=len(at)))) // WINDOW
    keep = ~close
    keep[1:] |= lap[1:] != lap[:-1]
    at, row, held = at[keep], row[keep], held[keep]
    order = np.argsort(at)
    at, row, held = at[order], row[order], held[order]
    return mixed[at], texts[row], at - first[row], ~held


def _emit_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds, and as rows marked low the windows of low-complexity text."""
    for batch in slices(batches, "text", SLICE):
        texts, words, first = _long(*words_of(batch.column("text")))
        low = _low(words)
        ids, marks = batch.column("id").to_numpy(), batch.column("mark").to_numpy().astype(np.int64)

        def rows(keys: np.ndarray, text: np.ndarray, place: np.ndarray, fresh: np.ndarray, is_low: bool) -> pa.RecordBatch:
            columns = [keys.view(np.int64), ids[text], marks[text] << 32 | place, fresh, np.full(len(keys), is_low)]  # noqa: B023
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["seed", "id", "at", "fresh", "low"])

        yield rows(*_seeds(texts, words, first, low), False)
        for keys, text, place in low_windows(texts, words, first, low):
            if len(keys):
                yield rows(keys, text, place, np.zeros(len(keys), bool), True)


class _PrefixMax:
    """Fenwick tree: best (value, item) among positions up to one."""

    def __init__(self, size: int):
        self.best = [(float("-inf"), -1)] * (size + 1)

    def put(self, position: int, value: float, item: int) -> None:
        position += 1
        while position < len(self.best):
            if value > self.best[position][0]:
                self.best[position] = (value, item)
            position += position & -position

    def up_to(self, position: int) -> tuple[float, int]:
        found = (float("-inf"), -1)
        while position > 0:
            if self.best[position][0] > found[0]:
                found = self.best[position]
            position -= position & -position
        return found


def chain(blocks: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Chains of (start in x, start in r, length) blocks, collinear in both, best first.

    A chain's score is its blocks' words less GAP_COST for each word skipped in either text; a block starts anew where
    no predecessor pays. Blocks belong to the best chain that reaches them.
    """
    if len(blocks) == 1:
        return [blocks]
    ends = sorted({r + n for _, r, n in blocks})
    tree = _PrefixMax(len(ends))
    events = sorted([(x, 1, i) for i, (x, _, _) in enumerate(blocks)] + [(x + n, 0, i) for i, (x, _, n) in enumerate(blocks)])
    score, before = [0.0] * len(blocks), [-1] * len(blocks)
    for _, starts, i in events:
        x, r, n = blocks[i]
        if starts:
            value, item = tree.up_to(bisect.bisect_right(ends, r))
            gain = value - GAP_COST * (x + r)
            score[i], before[i] = (n + gain, item) if item >= 0 and gain > 0 else (float(n), -1)
        else:
            tree.put(bisect.bisect_left(ends, r + n), score[i] + GAP_COST * (x + n + r + n), i)
    used, chains = [False] * len(blocks), []
    for i in sorted(range(len(blocks)), key=lambda i: (-score[i], i)):
        line = []
        while i >= 0 and not used[i]:
            used[i] = True
            line.append(blocks[i])
            i = before[i]
        if line:
            chains.append(line[::-1])
    return chains


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches sorted by document, earlier document and place to chains, and each document's split windows (rid is null).

    No chain is too short: edits can leave a passage a single seed. A seed that has its first place here is no match for a
    chain; it counts for windows only.
    """
    for table in whole_groups(batches, ["id", "mark"]):
        id_, mark, rid, rmark, x, r, seed = (table.column(c).to_numpy() for c in ("id", "mark", "rid", "rmark", "x", "r", "seed"))
        x, r = x.astype(np.int64), r.astype(np.int64)
        order = np.lexsort((x, x - r, rmark, rid, mark, id_))
        id_, mark, rid, rmark, x, r, seed = (a[order] for a in (id_, mark, rid, rmark, x, r, seed))
        line = np.zeros(len(x), np.int64)
        line[group_starts(id_, mark, rid, rmark, x - r)] = 1
        line = np.cumsum(line)
        windows = []
        docs = group_starts(id_, mark).tolist()
        for a, b in zip(docs, [*docs[1:], len(x)], strict=True):
            found = split_windows(x[a:b], seed[a:b], line[a:b]) if line[a] != line[b - 1] else []
            if found:
                windows.append((id_[a], mark[a], *zip(*found, strict=True)))
        other = (id_ != rid) | (mark != rmark)
        id_, mark, rid, rmark, x, r, line = (a[other] for a in (id_, mark, rid, rmark, x, r, line))
        near = np.ones(len(x), bool)
        near[1:] = (line[1:] != line[:-1]) | (x[1:] - x[:-1] > MIN_PART)
        first = np.flatnonzero(near)
        long = x[np.append(first[1:], len(x)) - 1] + K - x[first] if len(first) else first
        rows, pairs = [], group_starts(id_[first], mark[first], rid[first], rmark[first])
        for s, e in zip(pairs.tolist(), np.append(pairs, len(first))[1:].tolist(), strict=True):
            blocks = list(zip(x[first[s:e]].tolist(), r[first[s:e]].tolist(), long[s:e].tolist(), strict=True))
            rows += [(first[s], c) for c in chain(blocks)]  # all of them: what a chain holds shows only in align()
        at = np.array([row for row, _ in rows], np.int64)
        ints, none = pa.list_(pa.int32()), [None] * len(windows)
        own = [np.array([w[i] for w in windows], v.dtype) for i, v in enumerate((id_, mark))]
        both = [pa.array(np.concatenate([v[at], o])) for v, o in zip((id_, mark), own, strict=True)]
        both += [pa.array([*v[at].tolist(), *none], t) for v, t in ((rid, pa.int64()), (rmark, pa.int32()))]
        lists = [[[block[i] for block in c] for _, c in rows] for i in range(3)]
        both += [pa.array([*c, *o], ints) for c, o in zip(lists, ([w[3] for w in windows], [w[4] for w in windows], none), strict=True)]
        both.append(pa.array([None] * len(at) + [w[2] for w in windows], pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays(both, names=["id", "mark", "rid", "rmark", "xs", "rs", "ns", "seeds"])


def _emit_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted blocks of documents as 32 bits of each word's hash."""
    for batch in slices(batches, "text", SLICE):
        words, first = words_of(batch.column("text"))
        words, rows = words.astype(np.uint32), []
        keys = (batch.column(c).to_pylist() for c in ("bid", "bmark", "wanted"))
        for i, mark, wanted, a, b in zip(*keys, first[:-1].tolist(), first[1:].tolist(), strict=True):
            rows += [(i, mark, at, words[a + at * BLOCK : min(a + (at + 1) * BLOCK, b)].tobytes()) for at in wanted if 0 <= at * BLOCK < b - a]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["bid", "bmark", "block", "words"])


def _gap(a: np.ndarray, b: np.ndarray) -> int:
    """Words of the longest common subsequence of two short stretches."""
    if not len(a) or not len(b):
        return 0
    if len(a) == len(b) and (same := int((a == b).sum())) * 2 >= len(a):
        return same
    row = np.zeros(len(b) + 1, np.int64)
    for word in a:
        diagonal = row[:-1] + (b == word)
        row[1:] = np.maximum.accumulate(np.maximum(diagonal, row[1:]))
    return int(row[-1])


def _run(a: np.ndarray, b: np.ndarray, cost: int) -> tuple[int, int, int]:
    """(words, agreeing words, sum) of the best sum of +1 for agreeing and -cost for other words; 0 is a word not fetched."""
    n = min(len(a), len(b))
    same = (a[:n] == b[:n]) & (a[:n] != 0)
    if not same.any():
        return 0, 0, 0
    sums = np.cumsum(np.where(same, 1, -cost))
    best = int(sums.argmax())
    return (best + 1, int(same[: best + 1].sum()), int(sums[best])) if sums[best] > 0 else (0, 0, 0)


def _extend(a: np.ndarray, b: np.ndarray, cost: int = 2) -> tuple[int, int, int]:
    """(words of a, words of b, agreeing words) to go on, over words inserted or deleted as well.

    Where a run breaks off, the nearest two agreeing words within LOOK words of each text take it on. The best sum of
    +1 for agreeing and -cost for other words is kept; it's given up at LOOK * cost below the best.
    """
    i, agree, score = _run(a, b, cost)
    j = i
    best, most = (i, j, agree), score
    while True:
        p, q = a[i : i + LOOK], b[j : j + LOOK]
        if min(len(p), len(q)) < 2:
            return best
        met = (p[:, None] == q) & (p != 0)[:, None]
        two = np.argwhere(met[:-1, :-1] & met[1:, 1:])
        if not len(two):
            return best
        di, dj = min(two.tolist(), key=lambda at: (max(at), sum(at)))
        n, more, gain = _run(a[i + di :], b[j + dj :], cost)
        i, j, agree, score = i + di + n, j + dj + n, agree + more, score + gain - cost * max(di, dj)
        if score > most:
            best, most = (i, j, agree), score
        elif score < most - LOOK * cost:
            return best


def align(x: np.ndarray, r: np.ndarray, blocks: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Aligned parts (start and end in x, start and end in r, agreeing words) of a chain.

    x and r hold words at their places in the documents; 0 stands for words that weren't fetched.
    """
    parts = []
    for bx, br, n in blocks:
        agree = int((x[bx : bx + n] == r[br : br + n]).sum())
        if parts:
            px, ex, pr, er, so_far = parts[-1]
            gx, gr = bx - ex, br - er
            if (0 <= gx <= WIDE_GAP and 0 <= gr <= WIDE_GAP) or gx == gr >= 0:
                more = so_far + agree + (int((x[ex:bx] == r[er:br]).sum()) if gx > WIDE_GAP else _gap(x[ex:bx], r[er:br]))
                if more >= SIMILARITY * max(bx + n - px, br + n - pr):
                    parts[-1] = (px, bx + n, pr, br + n, more)
                    continue
        parts.append((bx, bx + n, br, br + n, agree))
    out = []
    for sx, ex, sr, er, agree in parts:
        before = x[max(sx - MARGIN, 0) : sx][::-1], r[max(sr - MARGIN, 0) : sr][::-1]
        behind = x[ex : ex + MARGIN], r[er : er + MARGIN]
        for cost in (1, 2, 4):  # at 4 an extension has SIMILARITY itself
            (xl, rl, more_left), (xr, rr, more_right) = _extend(*before, cost), _extend(*behind, cost)
            part = (sx - xl, ex + xr, sr - rl, er + rr, agree + more_left + more_right)
            if part[4] >= SIMILARITY * max(part[1] - part[0], part[3] - part[2]):
                out.append(part)
                break
    return out


def merge(parts: list[tuple]) -> list[tuple[int, int, list[tuple]]]:
    """(start, end, its parts) of stretches of MIN_WORDS or more; parts begin with start and end."""
    out: list[tuple[int, int, list[tuple]]] = []
    for part in sorted(parts):
        if part[1] - part[0] < MIN_PART:
            continue
        if out and part[0] <= out[-1][1] + JOINED:
            start, end, held = out[-1]
            out[-1] = (start, max(end, part[1]), [*held, part])
        else:
            out.append((part[0], part[1], [part]))
    return [o for o in out if o[1] - o[0] >= MIN_WORDS]


def _place(found: list[tuple[int, bytes]]) -> np.ndarray:
    words = np.zeros((max(b for b, _ in found) + 1) * BLOCK if found else 0, np.uint32)
    most = 0
    for block, data in found:
        some = np.frombuffer(data, np.uint32)
        words[block * BLOCK : block * BLOCK + len(some)] = some
        most = max(most, block * BLOCK + len(some))
    return words[:most]


def split_windows(places: np.ndarray, seeds: np.ndarray, lines: np.ndarray) -> list[tuple[int, int, int]]:
    """(anchor, first and last start) of windows whose seeds are all repeated ones (those given) and not all of one line.

    A line is a diagonal of one earlier document; the text's own first places are a line too.
    """
    order = np.lexsort((places, seeds))
    close = (seeds[order][1:] == seeds[order][:-1]) & (np.diff(places[order]) < 2 * WINDOW)
    again = np.zeros(len(places), bool)  # k-mers that come again at once: seeds_of() keeps a place a window of these
    again[order[1:][close]] = again[order[:-1][close]] = True
    order = np.argsort(places, kind="stable")
    places, seeds, again, lines = places[order], seeds[order].view(np.uint64), again[order], lines[order]
    reach = np.where(again, 2 * WINDOW, WINDOW)
    cuts = np.flatnonzero(np.diff(places) > np.maximum(reach[1:], reach[:-1])) + 1
    width, out = MIN_WORDS - K + 1, []
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)], strict=True):
        low = max(int(places[a] - reach[a]) + 1, 0)
        n = int(places[b - 1] + K + reach[b - 1]) - 1 - MIN_WORDS - low + 1  # starts of windows
        change = np.flatnonzero(lines[a + 1 : b] != lines[a : b - 1]) + a + 1
        if n <= 0 or not len(change):
            continue
        split = np.zeros(n + 1, np.int64)  # windows that hold two neighbouring seeds of different lines
        begin, end = (places[change] + K - MIN_WORDS - low).clip(0, n), (places[change - 1] - low + 1).clip(0, n)
        np.add.at(split, begin[begin < end], 1)
        np.add.at(split, end[begin < end], -1)
        at = np.flatnonzero(np.cumsum(split)[:-1] > 0)
        if not len(at):
            continue
        held = np.full(n + width - 1, _MOST)
        inside = places[a:b] - low < len(held)
        held[places[a:b][inside] - low] = seeds[a:b][inside]
        least = _sliding(held, width, np.minimum)[at].astype(np.uint64).view(np.int64)
        for run in np.split(np.arange(len(at)), np.flatnonzero((np.diff(at) > 1) | (np.diff(least) != 0)) + 1):
            out.append((int(least[run[0]]), int(at[run[0]]) + low, int(at[run[-1]]) + low))
    return out


def _open(windows: list[tuple[int, int, int]], spans: list[tuple[int, int]]) -> set[int]:
    """Anchors of windows that no span holds."""
    out = set()
    for anchor, first, last in windows:
        for start, end in sorted(spans):
            if start <= first <= end - MIN_WORDS:
                first = end - MIN_WORDS + 1
        if first <= last:
            out.add(anchor)
    return out


PASSAGES = (
    "id long, mark int, start_word int, end_word int, ref_id long, ref_start_word int, ref_end_word int, "
    "agreeing_words int, ref_ids array<long>"
)
FOUND = PASSAGES + ", seed long"  #: null for passages; for anchors of open windows all between mark and it


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(column.split() for column in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def _rows(me: tuple, found: list[tuple]) -> Iterator[tuple]:
    """Rows of merged parts; a part ends with its document and all documents that it stands for."""
    for start, end, held in found:
        best = max(held, key=lambda p: (p[4], -p[5]))
        yield (*me, start, end, best[5], best[2], best[3], best[4], sorted({i for p in held for i in p[6]}))


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column; of nulls, empty."""
    column = column.combine_chunks()
    return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)


def _valid(column: pa.ChunkedArray) -> np.ndarray:
    return column.is_valid().to_numpy()


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains and blocks sorted by document to its passages and open windows."""
    for table in whole_groups(batches, ["id", "mark"]):
        id_, mark = table.column("id").to_numpy(), table.column("mark").to_numpy()
        starts = group_starts(id_, mark)
        is_block, is_window = _valid(table.column("words")), _valid(table.column("seeds"))
        other, rmark, block = (table.column(c).fill_null(0).to_numpy() for c in ("bid", "bmark", "block"))
        lists = {c: _lists(table.column(c)) for c in ("xs", "rs", "ns", "seeds")}
        column = table.column("words").combine_chunks()
        some = lambda c, i: lists[c][1][lists[c][0][i] : lists[c][0][i + 1]]
        rows = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
            own = np.arange(a, b)
            words: dict[tuple, list] = {}
            for i in own[is_block[a:b]].tolist():
                words.setdefault((int(other[i]), int(rmark[i])), []).append((int(block[i]), column[i].as_buffer()))
            placed = {key: _place(found) for key, found in words.items()}
            me = int(id_[a]), int(mark[a])
            parts = []
            for i in own[~is_block[a:b] & ~is_window[a:b]].tolist():
                ref = int(other[i]), int(rmark[i])
                if me in placed and ref in placed:
                    blocks = list(zip(*(some(c, i).tolist() for c in ("xs", "rs", "ns")), strict=True))
                    parts += [(*p, ref[0], (ref[0],)) for p in align(placed[me], placed[ref], blocks)]
            found = merge(parts)
            rows += [(*row, None) for row in _rows(me, found)]
            for i in own[is_window[a:b]].tolist():
                windows = list(zip(*(some(c, i).tolist() for c in ("seeds", "xs", "rs")), strict=True))
                rows += [(*me, *[None] * 7, anchor) for anchor in sorted(_open(windows, [f[:2] for f in found]))]
        yield _batch(rows, FOUND)


def _emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the wanted windows of documents."""
    for batch in slices(batches, "text", SLICE):
        hashes, first = words_of(batch.column("text"))
        keys = (batch.column(c).to_pylist() for c in ("id", "mark", "wanted"))
        for i, mark, wanted, a, b in zip(*keys, first[:-1].tolist(), first[1:].tolist(), strict=True):
            words = hashes[a:b]
            if len(words) < MIN_WORDS:
                continue
            asked = np.zeros(len(words) - MIN_WORDS + 2, np.int64)
            low = np.array([w["low"] for w in wanted]).clip(0, len(asked) - 1)
            high = np.array([w["high"] + 1 for w in wanted]).clip(0, len(asked) - 1)
            np.add.at(asked, low, 1)
            np.add.at(asked, high, -1)
            starts = np.flatnonzero(np.cumsum(asked)[:-1] > 0)
            for some in np.array_split(starts, len(starts) // 50_000 + 1):
                window = window_hashes(words, some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(window.view(np.int64)), pa.array(np.full(len(some), i, np.int64)), pa.array(np.int64(mark) << 32 | some)],
                    names=["window", "id", "at"],
                )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages and repeated windows sorted by document to its passages."""
    for table in whole_groups(batches, ["id", "mark"]):
        starts = group_starts(table.column("id").to_numpy(), table.column("mark").to_numpy())
        rows: list[tuple] = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
            own = table.slice(a, b - a).to_pylist()
            parts, windows = [], set()
            for row in own:
                part = row["start_word"], row["end_word"], row["ref_start_word"], row["ref_end_word"], row["agreeing_words"], row["ref_id"]
                if row["ref_ids"] is None:
                    windows.add((part[5], part[2] - part[0], part[0]))
                else:
                    parts.append((*part, tuple(row["ref_ids"])))
            runs: list[list[int]] = []
            for ref, shift, x in sorted(windows):
                if runs and runs[-1][:2] == [ref, shift] and x <= runs[-1][3]:
                    runs[-1][3] = x + MIN_WORDS
                else:
                    runs.append([ref, shift, x, x + MIN_WORDS])
            parts += [(x, e, x + shift, e + shift, e - x, ref, (ref,)) for ref, shift, x, e in runs]
            rows += _rows((own[0]["id"], own[0]["mark"]), merge(parts))
        yield _batch(rows, PASSAGES)


def _mark(text: Column) -> Column:
    """31 bits of the text's hash: tells apart rows that share an id."""
    return F.shiftrightunsigned(F.xxhash64(text), 33).cast("int")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.col(text).cast("string")
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), _mark(t).alias("mark"), t.alias("text"))


def _blocks_between(low: Column, high: Column) -> Column:
    at = lambda place: F.floor(F.greatest(place, F.lit(0)) / BLOCK).cast("int")
    return F.sequence(at(low - MARGIN), at(high + MARGIN))


def find_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Passages (columns PASSAGES) of documents that an earlier document has; words are counted from 0."""
    keyed = _keyed(docs, doc_id, text)
    emitted = written(keyed.mapInArrow(_emit_seeds, "seed long, id long, at long, fresh boolean, low boolean"), "passage-seeds")
    seeds, low = emitted.filter("not low"), emitted.filter("low").select(F.col("seed").alias("window"), "id", "at")
    low = None if low.isEmpty() else written(low, "passage-low")
    # two numbers rather than a struct, so that it is a hash aggregate; a text has one fresh place a seed
    first = seeds.filter("fresh").groupBy("seed").agg(F.min("id").alias("rid"), F.min_by("at", "id").alias("rat"), F.count("*").alias("n"))
    first = first.filter("n > 1").drop("n")
    first = written(first, "passage-firsts")  # so that both sides of the join are exchanges, which AQE can split
    mark = lambda at: F.shiftright(at, 32).cast("int")
    place = lambda at: F.col(at).bitwiseAND((1 << 32) - 1).cast("int")
    met = seeds.join(first, "seed").select(
        "id", mark("at").alias("mark"), "rid", mark("rat").alias("rmark"), place("at").alias("x"), place("rat").alias("r"), "seed"
    )
    met = met.repartition("id", "mark").sortWithinPartitions("id", "mark", "rid", "rmark", "x", "r")
    chains = met.mapInArrow(
        _chains, "id long, mark int, rid long, rmark int, xs array<int>, rs array<int>, ns array<int>, seeds array<long>"
    )
    chains = written(chains, "passage-chains")
    discard(first, emitted)
    paired = chains.filter(F.col("rid").isNotNull())

    begin, end = (lambda a: F.element_at(a, 1)), (lambda a: F.element_at(a, -1) + F.element_at("ns", -1))
    theirs = paired.select("id", "mark", F.col("rid").alias("bid"), F.col("rmark").alias("bmark"), F.explode(_blocks_between(begin("rs"), end("rs"))).alias("block"))
    ours = paired.select("id", "mark", F.col("id").alias("bid"), F.col("mark").alias("bmark"), F.explode(_blocks_between(begin("xs"), end("xs"))).alias("block"))
    needs = theirs.union(ours).distinct()
    wanted = needs.select("bid", "bmark", "block").distinct().groupBy("bid", "bmark").agg(F.collect_list("block").alias("wanted"))
    # what is wanted grows with the documents: never a broadcast
    texts = keyed.withColumnsRenamed({"id": "bid", "mark": "bmark"}).join(wanted.hint("merge"), ["bid", "bmark"])
    # written, so that the texts' shuffle files go before the blocks are shuffled
    blocks = written(texts.mapInArrow(_emit_blocks, "bid long, bmark int, block int, words binary"), "passage-blocks")
    none = F.lit(None).cast("array<int>")
    fetched = needs.join(blocks, ["bid", "bmark", "block"]).select(
        "id", "mark", "bid", "bmark", "block", "words", none.alias("xs"), none.alias("rs"), none.alias("ns"), F.lit(None).cast("array<long>").alias("seeds")
    )
    lines = chains.select(
        "id", "mark", F.col("rid").alias("bid"), F.col("rmark").alias("bmark"), F.lit(None).cast("int").alias("block"),
        F.lit(None).cast("binary").alias("words"), "xs", "rs", "ns", "seeds",
    )
    both = fetched.union(lines).repartition("id", "mark").sortWithinPartitions("id", "mark")
    found = written(both.mapInArrow(_passages, FOUND), "passage-found")
    discard(blocks)
    names = [column.split()[0] for column in PASSAGES.split(", ")]
    passages = found.filter("seed is null").select(names)

    anchors = written(found.filter("seed is not null").select("seed").distinct(), "passage-anchors")
    windows = low
    if not anchors.isEmpty():
        spread = chains.filter("seeds is not null").select("id", "mark", F.inline(F.arrays_zip("seeds", F.col("xs").alias("low"), F.col("rs").alias("high"))))
        held = spread.toDF("id", "mark", "seed", "low", "high").join(anchors, "seed", "left_semi")
        held = held.groupBy("id", "mark").agg(F.collect_list(F.struct("low", "high")).alias("wanted"))
        anchored = keyed.join(held.hint("merge"), ["id", "mark"]).mapInArrow(_emit_windows, "window long, id long, at long")
        anchored = written(anchored, "passage-windows")
        windows = anchored if low is None else anchored.unionByName(low)
    discard(chains, anchors)
    if windows is None:
        return passages
    first = windows.groupBy("window").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = written(first.select("window", F.col("first.id").alias("rid"), F.col("first.at").alias("rat")), "passage-firsts")
    met = windows.join(first, "window").filter((F.col("id") != F.col("rid")) | (mark("at") != mark("rat")))
    x, r = place("at"), place("rat")
    met = met.select(
        "id", mark("at").alias("mark"), x.alias("start_word"), (x + MIN_WORDS).alias("end_word"), F.col("rid").alias("ref_id"),
        r.alias("ref_start_word"), (r + MIN_WORDS).alias("ref_end_word"), F.lit(MIN_WORDS).alias("agreeing_words"),
        F.lit(None).cast("array<long>").alias("ref_ids"),
    )
    both = passages.union(met).repartition("id", "mark").sortWithinPartitions("id", "mark")
    return both.mapInArrow(_joined, PASSAGES)


def list_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the passage's words, an earlier document that has them or a part, its place there, all such that were met, and a class.

    Those met are first places of seeds and windows, the representatives of all that share them: a later holder of the
    passage isn't listed, even where it has more of the words than they have. ref_doc_id is the one of those met with
    the most agreeing words in one part. class_id is the smallest id among all documents that passages connect, so
    documents that share a passage have one class, whether or not one lists the other; a representative itself, where it has no
    earlier holder, is the class of those that list it.
    """
    found = written(find_passages(docs, doc_id=doc_id, text=text), "passages")
    links = found.select(F.col("id").alias("a"), F.explode("ref_ids").alias("b")).distinct()
    classes = star_forest(links, "passage-classes").select(F.col("a").alias("id"), F.col("b").alias("class_id"))
    real = lambda c: F.nullif(c, F.lit(NO_ID))
    # only rows that share an id with what they repeat have no class from another document: their own id
    return found.join(classes, "id", "left").select(
        real(F.col("id")).alias("doc_id"),
        "start_word",
        "end_word",
        (F.col("end_word") - F.col("start_word")).alias("n_words"),
        real(F.col("ref_id")).alias("ref_doc_id"),
        "ref_start_word",
        "ref_end_word",
        "agreeing_words",
        F.transform("ref_ids", real).alias("ref_doc_ids"),
        real(F.coalesce("class_id", "id")).alias("class_id"),
    )


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of spans (from 0, end excluded) and the white space after them."""
    data = text.encode("utf-8")
    places = [m.span() for m in WORD_BYTES.finditer(data)]
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= len(places):
            break
        begin = places[start][0]
        stop = places[end][0] if end < len(places) else len(data)
        out.append(data[at : max(begin, at)])
        at = max(at, stop)
    out.append(data[at:])
    return b"".join(out).decode("utf-8")


def _cut(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, spans in rows:
        yield pd.Series(
            [t if t is None else cut_words(t, [(s["start"], s["end"]) for s in some]) for t, some in zip(texts, spans, strict=True)],
            dtype=object,
        )


def drop_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs without repeated passages: the first document keeps each, later ones lose its words.

    Texts without a passage stay as they are; a document that has no word left goes. Where docs has the column
    ``length`` it is set anew for texts that were cut.
    """
    found = find_passages(docs, doc_id=doc_id, text=text)
    spans = found.groupBy(F.col("id").alias("_sw_id"), F.col("mark").alias("_sw_mark")).agg(
        F.collect_list(F.struct(F.col("start_word").alias("start"), F.col("end_word").alias("end"))).alias("_sw_spans")
    )
    spans = written(spans, "passage-spans")
    t = F.col(text).cast("string")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(whole, F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("key"), _mark(t).alias("own"))
    met = rows.join(spans.hint("merge"), (rows["key"] == spans["_sw_id"]) & (rows["own"] == spans["_sw_mark"]), "left")
    was_cut = F.col("_sw_spans").isNotNull()
    old = F.col("row").getField(text)
    cut = F.pandas_udf(_cut, "string").asNondeterministic()(F.when(was_cut, old.cast("string")), F.col("_sw_spans"))  # null where whole
    met = met.withColumn("cut", cut)
    met = met.filter(~was_cut | F.col("cut").rlike(r"[^\x20\x09-\x0D]"))
    changed = {text: F.when(was_cut, F.col("cut")).otherwise(old)}
    if length in docs.columns:
        kind = docs.schema[length].dataType
        changed[length] = F.when(was_cut, F.length("cut").cast(kind)).otherwise(F.col("row").getField(length))
    return met.select(*(changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns))
