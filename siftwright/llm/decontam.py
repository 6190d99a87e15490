"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of the k-gram hashes of a text, the smallest of each sliding window is kept. With k = 5 and windows of 6 k-grams, two
texts that share 10 consecutive words share a kept hash. The kept hashes of documents are joined with those of the
benchmark; a hit is extended to all 10-word windows around it, which are matched word by word with the benchmark's
windows. Items of fewer than 10 words are one window: its length's n-gram hashes stand in for the kept ones.

The hashes decide candidates only; the joins on window texts decide, so collisions change nothing. A hit never joins
item by item: documents meet distinct windows, and the items of a window last.

Every text is read and cut into words once, and no text is shuffled, however many documents have candidates: the kept
hashes of the benchmark become a bit field of bounded size (``BITS`` at most) that is part of the plan. A document's kept
hashes are looked up in it, and the windows around hits leave the scan in the row they were found in. A fuller bit
field lets more windows through to the exact join, and changes no result.

Defined results: a null text has no words; an item without words has no window; rows that repeat an id are judged
by their own texts; rows that repeat an item count once; without hits the items are the empty list; extra columns, of
whatever names, change nothing. Where the table of windows is small Spark broadcasts it by its written size, otherwise it
shuffles the candidates' windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.llm.common import id_text
from siftwright.shared import written

#: Words are ASCII digits, ASCII letters and everything beyond ASCII, after A-Z are lower-cased.
BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN = 10
GRAM = 5
BITS = 1 << 24  #: of the bit field at most
BITS_EACH = 1024  #: of the bit field for each hash, as far as that stays below BITS

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters beyond ASCII that lower() changes; without them lower() and A-Z lower-casing agree, and it is faster.
_OTHER_UPPER = r"[[\p{IsUppercase}\p{Lt}]&&[^\x00-\x7F]]"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.when(text.rlike(_OTHER_UPPER), F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))


def bench_words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(BENCH_WORD), 0), F.array().cast("array<string>"))


def _let(value: Column, body) -> Column:
    """body of value, evaluated once: Catalyst would copy value into lambdas otherwise."""
    return F.transform(F.array(value), body)[0]


def _grams(words: Column, n: int) -> Column:
    """Hashes of n consecutive words; empty if there are fewer."""
    gram = lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, n)))
    none = F.array().cast("array<bigint>")
    return F.when(F.size(words) >= n, F.slice(F.transform(words, gram), F.lit(1), F.size(words) - (n - 1))).otherwise(none)


def winnow(words: Column, span: int = SPAN, gram: int = GRAM) -> Column:
    """Distinct k-gram hashes that are smallest in a window of span - gram + 1 of them."""
    window = span - gram + 1

    def least(hashes: Column) -> Column:
        lowest = lambda h, i: F.least(h, *(F.get(hashes, i + k) for k in range(1, window))) if window > 1 else h
        return F.array_distinct(F.slice(F.transform(hashes, lowest), F.lit(1), F.size(hashes) - (window - 1)))

    none = F.array().cast("array<bigint>")
    return F.when(F.size(words) >= span, _let(_grams(words, gram), least)).otherwise(none)


def kept_hashes(words: Column, short: list[int], span: int = SPAN, gram: int = GRAM) -> Column:
    parts = [winnow(words, span, gram), *(F.array_distinct(_grams(words, n)) for n in short)]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _windows_at(words: Column, starts: Column, n: int) -> Column:
    one = lambda s: F.struct(s.cast("int").alias("start"), F.lit(n).alias("length"), F.array_join(F.slice(words, s, n), " ").alias("window"))
    return F.transform(starts, one)


def _candidate_windows(words: Column, hits: Column, short: list[int], span: int, gram: int) -> Column:
    """Windows around each place of a hit hash: all that cover it and lie in the text."""

    def places(n: int) -> Column:
        indexed = F.transform(_grams(words, n), lambda h, i: F.when(F.array_contains(hits, h), i + 1))
        return F.filter(indexed, lambda i: i.isNotNull())

    def around(i: Column) -> Column:
        low, high = F.greatest(i - (span - gram), F.lit(1)), F.least(i, F.size(words) - (span - 1))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    long = F.array_distinct(F.flatten(F.transform(places(gram), around)))
    return F.concat(*([_windows_at(words, long, span)] + [_windows_at(words, places(n), n) for n in short]))


def benchmark_windows(bench: DataFrame, *, item_id: str = "item_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """Distinct (item, length, window) of all items: span words each, or the whole of a shorter item."""
    items = bench.select(id_text(item_id).alias("item"), bench_words(F.col(text).cast("string")).alias("words"))
    long = _windows_at(F.col("words"), F.sequence(F.lit(1), F.size("words") - (span - 1)), span)
    n = F.size("words")
    whole = F.array(F.struct(F.lit(1).alias("start"), n.alias("length"), F.array_join("words", " ").alias("window")))
    windows = items.filter(n > 0).select("item", F.inline(F.when(n >= span, long).otherwise(whole)))
    return windows.select("item", "length", "window").distinct()


def bit_field(hashes: DataFrame, most: int = BITS) -> tuple[Column, int]:
    """(array of longs as a constant, its number of bits) with the bit of each hash (column h) set.

    The driver sees most / 64 numbers at most, however many hashes there are.
    """
    n = hashes.count()
    size = min(most, max(64, 1 << (n * BITS_EACH - 1).bit_length())) if n else 64
    place = F.col("h").bitwiseAND(size - 1)
    spread = hashes.select(F.shiftright(place, 6).alias("at"), F.expr(f"shiftleft(1L, cast(h & {min(size - 1, 63)} as int))").alias("bit"))
    filled = {r["at"]: r["bits"] for r in spread.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()}
    # text that folds to one constant: an expression for each number would be a plan of that many nodes
    return F.split(F.lit(",".join(str(filled.get(i, 0)) for i in range(size // 64))), ",").cast("array<bigint>"), size


def _is_set(field: Column, size: int, h: Column) -> Column:
    at = F.shiftright(h.bitwiseAND(size - 1), 6).cast("int")
    return F.getbit(F.get(field, at), h.bitwiseAND(63)) == 1


class Hits:
    """What is found: rows by (doc_id, text_hash), which tells rows apart as far as their results can differ."""

    def __init__(
        self,
        docs: DataFrame,
        bench: DataFrame,
        *,
        doc_id: str = "doc_id",
        text: str = "text",
        item_id: str = "item_id",
        item_text: str = "text",
        span: int = SPAN,
        gram: int = GRAM,
        whole_rows: bool = False,
    ):
        self.windows = written(benchmark_windows(bench, item_id=item_id, text=item_text, span=span), "bench-windows")
        short = sorted(r[0] for r in self.windows.filter(F.col("length") < span).select("length").distinct().collect())
        items = bench.select(bench_words(F.col(item_text).cast("string")).alias("words"))
        hashes = items.select(F.explode(_let(F.col("words"), lambda w: kept_hashes(w, short, span, gram))).alias("h"))
        field, size = bit_field(written(hashes.distinct(), "bench-hashes"))

        def around_hits(words: Column) -> Column:
            hits = F.filter(kept_hashes(words, short, span, gram), lambda h: _is_set(field, size, h))
            none = F.array().cast("array<struct<start: int, length: int, window: string>>")
            return _let(hits, lambda h: F.when(F.size(h) > 0, _candidate_windows(words, h, short, span, gram)).otherwise(none))

        t = F.col(text).cast("string")
        told = _let(bench_words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), around_hits(w).alias("windows")))
        kept = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if whole_rows else []
        scan = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(t).alias("text_hash"), told.alias("told"), *kept)
        self.scan = written(scan.select("doc_id", "text_hash", "told.n_words", "told.windows", *(["row"] if whole_rows else [])), "bench-scan")
        near = self.scan.select("doc_id", "text_hash", F.inline("windows"))
        real = near.join(self.windows.select("length", "window").distinct(), ["length", "window"], "left_semi")
        self.found = written(real.distinct(), "bench-hits")

    def spans(self) -> DataFrame:
        """doc_id, text_hash, first word (from 1), number of words and text of each window that occurs."""
        return self.found

    def by_document(self) -> DataFrame:
        """_id, _hash, n_hit, n_items and the items' digest of documents with hits."""
        keys = [F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")]
        covered = F.flatten(F.collect_list(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)))
        words = self.found.groupBy(*keys).agg(F.size(F.array_distinct(covered)).cast("long").alias("n_hit"))
        pairs = self.found.select(*keys, "length", "window").distinct().join(self.windows, ["length", "window"])
        listed = pairs.groupBy("_id", "_hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
        listed = listed.select(
            F.col("_id").alias("_id2"),
            F.col("_hash").alias("_hash2"),
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        )
        both = words.join(listed, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2")))
        return both.drop("_id2", "_hash2")


def judge(docs: DataFrame, bench: DataFrame, **columns) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    hits = Hits(docs, bench, **columns)
    told = hits.by_document()
    rows = hits.scan.select("doc_id", "text_hash", "n_words")
    joined = rows.join(told, rows["doc_id"].eqNullSafe(told["_id"]) & (rows["text_hash"] == told["_hash"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, **columns) -> DataFrame:
    """docs without the rows that hold a benchmark window.

    Rows without a candidate stay as they are; only those with one meet what was found.
    """
    hits = Hits(docs, bench, whole_rows=True, **columns)
    keys = written(hits.spans().select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "bench-drop")
    clean = hits.scan.filter(F.size("windows") == 0).select("row.*")
    near = hits.scan.filter(F.size("windows") > 0)
    same = near["doc_id"].eqNullSafe(keys["_id"]) & (near["text_hash"] == keys["_hash"])
    return clean.unionByName(near.join(keys, same, "left_anti").select("row.*"))
