"""Cleaning, fingerprints and shingles as column expressions.

Only NFKC and the hashes of shingles are Python: NFKC's kernel gets null for texts of letters that it can't change, and the
hashes are made of texts' bytes, many texts at once.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwright.config import CleaningConfig

# Characters that cleaning deletes.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
ZERO_WIDTH = r"[\x{200b}-\x{200d}\x{feff}\x{2060}\x{180e}]"
#: Characters that NFKC may change, alone or beside others: all but ASCII and composed Latin letters. Two classes of one
#: range each, which Java scans far faster than one of several ranges.
UNSTABLE = (r"[\x80-\xbf]", r"[^\x00-\x{131}]")
#: What NFKC or deletion may change, and more rarely doesn't: all but printable ASCII, tab, line ends and composed Latin letters.
#: What stays below U+0100 is listed one by one, for which Java has a table: one fast scan for all of these steps.
ODD = "[^" + "".join(rf"\x{i:02x}" for i in (9, 10, 13, *range(32, 127), *range(192, 256))) + r"\x{100}-\x{131}]"
#: Unicode white space but a space that stands alone, which would become itself; plain \s would leave no-break spaces.
SPACES = r"(?U)\s(?:(?<! )|(?=\s))\s*"
EDGE_SPACES = r"(?U)^\s+|\s+$"
#: Rows that the kernel has as Python strings at once.
NORMALIZED = 256
#: Bytes of a word that are hashed by eights.
LONG_WORD = 64
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def nfkc(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        some = (batch.slice(i, NORMALIZED).to_pylist() for i in range(0, len(batch), NORMALIZED))
        made = [pa.array([t if t is None else unicodedata.normalize("NFKC", t) for t in part], pa.string()) for part in some]
        yield pa.concat_arrays(made) if made else pa.array([], pa.string())


def _normalized(text: Column) -> Column:
    """NFKC in the kernel, which is declared as not deterministic, so that Catalyst never runs it again to push a filter down."""
    return F.arrow_udf(nfkc, "string").asNondeterministic()(text)


def unstable(text: Column) -> Column:
    """text where NFKC may change it, else null."""
    return F.when(text.rlike(UNSTABLE[0]) | text.rlike(UNSTABLE[1]), text)


def normalize_unicode(text: Column) -> Column:
    """NFKC."""
    return F.coalesce(_normalized(unstable(text)), text)


def remove_control_characters(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "")


def remove_zero_width_characters(text: Column) -> Column:
    return F.regexp_replace(text, ZERO_WIDTH, "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_SPACES, "")


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def clean_text(text: Column, config: CleaningConfig = CleaningConfig()) -> Column:
    """The switched-on steps in their fixed order; null becomes the empty text. Those on characters see odd texts only."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    odd = F.when(whole.rlike(ODD), whole)
    by_character = (
        (config.normalize_unicode, _normalized),
        (config.remove_control_chars, remove_control_characters),
        (config.remove_zero_width, remove_zero_width_characters),
    )
    for wanted, step in by_character:
        odd = step(odd) if wanted else odd
    out = F.coalesce(odd, whole)
    steps = (
        (config.collapse_whitespace, collapse_whitespace),
        (config.strip_text and not config.collapse_whitespace, strip),  # which leaves spaces only, and trims them
        (config.lowercase, F.lower),
    )
    for wanted, step in steps:
        out = step(out) if wanted else out
    return out


def cleaning_fingerprint(text: Column) -> Column:
    """Cleaned and lower-cased, whatever the cleaning's own lower-case switch says."""
    return F.lower(clean_text(text))


def recleaned(text: Column) -> Column:
    """clean_text() of a text that clean_text() made with all of its steps.

    Deleting characters can bring a letter and its mark together, so NFKC may change such a text once more; no other step can.
    """
    return normalize_unicode(F.coalesce(text, F.lit("")))


def fingerprint_digest(text: Column, cleaned: bool = False) -> Column:
    """SHA-256 of the cleaning fingerprint; cleaned: of a text that went through all cleaning steps."""
    plain = F.lower(recleaned(text)) if cleaned else cleaning_fingerprint(text)
    return F.sha2(plain.cast("binary"), 256)


def let(value: Column, body) -> Column:
    """body of value evaluated once; Catalyst copies plain expressions into lambdas."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def token_shingles(text: Column, n: int = 3) -> Column:
    """The set of word n-grams as strings; one shingle of all tokens if they are fewer, none without a token."""

    def grams(words: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(words) - (n - 1))
        many = F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " ")))
        whole = F.array(F.array_join(words, " "))
        none = F.array().cast("array<string>")
        return F.when(F.size(words) >= n, many).when(F.size(words) > 0, whole).otherwise(none)

    return let(tokens(text), grams)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of a-z and 0-9 in texts' bytes, and of each text the number of runs; ends: of each text in data.

    Eight bytes of every word at a time; words of over LONG_WORD bytes are digested one by one.
    """
    inside = ((data - np.uint8(97)) < 26) | ((data - np.uint8(48)) < 10)
    starts, lasts = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    lasts[:-1] &= ~inside[1:]
    cuts = ends[(ends > 0) & (ends < len(data))]  # words don't go on from text to text
    starts[cuts], lasts[cuts - 1] = inside[cuts], inside[cuts - 1]
    first, size = np.flatnonzero(starts), np.flatnonzero(lasts) + 1
    size -= first
    padded = np.zeros(len(data) // 8 + 3, "<u8")
    padded.view(np.uint8)[: len(data)] = data
    hashed, some = np.zeros(len(first), np.uint64), slice(None)
    for k in range(0, LONG_WORD, 8):
        at, left = first[some] + k, size[some] - k
        low, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        eight = (padded[low] >> shift) | ((padded[low + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        hashed[some] = mixed((hashed[some] + np.uint64(0x9E3779B97F4A7C15)) ^ (eight & _FIRST_BYTES[np.minimum(left, 8)]))
        some = np.flatnonzero(size > k + 8)
        if not len(some):
            break
    for i in np.flatnonzero(size > LONG_WORD):
        hashed[i] = int.from_bytes(hashlib.blake2b(data[first[i] : first[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return hashed, np.diff(np.searchsorted(first, ends), prepend=0)


def shingle_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct hashes of the word 3-grams of lower-cased texts, one text after the other, and the number of each text.

    A text of one or two words has one hash of them all; of none, -1 as a sentinel. data, ends: as in word_hashes().
    """
    words, n = word_hashes(data, ends)
    text = np.repeat(np.arange(len(n)), n)
    chained = lambda x, y: mixed((x ^ y) + np.uint64(0xD1B54A32D192ED03))
    grams = chained(chained(mixed(words[:-2]), words[1:-1]), words[2:])
    here = np.flatnonzero(text[:-2] == text[2:]) if len(words) > 2 else np.empty(0, np.int64)
    many = n > 2
    count = np.where(many, n - 2, 1)
    end = np.cumsum(count)
    values = np.full(end[-1] if len(end) else 0, -1, np.int64)
    values[np.repeat(many, count)] = grams[here].view(np.int64)
    before = np.cumsum(n) - n
    for few in (1, 2):
        at = np.flatnonzero(n == few)
        whole = mixed(words[before[at]] + np.uint64(few))
        values[end[at] - 1] = (whole if few == 1 else chained(whole, words[before[at] + 1])).view(np.int64)
    for a, b in zip((end - count)[many].tolist(), end[many].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[end[:-1]] = True
    return values[new], np.add.reduceat(new, end - count, dtype=np.int64) if len(end) else end
