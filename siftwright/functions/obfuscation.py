"""Obfuscation flags and base64 decoding as column expressions."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwright.config import CleaningConfig
from siftwright.functions.text import clean_text, let

# The patterns of each kind, in the order in which kinds are listed.
BASE64 = r"(?:[A-Za-z0-9+/]{4}){2,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?"
KINDS = {
    "base64": BASE64,
    "hex": r"(?U)\b(?:0x)?([0-9a-fA-F]{8,})\b",
    "url_encoding": r"(?:%[0-9a-fA-F]{2})+",
    "leetspeak": r"(?d)[134570](?=.*[a-zA-Z])",
    "mixed_script": r"[\x{0400}-\x{04FF}\x{0600}-\x{06FF}\x{4E00}-\x{9FFF}\x{0590}-\x{05FF}]",
    "char_repetition": r"(?d)(.)\1{3,}",
}
#: Texts of nothing else are printable, whatever the JVM's Unicode version; \\z, since $ also matches before a final line end.
PLAIN = r"\A[ -~]*+\z"


def _unprintable() -> str:
    """A class of all characters that str.isprintable() rejects: the JVM's own categories are of another Unicode version."""
    kept: list[list[int]] = []
    for c in filter(lambda c: chr(c).isprintable(), range(sys.maxunicode + 1)):
        if kept and kept[-1][1] == c - 1:
            kept[-1][1] = c
        else:
            kept.append([c, c])
    return "[^" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in kept) + "]"


UNPRINTABLE = _unprintable()
CONTEXT_FRAGMENTS = 2


def obfuscation_flag(text: Column, kind: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(KINDS[kind])


def obfuscation_types(text: Column) -> Column:
    found = F.array(*(F.when(obfuscation_flag(text, kind), F.lit(kind)) for kind in KINDS))
    return F.filter(found, lambda kind: kind.isNotNull())


def decode_base64(fragment: Column) -> Column:
    """The decoded text; null unless strict base64 of valid UTF-8 that is printable or has a space."""
    padded = F.rpad(fragment, (F.ceil(F.length(fragment) / 4) * 4).cast("int"), F.lit("="))
    text = F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))
    return F.when(text.rlike(PLAIN) | text.contains(" ") | ~text.rlike(UNPRINTABLE), text)


def base64_fragments(text: Column) -> Column:
    """Decoded fragments of the raw text, in order, repeats included."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(BASE64), 0)
    return let(found, lambda m: F.filter(F.transform(m, decode_base64), lambda x: x.isNotNull() & (x != "")))


def decoded_context(fragments: Column) -> Column:
    """What is appended to a text with decoded fragments: the first two distinct ones; else nothing."""
    shown = F.array_join(F.slice(F.array_distinct(fragments), 1, CONTEXT_FRAGMENTS), " | ")
    return F.when(F.size(fragments) > 0, F.concat(F.lit(" [decoded_context: "), shown, F.lit("]"))).otherwise("")


def obfuscation_aware_text(text: Column, config: CleaningConfig = CleaningConfig()) -> Column:
    """Cleaned text that keeps its case, with up to two distinct decoded fragments appended."""
    return F.concat(clean_text(text, config), decoded_context(base64_fragments(text)))
