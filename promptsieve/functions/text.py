"""Text functions. Nothing here removes evidence: case, punctuation and odd code points survive."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, written out so that Java, RE2 and Python agree on them.
WHITESPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD_CHARS = r"\p{L}\p{N}_"
SPACES = "".join(map(chr, [*range(0x9, 0xe), *range(0x1c, 0x20), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b), 0x2028, 0x2029,
                           0x202f, 0x205f, 0x3000]))     # the same but for the blank itself, one by one
ODD_SPACE = WHITESPACE.replace(r"\x1c-\x20", r"\x1c-\x1f")   # the class without the blank
# Code points that canonical composition never touches. A text made of them alone is already NFC.
NFC_STABLE = (
    r"\x{0}-\x{2ff}\x{38e}-\x{482}\x{48a}-\x{52f}\x{200b}-\x{20cf}\x{2190}-\x{2328}\x{2500}-\x{27bf}"
    r"\x{3000}-\x{3029}\x{3030}-\x{3098}\x{309b}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7a3}\x{ff01}-\x{ffee}"
    r"\x{1f300}-\x{1faff}"
)

WORD_TOKEN = f"[{WORD_CHARS}]+|[^{WORD_CHARS}{WHITESPACE}]"
SIGNATURE_CHARS = 80


def nfc(text: Column) -> Column:
    """Canonical composition by the ICU library that Spark ships, called only for texts that could change.

    Spark treats the call as non-deterministic, so it is neither repeated for a filter nor inlined elsewhere.
    """
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    is_ascii = F.length(text) == F.octet_length(text)
    return F.when(is_ascii | text.rlike(f"^[{NFC_STABLE}]*$"), text).otherwise(composed)


def normalize(text: Column) -> Column:
    """NULL to empty, NFC, NUL dropped, whitespace runs to one space, ends trimmed."""
    composed = nfc(F.coalesce(text.cast("string"), F.lit("")))
    spaced = F.translate(composed, SPACES + "\x00", " " * len(SPACES))
    return F.trim(F.regexp_replace(spaced, "  +", " "))


def word_tokens(text: Column, lowercase: bool = False) -> Column:
    """Runs of word characters, and every other visible character on its own."""
    text = F.lower(text) if lowercase else text
    return F.regexp_extract_all(text, F.lit(WORD_TOKEN), F.lit(0))


def char_tokens(text: Column, lowercase: bool = False) -> Column:
    """Code points."""
    text = F.lower(text) if lowercase else text
    return F.filter(F.split(text, ""), lambda c: c != "")


def tokens(text: Column, level: str = "word", lowercase: bool = False) -> Column:
    if level not in ("word", "char"):
        raise ValueError(f"unknown token level {level!r}")
    return (word_tokens if level == "word" else char_tokens)(text, lowercase)


def matches(text: Column, pattern: str) -> Column:
    """``rlike`` for alternatives without groups. Plain words among them are searched as bytes, which takes a fraction of the
    time that a regular expression takes to try them at every character."""
    parts = re.findall(r"(?:\[[^\]]*\]|[^|\[])+", pattern)
    if "|".join(parts) != pattern or set(pattern) & set("()\\"):
        return text.rlike(pattern)
    plain = [p for p in parts if not set(p) & set(".^$*+?{}[]")]
    found = [F.contains(text, F.lit(p)) for p in plain]
    if len(plain) < len(parts):
        found.append(text.rlike("|".join(p for p in parts if p not in plain)))
    return functools.reduce(Column.__or__, found)


def exact_key(text: Column) -> Column:
    """Key of texts that differ in case only: 64 hex characters instead of the text itself."""
    return F.sha2(F.lower(text), 256)


def group_key(text: Column, n_chars: int = SIGNATURE_CHARS, empty_signature: str = "shared") -> Column:
    """Key of near-copies: md5 of the first letters and digits of the lower-cased text.

    Texts without any ``[a-z0-9]`` share one group, unless ``empty_signature='full_text'`` hashes their whole text.
    """
    signature = F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9]", ""), 1, n_chars)
    if empty_signature == "full_text":
        return F.md5(F.when(signature == "", F.concat(F.lit("#"), text)).otherwise(signature))
    return F.md5(signature)


def clean_subword(token: Column) -> Column:
    """Drop sub-word markers; a token that is nothing but a marker stays as it is."""
    bare = token
    for marker in ("Ġ", "##", "▁"):  # fixed values: sub-word markers
        bare = F.replace(bare, F.lit(marker), F.lit(""))
    return F.coalesce(F.nullif(bare, F.lit("")), token)


def truncated(text: Column, max_chars: int | None) -> Column:
    """First ``max_chars`` code points; the whole text when no limit is given."""
    return text if max_chars is None else F.substring(text, 1, max_chars)
