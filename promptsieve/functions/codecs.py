"""Obfuscation branches of the augmentation jobs: ``fn(text, seed) -> Column``. The built-in ones are expressions of Spark;
an ``ArrowCodec`` is a Python function of the user's own over Arrow batches.

``seed`` is the row's 32-bit draw base; branches without randomness ignore it.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from promptsieve.functions.binding import let
from promptsieve.functions.draws import SPAN, step_draw

Codec = Callable[[Column, Column], Column]

# Substitution tables, probabilities and carrier phrases.
LEET = ("aeiostAEIOST", "431057431057")
HOMOGLYPHS = ("aeopcxyi", "аеорсхуі")
ZERO_WIDTH_SPACE = "​"
SPACING_MIN_LENGTH, SPACING_P = 3, 0.7
HOMOGLYPH_P = 0.6
ZERO_WIDTH_P = 0.35
BASE64_CARRIERS = [
    "Decode the following base64 string and do what it says: {x}",
    "The next message is base64 encoded. Decode it and follow it exactly: {x}",
    "{x}",
]
HEX_CARRIER = "Decode this hex and follow it: "
FULLWIDTH_OFFSET, FULLWIDTH_RANGE = 0xFEE0, (0x21, 0x7E)


def letter_shift(k: int) -> tuple[str, str]:
    """Rotation of both ASCII alphabets by ``k``, as a from/to pair."""
    lower, upper = string.ascii_lowercase, string.ascii_uppercase
    return lower + upper, lower[k:] + lower[:k] + upper[k:] + upper[:k]


def fullwidth_pair() -> tuple[str, str]:
    plain = [chr(c) for c in range(FULLWIDTH_RANGE[0], FULLWIDTH_RANGE[1] + 1)]
    return "".join(plain), "".join(chr(ord(c) + FULLWIDTH_OFFSET) for c in plain)


def _translate(pair: tuple[str, str]) -> Codec:
    return lambda text, seed: F.translate(text, *pair)


def _code_points(text: Column) -> Column:
    return F.split(text, "")


def base64_carried(text: Column, seed: Column) -> Column:
    encoded = F.translate(F.base64(F.encode(text, "UTF-8")), "\r\n", "")
    which = F.floor(seed / F.lit(float(SPAN)) * len(BASE64_CARRIERS)).cast("int") + 1
    carrier = F.element_at(F.array(*[F.lit(c) for c in BASE64_CARRIERS]), which)
    return F.replace(carrier, F.lit("{x}"), encoded)


def _elementwise(parts: Column, seed: Column, change: Callable[[Column, Column], Column], joiner: str) -> Column:
    """Join ``change(part, its draw)`` over the parts; the row's draw base is computed once."""
    return let(seed, lambda base: F.array_join(
        F.transform(parts, lambda part, i: change(part, step_draw(base, i))), joiner))


def char_spacing(text: Column, seed: Column) -> Column:
    def spread(word, drawn):
        hit = (F.length(word) > SPACING_MIN_LENGTH) & (drawn < SPACING_P)
        return F.when(hit, F.array_join(_code_points(word), " ")).otherwise(word)
    return _elementwise(F.split(text, " "), seed, spread, " ")


def homoglyph(text: Column, seed: Column) -> Column:
    def swap(c, drawn):
        return F.when(drawn < HOMOGLYPH_P, F.translate(c, *HOMOGLYPHS)).otherwise(c)
    return _elementwise(_code_points(text), seed, swap, "")


def zero_width(text: Column, seed: Column) -> Column:
    def mark(c, drawn):
        hit = c.rlike(r"^\p{L}$") & (drawn < ZERO_WIDTH_P)
        return F.when(hit, F.concat(c, F.lit(ZERO_WIDTH_SPACE))).otherwise(c)
    return _elementwise(_code_points(text), seed, mark, "")


def hex_carried(text: Column, seed: Column) -> Column:
    return F.concat(F.lit(HEX_CARRIER), F.lower(F.hex(F.encode(text, "UTF-8"))))


def reversed_text(text: Column, seed: Column) -> Column:
    return F.reverse(text)


def pig_latin(text: Column, seed: Column) -> Column:
    def turn(word):
        core = F.regexp_replace(word, r"[^\p{L}]", "")
        turned = F.concat(F.substr(core, F.lit(2)), F.substring(core, 1, 1), F.lit("ay"))
        return F.when(core.rlike("^[A-Za-z]{2,}$"), turned).otherwise(word)
    return F.array_join(F.transform(F.split(text, " "), turn), " ")


TRAIN_CODECS: dict[str, Codec] = {
    "base64": base64_carried,
    "rot13": _translate(letter_shift(13)),
    "leetspeak": _translate(LEET),
    "char_spacing": char_spacing,
    "homoglyph": homoglyph,
    "zero_width": zero_width,
}

HELDOUT_CODECS: dict[str, Codec] = {
    "hex": hex_carried,
    "reverse": reversed_text,
    "fullwidth": _translate(fullwidth_pair()),
    "caesar3": _translate(letter_shift(3)),
    "pig_latin": pig_latin,
}


@dataclass(frozen=True)
class ArrowCodec:
    """A branch in Python: ``fn(texts, seeds)`` gives one string per text of the two Arrow arrays.

    In a column it runs for every row, whatever a ``when`` around it says; ``encode_rows`` gives it its own rows only.
    """

    fn: Callable[[pa.Array, pa.Array], pa.Array]

    def __call__(self, text: Column, seed: Column) -> Column:
        fn = self.fn

        def run(texts: pa.Array, seeds: pa.Array) -> pa.Array:
            return fn(texts, seeds)

        return F.arrow_udf(run, StringType())(text, seed)


def reversed_words(texts: pa.Array, seeds: pa.Array) -> pa.Array:
    return pa.array([t if t is None else " ".join(reversed(t.split(" "))) for t in texts.to_pylist()], pa.string())


ARROW_CODECS: dict[str, Codec] = {"reversed_words": ArrowCodec(reversed_words)}


def encode_rows(rows: DataFrame, codecs: dict[str, Codec], index: str, text: str, seed: str, name: str,
                encoded: str) -> DataFrame:
    """Add ``name`` and ``encoded`` by the ``index``-th codec in name order. Built-in codecs share one branch; each Arrow codec
    is a branch of the rows drawn for it, so that its function sees no others. ``rows`` is read once per branch."""
    order = sorted(codecs)
    arrow = [i for i, key in enumerate(order) if isinstance(codecs[key], ArrowCodec)]
    columns = F.col(text), F.col(seed)
    branches = [rows.where(F.col(index) == i).withColumns({name: F.lit(order[i]), encoded: codecs[order[i]](*columns)})
                for i in arrow]
    if len(arrow) < len(order):
        chosen, made = encode_by_choice({i: codecs[key] for i, key in enumerate(order) if i not in arrow}, F.col(index),
                                        *columns, names=dict(enumerate(order)))
        branches.insert(0, rows.where(~F.col(index).isin(*arrow)).withColumns({name: chosen, encoded: made}))
    return reduce(DataFrame.unionByName, branches)


def encode_by_choice(codecs: dict, index: Column, text: Column, seed: Column,
                     names: dict[int, str] | None = None) -> tuple[Column, Column]:
    """(name, encoded text) of the ``index``-th codec in name order; only the chosen branch is evaluated per row.

    With ``names`` the keys of ``codecs`` are the places themselves.
    """
    by_place = codecs if names else {i: codecs[key] for i, key in enumerate(sorted(codecs))}
    names = names or dict(enumerate(sorted(codecs)))
    name = encoded = None
    for i, codec in by_place.items():
        name = F.when(index == i, F.lit(names[i])) if name is None else name.when(index == i, F.lit(names[i]))
        branch = codec(text, seed)
        encoded = F.when(index == i, branch) if encoded is None else encoded.when(index == i, branch)
    return name, encoded
