"""Synthetic prompts composed from sentences of given texts, one attempt per row.

Nothing is written here but frames: two sentences of a row's text, drawn by its key, are set into the layout of a class. An
injection hides the second sentence in markup behind the first, a jailbreak puts it into a header before it, and a benign
prompt only joins the two. A generator is ``fn(seed, key, text) -> (text, tag)``: two Columns, the tag NULL when the source
needs none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptsieve.functions.codecs import HELDOUT_CODECS, encode_by_choice
from promptsieve.functions.draws import choice, draw, pick, row_seed
from promptsieve.functions.text import exact_key, normalize
from promptsieve.labels import SEED

Generator = Callable[[int, Column, Column], tuple[Column, Column]]

SENTENCE_END = "[.!?\\n]+"
FRAMES = {
    "injection": ["{a} <!-- {b} -->", "{a} ]] {b} [[", "{a} ### {b} ###"],
    "jailbreak": ["system = {b} ; user = {a}", "<mode {b} > {a}"],
    "benign": ["{a}, {b}.", "{a}? {b}.", "{a}: {b}!", "{a} ({b})."],
}
CLASSES = ("benign", "jailbreak", "injection")     # by label


def sentence(text: Column, salt: str, seed: int, key: Column) -> Column:
    """A drawn sentence of the text; empty if it has none."""
    parts = F.filter(F.transform(F.split(text, SENTENCE_END), lambda x: F.trim(x)), lambda x: x != "")
    at = F.floor(draw(seed, salt, key) * F.size(parts)).cast("int")
    return F.coalesce(F.get(parts, at), F.lit(""))


def framed(kind: str, seed: int, key: Column, text: Column) -> Column:
    """Both sentences in a drawn frame of the class."""
    frame = pick(FRAMES[kind], seed, f"frame_{kind}", key)
    first, second = (sentence(text, f"{kind}_{s}", seed, key) for s in "ab")
    return F.replace(F.replace(frame, F.lit("{a}"), first), F.lit("{b}"), second)


def _plain(kind: str) -> Generator:
    return lambda seed, key, text: (framed(kind, seed, key, text), F.lit(None).cast("string"))


jailbreak, injection, hard_benign = _plain("jailbreak"), _plain("injection"), _plain("benign")


def heldout_obfuscation(seed: int, key: Column, text: Column) -> tuple[Column, Column]:
    """An injection or a jailbreak, half each, through one codec that augmentation never uses."""
    base = F.when(draw(seed, "base", key) < 0.5, framed("injection", seed, key, text)).otherwise(
        framed("jailbreak", seed, key, text))
    index = choice(len(HELDOUT_CODECS), seed, "heldout", key)
    name, encoded = encode_by_choice(HELDOUT_CODECS, index, base, row_seed(seed, "codec", key))
    return encoded, name


def generate(rows: DataFrame, generator: Generator, n: int | None, label: int, source: str,
             seed: int = SEED) -> DataFrame:
    """(row_id, text, label, source): the first ``n`` texts that differ when lower-cased, in ``rows.row_id`` order.

    Fewer come back when the rows give no more; ``n=None`` keeps every distinct text.
    """
    text, tag = generator(seed, F.col("row_id"), F.col("text"))
    made = rows.select("row_id", normalize(text).alias("text"), tag.alias("_tag"))
    distinct = (made.groupBy(exact_key(F.col("text")).alias("_key"))
                .agg(F.min(F.struct("row_id", "text", "_tag")).alias("_row")).select("_row.*"))
    first = distinct if n is None else distinct.orderBy("row_id").limit(n)
    return first.select("row_id", "text", F.lit(label).alias("label"),
                        F.concat_ws(":", F.lit(source), F.col("_tag")).alias("source"))


def toy_corpus(rows: DataFrame, seed: int = 0) -> DataFrame:
    """(row_id, text, label, source): one labelled smoke-test prompt per row, classes 0/1/2 at .5/.25/.25.

    The row's key in front makes every text unique.
    """
    key, which = F.col("row_id"), draw(seed, "class", F.col("row_id"))
    label = F.when(which < 0.5, 0).when(which < 0.75, 1).otherwise(2)
    bodies = [framed(kind, seed, key, F.col("text")) for kind in CLASSES]
    body = F.when(F.col("label") == 0, bodies[0]).when(F.col("label") == 1, bodies[1]).otherwise(bodies[2])
    return (rows.select("row_id", F.col("text"), label.alias("label"))
            .select("row_id", F.concat(key.cast("string"), F.lit(" "), body).alias("text"), "label",
                    F.lit("toy").alias("source")))
