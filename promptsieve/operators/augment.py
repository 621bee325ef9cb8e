"""Obfuscated copies of attack rows, drawn and encoded inside each split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsieve.functions.codecs import TRAIN_CODECS, ArrowCodec, Codec, encode_rows
from promptsieve.functions.draws import row_seed
from promptsieve.functions.text import truncated
from promptsieve.labels import SEED, SPLITS
from promptsieve.operators.ranking import exact_sample
from promptsieve.session import materialized

FRACTION = 0.15
OBFUSCATION_LABEL = 3


def obfuscated_copies(rows: DataFrame, codecs: dict[str, Codec] = TRAIN_CODECS, frac: float = FRACTION,
                      seed: int = SEED, max_chars: int | None = None, source_labels=(1, 2),
                      by: str | None = None, strata: tuple = ()) -> DataFrame:
    """Label-3 copies of exactly ``floor(frac * attacks)`` attack rows, each through one codec drawn by row key."""
    attacks = rows.where(F.col("label").isin(*source_labels))
    chosen = exact_sample(attacks, "row_id", frac=frac, seed=seed, salt="augment", by=by, strata=strata)
    base = row_seed(seed, "codec", F.col("row_id"))
    index = F.pmod(row_seed(seed, "which", F.col("row_id")), F.lit(len(codecs)))
    drawn = chosen.withColumns({"_index": index, "_seed": base, "_text": truncated(F.col("text"), max_chars)})
    if any(isinstance(c, ArrowCodec) for c in codecs.values()):
        drawn = materialized(drawn, "drawn")    # one branch per Arrow codec reads it
    return (encode_rows(drawn, codecs, "_index", "_text", "_seed", "_codec", "_encoded")
            .withColumns({"text": F.col("_encoded"), "label": F.lit(OBFUSCATION_LABEL),
                          "source": F.concat(F.lit("obfuscated:"), "_codec")})
            .select(*rows.columns))


def augment(rows: DataFrame, codecs: dict[str, Codec] = TRAIN_CODECS, frac: float = FRACTION, seed: int = SEED,
            max_chars: int | None = None, source_labels=(1, 2)) -> DataFrame:
    """The rows and their obfuscated copies; unchanged when ``frac`` is not positive."""
    if frac <= 0:
        return rows
    return rows.unionByName(obfuscated_copies(rows, codecs, frac, seed, max_chars, source_labels))


def augment_splits(rows: DataFrame, codecs: dict[str, Codec] = TRAIN_CODECS, frac: float = FRACTION,
                   seed: int = SEED, max_chars: int | None = None, splits=SPLITS) -> DataFrame:
    """As ``augment``, with an exact share per split; a copy stays in the split of its original."""
    if frac <= 0:
        return rows
    return rows.unionByName(obfuscated_copies(rows, codecs, frac, seed, max_chars, by="split", strata=tuple(splits)))
