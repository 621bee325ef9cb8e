import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text) or (doc_id, text, source) with extra columns whose names clash with the
    operators' own."""
    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.withColumns({c: F.lit(1) for c in ("_id", "key", "size", "label", "h", "n", "score", "toxic", "host",
                                                     "_text", "_h", "kept", "pseudonyms_of")})
    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and long texts, ties, repeated rows and ids."""
    long = " ".join(f"w{i % 997} x{i % 13}" for i in range(20_000))
    return make([(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (5, "one two"), (6, long), (7, long),
                 (None, "a null id here"), (None, None), (8, "a b c d e f g h i j k l", None), (9, "é ß 😀 x", None)])
