"""The held-out set of novel phrasings: candidates from a manual file and four generators, minus near-copies of
anything already in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsieve.labels import SEED
from promptsieve.operators import generate as g
from promptsieve.operators.dedup import first_per_key
from promptsieve.operators.similarity import MAX_SIM, reference_texts, similarity_filter
from promptsieve.operators.tfidf import TermSpec
from promptsieve.session import materialized

# Prompts asked from each generator.
SIZES = {"jailbreak": 150, "injection": 150, "obfuscation": 100, "benign": 200}

RECIPES = (("jailbreak", g.jailbreak, 1, "template"), ("injection", g.injection, 2, "template"),
           ("obfuscation", g.heldout_obfuscation, 3, "obfuscated"), ("benign", g.hard_benign, 0, "hard_benign"))


def candidate_pool(rows: DataFrame, manual: DataFrame | None = None, sizes: dict[str, int] = SIZES,
                   seed: int = SEED) -> DataFrame:
    """(row_id, text, label, source, part): manual rows first, then what the generators make of ``rows``; one row per
    text, the first by (part, row_id)."""
    parts = [manual] if manual is not None else []
    parts += [g.generate(rows, fn, sizes[name], label, source, seed)
              for name, fn, label, source in RECIPES]
    offset = 0 if manual is not None else 1
    pool = None
    for i, part in enumerate(parts, start=offset):
        part = part.select("row_id", "text", "label", "source").withColumn("part", F.lit(i))
        pool = part if pool is None else pool.unionByName(part)
    return first_per_key(pool, F.col("text"), "part", "row_id")


def with_pool_id(pool: DataFrame) -> DataFrame:
    """One BIGINT key over all parts: 8 parts interleave, so keys stay unique."""
    return pool.withColumn("row_id", F.col("row_id") * 8 + F.col("part"))


def novel_set(candidates: DataFrame, *seen: DataFrame, max_sim: float = MAX_SIM, mode: str = "exact_max",
              spec: TermSpec | None = None, small: bool | None = None) -> DataFrame:
    """Candidates with ``max_sim`` and ``keep`` against every text of the ``seen`` tables."""
    return similarity_filter(candidates, reference_texts(*seen), max_sim, mode, spec, small)


def build(rows: DataFrame, path: str, *seen: DataFrame, manual: DataFrame | None = None,
          sizes: dict[str, int] = SIZES, max_sim: float = MAX_SIM, seed: int = SEED) -> DataFrame:
    """Write the novel set made of sentences of ``rows``; returns it with the columns of a prompt table."""
    spark = rows.sparkSession
    pool = materialized(with_pool_id(candidate_pool(rows, manual, sizes, seed)), "pool")
    kept = novel_set(pool, *seen, max_sim=max_sim).where("keep")
    kept.select("row_id", "text", "label", "source").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
