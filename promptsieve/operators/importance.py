"""Token importance. Input: attributions (row_id, pos, token, score, special, pred), one row per token, or one row per prompt
with (row_id, pred, tokens), ``tokens`` an array of (pos, token, score, special). The second form needs no shuffle by prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptsieve.functions.binding import let
from promptsieve.functions.text import clean_subword

TOP_PER_PROMPT = 8
MIN_COUNT, TOP_TOKENS = 3, 25


def is_nested(attributions: DataFrame) -> bool:
    return "tokens" in attributions.columns


def nested(weighted: DataFrame, score: str = "values") -> DataFrame:
    """One row per prompt, of (row_id, pred) beside the arrays indices, term, special and ``score``."""
    named = weighted.withColumnsRenamed({"indices": "pos", "term": "token", score: "score"})
    return named.select("row_id", "pred", F.arrays_zip("pos", "token", "score", "special").alias("tokens"))


def flat(attributions: DataFrame) -> DataFrame:
    """One row per token."""
    return attributions.select("row_id", "pred", F.inline("tokens")) if is_nested(attributions) else attributions


def normalized(attributions: DataFrame) -> DataFrame:
    """Scores relative to the prompt's largest one; special tokens score 0."""
    if is_nested(attributions):
        scores = F.transform("tokens", lambda t: F.when(t["special"], 0.0).otherwise(t["score"]))
        relative = let(scores, lambda masked: let(F.array_max(masked), lambda top: F.transform(
            masked, lambda score: F.when(top > 0, score / top).otherwise(score))))
        return attributions.withColumn("tokens", F.zip_with("tokens", relative, lambda t, score: F.struct(
            t["pos"].alias("pos"), t["token"].alias("token"), score.alias("score"), t["special"].alias("special"))))
    masked = F.when(F.col("special"), 0.0).otherwise(F.col("score"))
    top = F.max("_masked").over(Window.partitionBy("row_id"))
    return (attributions.withColumn("_masked", masked)
            .withColumn("score", F.when(top > 0, F.col("_masked") / top).otherwise(F.col("_masked")))
            .drop("_masked"))


def top_tokens_per_prompt(attributions: DataFrame, k: int = TOP_PER_PROMPT) -> DataFrame:
    if is_nested(attributions):
        kept = F.transform(F.filter("tokens", lambda t: ~t["special"]),
                           lambda t: F.struct((-t["score"]).alias("_low"), t["pos"].alias("_at"), t["token"].alias("token")))
        return (attributions.select("row_id", F.posexplode(F.slice(F.sort_array(kept), 1, k)).alias("_place", "_t"))
                .select("row_id", (F.col("_place") + 1).alias("rank"), clean_subword(F.col("_t.token")).alias("token"),
                        (-F.col("_t._low")).alias("score")))
    ranked = F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("score"), "pos"))
    return (attributions.where(~F.col("special")).withColumn("rank", ranked).where(F.col("rank") <= k)
            .select("row_id", "rank", clean_subword(F.col("token")).alias("token"), "score"))


def mean_importance(attributions: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(token, mean_importance, n) over prompts predicted as an attack."""
    return (flat(attributions.where("pred != 0")).where(~F.col("special"))
            .groupBy(F.lower(clean_subword(F.col("token"))).alias("token"))
            .agg(F.avg("score").alias("mean_importance"), F.count("*").alias("n"))
            .where(F.col("n") >= min_count))


def top_tokens(attributions: DataFrame, k: int = TOP_TOKENS, min_count: int = MIN_COUNT) -> DataFrame:
    """The ``k`` tokens that drive attack predictions most. Means are rounded so that ties do not hang on sum order."""
    return (mean_importance(attributions, min_count)
            .withColumn("mean_importance", F.round("mean_importance", 9))
            .orderBy(F.desc("mean_importance"), "token").limit(k))
