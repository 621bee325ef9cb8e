"""Tables, CSV exports, JSON statistics, vocabularies and fitted features on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptsieve.operators import vocab as v
from promptsieve.sources.readers import exists


def write_splits(rows: DataFrame, path: str) -> None:
    """Parquet partitioned by ``split``, so that reading one split scans only its folder."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_json(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """JSON documents; with ``lines``, one row per line, as ``write_json`` leaves them."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=not lines)


def save_vocab(vocab: DataFrame, path: str, level: str = "word", lowercase: bool = False) -> None:
    vocab.withColumns({"level": F.lit(level), "lowercase": F.lit(lowercase)}).write.mode("overwrite").parquet(path)


def load_vocab(spark: SparkSession, path: str) -> tuple[DataFrame, str, bool]:
    """(vocabulary, level, lowercase)."""
    saved = spark.read.parquet(path)
    options = saved.select("level", "lowercase").first()
    return saved.select("token", "id", "n"), options["level"], options["lowercase"]


def corpus_fingerprint(texts: DataFrame) -> str:
    """Order-independent hash of a corpus: row count and the sum of its text hashes."""
    n, total = texts.agg(F.count("*"), F.sum(F.xxhash64("row_id", "text").cast("decimal(38,0)"))).first()
    return f"{n}-{abs(int(total or 0)):x}"


def get_or_build_vocab(train: DataFrame, folder: str, level: str = "word", max_size: int | None = None,
                       lowercase: bool = False, rebuild: bool = False) -> DataFrame:
    """The vocabulary of the *train* texts, built once per level, size, case option and corpus content."""
    max_size = max_size or v.MAX_SIZE[level]
    case = "lower" if lowercase else "cased"
    path = f"{folder.rstrip('/')}/vocab_{level}_{max_size}_{case}_{corpus_fingerprint(train)}"
    if rebuild or not exists(train.sparkSession, path):
        save_vocab(v.build_vocab(train, level, max_size, lowercase=lowercase), path, level, lowercase)
    return load_vocab(train.sparkSession, path)[0]
