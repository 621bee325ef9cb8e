"""The label domain and the split names shared by every job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label ids and their names, four-class and binary view.
LABELS = {0: "benign", 1: "jailbreak", 2: "prompt_injection", 3: "obfuscation"}
BINARY_LABELS = {0: "benign", 1: "attack"}

SPLITS = ("train", "val", "test")
SEED = 42

PROMPT_SCHEMA = "text STRING, label INT, source STRING"


def label_names(binary: bool = False) -> dict[int, str]:
    return BINARY_LABELS if binary else LABELS


def label_name(label: Column, binary: bool = False) -> Column:
    """Label id -> name; ids outside the domain give NULL."""
    names = F.create_map(*[F.lit(x) for pair in label_names(binary).items() for x in pair])
    return F.try_element_at(names, label.cast("int"))


def binary_label(label: Column) -> Column:
    return (label > 0).cast("int")
