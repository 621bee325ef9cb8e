"""Near-duplicate families over whole texts: min-hash bands find candidates, exact Jaccard similarity links them, and
linked texts are one family.

A text is the set of its 5-word shingles (lower-cased; a shorter text is one shingle, an empty one has none and is a
family of its own with the other empty texts). Texts that are equal but for case and white space are one class and go
through once. Two classes with a similarity of 0.8 share one of the 25 bands with a probability above 0.9999.

Classes of a band are compared with the band's pivot, never with each other, so a round makes at most one pair per class and
band. Further rounds take other pivots and only classes that are not yet in the pivot's family, until rounds find nothing.
A band with few classes outside its largest family is closed at once: these meet all others, and no pair of it is left. How
many are few is set by the pairs that a round may make, a fixed number per class.
A class is named by 60 bits; classes whose names clash share a family.

Most pairs of a band are no links. Two numbers of a class rule them out without its set, and rule out no link: the size, and
a sketch with one parity bit per slot, which differs between two sets in at most as many bits as they have elements apart.
Only the sets of pairs that pass are brought together, and sets are only made of classes that share a band.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptsieve.functions.text import ODD_SPACE, WHITESPACE
from promptsieve.operators.lookup import BROADCAST_ROWS, bounded
from promptsieve.session import materialized

SHINGLE_WORDS = 5
MIN_PERCENT = 80
BANDS, BAND_ROWS = 25, 5
IDLE_ROUNDS = 2     # rounds without a new link after which the search ends
NAME_DIGITS = 15    # hexadecimal digits of a class name
BLOCK = 256         # shingles that are hashed at once: 256 KB, which stay in a core's cache
OUTSIDERS = 4       # classes outside the largest family of a band, up to which the band is always closed
CLOSING_PAIRS = 4   # pairs per class up to which a round closes more bands, those with the fewest classes outside first
SKETCH_BITS = 1024
HELD = 1 << 19      # numbers that leave a task at once, 4 MB; more only for a single text that has more
ARROW = {"int": pa.int32(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}

_draws = np.random.default_rng(42).integers(1, 1 << 63, size=(2, BANDS * BAND_ROWS), dtype=np.uint64)
_FACTORS, _SHIFTS = _draws[0] | np.uint64(1), _draws[1]
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def canonical(text: Column) -> Column:
    """Lower-cased words with one space between them. Texts that have no other white space are left as they are."""
    text = F.coalesce(text, F.lit(""))
    is_spaced = ~F.contains(text, F.lit("  ")) & ~text.rlike(f"[{ODD_SPACE}]")
    return F.trim(F.when(is_spaced, F.lower(text)).otherwise(F.regexp_replace(F.lower(text), f"[{WHITESPACE}]+", " ")))


def class_name(text: Column) -> Column:
    return F.conv(F.substring(F.md5(canonical(text)), 1, NAME_DIGITS), 16, 10).cast("bigint")


def _power(way: str, n: int) -> np.ndarray:
    """The powers 0 to n - 1 of the base ("up") or of its inverse ("down"), modulo 2**64."""
    if len(_powers[way]) < n:
        factor = np.uint64(_BASE if way == "up" else pow(_BASE, -1, 1 << 64))
        steps = np.full(2 * n, factor, dtype=np.uint64)
        steps[0] = 1
        _powers[way] = np.cumprod(steps)
    return _powers[way]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _FACTORS[0]
    return h ^ (h >> np.uint64(32))


def shingle_hashes(canon: bytes, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct hashes of the shingles of a text whose words have one space between them, sorted."""
    if not canon:
        return np.zeros(0, dtype=np.uint64)
    data = np.frombuffer(canon, dtype=np.uint8)
    spaces = np.flatnonzero(data == 32)
    starts, ends = np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(data)]))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data + np.uint64(1)) * _power("up", len(data))[:len(data)], out=sums[1:])
    words = _mixed((sums[ends] - sums[starts]) * _power("down", len(data))[starts] ^ (ends - starts).astype(np.uint64) * _MIX)
    n = min(n, len(words))
    h = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = _mixed(h * _MIX + words[k:len(words) - n + 1 + k])
    return np.unique(h)


def band_keys(values: np.ndarray) -> np.ndarray | None:
    """One key per band: the band's minima over all shingles, folded to 64 bits. None for a text without shingles."""
    if len(values) == 0:
        return None
    low = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), BLOCK):
        block = values[at:at + BLOCK, None] * _FACTORS
        block += _SHIFTS
        block ^= block >> np.uint64(29)
        np.minimum(low, block.min(axis=0), out=low)
    folded = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, BAND_ROWS).T:
        folded = (folded ^ column) * _MIX
        folded ^= folded >> np.uint64(31)
    return folded.view(np.int64)


def sketch(values: np.ndarray) -> np.ndarray:
    """Whether each of ``SKETCH_BITS`` slots holds an odd number of the hashes, 64 slots to a number."""
    odd = np.bincount((values >> np.uint64(40)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def from_hashes(texts: DataFrame, made: dict[str, tuple[str, Callable]]) -> DataFrame:
    """The columns of ``texts`` but ``_canon``, its last one, and those of ``made``: type and function of a text's hashes."""
    columns = texts.dtypes[:-1] + [(c, kind) for c, (kind, _) in made.items()]
    arrow = pa.schema([(c, ARROW[kind]) for c, kind in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for batch in batches:
            rows, held = [], 0
            for *row, canon in zip(*[c.to_pylist() for c in batch.columns[:-1]], batch.columns[-1]):
                h = shingle_hashes(canon.as_py().encode())
                rows.append((*row, *[fn(h) for _, fn in made.values()]))
                held += len(h)
                if held >= HELD:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return texts.mapInArrow(run, ", ".join(" ".join(c) for c in columns))


def classes(rows: DataFrame, text: str = "text", name: str | None = None) -> DataFrame:
    """(node, n, bands, sketch), one row per distinct text; ``name`` is the column of the class names, if there is one. Texts and
    sets stay where they are: copies are hashed each for itself and collapse before the shuffle."""
    texts = _named(rows, text, name).select("node", F.xxhash64("_canon").alias("_order"), "_canon")
    made = from_hashes(texts, {"n": ("int", len), "bands": ("array<bigint>", band_keys), "sketch": ("array<bigint>", sketch)})
    return (made.groupBy("node").agg(F.min(F.struct("_order", "n", "bands", "sketch")).alias("_first"))
            .select("node", "_first.n", "_first.bands", "_first.sketch"))


def shingle_sets(rows: DataFrame, nodes: DataFrame, text: str = "text", name: str | None = None) -> DataFrame:
    """(node, hashes) of the classes in ``nodes``. Only their texts are moved, and copies collapse before that."""
    texts = (_named(rows, text, name).join(bounded(nodes, nodes.count()), "node", "left_semi")
             .groupBy("node").agg(F.min(F.struct(F.xxhash64("_canon"), "_canon")).alias("_first"))
             .select("node", "_first._canon"))
    return from_hashes(texts, {"hashes": ("array<bigint>", lambda h: h.view(np.int64))})


def _named(rows: DataFrame, text: str, name: str | None) -> DataFrame:
    node = class_name(F.col(text)) if name is None else F.col(name)
    return rows.select(node.alias("node"), canonical(F.col(text)).alias("_canon"))


def pivot_pairs(banded: DataFrame, turn: int) -> DataFrame:
    """(pivot, node): classes of a band that aren't in the family of the band's pivot. ``banded`` has node, label, band.

    The first turn takes the smallest name, which is the same one in most bands of a family; later turns draw by band.
    """
    order = F.col("node") if turn == 0 else F.xxhash64(F.col("node"), F.col("band"), F.lit(turn))
    pivots = (banded.groupBy("band")
              .agg(F.min_by("node", order).alias("pivot"), F.min_by("label", order).alias("pivot_label"),
                   F.min("label").alias("_low"), F.max("label").alias("_high"))
              .where("_low < _high").select("band", "pivot", "pivot_label"))
    return (banded.join(pivots, "band").where("label <> pivot_label").select("pivot", "node").distinct())


def band_families(marked: DataFrame) -> DataFrame:
    """(band, top, outside, size): the largest family of each band that has several, and its classes outside it and in all."""
    return (marked.groupBy("band", "label").agg(F.count("*").alias("_c"))
            .groupBy("band").agg(F.max_by("label", F.struct("_c", "label")).alias("top"),
                                 (F.sum("_c") - F.max("_c")).alias("outside"), F.sum("_c").alias("size"))
            .where("outside > 0"))


def closing_limit(several: DataFrame, budget: int) -> int:
    """Classes outside the largest family up to which bands are closed with at most ``budget`` pairs."""
    step = F.length(F.bin(F.col("outside") - 1)) * (F.col("outside") > 1).cast("int")
    limit, total = OUTSIDERS, 0
    for places, pairs in sorted(several.groupBy(step).agg(F.sum(F.col("outside") * F.col("size"))).collect()):
        total += pairs
        if total <= budget:
            limit = max(limit, 1 << places)
    return limit


def closing_pairs(marked: DataFrame, few: DataFrame) -> DataFrame:
    """(pivot, node): in the bands of ``few``, each class outside the largest family with all classes of other families."""
    rows = marked.join(few.select("band", "top"), "band")
    outside = rows.where("label <> top").select("band", F.col("node").alias("_o"), F.col("label").alias("_of"), F.col("n").alias("_on"))
    return (rows.join(outside, "band").where("label <> _of").where(_sizes_fit(F.col("n"), F.col("_on")))
            .select(F.least("node", "_o").alias("pivot"), F.greatest("node", "_o").alias("node")).distinct())


def _sizes_fit(n: Column, m: Column, percent: int = MIN_PERCENT) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def likely(pairs: DataFrame, sketches: DataFrame, percent: int = MIN_PERCENT) -> DataFrame:
    """The pairs that their sizes and sketches do not rule out. ``sketches`` has node, n and sketch."""
    left = sketches.select("node", F.col("n").alias("_n"), F.col("sketch").alias("_s"))
    right = sketches.select(F.col("node").alias("pivot"), F.col("n").alias("_m"), F.col("sketch").alias("_t"))
    apart = F.aggregate(F.zip_with("_s", "_t", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    return (pairs.join(left, "node").join(right, "pivot").where(_sizes_fit(F.col("_n"), F.col("_m"), percent))
            .where((100 + percent) * apart <= (100 - percent) * (F.col("_n") + F.col("_m"))).select("pivot", "node"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int = MIN_PERCENT) -> DataFrame:
    """The pairs whose sets have at least ``percent`` of their union in common. Only sets of the pairs are moved."""
    pairs = materialized(pairs, "pairs")
    nodes = pairs.select("node").unionByName(pairs.select(F.col("pivot").alias("node"))).distinct()
    if nodes.count() <= BROADCAST_ROWS:
        sets = sets.join(F.broadcast(nodes), "node", "left_semi")
    left = sets.select("node", F.col("hashes").alias("_a"))
    right = sets.select(F.col("node").alias("pivot"), F.col("hashes").alias("_b"))
    common = F.size(F.array_intersect("_a", "_b"))
    return (pairs.join(left, "node").join(right, "pivot")
            .where(100 * common >= percent * (F.size("_a") + F.size("_b") - common))
            .select(F.col("pivot").alias("u"), F.col("node").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links (u, v) reach from each node they name. Labels spread to neighbours and then
    jump to their own label's label, so the number of rounds grows with the logarithm of the longest chain."""
    edges = materialized(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialized(edges.groupBy(F.col("u").alias("node"))
                          .agg(F.least(F.first("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = (edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node"))
                .agg(F.min("label").alias("_near")))
        spread = labels.join(near, "node").select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("_next"))
        # a label names a node of the links, whose own label may be smaller still
        jump = labels.select(F.col("node").alias("_next"), F.col("label").alias("_jump"))
        moved = materialized(spread.join(jump, "_next")
                             .select("node", "_old", F.least("_next", "_jump").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where("label < _old").isEmpty():
            return labels


def families(rows: DataFrame, text: str = "text", name: str | None = None) -> DataFrame:
    """(node, label) of the classes that link with another one; every other class is its own family. ``rows`` are read twice."""
    found = materialized(classes(rows, text, name), "classes")
    bands = found.select("node", "n", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("_n")).where("_n > 1").select("band")
    banded = materialized(bands.join(shared, "band"), "banded")     # bands of one class leave here
    nodes = banded.select("node").distinct()
    sketches = materialized(found.select("node", "n", "sketch").join(nodes, "node", "left_semi"), "sketches")
    sets = materialized(shingle_sets(rows, sketches.select("node"), text, name), "sets")
    budget = CLOSING_PAIRS * found.count()
    labels, turn, idle = None, 0, 0
    while idle < IDLE_ROUNDS:
        if labels is None:
            marked = banded.withColumn("label", F.col("node"))
        else:
            marked = banded.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        several = materialized(band_families(marked), "several")
        limit = closing_limit(several, budget)
        few, many = several.where(F.col("outside") <= limit), several.where(F.col("outside") > limit)
        marked = materialized(marked.join(several.select("band"), "band"), "marked")
        still = marked.join(many.select("band"), "band")
        pairs = closing_pairs(marked, few).unionByName(pivot_pairs(still, turn))
        new = materialized(verified(likely(pairs, sketches), sets), "links")
        banded, is_open, turn = still.drop("label"), not many.isEmpty(), turn + 1
        if new.isEmpty():
            idle += 1
        else:
            idle = 0
            if labels is not None:  # earlier families, as links to their smallest node
                new = new.unionByName(labels.where("node <> label").select(F.col("label").alias("u"), F.col("node").alias("v")))
            labels = components(new)
        if not is_open:
            break
    return labels if labels is not None else new.select(F.col("u").alias("node"), F.col("v").alias("label"))


def with_family(rows: DataFrame, name: str = "group_key", text: str = "text") -> DataFrame:
    """Add the family's key: the smallest class name in it, in hexadecimal digits. Stores the rows, which are read three times."""
    rows = materialized(rows.withColumn("_node", class_name(F.col(text))), "rows")
    found = families(rows, text, "_node").select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    return (rows.join(bounded(found, found.count()), "_node", "left")
            .withColumn(name, F.lower(F.lpad(F.hex(F.coalesce("_label", "_node")), NAME_DIGITS, "0")))
            .drop("_node", "_label"))
