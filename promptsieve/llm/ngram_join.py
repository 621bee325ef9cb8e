"""N-gram Jaccard self-join by vertical partitioning.

A text is the set of its five-word shingles. Texts with equal sets are one class and go through once.

1. Two texts that link share t of their smallest shingles, the first n - ceil(0.8 n) + t of n in the order of the hashes.
   Classes of which fewer than t = ceil(n / 10) of these are held by other classes link with nothing and go no further. The
   names of the others go to the tasks as a bitmap of bounded size, whose false hits only keep more classes.
   The global order of shingles is cut into fragments by hash. Map tasks pack their shingles per fragment, so one shuffle of
   about eight bytes a shingle brings each fragment together; there document frequencies are counted and shingles of one
   class dropped. A class that keeps less than the threshold of its shingles links with nothing.
2. The rest is ordered by (frequency, hash). Classes that link share a shingle of their prefixes.
3. Candidates are tried in rounds: first every class against one pivot per prefix shingle, then, after links have merged
   classes to components, only pairs of different components. The first pivot is the most central class, whose shingles are
   held by most others, as the text that others are copies of. What is left of a group of near copies is joined by what its
   members lack and what they have beside the group's common shingles, so a group of thousands costs a few pairs per
   member; passages that many documents share stay out of the prefixes. The last round leaves no pair out.
4. A pair's overlap is counted fragment by fragment and summed per pair; the exact counts decide.

Edge cases: null texts and texts without a word have no shingle, link with nothing and are their own component; texts of one
to four words are one shingle; rows that repeat an id or a text each come back; a null id's component is the smallest id
among its copies, null if there is none; an empty table gives an empty table; extra columns are ignored. Classes are named
by 64 bits of their shingles' hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptsieve.llm.common import chunks, mixed, small, stored, with_side, word_hashes, word_spans
from promptsieve.llm.phrases import _in as in_bitmap, bitmap

WORDS = 5
PERCENT = 80
PREFIX_PART = 10            # share of a class's shingles that links must show among the smallest ones
PACK_SHINGLES = 1 << 19     # shingles a map task holds before it sends them, packed per fragment
HASH_BYTES = 6              # of a shingle's hash that are sent; the fragment adds what it knows of the rest
PARTS = 4                   # fragments in which overlaps of candidate pairs are counted
PIVOT_ROUNDS = 3
COMPLEMENT_ROUNDS = 2
FRAGMENT_SHINGLES = 1 << 21 # shingles of a fragment, at which more fragments than shuffle partitions are cut
_C = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, ends: np.ndarray, n: int = WORDS):
    """(hashes, bounds): the distinct shingles of every text, sorted inside each text."""
    starts, stops, bounds = word_spans(data, ends)
    h = word_hashes(data, starts, stops)
    many = len(h) - n + 1
    rolled = np.zeros(max(many, 0), dtype=np.uint64)
    for k in range(n if many > 0 else 0):
        rolled = mixed(rolled * _C + h[k:k + many])
    out, sizes = [], np.zeros(len(bounds) - 1, dtype=np.int64)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if b - a >= n:
            s = np.unique(rolled[a:b - n + 1])
        elif b > a:
            s = np.full(1, b - a, dtype=np.uint64)
            for x in h[a:b]:
                s = mixed(s * _C + x)
        else:
            continue
        sizes[i] = len(s)
        out.append(s)
    at = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=at[1:])
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), at


def class_keys(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One signed 64-bit name per text, equal for equal sets."""
    sizes = np.diff(at)
    full = np.flatnonzero(sizes)
    key = np.zeros(len(sizes), dtype=np.uint64)
    if len(full):
        first = at[:-1][full]
        total = np.add.reduceat(mixed(hashes ^ _C), first)
        key[full] = mixed(total * _C ^ mixed(np.bitwise_xor.reduceat(hashes, first)) ^ sizes[full].astype(np.uint64))
    return key.view(np.int64)


def _sets_of(batch: pa.RecordBatch):
    for first, end, data, ends in chunks(batch.column("text")):
        hashes, at = shingle_sets(data, ends)
        yield first, end, hashes, at


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, key)."""
    def run(batches):
        for batch in batches:
            for first, end, hashes, at in _sets_of(batch):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[first:end], batch.column("text_hash")[first:end], pa.array(np.diff(at)),
                     pa.array(class_keys(hashes, at))], names=["doc_id", "text_hash", "n_shingles", "key"])
    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, "doc_id bigint, text_hash bigint, n_shingles bigint, key bigint")


def smallest(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): of each class the smallest shingles, of which it shares ``ceil(n / PREFIX_PART)`` with any class it
    links with. The hashes are mixed again, so that they spread over the fragments."""
    sizes = np.diff(at)
    kept = sizes + (-sizes * PERCENT // 100) - (-sizes // PREFIX_PART)      # n - ceil(0.8 n) + ceil(n / 10)
    place = np.arange(len(hashes)) - np.repeat(at[:-1], sizes)
    return mixed(hashes[place < np.repeat(kept, sizes)] ^ _C), kept


def packed(docs: DataFrame, fragments: int, only: tuple[int, np.ndarray] | None = None, prefix: bool = False) -> DataFrame:
    """(fragment, hashes, keys, counts): a map task's shingles of one fragment; ``counts`` of them belong to each of
    ``keys``. A task sends each class once, with ``only`` just the classes of that bitmap, with ``prefix`` just the
    smallest shingles."""
    def run(batches):
        seen: set[int] = set()
        held, n_held = [], 0

        def sent():
            hashes = np.concatenate([x for x, _, _ in held])
            keys = np.repeat(np.concatenate([k for _, k, _ in held]), np.concatenate([c for _, _, c in held]))
            fragment = ((hashes >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(fragment, kind="stable")
            hashes, keys, fragment = hashes[order], keys[order], fragment[order]
            cuts = np.flatnonzero(np.diff(fragment)) + 1
            rows = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fragment)]):
                new = np.flatnonzero(np.diff(keys[a:b])) + 1
                at = np.concatenate([[0], new, [b - a]])
                low = hashes[a:b].view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
                rows.append((int(fragment[a]), low.tobytes(), keys[a:b][at[:-1]].tobytes(),
                             np.diff(at).astype(np.int32).tobytes()))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                names=["fragment", "hashes", "keys", "counts"])

        for batch in batches:
            for _, _, hashes, at in _sets_of(batch):
                keys, sizes = class_keys(hashes, at), np.diff(at)
                if prefix:
                    hashes, sizes = smallest(hashes, at)
                wanted = np.ones(len(keys), dtype=bool) if only is None else in_bitmap(only, keys.view(np.uint64))
                fresh = np.zeros(len(keys), dtype=bool)
                for i, (k, n) in enumerate(zip(keys.tolist(), sizes.tolist())):
                    if n and wanted[i] and k not in seen:
                        seen.add(k)
                        fresh[i] = True
                if not fresh.any():
                    continue
                held.append((hashes[np.repeat(fresh, sizes)], keys[fresh], sizes[fresh]))
                n_held += int(sizes[fresh].sum())
                if n_held >= PACK_SHINGLES:
                    yield sent()
                    held, n_held = [], 0
        if held:
            yield sent()
    return docs.select("text").mapInArrow(run, "fragment int, hashes binary, keys binary, counts binary")


def shared(packs: DataFrame, fragments: int) -> DataFrame:
    """(key, h, df): shingles that two classes or more hold. A task sees whole fragments."""
    def run(batches):
        hashes, keys = [], []
        for batch in batches:
            for f, h, k, c in zip(*(batch.column(i).to_pylist() for i in ("fragment", "hashes", "keys", "counts"))):
                whole = np.zeros((len(h) // HASH_BYTES, 8), dtype=np.uint8)
                whole[:, :HASH_BYTES] = np.frombuffer(h, dtype=np.uint8).reshape(-1, HASH_BYTES)
                hashes.append(whole.view(np.uint64).ravel() | np.uint64(f % (1 << 16) << (8 * HASH_BYTES)))
                keys.append(np.repeat(np.frombuffer(k, dtype=np.int64), np.frombuffer(c, dtype=np.int32)))
        if not hashes:
            return
        h, k = np.concatenate(hashes), np.concatenate(keys)
        del hashes, keys
        order = np.argsort(h)
        same = np.flatnonzero(np.diff(h[order]) == 0)   # drop what is alone before the finer sort
        order = order[np.union1d(same, same + 1)]
        h, k = h[order], k[order]
        order = np.lexsort((k, h))
        h, k = h[order], k[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
        h, k = h[new], k[new]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])) if len(h) else np.zeros(1, dtype=int)
        df = np.repeat(np.diff(at), np.diff(at))
        keep = df > 1
        order = np.argsort(k[keep], kind="stable")
        for a in range(0, len(order), 50_000):
            o = order[a:a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(k[keep][o]), pa.array(h[keep][o].view(np.int64)),
                                              pa.array(df[keep][o].astype(np.int32))], names=["key", "h", "df"])
    return packs.repartition(fragments, "fragment").mapInArrow(run, "key bigint, h bigint, df int")


def _least(n: Column) -> Column:
    """Shingles that a class of ``n`` must share with any class it links with."""
    return F.ceil(n * PERCENT / 100)


def meeting(docs: DataFrame, sizes: DataFrame, total: int) -> tuple[int, np.ndarray]:
    """Bitmap of the classes of whose smallest shingles others hold as many as a link takes. ``sizes`` has key and n."""
    fragments = _fragments(docs, total * (100 - PERCENT) // 100 * 2)
    held = shared(packed(docs, fragments, prefix=True), fragments).groupBy("key").agg(F.count("*").alias("_held"))
    enough = held.join(sizes, "key").where(F.col("_held") >= F.ceil(F.col("n") / PREFIX_PART))
    return bitmap(stored(enough.select(F.col("key").alias("name"))))


def survivors(docs: DataFrame, named: DataFrame, total: int) -> DataFrame:
    """(key, n, tokens, weight): classes that may link; ``tokens`` are their shared shingles, rarest first, and ``weight``
    says how central they are."""
    sizes = named.where("n_shingles > 0").groupBy("key").agg(F.first("n_shingles").alias("n"))
    only, fragments = meeting(docs, sizes, total), _fragments(docs, total)
    kept = shared(packed(docs, 3 * fragments, only), fragments).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("df", "h"))).alias("tokens"))
    weight = F.aggregate("tokens.df", F.lit(0.0), lambda a, x: a + F.log(x.cast("double"))) / F.col("n")
    return (kept.join(sizes, "key").where(F.size("tokens") >= _least(F.col("n")))
            .select("key", "n", "tokens", weight.alias("weight")))


def _fragments(docs: DataFrame, shingles: int) -> int:
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shingles // FRAGMENT_SHINGLES))


def linked(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs (a, b) beyond the threshold. ``parts`` has (key, part, hs): overlaps are counted part by part and summed."""
    left = parts.select(F.col("key").alias("a"), "part", F.col("hs").alias("_l"))
    right = parts.select(F.col("key").alias("b"), "part", F.col("hs").alias("_r"))
    met = pairs.join(left, "a").join(right, ["b", "part"])
    overlap = met.groupBy("a", "b").agg(F.sum(F.size(F.array_intersect("_l", "_r"))).alias("o"),
                                        F.first("na").alias("na"), F.first("nb").alias("nb"))
    return overlap.where(100 * F.col("o") >= PERCENT * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(key, label): labels of linked keys merged to the smallest, by neighbours' minimum and pointer jumping."""
    named = labels.select(F.col("key").alias("a"), F.col("label").alias("la"))
    other = labels.select(F.col("key").alias("b"), F.col("label").alias("lb"))
    edges = links.join(named, "a").join(other, "b").where("la <> lb").select("la", "lb")
    edges = stored(edges.unionByName(edges.select(F.col("lb").alias("la"), F.col("la").alias("lb"))).distinct())
    if not edges.limit(1).count():
        return labels
    roots = stored(edges.groupBy("la").agg(F.least(F.col("la"), F.min("lb")).alias("root")))
    while True:
        of = roots.select(F.col("la").alias("lb"), F.col("root").alias("_r"))
        near = edges.join(of, "lb").groupBy("la").agg(F.min("_r").alias("_near"))
        up = roots.select(F.col("la").alias("root"), F.col("root").alias("_up"))
        moved = stored(roots.join(near, "la").join(up, "root", "left").select(
            "la", F.least("root", "_near", F.coalesce("_up", "root")).alias("_new"), "root"))
        changed = moved.where("_new <> root").limit(1).count()
        roots = moved.select("la", F.col("_new").alias("root"))
        if not changed:
            break
    return labels.join(roots.withColumnRenamed("la", "label"), "label", "left").select(
        "key", F.coalesce("root", "label").alias("label"))


def _fits(na: Column, nb: Column) -> Column:
    return 100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)


def merged(found: DataFrame) -> DataFrame:
    """(key, label): components of the survivors."""
    prefix = F.slice("tokens", F.lit(1), (F.size("tokens") - _least(F.col("n")) + 1).cast("int"))
    tokens = stored(found.select("key", "n", F.posexplode(prefix).alias("_at", "_t"), F.size("tokens").alias("_k"),
                              "weight").select(
        "key", "n", "weight", F.col("_k").alias("k"), F.col("_t.h").alias("h"), (F.col("_k") - F.col("_at")).alias("left")))
    hs = lambda p: F.filter("tokens.h", lambda x: F.pmod(x, PARTS) == p)
    parts = found.select("key", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), hs(p).alias("hs"))
                                                    for p in range(PARTS)])).alias("_p")).select("key", "_p.*")
    parts = stored(parts)
    labels = found.select("key", F.col("key").alias("label"))
    for turn in range(PIVOT_ROUNDS):
        rows = tokens.join(labels, "key") if turn else tokens.withColumn("label", F.col("key"))
        # the most central class, later one of another half of the classes each time
        rank = F.col("weight") if not turn else F.when(F.xxhash64("key", F.lit(turn)) % 2 == 0, F.col("weight")).otherwise(0.0)
        pivots = rows.groupBy("h").agg(F.max(F.struct(rank.alias("_o"), "key", "n", "label")).alias("_p"),
                                       F.count_distinct("label").alias("_m")).where("_m > 1").select("h", "_p")
        pairs = (rows.join(pivots, "h").where(F.col("label") != F.col("_p.label"))
                 .where(_fits(F.col("n"), F.col("_p.n")))
                 .select(F.col("_p.key").alias("a"), F.col("key").alias("b"), F.col("_p.n").alias("na"),
                         F.col("n").alias("nb")).distinct())
        labels = stored(components(labels, stored(linked(pairs, parts))))
    labels, rest = complements(_mixed(tokens, labels, "h"), parts, labels)
    rows = _mixed(rest, labels, "h")
    left, right = (rows.select("h", *[F.col(c).alias(s + c) for c in ("key", "n", "label", "left")]) for s in "lr")
    needed = F.ceil((F.col("ln") + F.col("rn")) * PERCENT / (100 + PERCENT))
    pairs = (left.join(right, "h").where((F.col("llabel") != F.col("rlabel")) & (F.col("lkey") < F.col("rkey")))
             .where(_fits(F.col("ln"), F.col("rn")) & (F.least("lleft", "rleft") >= needed)))
    return components(labels, stored(linked(_pair(pairs, "l", "r"), parts)))


def _pair(pairs: DataFrame, left: str, right: str) -> DataFrame:
    return pairs.select(F.col(left + "key").alias("a"), F.col(right + "key").alias("b"), F.col(left + "n").alias("na"),
                        F.col(right + "n").alias("nb")).distinct()


def _mixed(rows: DataFrame, labels: DataFrame, *by: str) -> DataFrame:
    """``rows`` with their labels, of the groups that hold more than one label."""
    rows = rows.join(labels, "key")
    several = rows.groupBy(*by).agg((F.min("label") < F.max("label")).alias("_m")).where("_m").select(*by)
    return stored(rows.join(several, list(by)))


def complements(rows: DataFrame, parts: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, rest): the links of near copies, found by what they lack and what they have beside it.

    Near copies share most of their shingles, so prefixes say little about which of them link. All classes of a prefix
    shingle get one pivot; the shingles that most classes near the pivot hold are its core V. With T = class minus V and V
    minus class, two classes differ by at most the sum of their |T|, and by |T_A| + |T_B| - 2 |T_A and T_B| exactly. They
    link if they differ by at most a ninth of their sizes' sum (at 80 %; written with g = |T| - size / 9). So

    * classes whose g sum to 0 or less link by count alone: the class with the least g links with all that link with any;
    * others must share (g_A + g_B) / 2 elements of T, which are rare, as most near copies agree with V. They are joined
      by these, rarest first, each class with one representative per element, then all that are left;
    * a class with |T| above 7/8 of its size links with none whose |T| is at most half of its size.

    Classes near V (|T| at most half of their size) are done; ``rest`` has the others."""
    pivots = rows.groupBy("h").agg(F.max(F.struct("weight", "key", "n")).alias("_p")).select(
        "h", F.col("_p.key").alias("pivot"), F.col("_p.n").alias("_np"))
    rows = stored(rows.drop("label").join(pivots, "h"))
    balls = stored(rows.groupBy("pivot", "key").agg(*[F.first(c).alias(c) for c in ("n", "k", "_np")]))
    theirs = parts.select(F.col("key").alias("pivot"), "part", F.col("hs").alias("_hs"))
    close = (balls.join(parts, "key").join(theirs, ["pivot", "part"]).groupBy("pivot", "key")
             .agg(F.sum(F.size(F.array_intersect("hs", "_hs"))).alias("_o"), F.first(F.col("n") + F.col("_np")).alias("_n"))
             .where("3 * _o >= _n").select("pivot", "key"))
    close = stored(close)
    members = close.groupBy("pivot").agg(F.count("*").alias("_m"))
    held = close.join(parts, "key").select("pivot", "part", F.explode("hs").alias("_h")).groupBy("pivot", "part", "_h").count()
    core = held.join(members, "pivot").where("2 * count > _m").groupBy("pivot", "part").agg(F.collect_list("_h").alias("_v"))
    v = F.coalesce("_v", F.array().cast("array<bigint>"))
    apart = F.concat(F.array_except("hs", v), F.array_except(v, "hs"))
    around = (balls.join(parts, "key").join(stored(core), ["pivot", "part"], "left").groupBy("pivot", "key")
              .agg(F.first("n").alias("n"), F.first("k").alias("k"), F.flatten(F.collect_list(apart)).alias("d"))
              .withColumn("t", F.size("d") + F.col("n") - F.col("k")).where("8 * t <= 7 * n")
              .select("pivot", "key", "n", "d", (9 * F.col("t") - F.col("n")).alias("g"), (2 * F.col("t") <= F.col("n")).alias("near")))
    around = stored(around)
    least = stored(around.groupBy("pivot").agg(F.min(F.struct("g", "key")).alias("_l")))
    alone = around.join(least, "pivot").where("g + _l.g <= 0 AND key <> _l.key").select(F.col("_l.key").alias("a"), F.col("key").alias("b"))
    labels = stored(components(labels, alone))

    single = around.select("pivot", "key", "n", "g", "near", F.explode("d").alias("e"))
    shared_by = single.groupBy("pivot", "e").agg(F.count("*").alias("_c")).where("_c > 1")
    lists = (single.join(shared_by, ["pivot", "e"]).groupBy("pivot", "key", "n", "g", "near")
             .agg(F.array_sort(F.collect_list(F.struct("_c", "e"))).alias("_s")).join(least, "pivot"))
    shares = lambda g: F.greatest(F.lit(1), F.ceil(g / 18))
    elements = (lists.select("pivot", "key", "n", "g", "near", F.col("_l.g").alias("_g"), F.size("_s").alias("_k"),
                             F.posexplode("_s").alias("_at", "_e"))
                .select("pivot", F.col("_e.e").alias("e"), "key", "n", "g", "near", "_g", (F.col("_k") - F.col("_at")).alias("left"))
                .where(F.col("left") >= shares(F.col("g") + F.col("_g"))).drop("_g"))
    elements = stored(elements)

    def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
        needed = shares(F.col("lg") + F.col("rg"))
        return left.join(right, ["pivot", "e"]).where(
            (F.col("llabel") != F.col("rlabel")) & (F.col("lnear") | F.col("rnear")) & _fits(F.col("ln"), F.col("rn"))
            & (F.least("lleft", "rleft") >= needed))
    columns = ("key", "n", "g", "near", "left", "label")
    for _ in range(COMPLEMENT_ROUNDS):
        found = _mixed(elements, labels, "pivot", "e")
        one = found.groupBy("pivot", "e").agg(F.min(F.struct("g", *[c for c in columns if c != "g"])).alias("_r"))
        one = one.select("pivot", "e", *[F.col(f"_r.{c}").alias("l" + c) for c in columns])
        others = found.select("pivot", "e", *[F.col(c).alias("r" + c) for c in columns])
        labels = stored(components(labels, stored(linked(_pair(candidates(one, others), "l", "r"), parts))))
    found = _mixed(elements, labels, "pivot", "e")
    left, right = (found.select("pivot", "e", *[F.col(c).alias(s + c) for c in columns]) for s in "lr")
    pairs = candidates(left, right).where("lkey < rkey")
    labels = stored(components(labels, stored(linked(_pair(pairs, "l", "r"), parts))))
    done = around.where("near").select("pivot", "key")
    return labels, stored(rows.join(done, ["pivot", "key"], "left_anti").select("h", "key", "n", "left"))


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_key) per row of ``docs``; equal ``class_key``: equal sets."""
    return _joined(docs).drop("text_hash", "group")


def _joined(docs: DataFrame) -> DataFrame:
    """``join`` with the text's hash and the ``group`` of linked classes."""
    named = stored(classes(docs))
    total = named.agg(F.sum("n_shingles")).first()[0] or 0
    found = stored(survivors(docs, named, total))
    labels = merged(found)
    ids = named.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("_id")).join(labels, "key", "left")
    ids = ids.withColumn("label", F.coalesce("label", "key"))
    least = ids.groupBy("label").agg(F.min("_id").alias("_component"))
    of_class = ids.join(least, "label").select(F.col("key").alias("_key"), "_component", "label")
    full = F.when(F.col("n_shingles") > 0, F.col("key"))
    return named.withColumn("key", full).join(of_class, F.col("key") == F.col("_key"), "left").select(
        "doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id"),
        F.col("key").alias("class_key"), "text_hash", F.col("label").alias("group"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, of each group of linked texts only the row with the smallest id (ties: by the text's hash; a null
    id only if the group has no other). Rows without a word stay."""
    rows = stored(_joined(docs).where(F.col("group").isNotNull()).groupBy("group", "doc_id", "text_hash").agg(
        F.count("*").alias("_n")))
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "text_hash")).alias("_f"))
    kept = F.col("doc_id").eqNullSafe(F.col("_f.doc_id")) & (F.col("text_hash") == F.col("_f.text_hash"))
    marked = stored(rows.join(first, "group").select("doc_id", "text_hash", "_n", kept.alias("_kept")))
    columns = [F.col(f"docs.`{c}`") for c in docs.columns]
    left = with_side(docs, small(marked.where("NOT _kept")), "left_anti")
    again = small(marked.where("_kept AND _n > 1"))
    single = with_side(left.select(*columns), again, "left_anti").select(*columns)
    place = F.row_number().over(Window.partitionBy("docs.doc_id", "side.text_hash").orderBy("docs.doc_id"))
    # a row of each that repeats: the columns are packed, so that none can clash with the place
    repeated = with_side(left.select(*columns), again, "inner").select(F.struct(*columns).alias("row"), place.alias("place"))
    return single.unionByName(repeated.where("place = 1").select("row.*"))
