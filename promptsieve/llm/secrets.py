"""Secret scans with a randomness test battery.

Three fixed patterns give the base spans. The battery adds runs of an encoding's alphabet that look like random keys: for
every run long enough, an encoding is inferred and three tests ask whether its symbols are uniform draws: chi-squared
against a flat alphabet, runs above and below the middle, and serial correlation of neighbours. The largest deviate of the
three counts (as one of three tries). What is not random is rejected with the false-discovery rate controlled, separately
for each length class, because long runs give far sharper tests than short ones; what isn't rejected is a secret.

Only DataFrame functions are used. The correction needs counts of p-value classes per length class, at most CLASSES times
LENGTHS rows.

Edge cases: a null text is empty; empty texts have no spans and the digest of the empty string; rows that repeat an id are
scanned each; an empty table gives an empty table; extra columns are ignored. Positions count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptsieve.llm.common import cut, small, with_side

# The base patterns, their kinds in order and their least lengths.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "random")

RUN = "[A-Za-z0-9+/_-]{20,}"    # candidates of the battery
RATE = 0.01                     # of random runs that may be rejected, per length class
CLASSES = 64                    # classes of deviates, four per unit
LENGTHS = 8                     # length classes, powers of two from 16
MARK = "[SECRET]"
_SPAN = "array<struct<start:int,end:int,value:string,part:string>>"


def occurrences(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, value, part) of the leftmost non-overlapping matches; ``part`` is the pattern's group.

    The text before each match is extracted with it, so that lengths sum up to positions.
    """
    pieces = [F.regexp_extract_all(text, F.lit(f"\\G(?s)(.*?)({pattern})"), F.lit(g)) for g in (1, 2, 2 + group)]

    def step(found: Column, x: Column) -> Column:
        start = F.when(F.size(found) > 0, F.element_at(found, -1)["end"]).otherwise(0) + F.length(x["0"])
        return F.concat(found, F.array(F.struct(start.alias("start"), (start + F.length(x["1"])).alias("end"),
                                                x["1"].alias("value"), x["2"].alias("part"))))
    return F.aggregate(F.arrays_zip(*pieces), F.array().cast(_SPAN), step)


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each base kind. A cheap search first, as most texts have none."""
    none = F.array().cast(_SPAN)
    assign = F.filter(occurrences(text, ASSIGN, 2), lambda x: F.length(x["part"]) >= MIN_ASSIGN)
    access = F.filter(occurrences(text, ACCESS), lambda x: F.length(x["value"]) >= MIN_ACCESS)
    runs = F.filter(occurrences(text, f"[0-9a-f]{{{MIN_HEX},}}"), lambda x: F.length(x["value"]) >= MIN_HEX)
    return {"assign": F.when(text.rlike(ASSIGN), assign).otherwise(none),
            "access": F.when(F.contains(text, F.lit("AKIA")), access).otherwise(none),
            "hex": F.when(text.rlike(f"[0-9a-f]{{{MIN_HEX}}}"), runs).otherwise(none)}


def encoding(run: Column) -> Column:
    """Symbols of the inferred alphabet, in order; null when the run is no key of a known encoding.

    A run must hold digits, and letters of one case (hexadecimal, base 32 or base 36) or of both (base 62 and 64).
    """
    digit, lower, upper = run.rlike("[0-9]"), run.rlike("[a-z]"), run.rlike("[A-Z]")
    digits, az = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    return (F.when(run.rlike("^[0-9a-f]+$") & digit & lower, digits + az[:6])
            .when(run.rlike("^[0-9A-F]+$") & digit & upper, digits + az[:6].upper())
            .when(run.rlike("^[A-Z2-7]+$") & digit & upper, az.upper() + "234567")
            .when(run.rlike("^[a-z0-9]+$") & digit & lower, digits + az)
            .when(run.rlike("^[A-Z0-9]+$") & digit & upper, digits + az.upper())
            .when(run.rlike("^[A-Za-z0-9]+$") & digit & lower & upper, az.upper() + az + digits)
            .when(digit & lower & upper & run.rlike("^[A-Za-z0-9+/]+$"), az.upper() + az + digits + "+/")
            .when(digit & lower & upper & run.rlike("^[A-Za-z0-9_-]+$"), az.upper() + az + digits + "-_"))


def deviates(rows: DataFrame) -> DataFrame:
    """Adds ``z``: the largest deviate of the three tests of ``value`` over ``alphabet``."""
    def total(array: Column, term) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda a, x: a + term(x))

    def neighbours(array: Column, term) -> Column:
        return total(F.zip_with(F.slice(array, 2, 1 << 30), F.slice(array, 1, F.size(array) - 1), term), lambda x: x)

    symbols = F.filter(F.split("value", ""), lambda c: c != "")
    codes = F.transform(symbols, lambda c: F.position(c, F.col("alphabet")).cast("double"))
    rows = rows.withColumns({"_c": codes, "_k": F.length("alphabet").cast("double")})
    c, n, k = F.col("_c"), F.size("_c").cast("double"), F.col("_k")
    square = total(F.array_distinct(c), lambda d: F.pow(F.size(F.filter(c, lambda x: x == d)).cast("double"), 2))
    chi, free = square * k / n - n, k - 1
    z_chi = F.abs((F.cbrt(chi / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))     # Wilson and Hilferty
    middle = (k + 1) / 2
    is_high = F.transform(c, lambda x: (x > middle).cast("double"))
    rows = rows.withColumns({"_chi": z_chi, "_high": is_high})
    high = total(F.col("_high"), lambda x: x)
    both = 2 * high * (n - high)
    runs = 1 + neighbours(F.col("_high"), lambda a, b: (a != b).cast("double"))
    var = both * (both - n) / (n * n * (n - 1))
    z_runs = F.when(var > 0, F.abs(runs - 1 - both / n) / F.sqrt(var)).otherwise(F.sqrt(n))
    spread = total(c, lambda x: F.pow(x - middle, 2))
    lagged = neighbours(c, lambda a, b: (a - middle) * (b - middle))
    z_serial = F.when(spread > 0, F.abs(lagged) / spread * F.sqrt(n)).otherwise(F.sqrt(n))
    return rows.withColumn("z", F.greatest("_chi", z_runs, z_serial)).drop("_c", "_k", "_chi", "_high")


def tail(z: Column) -> Column:
    """Upper tail of the normal law, two-sided and for the largest of three tries, by Abramowitz and Stegun 26.2.17."""
    x = F.greatest(z, F.lit(0.0))
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 6 * F.exp(-x * x / 2) * 0.3989422804014327 * poly)


def rejections(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """(length, cut): in each length class, deviates of class ``cut`` and above are not random.

    Benjamini and Hochberg over classes of deviates: the class of smallest deviates whose tail is at most ``rate`` times
    the share of runs at or above it.
    """
    per = tested.groupBy("length", "step").agg(F.count("*").alias("n"))
    falling = Window.partitionBy("length").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    above = per.withColumns({"_above": F.sum("n").over(falling), "_all": F.sum("n").over(Window.partitionBy("length"))})
    passing = above.where(tail(F.col("step") / 4.0) <= rate * F.col("_above") / F.col("_all"))
    return passing.groupBy("length").agg(F.min("step").alias("cut"))


def random_runs(rows: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, _h, _added): the runs that no test rejects, per document."""
    each = rows.where(F.size("_runs") > 0).select("doc_id", "_h", F.inline("_runs"))
    each = each.withColumn("alphabet", encoding(F.col("value"))).where("alphabet IS NOT NULL")
    length = F.least(F.floor(F.log2(F.length("value").cast("double"))) - 4, F.lit(LENGTHS - 1))
    tested = cut(deviates(each).select("doc_id", "_h", "start", "end", length.alias("length"),
                                       F.least(F.floor(F.col("z") * 4), F.lit(CLASSES)).alias("step")))
    cuts = F.broadcast(rejections(tested, rate))     # one row per length class
    kept = tested.join(cuts, "length", "left").where("cut IS NULL OR step < cut")
    return kept.groupBy("doc_id", "_h").agg(F.collect_set(_entry(F.col("start"), "random", F.col("end"))).alias("_added"))


def _entry(start: Column, kind: str, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"),
                    end.alias("end"))


def _entry_of(kind: str):
    return lambda x: _entry(x["start"], kind, x["end"])


def _is(kind: str):
    return lambda x: x == kind


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, _h, _base, _spans) per row: the text's hash, its base spans, and all spans, each as (start, rank, kind,
    end) in order. A run that touches a base span isn't tested."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    found = base_spans(F.col("_text"))
    base = F.array_sort(F.concat(*[F.transform(found[k], _entry_of(k)) for k in KINDS[:3]]))
    rows = rows.withColumn("_base", base)
    runs = F.filter(occurrences(F.col("_text"), RUN), lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]")
                    & ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    rows = cut(rows.select("doc_id", F.xxhash64("_text").alias("_h"), "_base",
                           F.when(F.col("_text").rlike(RUN), runs).otherwise(F.array().cast(_SPAN)).alias("_runs")))
    added = small(cut(random_runs(rows, rate).withColumnsRenamed({"doc_id": "__id", "_h": "__g"})))
    both = rows.join(added, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("_h") == F.col("__g")), "left")
    spans = F.when(F.col("_added").isNull(), F.col("_base")).otherwise(
        F.array_sort(F.concat("_base", F.col("_added").cast("array<struct<start:int,rank:int,kind:string,end:int>>"))))
    return both.select("doc_id", "_h", "_base", spans.alias("_spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    counts = [F.size(F.filter("_base.kind", _is(k))).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]]
    return scan(docs).select("doc_id", *counts, F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"),
                             _listed(F.col("_spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a mark in place of every span; overlapping spans get one mark."""
    spans = scan(docs).where(F.size("_spans") > 0).select("doc_id", F.col("_h").alias("text_hash"), "_spans").distinct()
    text = F.col("docs.text")

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        new = F.when(x["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(MARK))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), new.alias("out"))
    clean = F.aggregate("side._spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    new = F.when(F.col("side.text_hash").isNull(), text).otherwise(clean)
    return with_side(docs, small(cut(spans)), "left").select(
        *[new.alias(c) if c == "text" else F.col(f"docs.`{c}`") for c in docs.columns])
