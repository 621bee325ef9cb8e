"""Format-preserving Feistel pseudonyms for personal numbers and dates.

Personal values are found by pattern, validated (check digits, ranges, calendar), split into symbols of a radix each, and
permuted by a keyed Feistel network inside their format. The permutation depends on the key, the kind and the value only, so
equal values get equal pseudonyms in every document, and different values different ones. Separators, prefixes and check
digits stay valid: card numbers pass the Luhn test, dates stay dates, addresses stay addresses.

Only DataFrame functions are used. Texts without a candidate pass unchanged after one search. Nothing is shuffled.

Kinds in order of precedence: email (letters and digits of the local part), date (1900 to 2099; ISO, day first, or month
first where no day first date is meant), ssn, card, ip, phone. Every kind is searched on its own in what the kinds before it
left over, so a value that fails its validation stays and hides nothing:

* A card is any stretch of whole digit groups with 13 to 19 digits that passes the Luhn test, leftmost first, then longest.
* A phone number is a chain of groups with one separator other than blanks, else a whole run of groups, else three groups of
  3, 3 and 4 digits, else what follows a plus sign, the longest of up to 15 digits. It has 8 to 15 digits
  and not the shape of a date, ssn or address.
* A date with a month beyond twelve in second place is month first, and becomes such a date; it is linked with its like only.

Edge cases: null texts stay null and count nothing; empty texts stay empty; rows that repeat an id or a text get the same
pseudonyms; an empty table gives an empty table; extra columns are kept by ``pseudonymised``, also if their names clash: the
new column takes underscores until its name is free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptsieve.llm.secrets import occurrences

KEY = "pseudonyms"      # for trials only; give ``pseudonymised`` a secret of your own
ROUNDS = 8
DATE_WALKS = 12         # one in 55 steps leaves the calendar, so twelve in a row do so once in 1e20 dates
LATE_WALKS = 48         # two in five steps leave the days beyond the twelfth
CARD_DIGITS = 13, 19

# How the kinds are written.
_EDGE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_CODE, _GROUP = r"(?:\+[1-9][0-9]{0,2}[ .-]?)?", r"[0-9]{2,4}"
_FRESH = r"(?<![0-9A-Za-z+])"
PASSES = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}"),
    ("date", _EDGE + r"(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}" + _END),
    ("date", _EDGE + r"[0-9]{2}[./][0-9]{2}[./](?:19|20)[0-9]{2}" + _END),
    ("ssn", _EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END),
    ("card", _EDGE + r"[0-9][0-9 -]{11,}[0-9]" + _END),
    ("ip", r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"),
    ("phone", _FRESH + _CODE + rf"(?:{_GROUP}-{_GROUP}(?:-{_GROUP}){{1,5}}|{_GROUP}\.{_GROUP}(?:\.{_GROUP}){{1,5}})" + _END),
    ("phone", _FRESH + r"(?<!(?<![0-9A-Za-z])[0-9]{2,4}[ .-])" + _CODE
     + rf"\(?{_GROUP}\)?[ .-]{_GROUP}[ .-]{_GROUP}(?:[ .-]{_GROUP}){{0,4}}" + _END + rf"(?![ .-]{_GROUP}{_END})"),
    ("phone", _FRESH + _CODE + r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}" + _END),
    ("phone", _FRESH + r"\+[1-9](?:[ .-]?[0-9]){7,14}" + _END),
)
# Shapes of the other kinds, which are no phone numbers when their values aren't valid either.
_NO_PHONE = r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{1,3}(?:\.[0-9]{1,3}){3})$"
KINDS = tuple(dict.fromkeys(kind for kind, _ in PASSES))
_SPANS = "array<struct<start:int,end:int,value:string,kind:string,new:string>>"
_LIKELY = r"@|[0-9][0-9 ().+/-]{5,}[0-9]"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def feistel(symbols: Column, radices: Column, kind: str | Column, key: str = KEY, rounds: int = ROUNDS) -> Column:
    """``symbols``, each below its radix, permuted: halves take turns adding a digest of the other half, by symbol."""
    half = F.ceil(F.size(symbols) / 2).cast("int")

    def turn(state: Column, r: Column) -> Column:
        odd = r % 2 == 1
        fixed = F.when(odd, F.slice(state, 1, half)).otherwise(F.slice(state, half + 1, F.size(state) - half))
        seed = F.concat_ws(":", F.lit(key), kind if isinstance(kind, Column) else F.lit(kind), r, F.size(state), F.array_join(fixed.cast("array<string>"), "."))

        def moved(x: Column, i: Column) -> Column:
            pad = F.conv(F.substring(F.md5(F.concat_ws(":", seed, i)), 1, 12), 16, 10).cast("bigint")
            mine = F.when(odd, i >= half).otherwise(i < half)
            return F.when(mine, F.pmod(x + pad, F.get(radices, i))).otherwise(x)
        return F.transform(state, moved)
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), symbols.cast("array<bigint>"), turn)


def _digits(value: Column) -> Column:
    return F.transform(F.filter(F.split(value, ""), lambda c: c.rlike("[0-9]")), lambda c: c.cast("bigint"))


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second from the last but one doubled."""
    def term(x: Column, i: Column) -> Column:
        doubled = F.pmod(F.size(digits) - i, 2) == 0
        return F.when(doubled, 2 * x - F.when(x > 4, 9).otherwise(0)).otherwise(x)
    return F.aggregate(F.transform(digits, term), F.lit(0).cast("bigint"), lambda a, x: a + x)


def _refilled(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in order."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.rlike("[0-9]")
        return F.struct((acc["n"] + is_digit.cast("int")).alias("n"),
                        F.concat(acc["out"], F.when(is_digit, F.get(digits, acc["n"]).cast("string")).otherwise(c))
                        .alias("out"))
    return F.aggregate(chars, F.struct(F.lit(0).alias("n"), F.lit("").alias("out")), step, lambda a: a["out"])


def _tens(digits: Column) -> Column:
    return F.transform(digits, lambda _: F.lit(10).cast("bigint"))


def _card(value: Column, key: str) -> Column:
    def build(d: Column) -> Column:
        body = F.slice(d, 2, F.size(d) - 2)      # the first digit names the network, the last checks
        new = F.concat(F.slice(d, 1, 1), feistel(body, _tens(body), "card", key))
        check = _let(F.concat(new, F.array(F.lit(0).cast("bigint"))), lambda x: F.pmod(10 - luhn_sum(x) % 10, 10))
        valid = (luhn_sum(d) % 10 == 0) & F.exists(d, lambda x: x > 0)
        return F.when(valid, _refilled(value, F.concat(new, F.array(check))))
    return _let(_digits(value), build)


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.substring(value, a, n).cast("bigint") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = area - 1 - (area > 666).cast("bigint")
    radices = F.array(*[F.lit(r).cast("bigint") for r in (898, 99, 9999)])
    padded = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.when(valid, _let(feistel(F.array(index, group - 1, serial - 1), radices, "ssn", key), lambda s: F.concat_ws(
        "-", padded(F.get(s, 0) + 1 + (F.get(s, 0) >= 665).cast("bigint"), 3), padded(F.get(s, 1) + 1, 2),
        padded(F.get(s, 2) + 1, 4))))


def _ip(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, "\\."), lambda x: x.cast("bigint"))
    radices = F.transform(octets, lambda _: F.lit(256).cast("bigint"))
    valid = ~F.exists(octets, lambda x: x > 255)
    return F.when(valid, F.array_join(feistel(octets, radices, "ip", key).cast("array<string>"), "."))


def _phone(value: Column, key: str) -> Column:
    """All digits but a country code and leading zeros of groups' first digits are permuted."""
    code = F.regexp_extract(value, r"^\+[1-9][0-9]{0,2}(?=[ .(-])", 0)
    rest = F.substring(value, F.length(code) + 1, F.length(value))

    def build(d: Column) -> Column:
        n_all = F.size(d) + F.greatest(F.length(code) - 1, F.lit(0))
        # a first digit from 2 to 9 stays one, as North American numbers need it
        free = F.transform(d, lambda x, i: (x >= 2) & ((i == 0) | (i == 3)))
        radices = F.transform(free, lambda f: F.when(f, 8).otherwise(10).cast("bigint"))
        low = F.transform(free, lambda f: F.when(f, 2).otherwise(0).cast("bigint"))
        fixed = F.transform(d, lambda x, i: (x < 2) & ((i == 0) | (i == 3)))
        moving = F.zip_with(d, low, lambda x, y: x - y)
        radices = F.zip_with(radices, fixed, lambda r, f: F.when(f, 1).otherwise(r).cast("bigint"))
        base = F.transform(d, lambda x, i: F.when((x < 2) & ((i == 0) | (i == 3)), x)
                           .otherwise(F.when((i == 0) | (i == 3), 2).otherwise(0)).cast("bigint"))
        start = F.zip_with(moving, fixed, lambda x, f: F.when(f, 0).otherwise(x).cast("bigint"))
        out = F.zip_with(feistel(start, radices, "phone", key), base, lambda x, y: x + y)
        return F.when(n_all.between(8, 15) & ~value.rlike(_NO_PHONE), F.concat(code, _refilled(rest, out)))
    return _let(_digits(rest), build)


def _date(value: Column, key: str) -> Column:
    iso = value.rlike("^[0-9]{4}-")
    at = lambda a, b, n: F.when(iso, F.substring(value, a, n)).otherwise(F.substring(value, b, n)).cast("bigint")
    year, second = at(1, 7, 4), at(6, 4, 2)
    swapped = ~iso & (second > 12)
    month = F.when(swapped, at(9, 1, 2)).otherwise(second)
    day = F.when(swapped, second).otherwise(at(9, 1, 2))
    shown = lambda s: F.format_string("%04d-%02d-%02d", F.get(s, 0) + 1900, F.get(s, 1) + 1, F.get(s, 2) + 1)
    exists = lambda s: F.try_to_date(shown(s), "yyyy-MM-dd").isNotNull()
    radices = F.array(*[F.lit(r).cast("bigint") for r in (200, 12, 31)])
    symbols = F.array(year - 1900, month - 1, day - 1)
    valid = year.between(1900, 2099) & month.between(1, 12) & day.between(1, 31) & exists(symbols)
    state = F.struct(F.lit(False).alias("done"), symbols.alias("s"))

    def walk(acc: Column, _: Column) -> Column:
        def moved(s: Column) -> Column:
            done = exists(s) & (~swapped | (F.get(s, 2) >= 12))
            return F.struct(F.coalesce(done, F.lit(False)).alias("done"), s.alias("s"))
        kind = F.when(swapped, "late date").otherwise("date")
        return F.when(acc["done"], acc).otherwise(_let(feistel(acc["s"], radices, kind, key), moved))

    def written(s: Column) -> Column:
        sep = F.substring(value, 3, 1), F.substring(value, 6, 1)
        days, months = F.format_string("%02d", F.get(s, 2) + 1), F.format_string("%02d", F.get(s, 1) + 1)
        first, then = F.when(swapped, months).otherwise(days), F.when(swapped, days).otherwise(months)
        late = F.concat(first, sep[0], then, sep[1], F.format_string("%04d", F.get(s, 0) + 1900))
        return F.when(iso, shown(s)).otherwise(late)
    walks = F.sequence(F.lit(1), F.when(swapped, LATE_WALKS).otherwise(DATE_WALKS))
    return F.when(valid, _let(F.aggregate(walks, state, walk, lambda a: a["s"]), written))


def _email(value: Column, key: str) -> Column:
    """Letters and digits of the local part keep their class and case; the domain stays."""
    local = F.regexp_extract(value, "^[^@]+", 0)
    chars = F.filter(F.split(local, ""), lambda c: c != "")
    first = lambda c: F.when(c.rlike("[0-9]"), 48).when(c.rlike("[A-Z]"), 65).when(c.rlike("[a-z]"), 97).otherwise(
        F.ascii(c)).cast("bigint")
    radix = lambda c: F.when(c.rlike("[0-9]"), 10).when(c.rlike("[A-Za-z]"), 26).otherwise(1).cast("bigint")
    symbols = F.transform(chars, lambda c: F.ascii(c).cast("bigint") - first(c))
    moved = feistel(symbols, F.transform(chars, radix), "email", key)
    new = F.array_join(F.zip_with(moved, chars, lambda s, c: F.char(s + first(c))), "")
    return F.concat(new, F.substring(value, F.length(local) + 1, F.length(value)))


_MAKE = {"email": _email, "date": _date, "ssn": _ssn, "card": _card, "ip": _ip, "phone": _phone}


def _span(start: Column, value: Column, kind: str, new: Column) -> Column:
    return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"),
                    F.lit(kind).alias("kind"), new.alias("new"))


def _card_groups(run: Column) -> Column:
    """The run with its digit groups and, per group, how many groups from it on make a card: the most that do, or null."""
    groups = run["groups"]
    least, most = CARD_DIGITS

    def longest(group: Column, i: Column) -> Column:
        def is_card(n: Column) -> Column:
            digits = F.array_join(F.slice(groups, i + 1, n), "")
            return (F.length(digits).between(least, most) & ~F.array_contains(F.slice(groups, i + 1, n), "")
                    & digits.rlike("[1-9]") & F.call_function("luhn_check", digits))
        return F.get(F.filter(F.sequence(F.least(F.lit(most), F.size(groups) - i), F.lit(1), F.lit(-1)), is_card), 0)
    return F.struct(run["start"].alias("start"), run["value"].alias("value"), groups.alias("groups"),
                    F.transform(groups, longest).alias("n"))


def _cards(run: Column) -> Column:
    """(start, value) of the cards of a run that don't overlap, from left to right."""
    empty = F.array().cast("array<struct<start:int,value:string>>")
    state = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.lit(0).alias("free"), empty.alias("out"))

    def step(s: Column, x: Column) -> Column:
        taken = x["n"].isNotNull() & (s["at"] >= s["free"])
        size = F.length(F.array_join(F.slice(run["groups"], s["i"] + 1, x["n"]), " "))
        card = F.struct((run["start"] + s["at"]).alias("start"), F.substr(run["value"], s["at"] + 1, size).alias("value"))
        return F.struct((s["i"] + 1).alias("i"), (s["at"] + F.length(x["groups"]) + 1).alias("at"),
                        F.when(taken, s["at"] + size).otherwise(s["free"]).alias("free"),
                        F.when(taken, F.concat(s["out"], F.array(card))).otherwise(s["out"]).alias("out"))
    return F.aggregate(F.arrays_zip(run["groups"].alias("groups"), run["n"].alias("n")), state, step, lambda s: s["out"])


def _with_spans(rows: DataFrame, key: str, left: str, spans: str) -> DataFrame:
    """``rows`` with arrays of the valid values of every pass, ``spans`` and a number each. ``left`` holds the text, of
    which a pass hides what it finds from the next. Every step is a projection of its own, so none is evaluated twice."""
    none = F.array().cast(_SPANS)
    for k, (kind, pattern) in enumerate(PASSES):
        found = f"{spans}{k}"
        rows = rows.withColumn(found, F.when(F.col(left).rlike(pattern), occurrences(F.col(left), pattern)))
        if kind == "card":
            rows = rows.withColumn(found, F.transform(found, lambda x: F.struct(
                x["start"].alias("start"), x["value"].alias("value"), F.split(x["value"], "[ -]").alias("groups"))))
            rows = rows.withColumn(found, F.transform(found, _card_groups))
            rows = rows.withColumn(found, F.flatten(F.transform(found, _cards)))
        judged = F.transform(found, lambda x: _span(x["start"], x["value"], kind, _MAKE[kind](x["value"], key)))  # noqa: B023
        valid = F.filter(judged, lambda x: x["new"].isNotNull()).cast(_SPANS)
        rows = rows.withColumn(found, F.coalesce(valid, none))
        if k + 1 < len(PASSES):
            hidden = replaced(F.col(left), F.col(found), lambda x: F.repeat(F.lit("x"), x["end"] - x["start"]))
            rows = rows.withColumn(left, F.when(F.size(found) > 0, hidden).otherwise(F.col(left)))
    return rows


def replaced(text: Column, spans: Column, by=lambda x: x["new"]) -> Column:
    """``text`` with the spans' values replaced; pieces between them are joined once."""
    gap = lambda x, i: F.substring(
        text, F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0) + 1,
        x["start"] - F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0))
    pieces = F.transform(spans, lambda x, i: F.concat(gap(x, i), by(x)))
    return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(spans, -1)["end"] + 1, F.length(text)))


def pseudonymised(docs: DataFrame, key: str = KEY, column: str = "pseudonyms") -> DataFrame:
    """The rows of ``docs`` with new text and ``column``, an array of (start, end, value, kind, new). ``key`` should be a
    secret: whoever knows it can turn pseudonyms back."""
    taken = {c.lower() for c in docs.columns}
    while column.lower() in taken:
        column += "_"
    mine = "_"
    while any(c.startswith(mine) for c in taken | {column.lower()}):
        mine += "_"
    rows = docs.withColumn(f"{mine}left", F.when(F.col("text").rlike(_LIKELY), F.col("text")))
    rows = _with_spans(rows, key, f"{mine}left", f"{mine}spans")
    spans = F.array_sort(F.concat(*[F.col(f"{mine}spans{k}") for k in range(len(PASSES))]))
    rows = rows.select(*[F.col(f"`{c}`") for c in docs.columns], spans.alias(column))
    spans = F.col(f"`{column}`")
    return rows.withColumn("text", F.when(F.size(spans) > 0, replaced(F.col("text"), spans)).otherwise(F.col("text")))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_<kind> per kind, spans, text): ``spans`` lists kind:start:end of the original text."""
    def counted(kind: str) -> Column:
        return F.size(F.filter("pseudonyms.kind", lambda k: k == kind)).cast("bigint").alias(f"n_{kind}")
    listed = F.array_join(F.transform("pseudonyms", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return pseudonymised(docs.select("doc_id", "text")).select("doc_id", *[counted(k) for k in KINDS],
                                                               listed.alias("spans"), "text")
