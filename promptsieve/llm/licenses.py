"""License scans by ordered signature rules.

A rule is a regular expression with a label, a priority and a score. Rules are written per license family from a few
templates (identifier tag, grant sentence, name, address) plus sentences of the licenses' own texts. A text is tried with a
rule only if it holds one of the rule's keywords, and with any at all only if it passes a general gate; both are derived from
the rules' patterns, so that they change no detection. A detection that lies inside another of higher priority, or of equal
priority and greater length, is suppressed.

Only DataFrame functions are used. Texts without a keyword are scanned once and not kept; the others' detections are
resolved by one window per document, so many detections in one text stay n log n.

Edge cases: null texts are empty; texts without words have no places and null first and last words; rows that repeat an id
are scanned each; an empty table gives an empty table; extra columns are ignored. Only A-Z have upper case here.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptsieve.llm.common import cut, small
from promptsieve.llm.secrets import occurrences

SEP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"          # in a text in lower case
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Families: label, name as a pattern, whether versions belong to the label, address.
FAMILIES = (
    ("mit", "mit|expat", False, "opensource.org/licenses/mit"),
    ("apache", "apache(?: software)?", True, "apache.org/licenses"),
    ("gpl", "(?:gnu )?(?:general public|gpl)", True, "gnu.org/licenses/gpl"),
    ("gpl", "gnu gpl|gpl", True, "gnu.org/copyleft/gpl"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public", True, "gnu.org/licenses/lgpl"),
    ("lgpl", "(?:gnu )?lgpl", True, "gnu.org/copyleft/lesser"),
    ("agpl", "(?:gnu )?affero general public", True, "gnu.org/licenses/agpl"),
    ("agpl", "(?:gnu )?agpl", True, "spdx.org/licenses/agpl"),
    ("gfdl", "(?:gnu )?free documentation", True, "gnu.org/licenses/fdl"),
    ("bsd", "(?:new |modified |simplified |revised )?bsd(?:[- ][0-4][- ]clause)?|[0-4][- ]clause bsd", False,
     "opensource.org/licenses/bsd"),
    ("mpl", "mozilla public", True, "mozilla.org/mpl"),
    ("mpl", "mpl", True, "spdx.org/licenses/mpl"),
    ("epl", "eclipse public", True, "eclipse.org/legal/epl"),
    ("edl", "eclipse distribution", True, "eclipse.org/org/documents/edl"),
    ("cddl", "common development and distribution", True, "opensource.org/licenses/cddl"),
    ("cpl", "common public", True, "opensource.org/licenses/cpl"),
    ("isc", "isc", False, "opensource.org/licenses/isc"),
    ("zlib", "zlib(?:/libpng)?", False, "zlib.net/zlib_license"),
    ("unlicense", "unlicense", False, "unlicense.org"),
    ("cc0", "cc0", True, "creativecommons.org/publicdomain/zero"),
    ("cc-by", "creative commons attribution", True, "creativecommons.org/licenses/by/"),
    ("cc-by-sa", "creative commons attribution[- ]share[- ]?alike", True,
     "creativecommons.org/licenses/by-sa/"),
    ("cc-by-nc", "creative commons attribution[- ]non[- ]?commercial", True,
     "creativecommons.org/licenses/by-nc/"),
    ("cc-by-nd", "creative commons attribution[- ]no[- ]?deriv(?:ative)?s?(?: works)?", True,
     "creativecommons.org/licenses/by-nd/"),
    ("cc-by-nc-sa", "creative commons attribution[- ]non[- ]?commercial[- ]share[- ]?alike", True,
     "creativecommons.org/licenses/by-nc-sa/"),
    ("artistic", "(?:perl )?artistic", True, "opensource.org/licenses/artistic"),
    ("boost", "boost software", True, "boost.org/license"),
    ("wtfpl", "wtfpl", True, "wtfpl.net"),
    ("psf", "python(?: software foundation)?|psf", True, "docs.python.org/license"),
    ("openssl", "openssl", False, "openssl.org/source/license"),
    ("eupl", "european union public", True, "eupl.eu"),
    ("ofl", "(?:sil )?open font", True, "scripts.sil.org/ofl"),
    ("ms-pl", "microsoft public", False, "opensource.org/licenses/ms-pl"),
    ("ms-rl", "microsoft reciprocal", False, "opensource.org/licenses/ms-rl"),
    ("x11", "x11", False, "spdx.org/licenses/x11"),
    ("postgresql", "postgresql", False, "postgresql.org/about/licence"),
    ("ncsa", "(?:university of illinois/)?ncsa(?: open source)?", False, "opensource.org/licenses/ncsa"),
    ("vim", "vim", False, "spdx.org/licenses/vim"),
    ("ruby", "ruby", False, "ruby-lang.org/en/about/license"),
    ("php", "php", True, "php.net/license"),
    ("osl", "open software", True, "opensource.org/licenses/osl"),
    ("afl", "academic free", True, "opensource.org/licenses/afl"),
    ("ecl", "educational community", True, "opensource.org/licenses/ecl"),
    ("busl", "business source", True, "mariadb.com/bsl"),
    ("sspl", "server side public", True, "mongodb.com/licensing/server-side-public-license"),
    ("elastic", "elastic", True, "elastic.co/licensing/elastic-license"),
    ("odbl", "(?:odc )?open database", True, "opendatacommons.org/licenses/odbl"),
    ("odc-by", "open data commons attribution", True, "opendatacommons.org/licenses/by"),
)
_VERSION = r"(?:,?[ \n]*(?:version|v\.?)?[ \n]*([0-9](?:\.[0-9])?)(?:\.0)?(?![0-9.]?[0-9]))?"
GRANT = "(?:licensed|released|distributed|available|published|provided|covered)(?: to you)?[ \\n]+(?:under|by)[ \\n]+"
TEMPLATES = (   # priority, score, pattern over (label, name, address)
    (100, 1.0, "spdx-license-identifier:[ ]*{label}[a-z0-9.+-]*"),
    (80, 0.95, GRANT + "(?:the[ \\n]+)?(?:terms[ \\n]+of[ \\n]+)?(?:the[ \\n]+)?"
               "(?:{name})(?:[ \\n]+licen[cs]e)?{version}"),
    (60, 0.8, "(?:{name})[ \\n]+licen[cs]e{version}"),
    (60, 0.8, "licen[cs]e[ ]*[:=][ ]*[\"']?(?:{name}){version}"),
    (40, 0.7, "(?:https?://)?(?:www\\.)?{address}[a-z0-9./_-]*"),
)
TEXTS = (       # priority 90: sentences of the licenses themselves; label, pattern
    ("mit", "permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("bsd", "redistribution and use in source and binary forms, with or without modification"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "free software[;:,] you can redistribute it and/or modify it under the terms of the gnu general"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general"),
    ("agpl", "you can redistribute it and/or modify it under the terms of the gnu affero general"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with"),
    ("zlib", "provided 'as-is', without any express or implied warranty"),
    ("unlicense", "free and unencumbered software released into the public domain"),
    ("cc0", "dedicated to the public domain|public domain dedication"),
    ("boost", "to use, reproduce, display, distribute, execute, and transmit the software"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("epl", "accompanying materials are made available under the terms of the eclipse public"),
    ("postgresql", "permission to use, copy, modify, and distribute this software and its documentation for any"),
    ("proprietary", "all rights reserved"),
)


def literals(pattern: str) -> list[str]:
    """Strings of which every match of ``pattern`` holds one: the longest plain run of each alternative."""
    group = re.search(r"\(\?:([^()]*)\)(\??)", pattern)
    if group:
        inner = ["]["] if group[2] else group[1].split("|")     # "][" parts runs like a class
        return sorted({x for i in inner for x in literals(pattern[:group.start()] + i + pattern[group.end():])})
    runs = [re.split(r"\]\[|\[[^\]]*\][?*+]?|.\?", alternative) for alternative in pattern.split("|")]
    return sorted({max(r, key=len).replace("\\.", ".") for r in runs})


def general_gate(low: Column) -> Column:
    """Whether a text in lower case may match a rule: a grant's words, or a literal of any other rule."""
    words = {"licen"}       # of the templates with a name and "license"
    for _, keywords, priority, *_ in rules():
        if priority in (100, 90, 40):
            words |= {"spdx-license-identifier:"} if priority == 100 else set(keywords)
    passed = low.rlike(GRANT)
    for word in sorted(w for w in words if not any(x != w and x in w for x in words)):
        passed = F.contains(low, F.lit(word)) | passed
    return passed


def rules() -> list[tuple[str, list[str], int, float, bool, str]]:
    """(label, keywords, priority, score, is_versioned, pattern), several per family."""
    found = []
    for label, name, versioned, address in FAMILIES:
        for priority, score, pattern in TEMPLATES:
            body = pattern.replace("{label}", label).replace("{name}", name).replace(
                "{version}", _VERSION).replace("{address}", address.replace(".", r"\."))
            keywords = {100: ["spdx-license-identifier:"], 40: [address]}.get(priority) or literals(name)
            found.append((label, keywords, priority, score, versioned, f"(?<!{WORD}){body}(?!{WORD})"))
    for label, body in TEXTS:
        pattern = body.replace(" ", "[ \\n]+")
        found.append((label, literals(re.sub(r"\[[;:,]+\]", "][", pattern)), 90, 0.9, False, pattern))
    return found


def _base(text: Column) -> Column:
    """Places of the base phrases in a text in lower case."""
    phrases = "|".join(p.replace(" ", SEP + "+") for p in BASE)
    return occurrences(text, f"(?<!{WORD})(?:{phrases})(?!{WORD})")


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(ANY_WORD)).cast("bigint")


def detections(gated: DataFrame) -> DataFrame:
    """(_row, label, score) of the rules' detections that no other suppresses; ``gated`` has (_row, _low)."""
    listed = F.array(*[F.struct(*[(F.array(*[F.lit(x) for x in v]) if c == "keywords" else F.lit(v)).alias(c) for v, c in zip(
        rule, ("label", "keywords", "priority", "score", "versioned", "pattern"))]) for rule in rules()])
    tried = gated.withColumn("_r", F.explode(F.filter(
        listed, lambda r: F.exists(r["keywords"], lambda k: F.contains(F.col("_low"), k)))))
    spans = tried.where(F.rlike("_low", F.col("_r.pattern"))).select(
        "_row", "_r.label", "_r.priority", "_r.score", "_r.versioned",
        F.explode(_occurrences_of(F.col("_low"), F.col("_r.pattern"))).alias("_s"))
    version = F.regexp_extract(F.col("_s.value"), r"([0-9](?:\.[0-9])?)[^0-9]*$", 1)
    full = F.when(F.contains(version, F.lit(".")), version).otherwise(F.concat(version, F.lit(".0")))
    spans = spans.select("_row", "priority", "score", F.col("_s.start").alias("start"), F.col("_s.end").alias("end"),
                         F.when(F.col("versioned") & (version != ""), F.concat_ws("-", "label", full))
                         .otherwise(F.col("label")).alias("label")).distinct()
    upto = Window.partitionBy("_row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    above = F.lit(-1)
    for level in sorted({r[2] for r in rules()}):   # furthest end of a detection of higher priority that starts no later
        above = F.when(F.col("priority") == level,
                       F.max(F.when(F.col("priority") > level, F.col("end"))).over(upto)).otherwise(above)
    earlier = Window.partitionBy("_row", "priority").orderBy("start", F.desc("end"), "label").rowsBetween(
        Window.unboundedPreceding, -1)
    spans = spans.withColumns({"_above": above, "_peer": F.max(F.struct("end", -F.col("start"))).over(earlier)})
    peer_end, peer_start = F.col("_peer")["end"], -F.col("_peer")["col2"]
    covered = F.col("_above") >= F.col("end")
    inside = (peer_end > F.col("end")) | ((peer_end == F.col("end")) & (peer_start < F.col("start")))
    return spans.where(~F.coalesce(covered, F.lit(False)) & ~F.coalesce(inside, F.lit(False))).select(
        "_row", "label", "score")


def _occurrences_of(text: Column, pattern: Column) -> Column:
    """``occurrences`` with a pattern per row."""
    whole = F.concat(F.lit("\\G(?s)(.*?)("), pattern, F.lit(")"))
    pieces = [F.regexp_extract_all(text, whole, F.lit(g)) for g in (1, 2)]

    def step(found: Column, x: Column) -> Column:
        start = F.when(F.size(found) > 0, F.element_at(found, -1)["end"]).otherwise(0) + F.length(x["0"])
        return F.concat(found, F.array(F.struct(start.alias("start"), (start + F.length(x["1"])).alias("end"),
                                                x["1"].alias("value"))))
    return F.aggregate(F.arrays_zip(*pieces), F.array().cast("array<struct<start:int,end:int,value:string>>"), step)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row of ``docs``."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).withColumn("_low", F.lower("_text"))
    rows = rows.withColumn("_gated", F.when(general_gate(F.col("_low")), F.col("_low")))
    rows = cut(rows.select("doc_id", _words(F.col("_text")).alias("n_words"), F.col("_gated").alias("_low"),
                           F.when(F.contains("_gated", F.lit("license")), _base(F.col("_gated"))).alias("_places"))
               ).withColumn("_row", F.monotonically_increasing_id())
    word_at = lambda place: _words(F.substring("_low", 1, place["start"]))
    label = lambda x: F.element_at(F.create_map(*[F.lit(v) for k, lab in BASE.items() for v in (k, lab)]),
                                   F.regexp_replace(x["value"], SEP + "+", " "))
    facts = rows.select("_row", "doc_id", "n_words",
                        F.coalesce(F.size("_places"), F.lit(0)).cast("bigint").alias("_n"),
                        F.when(F.size("_places") > 0, word_at(F.get("_places", 0))).alias("first_word"),
                        F.when(F.size("_places") > 0, word_at(F.element_at("_places", -1))).alias("last_word"),
                        F.coalesce(F.array_distinct(F.transform("_places", label)),
                                   F.array().cast("array<string>")).alias("_base"))
    found = detections(rows.where("_low IS NOT NULL").select("_row", "_low")).groupBy("_row").agg(
        F.collect_set("label").alias("_own"), F.max("score").alias("_score"))
    found = small(cut(found))
    none = F.array().cast("array<string>")
    listed = lambda x: F.array_join(F.array_sort(x), ",")
    return facts.join(found, "_row", "left").select(
        "doc_id", "n_words", F.greatest("_n", F.lit(0)).alias("n_base"), "first_word", "last_word",
        listed(F.col("_base")).alias("base_labels"),
        listed(F.array_union("_base", F.coalesce("_own", none))).alias("labels"),
        F.coalesce("_score", F.when(F.size("_base") > 0, 0.5), F.lit(0.0)).alias("score"))
