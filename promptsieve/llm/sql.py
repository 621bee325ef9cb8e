"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

from promptsieve.llm import mixing, phrases, quality, warc

WORD = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""WITH base AS (SELECT rowid AS r, doc_id, source, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
        FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
    grams AS (SELECT r, i, list_slice(w, i, i + {quality.WINDOW - 1}) AS g FROM (SELECT r, w,
        unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i FROM base WHERE len(w) >= {quality.WINDOW})),
    twice AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
    reps AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range({quality.WINDOW}) t(k) GROUP BY r),
    lines AS (SELECT r, source, ('0x' || substr(md5(lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')))), 1, 15))::BIGINT AS h,
        len(regexp_extract_all(x, '{WORD}')) AS n FROM (SELECT r, source, unnest(l) AS x FROM base)),
    named AS (SELECT source, h, d FROM lines JOIN (SELECT r, list_sort(list(DISTINCT h)) AS d FROM lines GROUP BY r) USING (r)),
    hosts AS (SELECT source, count(*) AS n FROM base GROUP BY source),
    common AS (SELECT c.source, c.h FROM (SELECT source, h, count(DISTINCT d) AS n FROM named GROUP BY source, h) c
        JOIN hosts ON hosts.source IS NOT DISTINCT FROM c.source
        WHERE c.n > greatest({quality.MAX_DOCUMENTS},
            least({quality.MAX_LIMIT}, floor(hosts.n * {quality.MAX_SHARE_PERCENT} / 100)))),
    gone AS (SELECT r, sum(n) AS n FROM lines JOIN common ON common.source IS NOT DISTINCT FROM lines.source
        AND common.h = lines.h GROUP BY r),
    facts AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[{quality.SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(reps.n, 0)::BIGINT AS n_repeat_words,
        (len(w) - coalesce(gone.n, 0))::BIGINT AS n_left
        FROM base LEFT JOIN reps USING (r) LEFT JOIN gone USING (r)),
    failed AS (SELECT *, n_words < {quality.MIN_WORDS}
        OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM facts)
    SELECT *, NOT base_failed AND n_left >= {quality.MIN_WORDS}
        AND 100 * n_left >= {quality.MIN_LEFT_PERCENT} * n_words AS kept FROM failed"""

MIX = rf"""WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
        (('0x' || substr(md5(concat_ws(':', '{mixing.SEED}', doc_id)), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u
        FROM documents),
    placed AS (SELECT *, odds / (1 + odds) AS place FROM (SELECT *, u / (1 - u) / sqrt(greatest(size, 1)) AS odds
        FROM sized)),
    per AS (SELECT source, sum(size)::BIGINT AS s, {list(mixing.WEIGHTS)}[(row_number() OVER
        (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS w FROM sized GROUP BY source),
    levels AS (SELECT s, w, (sum(s) OVER () - {mixing.CAP} * (sum(s) OVER below - s)) / (sum(w) OVER () - sum(w) OVER below + w)
        AS level FROM per WINDOW below AS (ORDER BY s / w, source ROWS UNBOUNDED PRECEDING)),
    chosen AS (SELECT coalesce(max(level), 0) AS level FROM levels),
    goals AS (SELECT source, s, least((w * level)::DOUBLE, ({mixing.CAP} * s)::DOUBLE) AS target FROM per, chosen),
    plan AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s)::BIGINT ELSE 0 END AS whole FROM goals),
    run AS (SELECT doc_id, size, s AS source_size, target, whole, target - whole * s AS need, sum(size) OVER (
        PARTITION BY p.source ORDER BY place, size, doc_id ROWS UNBOUNDED PRECEDING) - size / 2 AS middle
        FROM placed p JOIN plan ON p.source IS NOT DISTINCT FROM plan.source)
    SELECT doc_id, size, source_size, target, size * (whole + (middle <= need)::INT) AS taken FROM run"""


PHRASES = rf"""WITH pieces AS (SELECT row_number() OVER () AS p, lang, w FROM (SELECT lang,
        regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, '{phrases.NO_LANG}') AS lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)) WHERE len(w) > 0),
    places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
    f AS (SELECT lang, array_to_string(g, ' ') AS phrase, len(g) AS m, count(*)::BIGINT AS a FROM (
        SELECT lang, list_slice(w, i, i + m - 1) AS g FROM places, range(1, {phrases.MAX_WORDS + 1}) t(m)
        WHERE i + m - 1 <= len(w)) GROUP BY lang, g HAVING count(*) >= {phrases.MIN_COUNT}),
    totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
    cuts AS (SELECT lang, phrase, m, a, k, string_split(phrase, ' ') AS w FROM f, range(1, {phrases.MAX_WORDS}) t(k)
        WHERE k < m),
    valued AS (SELECT c.*, x.a AS l, y.a AS r, n, (1000::HUGEINT * c.a * n // (x.a::HUGEINT * y.a))::BIGINT AS score FROM cuts c
        JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.w, 1, k), ' ')
        JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.w, k + 1, c.m), ' ')
        JOIN totals ON totals.lang = c.lang),
    weakest AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inner_parts AS (SELECT lang, array_to_string(list_slice(string_split(phrase, ' '), i, i + s - 1), ' ') AS phrase,
        max(a) AS longer FROM f, range(1, {phrases.MAX_WORDS}) t(s), range(1, {phrases.MAX_WORDS + 1}) u(i)
        WHERE s < m AND i + s - 1 <= m GROUP BY ALL)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM weakest LEFT JOIN inner_parts p USING (lang, phrase) WHERE coalesce(100 * longer < 100 * a, true)
    QUALIFY rank <= {phrases.TOP}"""


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _decoded(x: str) -> str:
    for name, plain in warc.ENTITIES:
        x = f"replace({x}, {_lit(name)}, {_lit(plain)})"
    return x


def _uuid(*parts: str) -> str:
    h = f"md5(concat_ws('|', {', '.join(parts)}))"
    cuts = ", ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || concat_ws('-', {cuts}) || '>'"


def _warc() -> str:
    sub = lambda x, pattern, by: f"regexp_replace({x}, {_lit(pattern)}, {by}, 'g')"
    flat = sub(sub("seen", r"\s+", "' '"), warc.BLOCKS, "chr(10)")
    lines = sub(sub(_decoded(sub(flat, "(?s)<[^>]*>", "''")), r"[ \t]+", "' '"), r" ?\n[ \n]*", "chr(10)")
    text = sub(lines, r"^[ \n]+|[ \n]+$", "''")
    line = "chr(13) || chr(10)"
    return f"""WITH pages2 AS (SELECT page_id, coalesce(url, '') AS uri, coalesce(html, '') AS html FROM pages),
    seen AS (SELECT *, {sub('html', warc.HIDDEN, "' '")} AS seen, {_uuid("'response'", 'uri', 'page_id::VARCHAR', 'md5(html)')}
        AS rid, 'sha1:' || sha1(html) AS digest,
        ['Content-Type: text/html; charset=utf-8', 'Content-Length: ' || strlen(html)] AS headers FROM pages2),
    facts AS (SELECT *, {text} AS body, list_transform(regexp_extract_all(seen, {_lit(warc.LINK)}, 1), lambda x: {_decoded('x')})
        AS links, trim({_decoded(sub(f"regexp_extract(html, {_lit(warc.TITLE)}, 1)", r"\s+", "' '"))}) AS title,
        regexp_extract(html, {_lit(warc.DESCRIPTION)}, 1) AS description FROM seen),
    records AS (SELECT page_id, uri, digest, links, 'response' AS type, rid AS record_id, NULL AS refers_to,
        'application/http; msgtype=response' AS content_type,
        'HTTP/1.1 200 OK' || {line} || array_to_string(headers, {line}) || {line} || {line} || html AS block FROM facts
        UNION ALL SELECT page_id, uri, digest, links, 'metadata', {_uuid("'metadata'", 'rid')}, rid, 'application/json',
        to_json({{uri: uri, status: 'HTTP/1.1 200 OK', headers: headers, title: title, description: description,
            links: links, payload_digest: digest}})::VARCHAR FROM facts
        UNION ALL SELECT page_id, uri, digest, links, 'conversion', {_uuid("'conversion'", 'rid')}, rid, 'text/plain', body
        FROM facts)
    SELECT page_id, type, record_id, refers_to, uri AS target_uri, content_type, digest AS payload_digest,
        'sha1:' || sha1(block) AS block_digest, len(links)::BIGINT AS n_links, strlen(block)::BIGINT AS n_bytes FROM records"""


def statements() -> dict[str, str]:
    return {"op3_warc_derivatives": _warc(), "op5_quality_rules": QUALITY, "op7_source_mixing": MIX,
            "op13_phrase_collocations": PHRASES}
