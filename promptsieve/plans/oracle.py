"""SQL statements that give the registered queries' results on DuckDB, for the correctness check only.

Statements are assembled from named sub-queries; constants (banks, tables, seeds) come from the library, logic does not.
"""

from __future__ import annotations

import re

from promptsieve.functions import codecs
from promptsieve.functions.text import WHITESPACE as WS
from promptsieve.labels import LABELS, SEED
from promptsieve.operators import generate as g
from promptsieve.operators import neardup, similarity, split, vocab
from promptsieve.operators.tfidf import CHAR_BLOCK, WORD_BLOCK
from promptsieve.plans import catalog, novel
from promptsieve.sources.results import MODEL_ORDER



def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def bank(items) -> str:
    return "[" + ", ".join(lit(x) for x in items) + "]"


def norm(x: str) -> str:
    return f"trim(regexp_replace(nfc_normalize(coalesce({x}, '')), '[{WS}]+', ' ', 'g'))"


def words(x: str) -> str:
    return rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{WS}]')"


def digest(salt: str, key: str, seed=SEED) -> str:
    return f"md5(concat_ws(':', '{seed}', '{salt}', {key}))"


def seed32(salt: str, key: str, seed=SEED) -> str:
    return f"CAST(('0x' || substr({digest(salt, key, seed)}, 1, 8))::UBIGINT AS BIGINT)"


def draw(salt: str, key: str, seed=SEED) -> str:
    return f"({seed32(salt, key, seed)}::DOUBLE / 4294967296)"


def choice(n: int, salt: str, key: str, seed=SEED) -> str:
    return f"CAST(floor({draw(salt, key, seed)} * {n}) AS INT)"


def pick(items, salt: str, key: str, seed=SEED) -> str:
    return f"list_extract({bank(items)}, {choice(len(items), salt, key, seed)} + 1)"


def step(base: str, i: str) -> str:
    return f"((({base} + ({i} - 1) * 2654435769) % 4294967296)::DOUBLE / 4294967296)"


def first_rows(rel: str, key: str, order: str, columns: str) -> str:
    return (f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn "
            f"FROM {rel}) WHERE rn = 1")


# ---- codecs

def per_char(text: str, body: str) -> str:
    return f"array_to_string(list_transform(string_split({text}, ''), lambda c, i: {body}), '')"


def codec_sql(name: str, t: str, s: str) -> str:
    pair = lambda p: f"translate({t}, {lit(p[0])}, {lit(p[1])})"
    if name == "base64":
        carrier = f"list_extract({bank(codecs.BASE64_CARRIERS)}, CAST(floor({s}::DOUBLE / 4294967296 * 3) AS INT) + 1)"
        return f"replace({carrier}, '{{x}}', base64(encode({t})))"
    if name == "rot13":
        return pair(codecs.letter_shift(13))
    if name == "caesar3":
        return pair(codecs.letter_shift(3))
    if name == "leetspeak":
        return pair(codecs.LEET)
    if name == "fullwidth":
        return pair(codecs.fullwidth_pair())
    if name == "char_spacing":
        return (f"array_to_string(list_transform(string_split({t}, ' '), lambda w, i: CASE WHEN length(w) > 3 AND "
                f"{step(s, 'i')} < 0.7 THEN array_to_string(string_split(w, ''), ' ') ELSE w END), ' ')")
    if name == "homoglyph":
        h = codecs.HOMOGLYPHS
        return per_char(t, f"CASE WHEN {step(s, 'i')} < 0.6 THEN translate(c, {lit(h[0])}, {lit(h[1])}) ELSE c END")
    if name == "zero_width":
        return per_char(t, rf"CASE WHEN regexp_matches(c, '^\p{{L}}$') AND {step(s, 'i')} < 0.35 "
                           rf"THEN c || chr(8203) ELSE c END")
    if name == "hex":
        return f"{lit(codecs.HEX_CARRIER)} || lower(hex(encode({t})))"
    if name == "reverse":
        return f"array_to_string(list_reverse(string_split({t}, '')), '')"
    if name == "pig_latin":
        core = r"regexp_replace(w, '[^\p{L}]', '', 'g')"
        return (f"array_to_string(list_transform(string_split({t}, ' '), lambda w: CASE WHEN "
                f"regexp_full_match({core}, '[A-Za-z]{{2,}}') THEN substr({core}, 2) || substr({core}, 1, 1) || 'ay' "
                f"ELSE w END), ' ')")
    if name == "reversed_words":
        return f"array_to_string(list_reverse(string_split({t}, ' ')), ' ')"
    raise KeyError(name)


def codec_case(names, index: str, t: str, s: str) -> tuple[str, str]:
    order = sorted(names)
    name = "CASE " + index + " " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(order)) + " END"
    text = "CASE " + index + " " + " ".join(f"WHEN {i} THEN {codec_sql(n, t, s)}" for i, n in enumerate(order)) + " END"
    return name, text


# ---- generators

def framed_sql(kind: str, key: str, text: str, seed=SEED) -> str:
    parts = rf"list_filter(list_transform(regexp_split_to_array({text}, '[.!?\n]+'), lambda s: trim(s)), lambda s: s <> '')"
    piece = lambda s: (f"coalesce(list_extract({parts}, CAST(floor({draw(f'{kind}_{s}', key, seed)} * len({parts})) AS INT)"
                       " + 1), '')")
    frame = pick(g.FRAMES[kind], f"frame_{kind}", key, seed)
    return f"replace(replace({frame}, '{{a}}', {piece('a')}), '{{b}}', {piece('b')})"


def generated(tries: str, recipe, n: int | None) -> str:
    """Select of (row_id, text, label, source) with distinct lower-cased texts."""
    kind, _, label, source = recipe
    if kind == "obfuscation":
        name, text = codec_case(codecs.HELDOUT_CODECS, "h", "t", "cs")
        base = (f"CASE WHEN {draw('base', 'row_id')} < 0.5 THEN {framed_sql('injection', 'row_id', 'text')} "
                f"ELSE {framed_sql('jailbreak', 'row_id', 'text')} END")
        made = (f"SELECT row_id, {norm(text)} AS text, 'obfuscated:' || {name} AS source FROM (SELECT row_id, "
                f"{base} AS t, {choice(len(codecs.HELDOUT_CODECS), 'heldout', 'row_id')} AS h, "
                f"{seed32('codec', 'row_id')} AS cs FROM {tries})")
    else:
        made = f"SELECT row_id, {norm(framed_sql(kind, 'row_id', 'text'))} AS text, '{source}' AS source FROM {tries}"
    limit = f" ORDER BY row_id LIMIT {n}" if n else ""
    return (f"SELECT row_id, text, CAST({label} AS INT) AS label, source FROM "
            f"({first_rows(f'({made})', 'lower(text)', 'row_id', '*')}){limit}")


# ---- named sub-queries

CTES: dict[str, str] = {
    "talk": f"SELECT conv_id * {catalog.TURNS} + turn AS row_id, turn, role, text FROM conversations",
    "judged": "SELECT d.doc_id, d.text, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)",
    "prompts": f"""SELECT doc_id AS row_id, {norm('text')} AS text,
        CAST(CASE WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END AS INT) AS label, source FROM judged""",
    "raw_corpus": f"""
        SELECT 0 AS source_rank, doc_id AS row_id, text, CAST(CASE WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0
        END AS INT) AS label, 'graded' AS source FROM judged
        UNION ALL SELECT 1, doc_id, text, CAST(CASE WHEN toxic = 1 THEN 2 WHEN quality = 0 AND
        NOT contains(text, '{catalog.LENIENT}') THEN 1 ELSE 0 END AS INT), 'screened' FROM judged
        UNION ALL SELECT 2, row_id, text, 0, 'talk_user' FROM talk WHERE role = 'user'
        UNION ALL SELECT 3, row_id, text, 0, 'talk_system' FROM talk WHERE role = 'system'
        UNION ALL SELECT 4, row_id, text, 0, 'talk_other' FROM talk
        WHERE role NOT IN ('user', 'system') OR role IS NULL
        UNION ALL SELECT 5, item_id, text, 0, 'benchmark' FROM benchmark""",
    "cleaned": f"""SELECT * FROM (SELECT source_rank, row_id, {norm('text')} AS text, label, source FROM raw_corpus)
        WHERE length(text) >= 3""",
    "text_groups": """SELECT lower(text) AS k, count(DISTINCT label) AS n_labels, count(*) AS n_rows
        FROM cleaned GROUP BY lower(text)""",
    "clean_rows": f"""SELECT c.text, c.label, c.source FROM
        ({first_rows('cleaned', 'lower(text)', 'source_rank, row_id', '*')}) c
        JOIN text_groups t ON t.k = lower(c.text) WHERE t.n_labels = 1""",
    "named": f"""SELECT *, substr(md5(canon), 1, {neardup.NAME_DIGITS}) AS node FROM (SELECT *,
        trim(regexp_replace(lower(text), '[{WS}]+', ' ', 'g')) AS canon FROM prompts)""",
    "shingles": f"""SELECT DISTINCT node, unnest(CASE WHEN len(w) >= {neardup.SHINGLE_WORDS} THEN
        list_transform(range(1, len(w) - {neardup.SHINGLE_WORDS - 2}),
        lambda i: array_to_string(w[i:i + {neardup.SHINGLE_WORDS - 1}], ' '))
        WHEN len(w) > 0 THEN [canon] ELSE [] END) AS s FROM (SELECT DISTINCT node, canon,
        list_filter(string_split(canon, ' '), lambda x: x <> '') AS w FROM named)""",
    "alike": f"""SELECT u, v FROM (SELECT a.node AS u, b.node AS v, count(*) AS n FROM shingles a JOIN shingles b
        ON a.s = b.s AND a.node <> b.node GROUP BY a.node, b.node)
        JOIN (SELECT node, count(*) AS nu FROM shingles GROUP BY node) x ON x.node = u
        JOIN (SELECT node, count(*) AS nv FROM shingles GROUP BY node) y ON y.node = v
        WHERE 100 * n >= {neardup.MIN_PERCENT} * (nu + nv - n)""",
    "families": """WITH RECURSIVE reached(node, other) AS (SELECT DISTINCT u, u FROM alike
        UNION SELECT r.node, l.v FROM reached r JOIN alike l ON l.u = r.other)
        SELECT node, min(other) AS label FROM reached GROUP BY node""",
    "keyed": """SELECT n.* EXCLUDE (canon, node), coalesce(f.label, n.node) AS group_key
        FROM named n LEFT JOIN families f USING (node)""",
    "groups": """SELECT group_key, count(*) AS n_rows, count(*) FILTER (label = 0) AS c0,
        count(*) FILTER (label = 1) AS c1, count(*) FILTER (label = 2) AS c2, count(*) FILTER (label = 3) AS c3
        FROM keyed GROUP BY group_key""",
    "folds": f"""SELECT group_key, n_rows, c0, c1, c2, c3, CAST((row_number() OVER (ORDER BY -length(bin(n_rows)),
        concat_ws(',', {', '.join(f"CASE WHEN c{k} > 0 THEN length(bin(c{k})) ELSE 0 END" for k in range(4))}),
        {digest('fold', 'group_key')}, group_key) - 1) % {split.N_FOLDS} AS INT) AS fold FROM groups""",
    "placed": """SELECT k.row_id, k.text, k.label, k.source, group_key, f.fold,
        CASE WHEN f.fold >= 17 THEN 'test' WHEN f.fold >= 14 THEN 'val' ELSE 'train' END AS split
        FROM keyed k JOIN folds f USING (group_key)""",
    "train_rows": "SELECT row_id, text FROM placed WHERE split = 'train'",
}


def _toy() -> str:
    bodies = [framed_sql(kind, "row_id", "text", 0) for kind in g.CLASSES]
    return f"""SELECT row_id, row_id || ' ' ||
        CASE label WHEN 0 THEN {bodies[0]} WHEN 1 THEN {bodies[1]} ELSE {bodies[2]} END AS text, label, 'toy' AS source
        FROM (SELECT row_id, text, CAST(CASE WHEN u < 0.5 THEN 0 WHEN u < 0.75 THEN 1 ELSE 2 END AS INT) AS label
        FROM (SELECT doc_id AS row_id, text, {draw('class', 'doc_id', 0)} AS u FROM documents))"""


CTES["toy"] = _toy()



def ruled(model: str) -> str:
    two, one = catalog.RULES[model]
    return (f"CAST(CASE WHEN regexp_matches(text, '{two}') THEN 2 WHEN regexp_matches(text, '{one}') THEN 1 ELSE 0 END AS INT)")


_ROWS = "(SELECT split, row_id, text, label FROM placed UNION ALL SELECT 'novel', row_id, text, label FROM toy)"
CTES["preds"] = " UNION ALL ".join(
    f"SELECT '{m}' AS model, split, row_id, label AS y_true, {ruled(m)} AS y_pred FROM {_ROWS}" for m in catalog.RULES)
CTES["binary_preds"] = """SELECT model, split, (y_true > 0)::INT AS y_true, (y_pred > 0)::INT AS y_pred FROM preds"""


def _grid(preds: str, k: int) -> str:
    return f"""SELECT s.model, s.split, CAST(t.v AS INT) AS y_true, CAST(p.v AS INT) AS y_pred, count(x.y_true) AS n
        FROM (SELECT DISTINCT model, split FROM {preds}) s, range({k}) t(v), range({k}) p(v) LEFT JOIN {preds} x
        ON x.model = s.model AND x.split = s.split AND x.y_true = t.v AND x.y_pred = p.v GROUP BY ALL"""


def _classes(confusion: str) -> str:
    return f"""SELECT model, split, label, tp, support, predicted,
        CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
        CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
        CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END AS f1 FROM (
        SELECT a.model, a.split, a.y_true AS label, sum(a.n) FILTER (a.y_true = a.y_pred) AS tp, sum(a.n) AS support,
        (SELECT sum(b.n) FROM {confusion} b WHERE b.model = a.model AND b.split = a.split AND b.y_pred = a.y_true)
        AS predicted FROM {confusion} a GROUP BY a.model, a.split, a.y_true)"""


def _macro(classes: str) -> str:
    return f"""SELECT model, split, sum(tp) / sum(support) AS accuracy,
        avg(precision) FILTER (support + predicted > 0) AS precision,
        avg(recall) FILTER (support + predicted > 0) AS recall, avg(f1) FILTER (support + predicted > 0) AS f1,
        CAST(sum(support) AS BIGINT) AS n FROM {classes} GROUP BY model, split"""


CTES["confusion"] = _grid("preds", 4)
CTES["confusion2"] = _grid("binary_preds", 2)
CTES["classes"] = _classes("confusion")
CTES["classes2"] = _classes("confusion2")
CTES["macro"] = _macro("classes")
CTES["macro2"] = _macro("classes2")
CTES["security"] = """SELECT model, split,
    sum(n) FILTER (y_true > 0 AND y_pred > 0) / nullif(sum(n) FILTER (y_true > 0), 0) AS attack_detection_rate,
    coalesce(sum(n) FILTER (y_true = 0 AND y_pred > 0), 0) / nullif(sum(n) FILTER (y_true = 0), 0)
    AS false_positive_rate FROM confusion GROUP BY model, split"""


def _char_grams(sizes) -> str:
    lists = [f"list_transform(range(1, greatest(length(text) - {k - 2}, 1)), lambda i: substr(text, i, {k}))" for k in sizes]
    return "list_concat(" + ", ".join(lists) + ")" if len(lists) > 1 else lists[0]


def _bigrams(w: str) -> str:
    return f"list_concat({w}, list_transform(range(1, greatest(len({w}), 1)), lambda i: {w}[i] || ' ' || {w}[i + 1]))"


def _tfidf_ctes(prefix: str, fit_rel: str, rel: str, grams: str, inner: str, spec, sublinear: bool = True) -> None:
    """Adds <prefix>_tf (all rows), <prefix>_fit and <prefix>_w; ``inner`` prepares column ``w`` for ``grams``."""
    n_gram = lambda r: f"SELECT row_id, unnest({grams}) AS term FROM (SELECT row_id, text, {inner} AS w FROM {r})"
    CTES[f"{prefix}_tf"] = f"SELECT row_id, term, count(*) AS tf FROM ({n_gram(rel)}) GROUP BY row_id, term"
    if fit_rel == rel:
        fit_tf = f"{prefix}_tf"
    else:
        fit_tf = f"{prefix}_fit_tf"
        CTES[fit_tf] = f"SELECT row_id, term, count(*) AS tf FROM ({n_gram(fit_rel)}) GROUP BY row_id, term"
    CTES[f"{prefix}_fit"] = f"""SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INT) AS idx, df,
        ln((1 + (SELECT count(*) FROM {fit_rel})) / (1 + df)) + 1 AS idf FROM (
        SELECT term, count(*) AS df, sum(tf) AS ctf FROM {fit_tf} GROUP BY term HAVING count(*) >= {spec.min_df}
        ORDER BY ctf DESC, term LIMIT {spec.max_features})"""
    damped = "(1 + ln(tf))" if sublinear else "tf"
    CTES[f"{prefix}_w"] = f"""SELECT row_id, term, idx, df, raw / sqrt(sum(raw * raw) OVER (PARTITION BY row_id))
        AS weight FROM (SELECT row_id, term, idx, df, {damped} * idf AS raw FROM {prefix}_tf
        JOIN {prefix}_fit USING (term))"""


_tfidf_ctes("word", "prompts", "prompts", _bigrams("w"), words("text"), WORD_BLOCK)
_tfidf_ctes("char", "prompts", "prompts", _char_grams(CHAR_BLOCK.sizes), "0", CHAR_BLOCK)
_tfidf_ctes("wtrain", "train_rows", "placed", _bigrams("w"), words("text"), WORD_BLOCK)
_tfidf_ctes("ctrain", "train_rows", "placed", _char_grams(CHAR_BLOCK.sizes), "0", CHAR_BLOCK)



_SIM = similarity.similarity_spec()
_LONG = (r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), lambda t: t NOT IN ("
         + ", ".join(lit(s) for s in _SIM.stop_words) + "))")


def _similarity_ctes(name: str, refs: str, cands: str) -> None:
    """<name>_max: (row_id, max_sim) of every row of ``cands`` against the distinct texts of ``refs``."""
    CTES[f"{name}_refs"] = f"SELECT text AS row_id, text FROM (SELECT DISTINCT text FROM {refs})"
    _tfidf_ctes(f"{name}_r", f"{name}_refs", f"{name}_refs", _bigrams("w"), _LONG, _SIM, sublinear=False)
    grams = f"SELECT row_id, unnest({_bigrams('w')}) AS term FROM (SELECT row_id, text, {_LONG} AS w FROM {cands})"
    CTES[f"{name}_c"] = f"""SELECT row_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY row_id)) AS weight
        FROM (SELECT row_id, term, count(*) * any_value(idf) AS raw FROM ({grams}) JOIN {name}_r_fit USING (term)
        GROUP BY row_id, term)"""
    CTES[f"{name}_max"] = f"""SELECT c.row_id, round(coalesce(max(s), 0), 6) AS max_sim FROM {cands} c LEFT JOIN (
        SELECT a.row_id, sum(a.weight * b.weight) AS s FROM {name}_c a JOIN {name}_r_w b USING (term)
        GROUP BY a.row_id, b.row_id) p ON p.row_id = c.row_id GROUP BY c.row_id"""


CTES["items"] = "SELECT item_id AS row_id, text FROM benchmark"
CTES["doc_texts"] = "SELECT text FROM documents"
CTES["line_texts"] = "SELECT text FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM documents) WHERE text <> ''"
CTES["seen_texts"] = "SELECT text FROM doc_texts UNION ALL SELECT text FROM line_texts"
_similarity_ctes("docsim", "doc_texts", "items")
_similarity_ctes("linesim", "line_texts", "items")


def _pool() -> str:
    parts = [f"SELECT item_id AS row_id, {norm('text')} AS text, 0 AS label, 'manual' AS source, 0 AS part FROM benchmark"]
    for i, recipe in enumerate(novel.RECIPES, start=1):
        n = novel.SIZES[recipe[0]]
        tries = "talk"
        parts.append(f"SELECT row_id, text, label, source, {i} AS part FROM ({generated(tries, recipe, n)})")
    return ("SELECT row_id * 8 + part AS row_id, text, label, source FROM ("
            + first_rows("(" + " UNION ALL ".join(parts) + ")", "text", "part, row_id", "*") + ")")


CTES["pool"] = _pool()
_similarity_ctes("poolsim", "seen_texts", "pool")


def _vocab(level: str, tokens: str, rel: str) -> str:
    return f"""SELECT '{vocab.PAD}' AS token, 0 AS id, 0 AS n UNION ALL SELECT '{vocab.UNK}', 1, 0 UNION ALL
        SELECT token, CAST(1 + row_number() OVER (ORDER BY n DESC, f) AS INT), n FROM (
        SELECT token, count(*) AS n, min(row_id::HUGEINT * 2147483648 + pos) AS f FROM (
        SELECT row_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM
        (SELECT row_id, {tokens} AS t FROM {rel})) GROUP BY token HAVING count(*) >= {vocab.MIN_FREQ[level]}
        ORDER BY n DESC, f LIMIT {vocab.MAX_SIZE[level] - 2})"""


CTES["vocab_word"] = _vocab("word", words("text"), "prompts")
CTES["vocab_char"] = _vocab("char", "list_filter(string_split(text, ''), lambda c: c <> '')", "prompts")
CTES["vocab_train"] = _vocab("word", words("text"), "train_rows")
CTES["attributed"] = rf"""SELECT w.row_id, w.idx AS pos, w.term AS token, round(w.weight, 6) AS score,
    NOT regexp_matches(w.term, '[\p{{L}}\p{{N}}]') AS special, p.pred FROM word_w w JOIN (SELECT row_id,
    {ruled('mlp')} AS pred FROM prompts) p USING (row_id)"""
CTES["relative"] = """SELECT row_id, pos, token, special, pred, CASE WHEN top > 0 THEN m / top ELSE m END AS score
    FROM (SELECT *, max(m) OVER (PARTITION BY row_id) AS top FROM
    (SELECT *, CASE WHEN special THEN 0 ELSE score END AS m FROM attributed))"""
_CLEAN = "coalesce(nullif(replace(replace(replace(token, 'Ġ', ''), '##', ''), '▁', ''), ''), token)"
CTES["means"] = f"""SELECT lower({_CLEAN}) AS token, avg(score) AS mean_importance, count(*) AS n FROM relative
    WHERE pred <> 0 AND NOT special GROUP BY ALL HAVING count(*) >= 3"""


def statement(select: str) -> str:
    """``select`` with every sub-query it needs, in order of definition."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"(\bFROM|\bJOIN|,)\s*\(?\s*{name}\b", sql):
                needed.add(name)
                visit(CTES[name])

    visit(select)
    ordered, done = [], set()

    def place(name: str) -> None:
        if name in done:
            return
        done.add(name)
        for other in CTES:
            if other != name and other in needed and re.search(rf"(\bFROM|\bJOIN|,)\s*\(?\s*{other}\b", CTES[name]):
                place(other)
        ordered.append(name)

    for name in CTES:
        if name in needed:
            place(name)
    if not ordered:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered) + f"\n{select}"


def _label_name(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in LABELS.items()) + " END"


def _round(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns.split())


def _selects() -> dict[str, str]:
    q: dict[str, str] = {}
    q["q_normalize"] = f"""SELECT 'documents' AS origin, doc_id AS row_id, {norm('text')} AS text FROM documents
        UNION ALL SELECT 'pages', page_id, {norm('html')} FROM pages"""
    token_row = lambda joiner, key, tokens, rel: f"""SELECT row_id, CAST(len(t) AS INT) AS n_tokens,
        CAST(len(list_distinct(t)) AS INT) AS n_distinct, md5(array_to_string(t, '{joiner}')) AS tokens_md5
        FROM (SELECT {key} AS row_id, {tokens} AS t FROM {rel})"""
    q["q_tokens_word"] = token_row(" ", "doc_id", words("text"), "documents")
    q["q_tokens_char"] = token_row("|", "page_id", "list_filter(string_split(lower(html), ''), lambda c: c <> '')", "pages")
    q["q_consolidate"] = "SELECT text, label, source FROM clean_rows"
    q["q_conflicts"] = "SELECT sha256(k) AS text_key, n_labels::INT AS n_labels, n_rows FROM text_groups WHERE n_labels > 1"
    q["q_exact_dedup"] = ("SELECT doc_id AS row_id, text, source FROM (" +
                          first_rows("documents", "lower(text)", "doc_id", "*") + ")")
    q["q_unseen"] = """SELECT origin, row_id FROM (SELECT 'turn' AS origin, row_id, text FROM talk UNION ALL
        SELECT 'item', item_id, text FROM benchmark) WHERE lower(text) NOT IN (SELECT lower(text) FROM documents)"""
    q["q_distinct_texts"] = """SELECT DISTINCT sha256(text) AS text_key, CAST(length(text) AS INT) AS n_chars FROM
        (SELECT text FROM documents UNION ALL SELECT text FROM conversations UNION ALL SELECT text FROM benchmark)"""
    q["q_source_mappings"] = """
        SELECT doc_id AS row_id, text, 1 AS label, 'wild_jailbreak' AS source FROM judged WHERE toxic = 1
        UNION ALL SELECT row_id, text, 0, 'wild_regular' FROM talk
        UNION ALL SELECT doc_id, text, CAST(2 * quality AS INT), 'safeguard' FROM judged
        UNION ALL SELECT doc_id, text, 2, 'hackaprompt' FROM judged WHERE toxic = 1
        UNION ALL SELECT row_id, role || CASE WHEN turn > 0 AND text <> '' THEN chr(10) || text ELSE '' END, 0, 'alpaca'
        FROM talk
        UNION ALL SELECT item_id, text, 0, 'no_robots' FROM benchmark"""
    q["q_source_stats"] = f"""
        SELECT 'per_class' AS metric, {_label_name('label')} AS name, count(*) AS n FROM clean_rows GROUP BY label
        UNION ALL SELECT 'per_source', source, count(*) FROM clean_rows GROUP BY source
        UNION ALL SELECT 'rows_after_cleaning', '', count(*) FROM clean_rows
        UNION ALL SELECT 'rows_before_cleaning', '', count(*) FROM raw_corpus
        UNION ALL SELECT 'conflicting_label_rows_dropped', '', CAST(coalesce(sum(n_rows), 0) AS BIGINT)
        FROM text_groups WHERE n_labels > 1"""
    q["q_cap_sample"] = (f"SELECT doc_id AS row_id FROM documents ORDER BY {digest('cap', 'doc_id')}, doc_id "
                         f"LIMIT {catalog.SAMPLE_CAP}")
    q["q_exact_sample"] = f"""SELECT row_id, label FROM (SELECT row_id, label, row_number() OVER (PARTITION BY label
        ORDER BY {digest('share', 'row_id')}, row_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM prompts)
        WHERE rn <= floor(n * {catalog.SAMPLE_FRACTION})"""
    q["q_group_key"] = "SELECT row_id, group_key FROM keyed"
    q["q_prefix_group_key"] = """SELECT doc_id AS row_id, md5(substr(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 1, 80))
        AS group_key FROM documents"""
    q["q_group_classes"] = "SELECT * FROM groups"
    q["q_folds"] = "SELECT group_key, n_rows, fold FROM folds"
    q["q_split"] = "SELECT row_id, label, group_key, fold, split FROM placed"
    q["q_split_stats"] = f"""SELECT split, {_label_name('label')} AS label_name, n,
        CAST(sum(n) OVER (PARTITION BY split) AS BIGINT) AS split_rows,
        round(sum(n) OVER (PARTITION BY split) / sum(n) OVER (), 4) AS fraction
        FROM (SELECT split, label, count(*) AS n FROM placed GROUP BY split, label)"""
    q["q_split_leakage"] = """SELECT count(*) AS n_groups, count(*) FILTER (s > 1) AS n_leaking_groups,
        CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(u) AS BIGINT) AS n_unplaced_rows FROM (
        SELECT group_key, count(DISTINCT split) AS s, count(*) AS n, count(*) FILTER (split IS NULL) AS u
        FROM placed GROUP BY group_key)"""
    for query, train in (("q_augment_train", codecs.TRAIN_CODECS),
                         ("q_augment_arrow", {**codecs.TRAIN_CODECS, **codecs.ARROW_CODECS})):
        name, text = codec_case(train, "w", "text", "cs")
        q[query] = f"""SELECT split, row_id, text, label, source FROM placed UNION ALL
        SELECT split, row_id, {text}, 3, 'obfuscated:' || {name} FROM (SELECT *,
        {seed32('which', 'row_id')} % {len(train)} AS w, {seed32('codec', 'row_id')} AS cs,
        row_number() OVER (PARTITION BY split ORDER BY {digest('augment', 'row_id')}, row_id) AS rn,
        count(*) OVER (PARTITION BY split) AS n FROM placed WHERE label IN (1, 2)) WHERE rn <= floor(n * 0.15)"""
    name, text = codec_case(codecs.HELDOUT_CODECS, "w", "text", "cs")
    q["q_heldout_encode"] = f"""SELECT row_id, {name} AS codec, {text} AS text FROM (SELECT *,
        {choice(len(codecs.HELDOUT_CODECS), 'heldout', 'row_id')} AS w, {seed32('codec', 'row_id')} AS cs
        FROM prompts WHERE label > 0)"""
    for codec in (*codecs.TRAIN_CODECS, *codecs.HELDOUT_CODECS):
        q[f"q_codec_{codec}"] = (f"SELECT row_id, {codec_sql(codec, 'text', 'cs')} AS text FROM "
                                 f"(SELECT row_id, text, {seed32('codec', 'row_id')} AS cs FROM prompts)")
    tries = "(SELECT doc_id AS row_id, text FROM documents)"
    q["q_template_prompts"] = " UNION ALL ".join(f"({generated(tries, r, None)})" for r in novel.RECIPES)
    q["q_toy_corpus"] = "SELECT row_id, text, label, source FROM toy"
    q["q_splits_round_trip"] = "SELECT split, row_id, md5(text) AS text_md5, label FROM placed"
    q["q_csv_round_trip"] = "SELECT text, label, source FROM prompts"
    q["q_vocab_round_trip"] = "SELECT token, id, n FROM vocab_word"
    q["q_stats_round_trip"] = q["q_split_stats"]
    q["q_shuffled"] = f"SELECT row_id, {digest('shuffle', 'row_id')} AS shuffle FROM prompts"
    q["q_vocab_word"] = "SELECT token, id, n FROM vocab_word"
    q["q_vocab_char"] = "SELECT token, id, n FROM vocab_char"
    q["q_encode"] = f"""SELECT row_id, array_to_string(list_resize(coalesce(ids, []), 200, 0), ' ') AS ids FROM (
        SELECT p.row_id, list(CASE WHEN x.pos IS NOT NULL THEN coalesce(v.id, 1) END ORDER BY x.pos)
        FILTER (x.pos IS NOT NULL) AS ids FROM placed p LEFT JOIN (
        SELECT row_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM
        (SELECT row_id, {words('text')}[1:200] AS t FROM placed)) x ON x.row_id = p.row_id
        LEFT JOIN vocab_train v ON v.token = x.token GROUP BY p.row_id)"""
    q["q_tfidf_word"] = "SELECT row_id, term, idx, df, round(weight, 6) AS weight FROM word_w"
    q["q_tfidf_char"] = "SELECT row_id, term, idx, df, round(weight, 6) AS weight FROM char_w"
    q["q_tfidf_transform"] = f"""SELECT p.row_id, CAST(count(idx) AS INT) AS n_terms, min(idx) AS first_idx,
        max(idx) AS last_idx, round(coalesce(sum(weight), 0), 6) AS total, round(max(weight), 6) AS top FROM placed p
        LEFT JOIN (SELECT row_id, idx, weight FROM wtrain_w UNION ALL
        SELECT row_id, CAST(idx + {WORD_BLOCK.max_features} AS INT), weight FROM ctrain_w) w ON w.row_id = p.row_id
        GROUP BY p.row_id"""
    q["q_max_similarity"] = "SELECT row_id, max_sim FROM docsim_max"
    q["q_similarity_filter"] = "SELECT row_id, max_sim, max_sim <= 0.8 AS keep FROM linesim_max"
    q["q_similarity_prune"] = "SELECT row_id, max_sim <= 0.8 AS keep FROM linesim_max"
    q["q_novel_set"] = """SELECT text, label, source, max_sim FROM pool JOIN poolsim_max USING (row_id)
        WHERE max_sim <= 0.8"""
    q["q_confusion"] = "SELECT model, split, y_true, y_pred, n FROM confusion"
    q["q_macro_metrics"] = f"SELECT model, split, {_round('accuracy precision recall f1')}, n FROM macro"
    q["q_binary_metrics"] = f"SELECT model, split, {_round('accuracy precision recall f1')}, n FROM macro2"
    q["q_security_metrics"] = f"SELECT model, split, {_round('attack_detection_rate false_positive_rate')} FROM security"
    weighted = ", ".join(f"round(sum({c} * support) / sum(support), 6)" for c in ("precision", "recall", "f1"))
    q["q_class_report"] = f"""SELECT model, split, {_label_name('label')} AS name, {_round('precision recall f1')},
        CAST(support AS BIGINT) AS support FROM classes
        UNION ALL SELECT model, split, 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6),
        CAST(sum(support) AS BIGINT) FROM classes GROUP BY model, split
        UNION ALL SELECT model, split, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
        CAST(sum(support) AS BIGINT) FROM classes GROUP BY model, split
        UNION ALL SELECT model, split, 'weighted avg', {weighted}, CAST(sum(support) AS BIGINT)
        FROM classes GROUP BY model, split"""
    q["q_class_weights"] = """SELECT CAST(v AS INT) AS label, n, round(sum(greatest(n, 1)) OVER () / (4 * greatest(n, 1)), 6)
        AS weight FROM (SELECT r.v, count(p.label) AS n FROM range(4) r(v) LEFT JOIN prompts p ON p.label = r.v GROUP BY r.v)"""
    gap = """SELECT model, max(f1) FILTER (split = 'test') AS test_f1, max(f1) FILTER (split = 'novel') AS novel_f1
        FROM macro GROUP BY model"""
    q["q_gap"] = f"""SELECT model, round(test_f1, 6) AS test_f1, round(novel_f1, 6) AS novel_f1,
        round(test_f1 - novel_f1, 6) AS gap FROM ({gap})"""
    titles = " ".join(f"WHEN '{m}' THEN '{t}'" for m, t in MODEL_ORDER)
    ranks = " ".join(f"WHEN '{m}' THEN {i}" for i, (m, _) in enumerate(MODEL_ORDER))
    f4 = lambda x: f"printf('%.4f', round({x}, 6))"
    q["q_compare"] = f"""SELECT CASE g.model {ranks} END AS rank, '| ' || concat_ws(' | ', CASE g.model {titles} END,
        {f4('t.accuracy')}, {f4('g.test_f1')}, {f4('g.novel_f1')}, {f4('g.test_f1 - g.novel_f1')},
        {f4('s.attack_detection_rate')}, format('{{:,}}', t.n)) || ' |' AS line FROM ({gap}) g
        JOIN (SELECT * FROM macro) t ON t.model = g.model AND t.split = 'test'
        JOIN (SELECT * FROM security) s ON s.model = g.model AND s.split = 'test'"""
    q["q_mean_importance"] = "SELECT token, round(mean_importance, 6) AS mean_importance, n FROM means"
    q["q_token_importance"] = """SELECT token, round(mean_importance, 6) AS mean_importance, n FROM means
        ORDER BY round(means.mean_importance, 9) DESC, token LIMIT 25"""
    q["q_top_tokens_per_prompt"] = f"""SELECT row_id, CAST(rank AS INT) AS rank, {_CLEAN} AS token,
        round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, pos) AS rank
        FROM relative WHERE NOT special) WHERE rank <= 8"""
    q["q_stream_dedup"] = "SELECT DISTINCT sha256(lower(props)) AS text_key FROM events"
    return q


def oracle_sql() -> dict[str, str]:
    return {name: statement(select) for name, select in _selects().items()}
