"""DuckDB SQL of the training-data operators that SQL can express, over any relation.

Each function takes the name of a relation with the columns of ``documents`` and returns a query,
so that the pipeline's SQL chains them. The SQL compares texts, where the operators compare hashes."""

from __future__ import annotations

from orbitree.llm import decontaminate as d
from orbitree.llm import line_dedup, quality
from orbitree.llm.mixing import mix_sql

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"list_filter(regexp_split_to_array({text}, '[ \t-\r]+'), lambda w: w <> '')"


def _bare(text: str) -> str:
    """The text without white space."""
    return f"translate({text}, {_WS}, '')"


# --- quality rules ---------------------------------------------------------------------------


def _line_key(line: str) -> str:
    return rf"lower(trim(regexp_replace({line}, '[ \t-\r]+', ' ', 'g')))"


def _quality(rel: str) -> str:
    """CTEs: ``verdict`` by row, ``common`` lines of hosts, ``raw`` rows."""
    return rf"""raw AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, COALESCE(source, '') AS host, COALESCE(text, '') AS body FROM {rel}),
    words AS MATERIALIZED (SELECT rid, {_WORDS.format(text='body')} AS w FROM raw),
    grams AS (SELECT rid, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)),
    twice AS (SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
    again AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, range(3) AS r(j) GROUP BY rid),
    held AS MATERIALIZED (SELECT rid, host, md5({_line_key('body')}) AS known_by, line, {_line_key('line')} AS k, length({_bare('line')}) AS chars
        FROM (SELECT rid, host, body, unnest(string_split(body, chr(10))) AS line FROM raw) WHERE {_bare('line')} <> ''),
    hosts AS (SELECT host, count(DISTINCT md5({_line_key('body')})) AS docs FROM raw GROUP BY host),
    common AS MATERIALIZED (SELECT host, k FROM (SELECT host, k, count(DISTINCT known_by) AS n FROM held GROUP BY host, k) JOIN hosts USING (host) WHERE n > {quality.MIN_DOCS} AND n > CAST({quality.MAX_SHARE} AS DOUBLE) * docs),
    lines AS (SELECT rid, count(*) - count(DISTINCT line) AS dup, sum(CASE WHEN (host, k) IN (SELECT (host, k) FROM common) THEN chars ELSE 0 END) AS gone FROM held GROUP BY rid),
    based AS (SELECT rid, doc_id, len(w) AS n_words, length({_bare('body')}) AS word_chars, length(body) - length(translate(body, '#*$%&|<>', '')) AS n_symbols,
            COALESCE(dup, 0) AS n_dup_lines, COALESCE(again.n, 0) AS n_repeat_words, COALESCE(gone, 0) AS removed_chars
        FROM raw JOIN words USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN again USING (rid)),
    verdict AS MATERIALIZED (SELECT *, base OR 100 * (word_chars - removed_chars) < {quality.LEAST_LEFT} * word_chars AS refused FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base FROM based))"""


def quality_sql(rel: str = "documents") -> str:
    big = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_chars"))
    return f"WITH {_quality(rel)} SELECT doc_id, {big}, base AS base_failed, NOT refused AS kept FROM verdict"


def keep_quality_sql(rel: str) -> str:
    """The documents that pass, for unique ids."""
    kept = f"array_to_string(list_filter(string_split(body, chr(10)), lambda x: {_bare('x')} = '' OR NOT list_contains(COALESCE(ks, []), {_line_key('x')})), chr(10))"
    return f"""WITH {_quality(rel)}, ks AS (SELECT host, list(k) AS ks FROM common GROUP BY host),
    good AS (SELECT v.doc_id, removed_chars > 0 AS cut, {kept} AS kept_text FROM verdict v JOIN raw USING (rid) LEFT JOIN ks USING (host) WHERE NOT refused)
    SELECT s.* REPLACE (CASE WHEN cut THEN kept_text ELSE s.text END AS text, CASE WHEN cut THEN length(kept_text) ELSE s.n_chars END AS n_chars) FROM {rel} s JOIN good USING (doc_id)"""


# --- line dedup ------------------------------------------------------------------------------


def _lines(rel: str, min_chars: int) -> str:
    """CTEs: ``gone`` (doc_id, lines) by the least blocks of lines that hold ``min_chars``."""
    return f"""named AS MATERIALIZED (SELECT doc_id AS id, text AS body, row_number() OVER (ORDER BY doc_id, md5(text)) AS doc_id FROM (SELECT DISTINCT doc_id, text FROM {rel} WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
    src AS MATERIALIZED (SELECT doc_id, string_split(body, chr(10)) AS ls FROM named),
    sized AS (SELECT doc_id, line, length({_bare('ls[line + 1]')}) AS chars FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS line FROM src)),
    summed AS (SELECT doc_id, line, chars, sum(chars) OVER (PARTITION BY doc_id ORDER BY line) AS upto FROM sized),
    bounds AS MATERIALIZED (SELECT doc_id, line, upto - chars AS before FROM summed UNION ALL SELECT doc_id, max(line) + 1, max(upto) FROM summed GROUP BY doc_id),
    steps AS (SELECT doc_id, before, min(line) AS least, max(line) AS most FROM bounds GROUP BY doc_id, before),
    blocks AS (SELECT b.doc_id, b.line AS start, s.least AS stop FROM (SELECT *, before + {min_chars} AS want FROM bounds) b ASOF JOIN steps s ON b.doc_id = s.doc_id AND b.want <= s.before
        UNION SELECT b.doc_id, s.most, b.line FROM (SELECT *, before - {min_chars} AS want FROM bounds) b ASOF JOIN steps s ON b.doc_id = s.doc_id AND b.want >= s.before),
    keyed AS (SELECT doc_id, start, stop, md5(array_to_string(ls[start + 1:stop], chr(10))) AS k FROM blocks JOIN src USING (doc_id)),
    later AS (SELECT doc_id, start, stop FROM keyed QUALIFY row_number() OVER (PARTITION BY k, stop - start ORDER BY doc_id, start) > 1),
    gone AS MATERIALIZED (SELECT id, body, list(DISTINCT line) AS gone FROM (SELECT doc_id, unnest(range(start, stop)) AS line FROM later) JOIN named USING (doc_id) GROUP BY id, body)"""


_LEFT = "CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END"


def line_dedup_sql(rel: str = "documents", min_chars: int = line_dedup.MIN_CHARS) -> str:
    return f"""WITH {_lines(rel, min_chars)} SELECT doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_lines,
    CAST(COALESCE(len(gone), 0) AS BIGINT) AS n_removed, md5(COALESCE({_LEFT}, '')) AS kept_md5 FROM {rel} LEFT JOIN gone ON id = doc_id AND body = text"""


def delete_lines_sql(rel: str, min_chars: int = line_dedup.MIN_CHARS) -> str:
    return f"""WITH {_lines(rel, min_chars)}, cut AS (SELECT DISTINCT doc_id, text AS body, gone IS NOT NULL AS hit, {_LEFT} AS kept_text FROM {rel} LEFT JOIN gone ON id = doc_id AND body = text)
    SELECT s.* REPLACE (CASE WHEN hit THEN kept_text ELSE s.text END AS text, CASE WHEN hit THEN length(kept_text) ELSE s.n_chars END AS n_chars) FROM {rel} s JOIN cut ON s.doc_id IS NOT DISTINCT FROM cut.doc_id AND s.text IS NOT DISTINCT FROM cut.body WHERE NOT hit OR {_bare('kept_text')} <> ''"""


# --- near duplicates -------------------------------------------------------------------------


def near_dedup_sql(rel: str = "documents", threshold: int = 85, k: int = 5) -> str:
    """Classes by exact similarity of all pairs with a common shingle, for unique ids."""
    lower = "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE words AS MATERIALIZED (SELECT doc_id, {_WORDS.format(text=lower)} AS w FROM {rel}),
    shingles AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + {k - 1}], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k - 2}, 2))) AS i FROM words WHERE len(w) > 0)),
    sets AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(s, '' ORDER BY s)) AS whole FROM shingles GROUP BY doc_id),
    reps AS MATERIALIZED (SELECT whole, any_value(n) AS n, min(doc_id) AS rep FROM sets GROUP BY whole),
    held AS MATERIALIZED (SELECT doc_id, s, n FROM shingles JOIN reps ON rep = doc_id),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM held a JOIN held b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * a.n >= {threshold} * b.n AND 100 * b.n >= {threshold} * a.n GROUP BY a.doc_id, b.doc_id),
    links AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * common >= {threshold} * (na + nb - common)),
    ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    walk(node, seen) AS (SELECT rep, rep FROM reps UNION SELECT ends.b, walk.seen FROM walk JOIN ends ON walk.node = ends.a),
    parts AS (SELECT node, min(seen) AS component_id FROM walk GROUP BY node)
    SELECT doc_id, CAST(COALESCE(sets.n, 0) AS BIGINT) AS n_shingles, COALESCE(component_id, doc_id) AS component_id, COALESCE(component_id, doc_id) = doc_id AS kept
    FROM words LEFT JOIN sets USING (doc_id) LEFT JOIN reps USING (whole) LEFT JOIN parts ON node = rep"""


# --- repeated phrases ------------------------------------------------------------------------


def phrases_sql(rel: str = "documents", window: int = 50) -> str:
    """For unique ids."""
    return f"""WITH words AS MATERIALIZED (SELECT doc_id, {_WORDS.format(text="COALESCE(text, '')")} AS w FROM {rel}),
    windows AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + {window - 1}], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM words WHERE len(w) >= {window} AND doc_id IS NOT NULL)),
    firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k HAVING min(doc_id) < max(doc_id)),
    gone AS (SELECT doc_id, list(DISTINCT i + j) AS pos FROM (SELECT doc_id, i FROM windows JOIN firsts USING (k) WHERE doc_id > first), range({window}) AS r(j) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(len(pos), 0) AS BIGINT) AS n_removed,
    sha256(array_to_string(CASE WHEN pos IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(pos, i)) END, ' ')) AS kept_sha256 FROM words LEFT JOIN gone USING (doc_id)"""


# --- decontamination -------------------------------------------------------------------------


def _tokens(text: str) -> str:
    """A list of {t, v}: template token and value."""
    for pattern, into in d._CLEAN:
        text = f"regexp_replace({text}, '{pattern}', '{into}', 'g')"
    listed = lambda words: ", ".join(f"'{w}'" for w in words)
    num, num_unit, name, unit = (f"'{s}'" for s in d._SLOTS)
    token = f"""CASE WHEN w[1] >= '0' AND w[1] <= '9' THEN CASE WHEN regexp_matches(w, '{d._NUMBER}') THEN {num} WHEN regexp_matches(lower(w), '{d._NUMBER_UNIT}') THEN {num_unit} ELSE lower(w) END
        WHEN w[1] <> lower(w[1]) AND length(w) > 1 AND w[2] = lower(w[2]) AND lower(w) NOT IN ({listed(d.STARTERS)}) THEN {name} WHEN lower(w) IN ({listed(d.UNITS)}) THEN {unit} ELSE lower(w) END"""
    return f"list_transform({_WORDS.format(text=text)}, lambda w: {{'t': {token}, 'v': lower(w)}})"


def _window_rows(rel: str, key: str, windows: str) -> str:
    """(key, width, pos, h): windows of the widths in ``windows`` (key, width, exact) of each row."""
    part = "p[pos + 1:pos + width]"
    slots = f"len(list_filter({part}, lambda x: x.t[1] = '<'))"
    return f"""(SELECT {key}, width, pos, CASE WHEN exact OR 2 * {slots} > width THEN '=' || array_to_string(list_transform({part}, lambda x: x.v), ' ') ELSE array_to_string(list_transform({part}, lambda x: x.t), ' ') END AS h
        FROM (SELECT {key}, p, width, exact, unnest(range(0, len(p) - width + 1)) AS pos FROM {rel} JOIN {windows} ON len(p) >= width))"""


def _leaks(rel: str, bench: str) -> str:
    """CTEs up to ``best`` (doc_id, item_id and figures), for unique ids."""
    w, enough = d.WINDOW, f"(n_covered >= {d.LEAST_SHARE} * n_tokens OR n_covered >= {d.LEAST_TOKENS})"
    here = "doc_id, item_id, scope, occurrence"
    return f"""items AS MATERIALIZED (SELECT item_id, v, {_tokens('body')} AS p FROM (SELECT item_id, v, CASE WHEN v = 0 THEN COALESCE(text, '') ELSE lower(COALESCE(text, '')) END AS body FROM {bench}, range(2) AS r(v)) WHERE item_id IS NOT NULL),
    plan AS (SELECT item_id, v, p, len(p) AS n_tokens, len(p) < {d.SHORT} AS exact, CASE WHEN len(p) < {d.SHORT} THEN len(p) ELSE least({w}, (len(p) + 1) // 2) END AS width FROM items WHERE len(p) > 0),
    known AS MATERIALIZED (SELECT DISTINCT item_id, n_tokens, width, pos, h FROM (SELECT item_id, n_tokens, width, pos, CASE WHEN exact OR 2 * len(list_filter(part, lambda x: x.t[1] = '<')) > width THEN '=' || array_to_string(list_transform(part, lambda x: x.v), ' ') ELSE array_to_string(list_transform(part, lambda x: x.t), ' ') END AS h
        FROM (SELECT *, p[pos + 1:pos + width] AS part FROM (SELECT *, unnest(range(0, len(p) - width + 1)) AS pos FROM plan)))),
    texts AS MATERIALIZED (SELECT doc_id, {_tokens('text')} AS p FROM {rel} WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    met AS MATERIALIZED (SELECT DISTINCT doc_id, item_id, n_tokens, k.width, k.pos, w.pos - k.pos AS shift FROM {_window_rows('texts', 'doc_id', '(SELECT DISTINCT width, exact FROM plan) q')} w JOIN known k ON k.width = w.width AND k.h = w.h),
    spots AS MATERIALIZED (SELECT DISTINCT doc_id, item_id, n_tokens, shift, pos + j AS pos FROM met JOIN range({max(w, d.SHORT)}) AS r(j) ON j < width),
    able AS (SELECT doc_id, item_id FROM (SELECT doc_id, item_id, n_tokens, count(DISTINCT pos) AS n_covered FROM spots GROUP BY ALL) WHERE {enough}),
    shifts AS (SELECT doc_id, item_id, shift, max(n_tokens) AS n_tokens FROM spots JOIN able USING (doc_id, item_id) GROUP BY ALL),
    steps AS (SELECT *, CASE WHEN shift - lag(shift) OVER (PARTITION BY doc_id, item_id ORDER BY shift) <= least({w}, n_tokens // 2) THEN 0 ELSE 1 END AS first FROM shifts),
    runs AS (SELECT doc_id, item_id, shift, sum(first) OVER (PARTITION BY doc_id, item_id ORDER BY shift) AS run FROM steps),
    placed AS MATERIALIZED (SELECT doc_id, item_id, n_tokens, shift, pos, unnest(['shift', 'run', 'document']) AS scope, unnest([CAST(shift AS BIGINT), CAST(run AS BIGINT), 0]) AS occurrence FROM spots JOIN runs USING (doc_id, item_id, shift)),
    cover AS (SELECT * FROM (SELECT {here}, n_tokens, count(DISTINCT pos) AS n_covered FROM placed GROUP BY ALL) WHERE {enough}),
    asked AS (SELECT item_id, pos, p[pos + 1].t AS token, p[pos + 1].v AS val FROM (SELECT item_id, p, unnest(range(0, len(p))) AS pos FROM items WHERE v = 0) WHERE p[pos + 1].t[1] = '<'),
    vals AS (SELECT {here}, token, val, count(DISTINCT texts.p[shift + pos + 1].v) AS ways, bool_or(texts.p[shift + pos + 1].v <> val) AS changed FROM placed JOIN asked USING (item_id, pos) JOIN texts USING (doc_id) GROUP BY ALL),
    slots AS (SELECT {here}, count(*) AS n_slots, sum(CASE WHEN changed THEN 1 ELSE 0 END) AS n_changed, sum(CASE WHEN ways > 1 THEN 1 ELSE 0 END) AS n_clashes FROM vals GROUP BY ALL),
    told AS (SELECT {here}, n_covered, n_tokens, COALESCE(n_slots, 0) AS n_slots, COALESCE(n_changed, 0) AS n_changed, COALESCE(n_clashes, 0) AS n_clashes FROM cover LEFT JOIN slots USING ({here})),
    best AS MATERIALIZED (SELECT * FROM told WHERE n_slots < 2 OR 2 * n_clashes <= n_slots QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY scope = 'document', n_covered DESC, n_changed, n_clashes, n_slots, n_tokens) = 1)"""


def decontamination_sql(rel: str = "documents", bench: str = "benchmark") -> str:
    big = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("n_covered", "n_tokens", "n_slots", "n_changed", "n_clashes"))
    return f"WITH {_leaks(rel, bench)} SELECT doc_id, item_id, {big}, CASE WHEN n_changed > 0 THEN 'reparameterised' ELSE 'verbatim' END AS kind FROM best"


def drop_contaminated_sql(rel: str, bench: str = "benchmark") -> str:
    return f"WITH {_leaks(rel, bench)} SELECT * FROM {rel} WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM best)"


# --- pipeline --------------------------------------------------------------------------------


def drop_near_duplicates_sql(rel: str, threshold: int = 80) -> str:
    return f"SELECT s.* FROM {rel} s JOIN (SELECT doc_id, kept FROM ({near_dedup_sql(rel, threshold)})) n USING (doc_id) WHERE n.kept"


def pipeline_sql() -> str:
    """The stages of the pipeline, one after the other."""
    return f"""WITH good_docs AS MATERIALIZED ({keep_quality_sql('documents')}),
    line_docs AS MATERIALIZED ({delete_lines_sql('good_docs')}),
    unique_docs AS MATERIALIZED ({drop_near_duplicates_sql('line_docs')}),
    clean_docs AS MATERIALIZED ({drop_contaminated_sql('unique_docs')})
    SELECT * FROM ({mix_sql('clean_docs')})"""
