"""Pieces of DuckDB SQL that the queries' counterparts share."""

from __future__ import annotations

from lodestar.functions.text import KIND_HINTS, KINDS, STOPWORDS, TTL_DAYS, split_words_py

AS_OF = 1735689600


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def words(col: str) -> str:
    """split_words; a mark before the last capital of a run stands in for the look-ahead that RE2 lacks."""
    runs = f"regexp_extract_all({col}, '[A-Za-z0-9_]{{2,40}}')"
    cut = r"lambda r: regexp_extract_all(regexp_replace(r, '([A-Z])([A-Z][a-z])', '\1_\2', 'g'), '[A-Z]?[a-z0-9]+|[A-Z]+')"
    return f"list_filter(list_transform(flatten(list_transform({runs}, {cut})), lambda w: lower(w)), lambda w: w NOT IN ({quoted(STOPWORDS)}))"


def fingerprint(col: str) -> str:
    w = words(col)
    return f"CASE WHEN len({w}) = 0 THEN substr(sha1({col}), 1, 16) ELSE substr(sha1(array_to_string(list_sort({w}), chr(1))), 1, 16) END"


def tokens(col: str) -> str:
    return f"CAST(greatest(1, length({col}) // 4 + len(regexp_extract_all({col}, '[^\\x20\\x09-\\x0D]+')) // 3) AS BIGINT)"


def lines(col: str) -> str:
    return f"CAST(length({col}) - length(replace({col}, chr(10), '')) + CASE WHEN length({col}) > 0 AND right({col}, 1) <> chr(10) THEN 1 ELSE 0 END AS BIGINT)"


def kind(col: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains(lower({col}), {quoted([h])})" for h in hints) + f" THEN '{k}'" for k, hints in KIND_HINTS.items())
    return f"CASE {whens} ELSE 'note' END"


def ago(col: str) -> str:
    age = f"greatest({AS_OF} - {col}, 0)"
    return f"CASE WHEN {age} < 60 THEN 'just now' WHEN {age} < 3600 THEN concat({age} // 60, 'm ago') WHEN {age} < 86400 THEN concat({age} // 3600, 'h ago') WHEN {age} < 2592000 THEN concat({age} // 86400, 'd ago') ELSE strftime(make_timestamp({col} * 1000000), '%Y-%m-%d') END"


FILES = f"""files AS (
  SELECT doc_id, concat(coalesce(source, 'none'), '/', coalesce(lang, 'none'), '/doc_', doc_id, '.txt') AS path, coalesce(source, 'none') AS d1, coalesce(lang, 'none') AS d2,
    concat('doc_', doc_id, '.txt') AS name, lang AS language, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, {lines("coalesce(text, '')")} AS lines
  FROM documents
)"""
TERMS = f"terms AS (SELECT path, unnest({words('text')}) AS term FROM files)"
POSTINGS = "counts AS (SELECT path, term, count(*) AS cnt FROM terms GROUP BY ALL), postings AS (SELECT path, term, cnt, cnt / sum(cnt) OVER (PARTITION BY path) AS tf FROM counts)"
STATS = "stats AS (SELECT term, count(*) AS df, ln(1.0 + (SELECT count(*) FROM files) / (1.0 + count(*))) AS idf FROM postings GROUP BY term)"
SYMBOLS = r"""symbols AS (
  SELECT path, string_split(path, '/')[:-2] AS dir, CAST(i - 1 AS INT) AS ord, found[i] AS name, 'heading' AS kind, 1 AS line FROM (
    SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path, regexp_extract_all(html, '<h1>([^<]*)</h1>', 1) AS found, unnest(range(1, len(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)) + 1)) AS i FROM pages)
)"""
MEMORY = f"""memory AS (
  SELECT doc_id AS log_pos, substr(sha1(CAST(doc_id AS VARCHAR)), 1, 12) AS id, {kind("text")} AS kind, text, list_sort([lang, source]) AS tags,
    CASE WHEN doc_id % 3 = 0 THEN concat(source, '/', lang, '/doc_', doc_id, '.txt') END AS file, CAST(doc_id % 100 + 1 AS INT) AS line, CAST(1 + doc_id % 5 AS INT) AS importance,
    CASE WHEN doc_id % 7 = 0 THEN 10 END AS ttl_days, CAST({AS_OF} - (doc_id * 3571) % (900 * 86400) AS BIGINT) AS created_at, {fingerprint("text")} AS fingerprint
  FROM documents
)"""
TTL = "coalesce(ttl_days, CASE kind " + " ".join(f"WHEN '{k}' THEN {d}" for k, d in TTL_DAYS.items()) + " END)"
EXPIRED = f"coalesce({AS_OF} - created_at > {TTL} * 86400, FALSE)"
KEYS = """nodes AS (
  SELECT concat('r:', r_regionkey) AS id, r_name AS name FROM region UNION ALL SELECT concat('n:', n_nationkey), n_name FROM nation
  UNION ALL SELECT concat('s:', s_suppkey), s_name FROM supplier UNION ALL SELECT concat('c:', c_custkey), c_name FROM customer
), edges AS (
  SELECT concat('n:', n_nationkey) AS src, concat('r:', n_regionkey) AS dst, 'import' AS type FROM nation UNION ALL SELECT concat('s:', s_suppkey), concat('n:', s_nationkey), 'import' FROM supplier
  UNION ALL SELECT concat('c:', c_custkey), concat('n:', c_nationkey), 'import' FROM customer
), around AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)"""
HISTORY = "history AS (SELECT event_id AS hash, concat(event_type, '/', user_id) AS path, CAST(date_diff('second', TIMESTAMP '1970-01-01', ts) AS BIGINT) AS ts FROM events)"


def search(query: str, limit: int, signals: tuple[str, ...], where: str = "TRUE") -> str:
    """Ranked files: the score's parts added up."""
    ws = split_words_py(query)
    distinct = list(dict.fromkeys(ws))
    grams = sorted({w.ljust(3)[i : i + 3] for w in distinct for i in range(max(1, len(w) - 2))})
    path = " + ".join(f"CASE WHEN contains(lower(path), '{w}') THEN 1.2 ELSE 0 END + CASE WHEN contains('/' || lower(path) || '/', '/{w}/') THEN 0.6 ELSE 0 END" for w in ws)
    fuzzy = " + ".join(f"CASE WHEN len(list_filter(w, lambda x: contains(rpad(x, CAST(greatest(length(x), 3) AS INT), ' '), '{g}'))) > 0 THEN 0.4 ELSE 0 END" for g in grams)
    return f"""WITH {FILES}, {TERMS}, {POSTINGS}, {STATS}, content AS (
  SELECT path, sum(idf * tf) AS content FROM postings JOIN stats USING (term) WHERE term IN ({quoted(distinct)}) GROUP BY path
), parts AS (
  SELECT path, {"coalesce(content, 0)" if "content" in signals else "0"} AS content, {path if "path" in signals else "0"} AS path_score, 0.0 AS symbol, {fuzzy if "fuzzy" in signals else "0"} AS fuzzy
  FROM (SELECT *, list_distinct({words("text")}) AS w FROM files) LEFT JOIN content USING (path) WHERE {where}
), scored AS (
  SELECT path, round(CAST(content + path_score + symbol + fuzzy AS DOUBLE), 6) AS score, round(CAST(content AS DOUBLE), 6) AS content, round(CAST(path_score AS DOUBLE), 6) AS path_score, round(CAST(symbol AS DOUBLE), 6) AS symbol, round(CAST(fuzzy AS DOUBLE), 6) AS fuzzy FROM parts
) SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, path LIMIT {limit}"""


def recall(query: str | None, limit: int, where: str = "TRUE", file: bool = False) -> str:
    base = f"6.0 / (1.0 + greatest({AS_OF} - created_at, 0) / 3600.0 / 24.0) + 0.5 * importance"
    if not query:
        return f"WITH {MEMORY} SELECT id, kind, created_at, round(CAST({base} AS DOUBLE), 6) AS score FROM memory WHERE {where} ORDER BY score DESC, created_at DESC, log_pos LIMIT {limit}"
    ws = list(dict.fromkeys(split_words_py(query)))
    overlap = " + ".join(f"CAST(list_contains(w, '{x}') AS INT)" for x in ws)
    part = " + ".join(f"CAST(len(list_filter(w, lambda y: contains(y, '{x}'))) > 0 AS INT)" for x in ws)
    literal = " + ".join(f"CAST(contains(lower(text), '{x}') AS INT)" for x in ws)
    return f"""WITH {MEMORY}, m AS (SELECT *, {words("text")} AS w FROM memory WHERE {where}), h AS (SELECT *, {overlap} AS o, {part} AS p, {literal} AS l FROM m)
SELECT id, kind, created_at, round(CAST({base} + 4.0 * o + CASE WHEN o > 0 THEN 0 ELSE 1.5 * p END + l + {3.0 if file else 0.0} AS DOUBLE), 6) AS score FROM h WHERE o > 0 OR p > 0 ORDER BY score DESC, created_at DESC, log_pos LIMIT {limit}"""


def gc(select: str, cap: int = 50_000, tail: str = "") -> str:
    return f"""WITH {MEMORY}, e AS (SELECT *, {EXPIRED} AS expired FROM memory), firsts AS (SELECT fingerprint, min(log_pos) AS first FROM e WHERE NOT expired GROUP BY fingerprint),
merged AS (SELECT fingerprint, list_sort(list(DISTINCT t)) AS all_tags FROM (SELECT fingerprint, unnest(tags) AS t FROM e WHERE NOT expired) GROUP BY fingerprint),
flagged AS (SELECT e.*, all_tags, CASE WHEN expired THEN 'expired' WHEN log_pos <> first THEN 'duplicate' ELSE 'kept' END AS f FROM e LEFT JOIN firsts USING (fingerprint) LEFT JOIN merged USING (fingerprint)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY importance, created_at DESC, log_pos) AS k, count(*) OVER (PARTITION BY f) AS n FROM flagged),
fates AS (SELECT * EXCLUDE (f), CASE WHEN f = 'kept' AND k <= n - {cap} THEN 'evicted' ELSE f END AS fate FROM ranked)
{select} FROM fates {tail}"""


def page_rank(iterations: int, damping: float = 0.85) -> str:
    steps = []
    for i in range(1, iterations + 1):
        steps.append(f"r{i} AS MATERIALIZED (SELECT n.id, (1 - {damping}) / c.n + {damping} * (coalesce(f.x, 0) + s.x / c.n) AS rank FROM nodes n CROSS JOIN cnt c CROSS JOIN (SELECT coalesce(sum(rank), 0) AS x FROM r{i - 1} WHERE id NOT IN (SELECT id FROM outs)) s LEFT JOIN (SELECT w.dst AS id, sum(w.w * r.rank) AS x FROM flows w JOIN r{i - 1} r ON r.id = w.src GROUP BY w.dst) f ON f.id = n.id)")
    return f"""WITH {KEYS}, cnt AS (SELECT count(*) AS n FROM nodes), outs AS (SELECT src AS id, count(*) AS o FROM edges GROUP BY src),
flows AS MATERIALIZED (SELECT src, dst, count(*) / max(o) AS w FROM edges JOIN outs ON outs.id = src WHERE src <> dst AND dst IN (SELECT id FROM nodes) AND src IN (SELECT id FROM nodes) GROUP BY src, dst),
r0 AS MATERIALIZED (SELECT id, 1.0 / (SELECT n FROM cnt) AS rank FROM nodes), {", ".join(steps)} SELECT id, round(CAST(rank AS DOUBLE), 8) AS rank FROM r{iterations}"""


KIND_LIST = KINDS
