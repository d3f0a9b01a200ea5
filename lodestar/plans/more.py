"""Queries over code, scalars, whole indexes, exports and ingestion, with their SQL."""

from __future__ import annotations

import subprocess
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.checkpoints import cut, ensure_dir
from lodestar.functions import languages
from lodestar.functions import text as T
from lodestar.operators import commits, context, corpus, extraction, graph, memory, resolve, search
from lodestar.plans import sql as S
from lodestar.plans.registry import QUERY, drained, files_of, keys_of, log_of, query, spread, symbols_of
from lodestar.plans.sources import SOURCES, TOKENS
from lodestar.sources import config, index_store, repository
from lodestar.streaming import memory_stream
from lodestar.tables import table

KEY = "@K@"


def values(rows) -> str:
    """Literal rows of SQL."""
    def one(x) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def of_parts(columns: str, rows, select: str) -> str:
    """For each part, literal rows with its key put in."""
    return f"WITH facts({columns}) AS (VALUES {values(rows)}), k AS (SELECT CAST(p_partkey AS VARCHAR) AS k FROM part) SELECT {select} FROM facts CROSS JOIN k"


def put(*names: str) -> str:
    return ", ".join(f"replace({n}, '{KEY}', k) AS {n}" for n in names)


def code_of(spark: SparkSession, d: str) -> DataFrame:
    """Files of source code: one of each language for each part."""
    known = spark.createDataFrame([(lang, s.path, s.text) for lang, s in SOURCES.items()], "language string, path string, text string")
    files = spread(table(spark, d, "part")).select(F.col("p_partkey").cast("string").alias("k")).crossJoin(F.broadcast(known))  # a row a language
    return corpus.with_places(files.select(*(F.replace(c, F.lit(KEY), "k").alias(c) for c in ("path", "text")), "language"))


# --- code -----------------------------------------------------------------------------------


@query(of_parts("path, ord, name, kind, line", [(s.path, i, *x) for s in SOURCES.values() for i, x in enumerate(s.symbols)], f"{put('path', 'name')}, ord, kind, line"))
def code_symbols(spark, d):
    return extraction.declared(code_of(spark, d)).select("path", "name", "ord", "kind", "line")


@query(of_parts("path, ord, target, source", [(s.path, i, *x) for s in SOURCES.values() for i, x in enumerate(s.imports)], f"{put('path', 'target', 'source')}, ord"))
def code_imports(spark, d):
    return extraction.imported(code_of(spark, d)).select("path", "target", "source", "ord")


@query(of_parts("path, ident, keyword, number, string, punct, comment, docstring", [(SOURCES[lang].path, *n) for lang, n in TOKENS.items()], f"{put('path')}, ident, keyword, number, string, punct, comment, docstring, ident + keyword + number + string + punct AS code"))
def code_tokens(spark, d):
    files = code_of(spark, d).where(F.col("language").isin(*TOKENS))
    return extraction.token_stats(extraction.tokens(files))


LINE = "x@K@ = f('a', 0x7F)  # end"
PLACED = (("ident", "x@K@", 0), ("punct", "=", None), ("ident", "f", None), ("punct", "(", None), ("string", "'a'", None), ("punct", ",", None), ("number", "0x7F", None), ("punct", ")", None), ("comment", "# end", None))


@query(
    f"WITH t AS (SELECT p_partkey AS k, replace('{LINE.replace(chr(39), chr(39) * 2)}', '{KEY}', CAST(p_partkey AS VARCHAR)) AS text FROM part), facts(pos, kind, value) AS (VALUES {values((i, kind, v) for i, (kind, v, _) in enumerate(PLACED))}) "
    f"SELECT concat('f', k) AS path, CAST(pos AS INT) AS pos, kind, replace(value, '{KEY}', CAST(k AS VARCHAR)) AS value, CAST(1 AS INT) AS line, CAST(strpos(text, replace(value, '{KEY}', CAST(k AS VARCHAR))) AS INT) AS col, CAST(strpos(text, replace(value, '{KEY}', CAST(k AS VARCHAR))) - 1 AS INT) AS \"offset\" FROM t CROSS JOIN facts"
)
def lex_places(spark, d):
    rows = spread(table(spark, d, "part")).select(F.concat(F.lit("f"), "p_partkey").alias("path"), F.lit("python").alias("language"), F.replace(F.lit(LINE), F.lit(KEY), F.col("p_partkey").cast("string")).alias("text"))
    return extraction.tokens(rows)


@query("WITH t AS (SELECT p_partkey, p_name FROM part), f(level, line, name) AS (VALUES (1, 1, ''), (2, 3, ' details'), (4, 5, ' end')) SELECT concat('p', p_partkey) AS path, CAST(line AS INT) AS line, CAST(level AS INT) AS level, concat(p_name, name) AS name FROM t CROSS JOIN f")
def markdown_headings(spark, d):
    name = F.col("p_name")
    text = F.concat(F.lit("# "), name, F.lit("\n#none\n##  "), name, F.lit(" details\n##### five\n####\t"), name, F.lit(" end\n"))
    return corpus.headings(table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("path"), text.alias("text")))


ENDS = [(".py", "python"), (".TSX", "typescript"), (".h++", "cpp"), (".rs", "rust"), (".go", "go"), (".rb", "ruby"), (".sh", "shell"), (".md", "markdown"), (".toml", "toml"), (".xyz", None), ("", None), ("/Makefile", "makefile"), ("/Dockerfile", "dockerfile"), ("/.rs", None)]


@query(f"WITH f(i, ending, language) AS (VALUES {values((i, *x) for i, x in enumerate(ENDS))}) SELECT concat('a.b/c', p_partkey, ending) AS path, language FROM part JOIN f ON i = p_partkey % {len(ENDS)}")
def language_of_path(spark, d):
    ending = F.element_at(F.array(*(F.lit(e) for e, _ in ENDS)), (F.col("p_partkey") % len(ENDS) + 1).cast("int"))
    return table(spark, d, "part").select(F.concat(F.lit("a.b/c"), "p_partkey", ending).alias("path")).select("path", languages.classify(F.col("path")).alias("language"))


@query(f"SELECT * FROM (VALUES {values([('rust, nope', 'rust'), ('auto', ' '.join(sorted('python javascript typescript rust c cpp java go ruby shell json yaml toml markdown html css sql dockerfile makefile'.split())))])}) AS t(wanted, known)")
def languages_wanted(spark, d):
    rows = [(w, " ".join(languages.resolve(w.split(",")))) for w in ("rust, nope", "auto")]
    return spark.createDataFrame(rows, "wanted string, known string")


@query(
    "WITH l AS (SELECT concat('src/p', page_id, '.', e) AS path, CAST(o AS INT) AS ord, language, target, concat('lib/', lower(target), '.', x) AS dst FROM (SELECT DISTINCT page_id, h AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) AS h FROM pages) WHERE regexp_full_match(h, '[A-Za-z]+')), (VALUES (0, 'typescript', 'ts', 'ts'), (1, 'rust', 'rs', 'rs'), (2, 'c', 'c', 'h'), (3, 'ruby', 'rb', 'rb'), (4, 'go', 'go', 'go'), (5, 'java', 'java', 'java')) AS v(o, language, e, x)) SELECT path AS src, ord, target, dst FROM l"
)
def import_resolve_languages(spark, d):
    """Relative paths, crates, headers, packages and dotted names, in six languages."""
    targets = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("target")).where(F.col("target").rlike("^[A-Za-z]+$")).distinct()
    low = F.lower("target")
    how = {"typescript": ("ts", "ts", F.concat(F.lit("../lib/"), low)), "rust": ("rs", "rs", F.concat(F.lit("crate::lib::"), low)), "c": ("c", "h", F.concat(F.lit("lib/"), low, F.lit(".h"))), "ruby": ("rb", "rb", F.concat(F.lit("lib/"), low)), "go": ("go", "go", F.concat(F.lit("shop/lib/"), low)), "java": ("java", "java", F.concat(F.lit("lib."), low))}
    imports = files = None
    for i, (lang, (own, end, source)) in enumerate(how.items()):
        rows = targets.select(F.concat(F.lit("src/p"), "page_id", F.lit(f".{own}")).alias("path"), F.lit(i).alias("ord"), F.lit(lang).alias("language"), "target", source.alias("source"))
        some = targets.select(F.concat(F.lit("lib/"), low, F.lit(f".{end}")).alias("path")).distinct()
        imports, files = (rows, some) if imports is None else (imports.unionByName(rows), files.unionByName(some))
    return resolve.imports_to_files(imports, files).select("src", "ord", "target", "dst")


# --- a whole index --------------------------------------------------------------------------


TINY = ("lib/box@K@.py", "class Box@K@:\n    def lid(self):\n        pass\n"), ("lib/use@K@.py", "from lib.box@K@ import Box@K@\nb = Box@K@()\n")
BUILT = (
    ("edge", "f:lib/box@K@.py", "s:lib/box@K@.py:Box@K@@1", "define"), ("edge", "f:lib/box@K@.py", "s:lib/box@K@.py:lid@2", "define"), ("edge", "s:lib/box@K@.py:Box@K@@1", "s:lib/box@K@.py:lid@2", "contains"),
    ("edge", "f:lib/use@K@.py", "f:lib/box@K@.py", "import"), ("edge", "f:lib/use@K@.py", "s:lib/box@K@.py:Box@K@@1", "ref"),
    ("file", "f:lib/box@K@.py", "lib/box@K@.py", None), ("file", "f:lib/use@K@.py", "lib/use@K@.py", None), ("symbol", "s:lib/box@K@.py:Box@K@@1", "Box@K@", None), ("symbol", "s:lib/box@K@.py:lid@2", "lid", None),
)


def tiny_files(spark, d) -> DataFrame:
    known = spark.createDataFrame(list(TINY), "path string, text string")
    rows = spread(table(spark, d, "part")).select(F.col("p_partkey").cast("string").alias("k")).crossJoin(F.broadcast(known))
    return corpus.with_places(rows.select(*(F.replace(c, F.lit(KEY), "k").alias(c) for c in ("path", "text")), F.lit("python").alias("language")))


def folder_of(spark) -> str:
    ensure_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/query-{uuid.uuid4().hex}"


def built(spark, d) -> dict[str, DataFrame]:
    """The index of two files a part, saved and loaded."""
    folder = folder_of(spark)
    index_store.save(corpus.build(tiny_files(spark, d)), folder)
    return index_store.load(spark, folder)


@query(of_parts("what, a, b, type", BUILT, f"what, {put('a', 'b')}, type"))
def index_build(spark, d):
    """Nodes and edges of an index that was built from files, saved, and loaded again."""
    index = built(spark, d)
    edges = index["edges"].select(F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b"), "type")
    return edges.unionByName(index["nodes"].select(F.col("kind").alias("what"), F.col("id").alias("a"), F.col("name").alias("b"), F.lit(None).cast("string").alias("type")))


@query("SELECT 'files' AS metric, 2 * count(*) AS value FROM part UNION ALL SELECT 'lines', 5 * count(*) FROM part UNION ALL SELECT 'bytes', CAST(sum(77 + 4 * length(CAST(p_partkey AS VARCHAR))) AS BIGINT) FROM part UNION ALL SELECT 'symbols', count(*) + 1 FROM part UNION ALL SELECT 'edges', 5 * count(*) FROM part UNION ALL SELECT 'language python', 2 * count(*) FROM part UNION ALL SELECT 'skipped size', 3")
def index_summary(spark, d):
    index = built(spark, d)
    skipped = spark.createDataFrame([("size", 3)], "reason string, files long")
    return corpus.index_summary(index["files"], index["symbols"], index["edges"], skipped)


@query("SELECT 0 AS part, 1 AS place, concat('| files | ', 2 * count(*), ' |') AS line FROM part UNION ALL SELECT 0, 2, concat('| lines | ', format('{:,}', 5 * count(*)), ' |') FROM part UNION ALL SELECT 0, 3, concat('| symbols | ', count(*) + 1, ' |') FROM part UNION ALL SELECT 0, 4, concat('| graph edges | ', 5 * count(*), ' |') FROM part UNION ALL SELECT 1, 1, concat('* python: ', 2 * count(*), ' files') FROM part UNION ALL SELECT 2, CAST(row_number() OVER (ORDER BY path) AS INT), concat('* `lid` (method) — `', path, '`') FROM (SELECT concat('lib/box', p_partkey, '.py') AS path FROM part ORDER BY path LIMIT 20)")
def index_summary_markdown(spark, d):
    # A box's lid is reached from its file and its class: each lid has the same, highest rank.
    index = built(spark, d)
    return corpus.summary_markdown(index["files"], index["symbols"], index["nodes"], index["edges"])


@query(of_parts("id, name", [("s:lib/box@K@.py:Box@K@@1", "Box@K@"), ("s:lib/box@K@.py:lid@2", "lid")], put("id", "name") + " ") + " WHERE k = '7' UNION ALL SELECT concat('s:lib/box', p_partkey, '.py:lid@2'), 'lid' FROM part")
def graph_lookups(spark, d):
    """The symbols of one file, and every node of one name."""
    index = built(spark, d)
    one = graph.symbols_of_file(index["nodes"], index["edges"], "lib/box7.py")
    return one.select("id", "name").unionByName(graph.by_name(index["nodes"], "lid", "symbol").select("id", "name"))


@query("SELECT concat('lib/use', p_partkey, '.py') AS path FROM part WHERE p_partkey IN (3, 5)")
def graph_ref_dependents(spark, d):
    """Dependents by references alone: a symbol's file stands for it."""
    refs = built(spark, d)["edges"].where("type = 'ref'").withColumn("ord", F.lit(0))
    return graph.dependents(refs, ["lib/box3.py", "lib/box5.py"], limit=None)


@query(f"WITH {S.FILES}, {S.TERMS}, {S.POSTINGS}, {S.STATS} SELECT path, round(CAST(sum(idf * tf) AS DOUBLE), 6) AS content FROM postings JOIN stats USING (term) WHERE term IN ({S.quoted(T.split_words_py(QUERY))}) GROUP BY path")
def search_postings(spark, d):
    """Content scores from postings that were saved and loaded."""
    files, folder = files_of(spark, d), folder_of(spark)
    n = files.count()
    index_store.save({"postings": corpus.postings(files), "terms": lambda saved: corpus.term_stats(saved("postings"), n)}, folder)
    index = index_store.load(spark, folder)
    return search.stored_scores(index["postings"], index["terms"], T.split_words_py(QUERY)).select("path", F.round("content", 6).alias("content"))


#: Pages under addresses of their own.
PAGES = r"""upages AS (SELECT page_id, concat(regexp_replace(url, '[?#].*$', ''), '/', page_id) AS url, html FROM pages), pfiles AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path, html AS text FROM upages)"""
SIGNALS = "on blog tion"


@query(
    f"""WITH {PAGES}, {S.SYMBOLS.replace('FROM pages', 'FROM upages')}, tw AS (SELECT path, {S.words("text")} AS w FROM pfiles), counts AS (SELECT path, term, count(*) AS cnt FROM (SELECT path, unnest(w) AS term FROM tw) GROUP BY ALL), postings AS (SELECT path, term, cnt / sum(cnt) OVER (PARTITION BY path) AS tf FROM counts),
stats AS (SELECT term, ln(1.0 + (SELECT count(*) FROM pfiles) / (1.0 + count(*))) AS idf FROM postings GROUP BY term), content AS (SELECT path, sum(idf * tf) AS content FROM postings JOIN stats USING (term) WHERE term IN ('blog', 'tion') GROUP BY path),
sym AS (SELECT DISTINCT path, 2.5 AS symbol FROM symbols WHERE contains(lower(name), 'blog') OR contains(lower(name), 'tion')),
named AS (SELECT path, list(name ORDER BY ord)[1:12] AS names FROM symbols GROUP BY path),
scored AS (SELECT path, round(CAST(coalesce(content, 0) + coalesce(symbol, 0) + CASE WHEN contains(lower(path), 'blog') THEN 1.2 ELSE 0 END + CASE WHEN contains('/' || lower(path) || '/', '/blog/') THEN 0.6 ELSE 0 END + CASE WHEN contains(lower(path), 'tion') THEN 1.2 ELSE 0 END + CASE WHEN contains('/' || lower(path) || '/', '/tion/') THEN 0.6 ELSE 0 END AS DOUBLE), 6) AS score, round(CAST(coalesce(symbol, 0) AS DOUBLE), 6) AS symbol FROM pfiles LEFT JOIN content USING (path) LEFT JOIN sym USING (path))
SELECT path, score, symbol, concat_ws(',', CASE WHEN list_contains(w, 'blog') THEN 'blog' END, CASE WHEN list_contains(w, 'tion') THEN 'tion' END) AS matches, coalesce(array_to_string(names, ','), '') AS symbols FROM (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, path LIMIT 30) JOIN tw USING (path) LEFT JOIN named USING (path)"""
)
def search_details(spark, d):
    """Content, path and symbol signals over pages, with what matched and which symbols a result has."""
    pages = table(spark, d, "pages").withColumn("url", F.concat_ws("/", F.regexp_replace("url", "[?#].*$", ""), "page_id"))
    files, symbols = spread(corpus.from_pages(pages), "path"), corpus.html_symbols(spread(pages))
    posts = cut(corpus.postings(files))
    found = search.search(files, SIGNALS, 30, symbols=symbols, signals=("content", "path", "symbol"), index=(posts, corpus.term_stats(posts, files.count())))
    out = search.details(found, posts, symbols, SIGNALS)
    return out.select("path", "score", "symbol", F.array_join("matches", ",").alias("matches"), F.array_join("symbols", ",").alias("symbols"))


# --- scalars --------------------------------------------------------------------------------


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN TRUE ELSE FALSE END AS unsafe, CASE WHEN page_id % 2 = 0 THEN concat('src/p', page_id) ELSE concat('/other/p', page_id) END AS relative, CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS INT) ELSE -1 END AS number, concat('first ', page_id) AS line FROM pages")
def path_scalars(spark, d):
    i = F.col("page_id")
    path = F.when(i % 4 == 0, F.concat(F.lit("/abs/"), i)).when(i % 4 == 1, F.concat(F.lit("a/../b"), i)).when(i % 4 == 2, F.concat(F.lit("C:\\x"), i)).otherwise(F.concat(F.lit("a/..b/c"), i))
    rooted = F.when(i % 2 == 0, F.concat(F.lit("/repo\\src/p"), i)).otherwise(F.concat(F.lit("/other/p"), i))
    number = F.when(i % 3 == 0, F.concat(F.lit(" "), i)).otherwise(F.concat(F.lit("x"), i))
    return table(spark, d, "pages").select("page_id", T.unsafe_path(path).alias("unsafe"), T.repo_relative(rooted, "/repo").alias("relative"), T.parse_int_or(number, -1).alias("number"), T.first_line(F.concat(F.lit("  first "), i, F.lit(" \nsecond"))).alias("line"))


# --- notes ----------------------------------------------------------------------------------


@query(f"SELECT conv_id, turn, substr(sha1(concat(trim(text), '{S.AS_OF}')), 1, 12) AS id, {S.kind('text')} AS kind, CAST(greatest(1, least(5, turn - 1)) AS INT) AS importance, concat(CASE WHEN role < 'b' THEN concat(role, ',b') ELSE concat('b,', role) END) AS tags, CAST({S.AS_OF} AS BIGINT) AS created_at FROM conversations")
def mem_new_entries(spark, d):
    c = spread(table(spark, d, "conversations"))
    rows = c.select(F.lit(None).cast("string").alias("kind"), "text", F.array(F.upper("role"), F.lit("b, B")).alias("tags"), F.concat_ws("/", "conv_id", "turn").alias("file"), F.lit(1).alias("line"), F.lit(None).cast("string").alias("source"), (F.col("turn") - 1).cast("int").alias("importance"), F.lit(None).cast("int").alias("ttl_days"), F.lit(None).cast("string").alias("link"))
    out = memory.new_entries(rows, S.AS_OF)
    place = F.split("file", "/")
    return out.select(place[0].cast("bigint").alias("conv_id"), place[1].cast("bigint").alias("turn"), "id", "kind", "importance", F.array_join("tags", ",").alias("tags"), "created_at")


@query(f"WITH {S.MEMORY} SELECT log_pos, to_json({{'id': id, 'kind': kind, 'importance': importance, 'created_at': created_at}}) AS json FROM memory")
def memory_json(spark, d):
    return memory.to_json(log_of(spark, d).select("log_pos", "id", "kind", "importance", "created_at"))


@query(f"SELECT 'memory' AS source, CAST(row_number() OVER (ORDER BY score DESC, created_at DESC) AS INT) AS place, id, score FROM ({S.recall(QUERY, 10)}) UNION ALL SELECT 'file', CAST(row_number() OVER (ORDER BY score DESC, path) AS INT), path, score FROM ({S.search(QUERY, 10, ('content',))})")
def recall_with_files(spark, d):
    found = search.search(files_of(spark, d), QUERY, 10, signals=("content",))
    return memory.recall_with_files(log_of(spark, d), S.AS_OF, QUERY, found)


_fold = "lambda a, x: CASE WHEN list_contains(a.tail, x.fp) THEN {'tail': a.tail, 'dup': list_append(a.dup, x.log_pos)} ELSE {'tail': list_append(a.tail, x.fp)[-20:], 'dup': a.dup} END"


@query(
    f"WITH {S.MEMORY}, o AS (SELECT tags[2] AS log, list({{'log_pos': log_pos, 'fp': fingerprint}} ORDER BY log_pos) AS l FROM memory GROUP BY ALL), f AS (SELECT log, l, list_reduce(l, {_fold}, {{'tail': CAST([] AS VARCHAR[]), 'dup': CAST([] AS BIGINT[])}}) AS r FROM o) SELECT log, unnest(r.dup) AS log_pos FROM f"
)
def mem_tail_dedupe(spark, d):
    """Entries whose text is among the twenty kept before them in their log."""
    rows = log_of(spark, d).withColumn("log", F.element_at("tags", -1))
    return memory.tail_duplicates(rows.select("log", "log_pos", "fingerprint"), window=20).where("duplicate").select("log", "log_pos")


def json_log(spark, d) -> str:
    """The log's first fields as files of JSON lines."""
    folder = folder_of(spark)
    memory.append(log_of(spark, d).select("id", "text", "created_at", F.when(F.col("log_pos") % 2 == 0, F.col("kind")).alias("kind"), F.when(F.col("log_pos") % 3 == 0, F.lit(9)).alias("importance")), folder)
    return folder


@query(f"WITH {S.MEMORY} SELECT id, CASE WHEN log_pos % 2 = 0 THEN kind ELSE 'note' END AS kind, CASE WHEN log_pos % 3 = 0 THEN 5 ELSE 3 END AS importance, fingerprint FROM memory")
def memory_read(spark, d):
    """A log appended to and read back, with its defaults and bounds."""
    return memory.read(spark, json_log(spark, d)).select("id", "kind", F.col("importance").cast("int").alias("importance"), "fingerprint")


@query("SELECT count(*) AS n FROM documents")
def memory_count(spark, d):
    return spark.range(1).select(F.lit(memory.count(spark, json_log(spark, d))).cast("bigint").alias("n"))


# --- graphs ---------------------------------------------------------------------------------


@query("SELECT concat('u', user_id) AS id, arg_min(event_type, event_id) AS kind, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id")
def graph_merge_nodes(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("ord"), F.concat(F.lit("u"), "user_id").alias("id"), F.col("event_type").alias("kind"), F.create_map(F.lit("last"), F.col("event_type")).alias("attrs"))
    return graph.merge_nodes(rows).select("id", "kind", F.col("attrs")["last"].alias("last"))


@query("SELECT concat('u', user_id) AS src, event_type AS dst, 'did' AS type, min(event_id) AS ord FROM events GROUP BY ALL")
def graph_distinct_edges(spark, d):
    return graph.distinct_edges(table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("src"), F.col("event_type").alias("dst"), F.lit("did").alias("type"), F.col("event_id").alias("ord")))


@query(f"WITH {S.KEYS} SELECT dst AS id, type, 'out' AS direction FROM edges WHERE src = 'n:3' UNION ALL SELECT src, type, 'in' FROM edges WHERE dst = 'n:3'")
def graph_neighbors(spark, d):
    return graph.neighbors(keys_of(spark, d)[1], "n:3")


@query(f"SELECT id, rank FROM ({S.page_rank(15)}) ORDER BY rank DESC, id LIMIT 10")
def graph_top_ranks(spark, d):
    return graph.top_ranks(*keys_of(spark, d)).select("id", F.round("rank", 8).alias("rank"))


@query(f"WITH RECURSIVE {S.KEYS}, r AS (SELECT id, id AS c FROM nodes WHERE id LIKE 'r:%' UNION SELECT a.b, r.c FROM r JOIN around a ON a.a = r.id), l AS (SELECT c, min(id) AS component FROM r GROUP BY c) SELECT component, count(DISTINCT r.id) AS size, array_to_string(list_sort(list(DISTINCT r.id))[1:8], ',') AS members FROM r JOIN l USING (c) GROUP BY component ORDER BY size DESC, component LIMIT 10")
def graph_top_components(spark, d):
    return graph.largest_components(*keys_of(spark, d)).select("component", "size", F.array_join("members", ",").alias("members"))


# --- context --------------------------------------------------------------------------------


@query(f"WITH {S.SYMBOLS} SELECT path, ord, name, round(CASE WHEN contains(lower(name), 'tion') THEN 2.0 ELSE 0 END + CASE WHEN starts_with(lower(name), 'tion') THEN 1.0 ELSE 0 END + 1.5 * (length(path) % 7) / 8.0, 6) AS score FROM symbols WHERE contains(lower(name), 'tion') ORDER BY score DESC, path, ord LIMIT 25")
def symbols_interesting(spark, d):
    symbols = symbols_of(spark, d)
    ranks = symbols.select(graph.symbol_id(F.col("path"), F.col("name"), F.col("line")).alias("id"), (F.length("path") % 7 / 8.0).alias("rank")).distinct()
    return context.interesting(symbols, ranks, "tion").select("path", "ord", "name", "score")


_blocks = "lambda a, x: CASE WHEN a.used + x.cost <= 3000 THEN {'used': a.used + x.cost, 'kept': list_append(a.kept, x.t)} ELSE a END"


@query(
    f"WITH {S.FILES}, p AS (SELECT doc_id, path, text, lines AS n, string_split(text, chr(10)) AS l FROM files), s AS (SELECT doc_id, concat(path, '#L2', chr(10), array_to_string(l[2:least(n, 8)], chr(10))) AS t FROM p WHERE n >= 2), "
    f"o AS (SELECT list({{'t': t, 'cost': CAST(length(t) AS BIGINT)}} ORDER BY doc_id) AS l FROM s), f AS (SELECT list_reduce(l, {_blocks}, {{'used': CAST(0 AS BIGINT), 'kept': CAST([] AS VARCHAR[])}}) AS r FROM o) SELECT array_to_string(r.kept, chr(10)) AS body FROM f"
)
def context_snippets(spark, d):
    """One snippet a path, the first place of several, within 3000 characters."""
    files = files_of(spark, d)
    ids = F.regexp_extract("path", "([0-9]+)[.]txt$", 1).cast("bigint")
    first = files.select(ids.alias("ord"), "path", F.lit(3).alias("line"))
    return context.snippet_block(files, first.unionByName(first.select((F.col("ord") + 10**9).alias("ord"), "path", F.lit(1).alias("line"))))


# --- scans ----------------------------------------------------------------------------------


def repository_of(spark, d) -> str:
    """A folder with a few files for each nation, as a repository: small, so the driver writes it."""
    folder = folder_of(spark)
    root = Path(folder.removeprefix("file:"))
    root.mkdir(parents=True)
    (root / ".gitignore").write_text("*.log\n/build/\n")
    for r in table(spark, d, "nation").collect():
        k, name = r["n_nationkey"], r["n_name"]
        at = root / f"r{r['n_regionkey']}"
        at.mkdir(exist_ok=True)
        (at / f"n{k}.py").write_bytes(b"\xef\xbb\xbf" + f"NAME = '{name}'\n".encode())
        (at / f"n{k}.md").write_bytes(f"# {name} é\n".encode("utf-8" if k % 2 else "latin-1"))
        (at / f"n{k}.log").write_text("gone\n")
        (at / f"n{k}.bin").write_bytes(b"\x00\x01" + name.encode())
        (at / f".hidden{k}").write_text("h\n")
        if k % 5 == 0:
            (at / f"large{k}.py").write_text("x" * 3000)
            (root / "build").mkdir(exist_ok=True)
            (root / "build" / f"b{k}.py").write_text("y\n")
    return str(root)


@query("SELECT concat('r', n_regionkey, '/n', n_nationkey, e) AS path, language, replace(t, '@', n_name) AS text, CAST(length(replace(t, '@', n_name)) - length(replace(replace(t, '@', n_name), chr(10), '')) AS BIGINT) AS lines FROM nation, (VALUES ('.py', 'python', concat('NAME = ''@''', chr(10))), ('.md', 'markdown', concat('# @ é', chr(10)))) AS f(e, language, t)")
def repo_scan(spark, d):
    """Files of a folder, decoded by their marks, without hidden, ignored, binary and large ones."""
    files, _ = repository.scan(spark, repository_of(spark, d), max_bytes=2000)
    return files.select("path", "language", "text", F.col("lines").cast("bigint").alias("lines"))


@query("SELECT 'hidden' AS reason, count(*) + 1 AS files FROM nation UNION ALL SELECT 'ignored', count(*) + count(*) FILTER (n_nationkey % 5 = 0) FROM nation UNION ALL SELECT 'binary', count(*) FROM nation UNION ALL SELECT 'size', count(*) FROM nation WHERE n_nationkey % 5 = 0")
def repo_skipped(spark, d):
    return repository.scan(spark, repository_of(spark, d), max_bytes=2000)[1]


@query("SELECT concat('n', n_nationkey, '.txt') AS path, CAST(1700000000 + n_nationkey AS BIGINT) AS ts, concat('add ', n_name) AS subject FROM nation")
def repo_history(spark, d):
    """Commits of a repository joined to the files that they changed."""
    root = Path(folder_of(spark).removeprefix("file:"))
    root.mkdir(parents=True)

    def git(*args: str, at: int = 0) -> None:
        when = {"GIT_AUTHOR_DATE": f"{at} +0000", "GIT_COMMITTER_DATE": f"{at} +0000", "PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(root)}
        subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@example.com", *args], check=True, capture_output=True, env=when)

    git("init")
    for r in table(spark, d, "nation").orderBy("n_nationkey").collect():
        (root / f"n{r['n_nationkey']}.txt").write_text(r["n_name"])
        git("add", "-A")
        git("commit", "-m", f"add {r['n_name']}", at=1_700_000_000 + r["n_nationkey"])
    subjects = commits.parse_log(repository.git_log(spark, str(root))).select("hash", "subject")
    return commits.parse_files(repository.git_files(spark, str(root))).join(subjects, "hash").select("path", "ts", "subject")


@query("SELECT * FROM (VALUES ('index_depth', '4'), ('ttl task', '5'), ('ttl tip', '365'), ('web_port', '8765'), ('unknown', 'refused')) AS t(setting, value)")
def config_merged(spark, d):
    """The user's settings under the repository's, objects key by key; a setting that isn't known is refused."""
    root = Path(folder_of(spark).removeprefix("file:"))
    root.mkdir(parents=True)
    for name, text in (("user", '{"index_depth": 3, "ttl_days": {"task": 5}}'), ("repo", '{"index_depth": 4}'), ("bad", '{"depth": 1}')):
        (root / name).write_text(text)
    c = config.Config.load(str(root / "user"), str(root / "repo"), str(root / "none"))
    try:
        config.Config.load(str(root / "bad"))
        unknown = "taken"
    except ValueError:
        unknown = "refused"
    return spark.createDataFrame([("index_depth", str(c.index_depth)), ("ttl task", str(c.ttl_days["task"])), ("ttl tip", str(c.ttl_days["tip"])), ("web_port", str(c.web_port)), ("unknown", unknown)], "setting string, value string")


# --- streams --------------------------------------------------------------------------------


@query(f"WITH {S.MEMORY} SELECT id, CASE WHEN log_pos % 2 = 0 THEN kind ELSE 'note' END AS kind, fingerprint FROM memory")
def stream_ingest(spark, d):
    """A log of JSON lines read as a stream, and appended to a log of Parquet files."""
    return drained(spark, memory_stream.read(spark, json_log(spark, d)).select("id", "kind", "fingerprint"))


@query("SELECT user_id AS log, arg_min(event_id, event_id) AS first, event_type AS fingerprint FROM events GROUP BY user_id, event_type")
def stream_tail_dedupe(spark, d):
    """The first of each user's events of a type: types are fewer than the tail is long."""
    e = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    rows = e.select(F.col("user_id").cast("string").alias("log"), F.col("event_id").alias("log_pos"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("fingerprint"))
    out = drained(spark, memory_stream.without_tail_duplicates(rows))
    return out.select(F.col("log").cast("bigint").alias("log"), F.col("id").cast("bigint").alias("first"), "fingerprint")


def epoch_of(ts: str) -> Column:
    """Seconds of the epoch to the nearest whole one, halves to the even one, as SQL casts them."""
    return F.bround(F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})") / F.lit(1e6)).cast("bigint")


@query("WITH m AS (SELECT CAST(max(epoch(ts)) AS BIGINT) AS last FROM events) SELECT event_id FROM events, m WHERE CAST(epoch(ts) AS BIGINT) >= last - 86400")
def stream_late(spark, d):
    """Entries that come after the watermark has passed them are dropped: a second batch holds all events, a first one the last day's."""
    events = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.lit("t").alias("text"), F.lit("note").alias("kind"), epoch_of("ts").alias("created_at"))
    last = events.agg(F.max("created_at")).first()[0]
    folder = folder_of(spark)
    events.where(F.col("created_at") >= last - 86400).coalesce(1).write.json(f"{folder}/in/a")
    rows = memory_stream.read(spark, f"{folder}/in/*", "1 day").dropDuplicatesWithinWatermark(["id"]).select("id")

    def run() -> None:
        rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()

    run()
    events.coalesce(1).write.json(f"{folder}/in/b")
    run()
    return spark.read.parquet(f"{folder}/out").select(F.col("id").cast("bigint").alias("event_id"))
