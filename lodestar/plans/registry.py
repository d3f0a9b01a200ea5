"""All queries by name, each with the SQL that gives the same rows where there is any."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DatetimeType, NumericType

from lodestar.checkpoints import ensure_dir
from lodestar.functions import text as T
from lodestar.operators import commits, context, corpus, extraction, graph, ignore, memory, resolve, search
from lodestar.plans import sql as S
from lodestar.streaming import memory_stream
from lodestar.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The corpora's texts are invented; these words occur in them.
QUERY = "rest inter onder"


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


#: Rows of a task: few up to so many partitions as a shuffle writes without sorting, then more.
FEW_ROWS, UNSORTED, MANY_ROWS = 2_000, 200, 20_000


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows over all cores, and over more partitions as a table grows: a file may be one row group, which one task would read and tokenise alone.

    Dealt by the columns ``by``, or by all that aren't texts: to deal rows in turn Spark would
    first sort all rows of a file in one task, with its texts in memory.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    rows = df.select().count()  # from the files' footers
    n = max(min(UNSORTED - cores, rows // FEW_ROWS), rows // MANY_ROWS)
    n = (n // cores + 1) * cores  # whole rounds of tasks
    keys = by or [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType | DatetimeType)]
    return df.repartition(n, *keys)


def files_of(spark: SparkSession, d: str) -> DataFrame:
    return spread(corpus.from_documents(table(spark, d, "documents")), "path")


def symbols_of(spark: SparkSession, d: str) -> DataFrame:
    return corpus.html_symbols(table(spark, d, "pages"))


def log_of(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a memory log."""
    docs = spread(table(spark, d, "documents"))
    i = F.col("doc_id")
    return docs.select(
        i.alias("log_pos"), T.short_hash(i.cast("string"), 12).alias("id"), T.autocategorize("text").alias("kind"), "text", F.array_sort(F.array("lang", "source")).alias("tags"),
        F.when(i % 3 == 0, F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), i, F.lit(".txt"))).alias("file"), (i % 100 + 1).cast("int").alias("line"), (1 + i % 5).cast("int").alias("importance"),
        F.when(i % 7 == 0, 10).alias("ttl_days"), (F.lit(S.AS_OF) - (i * 3571) % (900 * 86400)).cast("bigint").alias("created_at"), T.fingerprint("text").alias("fingerprint"), F.lit(None).cast("bigint").alias("updated_at"),
    )


def keys_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return graph.from_keys(*(table(spark, d, t) for t in ("region", "nation", "supplier", "customer")))


# --- corpus ---------------------------------------------------------------------------------


@query(f"WITH {S.FILES}, {S.TERMS}, {S.POSTINGS} SELECT path, term, cnt, round(tf, 8) AS tf FROM postings")
def terms_tf(spark, d):
    return corpus.postings(files_of(spark, d)).select("path", "term", "cnt", F.round("tf", 8).alias("tf"))


@query(f"WITH {S.FILES}, {S.TERMS}, {S.POSTINGS}, {S.STATS} SELECT term, df, round(idf, 8) AS idf FROM stats")
def term_idf(spark, d):
    files = files_of(spark, d)
    posts = corpus.terms(files).distinct()
    return corpus.term_stats(posts, files.count()).select("term", "df", F.round("idf", 8).alias("idf"))


@query(f"WITH {S.FILES}, {S.TERMS}, {S.POSTINGS}, {S.SYMBOLS} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(DISTINCT term) FROM postings) AS unique_terms, (SELECT count(*) FROM postings) AS postings, (SELECT count(DISTINCT name) FROM symbols) AS symbols")
def corpus_stats(spark, d):
    return search.stats(files_of(spark, d), symbols_of(spark, d))


@query(f"WITH {S.FILES} SELECT count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT language) AS languages FROM files")
def files_summary(spark, d):
    return corpus.summary(files_of(spark, d))


@query(f"WITH {S.FILES} SELECT language, count(*) AS files FROM files GROUP BY language")
def language_counts(spark, d):
    return corpus.language_counts(files_of(spark, d))


@query(f"WITH {S.FILES} SELECT path, language, lines, size FROM files ORDER BY size DESC, path LIMIT 6")
def largest_files(spark, d):
    return corpus.largest(files_of(spark, d))


@query(r"WITH p AS (SELECT page_id, regexp_extract_all(html, '<h1>([^<]*)</h1>', 1) AS h FROM pages) SELECT page_id, unnest(h) AS name FROM p")
def headings(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<h1>([^<]*)</h1>"), F.lit(1))).alias("name"))


# --- scalars --------------------------------------------------------------------------------


@query(f"SELECT doc_id, {S.fingerprint('text')} AS fp, substr(sha1(text), 1, 8) AS h FROM documents")
def fingerprint(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", T.fingerprint("text").alias("fp"), T.short_hash("text").alias("h"))


_joined = f"array_to_string({S.words('text')}, '')"


@query(f"WITH j AS (SELECT doc_id, {_joined} AS t, len({S.words('text')}) AS n FROM documents) SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, rpad(substr(t, unnest(range(1, greatest(length(t) - 2, 1) + 1)), 3), 3, ' ') AS g FROM j WHERE n > 0) GROUP BY ALL")
def trigrams(spark, d):
    docs = spread(table(spark, d, "documents")).select("doc_id", F.array_join(T.split_words("text"), "").alias("t"))
    padded = docs.select("doc_id", F.when(F.col("t") == "", "").otherwise(F.rpad("t", F.greatest(F.length("t"), F.lit(3)), F.lit(" "))).alias("t"))
    pieces = padded.select("doc_id", F.explode(T.gram_pieces("t", 3)).alias("p"))
    # Pieces are short, so that a gram is cut out by its place at once.
    places = pieces.where(F.length("p") > 2).select("doc_id", "p", F.explode(F.sequence(F.lit(1), F.length("p") - 2)).alias("i"))
    return places.select("doc_id", F.substr("p", "i", F.lit(3)).alias("g")).groupBy("doc_id", "g").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, {S.tokens('text')} AS tokens, {S.lines('text')} AS lines FROM documents")
def token_estimate(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", T.estimate_tokens("text").alias("tokens"), T.line_count("text").alias("lines"))


@query(r"SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.:/-]', '_', 'g') AS safe, concat_ws('::', page_id, url) AS skey, CASE WHEN length(url) > 24 THEN concat(substr(url, 1, 23), '…') ELSE url END AS short FROM pages")
def safe_names(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_name("url").alias("safe"), T.stable_key(F.col("page_id").cast("string"), "url").alias("skey"), T.truncate("url", 24).alias("short"))


@query(f"WITH {S.MEMORY} SELECT log_pos, {S.ago('created_at')} AS ago, strftime(make_timestamp(created_at * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM memory")
def time_ago(spark, d):
    return log_of(spark, d).select("log_pos", T.time_ago("created_at", S.AS_OF).alias("ago"), T.iso("created_at").alias("iso"))


@query("SELECT doc_id, CASE WHEN s < 1024 THEN concat(s, ' B') WHEN s < 1048576 THEN printf('%.1f KB', s / 1024.0) ELSE printf('%.1f MB', s / 1048576.0) END AS size, format('{:,}', s) AS n FROM (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS s FROM documents)")
def human_bytes(spark, d):
    s = F.octet_length("text").cast("bigint")
    return table(spark, d, "documents").select("doc_id", T.human_bytes(s).alias("size"), T.human_count(s).alias("n"))


@query(f"WITH {S.FILES} SELECT path, CAST(row_number() OVER (ORDER BY d1, d2, doc_id) AS INT) AS place FROM files ")
def natural_sort(spark, d):
    rows = files_of(spark, d).select("path", "dir", T.natural_key("name").alias("key"))
    return corpus.placed(rows, F.element_at("dir", 1), F.element_at("dir", 2), "key").select("path", F.col("place").cast("int").alias("place"))


# --- search ---------------------------------------------------------------------------------


@query(S.search(QUERY, 20, ("content",)))
def search_content(spark, d):
    return search.search(files_of(spark, d), QUERY, 20, signals=("content",))


@query(S.search("src1 doc", 20, ("path",)))
def search_path(spark, d):
    return search.search(files_of(spark, d), "src1 doc", 20, signals=("path",))


@query(S.search(QUERY, 20, ("fuzzy",)))
def search_fuzzy(spark, d):
    return search.search(files_of(spark, d), QUERY, 20, signals=("fuzzy",))


@query(S.search("src1 " + QUERY, 20, ("content", "path", "fuzzy")))
def search_hybrid(spark, d):
    return search.search(files_of(spark, d), "src1 " + QUERY, 20)


@query(S.search(QUERY, 10, ("content", "path", "fuzzy"), "language = 'en' AND starts_with(path, 'src3/')"))
def search_filtered(spark, d):
    return search.search(files_of(spark, d), QUERY, 10, language="en", path_prefix="src3")


@query(f"WITH {S.FILES} SELECT path, 0.0::DOUBLE AS score, 0.0::DOUBLE AS content, 0.0::DOUBLE AS path_score, 0.0::DOUBLE AS symbol, 0.0::DOUBLE AS fuzzy FROM files ORDER BY d1, d2, name LIMIT 10")
def search_empty(spark, d):
    return search.search(files_of(spark, d), "", 10)


@query(f"WITH {S.SYMBOLS} SELECT path, 2.5::DOUBLE AS symbol FROM symbols WHERE contains(lower(name), 'tion') OR contains(lower(name), 'elle') GROUP BY path")
def search_symbol(spark, d):
    return search.symbol_scores(symbols_of(spark, d), ["tion", "elle"])


@query(f"WITH {S.SYMBOLS} SELECT path, ord, name FROM symbols WHERE name = (SELECT min(name) FROM symbols)")
def symbol_exact(spark, d):
    symbols = symbols_of(spark, d)
    name = symbols.agg(F.min("name")).first()[0]
    return search.lookup_symbol(symbols, name).select("path", "ord", "name")


@query(
    f"WITH {S.SYMBOLS}, hits AS (SELECT * FROM symbols WHERE contains(lower(name), 'on')), names AS (SELECT name, min((dir, path, ord)) AS first, least(count(*), 6) AS take FROM hits GROUP BY name), "
    "cum AS (SELECT *, coalesce(sum(take) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM names), picked AS (SELECT h.*, first, take, row_number() OVER (PARTITION BY name ORDER BY h.dir, h.path, h.ord) AS k FROM hits h JOIN cum USING (name) WHERE before < 20) "
    "SELECT path, ord, name FROM picked WHERE k <= take ORDER BY first, k LIMIT 40"
)
def symbol_fuzzy(spark, d):
    return search.lookup_symbol(symbols_of(spark, d), "on", fuzzy=True).select("path", "ord", "name")


@query(
    f"WITH {S.SYMBOLS}, k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY dir, path, ord) AS k FROM symbols), s AS (SELECT *, CASE WHEN contains(lower(name), 'on') THEN 3.0 ELSE 0 END + CASE WHEN starts_with(lower(name), 'on') THEN 1.0 ELSE 0 END + CASE WHEN contains(lower(name), 'blog') THEN 3.0 ELSE 0 END + CASE WHEN starts_with(lower(name), 'blog') THEN 1.0 ELSE 0 END "
    "+ sum(CASE WHEN k <= 3 THEN CASE WHEN contains(lower(path), 'blog') THEN 0.8 ELSE 0 END + CASE WHEN contains(lower(path), 'on') THEN 0.8 ELSE 0 END ELSE 0 END) OVER (PARTITION BY name) AS v FROM k) "
    "SELECT name, path, ord, round(CAST(v AS DOUBLE), 6) AS score FROM s WHERE v > 0 ORDER BY score DESC, path, ord LIMIT 15".replace("contains(lower(name), 'on')", "FALSE").replace("starts_with(lower(name), 'on')", "FALSE").replace("contains(lower(path), 'on')", "FALSE")
)
def symbol_search(spark, d):
    # "on" is a stopword: only "blog" counts.
    return search.search_symbols(symbols_of(spark, d), "blog on").select("name", "path", "ord", "score")


# --- memory ---------------------------------------------------------------------------------


@query(f"SELECT conv_id, turn, {S.kind('text')} AS kind FROM conversations")
def mem_autocategorize(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.autocategorize("text").alias("kind"))


@query("SELECT event_id, concat(lower(event_type), ',', user_id) AS tags FROM events")
def mem_tags(spark, d):
    e = table(spark, d, "events").select("event_id", T.normalize_tags(F.array(F.concat("event_type", F.lit(", "), F.upper("event_type")), F.col("user_id").cast("string"))).alias("t"))
    return e.select("event_id", F.array_join("t", ",").alias("tags"))


@query(f"WITH {S.MEMORY}, k AS (SELECT unnest([{S.quoted(S.KIND_LIST)}]) AS kind) SELECT k.kind, CAST(count(m.id) AS BIGINT) AS n FROM k LEFT JOIN memory m ON m.kind = k.kind GROUP BY k.kind UNION ALL SELECT 'total', count(*) FROM memory")
def mem_stats(spark, d):
    return memory.stats(log_of(spark, d))


RECALLED = ("id", "kind", "created_at", "score")


@query(S.recall(QUERY, 20))
def mem_recall_query(spark, d):
    return memory.recall(log_of(spark, d), S.AS_OF, QUERY).select(*RECALLED)


@query(S.recall(None, 20))
def mem_recall_list(spark, d):
    return memory.recall(log_of(spark, d), S.AS_OF).select(*RECALLED)


@query(S.recall("rest", 15, "list_contains(tags, 'en') AND contains(file, 'src3')", file=True))
def mem_recall_filtered(spark, d):
    return memory.recall(log_of(spark, d), S.AS_OF, "rest", tag="en", file="src3", limit=15).select(*RECALLED)


@query(f"WITH {S.MEMORY} SELECT id FROM memory WHERE NOT {S.EXPIRED}")
def mem_gc_ttl(spark, d):
    return log_of(spark, d).where(~memory.expired(S.AS_OF)).select("id")


@query(S.gc("SELECT id, fate, array_to_string(CASE WHEN fate = 'kept' THEN all_tags ELSE tags END, ',') AS tags"))
def mem_gc_dedupe(spark, d):
    return memory.gc_flags(log_of(spark, d), S.AS_OF).select("id", "fate", F.array_join("tags", ",").alias("tags"))


@query(S.gc("SELECT id, importance", 300, "WHERE fate = 'kept'"))
def mem_gc_cap(spark, d):
    return memory.gc(log_of(spark, d), S.AS_OF, hard_cap=300).select("id", "importance")


@query(S.gc("SELECT count(*) AS before, count(*) FILTER (fate = 'kept') AS after, count(*) FILTER (fate = 'expired') AS expired, count(*) FILTER (fate IN ('duplicate', 'evicted')) AS deduped", 300))
def mem_gc_report(spark, d):
    return memory.gc_report(log_of(spark, d), S.AS_OF, hard_cap=300)


@query()
def mem_add_tail_dedupe(spark, d):
    rows = log_of(spark, d).withColumn("log", F.element_at("tags", -1))
    return memory.tail_duplicates(rows.select("log", "log_pos", "fingerprint"), window=200)


@query(f"WITH {S.MEMORY} SELECT id FROM memory WHERE NOT list_has_any({S.words('text')}, ['rest', 'inter'])")
def mem_forget_matching(spark, d):
    return memory.forget_matching(log_of(spark, d), "rest inter").select("id")


@query(f"WITH {S.MEMORY} SELECT id, CASE WHEN log_pos = 21 THEN 5 ELSE importance END AS importance, CASE WHEN log_pos = 21 THEN 'task' ELSE kind END AS kind, CASE WHEN log_pos = 21 THEN {S.fingerprint(chr(39) + 'a new text' + chr(39))} ELSE fingerprint END AS fingerprint FROM memory")
def mem_update(spark, d):
    import hashlib

    entry = hashlib.sha1(b"21").hexdigest()[:12]
    return memory.update(log_of(spark, d), entry, S.AS_OF, importance=5, kind="task", text="a new text").select("id", "importance", "kind", "fingerprint")


@query(f"WITH {S.MEMORY} SELECT id, kind, importance FROM memory WHERE id = substr(sha1('42'), 1, 12)")
def mem_get(spark, d):
    import hashlib

    return memory.get(log_of(spark, d), hashlib.sha1(b"42").hexdigest()[:12]).select("id", "kind", "importance")


_where = "CASE WHEN file IS NOT NULL THEN concat(' · `', file, '@', line, '`') ELSE '' END"


@query(
    f"WITH {S.MEMORY} SELECT CAST(list_position([{S.quoted(S.KIND_LIST)}], kind) AS INT) AS section_ord, kind, string_agg(concat('- **', substr(id, 1, 8), '** (', {S.ago('created_at')}, ')', {_where}, ' `#', tags[1], '` `#', tags[2], '`', chr(10), '  ', text), chr(10) ORDER BY created_at DESC, log_pos) AS body FROM memory GROUP BY kind UNION ALL SELECT 8, 'total', concat('---', chr(10), '_Total: ', count(*), ' entries._') FROM memory"
)
def memory_markdown(spark, d):
    log = log_of(spark, d)
    return memory.markdown(log, S.AS_OF).unionByName(memory.footer(log))


# --- graph ----------------------------------------------------------------------------------


@query(f"WITH {S.KEYS} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM nodes) AS files, CAST(0 AS BIGINT) AS symbols, (SELECT count(*) FROM edges) AS edges")
def graph_meta(spark, d):
    return graph.meta(*keys_of(spark, d))


@query(f"WITH {S.KEYS} SELECT n.id, count(e.id) AS degree FROM nodes n LEFT JOIN (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) e ON e.id = n.id GROUP BY n.id")
def graph_degree(spark, d):
    return graph.degree(*keys_of(spark, d))


@query(f"WITH {S.KEYS} SELECT concat('f:', dst) AS id, count(*) AS score FROM edges GROUP BY dst")
def graph_hub(spark, d):
    edges = keys_of(spark, d)[1]
    return graph.hubs(edges.withColumns({"src": graph.file_id(F.col("src")), "dst": graph.file_id(F.col("dst"))}))


@query(f"WITH {S.KEYS}, deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id), top AS (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 220) SELECT DISTINCT src, dst, type FROM edges WHERE src IN (FROM top) AND dst IN (FROM top)")
def graph_topk_subgraph(spark, d):
    return graph.subgraph(*keys_of(spark, d))[1]


@query(f"WITH {S.KEYS} SELECT type, count(*) AS n FROM edges GROUP BY type")
def graph_edge_types(spark, d):
    return graph.edge_types(keys_of(spark, d)[1]).select("type", "n")


@query(f"WITH RECURSIVE {S.KEYS}, r AS (SELECT 'c:1' AS id, 0 AS hops UNION SELECT a.b, r.hops + 1 FROM r JOIN around a ON a.a = r.id WHERE r.hops < 4) SELECT id, min(hops) AS hops FROM r GROUP BY id")
def graph_khop(spark, d):
    return graph.k_hop(keys_of(spark, d)[1], "c:1", 4)


@query(
    f"WITH RECURSIVE {S.KEYS}, dist AS (SELECT 'c:1' AS id, 0 AS hops UNION SELECT a.b, dist.hops + 1 FROM dist JOIN around a ON a.a = dist.id WHERE dist.hops < 6), best AS (SELECT id, min(hops) AS hops FROM dist GROUP BY id), "
    "back AS (SELECT id, hops FROM (FROM best ORDER BY hops DESC, id DESC LIMIT 1) UNION ALL SELECT id, hops FROM (SELECT min(b.id) AS id, min(b.hops) AS hops FROM back k JOIN around a ON a.a = k.id JOIN best b ON b.id = a.b AND b.hops = k.hops - 1) WHERE id IS NOT NULL) SELECT CAST(hops AS INT) AS step, id FROM back"
)
def graph_shortest_path(spark, d):
    edges = keys_of(spark, d)[1]
    far = graph.k_hop(edges, "c:1", 6).orderBy(F.desc("hops"), F.desc("id")).first()["id"]
    return graph.shortest_path(edges, "c:1", far)


@query(f"WITH RECURSIVE {S.KEYS}, r AS (SELECT id, id AS c FROM nodes WHERE id LIKE 'r:%' UNION SELECT a.b, r.c FROM r JOIN around a ON a.a = r.id), l AS (SELECT c, min(id) AS component FROM r GROUP BY c) SELECT r.id, min(l.component) AS component FROM r JOIN l USING (c) GROUP BY r.id")
def graph_components(spark, d):
    return graph.components(*keys_of(spark, d))


@query(S.page_rank(15))
def graph_pagerank(spark, d):
    return graph.page_rank(*keys_of(spark, d), iterations=15).select("id", F.round("rank", 8).alias("rank"))


def links_of(spark, d):
    """Links among pages: a page imports what its anchors name."""
    pages = table(spark, d, "pages")
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("ord", "target"))


_links = "links AS (SELECT page_id, h[i] AS target, i - 1 AS ord FROM (SELECT page_id, regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1) AS h, unnest(range(1, len(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) + 1)) AS i FROM pages))"


@query(f"WITH {_links} SELECT concat('p', page_id) AS path FROM links WHERE target IN ('the', 'of') GROUP BY page_id ORDER BY min(page_id * 1000 + ord), 1 LIMIT 15")
def graph_dependents(spark, d):
    edges = links_of(spark, d).select(F.concat(F.lit("f:p"), "page_id").alias("src"), F.concat(F.lit("f:"), "target").alias("dst"), F.lit("import").alias("type"), (F.col("page_id") * 1000 + F.col("ord")).alias("ord"))
    return graph.dependents(edges, ["the", "of"])


@query(f"WITH {_links} SELECT concat('src/p', page_id, '.py') AS src, CAST(ord AS INT) AS ord, concat('src/lib/', lower(target), '.py') AS dst FROM links WHERE regexp_full_match(target, '[A-Za-z]+')")
def import_resolve(spark, d):
    links = links_of(spark, d).where(F.col("target").rlike("^[A-Za-z]+$"))
    imports = links.select(F.concat(F.lit("src/p"), "page_id", F.lit(".py")).alias("path"), "ord", F.lit("python").alias("language"), "target", F.col("target").alias("source"))
    files = links.select(F.concat(F.lit("src/lib/"), F.lower("target"), F.lit(".py")).alias("path")).distinct()
    return resolve.imports_to_files(imports, files).select("src", "ord", "dst")


@query(f"WITH {_links}, decl AS (SELECT target AS name, min(page_id) AS page FROM links WHERE regexp_full_match(target, '[a-z]+') GROUP BY target) SELECT DISTINCT printf('p%08d', page_id) AS path, name, printf('s:p%08d:%s@1', page, name) AS target, page_id <> page AS is_cross_file FROM links JOIN decl ON name = target")
def refs_first_decl(spark, d):
    links = links_of(spark, d).where(F.col("target").rlike("^[a-z]+$")).withColumn("path", F.concat(F.lit("p"), F.lpad(F.col("page_id").cast("string"), 8, "0")))
    symbols = links.groupBy("path", F.col("target").alias("name")).agg(F.min("ord").alias("ord")).withColumn("line", F.lit(1))
    calls = links.select("path", (F.col("ord") * 2).alias("pos"), F.lit("ident").alias("kind"), F.col("target").alias("value"), F.lit(9).alias("line"))
    tokens = calls.unionByName(calls.select("path", (F.col("pos") + 1).alias("pos"), F.lit("punct").alias("kind"), F.lit("(").alias("value"), "line"))
    return resolve.references(tokens, symbols, max_edges=None)


@query(
    f"WITH {S.KEYS} SELECT 0 AS part, to_json({{'nodes': (SELECT count(*) FROM nodes), 'edges': (SELECT count(*) FROM edges), 'files': (SELECT count(*) FROM nodes), 'symbols': 0}}) AS json "
    "UNION ALL SELECT 1, to_json({'id': id, 'kind': 'file', 'name': name}) FROM nodes UNION ALL SELECT 2, to_json({'src': src, 'dst': dst, 'type': type}) FROM edges"
)
def graph_json(spark, d):
    return graph.to_json(*keys_of(spark, d))


@query(
    f"WITH {S.KEYS}, shown AS (SELECT * FROM nodes ORDER BY id LIMIT 2000) SELECT concat('  \"', regexp_replace(id, '[^A-Za-z0-9_.:/-]', '_', 'g'), '\" [label=\"', name, '\", shape=box];') AS line FROM shown "
    "UNION ALL SELECT concat('  \"', src, '\" -> \"', dst, '\" [color=\"#4c8bf5\"];') FROM edges WHERE src IN (SELECT id FROM shown) AND dst IN (SELECT id FROM shown)"
)
def graph_dot(spark, d):
    return graph.to_dot(*keys_of(spark, d)).select("line")


# --- commits --------------------------------------------------------------------------------


def history_of(spark, d):
    return commits.from_events(table(spark, d, "events"))


@query(f"WITH {S.HISTORY}, l AS (SELECT hash FROM history ORDER BY ts DESC, hash DESC LIMIT 500) SELECT path, count(*) AS n FROM history WHERE hash IN (FROM l) GROUP BY path ORDER BY n DESC, path LIMIT 20")
def hot_files(spark, d):
    return commits.hot(history_of(spark, d))


@query(f"WITH {S.HISTORY} SELECT path, max(ts) AS last FROM history WHERE ts >= 1706572800 - 14 * 86400 GROUP BY path ORDER BY last DESC, path LIMIT 30")
def touched_files(spark, d):
    return commits.touched(history_of(spark, d), 1706572800)


@query(f"WITH {S.HISTORY} SELECT hash, ts FROM history ORDER BY ts DESC, hash DESC LIMIT 10")
def recent_commits(spark, d):
    return commits.recent(history_of(spark, d).select("hash", "ts"))


@query(f"WITH {S.HISTORY} SELECT DISTINCT path FROM history WHERE ts > 1704240000 AND ts <= 1704326400")
def changed_between(spark, d):
    return commits.changed_between(history_of(spark, d), 1704240000, 1704326400)


# --- context --------------------------------------------------------------------------------


@query(f"WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l, {S.lines('text')} AS n FROM documents) SELECT doc_id, CASE WHEN 2 > n THEN '' ELSE concat('doc_', doc_id, '#L2', chr(10), array_to_string(l[2:least(n, 10)], chr(10))) END AS snippet FROM t")
def snippet(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", context.snippet("text", F.concat(F.lit("doc_"), "doc_id"), 2).alias("snippet"))


_step = "lambda a, x: CASE WHEN a.used + x.tokens <= 8000 OR len(a.kept) = 0 THEN {'used': a.used + x.tokens, 'kept': list_append(a.kept, x.section_ord)} ELSE a END"


@query(
    f"WITH r AS (SELECT path, row_number() OVER (ORDER BY score DESC, path) AS section_ord FROM ({S.search(QUERY, 40, ('content',))})), s AS (SELECT section_ord, {S.tokens('text')} AS tokens FROM r JOIN (WITH {S.FILES} SELECT path, text FROM files) USING (path)), o AS (SELECT list({{'section_ord': section_ord, 'tokens': tokens}} ORDER BY section_ord) AS l FROM s), "
    f"f AS (SELECT list_reduce(l, {_step}, {{'used': CAST(0 AS BIGINT), 'kept': CAST([] AS BIGINT[])}}) AS r FROM o) SELECT unnest(r.kept) AS section_ord, r.used AS used FROM f"
)
def context_pack(spark, d):
    # The forty best files of a search are the pack's sections.
    files = files_of(spark, d)
    found = search.search(files, QUERY, 40, signals=("content",)).withColumn("section_ord", F.row_number().over(Window.orderBy(F.desc("score"), "path")))
    sections = files.join(F.broadcast(found.select("path", "section_ord")), "path").select("section_ord", F.col("path").alias("title"), F.col("text").alias("body"))
    return context.pack(sections, 8000).select("section_ord", "used")


@query()
def context_build(spark, d):
    nodes, edges = keys_of(spark, d)
    symbols = symbols_of(spark, d)
    return context.build("rest inter", S.AS_OF, files=files_of(spark, d), symbols=symbols, log=log_of(spark, d), nodes=nodes, edges=edges)


@query(f"WITH {S.FILES} SELECT path, (d2 = 'fr' AND NOT ends_with(name, '7.txt')) OR d1 = 'src4' OR ends_with(name, '13.txt') AS ignored FROM files")
def ignore_match(spark, d):
    rules = ignore.rules_table(spark, [("", ["# rules", "*/fr/*", "!*7.txt", "*13.txt", "/src4/"])])
    return ignore.ignored(files_of(spark, d).select("path", F.lit(False).alias("is_dir")), rules).select("path", "ignored")


# --- tables by Python -----------------------------------------------------------------------


@query()
def lex_tokens(spark, d):
    return extraction.token_stats(extraction.tokens(spread(table(spark, d, "pages")).select(F.col("url").alias("path"), F.lit("html").alias("language"), F.col("html").alias("text"))))


@query()
def extract_symbols(spark, d):
    files = spread(table(spark, d, "conversations")).select(F.concat_ws("/", "conv_id", "turn").alias("path"), F.lit("markdown").alias("language"), F.concat(F.lit("# "), "text").alias("text"))
    return extraction.declared(files)


# --- streams --------------------------------------------------------------------------------


def drained(spark: SparkSession, rows: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream has written once its input is used up."""
    ensure_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{next(tempfile._get_candidate_names())}"
    rows.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


def stream_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table's file as a stream."""
    return spark.readStream.schema(table(spark, d, name).schema).option("pathGlobFilter", f"{name}*.parquet").parquet(d)


@query(f"WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type AS kind FROM events) SELECT start, kind, count(*) AS n FROM w WHERE start < (SELECT max(start) FROM w) GROUP BY ALL")
def stream_kind_counts(spark, d):
    # The last day stays open: no later event closes its window.
    e = stream_of(spark, d, "events").select(F.col("ts").cast("timestamp").alias("event_ts"), F.col("event_type").alias("kind")).withWatermark("event_ts", "0 seconds")
    counts = e.groupBy(F.window("event_ts", "1 day"), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")
    out = drained(spark, counts)
    return out.where(F.col("start") < F.lit(table(spark, d, "events").agg(F.date_trunc("day", F.max("ts"))).first()[0])).select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n")


@query("SELECT user_id, event_type FROM events GROUP BY ALL")
def stream_dedupe(spark, d):
    e = stream_of(spark, d, "events").select(F.col("ts").cast("timestamp").alias("event_ts"), "user_id", "event_type").withWatermark("event_ts", "400 days")
    return drained(spark, e.dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type"))


@query("SELECT event_id FROM events WHERE NOT (1706572800 - date_diff('second', TIMESTAMP '1970-01-01', ts) > CASE WHEN event_type = 'error' THEN 10 ELSE 20 END * 86400)")
def stream_ttl(spark, d):
    e = stream_of(spark, d, "events").select("event_id", F.lit("note").alias("kind"), F.when(F.col("event_type") == "error", 10).otherwise(20).alias("ttl_days"), F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").cast("bigint").alias("created_at"))
    return drained(spark, memory_stream.live(e, 1706572800).select("event_id"))
