"""The memory log, graphs, context packs, stores and streams, on small tables."""

import json
from pathlib import Path

import pytest

from lodestar.checkpoints import CLEANUP, discard, written
from lodestar.functions import text as T
from lodestar.operators import commits, context, graph, memory
from lodestar.sources import config, index_store
from lodestar.streaming import memory_stream
from pyspark.sql import functions as F

NOW = 1_700_000_000
DAY = 86400


def entry(i, text, kind="note", age=0, **more):
    return {"id": f"e{i}", "text": text, "kind": kind, "created_at": NOW - age, "importance": 3, "tags": [], **more}


@pytest.fixture
def log_of(spark, tmp_path):
    def make(*entries):
        path = tmp_path / "log.jsonl"
        path.write_text("\n".join(json.dumps(e) for e in entries) + "\n")
        return memory.read(spark, str(path))

    return make


def test_text_functions(spark):
    one = spark.range(1)

    def of(c):
        return one.select(c.alias("x")).first()["x"]

    assert of(T.split_words(F.lit("parseHTTPServer_v2 the cache_size"))) == ["parse", "http", "server", "v2", "cache", "size"] == T.split_words_py("parseHTTPServer_v2 the cache_size")
    assert of(T.char_ngrams(F.array(F.lit("ab")), 3)) == ["ab "] and of(T.char_ngrams(F.array(F.lit("ab"), F.lit("cd")), 3)) == ["abc", "bcd"] and of(T.char_ngrams(T.strings(), 3)) == []
    assert of(T.fingerprint(F.lit("red blue"))) == of(T.fingerprint(F.lit("Blue, red!"))) != of(T.fingerprint(F.lit("red")))
    assert of(T.estimate_tokens(F.lit(""))) == 1
    assert [of(T.unsafe_path(F.lit(p))) for p in ("/etc", "a/../b", "a/b", "C:\\x")] == [True, True, False, True]
    assert of(T.repo_relative(F.lit("/r/a/b.c"), "/r")) == "a/b.c" and of(T.first_line(F.lit("  a \nb"))) == "a" and of(T.parse_int_or(F.lit("x"), 7)) == 7
    assert of(T.normalize_tags(F.array(F.lit("A, b"), F.lit("b c")))) == ["a", "b", "c"]
    assert of(T.human_bytes(F.lit(1536))) == "1.5 KB" and of(T.time_ago(F.lit(NOW - 7200), NOW)) == "2h ago"
    assert [of(T.autocategorize(F.lit(t))) for t in ("we decided on red", "watch out here", "use this", "blue")] == ["decision", "gotcha", "tip", "note"]
    assert sorted(["a10", "a2", "A1"], key=lambda s: of(T.natural_key(F.lit(s)))) == ["A1", "a2", "a10"]


def test_recall(log_of):
    log = log_of(entry(1, "the cache drops tokens", "decision", tags=["x"]), entry(2, "blue paint", age=DAY), entry(3, "cached values", importance=5))
    assert [r["id"] for r in memory.recall(log, NOW, "tokens cache").collect()] == ["e1", "e3"]
    assert [r["id"] for r in memory.recall(log, NOW).collect()] == ["e3", "e1", "e2"]
    assert [r["id"] for r in memory.recall(log, NOW, tag="x").collect()] == ["e1"]
    assert memory.recall(log, NOW, "nothing here matches").count() == 0


def test_gc(log_of):
    log = log_of(entry(1, "same words", tags=["b"]), entry(2, "words same", tags=["a"]), entry(3, "old", ttl_days=1, age=3 * DAY), entry(4, "task left", "task", age=31 * DAY), entry(5, "kept task", "task", age=29 * DAY))
    assert memory.gc_report(log, NOW).first().asDict() == {"before": 5, "after": 2, "expired": 2, "deduped": 1}
    kept = {r["id"]: r["tags"] for r in memory.gc(log, NOW).collect()}
    assert kept == {"e1": ["a", "b"], "e5": []}
    again = memory.gc(log, NOW)
    assert memory.gc(again, NOW).count() == again.count()
    capped = log_of(*(entry(i, f"text number {w}", age=i * 60, importance=1 + i % 2) for i, w in enumerate(["one", "two", "three", "four"])))
    assert {r["id"] for r in memory.gc(capped, NOW, hard_cap=3).collect()} == {"e1", "e2", "e3"}
    assert {r["id"] for r in memory.gc(capped, NOW, hard_cap=3, oldest_first=True).collect()} == {"e0", "e1", "e3"}


def test_changes(log_of, spark, tmp_path):
    log = log_of(entry(1, "drop this"), entry(2, "keep that"))
    assert [r["id"] for r in memory.forget_matching(log, "drop").collect()] == ["e2"]
    assert memory.forget(log, "e1").count() == 1 and memory.get(log, "e2").first()["text"] == "keep that"
    new = memory.update(log, "e2", NOW + 5, text="other words", kind="bogus", tags=["Z, y"]).where("id = 'e2'").first()
    assert (new["kind"], new["tags"], new["updated_at"]) == ("note", ["y", "z"], NOW + 5) and new["fingerprint"] != memory.get(log, "e2").first()["fingerprint"]
    with pytest.raises(ValueError):
        memory.update(log, "e2", NOW, id="x")
    made = memory.new_entries(spark.createDataFrame([(" we decided ", None, ["B a"], None, None, None, 9, None, None)], "text string, kind string, tags array<string>, file string, line int, source string, importance int, ttl_days int, link string"), NOW).first()
    assert (made["kind"], made["text"], made["tags"], made["importance"], len(made["id"])) == ("decision", "we decided", ["a", "b"], 5, 12)
    assert {r["kind"]: r["n"] for r in memory.stats(log).collect()} == {**dict.fromkeys(T.KINDS, 0), "note": 2, "total": 2}


def test_corrupt_lines_are_errors(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"id": "a", "text": "t"}\n\n{not json}\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|parse"):
        memory.read(spark, str(tmp_path / "bad.jsonl")).collect()
    assert memory.count(spark, str(tmp_path / "bad.jsonl")) == 2


def test_tail_duplicates_fold(spark):
    seq = "abacadaebf"
    rows = spark.createDataFrame([("l", i, c) for i, c in enumerate(seq)] + [("m", 0, "a")], "log string, log_pos long, fingerprint string")
    got = {(r["log"], r["log_pos"]): r["duplicate"] for r in memory.tail_duplicates(rows, window=3).collect()}
    tail, want = [], {("m", 0): False}
    for i, c in enumerate(seq):
        want["l", i] = c in tail
        tail = tail if c in tail else [*tail, c][-3:]
    assert got == want


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([(f"f:{x}", "file", x) for x in "pqrz"], "id string, kind string, name string")
    edges = spark.createDataFrame([("f:p", "f:q", "import", 0), ("f:q", "f:r", "import", 1)], "src string, dst string, type string, ord int")
    return nodes, edges


def test_graph(small):
    nodes, edges = small
    assert [r["id"] for r in graph.shortest_path(edges, "f:p", "f:r").orderBy("step").collect()] == ["f:p", "f:q", "f:r"]
    assert graph.shortest_path(edges, "f:p", "f:z", nodes).count() == 0 and graph.shortest_path(edges, "f:p", "f:p").count() == 1
    assert {r["id"]: r["component"] for r in graph.components(nodes, edges).collect()} == {"f:p": "f:p", "f:q": "f:p", "f:r": "f:p", "f:z": "f:z"}
    assert {r["id"]: r["hops"] for r in graph.k_hop(edges, "f:p", 2).collect()} == {"f:p": 0, "f:q": 1, "f:r": 2}
    assert [r["id"] for r in graph.k_hop(edges, "f:unknown", 2).collect()] == ["f:unknown"]
    ranks = [r["rank"] for r in graph.page_rank(nodes, edges, iterations=12).collect()]
    assert abs(sum(ranks) - 1) < 1e-9
    assert {r["id"]: r["score"] for r in graph.hubs(edges).collect()} == {"f:q": 1, "f:r": 1}
    assert {r["id"] for r in graph.neighbors(edges, "f:q").collect()} == {"f:p", "f:r"}


def test_page_rank_leaks_along_self_loops_unless_normalised(spark, small):
    nodes, edges = small
    loop = edges.unionByName(spark.createDataFrame([("f:p", "f:p", "ref", 2), ("f:q", "f:gone", "ref", 3)], edges.schema))
    assert sum(r["rank"] for r in graph.page_rank(nodes, loop, iterations=10).collect()) < 0.99
    assert abs(sum(r["rank"] for r in graph.page_rank(nodes, loop, iterations=10, normalize=True).collect()) - 1) < 1e-9


def test_nodes_edges_and_dependents(spark):
    rows = spark.createDataFrame([(0, "a", "file", {"x": "1"}), (1, "a", "symbol", {"x": "2", "y": "3"})], "ord int, id string, kind string, attrs map<string,string>")
    assert graph.merge_nodes(rows).first().asDict() == {"id": "a", "kind": "file", "attrs": {"x": "2", "y": "3"}}
    symbols = spark.createDataFrame([("m.py", "Box", 1, None), ("m.py", "put", 3, "Box")], "path string, name string, line int, parent string")
    assert [(r["src"], r["dst"]) for r in graph.contains_edges(symbols).collect()] == [("s:m.py:Box@1", "s:m.py:put@3")]
    edges = spark.createDataFrame([("f:a.py", "s:m.py:put@3", "ref", 0), ("f:b.py", "f:m.py", "import", 1), ("f:m.py", "f:a.py", "import", 2)], "src string, dst string, type string, ord int")
    assert [r["path"] for r in graph.dependents(edges, ["m.py"]).collect()] == ["a.py", "b.py"]


def test_greedy_budgets_skip_and_go_on(spark):
    rows = spark.createDataFrame([(0, "big", "x" * 400), (1, "mid", "x" * 200), (2, "huge", "x" * 4000), (3, "small", "x" * 40)], "section_ord int, title string, body string")
    got = context.pack(rows, 170).collect()
    assert [r["title"] for r in got] == ["big", "mid", "small"] and got[0]["used"] == 160
    assert [r["title"] for r in context.pack(rows.where("section_ord = 2"), 10).collect()] == ["huge"]
    assert context.render(context.pack(rows, 170), 170).first()["text"].startswith("context pack · 160/170 tokens")


def test_snippets(spark):
    text = "\n".join(f"line {i}" for i in range(1, 21))
    row = spark.createDataFrame([(text,)], "t string")

    def of(path, start, span=8):
        return row.select(context.snippet("t", F.lit(path), start, span).alias("x")).first()["x"]

    assert of("a.py", 3, 2) == "a.py#L3\nline 3\nline 4\nline 5" and of("a.py", 19).count("\n") == 2
    assert of("../a", 1) == "" and of("/a", 1) == "" and of("a", 40) == ""


def test_context(log_of, spark):
    log = log_of(entry(1, "about widgets"), entry(2, "other"))
    files = spark.createDataFrame([("w.py", [], "w.py", "python", "class Widget:\n  pass\n", 22, 2), ("u.py", [], "u.py", "python", "use\n", 4, 1)], "path string, dir array<string>, name string, language string, text string, size long, lines long")
    symbols = spark.createDataFrame([("w.py", 0, "Widget", "class", 1)], "path string, ord int, name string, kind string, line int")
    nodes = spark.createDataFrame([("f:w.py", "file", "w"), ("s:w.py:Widget@1", "symbol", "Widget"), ("f:u.py", "file", "u")], "id string, kind string, name string")
    edges = spark.createDataFrame([("f:u.py", "s:w.py:Widget@1", "ref", 0)], "src string, dst string, type string, ord int")
    out = {r["title"]: r["body"] for r in context.build("widget", NOW, files=files, symbols=symbols, log=log, nodes=nodes, edges=edges).collect()}
    assert list(out) == ["Relevant memory", "Symbols", "Definitions (snippets)", "Impact / dependents", "Largest indexed files"]
    assert "about widgets" in out["Relevant memory"] and "u.py" in out["Impact / dependents"] and "class Widget" in out["Definitions (snippets)"]


def test_commits(spark):
    lines = spark.createDataFrame([("abcdef1234567890\x01fix\x01me\x01100",), ("broken",)], "value string")
    assert commits.parse_log(lines).first().asDict() == {"hash": "abcdef123456", "subject": "fix", "author": "me", "ts": 100}
    files = spark.createDataFrame([("c1", "a", 10), ("c2", "a", 20), ("c2", "b", 20)], "hash string, path string, ts long")
    assert [(r["path"], r["n"]) for r in commits.hot(files).collect()] == [("a", 2), ("b", 1)]
    assert [r["path"] for r in commits.hot(files, commits=1, limit=1).collect()] == ["a"]


def test_index_store(spark, tmp_path, small):
    index_store.save({"nodes": small[0], "edges": small[1]}, str(tmp_path / "i"))
    assert index_store.load(spark, str(tmp_path / "i"))["nodes"].count() == 4
    index_store.replace(spark.read.parquet(str(tmp_path / "i/nodes")).limit(1), str(tmp_path / "i/nodes"))
    assert index_store.load(spark, str(tmp_path / "i"))["nodes"].count() == 1
    with pytest.raises(index_store.IndexCorrupt):
        index_store.load(spark, str(tmp_path / "none"))


def test_config(tmp_path):
    (tmp_path / "user.json").write_text('{"index_depth": 3, "ttl_days": {"task": 5}}')
    (tmp_path / "repo.json").write_text('{"index_depth": 4}')
    c = config.Config.load(str(tmp_path / "user.json"), str(tmp_path / "repo.json"), str(tmp_path / "none.json"))
    assert c.index_depth == 4 and c.ttl_days["task"] == 5 and c.ttl_days["tip"] == 365
    (tmp_path / "bad.json").write_text('{"depth": 1}')
    with pytest.raises(ValueError, match="depth"):
        config.Config.load(str(tmp_path / "bad.json"))


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps(entry(i, t, age=DAY * i)) for i, t in enumerate(["red", "blue", "red", "green"])))
    rows = memory_stream.read(spark, str(tmp_path / "in"), "10 days")
    memory_stream.append(memory_stream.without_duplicates(rows).select("id", "text"), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["blue", "green", "red"]
    plain = spark.readStream.schema(memory.SCHEMA).json(str(tmp_path / "in"))
    tagged = memory.with_defaults(plain).withColumns({"log": F.lit("l"), "log_pos": -F.col("created_at")})
    memory_stream.without_tail_duplicates(tagged, 1).writeStream.format("memory").queryName("tail").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("tail").count() == 4
    memory_stream.without_tail_duplicates(tagged, 2).writeStream.format("memory").queryName("tail2").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("tail2").count() == 3


def test_discarded_tables_and_no_others_are_removed(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "kept"))
    mine, other = written(spark.range(7)), spark.read.parquet(str(tmp_path / "kept"))
    folder = Path(mine.inputFiles()[0].removeprefix("file:")).parent
    assert folder.is_dir() and mine.count() == 7
    discard(mine, other, written(spark.range(0)))
    assert not folder.exists() and other.count() == 5
    discard()


def test_writing_a_table_leaves_the_session_as_it_was(spark):
    was = spark.conf.get(CLEANUP, None)
    table = written(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    assert table.count() == 7 and spark.conf.get(CLEANUP, None) == was
    spark.conf.set(CLEANUP, "true")
    try:
        written(spark.range(3))
        assert spark.conf.get(CLEANUP) == "true"
    finally:
        spark.conf.unset(CLEANUP)
