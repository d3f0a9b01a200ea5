"""Work and memory that grow with the input only, and queries whole at more rows than the smallest tables have."""

import hashlib
import time
from itertools import chain, repeat

import pyarrow as pa
import pytest
from lodestar.functions import text as T
from lodestar.operators import context, corpus, extraction, graph, lexer, memory, resolve, symbols
from lodestar.plans.more import epoch_of
from lodestar.plans.registry import spread
from lodestar.sources import index_store
from pyspark.sql import functions as F


def test_ngrams_of_a_long_text_take_one_pass(spark):
    began = time.time()
    words = spark.range(1).select(F.array(F.repeat(F.lit("abcdefg"), 200_000)).alias("w"))
    row = words.select(T.char_ngrams("w", 3).alias("g")).select(F.size("g").alias("n"), F.size(F.array_distinct("g")).alias("d")).first()
    assert (row["n"], row["d"]) == (1_399_998, 7)
    assert time.time() - began < 60  # a walk to each place took minutes


def test_pieces_hold_each_ngram_once(spark):
    for text in ("", "ab", "abc", "abcdefghijklmnopqrstuvwxyz", "a\U0001f600\u00e9b\nc" * 5):
        rows = spark.createDataFrame([(text,)], "t string").select(F.explode(T.gram_pieces("t", 3, 7)).alias("p")).select(F.explode(T.grams_of_text("p", 3)).alias("g")).collect()
        assert sorted(r["g"] for r in rows) == sorted(text[i : i + 3] for i in range(len(text) - 2))


def test_references_have_no_cap(spark):
    n = 40_100
    files = spark.range(n).select(F.concat(F.lit("f"), "id", F.lit(".py")).alias("path"), F.concat(F.lit("g"), "id").alias("name"))
    symbols = files.select(F.concat(F.lit("d/"), "path").alias("path"), F.lit(0).alias("ord"), "name", F.lit(1).alias("line"))
    ident = files.select("path", F.lit(0).alias("pos"), F.lit("ident").alias("kind"), F.col("name").alias("value"), F.lit(7).alias("line"))
    tokens = ident.unionByName(ident.select("path", F.lit(1).alias("pos"), F.lit("punct").alias("kind"), F.lit("(").alias("value"), "line"))
    assert resolve.references(tokens, symbols).count() == n
    assert resolve.references(tokens, symbols, max_edges=5).count() == 5


def test_dependents_have_no_cap(spark):
    edges = spark.range(40).select(F.concat(F.lit("f:u"), "id").alias("src"), F.lit("s:b:x@1").alias("dst"), F.lit("ref").alias("type"), F.lit(0).alias("ord"))
    assert graph.dependents(edges, ["b"], limit=None).count() == 40 and graph.dependents(edges, ["b"]).count() == 15


def test_partitions_grow_with_a_table(spark, tmp_path):
    spark.range(60_000).withColumn("text", F.lit("a")).coalesce(1).write.parquet(f"{tmp_path}/t")
    one = spread(spark.read.parquet(f"{tmp_path}/t"))
    n = one.rdd.getNumPartitions()
    assert n > max(spark.sparkContext.defaultParallelism, 30) - 1 and n % spark.sparkContext.defaultParallelism == 0
    assert one.count() == 60_000 and max(r["n"] for r in one.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()) < 6_000


def test_tokens_are_handed_on_as_they_are_found():
    # A text without end: a list of its tokens would never be done.
    endless = ((i, t.value) for i in repeat(0) for t in lexer.tokens("a b c", "python"))
    fields = pa.schema([("i", pa.int32()), ("v", pa.string())])
    assert next(extraction.batched(endless, fields)).num_rows == extraction.ROWS
    assert [t.value for _, t in zip(range(2), lexer.tokens("a b " * 5, None), strict=False)] == ["a", "b"]
    assert list(extraction.batched(iter(()), fields)) == []
    assert sum(b.num_rows for b in extraction.batched(chain([(1, "x")] * 12_001), fields)) == 12_001


@pytest.mark.parametrize(
    ("text", "language", "want"),
    [
        ("a\\'b' 'x\\\\' `q", "ruby", ["a", "\\", "'b'", "'x\\\\'", "`", "q"]),
        ('"a\nb" "c\\', "go", ['"a', "b", '" "', "c", "\\"]),
        ("/* a /* b */ c */ d /*/ e", "rust", ["/* a /* b */ c */", "d", "/*/ e"]),
        ("/* a /* b */ c", "c", ["/* a /* b */", "c"]),
        ("&'a str 'b' 'cd'", "rust", ["&", "'a", "str", "'b'", "'c", "d", "' "[:1]]),
        ("1.5e3x 0x1F_ 9__ a\u00b2 \u00e9", "python", ["1.5e3x", "0x1F_", "9__", "a\u00b2", "\u00e9"]),
    ],
)
def test_lexer_ends(text, language, want):
    found = lexer.lex(text, language)
    assert [t.value for t in found] == want
    assert all(text[t.offset :].startswith(t.value) for t in found)


def test_calls():
    assert symbols.calls(lexer.lex("f(g (x), # note\nh\n# other\n(y)) + z", "python")) == [(0, "f", 1), (2, "g", 1), (8, "h", 2)]


def test_an_index_lexes_its_files_once(spark, monkeypatch, tmp_path):
    rows = spark.createDataFrame([("a.py", "def f():\n    pass\n"), ("b.py", "from a import f\nf()\n")], "path string, text string")
    files = corpus.with_places(rows.select("path", F.lit("python").alias("language"), "text"))
    for name in ("tokens", "declared", "imported"):
        monkeypatch.setattr(extraction, name, lambda *_: pytest.fail("lexed again"))
    index_store.save(corpus.build(files), f"{tmp_path}/index")
    index = index_store.load(spark, f"{tmp_path}/index")
    assert {(r["src"], r["dst"], r["type"]) for r in index["edges"].collect()} == {("f:a.py", "s:a.py:f@1", "define"), ("f:b.py", "f:a.py", "import"), ("f:b.py", "s:a.py:f@1", "ref")}
    assert {r["term"]: r["df"] for r in index["terms"].select("term", "df").collect()} == {r["term"]: r["df"] for r in corpus.term_stats(corpus.postings(files), 2).select("term", "df").collect()}


def test_seconds_are_rounded_as_sql_rounds_them(spark):
    times = ["2024-01-30 23:59:25.26", "2024-01-29 23:59:24.7", "2024-01-29 23:59:24.5", "2024-01-29 23:59:25.5", "2024-01-29 23:59:25.499999"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = [r["s"] for r in rows.select("i", epoch_of("ts").alias("s")).orderBy("i").collect()]
    assert got == [1706659165, 1706572765, 1706572764, 1706572766, 1706572765]


def test_snippets_that_fit_are_found_without_holding_all(spark):
    lengths = [(i * 7919) % 61 + 3 for i in range(600)]
    files = spark.createDataFrame([(f"{i:03}", "x" * n) for i, n in enumerate(lengths)], "path string, text string")
    places = files.select(F.col("path").cast("int").alias("ord"), "path", F.lit(1).alias("line"))
    used, want = 0, []
    for i, n in enumerate(lengths):
        t = f"{i:03}#L1\n" + "x" * n
        if used + len(t) <= 300:
            used, want = used + len(t), [*want, t]
    body = context.snippet_block(files, places, max_chars=300)
    assert body.first()["body"] == "\n".join(want)
    plan = body._jdf.queryExecution().optimizedPlan().toString()
    assert "partition by" in plan.lower() or "windowspecdefinition(cost" in plan


def test_markdown_joins_days_in_order(spark):
    ages = [0, 5, 5, 86_400, 86_401, 3 * 86_400, 400 * 86_400]
    log = spark.createDataFrame([(i, f"{i:08}", "note", f"t{i}" if i != 5 else None, [], None, None, 1_700_000_000 - a) for i, a in enumerate(ages)], "log_pos long, id string, kind string, text string, tags array<string>, file string, line int, created_at long")
    body = memory.markdown(log, 1_700_000_000).first()["body"]
    assert [x[4:12] for x in body.split("\n") if x.startswith("- ")] == ["00000000", "00000001", "00000002", "00000003", "00000004", "00000006"]
    assert "\n\n" not in body


def test_a_fingerprint_splits_its_text_once(spark):
    rows = spark.createDataFrame([("red blue",), ("?!",), ("",), (None,)], "text string").select(T.fingerprint("text").alias("f"))
    words = hashlib.sha1(b"blue\x01red").hexdigest()[:16]
    assert [r["f"] for r in rows.collect()] == [words, hashlib.sha1(b"?!").hexdigest()[:16], hashlib.sha1(b"").hexdigest()[:16], None]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(T.TOKEN) == 1
