"""Every operator and stage on awkward rows, empty tables and clashing columns."""

import pytest

from lodestar.llm import decontaminate, hnsw, jaccard, langid, packing, pii, quality, repeats, secret_scan, suffix_lm
from lodestar.llm.queries import vocabulary
from pyspark.sql import functions as F


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


RUNS = {
    "pii": lambda d: pii.spans(d),
    "suffix_lm": lambda d: suffix_lm.score(d, F.lit(True)),
    "repeats": lambda d: repeats.removed(d),
    "quality": lambda d: quality.score(d, quality.train(d, d.select("doc_id", F.lit(1).alias("quality"))), ["doc_id"]),
    "langid": lambda d: langid.predict(d, langid.train(d), ["doc_id"]),
    "secrets": lambda d: secret_scan.spans(d),
    "jaccard": lambda d: jaccard.join(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_keeps_every_row(name, docs_of, awkward):
    assert ids(RUNS[name](docs_of(awkward))) == sorted((i for i, _ in awkward), key=lambda x: (x is None, x))


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(name, docs_of):
    assert RUNS[name](docs_of([])).count() == 0


@pytest.mark.parametrize("name", RUNS)
def test_clashing_columns(name, clashing):
    assert ids(RUNS[name](clashing)) == [1, 2]


def test_packing_edges(docs_of, awkward, clashing):
    out = packing.pack(docs_of(awkward), vocabulary()).collect()
    assert {r["doc_id"] for r in out} == {i for i, _ in awkward}
    assert packing.pack(docs_of([]), vocabulary()).count() == 0
    assert packing.pack(clashing, vocabulary()).count() == 2


def test_decontaminate_edges(spark, docs_of, awkward, clashing):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two three"), (4, " ")], "item_id long, text string")
    found = decontaminate.matches(docs_of(awkward), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(6, 3)} and len(found) == 2
    assert decontaminate.clean(docs_of(awkward), items).count() == len(awkward) - 2
    assert decontaminate.matches(docs_of([]), items).count() == 0
    assert decontaminate.matches(clashing, items.limit(0)).count() == 0


def test_hnsw_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [0.0, 1.0])]
    out = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out.collect()}
    linked = {(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False)}
    alone = {(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)} | {(None, 0, None, False)}
    assert got == linked | alone and out.count() == len(rows)
    assert hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    names = "vec_id long, embedding array<double>, rep long, v int, dim int, shard string, copies int, key string, n_links int, component string"
    more = spark.createDataFrame([(i, [1.0, 0.1 * (i % 2)], 1, 2, 3, "s", 4, "k", 5, "c") for i in range(4)], names)
    assert {tuple(r) for r in hnsw.near_duplicates(more).collect()} == {(i, 3, 0, i == 0) for i in range(4)}


def test_values_on_awkward_rows(docs_of):
    mail = "mail a.b@c.de now"
    docs = docs_of([(1, None), (2, ""), (3, mail), (3, mail), (None, "secret = abcdef1 end"), (4, "x" * 200_000 + " 10.0.0.1")])

    def told(df):
        return sorted(((r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in df.collect()), key=str)

    assert told(pii.spans(docs)) == sorted([(1, []), (2, []), (3, [("email", 5, 13)]), (3, [("email", 5, 13)]), (None, []), (4, [("ip", 200_001, 200_009)])], key=str)
    found = dict(told(secret_scan.spans(docs)))
    assert found[None] == [("assign", 0, 16)] and not any(found[i] for i in (1, 2, 3))
    cut = {r["doc_id"]: (r["n_bytes"], len(r["kept"])) for r in repeats.removed(docs_of([(1, None), (2, ""), (3, "z" * 399), (4, "q" * 900), (None, "short")])).collect()}
    assert cut == {1: (0, 0), 2: (0, 0), 3: (399, 399), 4: (900, 0), None: (5, 5)}
    sizes = {r["doc_id"]: (r["n_tokens"], r["n_known"]) for r in suffix_lm.score(docs, F.col("doc_id") == 3).collect()}
    assert sizes == {1: (1, 1), 2: (1, 1), 3: (4, 4), None: (5, 1), 4: (3, 1)}
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs_of([(1, None), (2, " "), (5, "a b"), (4, "A  B"), (6, "b a")])).collect()}
    assert rows == {1: (0, 1), 2: (0, 2), 4: (1, 4), 5: (1, 4), 6: (1, 6)}


def test_ties(docs_of, spark):
    # Two languages with the same words are equally likely: the first by name is given, with half a score.
    both = docs_of([(1, "same words here")], "xx").unionByName(docs_of([(2, "same words here")], "aa"))
    out = langid.predict(docs_of([(9, "same words"), (8, "same words")]), langid.train(both), ["doc_id"]).collect()
    assert [(r["lang_pred"], round(r["score"], 6)) for r in out] == [("aa", 0.5)] * 2
    # Equal texts with opposite labels are scored alike, and as likely as not.
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    alike = docs_of([(i, "one text for all of them") for i in range(20)])
    scores = {r["score"] for r in quality.score(alike, quality.train(alike, labels), ["doc_id"]).collect()}
    assert len(scores) == 1 and abs(scores.pop() - 0.5) < 1e-6
    # An item that occurs twice is given once, at its first end; items alike are given each.
    items = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta")], "item_id long, text string")
    found = decontaminate.matches(docs_of([(1, "alpha beta gamma delta x alpha beta gamma delta")]), items).collect()
    assert sorted((r["item_id"], r["distance"], r["end"]) for r in found) == [(1, 0, 22), (2, 0, 22)]


def test_grams_are_counted_alike_whatever_a_task_holds(docs_of, monkeypatch):
    docs = docs_of([(i, f"word{i} and {i * i} more") for i in range(60)])
    monkeypatch.setattr(suffix_lm, "CHUNK", 1)
    whole, small = ({(r["code"], r["c"]) for r in suffix_lm.count_grams(docs, "text", 3, most=n).collect()} for n in (10**6, 40))
    assert whole == small


def test_undetermined_language(docs_of):
    docs = [(1, None), (2, "123 !!"), (3, "hello there"), (4, "½ ² Ⅷ ①"), (5, "hello½there")]
    out = langid.predict(docs_of(docs), langid.train(docs_of([(9, "hello there world")])), ["doc_id"])
    assert {r["doc_id"]: r["lang_pred"] for r in out.collect()} == {1: "und", 2: "und", 3: "en", 4: "und", 5: "en"}
