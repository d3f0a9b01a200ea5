"""Each stage against a plain version of its decisions, and the whole."""

import corpus_pipeline as P
from lodestar.llm import decontaminate
from lodestar.tables import table


def test_stages(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    items = [r["text"] for r in table(spark, sf, "benchmark").collect()]
    for name, stage in P.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert set(after) <= set(before)
        if name == "near_duplicates":
            sets = {i: shingles(r["text"], 5) for i, r in before.items()}
            kept = {i: sets[i] for i in after}
            for i in set(before) - set(after):  # every dropped one has a chain of links to a smaller kept one
                assert any(j < i and alike(sets[i], sets[j]) for j in before)
            assert not any(alike(kept[i], kept[j]) for i in kept for j in kept if i < j)
        if name == "decontamination":
            held = {i for i, r in before.items() if any(decontaminate.normalise(t) in decontaminate.normalise(r["text"]) for t in items)}
            assert held and not held & set(after) and len(before) - len(after) <= len(held) + 2
        if name == "pii":
            assert set(after) == set(before)
            assert any(after[i]["text"] != before[i]["text"] for i in after)
            assert all("@" not in r["text"] or "@" not in r["text"].replace("@ ", "") for r in after.values())
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    assert P.run(spark, sf).select("doc_id").distinct().count() == docs.count()


def shingles(t, k):
    w = (t or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def alike(a, b):
    both = len(a & b)
    return bool(both) and 100 * both >= 80 * (len(a) + len(b) - both)


def test_awkward_rows(docs_of, awkward, spark, sf, clashing):
    docs = docs_of([*awkward, *((100 + i, "plain words of a usual text go here") for i in range(5))])
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf).persist()
    kept = [r["doc_id"] for r in docs.collect()]
    assert 1 not in kept and 3 not in kept and kept.count(6) == 1 and kept.count(100) == 1 and 101 not in kept and None in kept
    assert P.STAGES[-1][1](spark, docs, sf).count() >= len(kept)
    empty = docs_of([])
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf).count() == 0
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, clashing, sf).columns == clashing.columns
