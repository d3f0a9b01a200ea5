"""Operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestar.llm import decontaminate, hnsw, jaccard, langid, packing, pii, quality, queries, repeats, secret_scan, suffix_lm
from lodestar.tables import table
from pyspark.sql import functions as F


def texts(rng, n, words, lo=5, hi=300):
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(words)]
    return [" ".join(rng.choice(vocab) for _ in range(rng.randint(lo, hi))) for _ in range(n)]


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def jaccard_brute(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in keys}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard(docs_of, k, percent):
    rng = random.Random(percent)
    docs = texts(rng, 60, 80, 1, 60) + texts(rng, 30, 3, 1, 14)
    for base in texts(rng, 6, 200, 30, 120):
        docs += near_copies(rng, base, 12, 6)
    docs += near_copies(rng, docs[3], 40, 2) + [docs[5]] * 30 + ["", None, " "]
    rows = list(enumerate(docs))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs_of(rows), k=k, percent=percent).collect()}
    assert got == jaccard_brute(rows, k, percent)


@pytest.mark.parametrize("boundary", [0, 9, 16])
def test_jaccard_boundaries(docs_of, monkeypatch, boundary):
    """Results don't depend on where light sets end."""
    monkeypatch.setattr(jaccard, "choose_boundary", lambda *_: boundary)
    rng = random.Random(boundary)
    docs = []
    for base in texts(rng, 20, 50, 6, 24):
        docs += near_copies(rng, base, 4, 2) + [" ".join(base.split()[:-1])]
    rows = list(enumerate(docs))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs_of(rows), k=1, percent=85).collect()}
    assert got == jaccard_brute(rows, 1, 85)


def edited(rng, base, edits):
    """The words of base, the given number of them replaced by new ones."""
    out = list(base)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"x{rng.randrange(10**9)}"
    return " ".join(out)


@pytest.fixture
def compared(monkeypatch):
    """What each comparison of the Jaccard join was given and found to link."""
    seen, real = [], jaccard._compare

    def spy(pairs, sets, percent):
        out = jaccard.cut(real(pairs, sets, percent))
        seen.append((pairs.count(), out.count()))
        return out

    monkeypatch.setattr(jaccard, "_compare", spy)
    return seen


def test_jaccard_links_follow_group_size(docs_of, monkeypatch, compared):
    """Copies that the rounds leave apart are linked by a few pairs each, not by all pairs of the group."""
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    rng = random.Random(31)
    base = [f"w{i}" for i in range(100)]
    found = {}
    for n in (40, 80):
        compared.clear()
        rows = list(enumerate(edited(rng, base, 1 + i % 2) for i in range(n)))
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs_of(rows), k=1, percent=80).collect()}
        assert got == jaccard_brute(rows, 1, 80) == {i: (100, 0) for i in range(n)}
        found[n] = sum(given for given, _ in compared), sum(linked for _, linked in compared)
    # All pairs: 780 of 40, 3160 of 80.
    assert all(x <= 5 * n for n in found for x in found[n]), found


@pytest.mark.parametrize(("rounds", "nearest", "block"), [(0, 1, 4096), (0, 1, 7), (2, 2, 16)])
def test_jaccard_passes_are_exact(docs_of, monkeypatch, compared, rounds, nearest, block):
    """Pairs that parities can't tell from links, and links found in later passes and between blocks."""
    for name, value in (("ROUNDS", rounds), ("NEAREST", nearest), ("MORE", 2), ("BLOCK", block), ("PAIRS", 50)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(32)
    docs = []
    for edits in ([26] * 60, [18, 26] * 12, range(0, 39, 3)):  # two with 44 edits in all link, those with 52 seem to by parities
        base = [f"w{rng.randrange(10**9)}" for _ in range(400)]
        docs += [edited(rng, base, e) for e in edits]
    rng.shuffle(docs)
    rows = list(enumerate(docs))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs_of(rows), k=1, percent=80).collect()}
    assert got == jaccard_brute(rows, 1, 80)
    assert len({c for _, c in got.values()}) > 50 and (rounds or len(compared) >= 4)


def repeats_brute(texts: list[str | None], length: int = 400) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, from all strings of ``length`` bytes."""
    raws = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, np.int64)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = (np.cumsum(gone)[:-1] > 0) if len(r) else np.zeros(0, bool)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_jaccard_tells_sets_of_one_key_apart(docs_of, spark, monkeypatch):
    """Keys of 64 bits may be shared by different sets; here a third of all sets share one."""
    real = jaccard.set_key
    monkeypatch.setattr(jaccard, "set_key", lambda s: real(s) // 3 * 3 if len(s) % 3 else 12345)
    sets = [np.unique(np.array([hash((i, j)) for j in range(n)], np.int64).view(np.uint64)) for i, n in enumerate((3, 3, 6, 9, 4, 5))]
    assert len({jaccard.class_of(s, frozenset()) for s in sets}) < len({jaccard.class_of(s, frozenset({12345})) for s in sets}) == 6
    assert jaccard.class_of(sets[0], frozenset({12345})) == jaccard.class_of(sets[0].copy(), frozenset({12345}))


def test_subset_keys_have_two_hashes(docs_of, monkeypatch):
    """With a first hash of subsets that tells nothing, the second one alone keeps other sets apart."""
    rng = random.Random(24)
    docs = [f"{a} {b} {c}" for a, b, c in zip(*(texts(rng, 40, 300, 1, 2) for _ in range(3)), strict=True)] * 2
    rows = list(enumerate(docs))
    found = jaccard.postings(docs_of(rows), 1, 80, 10, frozenset()).where("light").collect()
    second = {(r["class"], r["packed"]) for r in found}
    assert len({r["packed"] for r in found}) > 0.9 * len({r["key"] for r in found}) and len(second) == len({(r["class"], r["key"]) for r in found})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs_of(rows), k=1, percent=80).collect()}
    assert got == jaccard_brute(rows, 1, 80)


@pytest.mark.parametrize("hot", [100_000, 2])
def test_repeats(docs_of, hot):
    rng = random.Random(hot)
    passage = texts(rng, 3, 300, 90, 200)
    docs = [f"{a} {p[rng.randint(0, 60):]} {b}" for p in passage for a, b in zip(texts(rng, 6, 400), texts(rng, 6, 400), strict=True)]
    docs += texts(rng, 10, 400) + [docs[0], docs[0] + "é", "ab" * 900, " " * 1500, "x" * 399, "y" * 400, "y" * 400, None, "", passage[0] * 2]
    rows = list(enumerate(docs))
    out = repeats.removed(docs_of(rows), hot=hot, short=240).collect()
    shared = {r["doc_id"]: sum(s["stop"] - s["start"] for s in r["shared"]) for r in out}
    assert shared == dict(zip(range(len(docs)), (n for _, n, _, _ in repeats_brute(docs, 240)), strict=True))
    got = {r["doc_id"]: (r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in out}
    assert got == dict(zip(range(len(docs)), repeats_brute(docs), strict=True))


def test_repeat_groups_list_all_occurrences(docs_of):
    rng = random.Random(5)
    core = texts(rng, 1, 300, 120, 120)[0]
    docs = [f"{a} {core} {b}" for a, b in zip(texts(rng, 4, 400, 20, 40), texts(rng, 4, 400, 20, 40), strict=True)]
    rows = repeats.groups(docs_of(list(enumerate(docs)))).collect()
    by = {}
    for r in rows:
        by.setdefault(r["repeat"], set()).add((r["c1"], r["start"], r["size"]))
    assert max(len(v) for v in by.values()) == 4
    assert all(size >= 400 for v in by.values() for _, _, size in v)


def test_maximal_repeats_are_those_of_brute_force(docs_of):
    """Around each anchor: every string that occurs twice and can't be extended to either side without losing an occurrence."""
    rng = random.Random(15)
    core = texts(rng, 2, 300, 60, 60)
    docs = [f"{a} {c[:cut]} {b}" for c in core for cut in (300, 260) for a, b in [("lorem ipsum " * 3, "dolor"), ("lorem ipsum " * 3, "amet sit"), ("other words", "dolor")]]
    length = 100
    got = {}
    for r in repeats.groups(docs_of(list(enumerate(docs))), length=length).collect():
        got.setdefault(r["repeat"], set()).add((r["c1"], r["start"], r["size"]))
    names = {r["c1"]: r["doc_id"] for r in repeats.texts(docs_of(list(enumerate(docs))), "doc_id", "text").collect()}
    found = {frozenset((names[c], at, size) for c, at, size in v) for v in got.values()}
    want = set()
    raws = [d.encode() for d in docs]
    for raw in raws:
        place, _ = repeats.anchors(raw, length)
        for p in place.tolist():
            spots = [(i, q) for i, x in enumerate(raws) for q in repeats.anchors(x, length)[0].tolist() if x[q : q + 32] == raw[p : p + 32]]
            around = {(i, q): (raws[i][max(0, q - length + 32) : q][::-1], raws[i][q : q + length]) for i, q in spots}

            def agree(x, y):
                return next((k for k, (s, t) in enumerate(zip(x, y, strict=False)) if s != t), min(len(x), len(y)))

            for one in spots:
                for two in spots:
                    if one < two:
                        back, on = agree(around[one][0], around[two][0]), agree(around[one][1], around[two][1])
                        if back + on >= length:
                            all_of = [s for s in spots if agree(around[one][0], around[s][0]) >= back and agree(around[one][1], around[s][1]) >= on]
                            want.add(frozenset((i, q - back, back + on) for i, q in all_of))
    assert found == want and len(want) > 5


def test_groups_of_hot_anchors_and_of_one_text(docs_of):
    line = "the same line of text again and again, number none, "
    docs = [(1, line * 12), (2, "x " + line * 9 + "y")]
    cold = {}
    for r in repeats.groups(docs_of(docs), length=120).collect():
        cold.setdefault(r["repeat"], set()).add((r["c1"], r["start"]))
    assert max(map(len, cold.values())) > 8
    hot = repeats.groups(docs_of(docs), length=120, hot=1).collect()
    assert hot and all(r["size"] == 120 for r in hot)


def test_decontaminate(spark, docs_of):
    rng = random.Random(2)
    items = [(i, t) for i, t in enumerate(texts(rng, 8, 200, 20, 40))]
    edited = []
    for i, t in items:
        c = list(t)
        for _ in range(int(len(t) * 0.08)):
            c[rng.randrange(len(c))] = rng.choice("qwz")
        edited.append((100 + i, "before " + "".join(c).upper() + "!! after"))
    clean = list(enumerate(texts(rng, 20, 200)))
    found = decontaminate.matches(docs_of(edited + clean), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"] - 100, r["item_id"]) for r in found} == {(i, i) for i, _ in items}


def test_matcher_finds_what_a_table_finds():
    rng = random.Random(3)

    def brute(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            prev, row = row, [i] + [0] * len(t)
            for j, d in enumerate(t, 1):
                row[j] = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (c != d))
        return min(row)

    for _ in range(300):
        p = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 60)))
        q = [c if rng.random() > 0.1 else rng.choice("abc") for c in p]
        t = "".join(rng.choice("abcd") for _ in range(20)) + "".join(q) + "abcd"
        found, d, k = decontaminate.Matcher([(0, p)], 0.15).match(t), brute(p, t), int(len(p) * 0.15)
        assert [f[1] for f in found] == ([d] if d <= k else [])


def test_packing_round_trip(docs_of, awkward):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary())
    rng = random.Random(4)
    docs = {i: t for i, t in awkward if i is not None} | {100 + i: t for i, t in enumerate(texts(rng, 40, 300, 1, 900))} | {200: "don't O'Neil's 3.14 Straße ÀÉ é <|endoftext|> x_y ... ?!) ²½ ﬁ"}
    out = packing.pack(docs_of(list(docs.items())), queries.vocabulary()).collect()
    windows = {}
    for r in out:
        ids = np.array([*tok.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids, 2], "<u4")
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    for i, t in docs.items():
        mine = sorted((r["start"], r["length"]) for r in out if r["doc_id"] == i)
        assert [s for s, _ in mine] == [0, *np.cumsum([n for _, n in mine])[:-1].tolist()]
    full = sum(n for p in windows.values() for _, n in p)
    assert len(windows) * 4096 - full < 0.05 * full + 2 * 4096


def test_cuts_are_the_best_ones():
    """Against a table of all windows, with the last window closed and open."""
    rng = random.Random(19)

    def pad(n, size):
        return 0 if n & (n - 1) == 0 else size - n

    for _ in range(300):
        size, price = rng.choice((16, 64, 100)), rng.choice((0.0, 5.0))
        ends = np.cumsum([rng.randint(1, size) for _ in range(rng.randint(1, 40))])
        costs = np.array([rng.choice((0.0, 1.0, 4.0)) for _ in ends])
        places, fees = [0, *ends.tolist()], [0.0, *costs.tolist()]
        best = [0.0] + [math.inf] * len(ends)
        for j in range(1, len(places)):
            best[j] = min(best[i] + pad(places[j] - places[i], size) + price for i in range(j) if places[j] - places[i] <= size) + fees[j]

        def cost(taken):
            return sum(pad(b - a, size) + fees[places.index(b)] + price for a, b in zip([0, *taken], taken, strict=False))

        taken = packing.cuts(ends, costs, size, price=price)
        assert taken[-1] == ends[-1] and all(0 < b - a <= size for a, b in zip([0, *taken], taken, strict=False))
        assert math.isclose(cost(taken), best[-1])
        taken = packing.cuts(ends, costs, size, False, price)
        assert math.isclose(cost(taken), min(best[k] for k in range(len(places)) if places[-1] - places[k] <= size)) or not taken


def test_suffix_tree(spark, sf):
    docs = table(spark, sf, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = queries.op2_suffix_tree(spark, sf).collect()
    words = lambda t: (t or "").encode().lower().split() + [b""]
    c = Counter(w for i, t in rows.items() if zlib.crc32(str(i).encode()) % 10 for w in words(t))
    n, v = sum(c.values()), len(c)
    for r in out:
        w = words(rows[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in c for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
    held = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_rare_words_are_joined(spark, sf):
    docs = table(spark, sf, "documents")
    a, b = ({r["doc_id"]: r for r in suffix_lm.score(docs, F.col("doc_id") % 3 != 0, frequent=f).collect()} for f in (50, 10**6))
    assert all(a[i]["n_known"] == b[i]["n_known"] and math.isclose(a[i]["base_score"], b[i]["base_score"], rel_tol=1e-9) for i in a)


def test_suffix_tree_is_a_distribution(docs_of):
    tree = suffix_lm.grow(docs_of([(i, "abab abba baab " * 20) for i in range(20)]).where("doc_id >= 0"), depth=3, p_min=1e-4)
    a = suffix_lm.Automaton(tree)
    p = 10 ** a.p.reshape(-1, a.a).astype(float)
    p[:, -1] *= 256 - (a.a - 1)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    # The automaton's states agree with a search for the longest retained suffix.
    x = b"\n\n\n" + b"abab abba \n"
    contexts = set(zip(tree.length.tolist(), tree.context.tolist(), strict=True))
    total = 0.0
    for i in range(3, len(x)):
        d = max(d for d in range(4) if (d, int.from_bytes(x[i - d : i], "big")) in contexts)
        total += math.log10(prob(tree, x[i - d : i], x[i]))
    assert math.isclose(total, a.score([[b"abab", b"abba"]])[0], rel_tol=1e-4)


def test_suffix_tree_grows_with_the_corpus(docs_of, spark):
    # One context of 20 occurrences, in a corpus of more than 10 million positions.
    docs = [(i, "abab abba baab " * 35_000) for i in range(20)] + [(20, "zqxyw " * 20)]
    tree = suffix_lm.grow(docs_of(docs))
    assert (1, ord("z")) in set(zip(tree.length.tolist(), tree.context.tolist(), strict=True))


def test_suffix_tree_in_blocks_scores_like_the_automaton(spark, sf):
    docs = table(spark, sf, "documents").where("doc_id < 100")
    train = F.col("doc_id") % 3 != 0
    a, b, c = ({r["doc_id"]: r["score"] for r in suffix_lm.score(docs, train, **how).collect()} for how in ({"dense": 10**9}, {"dense": 0}, {"dense": 0, "block_rows": 3000}))
    assert a.keys() == b.keys() == c.keys()
    assert all(math.isclose(a[i], b[i], rel_tol=1e-5) and math.isclose(b[i], c[i], rel_tol=1e-9) for i in a)


def test_score_mixes_tree_and_word_shares(docs_of, spark):
    """Recomputed word by word, with the rare words broadcast and joined."""
    docs = docs_of([(i, f"abab abba baab w{i % 7} u{i}") for i in range(40)])
    train, how = F.col("doc_id") % 4 != 0, {"depth": 3, "least": 4, "divergence": 2.0}
    tree = suffix_lm.grow(docs.where(train), **how)
    rows = {r["doc_id"]: r["text"].encode().split() for r in docs.collect()}
    c = Counter(w for i, ws in rows.items() if i % 4 for w in [*ws, b""])
    n, v = sum(c.values()), len(c)
    contexts = set(zip(tree.length.tolist(), tree.context.tolist(), strict=True))

    def spelled(ws):
        x = b"\n" * 3 + b"".join(w + b" " for w in ws) + b"\n"
        at, out = 3, []
        for size in [*(len(w) + 1 for w in ws), 1]:
            total = 0.0
            for i in range(at, at + size):
                d = max(d for d in range(4) if (d, int.from_bytes(x[i - d : i], "big")) in contexts)
                total += math.log10(prob(tree, x[i - d : i], x[i]))
            out.append(total)
            at += size
        return out

    for frequent in (1000, 2):
        for r in suffix_lm.score(docs, train, frequent=frequent, **how).collect():
            ws = rows[r["doc_id"]]
            want = sum(math.log10(0.5 * 10**t + 0.5 * (c[w] + 0.1) / (n + 0.1 * (v + 1))) for w, t in zip([*ws, b""], spelled(ws), strict=True))
            assert math.isclose(r["score"], want, rel_tol=1e-4)


def test_suffix_tree_depth(docs_of):
    docs = docs_of([(i, "abc abd " * 9) for i in range(4)])
    assert suffix_lm.score(docs, F.lit(True), depth=6, least=2, divergence=0.5).count() == 4
    with pytest.raises(ValueError, match="depth"):
        suffix_lm.score(docs, F.lit(True), depth=7)


def test_divergence_is_recomputed(docs_of):
    """The contexts that stay are those that a plain count of divergences retains, with their suffixes."""
    rng = random.Random(21)
    docs = texts(rng, 30, 12, 10, 60)
    tree = suffix_lm.grow(docs_of(list(enumerate(docs))), depth=3, least=5, divergence=4.0)
    n = {}
    for t in docs:
        x = b"\n" * 3 + b"".join(w + b" " for w in t.encode().split()) + b"\n"
        for i in range(3, len(x)):
            for d in range(4):
                n.setdefault((d, x[i - d : i]), Counter())[x[i]] += 1
    kept = set()
    for (d, c), follow in n.items():
        total, up = sum(follow.values()), n.get((d - 1, c[1:]))
        if d and total >= 5 and sum(k * math.log(k / total / (up[a] / sum(up.values()))) for a, k in follow.items()) > 4.0:
            kept |= {(k, c[d - k :]) for k in range(1, d + 1)}
    got = {(int(k), int(c).to_bytes(int(k), "big")) for k, c in zip(tree.length, tree.context, strict=True) if k}
    assert got == kept


def prob(tree, context, symbol):
    rows = (tree.length == len(context)) & (tree.context == int.from_bytes(context, "big"))
    n, k = tree.count[rows].sum(), rows.sum()
    c = tree.count[rows & (tree.symbol == symbol)].sum()
    if not context:
        return (c + 0.5) / (n + 0.5 * 256)
    return (c + k * prob(tree, context[1:], symbol)) / (n + k)


def base_pii(t):
    o = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    o += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    o += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
    o += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(o)


def test_pii_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("a1.@+-2 9(") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == base_pii(t)


def test_pii_long_runs_take_linear_time():
    assert pii.base_spans("a" * 300_000 + "@" + "1" * 300_000 + " 1.2.3.4 " + "+" * 100_000)[-1][1] == 1


def test_disclosing_terms(docs_of):
    rng = random.Random(6)
    filler = texts(rng, 60, 400, 30, 60)
    docs = [f"{t} call zanzibar reach bob@corp.example now {u}" for t, u in zip(filler[:10], filler[10:20], strict=True)]
    docs += [f"{t} {u}" for t, u in zip(filler[20:40], filler[40:60], strict=True)]
    out = {r["doc_id"]: r for r in pii.spans(docs_of(list(enumerate(docs)))).collect()}
    assert all({s["kind"] for s in out[i]["spans"]} >= {"email", "term"} for i in range(10))
    assert all("zanzibar" not in out[i]["sanitised"] and "[EMAIL]" in out[i]["sanitised"] for i in range(10))
    assert all(not out[i]["spans"] for i in range(10, 30))
    joined = {r["doc_id"]: r["sanitised"] for r in pii.spans(docs_of(list(enumerate(docs))), broadcast_terms=0).collect()}
    assert joined == {i: r["sanitised"] for i, r in out.items()}


def test_disclosing_terms_are_those_of_a_plain_count(docs_of):
    """n, df, P(v | t), bits and the choice of terms, recounted; words are long, so that windows of characters would miss some."""
    rng = random.Random(16)
    pool = ["".join(rng.choice("abcdefghij") for _ in range(rng.choice((3, 5, 60)))) for _ in range(25)]
    values = ["one@example.com", "two@example.com", "10.1.2.3"]
    terms = [["quorvex", "blandip"], ["zanzibar" * 9, "mirbel"], ["ostrander", "quorvex"]]
    docs = []
    for _ in range(120):
        words = [rng.choice(pool) for _ in range(rng.randint(3, 30))]
        for _ in range(rng.randint(0, 2)):
            v = rng.randrange(3)
            at = rng.randint(0, len(words))
            words[at:at] = [values[v], rng.choice(terms[v])]
        if rng.random() < 0.1:
            words.append(rng.choice(terms[0]))
        docs.append(" ".join(words))
    docs += docs[:10] * 3
    n, df, df_value, around = Counter(), Counter(), Counter(), {}
    for t in docs:
        places = [(m.start(), m.end(), v) for v in values for m in re.finditer(re.escape(v), t)]
        near = set()
        for a, b, v in places:
            ws = re.findall(r"[^\W_]+", t[:a].lower())[-12:] + re.findall(r"[^\W_]+", t[b:].lower())[:12]
            for w in {w for w in ws if len(w) >= 4 and w.isalpha()}:
                near.add((w, v))
                around.setdefault((w, v), set()).add(" ".join(ws))
        n.update(near)
        df.update(set(re.findall(r"[^\W_]+", t.lower())))
        df_value.update({v for _, _, v in places})
    want = {}
    for (w, v), k in n.items():
        p = min(1.0, k / df[w])
        bits = math.log2(k / df[w] * len(docs) / df_value[v])
        if len(around[w, v]) >= 3 and p >= 0.5 and bits >= 1.0:
            want[w, v] = (k, df[w], round(p, 9), round(bits, 9))
    got = {(r["term"], r["value"].partition(":")[2]): (r["n"], r["df"], round(r["p"], 9), round(r["bits"], 9)) for r in pii.disclosing(docs_of(list(enumerate(docs)))).collect()}
    assert got == want and want


def test_copies_disclose_nothing(docs_of):
    t = "alpha bravo charlie delta someone@host.example echo foxtrot golf hotel"
    out = pii.spans(docs_of([(i, t) for i in range(30)])).collect()
    assert {s["kind"] for r in out for s in r["spans"]} == {"email"}


def test_copies_hide_no_terms(docs_of):
    # Four distinct documents, each copied ten times: the term is beside the address in all of them.
    docs = [f"start{j} word{j} zorblax mail a@example.com end{j}" for j in range(4) for _ in range(10)] + [f"plain text {i}" for i in range(2000)]
    got = {r["term"]: r for r in pii.disclosing(docs_of(list(enumerate(docs)))).collect()}
    assert (got["zorblax"]["n"], got["zorblax"]["df"], got["zorblax"]["p"]) == (40, 40, 1.0)


def test_common_values_are_not_disclosed(docs_of):
    # A contact address in a third of all documents: a rare word beside it tells next to nothing.
    docs = [f"text{i} and words{i}" + (" mail info@example.com" if i % 3 == 0 else "") for i in range(600)] + [f"lead{j} quorvex{' mail info@example.com' * (j < 3)} tail{j}" for j in range(5)]
    assert "quorvex" not in {r["term"] for r in pii.disclosing(docs_of(list(enumerate(docs)))).collect()}


def test_secrets(docs_of):
    rng = random.Random(8)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    words = texts(rng, 30, 300)
    docs = [(1, f"see {key} there"), (2, "password = 'hunter22' and secret: token: abcdefgh"), (3, "AKIA" + "A1" * 8 + " short AKIA12"), (4, "0123456789abcdef01234567 x 0123456789abcdef"), (5, "internationalization_of_configurations thenationalistedly_andthereforeinternational"), *((100 + i, w) for i, w in enumerate(words))]
    out = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secret_scan.spans(docs_of(docs)).collect()}
    assert out[1] == [("random", 4, 44)]
    assert [s[0] for s in out[2]] == ["assign"]
    assert out[3] == [("access", 0, 20)]
    assert out[4] == [("hex", 0, 24)]
    assert all(out[i] == [] for i in out if i >= 100 or i == 5)


def base_secrets(t):
    o = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    o += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    o += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(o)


def test_secret_patterns(docs_of):
    """Base spans against plain patterns, also where a text has more matches than are placed at once."""
    rng = random.Random(17)
    parts = ["password", "Token", "api_key", "SECRET", '"', "'", " ", "=", ":", "abc123", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "deadbeef", "é", "\U0001f600", ".", "-", "\n"]
    docs = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["".join(rng.choice(parts) for _ in range(6000)) for _ in range(3)]
    kinds = secret_scan.KINDS
    for r in secret_scan.spans(docs_of(list(enumerate(docs)))).collect():
        assert [(s["start"], kinds.index(s["kind"]), s["end"]) for s in r["spans"] if s["kind"] != "random"] == base_secrets(docs[r["doc_id"]])


def test_secret_ratios_are_recomputed(docs_of):
    import base64

    docs = ["some words_of-ordinary text, some again", "more words: identifier_names/and-such x1", "Qx7Kp2Zt9Wm4Rv8Lb3Ny6 is longer than what is learned from", "", None]
    got = secret_scan.ratios(docs_of(list(enumerate(docs))), samples=40)
    a = secret_scan.ALPHABET
    seen = Counter(w for t in docs for w in re.findall(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{2,16}(?![A-Za-z0-9+/_=-])", t or ""))
    samples = []
    for i in range(40):
        raw = hashlib.sha256(str(i).encode()).hexdigest()
        b = base64.b64encode(bytes.fromhex(raw)).decode()
        samples.append([b, raw, b.upper(), b.translate(str.maketrans("+/=", "Ab0"))][i % 4])

    def pairs(tokens):
        n = Counter()
        for t, weight in tokens:
            for x, y in zip(["", *t], t, strict=False):
                n[x, y] += weight
        return n

    models = [pairs((t, 1.0) for t in samples), pairs((f"{w}_{w}-{w}/{w}", math.log2(k + 1)) for w, k in seen.items())]
    models.append(Counter(secret_scan.known_words()))
    p = []
    for m in models:
        single = Counter({y: 0.5 for y in a})
        for (_, y), k in m.items():
            single[y] += k
        classes = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "+/_=-"]
        mean = {y: sum(single[z] for z in c) / len(c) for c in classes for y in c}
        share = {y: (single[y] + mean[y]) / 2 / sum(single.values()) for y in a}
        p.append([(m[x, y] + 4 * share[y]) / (sum(m[x, z] for z in a) + 4) for x in ["", *a] for y in a])
    want = [math.log2(r / ((o + w) / 2)) for r, o, w in zip(*p, strict=True)]
    assert np.allclose(got, want)
    assert not any("Qx7" in w for w in seen)


def test_short_secrets_need_the_more_evidence(docs_of):
    rng = random.Random(18)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(letters) for _ in range(n)) for n in (17, 19, 30) for _ in range(10)]
    docs = [(i, f"see {k} here") for i, k in enumerate(keys)] + [(100 + i, t) for i, t in enumerate(texts(rng, 30, 300))] + [(200, "internationalizations responsibilities-and-others")]
    out = {r["doc_id"]: r["spans"] for r in secret_scan.spans(docs_of(docs)).collect()}
    assert sum(bool(out[i]) for i in range(30)) >= 28 and not any(out[i] for i in out if i >= 100)
    assert sum(bool(r["spans"]) for r in secret_scan.spans(docs_of(docs), evidence=1000.0).collect()) == 0


def test_hnsw_links_are_those_of_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    x = np.concatenate([centres[rng.integers(0, 40, 900)] + 0.12 * rng.normal(size=(900, 32)), rng.normal(size=(600, 32)), np.repeat(centres[:1], 30, axis=0)])
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    out = sorted(hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), shards=3).collect())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    got = np.array([r["n_links"] for r in out])
    assert (got <= near.sum(axis=1)).all() and got.sum() >= 0.98 * near.sum()


def test_hnsw_audit_leaves_out_hits_on_oneself():
    """A graph without links between nodes finds each vector itself only: its recall is none until the beam is the whole shard."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(100, 16)), 2, axis=0) + 0.01 * rng.normal(size=(200, 16))
    graph = hnsw.Graph(x)
    u = hnsw.unit(x)
    assert graph.audit(0.9, u[:20], np.arange(20), 64, 50, 0.99) >= 0.99
    for lists in graph.lists:
        lists[:] = -1
    graph.ef = 4
    graph.audit(0.9, u[:0], np.zeros(0, np.int64), 64, 50, 0.99)
    assert 2 * graph.ef >= len(x)
    # Vectors of other shards count as well.
    graph.ef, graph.x = 4, graph.x.copy()
    assert (graph.audit(0.9, u + 0.001, np.full(200, -1), 64, 50, 0.99) >= 0.99) and 2 * graph.ef >= len(x)


def test_statistics_count_all_words():
    # Every 16th of 1,600 words is one of its own; junk and capitals stand between them only.
    words = [f"word{i}" if i % 16 == 0 else "Junk" if i % 2 else f"Other{i}" for i in range(1600)]
    got = dict(zip(quality.STATISTICS, quality.statistics(" ".join(words)), strict=True))
    assert got["top_share"] == 800 / 1600
    words = ["Name" if i % 2 else f"word{i}" for i in range(1024)]
    got = dict(zip(quality.STATISTICS, quality.statistics(" ".join(words)), strict=True))
    assert got["upper_first"] == got["top_share"] == 0.5


def test_trees_walk_like_one_row_at_a_time():
    rng = np.random.default_rng(20)
    x, y = rng.normal(size=(400, 5)), None
    y = (x[:, 0] + x[:, 1] ** 2 + 0.1 * rng.normal(size=400) > 0.5).astype(float)
    forest = quality.fit(x, y, rounds=30, depth=3)

    def walk(row):
        z = forest.base
        for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf, strict=True):
            k = 0
            while k < len(feature):
                k = 2 * k + 2 if row[feature[k]] > cut[k] else 2 * k + 1
            z += leaf[k - len(feature)]
        return 1 / (1 + math.exp(-z))

    assert np.allclose(forest.score(x), [walk(r) for r in x]) and ((forest.score(x) > 0.5) == y).mean() > 0.9


def test_first_split_is_the_best_one():
    """A tree of one level against all splits of all statistics."""
    rng = np.random.default_rng(22)
    x = rng.integers(0, 12, size=(80, 3)).astype(float)
    y = (x[:, 2] > 6).astype(float)
    y[:6] = 1 - y[:6]
    forest = quality.fit(x, y, rounds=1, depth=1)
    g, h = np.full(80, (y.sum() + 1) / 82) - y, np.full(80, (y.sum() + 1) / 82 * (1 - (y.sum() + 1) / 82))
    gain = {}
    for f in range(3):
        for c in np.unique(x[:, f]):
            left = x[:, f] <= c
            if h[left].sum() >= 4 and h[~left].sum() >= 4:
                gain[f, c] = g[left].sum() ** 2 / (h[left].sum() + 2) + g[~left].sum() ** 2 / (h[~left].sum() + 2)
    f, c = max(gain, key=gain.get)
    assert forest.feature[0, 0] == f and ((x[:, f] <= forest.cut[0, 0]) == (x[:, f] <= c)).all()


def test_languages_are_scored_like_a_plain_count(docs_of, spark):
    """Words by their log frequency, unseen ones by the longest known n-grams, recomputed without batches or memos."""
    rng = random.Random(23)
    docs = [(i, " ".join("".join(rng.choice(a) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 12)))) for i, a in enumerate(["abcde", "defgh"] * 40)]
    rows = spark.createDataFrame([(i, t, "xy"[i % 2]) for i, t in docs], "doc_id long, text string, lang string")
    model = langid.train(rows.where("doc_id < 40"), top_words=30, top_grams=40)
    counts = {(lang, n): Counter() for lang in "xy" for n in (0, 5, 4, 3, 2, 1)}
    for i, t in docs[:40]:
        for w in t.split():
            counts["xy"[i % 2], 0][w] += 1
            for n in (5, 4, 3, 2, 1):
                counts["xy"[i % 2], n].update(f"^{w}$"[k : k + n] for k in range(len(w) + 3 - n))
    kept = {k: dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[: 40 if k[1] else 30]) for k, c in counts.items()}

    def log(n, g):
        v = len(set(kept["x", n]) | set(kept["y", n])) + 1
        return [math.log((kept[x, n].get(g, 0) + 0.5) / (sum(kept[x, n].values()) + 0.5 * v)) for x in "xy"]

    def word(w):
        if any(w in kept[x, 0] for x in "xy"):
            return log(0, w)
        for n in (5, 4, 3, 2, 1):
            known = [g for k in range(len(w) + 3 - n) if any((g := f"^{w}$"[k : k + n]) in kept[x, n] for x in "xy")]
            if known:
                return [sum(log(n, g)[x] for g in known) / len(known) for x in (0, 1)]
        return [0.0, 0.0]

    for r in langid.predict(rows, model, ["doc_id"]).collect():
        ws = docs[r["doc_id"]][1].split()
        if not ws:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        z = [sum(word(w)[x] for w in ws) * min(len(ws), langid.EVIDENCE) / len(ws) for x in (0, 1)]
        p = 1 / (1 + math.exp(min(700, abs(z[0] - z[1])) * -1))
        assert r["lang_pred"] == ("x" if z[0] >= z[1] else "y") and math.isclose(r["score"], p, rel_tol=1e-6)


def test_quality_and_language_on_held_out_rows(spark, sf):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    q = [r for r in queries.op6_quality(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in q) >= 0.8 * len(q)
    langs = {r["doc_id"]: r["lang"] for r in table(spark, sf, "documents").collect()}
    g = [r for r in queries.op7_language(spark, sf).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in g) >= 0.97 * len(g)
