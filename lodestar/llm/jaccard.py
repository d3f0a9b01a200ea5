"""Exact Jaccard self-join of shingle sets, light sets by subsets and heavy ones by lists.

Equal sets form one class, which joins as one. Two classes of sizes a <= b link when
their overlap is at least o(a, b) = ceil(p (a + b) / (100 + p)) for p per cent.

* Light: a class with a <= boundary, and any that such a class may link with, lists the
  hashes of its subsets of the sizes o(.) that may matter. Two classes link exactly when
  they share a subset of at least o(a, b) elements, so no sets need be compared.
* Heavy: all other pairs share an element among the first n - ceil(p n / 100) + 1 of each
  set, in any order that all sets follow. Elements with the rarest words come first in it, and
  elements that repeat last, so that the inverted lists of these elements are short.
  Candidates from a list pass size and position filters, and their sets are compared.

The boundary is the one with the least estimated cost over the sizes at hand: subsets
listed against elements listed and the probing of their lists.

Inverted lists of more than a few members are scanned without forming all their pairs: in
a few rounds every member is compared with one of the list, a different one each round; members already in one
component are not compared again. Of long lists' pairs only those go on whose parities leave
room for a link: the bits in which they differ are at most the elements that one set has alone.
What is left after the rounds, such pairs of a list in different components, is looked
through in blocks, and every member hands on its nearest few by parities: those that link unite
their components, whose other pairs need no comparison. Members with more pairs left hand on more
of them the next time, until none has, so the components are exact and what is handed on follows
the lists' lengths; only pairs that parities can't tell apart and that don't link are all compared.

Elements are 64-bit hashes of shingles. Equality of sets is told by two hashes of 64 bits: the
first names the class, and sets of one class that differ in the second (which takes some 10^9
different sets to happen) get names of their own. Subsets are told apart by 64 and 52 bits.

Defined cases: null, empty and blank texts have empty sets and link with nothing; a null id
keeps its row, links with nothing and has a null component; rows that share an id are one
document; equal sets are one class and no ties arise between them, as components are named by
their smallest id; very long texts are hashed whole, one at a time; an empty table gives no
rows; columns beside the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.checkpoints import cut
from lodestar.llm.common import arrow_map, components, drawn, few, sweep, texts_of
from lodestar.llm.shingles import ODD, mix, ranked_sets, set_check, set_key, shingle_sets

#: Bytes of text whose shingles are hashed at once; each takes some forty bytes meanwhile.
CHUNK = 1 << 20
#: How many documents the order of elements is taken from; slots for words' counts; from which count on an element repeats.
SAMPLE, WORD_TABLE, OFTEN = 20_000, 1 << 20, 3
#: Of an element in an inverted list against one subset: storing it, and probing its list.
PROBE = 4
LARGEST_LIGHT = 24
ROUNDS = 2
#: Lists of so many members at most have all their pairs compared at once.
FEW = 4
#: Bits by which sets of a long list are told apart before they are compared.
PARITY = 1024
#: Of a long list's member, the pairs compared in the first pass over what the rounds have left; how many times as many in each next one; members of a block.
NEAREST, MORE, BLOCK = 2, 8, 4096
#: Pairs of a block looked through at once.
PAIRS = 1 << 18
#: Keys before each of its own that a class brings to a long list, so that two classes seldom meet more than once.
BEFORE = 16
#: Sets that a task remembers having listed, to list copies once.
REMEMBERED = 200_000
#: Bits of a subset's second hash.
SECOND = 52


def overlap(a: int, b: int, percent: int) -> int:
    return -(-percent * (a + b) // (100 + percent))


def partners(n: int, percent: int) -> range:
    """Sizes that a set of n elements can link with."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_sizes(n: int, percent: int, boundary: int) -> list[int]:
    """Sizes of the subsets that a set of n elements lists, for pairs whose smaller set is light."""
    return sorted({overlap(n, m, percent) for m in partners(n, percent) if min(n, m) <= boundary and overlap(n, m, percent) <= min(n, m)})


def prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def choose_boundary(sizes: dict[int, int], percent: int) -> int:
    """The largest light size, by the least cost. sizes: how many sets have each size."""

    def cost(x: int) -> int:
        light = sum(c * sum(comb(n, k) for k in subset_sizes(n, percent, x)) for n, c in sizes.items() if n <= 100 * x // percent)
        return light + sum(c * prefix(n, percent) * (1 + PROBE) for n, c in sizes.items() if n > x)

    return min(range(min(LARGEST_LIGHT, 63 * percent // 100) + 1), key=cost)  # sizes up to 63 fit a packed row


def chunks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """The first column and the sets of a few texts at a time."""
    for b in batches:
        texts, at, size = texts_of(b, "text"), 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= CHUNK or i + 1 == len(texts):
                yield b.column(0).slice(at, i + 1 - at), shingle_sets(texts[at : i + 1], k)
                at, size = i + 1, 0


def text_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    """A few texts at a time."""
    for b in batches:
        texts, at, size = texts_of(b, "text"), 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= CHUNK or i + 1 == len(texts):
                yield texts[at : i + 1]
                at, size = i + 1, 0


def class_of(s: np.ndarray, shared: frozenset[int]) -> int:
    """A set's class: its key, or where different sets have the same key (shared), that mixed with its check."""
    key = set_key(s)
    return int(mix(np.array([key, set_check(s)], np.int64).view(np.uint64)).view(np.int64).sum()) if key in shared else key


def classes(docs: DataFrame, k: int, shared: frozenset[int] = frozenset()) -> DataFrame:
    """(doc_id, n_shingles, class, check) for each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in chunks(batches, k):
            values = [pa.array([f(s) if len(s) else None for s in sets], pa.int64()) for f in (lambda s: class_of(s, shared), set_check)]
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), *values], names=["doc_id", "n_shingles", "class", "check"])

    return arrow_map(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, class long, check long")


def subsets(mixed: np.ndarray, gone: int) -> np.ndarray:
    """Sums of all subsets of the elements that leave ``gone`` out."""
    left = np.array(list(combinations(range(len(mixed)), gone)), np.int64)
    return mixed.sum() - mixed[left].sum(axis=1, dtype=np.uint64)


def rarity(docs: DataFrame, k: int, rows: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How frequent words are (by the low bits of their hash), and which elements repeat, with their counts.

    From a bounded, repeatable draw of documents, as this only orders a set's elements: any
    order that all sets follow gives the same results, a good one gives short lists.
    """
    n = docs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, elements = np.zeros(WORD_TABLE, np.int64), []
        for b in batches:
            for s, _, w in ranked_sets(texts_of(b, "text"), k, None):
                words += np.bincount(w & np.uint64(WORD_TABLE - 1), minlength=WORD_TABLE) if len(w) > 4096 else 0
                if len(w) <= 4096:
                    np.add.at(words, w & np.uint64(WORD_TABLE - 1), 1)
                elements.append(s)
        at = np.flatnonzero(words)
        e, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *elements]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), bool)), pa.array(at), pa.array(words[at])], names=["word", "e", "c"])
        for i in range(0, len(e), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(e[i : i + 100_000]), bool)), pa.array(e[i : i + 100_000].view(np.int64)), pa.array(c[i : i + 100_000].astype(np.int64))], names=["word", "e", "c"])

    some = docs.where(drawn("doc_id", min(1.0, rows / max(1, n)))).select("doc_id", "text")
    found = arrow_map(some.select("doc_id", "text"), run, "word boolean, e long, c long").groupBy("word", "e").agg(F.sum("c").alias("c"))
    got = found.where((F.col("word")) | (F.col("c") >= OFTEN)).toArrow()
    word, e, c = (got.column(x).to_numpy() for x in ("word", "e", "c"))
    table = np.zeros(WORD_TABLE, np.int32)
    table[e[word]] = np.minimum(c[word], (1 << 31) - 1)
    e, c = e[~word].view(np.uint64), c[~word]
    order = np.argsort(e)
    return table, e[order], c[order]


def postings(docs: DataFrame, k: int, percent: int, boundary: int, same: frozenset[int]) -> DataFrame:
    """What classes list: (light, key, class, packed) with subsets (light) and elements.

    packed is n << 32 and the place of an element; or n << 58, a subset's size << 52 and its second hash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rarity(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, often, counts = shared.value
        seen: set[int] = set()
        limit = 100 * boundary // percent
        for part in text_chunks(batches):
            keys, owners, sizes, light, places = [], [], [], [], []
            for s, rank, _ in ranked_sets(part, k, table):
                n = len(s)
                if not n or (key := class_of(s, same)) in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(key)
                if n <= limit:
                    mixed, again = mix(s), mix(s ^ ODD[41])
                    with np.errstate(over="ignore"):
                        for size in subset_sizes(n, percent, boundary):
                            keys.append(mix(subsets(mixed, n - size) + np.uint64(size)))
                            second = mix(subsets(again, n - size)) >> np.uint64(64 - SECOND)
                            places.append((second | np.uint64(size << SECOND)).astype(np.int64))
                    new = len(keys) - len(owners)
                    owners += [key] * new
                    sizes += [n] * new
                    light += [True] * new
                if n > boundary:
                    p = prefix(n, percent)
                    if len(often):
                        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                        rank = rank + np.where(often[at] == s, counts[at] << 32, 0)
                    keys.append(s[np.lexsort((s, rank))[:p]])
                    places.append(np.arange(p))
                    owners.append(key)
                    sizes.append(n)
                    light.append(False)
            each = np.fromiter(map(len, keys), np.int64, len(keys))
            flat = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
            place = np.concatenate([np.zeros(0, np.int64), *places])
            # n and place share a long: fewer bytes to shuffle
            shift = np.where(np.array(light, bool), SECOND + 6, 32)
            packed = np.repeat(np.array(sizes, np.int64) << shift, each) | place
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(light, bool), each)), pa.array(flat), pa.array(np.repeat(np.array(owners, np.int64), each)), pa.array(packed)], names=["light", "key", "class", "packed"])

    return arrow_map(docs.select("doc_id", "text"), run, "light boolean, key long, class long, packed long")


def shared_lists(rows: DataFrame) -> DataFrame:
    """The rows whose key at least two classes have, once for each class.

    Rows are shuffled once, by their key, and sorted; whether a key has another class shows
    in the row before or after, so a list of any length passes through a few rows of memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["light", "key", "class", "packed"]
        held: list[np.ndarray] | None = None  # the last row, whose next one is yet to come
        before = None  # light and key of the row before it

        def pick(x: list[np.ndarray], last: bool) -> pa.RecordBatch:
            nonlocal held, before
            light, key, cls, packed = x
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1]) | (light[1:] != light[:-1]) | light[1:] & (packed[1:] != packed[:-1])])
            light, key, _, _ = x = [v[new] for v in x]
            same = (key[1:] == key[:-1]) & (light[1:] == light[:-1])
            first = before is not None and before == (light[0], key[0])
            shared = np.concatenate([[first], same]) | np.concatenate([same, [False]])
            if not last:
                held = [v[-1:] for v in x]
                # What came before the held row: the row before it here, or else the one before this part.
                before = (light[-2], key[-2]) if len(key) > 1 else before
                shared[-1] = False
            return pa.RecordBatch.from_arrays([pa.array(v[shared]) for v in x], names=names)

        for b in batches:
            if b.num_rows:
                x = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
                yield pick(x if held is None else [np.concatenate([h, v]) for h, v in zip(held, x, strict=True)], last=False)
        if held is not None:
            yield pick(held, last=True)

    ordered = rows.repartition("light", "key").sortWithinPartitions("light", "key", "class")
    out = arrow_map(ordered, run, "light boolean, key long, class long, packed long")

    def bits(first: int, n: int):
        return F.shiftright("packed", first).bitwiseAND(F.lit((1 << n) - 1))

    n, place = (F.when(F.col("light"), of_light).otherwise(of_heavy) for of_light, of_heavy in ((bits(SECOND + 6, 6), bits(32, 31)), (bits(SECOND, 6), bits(0, 32))))
    return out.select("light", "key", "class", n.alias("n"), place.alias("place"), F.when(F.col("light"), bits(0, SECOND)).alias("second"))


def at_least(a: str, b: str, percent: int):
    """o(a, b) of two columns."""
    return F.ceil(F.lit(percent) * (F.col(a) + F.col(b)) / (100 + percent))


def fits(percent: int):
    """Size and position filters for a pair (n, place, m, spot) that shares an element there."""
    need = at_least("n", "m", percent)
    small = F.least("n", "m")
    return (100 * small >= percent * F.greatest("n", "m")) & (F.least(F.col("n") - F.col("place"), F.col("m") - F.col("spot")) >= need)


def links(docs: DataFrame, k: int, percent: int, sized: DataFrame, same: frozenset[int] = frozenset()) -> DataFrame:
    """Pairs (a, b) of classes, enough of them to connect every component of the linked classes. sized: (class, n, rep)."""
    histogram = {r["n"]: r["count"] for r in sized.where(F.col("n") <= 100 * LARGEST_LIGHT // percent + 1).groupBy("n").count().collect()}
    more = sized.where(F.col("n") > 100 * LARGEST_LIGHT // percent + 1).limit(1).count()
    boundary = choose_boundary(histogram, percent) if histogram or more else 0
    every = cut(shared_lists(postings(docs, k, percent, boundary, same)))
    # Subsets: every class with one is linked with the first of each size; sizes matter, as o(a, b) depends on them.
    found = _light(every.where("light"), percent, boundary)
    lists = every.where("not light").drop("light", "second").withColumn("prev", F.lag("key").over(Window.partitionBy("class").orderBy("place")))
    # The sets of listed classes; few against all, so their ids are sent to the scan where they are few enough.
    wanted = sized.join(lists.select("class").distinct(), "class", "left_semi").select("class", F.col("rep").alias("doc_id"))
    wanted = cut(wanted)
    sets = cut(_sets(docs.join(few(wanted.select("doc_id"), wanted.count()), "doc_id", "left_semi"), k, same))
    counts = lists.groupBy("key").agg(F.count("*").alias("members"))
    long = counts.where(F.col("members") > FEW).select("key")
    other = lists.select("key", F.col("class").alias("other"), F.col("n").alias("m"), F.col("place").alias("spot"), F.col("prev").alias("prev2"))
    # Two classes that have the same key before this one in common have met there.
    unmet = F.col("prev").isNull() | F.col("prev2").isNull() | (F.col("prev") != F.col("prev2"))
    # Lists of a few members: all their pairs at once.
    short = lists.join(long, "key", "left_anti")
    pairs = short.join(other, "key").where((F.col("class") < F.col("other")) & fits(percent) & unmet)
    pairs = cut(pairs.select(F.col("class").alias("a"), F.col("other").alias("b")).distinct())
    found = found.unionByName(cut(_compare(pairs, sets, percent)))
    # Along with the last few long lists' keys before each of its own: two classes with one of these in common have met there.
    before = F.collect_list("key").over(Window.partitionBy("class").orderBy("place").rowsBetween(-BEFORE, -1))
    lists = cut(lists.join(long, "key", "left_semi").withColumn("before", before).drop("prev").join(sets.groupBy("class").agg(F.first("parity").alias("parity")), "class"))
    # Elements in one set alone leave their bit of the parities different, unless two share it.
    apart = F.aggregate(F.zip_with("parity", "parity2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    near = fits(percent) & (apart <= F.col("n") + F.col("m") - 2 * at_least("n", "m", percent))
    sweep(docs.sparkSession)
    turn, most, tried = 0 if not lists.isEmpty() else None, NEAREST, None
    while turn is not None:
        label = components(found).withColumnsRenamed({"id": "class"})
        rows = lists.join(label, "class", "left").withColumn("label", F.coalesce("component", "class")).drop("component")
        spread = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members")).where("lo < hi").select("key", "members")
        rows = cut(rows.join(spread, "key"))
        if rows.isEmpty():
            break
        if turn < ROUNDS:
            order = F.xxhash64("class", F.lit(turn))
            head = rows.groupBy("key").agg(F.min_by(F.struct("class", "n", "place", "label", "parity"), order).alias("h")).select("key", F.col("h.class").alias("other"), F.col("h.n").alias("m"), F.col("h.place").alias("spot"), F.col("h.label").alias("label2"), F.col("h.parity").alias("parity2"))
            pairs = rows.join(head, "key").where((F.col("label") != F.col("label2")) & near)
            pairs = cut(pairs.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct())
            # One member of each list may have no pair that fits where others do: on to all pairs that are left.
            turn = ROUNDS if pairs.isEmpty() else turn + 1
        else:
            picked = cut(nearest(rows, percent, most))
            pairs = picked.select("a", "b").distinct()
            pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
            tried = pairs if tried is None else tried.unionByName(pairs)
            # Only lists with members that have more pairs than they have handed on are looked through again; without any, all pairs are compared.
            left = cut(picked.where("more IS NOT NULL").select(F.col("more").alias("key")).distinct())
            n = left.count()
            lists = lists.join(few(left, n), "key", "left_semi")
            turn, most = turn if n else None, most * MORE
        if not pairs.isEmpty():
            found = found.unionByName(cut(_compare(pairs, sets, percent)))
        sweep(docs.sparkSession)
    return found


def nearest(rows: DataFrame, percent: int, most: int) -> DataFrame:
    """Pairs (a, b, more) of lists' members in different components, for each member the ``most`` nearest by parities.

    Only pairs that fit, may link and first meet in the list count; more: the list's key where one of the two has further ones there, else null.
    Lists of more than BLOCK members are dealt out as pairs of blocks, so that a task holds two blocks at most.
    """
    blocks = F.ceil(F.col("members") / BLOCK)
    own, i, j = F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long")
    if rows.agg(F.max("members")).first()[0] > BLOCK:
        rows = rows.withColumn("own", F.pmod(F.xxhash64("class", F.lit("block")), blocks)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        own, i, j = F.col("own"), F.least("own", "with"), F.greatest("own", "with")
    dealt = rows.select("key", i.alias("i"), j.alias("j"), own.alias("own"), "class", "n", "place", "label", "before", "parity")

    def pick(x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the group of pairs, the smaller one first, and more, of each."""
        key, i, j, own, _, n, place, label, before, parities = x
        size, met = len(key), np.fromiter(map(len, before), np.int64, len(before))
        # A member's own key is none of those before it, so it can fill the rest.
        keys = np.full((size, max(1, int(met.max()))), key[0])
        keys[np.arange(keys.shape[1]) < met[:, None]] = np.concatenate([np.zeros(0, np.int64), *before])
        bits, across = np.stack(parities).view(np.uint64), i[0] != j[0]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
        step = max(1, PAIRS // size)
        for at in range(0, size, step):
            part = slice(at, at + step)
            need = -(-percent * (n[part, None] + n) // (100 + percent))
            fit = (label[part, None] != label) & (100 * np.minimum(n[part, None], n) >= percent * np.maximum(n[part, None], n)) & (np.minimum((n - place)[part, None], n - place) >= need)
            if across:
                fit &= own[part, None] != own
            a, b = np.nonzero(fit)
            need, a = need[a, b], a + at
            apart = np.zeros(len(a), np.int64)
            for w in range(bits.shape[1]):
                apart += np.bitwise_count(bits[a, w] ^ bits[b, w])
            near = apart <= n[a] + n[b] - 2 * need
            a, b, apart = a[near], b[near], apart[near]
            again = np.zeros(len(a), bool)
            for w in range(keys.shape[1]):
                again |= (w < met[a]) & (keys[b] == keys[a, w][:, None]).any(axis=1)
            a, b, apart = a[~again], b[~again], apart[~again]
            if len(a):
                order = np.lexsort((b, apart, a))
                a, b = a[order], b[order]
                first = np.searchsorted(a, a)
                more = np.searchsorted(a, a, "right") - first > most
                kept = np.arange(len(a)) - first < most
                found.append((a[kept], b[kept], more[kept]))
        a, b, more = (np.concatenate(v) for v in zip(*found, strict=True))
        return np.minimum(a, b), np.maximum(a, b), more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last group, of which more may come

        def picked(x: list[np.ndarray], edges: np.ndarray) -> pa.RecordBatch:
            parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))]
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                one = [v[lo:hi] for v in x]
                a, b, more = pick(one)
                parts.append((one[4][a], one[4][b], more, np.full(len(a), one[0][0])))
            a, b, more, key = (np.concatenate(v) for v in zip(*parts, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(key, mask=~more)], names=["a", "b", "more"])

        for batch in batches:
            if batch.num_rows:
                x = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(batch.num_columns)]
                x = x if held is None else [np.concatenate([h, v]) for h, v in zip(held, x, strict=True)]
                new = np.flatnonzero(np.any([v[1:] != v[:-1] for v in x[:3]], axis=0)) + 1
                edges = np.concatenate([[0], new])
                yield picked(x, edges)
                held = [v[edges[-1] :] for v in x]
        if held is not None:
            yield picked(held, np.array([0, len(held[0])]))

    return arrow_map(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "class"), run, "a long, b long, more long")


def _light(rows: DataFrame, percent: int, boundary: int) -> DataFrame:
    """Links of classes that share a subset of at least o(a, b) elements.

    For each subset and pair of sizes that it can link, every class of the one size is
    linked with the first class of the other; for equal sizes with the first of the same.
    Sharing the subset is the whole condition, so these links connect all that the subset links.
    """
    first = rows.groupBy("key", "second", "n", "place").agg(F.min("class").alias("other")).withColumnRenamed("n", "m")
    pairs = rows.join(first, ["key", "second", "place"]).where((F.col("class") != F.col("other")) & (F.least("n", "m") <= boundary) & (F.col("place") >= at_least("n", "m", percent)))
    return cut(pairs.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct())


def parity(s: np.ndarray) -> list[int]:
    """For each of PARITY slots whether the set has an odd number of elements there, as longs."""
    slots = np.bincount((mix(s) >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(slots.astype(np.uint8)).view(np.int64).tolist()


def _sets(docs: DataFrame, k: int, same: frozenset[int]) -> DataFrame:
    """(class, elements, parity) of the documents that stand for their classes; rows that share an id may repeat one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in chunks(batches, k):
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s, same) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([parity(s) for s in sets], pa.list_(pa.int64()))], names=["class", "elements", "parity"])

    return arrow_map(docs, run, "class long, elements binary, parity array<bigint>")


def _compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets link. Where they are few they go to the sets, of which only those in a pair move."""
    n = pairs.count()
    sets = sets.select("class", "elements")
    x = sets.withColumnsRenamed({"class": "a", "elements": "x"}).join(few(pairs, n), "a")
    y = sets.withColumnsRenamed({"class": "b", "elements": "y"}).join(few(pairs.select("b").distinct(), n), "b", "left_semi")
    both = x.join(y, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return arrow_map(both.select("a", "b", "x", "y"), run, "a long, b long")


def join(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (the smallest id reachable by links)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    same: frozenset[int] = frozenset()
    while True:
        rows = cut(classes(docs, k, same))
        # Equal sets are one class; rows that share an id tie their classes together.
        real = rows.where(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
        sized = cut(real.groupBy("class").agg(F.max("n_shingles").alias("n"), F.min("doc_id").alias("rep"), F.min("check").alias("lo"), F.max("check").alias("hi")))
        # Keys of different sets: none in any corpus of less than some 10^9 sets, a few in larger ones.
        more = {r["class"] for r in sized.where("lo <> hi").select("class").collect()}
        if not more:
            break
        same |= more
    sized = sized.drop("lo", "hi")
    found = links(docs.where(F.col("doc_id").isNotNull()), k, percent, sized, same)
    same = real.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b")
    tied = real.join(same.select("doc_id", "a"), "doc_id").where("a < class").select("a", F.col("class").alias("b"))
    label = components(found.unionByName(tied)).withColumnsRenamed({"id": "class"})
    named = sized.join(label, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = named.join(least, "component").select("class", "component_id")
    # A large class's rows are many but hold one key: only this small side is looked up.
    out = rows.join(of_class, "class", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
