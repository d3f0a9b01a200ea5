"""Exact repeats of at least ``length`` bytes, by common-prefix interval trees of suffixes.

Any string of ``length`` bytes holds the same gram of 32 bytes at the same place wherever it
occurs: the one with the least hash, the first of equals. Only these anchors (about one in
185 bytes) and what surrounds them need be compared. Anchors that occur once are dropped
before any text is moved. For each remaining anchor, the suffixes that start there are sorted
(a suffix array, restricted to the anchor); a stack scan over their common prefixes yields
the interval tree. Within an interval, members are ordered by what stands to their left: a
run of members whose common left extension and the interval's prefix add up to ``length`` is a
repeat, and it is maximal when its members' bytes on either side differ. ``groups`` gives all
occurrences of each, not pairs of neighbours; ``removed`` takes from the same scan how far
each suffix is covered.

Equal texts form one class and are compared once. An anchor with more than ``hot`` occurrences
isn't gathered in one task: the windows around it are hashed one by one, and counted by hash
(two 64-bit hashes), which spreads over all tasks and gives the same cover.

Defined cases: an empty table gives no rows; columns beside the id and the text are ignored,
whatever their names; ties among anchors' hashes go to the first place; a null or empty text has no bytes and nothing removed; texts shorter than
``length`` are kept whole; a text that occurs twice, in two rows of any ids, is removed whole
if it has ``length`` bytes; null ids keep their row; very long and monotonous texts too are
searched whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.checkpoints import discard, written
from lodestar.llm.common import arrow_map
from lodestar.llm.shingles import BYTE, ODD, mix

GRAM = 32
KEYS = ["c1", "c2"]


def raw_of(batch: pa.RecordBatch, k: int) -> list[bytes]:
    return [x or b"" for x in batch.column(k).to_pylist()]


def gram_hashes(raw: bytes) -> np.ndarray:
    """A hash of the 32 bytes from each place on."""
    b = np.frombuffer(raw, np.uint8)
    eight = np.lib.stride_tricks.as_strided(b, (len(b) - 7, 8), (1, 1)).copy().view(np.uint64).ravel()
    n = len(b) - GRAM + 1
    with np.errstate(over="ignore"):
        h = eight[:n] * ODD[30]
        for k in (1, 2, 3):
            h ^= h >> np.uint64(29)
            h += eight[8 * k : 8 * k + n]
            h *= ODD[30 + k]
    return mix(h)


def anchors(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all strings of ``length`` bytes."""
    if len(raw) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, w = gram_hashes(raw), length - GRAM + 1
    # The first least hash of each window: from its part left of a block's edge, and its part right of it.
    rows = -(-len(h) // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    block = padded.reshape(rows, w)
    forward = np.minimum.accumulate(block, axis=1).ravel()
    backward = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(h) - w + 1
    least = np.minimum(backward[:n], forward[w - 1 : w - 1 + n])
    # Each window's anchor: the first place at or after its start with that hash.
    at = np.arange(len(h))
    order = np.lexsort((at, h))
    start = np.arange(n)
    values, places = h[order], at[order]
    if n == 1:
        first = np.array([int(np.argmin(h))])
    else:
        # A new anchor begins where the least hash changes, or where the window has passed the last one.
        lo = np.searchsorted(values, least, side="left")
        changed = np.concatenate([[True], least[1:] != least[:-1]])
        first = np.empty(n, np.int64)
        group = np.cumsum(changed) - 1
        heads = np.flatnonzero(changed)
        run_lo = lo[heads]
        run_hi = np.searchsorted(values, least[heads], side="right")
        single = run_hi - run_lo == 1
        first[:] = places[run_lo][group]
        for g in np.flatnonzero(~single):
            a, b = heads[g], heads[g + 1] if g + 1 < len(heads) else n
            spots = places[run_lo[g] : run_hi[g]]
            first[a:b] = spots[np.searchsorted(spots, start[a:b], side="left")]
    found = np.unique(first)
    return found, h[found]


def thinned(raw: bytes, place: np.ndarray, h: np.ndarray, length: int, short: int) -> tuple[np.ndarray, list[tuple[int, int, bool]]]:
    """Of a text's anchors those to compare with others, and what the rest cover, by strings of ``length`` bytes and of ``short`` (True).

    Places with equal surroundings (as inside a run of one repeated line) cover these wholly,
    and are alike to any other text: the first one stands for all.
    """
    _, group, count = np.unique(h, return_inverse=True, return_counts=True)
    if not len(h) or count.max() < 2:
        return np.ones(len(h), bool), []
    keep = count[group] == 1
    seen: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(~keep):
        p = int(place[i])
        around = (int(h[i]), raw[max(0, p - short + GRAM) : p], raw[p : p + length])
        if around in seen:
            seen[around].append(p)
        else:
            seen[around] = [p]
            keep[i] = True
    cover: list[tuple[int, int, bool]] = []
    for least in {length, short}:
        runs = merged((p - len(left), p + len(right)) for (_, left, right), places in seen.items() if len(places) > 1 and len(left) + len(right) >= least for p in places)
        cover += [(a, b, least < length) for a, b in runs]
    return keep, cover


def merged(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    """The spans' union as runs, in order."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return runs


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of all intervals; lcp[i] is between suffixes i and i + 1. Inner ones come first."""
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*lcp, 0]):
        left = i
        while stack and stack[-1][0] > value:
            top, left = stack.pop()
            yield top, left, i
        if value and (not stack or stack[-1][0] < value):
            stack.append((value, left))


def common(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common prefixes of neighbouring rows of bytes, of the given lengths."""
    differ = x[1:] != x[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])
    return np.minimum(first, np.minimum(size[1:], size[:-1]))


def repeats_of(left: np.ndarray, left_size: np.ndarray, lcp: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For suffixes in order: (prefix, members, each one's common left extension with another member)."""
    width = left.shape[1]
    ranks = np.argsort(np.argsort(np.ascontiguousarray(left).view(f"V{width}").ravel(), kind="stable")) if len(left) > 2 else np.array([0, 1])
    for prefix, a, b in intervals(lcp.tolist()):
        if prefix < length - width:
            continue
        members = a + np.argsort(ranks[a : b + 1], kind="stable")
        back = common(left[members], left_size[members])
        ext = np.maximum(np.append(back, 0), np.insert(back, 0, 0))
        good = ext + prefix >= length
        if good.any():
            yield prefix, members[good], ext[good]


def matrix(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, values), np.int64, len(values))
    return np.frombuffer(b"".join([v.ljust(width, b"\0") for v in values]), np.uint8).reshape(len(values), width), size


def scan(heads: np.ndarray, left: list[bytes], right: list[bytes], length: int, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """repeats_of for every group of rows with equal heads, rows being sorted by head, then right; repeats of ``least`` bytes or more."""
    if len(heads) < 2:
        return
    r, r_size = matrix(right, length)
    f, f_size = matrix(left, max([1, *map(len, left)]))
    lcp = common(r, r_size)
    starts = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
    stops = np.append(starts[1:], len(heads))
    pairs = starts[stops - starts == 2]
    if len(pairs):
        both = np.stack([f[pairs], f[pairs + 1]], axis=1)
        differ = both[:, 0] != both[:, 1]
        back = np.where(differ.any(axis=1), differ.argmax(axis=1), f.shape[1])
        back = np.minimum(back, np.minimum(f_size[pairs], f_size[pairs + 1]))
        for p, k in zip(pairs[good := back + lcp[pairs] >= least], back[good], strict=True):
            yield int(lcp[p]), np.array([p, p + 1]), np.array([k, k])
    for a, b in zip(starts[stops - starts > 2], stops[stops - starts > 2], strict=True):
        for prefix, members, ext in repeats_of(f[a:b], f_size[a:b], lcp[a : b - 1], least):
            yield prefix, a + members, ext


def by_anchor(around: DataFrame) -> DataFrame:
    """The rows of anchors that aren't hot, as suffix arrays: those of one anchor in one partition, in order."""
    return around.where("not hot").repartition("h").sortWithinPartitions("h", "right", "c1", "c2", "place")


def once(t: pa.Table) -> pa.Table:
    """Without rows that copies of a text have repeated; these stand next to each other."""
    same = np.ones(len(t) - 1, bool)
    for c in ("h", "c1", "c2", "place"):
        x = t.column(c).to_numpy()
        same &= x[1:] == x[:-1]
    return t.filter(pa.array(np.concatenate([[True], ~same])))


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by ``h`` as tables that hold whole groups."""
    for t in _whole(batches):
        yield once(t)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not len(t):
            continue
        h = t.column("h").to_numpy()
        stop = int(np.flatnonzero(h != h[-1])[-1]) + 1 if h[0] != h[-1] else 0
        if stop:
            yield t.slice(0, stop)
        rest = t.slice(stop)
    if rest is not None and len(rest):
        yield rest


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, raw, c1, c2): the bytes with two hashes that name equal texts."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("doc_id"), raw.alias("raw")).select("doc_id", "raw", F.xxhash64("raw").alias("c1"), F.xxhash64("raw", F.lit(1)).alias("c2"))


def surroundings(rows: DataFrame, length: int, hot: int, short: int, thin: bool = True) -> tuple[DataFrame, DataFrame, bool, DataFrame]:
    """(h, hot, c1, c2, place, left, right): each shared anchor of each text with its bytes on either side.

    Left bytes are reversed; ``short`` of them less the gram are enough, as the first anchor in a
    string stands no further from its start. Copies of a text may give the same row more than once. Also
    (c1, c2, start, stop, short), what texts cover by themselves, whether any anchor is hot, and
    the written table of what texts hold, from which the first two are made.
    Anchors are those of all strings of ``short`` bytes, among which are those of longer ones.
    Without ``thin`` a text's places with equal surroundings are all given.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            out = []
            for raw, *key in zip(raw_of(b, 0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if len(raw) >= short and tuple(key) not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(tuple(key))
                    place, h = anchors(raw, short)
                    keep, cover = thinned(raw, place, h, length, short) if thin else (np.ones(len(h), bool), [])
                    start, stop, less = (np.array([c[k] for c in cover], np.int64) for k in (0, 1, 2))
                    out.append((np.concatenate([h[keep].view(np.int64), start * 31 + key[0] % 1009]), np.concatenate([place[keep], start]), np.concatenate([np.full(keep.sum(), -1), 2 * stop + less]), *key))
            n = [len(x[0]) for x in out]
            flat = [pa.array(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in out)])) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*flat, *(pa.array(np.repeat(np.array([x[k] for x in out], np.int64), n)) for k in (3, 4))], names=["h", "place", "stop", "c1", "c2"])

    # Written, as the grouping and the join with it both read it; the grouping adds up before it shuffles, and a hot anchor's rows can be split in the join.
    found = written(arrow_map(rows.select("raw", "c1", "c2"), first, "h long, place long, stop long, c1 long, c2 long"))
    one = F.struct("c1", "c2", "place")
    shared = found.groupBy("h").agg(F.min(one).alias("lo"), F.max(one).alias("hi"), F.count("*").alias("n"), F.max("stop").alias("stop")).where("lo <> hi OR stop >= 0").select("h", (F.col("n") > hot).alias("hot"))
    shared = written(shared)
    kept = found.join(shared.hint("merge"), "h").groupBy(*KEYS).agg(F.collect_set(F.struct("place", "h", "hot", "stop")).alias("found"))
    kept = written(kept)
    discard(found, shared)
    # What texts hold grows with them: it is never broadcast.
    texts_to_go = rows.select("raw", "c1", "c2").join(kept.hint("merge"), KEYS)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        names = ["h", "hot", "c1", "c2", "place", "left", "right"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for b in batches:
            rows: list[tuple] = []

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

            for c1, c2, raw, listed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw_of(b, 2), b.column(3), strict=True):
                if (c1, c2) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add((c1, c2))
                place, h, is_hot, stop = (listed.values.field(k).to_pylist() for k in range(4))
                rows += [(h[i], is_hot[i], c1, c2, p, raw[max(0, p - short + GRAM) : p][::-1], raw[p : p + length]) for i, p in enumerate(place) if stop[i] < 0]
                if len(rows) > 5000:
                    yield made()
                    rows = []
            if rows:
                yield made()

    any_hot = not kept.where(F.exists("found", lambda x: x["hot"])).isEmpty()
    own = kept.select("c1", "c2", F.explode("found").alias("f")).where("f.stop >= 0").select("c1", "c2", F.col("f.place").alias("start"), F.shiftright("f.stop", 1).alias("stop"), (F.col("f.stop") % 2 == 1).alias("short"))
    return arrow_map(texts_to_go.select("c1", "c2", "raw", "found"), around, "h long, hot boolean, c1 long, c2 long, place long, left binary, right binary"), own, any_hot, kept


def maximal(left: np.ndarray, left_size: np.ndarray, lcp: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bytes from the anchor on, bytes before it, members) of each maximal repeat among suffixes in order.

    An interval's members differ in their next byte or end there. Ordered by what stands to
    their left, they form a tree of intervals again: in each of these the members differ in
    the byte before, and it is a repeat of its own unless an inner interval of the suffixes
    has all of its members.
    """
    for prefix, a, b in intervals(lcp.tolist()):
        if prefix < length - left.shape[1]:
            continue
        members = a + np.lexsort(left[a : b + 1].T[::-1])
        back = common(left[members], left_size[members])
        # Members with nothing in common to their left are one interval too, if the prefix alone is long enough.
        tree = [*intervals(back.tolist()), *([(0, 0, b - a)] if prefix >= length and not back.all() else [])]
        for reach, i, j in tree:
            some = members[i : j + 1]
            if reach + prefix >= length and lcp[some.min() : some.max()].min() == prefix:
                yield prefix, reach, np.sort(some)


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, hot: int = 100_000) -> DataFrame:
    """Maximal repeats around each anchor with all their occurrences: (repeat, c1, c2, start, size).

    c1 and c2 name the text (see ``texts``); ``size`` is the repeat's number of bytes, as far as
    it reaches within ``length`` bytes of the anchor. A repeat's members differ in the byte
    before it and in the byte after it, unless it reaches that far or ends with its text. Around
    hot anchors, whose suffixes aren't gathered, each string of ``length`` bytes that occurs
    twice is given with all its occurrences, without being extended.
    """
    around, _, any_hot, _ = surroundings(texts(docs, id_col, text_col), length, hot, length, thin=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            h, c1, c2, place = (t.column(c).to_numpy() for c in ("h", "c1", "c2", "place"))
            r, r_size = matrix(t.column("right").to_pylist(), length)
            f, f_size = matrix(t.column("left").to_pylist(), length - GRAM)
            lcp, rows = common(r, r_size), []
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            for a, b in zip(starts, np.append(starts[1:], len(h)), strict=True):
                for prefix, reach, members in maximal(f[a:b], f_size[a:b], lcp[a : b - 1], length):
                    name = f"{int(h[a]) % (1 << 64):016x}:{prefix}:{reach}:{members[0]}"
                    rows += [(name, int(c1[m]), int(c2[m]), int(place[m]) - reach, reach + prefix) for m in a + members]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k == 0 else pa.int64()) for k in range(5)], names=["repeat", "c1", "c2", "start", "size"])

    out = arrow_map(by_anchor(around), run, "repeat string, c1 long, c2 long, start long, size long")
    if not any_hot:
        return out
    more = repeated_windows(around, length, length)
    return out.unionByName(more.select(F.concat_ws(":", F.lit("w"), "w1", "w2").alias("repeat"), "c1", "c2", "start", F.lit(length).cast("long").alias("size")).distinct())


def repeated_windows(around: DataFrame, length: int, reach: int) -> DataFrame:
    """(w1, w2, c1, c2, start): the strings of ``length`` bytes within ``reach`` bytes of hot anchors that occur at two places, with all of these."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            width = 2 * reach
            power = [np.ones(width, np.uint64), np.ones(width, np.uint64)]
            inverse = [np.ones(width, np.uint64), np.ones(width, np.uint64)]
            for k in (0, 1):
                m = int(ODD[50 + k])
                power[k][1:] = np.multiply.accumulate(np.full(width - 1, m, np.uint64))
                inverse[k][1:] = np.multiply.accumulate(np.full(width - 1, pow(m, -1, 1 << 64), np.uint64))
            for b in batches:
                for c1, c2, place, left, right in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5, 6)), strict=True):
                    x = np.frombuffer(left[::-1] + right, np.uint8)
                    n = len(x) - length + 1
                    if n < 1:
                        continue
                    h = []
                    for k in (0, 1):
                        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(BYTE[x] + ODD[52 + k]) * power[k][: len(x)], dtype=np.uint64)])
                        h.append(mix((s[length:] - s[:n]) * inverse[k][:n]).view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), pa.array(np.full(n, c1)), pa.array(np.full(n, c2)), pa.array(place - len(left) + np.arange(n))], names=["w1", "w2", "c1", "c2", "start"])

    each = arrow_map(around.where("hot"), windows, "w1 long, w2 long, c1 long, c2 long, start long")
    one = F.struct("c1", "c2", "start")
    twice = each.groupBy("w1", "w2").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).where("lo <> hi").select("w1", "w2")
    return each.join(twice, ["w1", "w2"], "left_semi")


def covers(around: DataFrame, length: int, short: int, any_hot: bool) -> DataFrame:
    """(c1, c2, start, stop, short): bytes covered by strings of ``length`` bytes that occur elsewhere too, and by those of ``short`` (True)."""

    def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            back, on = np.zeros((2, len(t)), np.int64), np.zeros((2, len(t)), np.int64)
            for prefix, members, ext in scan(t.column("h").to_numpy(), t.column("left").to_pylist(), t.column("right").to_pylist(), length, short):
                for k, least in enumerate((length, short)):
                    some = ext + prefix >= least
                    back[k, members[some]] = np.maximum(back[k, members[some]], ext[some])
                    on[k, members[some]] = np.maximum(on[k, members[some]], prefix)
            k, at = np.nonzero(on[: 1 + (short < length)])
            c1, c2, place = (t.column(c).to_numpy()[at] for c in ("c1", "c2", "place"))
            yield pa.RecordBatch.from_arrays([pa.array(c1), pa.array(c2), pa.array(place - back[k, at]), pa.array(place + on[k, at]), pa.array(k == 1)], names=["c1", "c2", "start", "stop", "short"])

    out = arrow_map(by_anchor(around), cold, "c1 long, c2 long, start long, stop long, short boolean")
    for least in {length, short} if any_hot else ():
        more = repeated_windows(around, least, length)
        out = out.unionByName(more.select("c1", "c2", "start", (F.col("start") + least).alias("stop"), F.lit(least < length).alias("short")))
    return out


def removed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, short: int | None = None, hot: int = 100_000) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, spans array<struct<start,stop>>, kept (the remaining bytes), shared.

    ``shared`` is as spans, for strings of ``short`` bytes (default: as many as ``length``), which aren't removed.
    """
    short = min(short or length, length)
    rows = texts(docs, id_col, text_col)
    around, own, any_hot, kept = surroundings(rows, length, hot, short)
    spans = covers(around, length, short, any_hot).unionByName(own).groupBy(*KEYS).agg(F.collect_set(F.struct("start", "stop", "short")).alias("spans"))
    copies = rows.groupBy(*KEYS).agg(F.count("*").alias("n")).where("n > 1").select(*KEYS, F.lit(True).alias("copied"))
    told = written(spans.join(copies, KEYS, "full"))
    discard(kept)
    every = rows.join(told.hint("merge"), KEYS, "left")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for b in batches:
            size, found, kept, shared = [], [], [], []
            for raw, listed, copied in zip(raw_of(b, 1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                all_of = [(0, len(raw))] if copied else []
                runs = all_of if copied and len(raw) >= length else merged((x["start"], x["stop"]) for x in listed or () if not x["short"])
                wide = runs if short == length else all_of if copied and len(raw) >= short else merged((x["start"], x["stop"]) for x in listed or ())
                size.append(len(raw))
                found.append([{"start": s, "stop": e} for s, e in runs])
                shared.append([{"start": s, "stop": e} for s, e in wide])
                kept.append(b"".join(raw[s:e] for s, e in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(raw)], strict=True)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(found, span), pa.array(kept, pa.binary()), pa.array(shared, span)], names=["doc_id", "n_bytes", "spans", "kept", "shared"])

    spans_type = "array<struct<start:bigint,stop:bigint>>"
    return arrow_map(every.select("doc_id", "raw", "spans", "copied"), run, f"doc_id {kind}, n_bytes long, spans {spans_type}, kept binary, shared {spans_type}")
