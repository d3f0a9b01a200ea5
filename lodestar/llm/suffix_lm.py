"""Language-model scores from a probabilistic suffix tree over bytes.

A text is lower-cased (A-Z), cut at white space, and read as the bytes of its words,
each followed by a space, and one closing line break. The tree's contexts are up to
``depth`` preceding bytes. Every context seen at least ``least`` times is a candidate (and
with a share of all training positions of at least ``p_min``, 0 unless given), so the tree
grows with the corpus. A candidate is retained when
n(context) * KL(next | context || next | shorter context) exceeds ``divergence`` nats
(and so are its suffixes). Next-symbol distributions are smoothed towards the shorter
context's in the manner of Witten and Bell; the root's is additive over all 256 bytes.
Scoring walks an automaton whose states are the longest retained suffixes (with the
prefixes that reaching them needs), many text segments at a time, while at most ``dense``
contexts of more than two bytes are retained. A larger tree stays a table, and is sent in
blocks of about ``block_rows`` rows, of which a task holds one at a time.

Beside it stands a unigram baseline over word tokens, exact for a vocabulary of any size:
the ``frequent`` most frequent words are broadcast, all others are joined. The score mixes the
two word by word: a word's probability is ``share`` of what the tree gives to its bytes in their
contexts, and 1 - ``share`` of its smoothed share of all tokens, so that a word seen often costs
little though its letters are unusual, and an unseen one is spelled.

Defined cases: an empty table gives no rows; columns beside the id and the text are ignored;
very long texts are scored in one piece, whole; words of equal counts are broadcast together or
not at all, and a context that diverges by just ``divergence`` isn't retained; ``depth`` is from 1 to 6, as a context and its next byte must fit a long;
null and blank texts are one closing token; with nothing to learn from,
counts are 0, every byte is equally likely, and base_score is 0 tokens' worth of log10 of
0.1 / 0.1; repeated rows are learned from and scored each; null ids are not held out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.checkpoints import cut
from lodestar.llm.common import arrow_map, texts_of

END = 10
SEGMENT = 512
#: Bytes of text handled at once.
CHUNK = 4 << 20


def word_bytes(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def laid_out(texts: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end, each after ``depth`` line breaks; where each one's own bytes begin, and stop."""
    pad = bytes([END]) * depth
    parts = [pad + b"".join([w + b" " for w in words]) + b"\n" for words in texts]
    stops = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    starts = np.concatenate([[0], stops[:-1]]) + depth
    return np.frombuffer(b"".join(parts), np.uint8), starts.astype(np.int64), stops


def grams_of(x: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """For each byte of the texts' own, the code of it and the ``depth`` bytes before."""
    code = np.zeros(len(x) - depth, np.uint64)
    for k in range(depth + 1):
        code = (code << np.uint64(8)) | x[k : len(x) - depth + k]
    own = np.ones(len(x) - depth, bool)
    for k in range(1, depth + 1):
        at = starts[1:] - depth - k
        own[at[at >= 0]] = False
    return code[own]


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def count_grams(docs: DataFrame, text_col: str, depth: int, most: int = 6_000_000) -> DataFrame:
    """(code long, c long): how often each byte follows each ``depth`` bytes, over all texts; a task holds about ``most`` codes at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held: list[list[bytes]] = []
        size = 0

        def take() -> None:
            x, starts, _ = laid_out(held, depth)
            parts.append(np.unique(grams_of(x, starts, depth), return_counts=True))
            held.clear()

        def rows() -> Iterator[pa.RecordBatch]:
            codes, counts = merge(parts)
            parts.clear()
            for i in range(0, len(codes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(codes[i : i + 100_000].astype(np.int64)), pa.array(counts[i : i + 100_000].astype(np.int64))], names=["code", "c"])

        for b in batches:
            for t in texts_of(b, "text"):
                held.append(word_bytes(t))
                size += len(t)
                if size >= CHUNK:
                    take()
                    size = 0
                    if sum(len(p[0]) for p in parts) > most:
                        parts[:] = [merge(parts)]
                        # Mostly different ones: they are added up after the shuffle.
                        if len(parts[0][0]) > most // 2:
                            yield from rows()
        if held:
            take()
        if parts:
            yield from rows()

    return arrow_map(docs.select(F.col(text_col).alias("text")), run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))


@dataclass
class Tree:
    """Retained contexts: (length, code of the context's bytes), and next-symbol counts as rows."""

    depth: int
    context: np.ndarray  # of each count row: code, the last byte lowest
    length: np.ndarray
    symbol: np.ndarray
    count: np.ndarray


#: Bytes of a context by which counts are dealt, and blocks of a large tree made.
NEAR = 2


def diverging(rows: tuple[np.ndarray, np.ndarray, np.ndarray], up: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, divergence: float) -> np.ndarray:
    """Contexts of k bytes that diverge from the one a byte shorter; rows, up: (context, symbol, count), up with all symbols of rows."""
    s, a, n = rows
    context, inverse = np.unique(s, return_inverse=True)
    sizes = np.bincount(inverse, n, len(context))
    key = up[0] << 8 | up[1]
    order = np.argsort(key)
    shorter, back = np.unique(up[0], return_inverse=True)
    share = (up[2] / np.bincount(back, up[2], len(shorter))[back])[order]
    q = share[np.searchsorted(key[order], (s & ((1 << 8 * (k - 1)) - 1)) << 8 | a)]
    kl = np.bincount(inverse, n * np.log(n / sizes[inverse] / q), len(context))
    return context[kl > divergence]


def retained(docs: DataFrame, text_col: str = "text", *, depth: int = 5, p_min: float = 0.0, least: int = 16, divergence: float = 12.0) -> tuple[Tree, DataFrame]:
    """Train on all rows: the tree's contexts up to NEAR bytes, and a table (d, s, a, n) of all longer ones.

    ``least`` occurrences make a context a candidate, ``divergence`` nats retain it (both fixed, at any size).

    The first has 256 ** NEAR contexts at most; the table grows with the corpus and stays with the executors.
    """
    grams = cut(count_grams(docs, text_col, depth))
    total = grams.agg(F.sum("c")).first()[0] or 0
    floor, near = max(least, p_min * total), min(NEAR, depth)
    levels = None
    for d in range(near + 1):
        code = F.col("code").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1))
        rows = grams.groupBy(F.shiftright(code, 8).alias("s"), code.bitwiseAND(F.lit(255)).alias("a")).agg(F.sum("c").alias("n"))
        rows = rows.groupBy("s").agg(F.sum("n").alias("total"), F.collect_list(F.struct("a", "n")).alias("next"))  # 256 at most
        rows = rows.where(F.col("total") >= (floor if d else 0)).select(F.lit(d).alias("d"), "s", F.explode("next").alias("x")).select("d", "s", "x.a", "x.n")
        levels = rows if levels is None else levels.unionByName(rows)
    got = levels.toArrow()
    d, s, a, n = (got.column(c).to_numpy() for c in ("d", "s", "a", "n"))

    def longer(t: pa.Table) -> pa.Table:
        """Retained contexts of more than NEAR bytes among all that end alike."""
        codes, counts = t.column("code").to_numpy(), t.column("c").to_numpy()
        level, kept = {}, {}
        for k in range(near, depth + 1):
            key, inverse = np.unique(codes & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            sums = np.bincount(inverse, counts).astype(np.int64)
            _, of, back = np.unique(key >> 8, return_index=True, return_inverse=True)
            often = (np.bincount(back, sums, len(of)) >= floor)[back]
            level[k] = key[often] >> 8, key[often] & 255, sums[often]
            if k > near:
                kept[k] = diverging(level[k], level[k - 1], k, divergence)
        for k in range(depth, near + 1, -1):
            kept[k - 1] = np.union1d(kept[k - 1], kept[k] & ((1 << 8 * (k - 1)) - 1))
        out = [(np.full(on.sum(), k, np.int32), s[on], a[on], n[on]) for k in kept for s, a, n in [level[k]] for on in [np.isin(s, kept[k])]]
        return pa.table(dict(zip("dsan", (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    if depth > near:
        ends = F.shiftright("code", 8).bitwiseAND(F.lit((1 << 8 * near) - 1))
        far = cut(grams.groupBy(ends.alias("ends")).applyInArrow(longer, "d int, s long, a long, n long"))
    else:
        far = docs.sparkSession.createDataFrame([], "d int, s long, a long, n long")
    kept: list[set[int]] = [set() for _ in range(near + 1)]
    for k in range(1, near + 1):
        # Each context's divergence from the one a byte shorter, whose counts hold all of its symbols.
        on, up = d == k, d == k - 1
        kept[k] = set(diverging((s[on], a[on], n[on]), (s[up], a[up], n[up]), k, divergence).tolist())
    # A retained context keeps its suffixes.
    kept[near] |= {r[0] for r in far.select(F.col("s").bitwiseAND(F.lit((1 << 8 * near) - 1))).distinct().collect()} if near else set()
    for k in range(near, 1, -1):
        kept[k - 1] |= {c & ((1 << 8 * (k - 1)) - 1) for c in kept[k]}
    keep = [d == 0] + [(d == k) & np.isin(s, np.fromiter(kept[k], np.int64, len(kept[k]))) for k in range(1, near + 1)]
    rows = np.flatnonzero(np.any(keep, axis=0))
    return Tree(depth, s[rows].astype(np.uint64), d[rows].astype(np.int64), a[rows].astype(np.int64), n[rows].astype(np.float64)), far


def whole(tree: Tree, far: DataFrame) -> Tree:
    """The tree with these longer contexts."""
    got = far.toArrow()
    parts = zip((tree.context, tree.length, tree.symbol, tree.count), "sdan", (np.uint64, np.int64, np.int64, np.float64), strict=True)
    return Tree(tree.depth, *(np.concatenate([own, got.column(c).to_numpy().astype(kind)]) for own, c, kind in parts))


def grow(docs: DataFrame, text_col: str = "text", **how) -> Tree:
    """The tree of all rows in one piece."""
    return whole(*retained(docs, text_col, **how))


class Block:
    """Sorted tables of contexts: log10 probabilities of (context, symbol), and what a symbol not seen there costs."""

    def __init__(self, tree: Tree):
        at = tree.length == 0
        p = np.full(256, 0.5)
        p[tree.symbol[at]] += tree.count[at]
        p /= p.sum()
        self.depth, self.base, self.levels = tree.depth, np.log10(p), []
        known, of = np.arange(256, dtype=np.uint64), p
        for k in range(1, tree.depth + 1):
            at = tree.length == k
            key = tree.context[at] << np.uint64(8) | tree.symbol[at].astype(np.uint64)
            order = np.argsort(key)
            key, count = key[order], tree.count[at][order]
            context, back, kinds = np.unique(key >> np.uint64(8), return_inverse=True, return_counts=True)
            both = np.bincount(back, count, len(context)) + kinds
            shorter = np.searchsorted(known, key & np.uint64((1 << 8 * k) - 1))
            p = (count + kinds[back] * of[shorter]) / both[back] if len(key) else np.zeros(0)
            self.levels.append((key, np.log10(p).astype(np.float32), context, np.log10(kinds / both).astype(np.float32)))
            known, of = key, p

    def logs(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each code after the others."""
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        for k in range(self.depth, 0, -1):
            key, log, context, back = self.levels[k - 1]
            if not len(key) or not len(left):
                continue
            x = codes[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(key, x), len(key) - 1)
            hit = key[at] == x
            out[left[hit]] += log[at[hit]]
            left, x = left[~hit], x[~hit] >> np.uint64(8)
            at = np.minimum(np.searchsorted(context, x), len(context) - 1)
            out[left] += np.where(context[at] == x, back[at], 0)
        out[left] += self.base[codes[left] & np.uint64(255)]
        return out


def blocks_of(tree: Tree, far: DataFrame, block_rows: int) -> Iterator[tuple[np.ndarray, Block]]:
    """The tree in blocks of about ``block_rows`` rows besides its short contexts: endings of NEAR bytes, and the block for them."""
    ends = F.col("s").bitwiseAND(F.lit((1 << 8 * NEAR) - 1))
    held = {r["e"]: r["k"] for r in far.groupBy(ends.alias("e")).agg(F.count("*").alias("k")).collect()}
    parts: list[list[int]] = [[]]
    size = 0
    for e in sorted(held):
        if size and size + held[e] > block_rows:
            parts.append([])
            size = 0
        parts[-1].append(e)
        size += held[e]
    for i, part in enumerate(parts):
        # The first block has all endings without longer contexts as well.
        mine = np.ones(256**NEAR, bool) if i == 0 else np.zeros(256**NEAR, bool)
        if i == 0:
            mine[list(held)] = False
        mine[part] = True
        yield mine, Block(whole(tree, far.where(ends.between(part[0], part[-1])) if part else far))


def block_logs(blocks: list, texts: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As Automaton.logs, from broadcast blocks; of several, only one is in memory at a time."""
    x, starts, stops = laid_out(texts, depth)
    code = np.zeros(len(x) - depth, np.uint64)
    for k in range(depth + 1):
        code = (code << np.uint64(8)) | x[k : len(x) - depth + k]
    # Told apart by hashing, as only the different ones, which are few, are worth sorting.
    of, codes = pd.factorize(code)
    order = np.argsort(codes)
    codes, logs = codes[order], np.zeros(len(codes))
    for b in blocks:
        mine, block = b.value if len(blocks) == 1 else b.load_from_path(b._path)
        at = np.flatnonzero(mine[(codes >> np.uint64(8)) & np.uint64(256**NEAR - 1)])
        logs[at] = block.logs(codes[at])
    every = np.empty(len(codes))
    every[order] = logs
    return np.concatenate([np.zeros(depth), every[of]]), starts, stops


def of_words(logs: np.ndarray, starts: np.ndarray, stops: np.ndarray, texts: list[list[bytes]]) -> list[np.ndarray]:
    """For each text the sums of its words' bytes, each with its space, and of the closing line break."""
    sums, out = np.concatenate([[0.0], np.cumsum(logs)]), []
    for words, start, stop in zip(texts, starts.tolist(), stops.tolist(), strict=True):
        ends = np.empty(len(words) + 2, np.int64)
        ends[0], ends[-1] = start, stop
        ends[1:-1] = start + np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        out.append(np.diff(sums[ends]))
    return out


class Shares(dict):
    """log10 of words' shares, NaN for others."""

    def __missing__(self, word):
        return math.nan


class Automaton:
    """Dense tables over states and symbols: next state, and log10 probability of the symbol."""

    def __init__(self, tree: Tree):
        seen = np.zeros(256, bool)
        seen[tree.symbol] = True
        seen[[10, 32]] = True
        self.symbol = np.full(256, seen.sum(), np.int64)  # bytes never seen share the last symbol
        self.symbol[seen] = np.arange(seen.sum())
        a, unseen = int(seen.sum()) + 1, 256 - int(seen.sum())
        contexts = {(int(n), int(c)) for n, c in set(zip(tree.length.tolist(), tree.context.tolist(), strict=True))} | {(0, 0)}
        states = set(contexts)
        for n, c in contexts:  # prefixes, and their suffixes
            for k in range(1, n):
                p = c >> 8 * k
                states.update((m, p & ((1 << 8 * m) - 1)) for m in range(1, n - k + 1))
        order = sorted(states)
        number = {s: i for i, s in enumerate(order)}
        n = len(order)
        depth = np.array([s[0] for s in order])
        up = np.array([number[(m - 1, c & ((1 << 8 * (m - 1)) - 1))] if m else 0 for m, c in order])
        own = np.array([number[(m, c)] for m, c in zip(tree.length.tolist(), tree.context.tolist(), strict=True)], np.int64)
        total, kinds = np.bincount(own, tree.count, n), np.bincount(own, minlength=n)
        p = np.zeros((n, a))
        symbols = self.symbol[tree.symbol] if len(tree.symbol) else np.zeros(0, np.int64)
        for d in range(int(depth.max()) + 1):
            at = np.flatnonzero(depth == d)
            rows = np.flatnonzero(depth[own] == d)
            if d == 0:
                p[0] = 0.5
                p[0, -1] = 0.5 * unseen
                p[0, symbols[rows]] += tree.count[rows]
                p[0] /= p[0].sum()
            else:
                weight = np.where(total[at] > 0, kinds[at] / np.maximum(total[at] + kinds[at], 1), 1.0)
                p[at] = p[up[at]] * weight[:, None]
                p[own[rows], symbols[rows]] += tree.count[rows] / (total[own[rows]] + kinds[own[rows]])
        with np.errstate(divide="ignore"):
            p = np.log10(p)
        p[:, -1] -= math.log10(max(1, unseen))
        go = np.zeros((n, a), np.int32)
        child = [(number[(m - 1, c >> 8)], int(self.symbol[c & 255]), i) for i, (m, c) in enumerate(order) if m]
        child_of = np.array(child, np.int64).reshape(-1, 3)
        level = depth[child_of[:, 2]] if len(child) else np.zeros(0, np.int64)
        for d in range(int(depth.max()) + 1):
            at = np.flatnonzero(depth == d)
            if d:
                go[at] = go[up[at]]
            here = child_of[level == d + 1]
            go[here[:, 0], here[:, 1]] = here[:, 2]
        self.depth, self.a, self.go, self.p = tree.depth, a, go.ravel(), p.astype(np.float32).ravel()

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        """log10 probability of each text."""
        logs, starts, stops = self.logs(texts)
        sums = np.concatenate([[0.0], np.cumsum(logs)])
        return sums[stops] - sums[starts]

    def logs(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each byte of the texts laid out, and where each text begins and stops."""
        x, starts, stops = laid_out(texts, self.depth)
        segments = -(-len(x) // SEGMENT)
        padded = np.full(segments * SEGMENT + self.depth, END, np.uint8)
        padded[self.depth : self.depth + len(x)] = x
        rows = self.symbol[np.lib.stride_tricks.sliding_window_view(padded, SEGMENT + self.depth)[::SEGMENT]].T.astype(np.int32)
        state, out = np.zeros(segments, np.int32), np.empty((SEGMENT, segments), np.float32)
        for k, symbols in enumerate(rows):
            at = state * np.int32(self.a) + symbols
            if k >= self.depth:
                np.take(self.p, at, out=out[k - self.depth])
            state = self.go[at]
        return out.T.ravel()[: len(x)].astype(np.float64), starts, stops


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, c long) over all texts, the closing token being the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[bytes, int] = {}

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "c"])
            n.clear()
            return out

        for b in batches:
            for t in texts_of(b, "text"):
                for w in word_bytes(t):
                    n[w] = n.get(w, 0) + 1
                n[b""] = n.get(b"", 0) + 1
                if len(n) > 800_000:
                    yield rows()
        yield rows()

    return arrow_map(docs.select(F.col(text_col).alias("text")), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def score(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", frequent: int = 250_000, dense: int = 20_000, block_rows: int = 4_000_000, share: float = 0.5, **how) -> DataFrame:
    """One row for each document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` says which rows are learned from.
    """
    if not 1 <= how.get("depth", 5) <= 6:
        raise ValueError("depth is from 1 to 6")
    learned = docs.where(train).select(F.col(text_col).alias("text"))
    counts = cut(count_words(learned, "text"))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # The most frequent words by a threshold on their count, found without sorting all of them.
    floor, held = 1, 0
    by_count = counts.groupBy(F.least("c", F.lit(100_000)).alias("c")).agg(F.count("*").alias("k")).collect()
    for r in sorted(by_count, key=lambda r: -r["c"]):
        floor, held = r["c"], held + r["k"]
        if held > frequent:
            floor += 1
            break
    top = counts.where(F.col("c") >= floor).toArrow()
    known = dict(zip(top.column("word").to_pylist(), top.column("c").to_pylist(), strict=True))
    tree, far = retained(learned, "text", **how)
    send, depth = docs.sparkSession.sparkContext.broadcast, tree.depth
    small = far.select("d", "s").distinct().count() <= dense
    shared = send((known, whole(tree, far) if small else None))
    blocks = [] if small else [send(x) for x in blocks_of(tree, far, block_rows)]
    norm = n + 0.1 * (v + 1)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sparse = shared.value
        automaton = Automaton(sparse) if sparse else None
        shares = Shares((w, math.log10((c + 0.1) / norm)) for w, c in words.items())
        for b in batches:
            texts, size = [], 0
            ids, at = b.column(0), 0
            for i, t in enumerate(texts_of(b, "text")):
                texts.append(word_bytes(t))
                size += len(t)
                if size < CHUNK and i + 1 < b.num_rows:
                    continue
                logs = automaton.logs(texts) if automaton else block_logs(blocks, texts, depth)
                found, sums, scores, rare = [], [], [], []
                for ws, tree in zip(texts, of_words(*logs, texts), strict=True):
                    base = np.fromiter(map(shares.__getitem__, [*ws, b""]), np.float64, len(ws) + 1)
                    new = np.isnan(base)
                    found.append(int(len(base) - new.sum()))
                    sums.append(float(base[~new].sum()))
                    scores.append(float(np.log10(share * 10 ** tree[~new] + (1 - share) * 10 ** base[~new]).sum()))
                    few: dict[bytes, list[float]] = {}
                    for k in np.flatnonzero(new).tolist():
                        few.setdefault(ws[k] if k < len(ws) else b"", []).append(float(tree[k]))
                    rare.append([{"word": w, "tree": x} for w, x in few.items()])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(texts)), pa.array([len(ws) + 1 for ws in texts], pa.int64()), pa.array(found, pa.int64()), pa.array(sums, pa.float64()), pa.array(scores, pa.float64()), pa.array(rare, pa.list_(pa.struct([("word", pa.binary()), ("tree", pa.list_(pa.float64()))])))],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score", "rare"],
                )
                at, texts, size = i + 1, [], 0

    rows = arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, rare array<struct<word:binary,tree:array<double>>>")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.tree")
    c, times = F.coalesce("c", F.lit(0)), F.size("tree")
    own = (c + 0.1) / norm
    mixed = F.aggregate("tree", F.lit(0.0), lambda s, x: s + F.log10(share * F.pow(F.lit(10.0), x) + (1 - share) * own))
    rest = rare.join(counts.where(F.col("c") < floor), "word", "left").groupBy("row").agg(F.sum(F.when(c > 0, times).otherwise(0)).alias("more"), F.sum(times * F.log10(own)).alias("rest"), F.sum(mixed).alias("mixed"))
    out = rows.drop("rare").join(rest, "row", "left")

    def both(a: str, b: str) -> Column:
        return (F.col(a) + F.coalesce(b, F.lit(0.0))).alias(a)

    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), both("base_score", "rest"), both("score", "mixed"))
