"""Benchmark decontamination by pigeonhole edit matching.

A test item of m bytes may occur in a document with up to k = floor(m * rate) edits.
It is split into k + 1 pieces, of which at least one then occurs unchanged; an
Aho-Corasick automaton finds every piece in every whole document. A hit is verified from the
piece upwards, with Myers' bit-parallel edit distance: of any two neighbouring groups of a and
b pieces with at most a + b - 1 edits, one has at most as many edits as it has pieces less one.
So some unchanged piece has a pair around it with one edit at most, that pair a group of three
or four with as few, and so on to the whole item; a hit whose next larger group has more is
dropped at little cost. Both sides are normalised alike: lower case, ASCII punctuation deleted, white space runs to one
space, as UTF-8 bytes (in which lengths, edits and offsets are counted).

Items are the stated query set: they are collected in blocks of at most
``block_bytes``, each block broadcast and matched against all documents.

Defined cases: null or blank texts and items match nothing; repeated items each give
their rows; repeated documents too; an item shorter than 1 / rate bytes must occur
exactly; very long documents are matched whole. Ids may be null; they are carried on. Of
places that match equally well the one that ends first is given; empty tables of either kind
give no rows; columns beside the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestar.checkpoints import cut
from lodestar.llm.common import arrow_map

BLANK = bytes(32 if i in b"\t\n\v\f\r" else i for i in range(256))
PUNCTUATION = string.punctuation.encode()


def normalise(text: str | None) -> str:
    """Normalised bytes, each as one character."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(BLANK, PUNCTUATION).split()).decode("latin-1")


def pieces(item: str, rate: float) -> list[tuple[int, str]]:
    """The item's k + 1 pieces of nearly equal length with their offsets."""
    k = int(len(item) * rate)
    at = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:], strict=False)]


class Myers:
    """Edit distance of one pattern to substrings of texts."""

    def __init__(self, pattern: str):
        self.m, self.masks = len(pattern), {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """The least distance of the pattern to any substring of text, and where the first such substring ends."""
        full, top = (1 << self.m) - 1, 1 << (self.m - 1)
        pv, mv, score, low, end, masks = full, 0, self.m, self.m, 0, self.masks
        for j, c in enumerate(text, 1):
            eq = masks.get(c, 0)
            xh = (((eq & pv) + pv) ^ pv) | eq | mv
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            xv = eq | mv
            ph, mh = ph << 1 & full, mh << 1 & full
            pv, mv = mh | (full & ~(xv | ph)), ph & xv
            if score < low:
                low, end = score, j
        return low, end


def groups(pieces: int) -> list[list[tuple[int, int]]]:
    """For each piece the groups (first, end) that hold it, from pairs up to all, of a tree of halves."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(pieces)]

    def split(a: int, b: int) -> None:
        if b - a > 1:
            split(a, (a + b) // 2)
            split((a + b) // 2, b)
            for i in range(a, b):
                out[i].append((a, b))

    split(0, pieces)
    return out


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, int(len(t) * rate)) for i, t in items if t]
        self.myers: dict[tuple[int, int, int], Myers] = {}
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple]] = {}
        for n, (_, t, _) in enumerate(self.items):
            parts = pieces(t, rate)
            starts = [at for at, _ in parts] + [len(t)]
            for i, (above, (at, piece)) in enumerate(zip(groups(len(parts)), parts, strict=True)):
                ladder = [(starts[a], starts[b], b - a - 1) for a, b in above]
                # The piece's neighbour in a pair: one of its halves is unchanged there, moved by one place at most.
                beside = None
                if above and above[0][1] - above[0][0] == 2:
                    other = above[0][0] if above[0][0] != i else i + 1
                    a, b = starts[other], starts[other + 1]
                    mid = (a + b) // 2
                    beside = [(x - at, y - at, t[x:y]) for x, y in ((a, mid), (mid, b)) if y > x]
                found.setdefault(piece, []).append((n, at, beside, ladder))
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def match(self, text: str) -> list[tuple[int, int, int]]:
        """(number of the item, least distance, where in the normalised text it ends), for each item that occurs."""
        best: dict[int, tuple[int, int]] = {}
        tried = set()
        if not self.items:
            return []
        for end, (size, where) in self.automaton.iter(text):
            place = end + 1 - size
            for n, at, beside, ladder in where:
                if beside and not any(text.find(half, max(0, place + x - 1), place + y + 1) >= 0 for x, y, half in beside):
                    continue
                first = place - at
                if best.get(n, (1,))[0] == 0 or (n, first) in tried:
                    continue
                item = self.items[n][1]
                if first >= 0 and text.startswith(item, first):
                    best[n] = (0, first + len(item))
                    continue
                for a, b, k in ladder:
                    key = (n, a, b)
                    if key not in self.myers:
                        self.myers[key] = Myers(item[a:b])
                    low = max(0, first + a - k)
                    distance, stop = self.myers[key].best(text[low : first + b + k])
                    if distance > k:
                        break
                    if (a, b) == (0, len(item)):
                        tried.add((n, first))
                        if distance < best.get(n, (k + 1,))[0]:
                            best[n] = (distance, low + stop)
        return [(n, *x) for n, x in sorted(best.items())]


def matches(docs: DataFrame, items: DataFrame, *, rate: float = 0.1, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """One row for each document and item that occurs in it: doc_id, item_id, distance, edits_allowed, end."""
    items = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // block_bytes
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema["item_id"].dataType
    item_arrow = to_arrow_type(item_type)
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        listed = sorted(((r["item_id"], normalise(r["text"])) for r in mine.collect()), key=repr)
        shared = docs.sparkSession.sparkContext.broadcast(listed)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for b in batches:
                at, rows = [], []
                for i, text in enumerate(b.column(1)):
                    for n, distance, end in matcher.match(normalise(text.as_py())):
                        at.append(i)
                        rows.append((matcher.items[n][0], distance, matcher.items[n][2], end))
                ids = b.column(0).take(pa.array(at, pa.int64()))
                kinds = (item_arrow, pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["doc_id", "item_id", "distance", "edits_allowed", "end"])

        got = arrow_map(read, run, f"doc_id {id_type}, item_id {item_type.simpleString()}, distance int, edits_allowed int, end long")
        out = got if out is None else out.unionByName(got)
    return out


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The documents in which no item occurs, with all their columns and repeated rows."""
    id_col = how.get("id_col", "doc_id")
    hit = cut(matches(docs, items, **how).select(F.col("doc_id").alias("_hit")).distinct())
    if hit.count() <= 1_000_000:
        hit = F.broadcast(hit)
    return docs.join(hit, docs[id_col].eqNullSafe(hit["_hit"]), "left_anti")
