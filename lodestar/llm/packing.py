"""Order-preserving packing of tokenised documents by dynamic programming.

Documents are laid end to end, in the order in which they are read. Windows of at most
``size`` tokens are cut at document ends, sentence ends (after a full stop, exclamation
or question mark before a space, or a line break) or, inside longer runs without
either, every ``step`` tokens. The cuts minimise padding (none where a window's length is a power of two) plus penalties for cutting
documents; a monotone queue of the reachable cuts gives each transition in constant
amortised time. Each partition packs its own rows as a stream, in stretches of about
``stretch`` tokens whose last window is left open for the next stretch, so memory is
bounded by the stretch and the longest document. Nothing is shuffled.

Words are tokenised once for each worker's bounded memo: the vocabulary's pre-tokeniser
never joins text across a space.

Defined cases: a null or empty text has only the closing id; empty tables give no rows;
repeated rows are packed once each, and so are rows that share an id; null ids are carried on; very long texts are cut like others, their
windows chosen together; of cuts that cost the same the first found is taken; columns beside
the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import KEPT, Memo, arrow_map, texts_of

END = np.array([2], "<u4").tobytes()

#: A run of Latin letters, and then marks other than the apostrophe: what the pre-tokeniser cuts in just these two.
PLAIN = re.compile(r"""([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\[-`{-~]*)""")


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: itself if it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


def words(vocabulary: str) -> Memo:
    """Text without spaces to its ids as little-endian bytes; kept between a worker's tasks of this operator.

    For the plain words of PLAIN the normaliser lowers letters and the pre-tokeniser cuts off
    the marks; doing these two here leaves the vocabulary's own model to give the ids. All
    else goes through the whole tokeniser.
    """
    held = KEPT.setdefault("packing", {})
    if vocabulary not in held:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        model, letters = tokenizer.model, byte_letters()

        def piece(p: str) -> bytes:
            written = p if p.isascii() else "".join([letters[b] for b in p.encode()])
            return array("I", [t.id for t in model.tokenize(written)]).tobytes()

        pieces = Memo(piece, most=500_000)

        def chunk(c: str) -> bytes:
            if m := PLAIN.fullmatch(c):
                word, marks = m.groups()
                return pieces[word.lower()] + pieces[marks] if marks else pieces[word.lower()]
            return array("I", tokenizer.encode(c, add_special_tokens=False).ids).tobytes()

        held[vocabulary] = Memo(chunk, most=1_000_000)
    return held[vocabulary]


def tokens(text: str, memo: Memo) -> tuple[bytes, np.ndarray]:
    """All ids of a text with its closing id, and after how many ids each sentence ends."""
    look = memo.__getitem__
    parts = [b"".join(map(look, s.split(" "))) for s in text.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n")]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) // 4
    parts.append(END)
    return b"".join(parts), ends


def unpadded(ends: np.ndarray, size: int) -> tuple[list[int], list[int], list[int]]:
    """(later place, earlier place, tokens) of all cuts that stand a power of two below size apart, by later place."""
    places = np.concatenate([[0], ends])
    at = np.full(size + places[-1] + 1, -1)
    at[size + places] = np.arange(len(places))
    found = []
    for k in range(size.bit_length()):
        if 1 << k < size:
            i = at[size + places - (1 << k)]
            j = np.flatnonzero(i >= 0)
            found.append(np.stack([j, i[j], np.full(len(j), 1 << k)]))
    every = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    return tuple(every[:, np.argsort(every[0], kind="stable")].tolist())


def cuts(ends: np.ndarray, penalties: np.ndarray, size: int, last: bool = True, price: float = 0.0) -> list[int]:
    """Which of the cuts (increasing, the last being the stretch's end) to take; gaps must be at most size.

    A window of a power of two isn't padded, all others are up to size; with the penalties of
    the cuts taken, and ``price`` for each window, this is least. Where more is to follow (not last), the final window stays
    open and its padding isn't counted.
    """
    at, costs = [0, *ends.tolist()], [0.0, *penalties.tolist()]
    value, back, queue = [0.0] * len(at), [0] * len(at), deque([0])
    later, earlier, tokens = unpadded(ends, size)
    later.append(-1)
    spot = 0
    for j in range(1, len(at)):
        low = at[j] - size
        while at[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        back[j] = i
        # value = cost so far + position: the padding of window (i, j] is size - (at[j] - at[i]), or none
        v = value[i] + size
        while later[spot] == j:
            if value[earlier[spot]] + tokens[spot] < v:
                back[j] = earlier[spot]
                v = value[back[j]] + tokens[spot]
            spot += 1
        v = value[j] = v + costs[j] + price
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    taken, j = [], len(at) - 1
    if not last:
        j = min((k for k in range(bisect_left(at, at[-1] - size), len(at))), key=lambda k: value[k] - at[k])
    while j:
        taken.append(at[j])
        j = back[j]
    return taken[::-1]


class Packer:
    """A stream of documents to pieces of windows."""

    def __init__(self, size: int, sentence: float, forced: float, price: float, step: int, first: int):
        self.size, self.sentence, self.forced, self.price, self.step, self.next = size, sentence, forced, price, step, first
        self.ids, self.docs, self.ends, self.costs, self.n = [], [], [], [], 0

    def add(self, doc: int, ids: bytes, ends: np.ndarray) -> None:
        n = len(ids) // 4
        ends = ends[(ends > 0) & (ends < n - 1)]
        ends = np.append(ends[np.diff(ends, prepend=0) > 0], n)
        costs = np.append(np.full(len(ends) - 1, self.sentence), 0.0)
        gaps = np.diff(ends, prepend=0)
        more = (gaps - 1) // self.step  # cuts inside each gap
        if more.any():
            within = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
            ends = np.concatenate([ends, np.repeat(ends - gaps, more) + self.step * within])
            costs = np.concatenate([costs, np.full(len(within), self.forced)])
            order = np.argsort(ends, kind="stable")
            ends, costs = ends[order], costs[order]
        self.docs.append((doc, 0, n, n))
        self.ids.append(ids)
        self.ends.append(ends + self.n)
        self.costs.append(costs)
        self.n += n

    def flush(self, last: bool) -> list[tuple]:
        """Pieces of the windows so far: (doc, start, length, crc32, doc tokens, window, offset)."""
        if not self.n:
            return []
        ends, costs = np.concatenate(self.ends), np.concatenate(self.costs)
        taken = cuts(ends, costs, self.size, last, self.price)
        out, d, used, ids = [], 0, 0, b"".join(self.ids)
        begin = 0
        for stop in taken:
            at = begin
            while at < stop:
                doc, start, length, total = self.docs[d]
                k = min(length - used, stop - at)
                out.append((doc, start + used, k, zlib.crc32(ids[4 * at : 4 * (at + k)]), total, self.next, at - begin))
                at, used = at + k, used + k
                if used == length:
                    d, used = d + 1, 0
            self.next += 1
            begin = stop
        rest = self.docs[d:]
        if rest and used:
            doc, start, length, total = rest[0]
            rest[0] = (doc, start + used, length - used, total)
        keep = ends > begin
        self.docs, self.ids, self.n = rest, [ids[4 * begin :]], self.n - begin
        self.ends, self.costs = [ends[keep] - begin], [costs[keep]]
        return out


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, sentence: float = 1.0, forced: float = 4.0, price: float = 1024.0, step: int = 16, stretch: int = 400_000) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``sentence`` and ``forced`` are what a cut inside a document costs, in padded tokens, and
    ``price`` what each sequence costs, so that short ones that need no padding don't multiply.
    A sequence's number holds its partition in the high bits.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = words(vocabulary)
        packer = Packer(size, sentence, forced, price, step, TaskContext.get().partitionId() << 36)
        ids: list = []

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * 7
            given = pa.array([ids[k] for k in columns[0]], id_type)
            return pa.RecordBatch.from_arrays([given, *(pa.array(c, pa.int64()) for c in columns[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        id_type = None
        for b in batches:
            id_type = b.column(0).type
            for one, text in zip(b.column(0).to_pylist(), texts_of(b, "text"), strict=True):
                ids.append(one)
                packer.add(len(ids) - 1, *tokens(text, memo))
                if packer.n >= stretch:
                    yield rows(packer.flush(last=False))
                    first = packer.docs[0][0] if packer.docs else len(ids)
                    ids = ids[first:]
                    packer.docs = [(d - first, *x) for d, *x in packer.docs]
        if packer.n:
            yield rows(packer.flush(last=True))

    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long", keeps="packing")
