"""Personal data: fixed patterns, and terms that give a protected value away.

Protected values are the e-mail addresses, IP addresses, card and phone numbers that
the patterns find. A term (a word of at least ``least_letters`` letters) co-occurs with
a value when it stands within ``reach`` words of it; equal surroundings, as in copies of
a document, count once. Over the whole corpus, n(t, v) is the number of documents where t
stands near v, df(t) the number of documents that hold t, and df(v) the number that hold v,
copies counted each in all three. Then P(v | t) ~ n(t, v) / df(t), and the information that t discloses
about v is log2(P(v | t) / P(v)) bits, with P(v) = df(v) / N. A term discloses v when it occurs in at least
``least`` distinct surroundings, P(v | t) reaches ``share`` and the information ``bits``: with
one bit, the term makes the value at least twice as likely.
Such terms are marked wherever they occur: generalised to a placeholder, or removed when
P(v | t) reaches ``remove_share``.

Terms' counts are aggregated by Spark; the list of disclosing terms is broadcast only up
to ``broadcast_terms`` of them, and joined to the documents' distinct words beyond that.

Defined cases: null text is empty and has no spans; null ids keep their row; repeated rows
are handled each, and count as separate documents, but not as distinct surroundings; very long texts are searched
whole in linear time; an empty table gives no rows; a term that discloses several values is removed if any of
them asks for it; shares and bits equal to a threshold reach it; spans of one start are given in the order of their kinds; columns not kept are ignored, and kept ones may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.checkpoints import cut
from lodestar.llm.common import arrow_map, texts_of

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W_]+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """What the address pattern matches, found from each @ outwards, so that long runs cost no more than their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """All spans of the four patterns, by start and then kind."""
    out: list[Span] = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    out.sort()
    return out


def value_of(text: str, span: Span) -> str:
    """A protected value: its kind with its lower-cased text, or digits only for numbers."""
    start, kind, end = span
    raw = text[start:end]
    return f"{KINDS[kind]}:{raw.lower() if kind < 2 else re.sub('[^0-9]', '', raw)}"


def nearest(text: str, end: int, most: int, back: bool) -> list[str]:
    """The ``most`` words before a place (back), or after it, however long they are."""
    size = 16 * most
    while True:
        part = text[max(0, end - size) : end] if back else text[end : end + size]
        words = WORD.findall(part.lower())
        # A word at the far edge may be cut: it isn't among the nearest, or the text ends there.
        if len(words) > most or len(part) < size:
            return (words[-most:] if back else words[:most]) if most else []
        size *= 4


def surroundings(text: str, spans: list[Span], reach: int, least_letters: int) -> Iterator[tuple[str, str, list[str]]]:
    """For each span its value, the words around it as one string, and those that may be terms."""
    for span in spans:
        words = nearest(text, span[0], reach, True) + nearest(text, span[2], reach, False)
        yield value_of(text, span), " ".join(words), sorted({w for w in words if len(w) >= least_letters and w.isalpha()})


def disclosing(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", reach: int = 12, least_letters: int = 4, least: int = 3, share: float = 0.5, bits: float = 1.0, remove_share: float = 0.9, broadcast_terms: int = 100_000) -> DataFrame:
    """Terms that give a value away: (term, value, n, df, p, bits, removed)."""
    read = docs.select(F.col(text_col).alias("text"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each value with its surroundings; ``fresh`` are the terms that weren't near it before in the same document, ``first`` is 1 on its first place there."""
        for b in batches:
            rows = []
            for t in texts_of(b, "text"):
                held: dict[str, set[str]] = {}
                for value, around, terms in surroundings(t, base_spans(t), reach, least_letters):
                    first = int(value not in held)
                    known = held.setdefault(value, set())
                    rows.append((value, around, terms, [w for w in terms if w not in known], first))
                    known.update(terms)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["value", "around", "terms", "fresh", "first"])

    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64()]
    seen = arrow_map(read, near, "value string, around string, terms array<string>, fresh array<string>, first long")
    seen = seen.groupBy("value", F.xxhash64("around").alias("around"), "fresh").agg(F.first("terms").alias("terms"), F.count("*").alias("times"), F.sum("first").alias("first"))
    seen = cut(seen)
    each = seen.select("value", "around", "times", "fresh", F.explode("terms").alias("term")).withColumn("here", F.when(F.array_contains("fresh", F.col("term")), F.col("times")).otherwise(0))
    each = each.groupBy("term", "value", "around").agg(F.sum("here").alias("here"))
    pairs = each.groupBy("term", "value").agg(F.count("*").alias("distinct"), F.sum("here").alias("n")).where(F.col("distinct") >= least)
    pairs = cut(pairs)
    terms = pairs.select("term").distinct()
    some = terms.limit(broadcast_terms + 1).collect()
    if not some:
        return docs.sparkSession.createDataFrame([], "term string, value string, n long, df long, p double, bits double, removed boolean")
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in some) if len(some) <= broadcast_terms else None)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with each word of this partition; only the wanted words where they are few enough to be sent."""
        n: dict[str, int] = {}
        only = wanted.value
        for b in batches:
            for t in texts_of(b, "text"):
                words = set(WORD.findall(t.lower()))
                for w in words & only if only is not None else words:
                    n[w] = n.get(w, 0) + 1
            if len(n) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "df"])
                n = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "df"])

    df = arrow_map(read, count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    total = docs.count()
    p = F.col("n") / F.col("df")
    held = seen.groupBy("value").agg(F.sum("first").alias("held"))
    out = pairs.join(df, "term").join(held, "value").withColumn("p", F.least(p, F.lit(1.0))).withColumn("bits", F.log2(F.col("p") * total / F.col("held")))
    return out.where((F.col("p") >= share) & (F.col("bits") >= bits)).select("term", "value", "n", "df", "p", "bits", (F.col("p") >= remove_share).alias("removed"))


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("spans", "sanitised"), broadcast_terms: int = 100_000, **how) -> DataFrame:
    """Columns ``keep`` (default: the id) of every document, with ``spans`` array<struct<kind,start,end,removed>>, ``sanitised`` text.

    Patterns become placeholders such as ``[EMAIL]``; terms become ``[TERM]`` or nothing.
    Overlapping spans are replaced together, under the first one's name.
    """
    keep = keep if keep is not None else [id_col]
    told = disclosing(docs, id_col=id_col, text_col=text_col, broadcast_terms=broadcast_terms, **how).groupBy("term").agg(F.max("removed").alias("removed"))
    told = cut(told)
    some = told.limit(broadcast_terms + 1).collect()
    few = len(some) <= broadcast_terms
    shared = docs.sparkSession.sparkContext.broadcast({r["term"]: r["removed"] for r in some} if few else None)
    read = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_col).alias("_text"))
    if few:
        read = read.withColumn("_terms", F.lit(None).cast("map<string,boolean>"))
    else:
        # Too many terms to send: each text gets its own, by a join on its distinct words.
        keys = [F.xxhash64("_text").alias("_k1"), F.xxhash64("_text", F.lit(1)).alias("_k2")]

        def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                words = [sorted(set(WORD.findall(t.lower()))) for t in texts_of(b, "_text")]
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(words, pa.list_(pa.string()))], names=["_k1", "_k2", "words"])

        words = arrow_map(read.select("_text", *keys), distinct, "_k1 long, _k2 long, words array<string>").select("_k1", "_k2", F.explode("words").alias("term")).distinct()
        own = words.join(told, "term").groupBy("_k1", "_k2").agg(F.map_from_entries(F.collect_list(F.struct("term", "removed"))).alias("_terms"))
        read = read.select("*", *keys).join(own, ["_k1", "_k2"], "left").drop("_k1", "_k2")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = shared.value
        k = len(keep)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("removed", pa.bool_())]))
        for b in batches:
            found, clean = [], []
            for text, own in zip(texts_of(b, "_text"), b.column(k + 1).to_pylist(), strict=True):
                terms = sent if sent is not None else dict(own or ())
                rows = [(a, c, e, False) for a, c, e in base_spans(text)]
                if terms:
                    rows += [(m.start(), 4, m.end(), terms[w]) for m in WORD.finditer(text) if (w := m[0].lower()) in terms]
                    rows.sort()
                out, at = [], 0
                for a, c, e, removed in rows:
                    if a >= at:
                        out += [text[at:a], "" if removed else f"[{KINDS[c].upper()}]"]
                    at = max(at, e)
                found.append([{"kind": KINDS[c], "start": a, "end": e, "removed": r} for a, c, e, r in rows])
                clean.append("".join([*out, text[at:]]) if rows else text)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(k)), pa.array(found, kind), pa.array(clean, pa.string())], names=[*(f"k{i}" for i in range(k)), "spans", "sanitised"])

    schema = ", ".join([*(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "spans array<struct<kind:string,start:bigint,end:bigint,removed:boolean>>", "sanitised string"])
    return arrow_map(read, mark, schema).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("spans").alias(names[0]), F.col("sanitised").alias(names[1]))
