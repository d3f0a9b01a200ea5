"""Language identification by words first, then ever shorter character n-grams.

A model holds, for each language, log frequencies of whole words and of character
n-grams (with word edges). A word that the model knows is scored by its log
frequency in each language. An unseen word backs off: its n-grams of the longest
order are tried, then shorter ones, until some of them are known.

Training reads a bounded sample of labelled rows (``per_lang`` rows a language are
expected) and keeps at most ``top_words`` words and ``top_grams`` n-grams of each
order for each language, so that the broadcast model has a fixed bound:
languages * (top_words + orders * top_grams) entries.

Defined cases: null or letterless text is ``und`` with score 0; without a single
labelled row every text is ``und``; rows with null language are not learned from;
repeated rows are scored alike; languages equally likely go to the first by name; words and
n-grams of equal counts are kept in their order; very long texts are read whole, and their
score rests on the mean over all words; an empty table gives no rows; columns that aren't
kept are ignored, and kept ones may have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.common import Memo, arrow_map, drawn, texts_of

#: Characters that \w takes and that are neither letters nor decimal digits, such as fractions and Roman numerals.
NUMERALS = "".join(c for c in map(chr, range(0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
LETTERS, NUMERAL = re.compile(r"[^\W\d_]+"), re.compile(f"[{NUMERALS}]")
#: Words that count as evidence at most: the score's logits are means scaled to so many words.
EVIDENCE = 20


def words_of(text: str) -> list[str]:
    """The runs of letters of a text in lower case."""
    low = text.lower()
    return LETTERS.findall(low if low.isascii() else NUMERAL.sub(" ", low))


@dataclass
class Model:
    langs: list[str]
    words: dict[str, tuple[float, ...]]
    grams: list[dict[str, tuple[float, ...]]]  # longest order first
    orders: tuple[int, ...]

    def word(self, w: str) -> tuple[float, ...]:
        """Log-likelihood of one word in each language."""
        if (known := self.words.get(w)) is not None:
            return known
        edged = f"^{w}$"
        for n, table in zip(self.orders, self.grams, strict=True):
            found = [table[g] for i in range(len(edged) - n + 1) if (g := edged[i : i + n]) in table]
            if found:
                k = len(found)
                return found[0] if k == 1 else tuple([sum(c) / k for c in zip(*found, strict=True)])
        return (0.0,) * len(self.langs)

    def chunk(self, chunk: str) -> tuple[float, ...]:
        """Log-likelihoods of the words in a piece of text without white space, then their number."""
        found = words_of(chunk)
        if len(found) == 1:
            return (*self.word(found[0]), 1.0)
        return (*(sum(c) for c in zip(*map(self.word, found), strict=True)), float(len(found))) if found else (0.0,) * (len(self.langs) + 1)


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", *, per_lang: int = 2000, top_words: int = 20_000, top_grams: int = 8_000, orders: tuple[int, ...] = (5, 4, 3, 2, 1)) -> Model:
    """Fit a model on a bounded, repeatable sample of the labelled rows."""
    rows = rows.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {}, [{} for _ in orders], orders)
    share: Column = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / n))).otherwise(share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in batches:
            for text, lang in zip(texts_of(b, "text"), b.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
        for lang, words in seen.items():
            grams = [Counter() for _ in orders]
            for w, c in words.items():
                edged = f"^{w}$"
                for n, g in zip(orders, grams, strict=True):
                    for i in range(len(edged) - n + 1):
                        g[edged[i : i + n]] += c
            for n, g in [(0, words), *zip(orders, grams, strict=True)]:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array([n] * len(g), pa.int32()), pa.array(list(g), pa.string()), pa.array(list(g.values()), pa.int64())], names=["lang", "n", "gram", "c"])

    counts = arrow_map(rows.where(drawn("id", share)).select("text", "lang"), count, "lang string, n int, gram string, c long")
    counts = counts.groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    place = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("c"), "gram"))
    kept = counts.withColumn("place", place).where(F.col("place") <= F.when(F.col("n") == 0, top_words).otherwise(top_grams)).collect()
    totals, vocab = Counter(), {}
    for r in kept:
        totals[r["lang"], r["n"]] += r["c"]
        vocab.setdefault(r["n"], {}).setdefault(r["gram"], Counter())[r["lang"]] = r["c"]
    tables = {}
    for n in (0, *orders):
        table, v = {}, len(vocab.get(n, {})) + 1
        for gram, c in vocab.get(n, {}).items():
            table[gram] = tuple(math.log((c[x] + 0.5) / (totals[x, n] + 0.5 * v)) for x in langs)
        tables[n] = table
    return Model(langs, tables[0], [tables[n] for n in orders], orders)


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` of docs with lang_pred and score (0 to 1), or whatever they are to be named, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]
    # A kept text isn't sent twice.
    source = f"k{keep.index(text_col)}" if text_col in keep else "_text"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        k = len(m.langs)
        rows: list[tuple[float, ...]] = []

        def add(chunk: str) -> int:
            rows.append(m.chunk(chunk))
            return len(rows) - 1

        table, ids, filled = np.zeros((1024, k + 1)), Memo(add, most=1 << 62), 0
        for b in batches:
            langs, scores = [], []
            if len(ids) > 150_000:
                ids.clear()
                rows.clear()
                filled = 0
            found = [np.fromiter(map(ids.__getitem__, chunks), np.int64, len(chunks)) for chunks in map(str.split, texts_of(b, source))]
            if len(rows) > len(table):
                table = np.concatenate([table[:filled], np.zeros((len(rows) + 50_000 - filled, k + 1))])
            if len(rows) > filled:
                table[filled : len(rows)] = rows[filled:]
                filled = len(rows)
            for at in found:
                total = table[at].sum(axis=0)
                if not k or total[k] == 0:
                    langs.append("und")
                    scores.append(0.0)
                else:
                    z = total[:k] * (min(total[k], EVIDENCE) / total[k])
                    p = np.exp(z - z.max())
                    best = int(np.argmax(p))
                    langs.append(m.langs[best])
                    scores.append(float(p[best] / p.sum()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*(f"k{i}" for i in range(len(keep))), "lang_pred", "score"])

    schema = ", ".join([*(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)), "lang_pred string, score double"])
    columns = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    out = arrow_map(docs.select(*columns, *([F.col(text_col).alias("_text")] if source == "_text" else [])), score, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("lang_pred").alias(names[0]), F.col("score").alias(names[1]))
