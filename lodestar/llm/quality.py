"""Quality scores from histogram gradient-boosted trees over document statistics.

The statistics describe a text's shape (sizes, character classes, repetition, lines);
no label, language, source or id is among them. Trees are grown level by level on
binned features on the driver, from at most about ``max_rows`` labelled rows, and
flattened to arrays, which are broadcast (their size is fixed by rounds and depth)
and walked for whole batches at once.

Defined cases: null and empty texts have the statistics of an empty text and a score
like any other; without labelled rows every score is 0.5, with labels of one kind only
it is that kind's smoothed share; a document with several labels counts once for each;
null labels are not learned from; very long texts are measured whole; an empty table gives no
rows; repeated rows are scored each, and alike; of splits that gain the same the first by
statistic and then by bin is taken, and a statistic equal to a cut goes left; columns beside
those kept are ignored, and kept ones may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_map, drawn, texts_of

STATISTICS = "log_bytes log_words word_len type_ratio top_share upper_first upper_bytes digits spaces non_ascii commas stops bars bangs symbols short_words long_words lines line_len line_repeat ended repeat_pairs other".split()
UPPER, LOWER, DIGIT, SPACE = (np.array([bool(f(chr(i))) for i in range(128)] + [False] * 128) for f in (str.isupper, str.islower, str.isdigit, str.isspace))
SYMBOL = np.array([chr(i) in "#$%&*+<=>@^_~`\\/{}[]" for i in range(128)] + [False] * 128)


def statistics(text: str) -> list[float]:
    """The statistics of one text, in the order of STATISTICS."""
    raw = text.encode("utf-8", "replace")
    words, lines = raw.split(), raw.split(b"\n")
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, w = max(1, len(raw)), max(1, len(words))
    lens = np.fromiter(map(len, words), np.int64, len(words))
    often = Counter(words)
    kinds = len(often)
    pairs = len(set(zip(words, words[1:], strict=False)))
    top = max(often.values(), default=0)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), float(lens.mean()) if len(words) else 0.0, kinds / w, top / w,
        sum(k for x, k in often.items() if x[:1].isupper()) / w,
        h[UPPER].sum() / n, h[DIGIT].sum() / n, h[SPACE].sum() / n, h[128:].sum() / n, h[44] / n, (h[46] + h[63]) / n, h[124] / n, h[33] / n, h[SYMBOL].sum() / n,
        float((lens <= 3).sum()) / w, float((lens >= 12).sum()) / w, np.log1p(len(lines)), len(raw) / len(lines), 1 - len(set(lines)) / len(lines),
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines), 1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        (n - h[UPPER].sum() - h[LOWER].sum() - h[SPACE].sum() - h[128:].sum()) / n,
    ]


@dataclass
class Forest:
    """Complete binary trees of one depth: node k has children 2k+1 and 2k+2."""

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # (trees, inner nodes): go right above it
    leaf: np.ndarray  # (trees, leaves)

    def score(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while inner and at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            z += leaf[at - inner]
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 2.0, least: float = 4.0) -> Forest:
    """Boost trees on the logistic loss; each level's splits come from gradient histograms."""
    inner, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    f = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    z, out = np.full(len(y), base), []
    offset = np.arange(f) * bins
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        at, feature, cut = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, k = 2**level - 1, 2**level
            key = ((at - first)[:, None] * f * bins + offset + binned).ravel()
            G, H = (np.bincount(key, np.repeat(v, f), k * f * bins).reshape(k, f, bins) for v in (g, h))
            GL, HL = G.cumsum(2), H.cumsum(2)
            GT, HT = GL[:, :, -1:], HL[:, :, -1:]
            gain = GL**2 / (HL + l2) + (GT - GL) ** 2 / (HT - HL + l2) - GT**2 / (HT + l2)
            gain[(HL < least) | (HT - HL < least)] = -1
            for j in range(k):
                i, b = divmod(int(gain[j].argmax()), bins)
                if gain[j, i, b] > 1e-9 and b < len(edges[i]):
                    feature[first + j], cut[first + j] = i, edges[i][b]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
        at -= inner
        leaf = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + l2)
        z += leaf[at]
        out.append((feature, cut, leaf))
    return Forest(base, *(np.stack(v) for v in zip(*out, strict=True)))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", *, max_rows: int = 20_000, **how) -> Forest:
    """Fit on labelled documents; about ``max_rows`` of them, drawn by a hash of their id, where there are more."""
    labels = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    n = labels.count()
    labels = labels.where(drawn("id", min(1.0, max_rows / max(1, n))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(drawn("id", min(1.0, max_rows / max(1, n)))).join(labels, "id").select("y", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t) for t in texts_of(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    got = arrow_map(rows, measure, "y double, x array<double>").collect()
    got.sort(key=lambda r: (r["y"], r["x"]))
    return fit(np.array([r["x"] for r in got]).reshape(len(got), len(STATISTICS)), np.array([r["y"] for r in got]), **how)


def score(docs: DataFrame, forest: Forest, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of docs with a score from 0 to 1 for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    fields = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in texts_of(b, "_text")]).reshape(b.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(shared.value.score(x), pa.float64())], names=[*(f"k{i}" for i in range(len(keep))), "score"])

    schema = ", ".join([*(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)), "score double"])
    out = arrow_map(docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_col).alias("_text")), run, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "score")
