"""Near-duplicate vectors by hierarchical navigable small-world graphs, one for each shard.

Equal vectors form one class with one representative. Representatives are dealt to shards
of at most about ``shard_rows`` (``shards`` at least); each shard's graph is built once and
every representative queries every shard: a shard's graph comes first in its task, and the
queries stream past it. Graphs are copied only where there are fewer shards than cores.

The base layer's beam starts at 24 and is doubled until a recall audit passes: of the links
that brute force finds between a shard's vectors and audited ones, ``recall`` must be found
by the graph, hits of a vector on itself left out. Audited are about ``audit`` vectors drawn from all
shards, and as many of the shard's own, in up to 8 rounds, until ``audit_links`` links have been
checked. A beam of half the shard or more is a comparison with all of it, so every audit ends.
A query whose beam is full of links is repeated with a wider one, up to the whole shard, so
large groups are found whole. Every hit's cosine is verified in double precision.

Links are counted where they are found (``n_links`` is what a vector's own queries found, with
copies), and only as many go on as tie the components together.

Defined cases: null, empty and zero vectors, and vectors with null or non-finite components,
link with nothing; vectors of different lengths don't link; equal vectors always do; a null
id keeps its row with 0 links and a null component; repeated rows count as vectors of their own;
a cosine of just ``least`` links; an empty table gives no rows; columns beside the id and the
vector are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.checkpoints import cut
from lodestar.llm.common import FOREST, Forest, arrow_map, components, drawn
from lodestar.shipping import ship

#: Queries that walk a graph side by side, and nodes that each of them opens in a step.
LOCKSTEP, OPEN = 256, 4
#: Cosines in single precision within this of the threshold are verified in double.
SLACK = 1e-4
#: Bytes of a graph in one row; rounds of an audit.
PART, AUDITS = 4 << 20, 8


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Graph:
    """Vectors of a shard with neighbour lists for each layer; -1 fills a list up."""

    def __init__(self, x: np.ndarray, m: int = 16, build_ef: int = 48, seed: int = 7):
        self.x, self.m = unit(x.astype(np.float64)).astype(np.float32), m
        n = len(x)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(rng.random(n)) / np.log(m)).astype(int), 6)
        self.level[0] = self.level.max()
        self.lists = [np.full((n, 3 * m if layer == 0 else 2 * m), -1, np.int32) for layer in range(self.level[0] + 1)]
        self.size = [np.zeros(n, np.int64) for _ in self.lists]
        self.ef = 24
        done = 1
        while done < n:
            stop = min(n, 2 * done, done + LOCKSTEP)
            self._insert(done, stop, build_ef)
            done = stop

    def _search_layer(self, q: np.ndarray, entry: np.ndarray, ef: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """Beams of the ef nearest nodes (ids, cosines; -1 fills up), best first, from the entry nodes (rows, k)."""
        b, lists = len(q), self.lists[layer]
        width = max(ef, entry.shape[1])
        ids = np.full((b, width), -1, np.int32)
        sims = np.full((b, width), -np.inf, np.float32)
        ids[:, : entry.shape[1]] = entry
        sims[:, : entry.shape[1]] = np.where(entry >= 0, np.einsum("bd,bkd->bk", q, self.x[entry]), -np.inf)
        opened = ids < 0
        seen = np.zeros((b, len(self.x)), bool)
        r, c = np.nonzero(entry >= 0)
        seen[r, entry[r, c]] = True
        rows = np.arange(b)
        while len(rows):
            s = np.where(opened[rows], -np.inf, sims[rows])
            k = min(OPEN, s.shape[1])
            at = np.argpartition(-s, k - 1, axis=1)[:, :k]
            fresh = np.take_along_axis(s, at, 1) > -np.inf
            going = fresh.any(axis=1)
            rows, at, fresh = rows[going], at[going], fresh[going]
            if not len(rows):
                break
            nodes = ids[rows[:, None], at]
            opened[rows[:, None], at] = True
            near = np.where(fresh[:, :, None], lists[nodes], -1).reshape(len(rows), -1)
            near.sort(axis=1)
            new = near >= 0
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            new &= ~seen[rows[:, None], near]
            r, c = np.nonzero(new)
            if not len(r):
                continue
            found = near[r, c]
            seen[rows[r], found] = True
            close = np.full(near.shape, -np.inf, np.float32)
            close[r, c] = np.einsum("id,id->i", q[rows[r]], self.x[found])
            all_sims = np.concatenate([sims[rows], close], axis=1)
            all_ids = np.concatenate([ids[rows], near], axis=1)
            all_open = np.concatenate([opened[rows], np.zeros(near.shape, bool)], axis=1)
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            sims[rows] = np.take_along_axis(all_sims, best, 1)
            ids[rows] = np.take_along_axis(all_ids, best, 1)
            opened[rows] = np.take_along_axis(all_open, best, 1) | (sims[rows] == -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :ef]
        sims = np.take_along_axis(sims, order, 1)
        return np.where(sims == -np.inf, -1, np.take_along_axis(ids, order, 1)), sims

    def _chosen(self, x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, those nearer to x than to any chosen before, then the nearest others; -1 fills up."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        v = self.x[ids]
        between = v @ v.transpose(0, 2, 1)
        keep = np.zeros(ids.shape, bool)
        for c in range(ids.shape[1]):
            keep[:, c] = (sims[:, c] > -np.inf) & (np.where(keep, between[:, c], -np.inf).max(axis=1) < sims[:, c]) & (keep.sum(axis=1) < most)
        rank = np.where(sims == -np.inf, 2, np.where(keep, 0, 1))
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(ids, order, 1), -1)

    def _descend(self, q: np.ndarray, down_to: int) -> np.ndarray:
        entry = np.zeros((len(q), 1), np.int32)
        for layer in range(len(self.lists) - 1, down_to, -1):
            entry = self._search_layer(q, entry, 4, layer)[0]
        return entry

    def _insert(self, a: int, b: int, ef: int) -> None:
        q = self.x[a:b]
        inner = q @ q.T
        np.fill_diagonal(inner, -np.inf)
        entry = np.zeros((b - a, 1), np.int32)
        for layer in range(len(self.lists) - 1, -1, -1):
            ids, sims = self._search_layer(q, entry, ef, layer)
            entry = ids[:, :4]
            mine = np.flatnonzero(self.level[a:b] >= layer)
            if not len(mine):
                continue
            # Nodes of the batch aren't linked yet; they see each other directly.
            k = min(self.m, len(mine))
            own = inner[np.ix_(mine, mine)]
            at = np.argpartition(-own, k - 1, axis=1)[:, :k] if k < len(mine) else np.tile(np.arange(len(mine)), (len(mine), 1))
            cand = np.concatenate([ids[mine], (a + mine[at]).astype(np.int32)], axis=1)
            near = np.concatenate([sims[mine], np.take_along_axis(own, at, 1)], axis=1)
            near = np.where(cand >= 0, near, -np.inf)
            chosen = self._chosen(q[mine], np.maximum(cand, 0), near, self.m)
            self._link(layer, np.repeat(a + mine, chosen.shape[1]), chosen.ravel())

    def _link(self, layer: int, u: np.ndarray, v: np.ndarray) -> None:
        """Links both ways; a list that would run over is chosen anew."""
        u, v = u[v >= 0], v[v >= 0]
        src, dst = np.concatenate([u, v]).astype(np.int64), np.concatenate([v, u]).astype(np.int32)
        lists, size = self.lists[layer], self.size[layer]
        _, first = np.unique(src * len(self.x) + dst, return_index=True)
        src, dst = src[first], dst[first]
        known = (lists[src] == dst[:, None]).any(axis=1)
        src, dst = src[~known], dst[~known]
        if not len(src):
            return
        heads, starts, counts = np.unique(src, return_index=True, return_counts=True)
        within = np.arange(len(src)) - np.repeat(starts, counts)
        room = lists.shape[1]
        over = size[heads] + counts > room
        ok = ~np.repeat(over, counts)
        lists[src[ok], size[src[ok]] + within[ok]] = dst[ok]
        size[heads[~over]] += counts[~over]
        if over.any():
            full = heads[over]
            extra = np.full((len(full), int(counts[over].max())), -1, np.int32)
            extra[np.repeat(np.arange(len(full)), counts[over]), within[~ok]] = dst[~ok]
            cand = np.concatenate([lists[full], extra], axis=1)
            for i in range(0, len(full), 256):
                c = cand[i : i + 256]
                x = self.x[full[i : i + 256]]
                sims = np.where(c >= 0, np.einsum("id,icd->ic", x, self.x[c]), -np.inf)
                kept = self._chosen(x, np.maximum(c, 0), sims, 2 * room // 3)
                lists[full[i : i + 256]] = -1
                lists[full[i : i + 256], : kept.shape[1]] = kept
                size[full[i : i + 256]] = (kept >= 0).sum(axis=1)

    def near(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs with a cosine of about least or more. q: unit vectors in single precision."""
        out_q, out_n = [], []
        n = len(self.x)
        for i in range(0, len(q), LOCKSTEP):
            rows, ef = np.arange(i, min(i + LOCKSTEP, len(q))), self.ef
            entry = self._descend(q[rows], 0)
            while len(rows):
                if 2 * ef >= n:  # the beam would hold most of the shard: compare with all of it
                    r, c = np.nonzero(q[rows] @ self.x.T >= least - SLACK)
                    out_q.append(rows[r])
                    out_n.append(c)
                    break
                ids, sims = self._search_layer(q[rows], entry, ef, 0)
                full = sims[:, -1] >= least - SLACK
                r, c = np.nonzero((sims >= least - SLACK) & ~full[:, None])
                out_q.append(rows[r])
                out_n.append(ids[r, c])
                rows, entry, ef = rows[full], ids[full], 2 * ef
        return np.concatenate([np.zeros(0, np.int64), *out_q]), np.concatenate([np.zeros(0, np.int64), *out_n])

    def links(self, q: np.ndarray, own: np.ndarray, least: float) -> set[tuple[int, int]]:
        """(query, node) pairs by brute force; own: which node each query is itself, or -1."""
        out = set()
        for i in range(0, len(q), 64):
            a, b = np.nonzero(q[i : i + 64] @ self.x.T >= least)
            out |= {(int(u) + i, int(v)) for u, v in zip(a, b, strict=True) if own[u + i] != v}
        return out

    def audit(self, least: float, others: np.ndarray, own: np.ndarray, rows: int, links: int, recall: float, seed: int = 11) -> float:
        """Widen the beam until the links found are enough of those that brute force finds; the share found.

        others: unit vectors of any shard, and which node each of them is here, or -1.
        """
        order = np.random.default_rng(seed).permutation(len(self.x))
        q, own = others.astype(np.float32), own.astype(np.int64)
        truth = self.links(q, own, least)
        for i in range(0, min(len(order), AUDITS * rows), rows):
            part = order[i : i + rows]
            truth |= {(a + len(q), b) for a, b in self.links(self.x[part], part, least)}
            q, own = np.concatenate([q, self.x[part]]), np.concatenate([own, part])
            if len(truth) >= links:
                break
        while True:
            got = {(int(a), int(b)) for a, b in zip(*self.near(q, least), strict=True)}
            reached = len(truth & got) / max(1, len(truth)) if truth else 1.0
            if reached >= recall:
                return reached
            if 2 * self.ef >= len(self.x):
                raise RuntimeError(f"recall {reached} of a whole comparison")  # it can't miss
            self.ef *= 2


def valid(v):
    """Whether a vector can link: not null or empty, all components finite, not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, shards: int = 8, shard_rows: int = 100_000, audit: int = 1024, audit_links: int = 500, recall: float = 0.99) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ship(spark)
    id_type = vectors.schema[id_col].dataType.simpleString()
    # Single precision moves as it is, and is widened where cosines are worked out.
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    ok = rows.where(valid(F.col("v")) & F.col("vec_id").isNotNull())
    reps = cut(ok.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    n = reps.count()
    parts = max(shards, -(-n // shard_rows))
    copies = max(1, -(-2 * spark.sparkContext.defaultParallelism // parts))
    reps = reps.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("int"))
    audited = reps.where(drawn("rep", min(1.0, audit / max(1, n)))).select("rep", "v").collect()
    shared = spark.sparkContext.broadcast([(r["rep"], np.array(r["v"], np.float64)) for r in audited])

    def matrix(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep").combine_chunks()
        ids, x = t.column("rep").to_pylist(), unit(matrix(t.column("v").chunk(0)))
        graph = Graph(x)
        place = {r: i for i, r in enumerate(ids)}
        others = [(place.get(r, -1), v) for r, v in shared.value if len(v) == x.shape[1]]
        y = unit(np.array([v for _, v in others]).reshape(len(others), x.shape[1])) if others else x[:0]
        reached = graph.audit(least, y, np.array([i for i, _ in others], np.int64), audit, audit_links, recall)
        blob = pickle.dumps((graph, x, ids, t.column("copies").to_numpy()), protocol=5)
        pieces = [blob[i : i + PART] for i in range(0, len(blob), PART)]
        same = {c: pa.chunked_array([pa.repeat(t.column(c)[0], len(pieces))]) for c in ("dim", "shard")}
        return pa.table({**same, "seq": pa.array(range(len(pieces)), pa.int32()), "piece": pa.array(pieces, pa.binary()), "recall": [reached] * len(pieces)})

    graphs = cut(reps.select("dim", "shard", "rep", "v", "copies").groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, seq int, piece binary, recall double"))
    worst = graphs.agg(F.min("recall")).first()[0]
    if worst is not None and worst < recall:
        raise RuntimeError(f"a shard's audit ended at a recall of {worst}")

    def spread(limit: int):
        return F.explode(F.sequence(F.lit(0), F.lit(limit - 1)))

    def no(kind: str, name: str):
        return F.lit(None).cast(kind).alias(name)

    # Each (shard, copy) is one task's: its graph's pieces, and then its queries.
    first = graphs.select("dim", "shard", spread(copies).alias("copy"), "seq", "piece", no(id_type, "rep"), no(f"array<{kind}>", "v"))
    queries = reps.select("dim", spread(parts).alias("shard"), F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(copies)).cast("int").alias("copy"), F.lit(1 << 30).alias("seq"), no("binary", "piece"), "rep", "v")
    dealt = first.unionByName(queries).repartitionById(parts * copies, F.col("shard") * copies + F.col("copy")).sortWithinPartitions("dim", "shard", "copy", "seq")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pieces, held, forest, rep_type = None, [], None, Forest(), None

        def tied() -> pa.RecordBatch:
            rows = forest.links()
            forest.up.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], rep_type), pa.array([r[1] for r in rows], rep_type), pa.nulls(len(rows), pa.int64())], names=["a", "b", "n"])

        for b in batches:
            rep_type = b.schema.field("rep").type
            at = np.stack([b.column(k).to_numpy() for k in range(3)], axis=1)
            query = b.column(3).to_numpy() == 1 << 30
            change = np.flatnonzero((at[1:] != at[:-1]).any(axis=1) | (query[1:] != query[:-1])) + 1
            for i, j in zip([0, *change], [*change, len(at)], strict=True):
                if i == j:
                    continue
                if key != tuple(at[i]):
                    key, pieces, held = tuple(at[i]), [], None
                if not query[i]:
                    pieces += b.column(4).slice(i, j - i).to_pylist()
                    continue
                if not pieces and held is None:
                    continue  # no shard of this length
                if held is None:
                    held = pickle.loads(b"".join(pieces))
                    pieces = []
                graph, x, ids, times = held
                y, mine = unit(matrix(b.column(6).slice(i, j - i))), b.column(5).slice(i, j - i).to_pylist()
                u, v = graph.near(y.astype(np.float32), least)
                others = np.zeros(len(mine), np.int64)
                for s in range(0, len(u), 100_000):
                    p, q = u[s : s + 100_000], v[s : s + 100_000]
                    good = np.einsum("id,id->i", y[p], x[q]) >= least
                    for c, d in zip(p[good].tolist(), q[good].tolist(), strict=True):
                        if mine[c] != ids[d]:
                            others[c] += times[d]
                            forest.add(mine[c], ids[d])
                hit = np.flatnonzero(others)
                yield pa.RecordBatch.from_arrays([pa.array([mine[k] for k in hit], rep_type), pa.nulls(len(hit), rep_type), pa.array(others[hit])], names=["a", "b", "n"])
                if len(forest) > FOREST:
                    yield tied()
        if rep_type is not None:
            yield tied()

    hits = cut(arrow_map(dealt, search, f"a {id_type}, b {id_type}, n long"))
    others = hits.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    label = components(hits.where("b IS NOT NULL").select("a", "b")).withColumnsRenamed({"id": "rep"})
    told = reps.join(others, "rep", "left").join(label, "rep", "left").select(F.col("v").alias("key"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.withColumn("key", F.when(valid(F.col("v")) & F.col("vec_id").isNotNull(), F.col("v"))).join(told, "key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
