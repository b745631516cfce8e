"""Approximate nearest neighbours: one navigable small-world graph per shard.

Equal vectors are one node that carries its smallest ids.  Nodes are dealt to shards
by a hash of the vector; each shard is built in one task as a hierarchical navigable
small-world graph, held as flat arrays (for each layer the node numbers and a matrix
of neighbours), and written as one row.  Nodes enter a layer in batches that double it;
the candidates of each are the nearest of those before it and of its batch, of which
neighbours in different directions are linked both ways.  Queries are dealt to every
shard, searched from the top layer down, and the shard results are merged by distance.

Distances are in double precision, by differences: nothing is lost where vectors lie
far from the origin.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARD_ROWS = 8192
#: So many shards are searched in one task and merged there, once there are enough for many tasks.
POOL, TASKS = 8, 64
LINKS = 12
BUILD_WIDTH = 48
SEARCH_WIDTH = 64
#: Nodes kept while a search descends: tight groups far apart leave a single one in the wrong group.
DESCENT = 8
MAX_QUERIES = 100_000
#: Squares of components beyond this are out of proportion to ordinary ones.
HUGE = 1e100
#: Nodes that enter a layer at once, at most; bounds the memory of a build.
BATCH = 256


def fitted(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """The vectors times a power of two, so that squares can't overflow; and that power."""
    most = float(np.abs(vectors).max(initial=0.0))
    scale = 2.0 ** -max(0, math.frexp(most)[1] - 400)
    return np.ascontiguousarray(vectors * scale), scale


class Graph:
    """A hierarchical navigable small-world graph over the rows of ``vectors``."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH, seed: int = 10):
        self.vectors, self.scale = fitted(np.asarray(vectors, np.float64))
        self.links, self.width = links, width
        n = len(self.vectors)
        rng = np.random.default_rng(seed)
        self.height = np.minimum((-np.log(rng.uniform(1e-9, 1, n)) / math.log(links)).astype(np.int32), 12)
        order = rng.permutation(n)
        self.entry = int(order[self.height[order].argmax()]) if n else 0
        self.rows, self.layers = [], []
        for layer in range(int(self.height.max(initial=0)) + 1):
            members = order[self.height[order] >= layer]
            near = self._layer(members, links * 2 if layer == 0 else links)  # the higher layers hold few nodes
            own = np.sort(members)
            table = np.empty_like(near)
            table[np.searchsorted(own, members)] = np.where(near >= 0, members[near], -1)
            self.layers.append(table.astype(np.int32))
        self._ready()

    def _ready(self) -> None:
        n = len(self.vectors)
        self.rows = [None]
        for layer in range(1, len(self.layers)):
            rows = np.full(n, -1, np.int32)
            members = np.flatnonzero(self.height >= layer)
            rows[members] = np.arange(len(members))
            self.rows.append(rows)
        self._mark, self._turn = np.zeros(n, np.int32), 0

    def _layer(self, members: np.ndarray, most: int) -> np.ndarray:
        """Neighbours of each member, as places among the members; -1 where there is none."""
        v = self.vectors[members]
        middle = v - np.median(v, axis=0) if len(v) else v
        norms = np.einsum("ij,ij->i", middle, middle)
        table = np.full((len(v), most), -1, np.int64)
        lo = 0
        while lo < len(v):
            hi = min(len(v), lo + min(BATCH, max(lo, 2 * self.width)))
            nodes = np.arange(lo, hi)
            found = self._candidates(v, middle, norms, nodes, hi)
            chosen = self._diverse(v, nodes, found, self.links)
            table[nodes, : self.links] = chosen
            node, slot = np.nonzero(chosen >= 0)
            self._link_back(v, table, chosen[node, slot], nodes[node])
            lo = hi
        return table

    def _candidates(self, v, middle, norms, nodes, upto) -> np.ndarray:
        """The nearest ``width`` of the first ``upto`` members for each node, nearest first.

        Chosen by products of centred vectors, where rounding can't matter; else by differences.
        """
        width = min(self.width, upto - 1)
        if width < 1:
            return np.full((len(nodes), 1), -1)
        far = norms[nodes, None] + norms[None, :upto] - 2 * (middle[nodes] @ middle[:upto].T)
        far[np.arange(len(nodes)), nodes] = np.inf
        found = np.argpartition(far, width - 1, axis=1)[:, :width]
        dist = ((v[found] - v[nodes, None]) ** 2).sum(axis=2)
        for i in np.flatnonzero(dist.max(axis=1) < 1e-11 * (norms[nodes] + norms[:upto].max())):
            every = ((v[:upto] - v[nodes[i]]) ** 2).sum(axis=1)
            every[nodes[i]] = np.inf
            found[i] = np.argpartition(every, width - 1)[:width]
            dist[i] = every[found[i]]
        return np.take_along_axis(found, np.lexsort((found, dist), axis=1), axis=1)

    @staticmethod
    def _diverse(v, nodes, found, most) -> np.ndarray:
        """For each node at most ``most`` of its candidates (nearest first, -1 is none), in different directions.

        One is passed over if a chosen one is nearer to it than the node is; what is
        passed over fills places that stay free.
        """
        local = v[found] - v[nodes, None]
        own = np.einsum("ijk,ijk->ij", local, local)
        between = own[:, :, None] + own[:, None, :] - 2 * (local @ local.transpose(0, 2, 1))
        there = found >= 0
        alive, rank = there.copy(), np.full(found.shape, 1 << 20)
        each = np.arange(len(nodes))
        for step in range(most):
            pick = alive.argmax(axis=1)
            has = alive[each, pick]
            if not has.any():
                break
            rank[each[has], pick[has]] = step
            alive &= between[each, pick] >= own
            alive[each, pick] = False
        rank = np.where(there, rank + np.arange(found.shape[1]) * (rank >= 1 << 20), 1 << 30)
        order = rank.argsort(axis=1, kind="stable")[:, :most]
        out = np.full((len(nodes), most), -1)
        out[:, : order.shape[1]] = np.take_along_axis(found, order, axis=1)
        return out

    def _link_back(self, v, table, targets, nodes) -> None:
        """Adds each node to its target's neighbours, of which the most diverse stay where there are too many."""
        if not len(targets):
            return
        most = table.shape[1]
        at = np.unique(targets)
        old_at, old_slot = np.nonzero(table[at] >= 0)
        pairs = np.unique(np.concatenate([targets * len(v) + nodes, at[old_at] * len(v) + table[at][old_at, old_slot]]))
        target, other = pairs // len(v), pairs % len(v)
        dist = ((v[target] - v[other]) ** 2).sum(axis=1)
        order = np.lexsort((other, dist, target))
        target, other = target[order], other[order]
        first = np.searchsorted(target, at)
        place = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
        keep = place < 2 * most
        rows = np.full((len(at), 2 * most), -1)
        rows[np.searchsorted(at, target[keep]), place[keep]] = other[keep]
        full = rows[:, most] >= 0
        table[at[~full]] = rows[~full, :most]
        many = np.flatnonzero(full)
        for i in range(0, len(many), BATCH):
            part = many[i : i + BATCH]
            table[at[part]] = self._diverse(v, at[part], rows[part], most)

    def _near(self, query: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        apart = self.vectors[nodes] - query
        return np.einsum("ij,ij->i", apart, apart)

    def _of(self, node: int, layer: int) -> np.ndarray:
        row = self.layers[layer][node if layer == 0 else self.rows[layer][node]]
        return row[row >= 0]

    def search(self, query: np.ndarray, starts: list[tuple[float, int]], layer: int, width: int) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes met in a layer, best first."""
        self._turn += 1
        turn, mark = self._turn, self._mark
        todo = list(starts)
        best = [(-d, x) for d, x in starts]
        for _, x in starts:
            mark[x] = turn
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            d, x = heapq.heappop(todo)
            if d > -best[0][0] and len(best) >= width:
                break
            near = self._of(x, layer)
            near = near[mark[near] != turn]
            if not len(near):
                continue
            mark[near] = turn
            dist = self._near(query, near)
            if len(best) >= width:
                keep = dist < -best[0][0]
                near, dist = near[keep], dist[keep]
            for e, y in zip(dist.tolist(), near.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (-e, y))
                    heapq.heappush(todo, (e, y))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, y))
                    heapq.heappush(todo, (e, y))
        return sorted((-d, x) for d, x in best)

    def flat(self) -> dict:
        """The arrays of the graph as bytes."""
        return {
            "entry": int(self.entry), "links": self.links, "height": self.height.astype("<i4").tobytes(),
            "layers": [x.astype("<i4").tobytes() for x in self.layers],
        }

    @classmethod
    def of(cls, vectors: np.ndarray, entry: int, links: int, height: bytes, layers: list[bytes]) -> Graph:
        self = cls.__new__(cls)
        self.vectors, self.scale = fitted(vectors)
        self.height = np.frombuffer(height, "<i4")
        self.entry, self.links = entry, links
        self.layers = [np.frombuffer(x, "<i4").reshape(-1, links * 2 if k == 0 else links) for k, x in enumerate(layers)]
        self._ready()
        return self

    def nearest(self, query: np.ndarray, width: int) -> np.ndarray:
        """Nodes near the query, at most ``width``."""
        query = np.asarray(query, np.float64) * self.scale
        at = [(float(self._near(query, np.array([self.entry]))[0]), self.entry)]
        for layer in range(int(self.height[self.entry]), 0, -1):
            at = self.search(query, at, layer, DESCENT)
        return np.array([x for _, x in self.search(query, at, 0, width)])


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, for any finite components."""
    apart = vectors - query
    with np.errstate(over="ignore"):
        out = np.sqrt((apart**2).sum(axis=1))
    over = ~np.isfinite(out)
    if over.any():  # squares beyond the largest double: each row in the scale of its own largest difference
        half = vectors[over] / 2 - query / 2
        most = np.abs(half).max(axis=1)
        out[over] = np.sqrt(((half / most[:, None]) ** 2).sum(axis=1)) * most * 2
    return out


def usable(df: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = df.select("vec_id", v.alias("embedding")).where("vec_id is not null and embedding is not null")
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(whole & F.exists("embedding", lambda x: x != 0))


def _few(keep: int):
    """Within a batch, one row for each vector with its smallest ids."""

    def run(batches):
        for batch in batches:
            by: dict[tuple, list[int]] = {}
            where: dict[tuple, int] = {}
            shard, vec, ids = (batch.column(i).to_pylist() for i in range(3))
            for i, key in enumerate(zip(shard, vec)):
                by.setdefault(key, []).extend(ids[i])
                where.setdefault(key, i)
            took = pa.array(list(where.values()), pa.int64())
            own = pa.array([sorted(set(x))[:keep] for x in by.values()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(took), batch.column(1).take(took), own], ["shard", "vec", "ids"])

    return run


_NODE = "shard int, vec binary, ids array<long>"
_INDEX = "shard int, dim int, vectors binary, ids array<array<long>>, entry int, links int, height binary, layers array<binary>"


def _build(links: int, width: int, keep: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes: dict[bytes, list[int]] = {}
        for vec, ids in zip(pdf["vec"], pdf["ids"]):
            nodes.setdefault(vec, []).extend(int(i) for i in ids)
        out = []
        for size in sorted({len(v) for v in nodes}):  # vectors of one length each
            own = sorted((v, sorted(set(i))[:keep]) for v, i in nodes.items() if len(v) == size)
            raw = b"".join(v for v, _ in own)
            flat = Graph(np.frombuffer(raw, "<f8").reshape(len(own), -1), links, width).flat()
            out.append({"shard": int(pdf["shard"].iloc[0]), "dim": size // 8, "vectors": raw, "ids": [i for _, i in own]} | flat)
        return pd.DataFrame(out)

    return run


def _packed(df: DataFrame) -> DataFrame:
    """The embedding as bytes: the vector's key, and what crosses to the tasks."""

    def run(batches):
        for batch in batches:
            vec = [np.array(v, "<f8") for v in batch.column("embedding").to_pylist()]
            huge = [bool((np.abs(v) > HUGE).any()) for v in vec]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([v.tobytes() for v in vec], pa.binary()), pa.array(huge, pa.bool_())], ["vec_id", "vec", "huge"])

    return df.mapInArrow(run, "vec_id long, vec binary, huge boolean")


def build_index(df: DataFrame, keep: int, shard_rows: int = SHARD_ROWS, links: int = LINKS, width: int = BUILD_WIDTH) -> DataFrame:
    """One row of flat arrays for each shard (and vector length), written to the shared folder.

    ``keep`` ids are kept for a vector that repeats: the smallest, which is all that a
    search for fewer neighbours with ties to the smaller id can return.
    """
    rows = stored(_packed(usable(df)), "vectors")
    shards = max(1, math.ceil(rows.count() / shard_rows))
    # beside a huge component the squares of ordinary ones vanish, so huge vectors have shards of their own
    place = F.expr(f"cast(pmod(xxhash64(vec), {shards}) as int)") + F.when(F.col("huge"), shards).otherwise(0)
    dealt = rows.select(place.alias("shard"), "vec", F.array("vec_id").alias("ids"))
    nodes = dealt.mapInArrow(_few(keep), _NODE).repartition(shards, "shard")
    return stored(nodes.groupBy("shard").applyInPandas(_build(links, width, keep), _INDEX), "index")


def _search(k: int, width: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        best: dict[int, list[tuple[float, int]]] = {}
        for row in index.itertuples():
            vectors = np.frombuffer(row.vectors, "<f8").reshape(-1, row.dim)
            graph = Graph.of(vectors, row.entry, row.links, row.height, list(row.layers))
            for q, vec in zip(queries["query_id"].tolist(), queries["vec"]):
                if len(vec) != 8 * row.dim:
                    continue
                query = np.frombuffer(vec, "<f8")
                near = graph.nearest(query, max(width, k + 1))
                more = [(float(s), int(i)) for s, x in zip(distances(vectors[near], query), near) for i in row.ids[x] if i != q]
                best[q] = heapq.nsmallest(k, best.get(q, []) + more)
        found = [(q, i, s) for q, own in best.items() for s, i in own]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    return run


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, width: int = SEARCH_WIDTH, shard_rows: int = SHARD_ROWS, max_queries: int = MAX_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest rows of ``df`` for each query.

    ``queries`` has the columns of ``df`` (vec_id, embedding).  score is the Euclidean
    distance in double precision; ties go to the smaller vec_id; a query is not its own
    neighbour.  Vectors that are null, zero, empty or hold null or non-finite components
    take no part, nor do rows without id; vectors of other lengths are not candidates.
    A query id that repeats with different vectors is searched by the one whose bytes
    sort first.  An empty table gives an empty result; other columns are ignored.
    Queries are searched in blocks of about ``max_queries``; a task holds one block and
    one shard at a time, and merges what its shards find before anything is shuffled.
    """
    index = build_index(df, k + 1, shard_rows)
    shards = max(1, index.agg(F.coalesce(F.max("shard") + 1, F.lit(0))).first()[0])
    pools = max(min(shards, TASKS), math.ceil(shards / POOL))
    pooled = index.withColumn("pool", F.col("shard") % pools)
    asked = _packed(usable(queries)).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec"))
    asked = stored(asked, "queries")
    blocks = max(1, math.ceil(asked.count() / max_queries))
    parts = []
    for block in range(blocks):
        own = asked.where(F.expr(f"pmod(xxhash64(query_id), {blocks}) = {block}"))
        dealt = own.withColumn("pool", F.explode(F.sequence(F.lit(0), F.lit(pools - 1))))
        found = pooled.groupBy("pool").cogroup(dealt.groupBy("pool")).applyInPandas(_search(k, width), "query_id long, vec_id long, score double")
        parts.append(stored(found, "found"))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
