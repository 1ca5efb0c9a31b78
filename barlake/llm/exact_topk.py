"""Exact top-k search by inner product: ball trees by branch and bound, one a shard.

Candidates are clustered about at most ``CENTRES`` of them, and clusters of more than about ``SHARD`` rows dealt over several shards by a hash. A
first round asks each query of one shard of the cluster that it points to; its k-th score there goes along as the bound when the second round
asks the shards of those clusters whose ball could hold a better one, and most of their nodes are never opened. Within a shard,
blocks of queries open nodes in falling order of the upper bound q.c + |q| r and skip those below every query's k-th score. Only hits that
can still be in the result leave a shard.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, table, tune

SHARD = 16_384
CENTRES = 1024
LEAF, BLOCK = 256, 64
SCALE = 256


def _integers(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(id, v): components as floor(SCALE * x); rows with a null id or vector, or a bad component, go."""
    ids, vectors = [], []
    for i, x in zip(batch.column("id").to_pylist(), batch.column("embedding").to_pylist()):
        if i is None or x is None or any(y is None for y in x):
            continue
        v = np.floor(np.array(x, dtype=np.float64) * SCALE)
        if np.isfinite(v).all():
            ids.append(i)
            vectors.append(v.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())], ["id", "v"])


class BallTree:
    """Nodes hold a centre, a radius and a run of the reordered rows; a split is by the median on the widest axis."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(x))
        self.nodes: list[tuple[np.ndarray, float, int, int, int, int]] = []
        todo = [(0, len(x), -1, 0)]
        while todo:
            a, b, up, side = todo.pop()
            rows = x[order[a:b]]
            centre = rows.mean(axis=0)
            radius = float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max()))
            me = len(self.nodes)
            self.nodes.append((centre, radius, a, b, -1, -1))
            if up >= 0:
                n = self.nodes[up]
                self.nodes[up] = (*n[:4], me, n[5]) if side == 0 else (*n[:5], me)
            if b - a > leaf and radius > 0:
                axis = int(np.argmax(rows.var(axis=0)))
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argsort(rows[:, axis], kind="stable")]
                todo += [(a + half, b, me, 1), (a, a + half, me, 0)]
        self.x, self.ids = x[order], ids[order]
        self.top = float(np.abs(x).max()) if x.size else 0.0

    def search(self, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Best k (scores, ids) for each row of q among rows of other ids with a score of at least floor; id -1: none."""
        m = len(q)
        scores = np.full((m, k), -np.inf)
        ids = np.full((m, k), np.iinfo(np.int64).max)
        kth = floor.astype(np.float64).copy()
        norms = np.sqrt((q**2).sum(axis=1))
        exact = self.top * float(np.abs(q).max(initial=0)) * q.shape[1] < 2**53

        def bound(node: int) -> np.ndarray:
            centre, radius = self.nodes[node][:2]
            reach = norms * radius
            return q @ centre + reach + 1e-9 * (1 + np.abs(reach) + norms * np.sqrt((centre**2).sum()))

        first = bound(0)
        heap = [(-float(first.max()), 0)]
        bounds = {0: first}
        while heap:
            _, node = heapq.heappop(heap)
            live = np.flatnonzero(bounds.pop(node) >= kth)
            if not len(live):
                continue
            _, _, a, b, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    bounds[child] = bound(child)
                    heapq.heappush(heap, (-float(bounds[child].max()), child))
                continue
            if exact:
                s = q[live] @ self.x[a:b].T
            else:
                s = (q[live].astype(object) @ self.x[a:b].astype(object).T).astype(np.float64)
            s[own[live, None] == self.ids[None, a:b]] = -np.inf
            hit = (s >= kth[live, None]) & (s > -np.inf)
            for r in np.flatnonzero(hit.any(axis=1)):
                n, cols = live[r], np.flatnonzero(hit[r])
                all_s, all_i = np.concatenate((scores[n], s[r, cols])), np.concatenate((ids[n], self.ids[a:b][cols]))
                best = np.lexsort((all_i, -all_s))[:k]
                scores[n], ids[n] = all_s[best], all_i[best]
                kth[n] = max(kth[n], scores[n, k - 1])
        return scores, ids


def _shards(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = itertools.chain.from_iterable(b.to_pylist() for b in batches)
        for _, shard in itertools.groupby(rows, key=lambda r: r["shard"]):
            tree, own, vectors = None, [], []
            for is_query, part in itertools.groupby(shard, key=lambda r: r["query"] is not None):
                if not is_query:
                    for r in part:
                        own.append(r["id"])
                        vectors.append(np.frombuffer(r["v"], dtype=np.float64))
                    width = max(map(len, vectors))
                    x = np.array([np.pad(v, (0, width - len(v))) for v in vectors])
                    tree, own, vectors = BallTree(x, np.array(own)), [], []
                    continue
                if tree is None:
                    continue
                for block in iter(lambda p=part: list(itertools.islice(p, BLOCK)), []):
                    q = np.zeros((len(block), tree.x.shape[1]))
                    for n, r in enumerate(block):
                        v = np.frombuffer(r["v"], dtype=np.float64)[: q.shape[1]]
                        q[n, : len(v)] = v
                    floor = np.array([-np.inf if r["floor"] is None else float(r["floor"]) for r in block])
                    scores, ids = tree.search(q, np.array([r["id"] for r in block]), floor, k)
                    out = [(r["query"], r["id"], int(i), int(s)) for n, r in enumerate(block) for s, i in zip(scores[n], ids[n]) if s > -np.inf]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["query", "query_id", "vec_id", "score"])

    return run


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, padded with zeros."""
    out = np.zeros((len(column), width))
    for n, v in enumerate(column.to_pylist()):
        x = np.frombuffer(v, dtype=np.float64)[:width]
        out[n, : len(x)] = x
    return out


def _placed(centres: np.ndarray):
    """Each vector's nearest centre and how far it is."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch.column("v"), centres.shape[1])
        far = np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None, :], 0))
        near = far.argmin(axis=1)
        # by subtraction, as the difference of squares may be off by more than a bound can bear
        dist = np.sqrt(((x - centres[near]) ** 2).sum(axis=1))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(dist)], [*batch.schema.names, "cluster", "dist"])

    return run


def _reached(centres: np.ndarray, radius: np.ndarray):
    """The clusters that a query's best k may come from: its home alone without a floor, else all whose ball can beat it."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        q = _matrix(batch.column("v"), centres.shape[1])
        middle, reach = q @ centres.T, np.sqrt((q**2).sum(axis=1))[:, None] * radius[None, :]
        slack = 1e-9 * (1 + np.abs(reach) + np.sqrt((q**2).sum(axis=1))[:, None] * np.sqrt((centres**2).sum(axis=1))[None, :])
        floor = np.array([-np.inf if f is None else float(f) for f in batch.column("floor").to_pylist()])
        home = np.where(radius[None, :] >= 0, middle, -np.inf).argmax(axis=1)
        open_ = (radius[None, :] >= 0) & (middle + reach + slack >= floor[:, None])
        clusters = [np.flatnonzero(r).astype(np.int32) for r in open_]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array(clusters, pa.list_(pa.int32()))], [*batch.schema.names, "home", "clusters"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of vectors for each row of queries, by other ids.

    Components become floor(256 x); scores are exact integers (up to 2**53). Rows with a null id or
    vector, or a null or non-finite component, take no part. Vectors of different lengths count as padded
    with zeros. Repeated candidate rows each may appear; equal query rows count once. No candidates: no
    rows for that query.
    """
    tune(vectors.sparkSession)
    shape = [F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("embedding")]
    rows = table(arrow_map(vectors.select(*shape), _integers, "id long, v binary"), "vectors")
    asked = arrow_map(queries.select(*shape), _integers, "id long, v binary").withColumn("query", F.xxhash64("id", "v"))
    asked = table(asked.dropDuplicates(["query"]), "queries")
    total, width = rows.agg(F.count("*"), F.coalesce(F.max(F.length("v")), F.lit(0))).first()
    none = F.lit(None).cast("long")
    # the centres are a few of the rows, the least by hash; no more come to the driver, however many rows there are
    some = rows.orderBy(F.xxhash64("v", "id"), "id").limit(max(1, min(CENTRES, -(-total // SHARD)))).collect()
    centres = np.zeros((max(1, len(some)), max(1, width // 8)))
    for n, r in enumerate(some):
        x = np.frombuffer(r["v"], dtype=np.float64)
        centres[n, : len(x)] = x
    placed = table(arrow_map(rows, _placed(centres), "id long, v binary, cluster int, dist double"), "placed")
    radius, parts = np.full(len(centres), -1.0), [1] * len(centres)
    for r in placed.groupBy("cluster").agg(F.max("dist").alias("far"), F.count("*").alias("n")).collect():  # a row a centre
        radius[r["cluster"]], parts[r["cluster"]] = r["far"], max(1, -(-r["n"] // SHARD))
    offset = [0, *itertools.accumulate(parts)]
    shards = offset[-1]
    of = lambda numbers, cluster: F.element_at(F.array(*map(F.lit, numbers)), F.col(cluster) + 1)
    deal = lambda cluster, *key: (of(offset[:-1], cluster) + F.pmod(F.xxhash64(*key), of(parts, cluster).cast("long"))).cast("int")
    candidates = placed.select(deal("cluster", "id", "v").alias("shard"), none.alias("query"), "id", "v", none.alias("floor"))

    def reached(part: DataFrame) -> DataFrame:
        fields = "query long, id long, v binary, floor long, home int, clusters array<int>"
        return arrow_map(part.select("query", "id", "v", "floor"), _reached(centres, radius), fields).withColumn("first", deal("home", "query"))

    def ask(part: DataFrame) -> DataFrame:
        both = candidates.unionByName(part.select("shard", "query", "id", "v", "floor")).repartition(shards, "shard").sortWithinPartitions("shard", F.col("query").asc_nulls_first())
        return table(both.mapInArrow(_shards(k), "query long, query_id long, vec_id long, score long"), "hits")

    first = ask(reached(asked.withColumn("floor", none)).withColumn("shard", F.col("first")))
    if shards == 1:
        return _best(first, k).select("query_id", "rank", "vec_id", "score")
    floors = _best(first, k).groupBy("query").agg(F.min("score").alias("low"), F.count("*").alias("n"))
    floors = floors.select("query", F.when(F.col("n") == k, F.col("low")).alias("floor"))
    others = reached(asked.join(floors, "query", "left")).withColumn("cluster", F.explode("clusters"))
    others = others.withColumn("shard", F.explode(F.sequence(of(offset[:-1], "cluster"), of(offset[1:], "cluster") - 1))).where("shard <> first")
    second = ask(others)
    return _best(first.unionByName(second), k).select("query_id", "rank", "vec_id", "score")
