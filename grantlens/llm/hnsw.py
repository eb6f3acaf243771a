"""Near-duplicate vectors by hierarchical navigable small-world graphs, one for each shard.

Equal vectors are one class with a count first. Classes are dealt to shards by id; a shard builds its graph (levels fall off
geometrically, neighbours are chosen by the diversity rule, each list is bounded) and every class queries every shard.
Searches run for blocks of queries at once. The beam of a query is widened until its worst entry is below the threshold, so
a large group of near copies is found whole; and the first block audits recall against brute force on the shard: while the mean
recall of queries with links is below AUDIT_RECALL, the least beam doubles, at most up to the shard itself. Found pairs are verified by cosine in double
precision. A query's links are counted where they are found; for components each block hands on a spanning forest of the links
it found, not the pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
component; vectors of unequal dimension are filled up with zeros; repeated vec_ids are separate rows in one class if equal;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, mix, read, with_components
from .shards import shard_count, visit, whole

THRESHOLD = 0.95
#: Rows of a shard. Every query visits every shard, and a visit grows with the logarithm of the shard: few large shards are less work.
LEAST_ROWS, MOST_ROWS = 32768, 65536
NEIGHBOURS = 12
BUILD_BEAM = 48
LEAST_BEAM = 32
AUDIT_QUERIES = 64
AUDIT_RECALL = 0.99


class Graph:
    """Layers of bounded neighbour lists over unit vectors; -1 marks an empty place."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.x = x.astype(np.float32)
        n = len(ids)
        u = (mix(ids.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2.0**53
        level = np.minimum(np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(NEIGHBOURS)).astype(int), 6)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # members, neighbours as places in members
        top = int(level.max())
        while top and (level >= top).sum() < 2:
            top -= 1
        self.entries: np.ndarray | None = None
        for lay in range(top, -1, -1):
            members = np.flatnonzero(level >= lay)
            width = NEIGHBOURS * (2 if lay == 0 else 1)
            self.layers.append((members, self._build(members, width)))

    def _build(self, members: np.ndarray, width: int) -> np.ndarray:
        """Insert members in batches, each no larger than what is there, and at most 256."""
        x = self.x[members]
        n = len(members)
        near = np.full((n, width), -1, np.int32)
        first = min(n, 2 * width)
        sims = x[:first] @ x[:first].T
        np.fill_diagonal(sims, -np.inf)
        order = np.argsort(-sims, 1)[:, : max(0, first - 1)]
        near[:first] = self._diverse(x, np.arange(first), order, width)
        at = first
        while at < n:
            new = np.arange(at, min(n, at + min(at, 256)))
            found, _ = self._search(x, near, x[new], self._starts(at, len(new)), BUILD_BEAM, None)
            among = x[new] @ x[new].T
            np.fill_diagonal(among, -np.inf)
            peers = new[np.argsort(-among, 1)[:, : min(16, len(new) - 1)]] if len(new) > 1 else np.zeros((1, 0), int)
            cand = np.hstack((found, peers))
            cand = self._sorted(x, new, cand)
            near[new] = chosen = self._diverse(x, new, cand, width)
            self._link_back(x, near, new, chosen, width)
            at = int(new[-1]) + 1
        return self._adopt(x, near)

    @staticmethod
    def _adopt(x: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Bounded lists can leave places that nothing leads to; a near place that is reached gets a further link to each."""
        n = len(x)
        reached = np.zeros(n, bool)

        def spread(front: np.ndarray) -> None:
            while len(front):
                reached[front] = True
                front = np.unique(near[front])
                front = front[(front >= 0) & ~reached[np.maximum(front, 0)]]

        spread(np.linspace(0, n - 1, min(n, 8)).astype(int))
        more: dict[int, list[int]] = {}
        while not reached.all():
            node = int(np.argmin(reached))
            there = np.flatnonzero(reached)
            parent = int(there[np.argmax(x[there] @ x[node])])
            more.setdefault(parent, []).append(node)
            spread(np.array([node]))
        if more:
            extra = np.full((n, max(map(len, more.values()))), -1, np.int32)
            for parent, nodes in more.items():
                extra[parent, : len(nodes)] = nodes
            near = np.hstack((near, extra))
        return near

    def _starts(self, n: int, b: int) -> np.ndarray:
        """A few spread places to start from while a layer grows."""
        return np.tile(np.linspace(0, n - 1, min(n, 8)).astype(int), (b, 1))

    @staticmethod
    def _sorted(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray) -> np.ndarray:
        sims = np.einsum("bd,bkd->bk", x[nodes], x[np.maximum(cand, 0)])
        sims[(cand < 0) | (cand == nodes[:, None])] = -np.inf
        order = np.argsort(-sims, 1)
        out = np.take_along_axis(cand, order, 1)
        out[np.take_along_axis(sims, order, 1) == -np.inf] = -1
        return out

    @staticmethod
    def _diverse(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, width: int) -> np.ndarray:
        """From candidates by falling similarity, those nearer to the node than to any chosen before; then the nearest others."""
        out = np.full((len(nodes), width), -1, np.int32)
        for a in range(0, len(nodes), 64):
            c = cand[a : a + 64, : 4 * width]
            b, k = c.shape
            if not k:
                continue
            v = x[np.maximum(c, 0)]
            to_node = np.einsum("bd,bkd->bk", x[nodes[a : a + 64]], v)
            between = v @ v.transpose(0, 2, 1)
            took = np.zeros((b, k), bool)
            nearest = np.full((b, k), -np.inf, np.float32)  # of each candidate to the chosen ones
            repeat = np.zeros((b, k), bool)
            for j in range(k):
                repeat[:, j] = ((c[:, :j] == c[:, j : j + 1]).any(1)) | (c[:, j] < 0)
                take = ~repeat[:, j] & (to_node[:, j] > nearest[:, j]) & (took.sum(1) < width)
                took[:, j] = take
                nearest = np.where(take[:, None], np.maximum(nearest, between[:, j]), nearest)
            rank = np.where(took, 0, np.where(repeat, 2, 1)) * k + np.arange(k)
            order = np.argsort(rank, 1)[:, :width]
            picked = np.take_along_axis(c, order, 1)
            picked[np.take_along_axis(rank, order, 1) >= 2 * k] = -1
            out[a : a + 64, : picked.shape[1]] = picked
        return out

    def _link_back(self, x: np.ndarray, near: np.ndarray, new: np.ndarray, chosen: np.ndarray, width: int) -> None:
        src = np.repeat(new, width)
        dst = chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, start, count = np.unique(dst, return_index=True, return_counts=True)
        most = int(count.max(initial=0))
        more = np.full((len(nodes), most), -1, np.int64)
        place = np.arange(len(dst)) - np.repeat(start, count)
        more[np.repeat(np.arange(len(nodes)), count), place] = src
        used = (near[nodes] >= 0).sum(1)
        easy = used + count <= width
        for node, u, m in zip(nodes[easy], used[easy], more[easy], strict=True):
            m = m[m >= 0]
            near[node, u : u + len(m)] = m
        hard = np.flatnonzero(~easy)
        if len(hard):
            cand = self._sorted(x, nodes[hard], np.hstack((near[nodes[hard]], more[hard])))
            near[nodes[hard]] = self._diverse(x, nodes[hard], cand, width)

    @staticmethod
    def _search(x: np.ndarray, near: np.ndarray, q: np.ndarray, starts: np.ndarray, beam: int, full: float | None) -> tuple[np.ndarray, np.ndarray]:
        """Best `beam` places and similarities for each query, by falling similarity; best-first, four expansions a step."""
        b, n = len(q), len(x)
        beam = min(beam, n)
        seen = np.zeros((b, n), bool)
        who = np.arange(b)[:, None]
        ids = np.full((b, beam), -1, np.int64)
        sims = np.full((b, beam), -np.inf, np.float32)
        open_ = np.zeros((b, beam), bool)
        fresh, live = starts, np.arange(b)
        step = 4
        while len(live):
            # drop what is seen or doubled
            f = fresh.astype(np.int64)
            f = np.sort(f, 1)
            bad = (f < 0) | np.hstack((np.zeros((len(f), 1), bool), f[:, 1:] == f[:, :-1])) | seen[live[:, None], np.maximum(f, 0)]
            s = np.einsum("bd,bkd->bk", q[live], x[np.maximum(f, 0)])
            s[bad] = -np.inf
            seen[np.broadcast_to(live[:, None], f.shape)[~bad], f[~bad]] = True
            allids = np.hstack((ids[live], f))
            allsims = np.hstack((sims[live], s))
            allopen = np.hstack((open_[live], ~bad))
            order = np.argsort(-allsims, 1, kind="stable")[:, :beam]
            ids[live] = np.take_along_axis(allids, order, 1)
            sims[live] = np.take_along_axis(allsims, order, 1)
            open_[live] = np.take_along_axis(allopen, order, 1) & (sims[live] > -np.inf)
            o = open_[live]
            live = live[o.any(1)]
            if not len(live):
                break
            o = open_[live]
            turn = np.cumsum(o, 1)
            take = o & (turn <= step)
            cols = np.argsort(~take, 1, kind="stable")[:, :step]
            valid = np.take_along_axis(take, cols, 1)
            rows = live[:, None]
            node = np.where(valid, ids[rows, cols], 0)
            open_[live] = o & ~take
            fresh = np.where(valid[:, :, None], near[node], -1).reshape(len(live), -1)
        ids[sims == -np.inf] = -1
        return ids, sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Down the layers with a narrow beam, then the wide one at the bottom."""
        starts = None
        for depth, (members, near) in enumerate(self.layers):
            x = self.x if len(members) == len(self.x) else self.x[members]
            if starts is None:
                at = np.tile(np.linspace(0, len(members) - 1, min(len(members), 8)).astype(int), (len(q), 1))
            else:
                at = np.where(starts >= 0, np.searchsorted(members, np.maximum(starts, 0)), -1)
            last = depth == len(self.layers) - 1
            found, sims = self._search(x, near, q, at, beam if last else 4, None)
            starts = np.where(found >= 0, members[np.maximum(found, 0)], -1)
        return starts, sims


class Shard:
    def __init__(self, ids: np.ndarray, x: np.ndarray, counts: np.ndarray, threshold: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.counts, self.threshold = ids[order], counts[order], threshold
        self.x = _unit(x[order])
        self.graph = Graph(self.ids, self.x)
        self.beam, self.audited = LEAST_BEAM, False

    def links(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query row, shard row) of verified links; beams widen until their worst entry is below the threshold."""
        rows, hits = [], []
        todo, beam = np.arange(len(q)), min(self.beam, len(self.ids))
        while len(todo):
            q32 = q[todo].astype(np.float32)
            again = []
            step = max(1, (1 << 22) // max(len(self.ids), 64 * beam))
            for a in range(0, len(todo), step):
                found, sims = self.graph.search(q32[a : a + step], beam)
                near = (sims >= self.threshold - 1e-3) & (found >= 0)
                short = near[:, -1] & (beam < len(self.ids)) if near.shape[1] else np.zeros(len(found), bool)
                again.append(todo[a : a + step][short])
                r, c = np.nonzero(near & ~short[:, None])
                rows.append(todo[a : a + step][r])
                hits.append(found[r, c])
            todo, beam = np.concatenate(again), min(len(self.ids), beam * 4)
        r, h = np.concatenate(rows), np.concatenate(hits)
        exact = np.concatenate([np.einsum("bd,bd->b", q[r[a : a + 65536]], self.x[h[a : a + 65536]]) for a in range(0, len(r), 65536)]) if len(r) else np.zeros(0)
        keep = exact >= self.threshold
        return r[keep], h[keep]

    def audit(self, q: np.ndarray) -> None:
        """Widen the least beam until the mean recall of audit queries that have links is AUDIT_RECALL.

        Links of a vector with itself do not count. Queries are rows of the shard that have a link, and vectors of the first block.
        """
        probe = np.concatenate((q[:AUDIT_QUERIES], self.x[:: max(1, len(self.x) // AUDIT_QUERIES)][:AUDIT_QUERIES], self.x[self.graph_neighbours()]))
        near = probe @ self.x.T
        true = (near >= self.threshold) & (near < 1 - 1e-12)  # equal vectors are one class, so cosine 1 is the probe itself or a multiple
        probe, true = probe[true.any(1)], true[true.any(1)]
        while len(probe) and self.beam < len(self.ids):
            r, h = self.links(probe)
            found = np.bincount(r, true[r, h], minlength=len(probe)) / true.sum(1)
            if found.mean() >= AUDIT_RECALL:
                break
            self.beam *= 2

    def graph_neighbours(self) -> np.ndarray:
        """Up to AUDIT_QUERIES rows that the graph says have a link: strided rows are searched with the least beam."""
        rows = np.arange(0, len(self.x), max(1, len(self.x) // (16 * AUDIT_QUERIES)))
        r, h = self.links(self.x[rows])
        return np.unique(rows[r[h != rows[r]]])[:AUDIT_QUERIES]

    def __call__(self, qid: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        q = _unit(np.pad(q, ((0, 0), (0, max(0, self.x.shape[1] - q.shape[1]))))[:, : max(self.x.shape[1], q.shape[1])])
        if q.shape[1] > self.x.shape[1]:
            # the surplus dimensions are zero in this shard
            q = q[:, : self.x.shape[1]]
        if not self.audited:
            self.audit(q)
            self.audited = True
        r, h = self.links(q)
        other = self.ids[h] != qid[r]
        r, h = r[other], h[other]
        n = np.bincount(r, weights=self.counts[h], minlength=len(qid)).astype(np.int64)
        # a spanning forest of this block: each query with the first of its links, that link with the others
        order = np.lexsort((h, r))
        r, h = r[order], h[order]
        head = np.concatenate(([True], r[1:] != r[:-1])) if len(r) else np.zeros(0, bool)
        lead = h[np.flatnonzero(head)][np.cumsum(head) - 1] if len(r) else h
        pairs = np.unique(np.stack((self.ids[h], self.ids[lead]), 1), axis=0) if len(r) else np.zeros((0, 2), np.int64)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        linked = np.flatnonzero(n)
        a = np.concatenate((qid[linked], pairs[:, 0]))
        b = np.concatenate((self.ids[h[head]], pairs[:, 1])) if len(r) else np.zeros(0, np.int64)
        count = np.concatenate((n[linked], np.zeros(len(pairs), np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(count, pa.int64())], names=["a", "b", "links"])


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)
    x = x / np.where(top > 0, top, 1)  # before squaring: lengths neither overflow nor vanish
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def near_duplicates(vectors: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for vectors (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    fit = whole(F.col("v")) & F.exists("v", lambda x: x != 0)
    classes = scratch.save(rows.where(fit).groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "classes")
    shards = shard_count(classes, classes.count(), LEAST_ROWS, MOST_ROWS)
    found = visit(classes, classes.select("id", "v", "n"), shards, lambda ids, x, n: Shard(ids, x, n, threshold), "a long, b long, links long")
    found = scratch.save(found, "links")
    labels = components(scratch, found.select("a", "b"), "components")
    links = found.where("links > 0").groupBy("a").agg(F.sum("links").alias("links"))
    per_class = with_components(classes.join(links.withColumnRenamed("a", "id"), "id", "left"), "id", labels)
    per_class = per_class.select("v", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    linked = rows.where(fit).join(per_class, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and keep flag of every vector."""
    return near_duplicates(read(spark, sf_dir, "embeddings"), Scratch(spark, "hnsw"))
