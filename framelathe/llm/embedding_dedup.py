"""Near-duplicate embeddings by hierarchical navigable small-world graphs.

Equal vectors of one label are one node.  Each label's nodes are dealt into
shards of bounded size with one graph each; every node queries every shard of
its label.  Searches advance in batches of numpy arrays.  A beam that is full of
links is widened.  Before a block of queries searches a shard, some of them and
as many vectors made to link with rows of the shard are audited against brute
force, and the beam is doubled until they reach the recall, at last by scanning
the shard.  Cosines are verified in double precision.  A block reports link
counts and a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, cut

#: Nodes in a shard, about; a label of many nodes has larger shards, up to eight times this, rather than more than 64.
SHARD = 8192
#: Queries that ask a shard together, about: the shard's graph, of some 600 bytes a node, travels once for so many.
BLOCK = 8192
DEGREE = 12
BUILD_BEAM = 20
QUERY_BEAM = 16
#: Queries that advance together.
BATCH = 256
AUDITED = 48
#: How far a cosine in single precision may be off, with room to spare.
SINGLE = 1e-5
RECALL = 0.99


class Graph:
    """A navigable small-world graph over the rows of ``x`` (unit vectors).  Searches compare in single precision."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM):
        self.x, self.degree, self.rough = x, degree, x.astype(np.float32)
        n = len(x)
        mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        u = ((mixed >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53
        level = np.minimum((-np.log(u) / np.log(degree)).astype(int), 6)
        order = np.argsort(mixed, kind="stable")
        top = int(level.max()) if n else 0
        self.links = [np.full((n, degree * (2 if k == 0 else 1)), -1, np.int32) for k in range(top + 1)]
        self.member = [level >= k for k in range(top + 1)]
        self.there = np.zeros(n, bool)
        self.entry = [-1] * (top + 1)  # where each layer is entered if the one above has nothing yet
        done = 0
        while done < n:
            size = min(max(done, 32), BATCH)
            self.insert(order[done : done + size], beam)
            done += size

    def insert(self, new: np.ndarray, beam: int) -> None:
        start = None
        for k in reversed(range(len(self.links))):
            own = new[self.member[k][new]]
            found = np.full((len(new), 0), -1)
            if self.entry[k] >= 0:
                begin = np.full((len(new), 1), self.entry[k]) if start is None else start
                found, _ = self.search(self.rough[new], k, begin, beam if k == 0 else 16)
                start = found
            if len(own):
                if self.entry[k] < 0:
                    self.entry[k] = int(own[0])
                near = self.rough[own] @ self.rough[own].T
                np.fill_diagonal(near, -2)
                peers = own[np.argsort(-near, axis=1, kind="stable")[:, : min(self.degree, len(own) - 1)]]
                cand = np.concatenate([found[self.member[k][new]], peers], axis=1)
                self.link(k, own, cand)
        self.there[new] = True

    def choose(self, base: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates (-1: none) the nearest that are nearer to the base than to one chosen
        before, filled up by the nearest of the rest."""
        ok = (cand >= 0) & (cand != base[:, None])
        sim = np.where(ok, np.einsum("bd,bcd->bc", self.rough[base], self.rough[cand]), np.float32(-3))
        order = np.argsort(-sim, axis=1, kind="stable")[:, : max(64, most)]
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        twin = np.zeros(cand.shape, bool)  # the same candidate twice
        by = np.argsort(cand, axis=1, kind="stable")
        ranked = np.take_along_axis(cand, by, 1)
        np.put_along_axis(twin, by[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
        sim = np.where(twin, -3.0, sim)
        v = self.rough[cand]
        between = v @ v.transpose(0, 2, 1)
        b, c = cand.shape
        chosen = np.zeros((b, c), bool)
        worst = np.full((b, c), -2.0)  # the largest similarity to one chosen so far
        for j in range(c):
            take = (sim[:, j] > -2) & (sim[:, j] > worst[:, j]) & (chosen.sum(1) < most)
            chosen[:, j] = take
            worst = np.where(take[:, None], np.maximum(worst, between[:, j]), worst)
        rank = np.where(chosen, sim + 10, sim)
        order = np.argsort(-rank, axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(sim, order, 1) > -2, np.take_along_axis(cand, order, 1), -1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def link(self, k: int, own: np.ndarray, cand: np.ndarray) -> None:
        width = self.links[k].shape[1]
        picked = self.choose(own, cand, self.degree)
        self.links[k][own, : self.degree] = picked
        a = np.repeat(own, self.degree)
        b = picked.ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        to, first, count = np.unique(b, return_index=True, return_counts=True)
        for i in range(0, len(to), BATCH):
            part, f, c = to[i : i + BATCH], first[i : i + BATCH], count[i : i + BATCH]
            col = np.arange(c.max())
            fresh = np.where(col < c[:, None], a[np.minimum(f[:, None] + col, len(a) - 1)], -1)
            old = self.links[k][part]
            fresh = np.where((fresh[:, :, None] == old[:, None, :]).any(2), -1, fresh)
            room = (old >= 0).sum(1) + (fresh >= 0).sum(1) <= width
            both = np.concatenate([old, fresh], axis=1)
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :width]
            self.links[k][part[room]] = packed[room]
            if (~room).any():
                self.links[k][part[~room]] = self.choose(part[~room], both[~room], width)

    def search(self, q: np.ndarray, k: int, begin: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of layer k: ids (-1: none) and similarities, best first, for each query."""
        n, rows, wide = len(self.x), np.arange(len(q)), max(6, beam // 6)  # opened in one step
        seen = np.zeros((len(q), n + 1), bool)
        seen[:, n] = True
        begin = np.where(begin >= 0, begin, n)
        ids = np.full((len(q), beam), n)
        sim = np.full((len(q), beam), -3, np.float32)
        opened = np.ones((len(q), beam), bool)

        def merge(rows, new):
            fresh = ~seen[rows[:, None], new]
            seen[rows[:, None], new] = True
            order = np.sort(np.where(fresh, new, n), axis=1)
            new = np.where(np.concatenate([np.zeros((len(rows), 1), bool), order[:, 1:] == order[:, :-1]], axis=1), n, order)
            got = np.full(new.shape, -3, np.float32)
            a, c = np.nonzero(new < n)
            got[a, c] = np.einsum("pd,pd->p", q[rows[a]], self.rough[new[a, c]])
            all_ids = np.concatenate([ids[rows], new], axis=1)
            all_sim = np.concatenate([sim[rows], got], axis=1)
            all_open = np.concatenate([opened[rows], new >= n], axis=1)
            top = np.argsort(-all_sim, axis=1, kind="stable")[:, :beam]
            ids[rows], sim[rows] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sim, top, 1)
            opened[rows] = np.take_along_axis(all_open, top, 1)

        merge(rows, begin)
        live = rows
        while len(live):
            todo = np.argsort(opened[live], axis=1, kind="stable")[:, :wide]  # the best that are not yet opened
            fresh = ~np.take_along_axis(opened[live], todo, 1)
            keep = fresh.any(1)
            live, todo, fresh = live[keep], todo[keep], fresh[keep]
            if not len(live):
                break
            at = np.where(fresh, ids[live[:, None], todo], n)
            opened[live[:, None], todo] = True
            near = np.where((at < n)[:, :, None], self.links[k][np.minimum(at, n - 1)], -1).reshape(len(live), -1)
            merge(live, np.where(near >= 0, near, n))
        return np.where(ids < n, ids, -1), sim

    def nearest(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        q, start = q.astype(np.float32), np.full((len(q), 1), self.entry[-1])
        for k in reversed(range(1, len(self.links))):
            start, _ = self.search(q, k, start, 16)
        return self.search(q, 0, start, beam)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; first scaled by their largest entry, so squares neither overflow nor vanish."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def near(graph: Graph, q: np.ndarray, least: float, beam: int, take) -> None:
    """Calls ``take(queries, rows, cosines)`` with pairs of cosine at least ``least``, as far as beams find them and
    some queries at a time; a beam full of links widens.  What single precision finds is verified in double."""
    n, about = len(graph.x), least - SINGLE
    rows = np.arange(len(q))
    while len(rows):
        again = []
        for i in range(0, len(rows), BATCH):
            part = rows[i : i + BATCH]
            ids, sim = graph.nearest(q[part], min(beam, n))
            full = (ids[:, -1] >= 0) & (sim[:, -1] >= about) & (beam < n)
            again.append(part[full])
            a, c = np.nonzero((ids >= 0) & (sim >= about) & ~full[:, None])
            a, b = part[a], ids[a, c]
            for k in range(0, len(a), 65_536):
                cosine = np.einsum("pd,pd->p", q[a[k : k + 65_536]], graph.x[b[k : k + 65_536]])
                true = np.flatnonzero(cosine >= least)
                take(a[true + k], b[true + k], cosine[true])
        rows, beam = np.concatenate(again), beam * 4


def scan(graph: Graph, q: np.ndarray, least: float, take) -> None:
    """The same pairs by comparing all."""
    for i in range(0, len(q), BATCH):
        sim = q[i : i + BATCH] @ graph.x.T
        a, b = np.nonzero(sim >= least)
        take(a + i, b, sim[a, b])


class Links:
    """What a block of queries found in a shard: linked rows counted by their multiplicity, and a spanning forest."""

    def __init__(self, node: np.ndarray, ids: np.ndarray, mult: np.ndarray):
        self.node, self.ids, self.mult = node, ids, mult
        self.count = np.zeros(len(node), np.int64)
        self.names, at = np.unique(np.concatenate([node, ids]), return_inverse=True)
        self.of_query, self.of_row = at[: len(node)], at[len(node) :]
        self.root = np.arange(len(self.names))
        self.a: list[int] = []
        self.b: list[int] = []

    def __call__(self, a: np.ndarray, b: np.ndarray, cosine: np.ndarray) -> None:
        other = self.node[a] != self.ids[b]
        a, b = a[other], b[other]
        self.count += np.bincount(a, weights=self.mult[b], minlength=len(self.node)).astype(np.int64)
        x, y = self.of_query[a], self.of_row[b]
        while len(x):  # links within a tree go, one link is taken for each pair of trees
            while (self.root != self.root[self.root]).any():
                self.root = self.root[self.root]
            rx, ry = self.root[x], self.root[y]
            apart = rx != ry
            x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
            _, one = np.unique(np.minimum(rx, ry) * len(self.root) + np.maximum(rx, ry), return_index=True)
            for k in one.tolist():
                i, j = max(rx[k], ry[k]), min(rx[k], ry[k])
                if self.root[i] == i and self.root[j] == j:
                    self.root[i] = j
                    self.a.append(int(self.names[x[k]]))
                    self.b.append(int(self.names[y[k]]))


def planted(graph: Graph, least: float, many: int = AUDITED) -> np.ndarray:
    """Unit vectors, each at a cosine from ``least`` to halfway to one of a row of the graph."""
    rng = np.random.default_rng(len(graph.x))
    row = graph.x[rng.integers(0, len(graph.x), many)]
    if row.shape[1] == 1:
        return row
    off = rng.normal(size=row.shape)
    off -= (off * row).sum(1, keepdims=True) * row
    off /= np.sqrt((off * off).sum(1, keepdims=True)) + 1e-300
    c = least + (1 - least) * rng.uniform(1e-6, 0.5, (many, 1))
    return c * row + np.sqrt(1 - c * c) * off


def audited(graph: Graph, q: np.ndarray, least: float, beam: int = QUERY_BEAM, recall: float = RECALL) -> tuple[int, int, int]:
    """The beam with which planted vectors and evenly spaced queries reach the recall against brute force, 0 for a scan,
    and how many links they have and found.  A query's link with itself doesn't count, so neither can hide the other."""
    sample = np.unique(np.linspace(0, len(q) - 1, min(len(q), AUDITED)).astype(int))
    asks = np.concatenate([planted(graph, least), q[sample]])
    found = np.zeros(2, np.int64)

    def take(a, b, cosine):
        own = a[cosine < 1 - 1e-12] < AUDITED
        found[:] += own.sum(), (~own).sum()

    scan(graph, asks, least, take)
    true, beam = found.copy(), max(1, beam)
    while True:
        found[:] = 0
        near(graph, asks, least, beam, take)
        if (found >= recall * true).all():
            return beam, int(true.sum()), int(found.sum())
        if beam >= len(graph.x):
            return 0, int(true.sum()), int(true.sum())
        beam *= 2


def table_of(batch: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes in order, their multiplicities and unit vectors."""
    node, m = batch.column("node").to_numpy(), batch.column("m").to_numpy()
    v = batch.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)
    order = np.argsort(node, kind="stable")
    return node[order], m[order], unit(v[order])


def usable_rows(vectors: DataFrame) -> DataFrame:
    """``vec_id, vec, label, ok``: vectors in double precision, and whether they can link."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("string").alias("label"))
    inf = F.lit(float("inf"))
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()
        & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == inf)) & F.exists("vec", lambda v: v != 0)
    )
    return rows.withColumn("ok", F.coalesce(usable, F.lit(False)))


def search(rows: DataFrame, *, least: float = 0.93, shard: int = SHARD, block: int = BLOCK, beam: int = QUERY_BEAM, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Nodes ``label, vec, node, m, dim``, and what the searches found, ``kind, a, b, n``.

    Kind ``count``: node a has n links with rows in one shard; ``link``: a and b
    link; ``audit``: audits of a block had a true links, found b of them, with
    beam n (0: by a scan).
    """
    nodes = rows.filter("ok").groupBy("label", "vec").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("m")).withColumn("dim", F.size("vec"))
    nodes = cut(nodes, "vectors")
    many = F.count(F.lit(1))
    held = F.greatest(F.lit(shard), F.least(F.lit(8 * shard), F.ceil(many / 64)))
    sizes = nodes.groupBy("label", "dim").agg(F.ceil(many / held).cast("int").alias("shards"), F.ceil(many / F.lit(block)).cast("int").alias("blocks"))
    dealt = nodes.join(sizes, ["label", "dim"]).withColumns({
        "shard": F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"), "block": F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"),
    })

    def build(key, batch):
        node, m, x = table_of(batch)
        graph = Graph(node, x)
        raw = pickle.dumps((node, m, vars(graph) | {"rough": None}), protocol=5)  # numpy arrays only
        label, dim, shard = (k.as_py() for k in key)
        return pa.table({"label": [label], "dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "blocks": pa.array([batch.column("blocks")[0].as_py()], pa.int32()), "graph": pa.array([raw], pa.binary())})

    graphs = cut(
        dealt.groupBy("label", "dim", "shard").applyInArrow(build, "label string, dim int, shard int, blocks int, graph binary"), "graphs"
    )
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = dealt.select("label", "dim", "block", each("shards").alias("shard"), "node", "m", "vec")
    index = graphs.select("label", "dim", "shard", each("blocks").alias("block"), "graph")
    keys = ["label", "dim", "shard", "block"]
    schema = pa.schema([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def query(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return schema.empty_table()
        ids, mult, state = pickle.loads(left.column("graph")[0].as_py())
        graph = Graph.__new__(Graph)
        vars(graph).update(state, rough=state["x"].astype(np.float32))
        node, _, x = table_of(right)
        used, true, hit = audited(graph, x, least, beam, recall)
        got = Links(node, ids, mult)
        if used:
            near(graph, x, least, used, got)
        else:
            scan(graph, x, least, got)
        some = np.flatnonzero(got.count)
        a = np.concatenate([node[some], np.array(got.a, np.int64), [true]])
        b = np.concatenate([np.zeros(len(some), np.int64), np.array(got.b, np.int64), [hit]])
        n = np.concatenate([got.count[some], np.zeros(len(got.a), np.int64), [used]])
        return pa.table([pa.array(["count"] * len(some) + ["link"] * len(got.a) + ["audit"]), pa.array(a), pa.array(b), pa.array(n)], schema=schema)

    found = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(query, "kind string, a long, b long, n long")
    return nodes, cut(found, "links")


def embedding_dedup(vectors: DataFrame, **how) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``.

    Vectors link at a cosine of ``least`` or more if their labels are equal and
    not null.  Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing, nor do rows with a null vec_id or label or
    vectors of unlike lengths.  ``n_links`` counts other rows linked directly,
    repeated rows too; ``component_id`` is the smallest vec_id reachable.  Other
    columns are not looked at.  Empty table: empty.  ``how``: see ``search``.
    """
    rows = usable_rows(vectors)
    nodes, found = search(rows, **how)
    comp = components(found.filter("kind = 'link'").select("a", "b"))
    counts = found.filter("kind = 'count'").groupBy("a").agg(F.sum("n").alias("n"))
    of = nodes.join(comp.select(F.col("node").alias("_n"), "component"), F.col("node") == F.col("_n"), "left")
    of = of.join(counts, F.col("node") == F.col("a"), "left").filter("m > 1 or component is not null")
    of = of.select(
        F.col("label").alias("_label"), F.col("vec").alias("_vec"), F.xxhash64("label", "vec").alias("_key"),
        F.coalesce("component", "node").alias("_component"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("_links"),
    )
    on = (F.xxhash64("label", "vec") == F.col("_key")) & F.col("ok") & (F.col("label") == F.col("_label")) & (F.col("vec") == F.col("_vec"))
    out = rows.join(of, on, "left")
    component = F.coalesce("_component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def op2_query(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
ok AS MATERIALIZED (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
    AND len([x FOR x IN e IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0
), link AS (
  SELECT a.k, a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.k <> b.k
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.93 ELSE false END
), n AS (SELECT k, count(*) AS n FROM link GROUP BY k),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
c AS (SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, m) AS component_id FROM v LEFT JOIN n USING (k) LEFT JOIN comp ON a = vec_id)
SELECT *, coalesce(vec_id = component_id, true) AS kept FROM c
"""
