"""SimHash near-duplicates joined by the generalised pigeonhole principle.

Every document becomes a fingerprint of word shingles: 64 bits, or several such
lanes.  Bits are grouped into disjoint partitions, correlated bits together; for
every fingerprint a dynamic program gives each partition its own threshold (-1:
the partition is not probed) so that they sum to ``tau - parts + 1`` and the
estimated number of candidates is smallest.  A pair within ``tau`` bits then
agrees with one of the two within the threshold of some partition, so nothing
within ``tau`` is missed.  Links that may differ in more bits are found by the
same partitions with a stated probability (``reach``).

Documents with one fingerprint are one node.  Probes and index entries travel
packed and meet in buckets of bounded size (hot partition values are split over
a grid of cells); a bucket emits a spanning forest of its verified links, never
all its pairs.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import balanced, components, cut, hex64

SEED = 42
#: Rows that a bucket of the join should hold.
BUCKET_ROWS = 24_000
#: Index entries of one key that meet its probes in one cell; a larger key is split over a grid of cells.
CELL_ROWS = 24_000
#: Counters of the broadcast histogram over all partitions, about: its size bound is four bytes for each.
COUNTERS = 1 << 18
#: Share of the pairs at the limit of similarity that must be found.
RECALL = 0.99
#: Runs of one key beyond this length are compared in blocks.
LONG_RUN = 256
#: What a probe or index row costs, in comparisons of two fingerprints: time, and room on disk.
ROW_COST = 20_000


def shingle_hashes(text: bytes | None, k: int) -> np.ndarray:
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > k:
        starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hash_ = xxhash.xxh64_intdigest
    return np.fromiter((hash_(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def lane(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent 64-bit hash derived from h; lane 0 is h."""
    if not k:
        return h
    z = h + np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority(h: np.ndarray) -> int:
    """Bits set in more than half of the hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 60_000):
        part = h[i : i + 60_000].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(0, dtype=np.uint16)
    return int.from_bytes(np.packbits(total * 2 > len(h)).tobytes(), "big") if len(h) else 0


def fingerprints(docs: DataFrame, shingle: int, lanes: int = 1, distinct: bool = False) -> DataFrame:
    """``doc_id, mark, fp, n_shingles, ext``: fp the 64-bit fingerprint as a long, ext the further lanes (binary),
    mark a hash of the text that tells rows of one doc_id apart.

    Null and empty texts have no shingle: fingerprint zero.  ``distinct``: each
    shingle counts once, as it does for a set.
    """

    def run(batches):
        for b in batches:
            fps, ns, exts = [], [], []
            for t in pc.cast(b.column(2), pa.binary()).to_pylist():
                h = shingle_hashes(t, shingle)
                h = np.unique(h) if distinct else h
                fps.append(majority(h))
                ns.append(len(h))
                exts.append(b"".join(majority(lane(h, k)).to_bytes(8, "little") for k in range(1, lanes)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(ns, pa.int64()), pa.array(exts, pa.binary())],
                names=["doc_id", "mark", "fp", "n_shingles", "ext"],
            )

    text = F.col("text").cast("string")
    return balanced(docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("mark"), text.alias("text"))).mapInArrow(
        run, "doc_id long, mark long, fp long, n_shingles long, ext binary"
    )


def all_lanes(fp, ext, lanes: int) -> np.ndarray:
    """Fingerprints of the rows of two Arrow columns as a matrix of unsigned lanes."""
    out = np.empty((len(fp), lanes), np.uint64)
    out[:, 0] = fp.to_numpy(zero_copy_only=False).view(np.uint64)
    if lanes > 1:
        out[:, 1:] = np.frombuffer(b"".join(ext.to_pylist()), "<u8").reshape(len(fp), lanes - 1)
    return out


def bit_moments(nodes: DataFrame, lanes: int = 1) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each lane, the 64 x 64 counts of bits set together (bounded: 4096 sums a lane)."""
    size = lanes * 4096

    def run(batches):
        n, m = 0, np.zeros((lanes, 64, 64))
        for b in batches:
            v = all_lanes(b.column(0), b.column(1), lanes)
            for k in range(lanes):
                x = np.unpackbits(v[:, k].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
                m[k] += x.T @ x
            n += len(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(np.append(m.ravel(), n))], names=["k", "n"])

    part = nodes.select("fp", "ext").mapInArrow(run, "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(size + 1)
    total[part["k"].to_numpy(int)] = part["n"].to_numpy()
    return int(total[size]), total[:size].reshape(lanes, 64, 64)


def grouped_bits(n: int, together: np.ndarray, parts: int, width: int) -> list[list[int]]:
    """``parts`` disjoint groups of ``width`` bits; each starts at a free bit and takes the most correlated ones."""
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    free, out = set(range(64)), []
    for _ in range(parts):
        first = max(free, key=lambda i: (p[i] * (1 - p[i]), -i))
        group = [first]
        free.remove(first)
        while len(group) < width:
            best = max(free, key=lambda i: (corr[i, group].mean(), -i))
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def ball(width: int, radius: int) -> int:
    return sum(math.comb(width, k) for k in range(radius + 1)) if radius >= 0 else 0


def shape(n: int, tau: int) -> tuple[int, int]:
    """Number and width of the partitions of 64 bits, by the cost of probes and of expected candidates for n nodes."""
    best = (math.inf, 0, 0)
    for parts in range(2 if tau else 1, tau + 2):
        for width in range(4, min(21, 64 // parts) + 1):
            base, more = divmod(tau - parts + 1, parts)
            if base + (more > 0) > radius(width, tau):
                continue
            probes = sum(ball(width, base + (i < more)) for i in range(parts))
            best = min(best, (ROW_COST * (probes + parts) + probes * n / 2**width, parts, width))
    return best[1:]


def reach(n: int, lanes: int, differing: float, recall: float) -> tuple[int, int, int]:
    """Number and width of the partitions, and what their thresholds sum to, so that a pair whose bits differ with
    this probability is found with this one; of all such shapes the cheapest for n nodes."""
    best = (math.inf, 0, 0, 0)
    for width in range(8, 33):
        zero = (1 - differing) ** width
        one = zero + width * differing * (1 - differing) ** (width - 1)
        for parts in range(1, lanes * (64 // width) + 1):
            wide = next((e for e in range(parts + 1) if (1 - zero) ** (parts - e) * (1 - one) ** e <= 1 - recall), None)
            if wide is not None:
                rows = parts + wide * width
                best = min(best, (ROW_COST * rows + rows * n / 2**width, parts, width, wide))
    if best[0] == math.inf:
        raise ValueError("too few lanes for this recall")
    return best[1:]


def radius(width: int, tau: int) -> int:
    """Largest threshold that a partition may get."""
    return min(tau, width, 3 if width > 12 else width)


def gathered(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.int64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def sketch_bits(parts: int) -> int:
    """Bits that tell the counters of one partition apart."""
    return min(16, int(math.log2(COUNTERS // parts)))


def sketch_cell(v: np.ndarray, bits: int = 16) -> np.ndarray:
    mixed = (v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    return mixed.astype(np.int64)


def thresholds(values: np.ndarray, masks: list[list[np.ndarray]], hist: np.ndarray, tau: int, width: int) -> np.ndarray:
    """Per row and partition the threshold from -1 up, summing to tau - parts + 1, with the least estimated cost."""
    n, parts = values.shape
    bits = int(math.log2(hist.shape[1]))
    cells = 2.0 ** max(0, width - bits)
    top = len(masks[0]) - 1
    cost = np.zeros((top + 2, n, parts))
    for i in range(parts):
        run = np.zeros(n)
        for t, flips in enumerate(masks[i]):
            for f in flips:
                run += hist[i][sketch_cell(values[:, i] ^ f, bits)] / cells
            cost[t + 1, :, i] = run + ROW_COST * ball(width, t)
    budget = tau + 1  # thresholds + 1, summed
    total = np.full((n, budget + 1), np.inf)
    total[:, 0] = 0
    took = np.zeros((parts, n, budget + 1), np.int8)
    for i in range(parts):
        new = np.full((n, budget + 1), np.inf)
        for t in range(min(top + 1, budget) + 1):
            cand = total[:, : budget + 1 - t] + cost[t, :, i][:, None]
            better = cand < new[:, t:]
            new[:, t:][better] = cand[better]
            took[i][:, t:][better] = t
        total = new
    out = np.zeros((n, parts), np.int64)
    left = np.full(n, budget)
    for i in reversed(range(parts)):
        t = took[i][np.arange(n), left]
        out[:, i] = t - 1
        left -= t
    return out


class Forest:
    """Trees over nodes 0..n-1, and the links that made them."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []

    def roots(self, x: np.ndarray) -> np.ndarray:
        while (self.root != self.root[self.root]).any():
            self.root = self.root[self.root]
        return self.root[x]

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """Take the links x-y that join two trees."""
        while len(x):
            rx, ry = self.roots(x), self.roots(y)
            apart = rx != ry
            x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
            high, one = np.unique(np.maximum(rx, ry), return_index=True)
            self.root[high] = np.minimum(rx, ry)[one]
            self.a.append(x[one])
            self.b.append(y[one])

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *self.a]), np.concatenate([none, *self.b])


def entry_type(lanes: int) -> np.dtype:
    """A packed index entry (kind 0, or 1 if its partition is probed too) or probe (kind 2)."""
    return np.dtype([("key", "<u8"), ("node", "<i8"), ("n", "<u4"), ("kind", "u1"), ("bits", "<u8", (lanes,))])


class Bucket:
    """Entries that meet, in order of their keys, index entries before probes."""

    def __init__(self, e: np.ndarray, rule):
        e = e[np.lexsort((e["kind"] == 2, e["key"]))]
        self.rule = rule
        self.key, self.kind, self.n = e["key"].copy(), e["kind"].copy(), e["n"].astype(np.float64)
        self.lanes = [e["bits"][:, k].copy() for k in range(e["bits"].shape[1])]
        self.names, self.of = np.unique(e["node"], return_inverse=True)
        self.forest = Forest(len(self.names))

    def linked(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs (broadcast) of entries that link."""
        tau, ext_tau, ratio = self.rule
        where = np.nonzero(np.bitwise_count(self.lanes[0][p] ^ self.lanes[0][q]) <= tau)
        p, q = np.broadcast_to(p, np.broadcast_shapes(p.shape, q.shape))[where], np.broadcast_to(q, np.broadcast_shapes(p.shape, q.shape))[where]
        good = self.of[p] != self.of[q]
        if ratio is not None:
            good &= np.minimum(self.n[p], self.n[q]) >= ratio * np.maximum(self.n[p], self.n[q])
        p, q = p[good], q[good]
        if ext_tau is not None:
            d = np.zeros(len(p), np.int64)
            for x in self.lanes:
                d += np.bitwise_count(x[p] ^ x[q])
            p, q = p[d <= ext_tau], q[d <= ext_tau]
        return p, q

    def take(self, p: np.ndarray, q: np.ndarray) -> None:
        p, q = self.linked(p, q)
        self.forest.add(self.of[p], self.of[q])

    def search(self) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the links between entries of one key, of which one at least is probed with."""
        first = np.flatnonzero(np.concatenate(([True], self.key[1:] != self.key[:-1]))) if len(self.key) else np.zeros(0, np.int64)
        end = np.append(first[1:], len(self.key))
        counted = np.concatenate(([0], np.cumsum(self.kind < 2)))
        index = first + counted[end] - counted[first]  # end of the index entries
        asked = np.concatenate(([0], np.cumsum(self.kind > 0)))
        of_use = (index > first) & (end - first > 1) & (asked[end] > asked[first])
        first, index, end = first[of_use], index[of_use], end[of_use]
        long = end - first > LONG_RUN
        size = (end - first)[~long]
        run = np.repeat(np.flatnonzero(~long), size)
        row = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[run]
        probe = self.kind[row] == 2
        low = np.where(probe, first[run], row + 1)
        many = index[run] - low
        total = np.cumsum(many)
        at = 0
        while at < len(row):  # some millions of pairs at a time
            upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 2_000_000)))
            m = many[at:upto]
            p = np.repeat(row[at:upto], m)
            q = np.arange(len(p)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[at:upto], m)
            valid = (self.kind[p] | self.kind[q]) > 0
            self.take(p[valid], q[valid])
            at = upto
        for f, i, e in zip(first[long].tolist(), index[long].tolist(), end[long].tolist()):
            self.long_run(f, i, e)
        a, b = self.forest.links()
        return self.names[a], self.names[b]

    def long_run(self, first: int, index: int, end: int) -> None:
        """Blocks of bounded size; some entries are compared with all first, and what these join needs no comparison."""
        rows = np.arange(first, end)
        for k in np.unique(np.linspace(first, index - 1, 8).astype(int)):
            self.take(np.array([k]), rows)
        root = self.forest.roots(self.of[rows])
        rows = rows[np.lexsort((root, self.kind[rows] == 2))]
        root = self.forest.roots(self.of[rows])
        held = index - first
        for i in range(0, len(rows), 1024):
            top = min(i + 1024, held) if i < held else min(i + 1024, len(rows))
            for j in range(i if i < held else 0, held, 1024):
                p, q = rows[i:top], rows[j : min(j + 1024, held)]
                if not (self.kind[p].any() or self.kind[q].any()):
                    continue
                x, y = root[i:top], root[j : min(j + 1024, held)]
                if (x == x[0]).all() and (y == x[0]).all():
                    continue
                self.take(p[:, None], q[None, :])
            if i < held < i + 1024:  # the probes of this block
                for j in range(0, held, 1024):
                    self.take(rows[held : i + 1024, None], rows[None, j : min(j + 1024, held)])


def links(
    nodes: DataFrame, tau: int, *, plan: tuple[int, int] | None = None, lanes: int = 1, ext_tau: int | None = None, ratio: float | None = None,
    find: tuple[float, float] | None = None,
) -> DataFrame:
    """Spanning links ``a, b`` of ``nodes(node, fp, n_shingles, ext)``.

    Two nodes link when ``fp`` differ in at most ``tau`` bits and, if given, all
    lanes together in at most ``ext_tau`` bits and the smaller shingle count is
    at least ``ratio`` of the larger.  Without ``find`` the partitions are of
    ``fp`` and no link is missed; ``plan`` fixes their number and width.  With
    ``find``, a share of differing bits and a recall, they are of all lanes, and
    two nodes with that share are compared with that probability at least.
    """
    spark = nodes.sparkSession
    n, together = bit_moments(nodes, lanes)
    if find is None:
        parts, width = plan or shape(max(1, n), tau)
        sure, top, per_lane = tau, radius(width, tau), [parts]
    else:
        parts, width, wide = reach(max(1, n), lanes, *find)
        sure, top, per_lane = parts - 1 + wide, 1, [parts // lanes + (k < parts % lanes) for k in range(lanes)]
    groups = [(k, g) for k, many in enumerate(per_lane) for g in grouped_bits(n, together[k], many, width)]
    masks = [
        [np.array([sum(1 << b for b in c) for c in itertools.combinations(range(width), t)], np.int64) for t in range(top + 1)] for _ in range(parts)
    ]
    counters = sketch_bits(parts)
    values = lambda v: np.stack([gathered(v[:, k], g) for k, g in groups], axis=1)

    def counted(batches):
        total = np.zeros((parts, 1 << counters), np.int64)
        for b in batches:
            v = values(all_lanes(b.column(0), b.column(1), lanes))
            for i in range(parts):
                total[i] += np.bincount(sketch_cell(v[:, i], counters), minlength=1 << counters)
        i, c = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(c), pa.array(total[i, c])], names=["i", "c", "n"])

    hist = np.zeros((parts, 1 << counters), np.float32)  # at most COUNTERS numbers
    rows = nodes.select("fp", "ext").mapInArrow(counted, "i long, c long, n long").groupBy("i", "c").agg(F.sum("n").alias("n")).toPandas()
    hist[rows["i"].to_numpy(int), rows["c"].to_numpy(int)] = rows["n"].to_numpy(float)
    shared = spark.sparkContext.broadcast(hist)
    per_node = parts + (sure - parts + 1) * width if find else parts * 3
    buckets = max(8, n * per_node // BUCKET_ROWS)
    kind_of = entry_type(lanes)

    def dealt(batches):
        hist = shared.value
        step = max(500, 150_000 // per_node)
        for b in batches:
            for at in range(0, b.num_rows, step):
                yield one(b.slice(at, step), hist)

    def one(b, hist):
        node = b.column(0).to_numpy(zero_copy_only=False)
        bits = all_lanes(b.column(1), b.column(3), lanes)
        v = values(bits)
        t = thresholds(v, masks, hist, sure, width)
        key, which, kind = [], [], []

        def put(i: int, value: np.ndarray, own: np.ndarray, what: np.ndarray) -> None:
            """Keys of entries; a hot one is a grid of cells, in which index entries of two salts, and probes with those of one, meet."""
            base = (value.astype(np.uint64) << np.uint64(6) | np.uint64(i)) << np.uint64(24)
            side = np.clip(np.ceil(hist[i][sketch_cell(value, counters)] / CELL_ROWS), 1, 4095).astype(np.int64)
            if (side > 1).any():
                salt = ((node[own].view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % side
                rep = np.repeat(np.arange(len(own)), side)
                other = np.arange(len(rep)) - np.repeat(np.cumsum(side) - side, side)
                mine = np.where(what[rep] == 2, other, salt[rep])
                base = base[rep] | (np.minimum(mine, other) << 12 | np.maximum(mine, other)).astype(np.uint64)
                own, what = own[rep], what[rep]
            key.append(base)
            which.append(own)
            kind.append(what)

        everything = np.arange(len(node))
        for i in range(parts):
            put(i, v[:, i], everything, (t[:, i] >= 0).astype(np.uint8))
            for r in range(1, int(t[:, i].max(initial=0)) + 1):
                own = np.flatnonzero(t[:, i] >= r)
                for f in masks[i][r]:
                    put(i, v[own, i] ^ f, own, np.full(len(own), 2, np.uint8))
        key, which, kind = np.concatenate(key), np.concatenate(which), np.concatenate(kind)
        bucket = ((key * np.uint64(0x9E3779B97F4A7C15) ^ key >> np.uint64(31)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, which = bucket[order].astype(np.int64), which[order]
        e = np.empty(len(order), kind_of)
        e["key"], e["kind"], e["node"], e["bits"] = key[order], kind[order], node[which], bits[which]
        e["n"] = np.minimum(b.column(2).to_numpy(zero_copy_only=False), 2**32 - 1)[which]
        start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
        offsets = (np.append(start, len(bucket)) * kind_of.itemsize).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(e.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(bucket[start]), data], names=["bucket", "entries"])

    rule = (tau, ext_tau, ratio)

    def joined(table: pa.Table) -> pa.Table:
        a, b = Bucket(np.frombuffer(b"".join(table.column("entries").to_pylist()), kind_of), rule).search()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    flat = nodes.select("node", "fp", "n_shingles", "ext").mapInArrow(dealt, "bucket long, entries binary")
    return flat.groupBy("bucket").applyInArrow(joined, "a long, b long")


def similar(similarity: float, lanes: int) -> dict:
    """What ``links`` takes for a cosine of shingle sets: bits differ by its angle over pi, two standard deviations of
    that estimate are allowed on all lanes and three on the first; sets of unlike size can't be so similar."""
    share = math.acos(similarity) / math.pi
    above = lambda bits, sd: math.floor(bits * share + sd * math.sqrt(bits * share * (1 - share)))
    return {"tau": above(64, 3), "ext_tau": above(64 * lanes, 2), "ratio": similarity**2, "find": (share, RECALL)}


def grouped(docs: DataFrame, shingle: int, tau: int | None, lanes: int, similarity: float, distinct: bool) -> DataFrame:
    """``doc_id, mark, fp, group, component_id`` of each row; rows of one doc_id with unlike fingerprints are apart."""
    near = tau is None
    fps = cut(fingerprints(docs, shingle, lanes if near else 1, distinct), "fingerprints")
    same = ["fp", "ext", "n_shingles"] if near else ["fp"]
    nodes = fps.filter("doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("n"))
    for c, v in (("ext", F.lit(b"")), ("n_shingles", F.lit(0).cast("long"))):
        if c not in same:
            nodes = nodes.withColumn(c, v)
    # a doc_id names the first of its fingerprints; should it have more, each has a name of its own
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("fp", "ext", "n_shingles"))
    named = F.when(nth == 1, F.col("doc")).otherwise(F.xxhash64("doc", "fp", "ext", "n_shingles"))
    nodes = cut(nodes.select("doc", named.alias("node"), "fp", "n_shingles", "ext", "n"), "nodes")
    comp = components(links(nodes, **similar(similarity, lanes), lanes=lanes) if near else links(nodes, tau))
    of = nodes.join(comp.withColumnRenamed("component", "_group"), "node", "left").withColumn("_group", F.coalesce("_group", "node"))
    if nodes.filter("node <> doc").take(1):
        least = of.groupBy("_group").agg(F.min("doc").alias("_component"))
        of = of.join(least, "_group")
    else:
        of = of.withColumn("_component", F.col("_group"))
    of = of.filter("n > 1 or _component <> doc or node <> doc or _group <> node").select(*[F.col(c).alias(f"_{c}") for c in same], "_group", "_component")
    on = F.lit(True)
    for c in same:
        on = on & (F.col(c) == F.col(f"_{c}"))
    some = F.col("doc_id").isNotNull()
    return fps.join(of, on, "left").select(
        "doc_id", "mark", "fp", F.when(some, F.coalesce("_group", "doc_id")).alias("group"), F.when(some, F.coalesce("_component", "doc_id")).alias("component_id")
    )


def simhash_groups(docs: DataFrame, *, shingle: int = 5, tau: int | None = None, lanes: int = 8, similarity: float = 0.8, distinct: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, fp (long), component_id``.

    ``component_id`` is the smallest doc_id reachable over links.  With ``tau``,
    texts link whose 64-bit fingerprints differ in at most so many bits, none is
    missed.  Without, they link at a cosine of ``similarity`` of their sets of
    shingles, as 64 bits for each of ``lanes`` lanes estimate it; of the pairs
    at the limit RECALL are found, and more the more similar they are.

    Null texts and texts without words have fingerprint zero and are one group.
    Null doc_ids keep their fingerprint, take part in no group and get a null
    component.  Repeated rows stay repeated; rows of one doc_id with unlike texts
    are judged apart.  Other columns are not looked at.  Empty table: empty.
    """
    return grouped(docs, shingle, tau, lanes, similarity, distinct).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, *, shingle: int = 5, lanes: int = 8, similarity: float = 0.8, distinct: bool = True) -> DataFrame:
    """The rows of ``docs`` that stay: of each group one of the smallest doc_id, of several texts of that doc_id the one
    with the smallest hash, and of rows that share both the first by a hash of all columns.  Rows with a null doc_id all
    stay.  Columns are those of ``docs``."""
    groups = grouped(docs, shingle, None, lanes, similarity, distinct).filter("doc_id = component_id")
    kept = groups.groupBy("group").agg(F.min(F.struct("doc_id", "mark")).alias("x")).select(F.col("x.doc_id").alias("_doc"), F.col("x.mark").alias("_mark"))
    kept = kept.distinct()
    mark, cols = F.xxhash64(F.col("text").cast("string")), [F.col(f"`{c}`") for c in docs.columns]
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    nth = F.row_number().over(Window.partitionBy("_doc", "_mark").orderBy(F.xxhash64(*hashed)))
    named = docs.join(kept, (F.col("doc_id") == F.col("_doc")) & (mark == F.col("_mark"))).withColumn("_nth", nth).filter("_nth = 1")
    return named.select(*cols).unionByName(docs.filter("doc_id is null"))


def op3_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = simhash_groups(docs, shingle=3, tau=2, distinct=False)
    return found.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
