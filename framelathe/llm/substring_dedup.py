"""Repeated passages found by fixed-block anchors.

A repeat of ``window`` words holds a whole block of ``block`` words of the
reference at a multiple of ``block`` (``window >= 2 * block - 1``).  So all
non-overlapping blocks are indexed and probed with every rolling window of
``block`` words; around each hit the exact ``window``-word sequences are
compared, and their runs are the maximal exact repeats.

Documents are dealt into chunks once; that exchange serves all three passes.
Hashes travel packed: per chunk and hash range one message with the sorted
distinct hashes, a few bytes each, so that every passage counts once per chunk
however often it occurs and no key is hot.  Answers come back as one bit per
hash.  A sender splits its hashes among ``FAN`` ranges at most; for more, the
messages of as many senders are merged and split again, level by level, so
their number grows with the data and not with its square.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import text_bytes

CHUNK_BYTES = 4 << 20
#: Text bytes whose hashes share one range; a task sees the hashes of one range at a time.
RANGE_BYTES = 6 << 20
#: Ranges that a sender's hashes are split among at most.
FAN = 256


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)


def mixed_in(out: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = (out ^ h) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def ended(out: np.ndarray) -> np.ndarray:
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def rolling(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive entries."""
    n = len(h) - k + 1
    out = np.full(n, seed, np.uint64)
    for i in range(k):
        out = mixed_in(out, h[i : i + n])
    return ended(out)


def rolling_at(h: np.ndarray, at: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The same for the k entries from each position."""
    out = np.full(len(at), seed, np.uint64)
    for i in range(k):
        out = mixed_in(out, h[at + i])
    return ended(out)


class Chunk:
    """The words of a chunk's rows, in a stable order, with their windows.

    Rows are ordered by doc_id and text.  Rows with a null doc_id or text have
    no windows: they are neither references nor compared.
    """

    def __init__(self, ids: list, texts: list, block: int, window: int, bits: int):
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or b""))
        self.words = [(texts[i] or b"").split() for i in self.order]
        self.ids = [ids[i] for i in self.order]
        used = [len(w) if d is not None else 0 for w, d in zip(self.words, self.ids)]
        flat = [x for w, n in zip(self.words, used) if n for x in w]
        self.h, self.other = (np.ascontiguousarray(x) for x in word_hashes(flat).T)
        n = len(flat)
        length = np.array(used, np.int64)
        self.first = np.cumsum(length) - length
        self.doc = np.repeat(np.arange(len(used)), length)
        self.end = np.repeat(self.first + length, length)  # of the document each word is in
        self.offset = np.arange(n) - np.repeat(self.first, length)
        self.block, self.window, self.bits = block, window, bits

    def starts(self, k: int) -> np.ndarray:
        """Positions where k words of one document start."""
        at = np.arange(max(0, len(self.h) - k + 1))
        return at[at + k <= self.end[: len(at)]]

    def blocks(self):
        """Sorted distinct hashes of every rolling block, whether one is aligned, and how often each occurs."""
        at = self.starts(self.block)
        g = rolling(self.h, self.block, 7)[at] if len(at) else np.zeros(0, np.uint64)
        g >>= np.uint64(64 - self.bits)
        u, inv, count = np.unique(g, return_inverse=True, return_counts=True)
        aligned = np.zeros(len(u), bool)
        aligned[inv[self.offset[at] % self.block == 0]] = True
        return at, inv, u, aligned, count

    def candidates(self, hit_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that hold a hit block: positions, 64-bit hashes and 32 more bits."""
        at = self.starts(self.window)
        mark = np.zeros(len(self.h) + 1, np.int64)
        mark[hit_at + 1] = 1
        total = np.cumsum(mark)
        at = at[total[at + self.window - self.block + 1] > total[at]]
        more = rolling_at(self.other, at, self.window, 17) >> np.uint64(32)
        return at, rolling_at(self.h, at, self.window, 13), more


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with equal keys, the major one first, the first one's position; and the group of each row."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


def pack(u: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each entry, one plane after another."""
    return np.ascontiguousarray(u.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros(planes.shape[1], np.uint64)
    for k in range(width):
        out |= planes[k].astype(np.uint64) << np.uint64(8 * k)
    return out


def bits_of(table: pa.Table, first: int, sizes: np.ndarray) -> np.ndarray:
    """The answers to one sender, in the order of its ranges from ``first`` on: a bool per hash."""
    out = np.zeros(int(sizes.sum()), bool)
    begin = np.cumsum(sizes) - sizes
    for r, raw in zip(table.column("range").to_pylist(), table.column("bits").to_pylist()):
        out[begin[r - first] : begin[r - first] + sizes[r - first]] = np.unpackbits(np.frombuffer(raw, np.uint8))[: sizes[r - first]]
    return out


class Blocks:
    """Messages of block hashes: whether a hash is an aligned block, and whether two chunks have it."""

    schema = pa.schema([("range", pa.int64()), ("sender", pa.int64()), ("hashes", pa.binary()), ("flags", pa.binary()), ("many", pa.binary())])
    spark = "range long, sender long, hashes binary, flags binary, many binary"

    @staticmethod
    def packed(part, base: int, wide: int) -> tuple:
        u, aligned, many = part
        return pack(u - np.uint64(base), wide), np.packbits(aligned).tobytes(), np.packbits(many).tobytes() if many.any() else b""

    @staticmethod
    def unpacked(hashes: bytes, flags: bytes, many: bytes, base: int, wide: int) -> tuple:
        u = unpack(hashes, wide) + np.uint64(base)
        bits = lambda raw: np.unpackbits(np.frombuffer(raw, np.uint8))[: len(u)].astype(bool) if raw else np.zeros(len(u), bool)
        return u, bits(flags), bits(many)

    @staticmethod
    def union(parts: list) -> tuple[tuple, np.ndarray]:
        every, flags, many = (np.concatenate(x) for x in zip(*parts))
        u, inv, count = np.unique(every, return_inverse=True, return_counts=True)
        aligned, twice = np.zeros(len(u), bool), count > 1
        aligned[inv[flags]] = True
        twice[inv[many]] = True
        return (u, aligned, twice), inv

    @staticmethod
    def decided(whole: tuple) -> np.ndarray:
        """Hashes that two chunks have and that are an aligned block in one of them."""
        return whole[1] & whole[2]

    @staticmethod
    def told(bits: np.ndarray, whole: tuple, inv: np.ndarray, parts: list) -> np.ndarray:
        return bits[inv]


class Windows:
    """Messages of window hashes with the smallest doc_id that has each; 96 bits tell windows apart."""

    schema = pa.schema([("range", pa.int64()), ("sender", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary()), ("least", pa.int64())])
    spark = "range long, sender long, hashes binary, docs binary, least long"

    @staticmethod
    def packed(part, base: int, wide: int) -> tuple:
        u, more, low = part
        least = int(low.min())
        span = low.view(np.uint64) - np.uint64(least & 0xFFFFFFFFFFFFFFFF)
        return pack(u, 8) + pack(more, 4), pack(span, max(1, (int(span.max()).bit_length() + 7) // 8)), least

    @staticmethod
    def unpacked(hashes: bytes, docs: bytes, least: int, base: int, wide: int) -> tuple:
        n = len(hashes) // 12
        low = (unpack(docs, len(docs) // n) + np.uint64(least & 0xFFFFFFFFFFFFFFFF)).view(np.int64)
        return unpack(hashes[: 8 * n], 8), unpack(hashes[8 * n :], 4), low

    @staticmethod
    def union(parts: list) -> tuple[tuple, np.ndarray]:
        u, more, low = (np.concatenate(x) for x in zip(*parts))
        first, inv = grouped(u, more)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, inv, low)
        return (u[first], more[first], least), inv

    @staticmethod
    def decided(whole: tuple) -> np.ndarray:
        return np.zeros(len(whole[0]), bool)

    @staticmethod
    def told(bits: np.ndarray, whole: tuple, inv: np.ndarray, parts: list) -> np.ndarray:
        """Whether a smaller doc_id, here or beyond, has the window."""
        return bits[inv] | (whole[2][inv] < np.concatenate([p[2] for p in parts]))


class Exchange:
    """Sends sorted hashes of so many bits to their ranges and brings the answers back, in as many levels as it takes."""

    def __init__(self, kind: type, size: int, bits: int):
        self.kind, self.bits = kind, bits
        ranges = max(16, -(-size // RANGE_BYTES))
        self.levels = next(k for k in range(1, 65) if FAN**k >= ranges)
        self.fan = next(f for f in range(1, FAN + 1) if f**self.levels >= ranges)

    def edge(self, r: int, level: int) -> int:
        return (r << self.bits) // self.fan**level

    def wide(self, level: int) -> int:
        """Bytes that tell hashes of one range apart."""
        return max(1, -(-((1 << self.bits) // self.fan**level + 1).bit_length() // 8))

    def bounds(self, u: np.ndarray, within: int, level: int) -> np.ndarray:
        """Where the ranges of a level that make up one of the level above begin in u, and its end."""
        edges = [self.edge(within * self.fan + k, level) for k in range(self.fan)]
        return np.append(np.searchsorted(u, np.array(edges, np.uint64), "left"), len(u))

    def messages(self, part: tuple, within: int, level: int, sender: int) -> pa.Table:
        cut = self.bounds(part[0], within, level)
        rows = []
        for k in range(self.fan):
            if cut[k + 1] > cut[k]:
                r = within * self.fan + k
                own = tuple(x[cut[k] : cut[k + 1]] for x in part)
                rows.append((r, sender, *self.kind.packed(own, self.edge(r, level), self.wide(level))))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [()] * 5, self.kind.schema)], schema=self.kind.schema)

    def parts(self, table: pa.Table, level: int) -> list:
        fields = self.kind.schema.names[2:]
        return [
            self.kind.unpacked(*row, self.edge(r, level), self.wide(level))
            for r, *row in zip(table.column("range").to_pylist(), *[table.column(f).to_pylist() for f in fields])
        ]

    def reply(self, table: pa.Table, level: int, bits: Callable[[tuple], np.ndarray]) -> pa.Table:
        parts = self.parts(table, level)
        whole, inv = self.kind.union(parts)
        hit = self.kind.told(bits(whole), whole, inv, parts)
        ends = np.cumsum([len(p[0]) for p in parts])
        raw = [np.packbits(x).tobytes() for x in np.split(hit, ends[:-1])]
        return pa.table({"range": table.column("range"), "sender": table.column("sender"), "bits": pa.array(raw, pa.binary())})

    def answer(self, sent: DataFrame, level: int = 1, trace: list[DataFrame] | None = None) -> DataFrame:
        """``range, sender, bits`` for every message; ``trace`` takes the messages of each level."""
        if trace is not None:
            trace.append(sent)
        schema = "range long, sender long, bits binary"
        if level == self.levels:
            return sent.groupBy("range").applyInArrow(lambda t: self.reply(t, level, self.kind.decided), schema)
        keyed = sent.withColumn("team", F.floor(F.col("sender") / self.fan)).groupBy("range", "team")

        def merge(key, table):
            whole, _ = self.kind.union(self.parts(table, level))
            return self.messages(whole, key[0].as_py(), level + 1, key[1].as_py())

        def back(key, table, answers):
            r = key[0].as_py()
            return self.reply(table, level, lambda whole: bits_of(answers, r * self.fan, np.diff(self.bounds(whole[0], r, level + 1))))

        above = self.answer(keyed.applyInArrow(merge, self.kind.spark), level + 1, trace)
        above = above.select(F.floor(F.col("range") / self.fan).alias("within"), F.col("sender").alias("team"), "range", "bits")
        return keyed.cogroup(above.groupBy("within", "team")).applyInArrow(back, schema)


def hash_bits(size: int) -> int:
    """Bits of a block's hash: 40, or so many that few of the blocks of so many bytes agree by chance."""
    return min(64, max(40, size.bit_length() + 6))


def chunk_of(table: pa.Table, block: int, window: int, bits: int) -> Chunk:
    return Chunk(table.column("doc_id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist(), block, window, bits)


def dealt_out(docs: DataFrame) -> tuple[DataFrame, DataFrame, str, int]:
    """Rows dealt to chunks by the column named third; rows without it; and the bytes of all texts."""
    _, size = text_bytes(docs)
    chunks = max(16, -(-size // CHUNK_BYTES))
    deal = min(chunks, max(16, -(-size // (4 * CHUNK_BYTES))))
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "repeats")]
    plain = docs.select(*[F.col(f"`{c}`") for c in names])
    key = "__chunk"
    while key in names:
        key += "_"
    number = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(chunks)).cast("long")
    return plain.withColumn(key, number).repartition(deal, key), plain, key, size


def ask_blocks(dealt: DataFrame, key: str, exchange: Exchange, block: int, window: int) -> DataFrame:
    """The block hashes of every chunk, as messages of the first level."""

    def asked(table: pa.Table) -> pa.Table:
        _, _, u, aligned, _ = chunk_of(table, block, window, exchange.bits).blocks()
        return exchange.messages((u, aligned, np.zeros(len(u), bool)), 0, 1, table.column(key)[0].as_py())

    return dealt.groupBy(key).applyInArrow(asked, Blocks.spark)


def substring_dedup(docs: DataFrame, *, window: int = 13, block: int = 7) -> DataFrame:
    """``docs`` with ``text`` cut, and ``n_words, n_removed, repeats``.

    A word goes if it lies in ``window`` consecutive words of its document whose
    sequence also starts in a document of a smaller doc_id, judged on the input.
    Words that stay are joined by one space; a text that loses nothing stays as
    it is, and a null one null.  ``repeats`` lists the maximal runs removed as
    ``first, last`` word positions.  Rows with a null doc_id pass unchanged and
    match nothing; rows that repeat a doc_id don't remove each other's words.
    Columns of ``docs`` with the names of the three new ones are replaced.  Very
    long texts are chunks of their own.  Empty table: empty.
    """
    if window < 2 * block - 1:
        raise ValueError("window must be at least 2 * block - 1, or a repeat might hold no whole block")
    dealt, plain, key, size = dealt_out(docs)
    blocks, seconds = Exchange(Blocks, size, hash_bits(size)), Exchange(Windows, size, 64)
    first = blocks.answer(ask_blocks(dealt, key, blocks, block, window))

    def chunk(table: pa.Table) -> Chunk:
        return chunk_of(table, block, window, blocks.bits)

    def number(table: pa.Table) -> int:
        return table.column(key)[0].as_py()

    def hits(c: Chunk, answers: pa.Table) -> np.ndarray:
        at, inv, u, aligned, count = c.blocks()
        hit = bits_of(answers, 0, np.diff(blocks.bounds(u, 0, 1))) | ((count > 1) & aligned)
        return at[hit[inv]] if len(at) else at

    def windows(c: Chunk, answers: pa.Table):
        at, h, more = c.candidates(hits(c, answers))
        first, inv = grouped(h, more)
        ids = np.array([x if x is not None else 0 for x in c.ids], np.int64)
        return at, inv, (h[first], more[first], ids[c.doc[at[first]]]), ids  # rows are in order of doc_id

    def compared(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return Windows.schema.empty_table()
        return seconds.messages(windows(chunk(table), answers)[2], 0, 1, number(table))

    run = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
    out_schema = T.StructType([
        *plain.schema.fields,
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("repeats", T.ArrayType(run)),
    ])

    def cut_out(table: pa.Table, answers: pa.Table, again: pa.Table) -> pa.Table:
        c = chunk(table)
        at, inv, (u, _, low), ids = windows(c, answers)
        gone_hash = bits_of(again, 0, np.diff(seconds.bounds(u, 0, 1)))
        mine = ids[c.doc[at]] if len(at) else np.zeros(0, np.int64)
        hit = at[gone_hash[inv] | (low[inv] < mine)] if len(at) else at
        edge = np.zeros(len(c.h) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + window, -1)
        gone = np.cumsum(edge)[:-1] > 0
        texts = table.column("text").cast(pa.binary()).to_pylist()
        new, n_words, n_removed, runs = list(texts), [0] * len(texts), [0] * len(texts), [[] for _ in texts]
        for k, i in enumerate(c.order):
            words = c.words[k]
            n_words[i] = len(words)
            if c.ids[k] is None or not words:
                continue
            own = gone[c.first[k] : c.first[k] + len(words)]
            lost = int(own.sum())
            if lost:
                n_removed[i] = lost
                new[i] = b" ".join([w for w, x in zip(words, own.tolist()) if not x])
                turn = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
                runs[i] = [{"first": a, "last": b - 1} for a, b in turn.reshape(-1, 2).tolist()]
        table = table.drop_columns([key])
        table = table.set_column(table.column_names.index("text"), "text", pa.array(new, pa.binary()).cast(pa.string()))
        run = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for name, col in (("n_words", pa.array(n_words, pa.int64())), ("n_removed", pa.array(n_removed, pa.int64())), ("repeats", pa.array(runs, run))):
            table = table.append_column(name, col)
        return table

    by_chunk = dealt.groupBy(key)
    second = seconds.answer(by_chunk.cogroup(first.groupBy("sender")).applyInArrow(compared, Windows.spark))
    both = first.withColumn("pass", F.lit(1)).union(second.withColumn("pass", F.lit(2)))

    def last(table: pa.Table, answers: pa.Table) -> pa.Table:
        which = answers.column("pass").to_numpy()
        return cut_out(table, answers.filter(pa.array(which == 1)), answers.filter(pa.array(which == 2)))

    return by_chunk.cogroup(both.groupBy("sender")).applyInArrow(last, out_schema)


def op6_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = substring_dedup(docs)
    joined = F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), 1), " ")
    return found.select("doc_id", "n_words", "n_removed", F.sha2(joined, 256).alias("kept_sha256"))


_W = r"[^\x20\x09-\x0D]+"
_SEQ = " || ' ' || ".join(f"w[i+{k}]" for k in range(13))
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents
), win AS (
  SELECT k, doc_id, i, {_SEQ} AS s FROM (SELECT k, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), bad AS (
  SELECT k, i FROM (SELECT k, doc_id, i, min(doc_id) OVER (PARTITION BY s) AS low FROM win) WHERE low < doc_id
), gone AS (
  SELECT k, list(DISTINCT p) AS g FROM (SELECT k, unnest(range(i, i + 13)) AS p FROM bad) GROUP BY k
), gone_words AS (
  SELECT DISTINCT k, p FROM (SELECT k, unnest(range(i, i + 13)) AS p FROM bad)
), words AS (
  SELECT k, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT k, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone_words USING (k, p) GROUP BY k
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (k) LEFT JOIN kept USING (k)
"""
