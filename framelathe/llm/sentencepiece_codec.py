"""SentencePiece encoding and decoding in batched numpy.

A model file is parsed here and its pieces become sorted 64-bit keys.  Distinct
words of equal length form one matrix of code points and advance together:
prefix hashes give the hash of any substring, which probes the sorted keys.

Unigram models: Viterbi; for every end position the scores of all pieces that
end there are compared in one vectorised maximum, whose argument is the stored
backpointer.  BPE models: the best-scoring path is not what BPE yields, so the
same matrices and probes carry out BPE's merges instead (every step takes each
word's best-scored adjacent pair, leftmost on ties, by a vectorised maximum).
Characters outside the vocabulary fall back to bytes, or to the unknown piece.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import balanced

#: Names the model file in the session; without it, and without a path, the file of the public tokenizers.
SETTING = "spark.framelathe.sentencepiece.model"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Longer words are encoded one at a time by a heap.
LONG_WORD = 96
#: Words of a task whose pieces are kept for the next batch; then the store starts anew.
STORE = 400_000
#: Characters encoded at a time.
STEP_CHARS = 2_000_000


def varint(raw: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[i]
        i += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, i
        shift += 7


def fields(raw: bytes):
    """Number and value of each field of a protocol buffer message."""
    i = 0
    while i < len(raw):
        tag, i = varint(raw, i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(raw, i)
        elif kind == 1:
            value, i = raw[i : i + 8], i + 8
        elif kind == 5:
            value, i = raw[i : i + 4], i + 4
        else:
            n, i = varint(raw, i)
            value, i = raw[i : i + n], i + n
        yield tag >> 3, value


def mixed(points: np.ndarray) -> np.ndarray:
    z = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(32))


def prefix_hashes(points: np.ndarray) -> np.ndarray:
    w, n = points.shape
    h = np.zeros((w, n + 1), np.uint64)
    m = mixed(points)
    for j in range(n):
        h[:, j + 1] = h[:, j] * BASE + m[:, j]
    return h


def powers(n: int) -> np.ndarray:
    out = [1]
    for _ in range(n):
        out.append(out[-1] * int(BASE) & 0xFFFFFFFFFFFFFFFF)
    return np.array(out, np.uint64)


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    kind: int = UNIGRAM
    byte_fallback: bool = False
    dummy_prefix: bool = True
    squeeze: bool = True
    charsmap: bytes = b""
    keys: np.ndarray = field(init=False)
    key_ids: np.ndarray = field(init=False)

    def __post_init__(self):
        own = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER) and self.pieces[i]]
        h = np.zeros(len(own), np.uint64)
        by_length: dict[int, list[int]] = {}
        for at, i in enumerate(own):
            by_length.setdefault(len(self.pieces[i]), []).append(at)
        for n, at in by_length.items():
            h[at] = prefix_hashes(points_of([self.pieces[own[a]] for a in at], n))[:, n]
        order = np.argsort(h)
        self.keys, self.key_ids = h[order], np.array(own, np.int32)[order]
        if len(np.unique(self.keys)) != len(own):
            raise ValueError("two pieces have one hash")
        score = np.array(self.scores, np.float64)
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)  # equal scores, equal ranks
        self.score = score
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes_of = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.longest = max(by_length)
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", self.pieces[i]) for i in own)
        self.ids = {self.pieces[i]: i for i in own}
        raw = []
        for p, k in zip(self.pieces, self.kinds):
            if k == BYTE:
                raw.append(bytes([int(p[3:5], 16)]))
            elif k == CONTROL:
                raw.append(b"")
            elif k == UNKNOWN:
                raw.append(" ⁇ ".encode())
            else:
                raw.append(p.replace(SPACE, " ").encode())
        self.raw = np.array([*raw, b""], dtype=object)[:-1]

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Piece id of each hash, or -1."""
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == h, self.key_ids[at], -1)


def points_of(words: list[str], n: int) -> np.ndarray:
    return np.array(words, dtype=f"U{n}").view(np.uint32).reshape(len(words), n)


def load(path: str = MODEL) -> Model:
    """Parse a model file.  Normalisation maps other than the identity are refused."""
    with open(path, "rb") as f:
        return parse(f.read())


def parse(raw: bytes) -> Model:
    pieces, scores, kinds, how = [], [], [], {}
    for number, value in fields(raw):
        if number == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(fields(value))
            pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece[2])[0])
            kinds.append(piece[3])
        elif number == 2:
            own = dict(fields(value))
            how |= {"kind": own.get(3, UNIGRAM), "byte_fallback": bool(own.get(35, 0))}
        elif number == 3:
            own = dict(fields(value))
            how |= {"dummy_prefix": bool(own.get(3, 1)), "squeeze": bool(own.get(4, 1)), "charsmap": own.get(2, b"")}
    if how.get("charsmap"):
        raise ValueError("only models with the identity normalisation are supported")
    return Model(pieces, scores, kinds, **how)


def spell(m: Model, chars: str) -> list[int]:
    """Ids of characters that no piece covers."""
    if m.byte_fallback:
        return [m.bytes_of[b] for b in chars.encode("utf-8", "replace")]
    return [m.unknown]


def merged(m: Model, words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """BPE of words of n characters: a matrix of symbol bounds and the number of symbols of each word."""
    h, power = prefix_hashes(points_of(words, n)), powers(n)
    none = np.iinfo(np.int32).max
    out = np.tile(np.arange(n + 1, dtype=np.int32), (len(words), 1))
    left = np.full(len(words), n)
    live, bound = np.arange(len(words)), out.copy()

    def ranks(rows, s, e):
        ids = m.probe(h[rows, e] - h[rows, s] * power[e - s])
        return np.where(ids >= 0, m.rank[ids], none)

    r = np.full((len(words), n), none, np.int32)  # of the pair that starts at each symbol
    for j in range(n - 1):
        r[:, j] = ranks(live, bound[:, j], bound[:, j + 2])
    while len(live):
        best = r.argmin(1)
        rows = np.arange(len(live))
        going = r[rows, best] != none
        if not going.all():
            stop = ~going
            out[live[stop]] = bound[stop]
            left[live[stop]] = count_symbols(bound[stop], n)
            live, bound, r, best = live[going], bound[going], r[going], best[going]
            rows = np.arange(len(live))
            if not len(live):
                break
        # drop the bound between the two symbols; what follows moves up
        at = np.arange(n + 1)
        bound = np.take_along_axis(bound, np.minimum(at + (at > best[:, None]), n), 1)
        at = np.arange(n)
        r = np.take_along_axis(r, np.minimum(at + (at > best[:, None]), n - 1), 1)
        for j in (best - 1, best):
            ok = j >= 0
            jj = np.where(ok, j, 0)
            e = bound[rows, np.minimum(jj + 2, n)]
            s, mid = bound[rows, jj], bound[rows, jj + 1]
            new = ranks(live, s, e)
            new[mid >= n] = none
            r[rows[ok], jj[ok]] = new[ok]
        r[:, n - 1] = none
    return out, left


def count_symbols(bound: np.ndarray, n: int) -> np.ndarray:
    return (bound < n).sum(1)


def viterbi(m: Model, words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The best-scoring segmentation of words of n characters, as bounds and number of symbols."""
    h, power = prefix_hashes(points_of(words, n)), powers(n)
    w = len(words)
    unknown = m.score[[k in (NORMAL, USER) for k in m.kinds]].min() - 10.0
    top = m.score.max()
    user = np.array([k == USER for k in m.kinds])
    score = np.full((w, n + 1), -np.inf)
    score[:, 0] = 0
    back = np.zeros((w, n + 1), np.int32)
    for e in range(1, n + 1):
        first = max(0, e - m.longest)
        tried = np.full((w, e - first), -np.inf)
        for s in range(first, e):
            ids = m.probe(h[:, e] - h[:, s] * power[e - s])
            value = np.where(ids >= 0, np.where(user[ids], (e - s) * top - 0.1, m.score[ids]), unknown if e - s == 1 else -np.inf)
            tried[:, s - first] = score[:, s] + value
        k = tried.argmax(1)
        score[:, e] = tried[np.arange(w), k]
        back[:, e] = k + first
    bound = np.full((w, n + 1), n, np.int32)
    count = np.zeros(w, np.int64)
    rev = np.full((w, n + 1), 0, np.int32)
    at, rows = np.full(w, n), np.arange(w)
    while (at > 0).any():
        go = rows[at > 0]
        at[go] = back[go, at[go]]
        rev[go, count[go]] = at[go]
        count[go] += 1
    for k in range(n):
        has = count > k
        bound[has, k] = rev[has, count[has] - 1 - k]
    return bound, count


def one_word(m: Model, word: str) -> list[int]:
    """BPE of a long word by a heap of candidate pairs."""
    import heapq

    n = len(word)
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list = []

    def push(i: int) -> None:
        if i >= 0 and nxt[i] < n:
            e = end[nxt[i]]
            p = m.ids.get(word[i:e]) if e - i <= m.longest else None
            if p is not None:
                heapq.heappush(heap, (int(m.rank[p]), i, e))

    for i in range(n):
        push(i)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or end[j] != e:
            continue
        alive[j] = False
        end[i], nxt[i] = e, nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        push(prv[i])
        push(i)
    out, i = [], 0
    while i < n:
        p = m.ids.get(word[i : end[i]])
        out += [p] if p is not None else spell(m, word[i : end[i]])
        i = nxt[i]
    return out


def encode_words(m: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and their number for each word."""
    by_length: dict[int, list[int]] = {}
    for i, x in enumerate(words):
        by_length.setdefault(len(x), []).append(i)
    count = np.zeros(len(words), np.int64)
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # word, position in the word, id
    for n, at in by_length.items():
        if m.kind == BPE and n > LONG_WORD:
            for i in at:
                ids = one_word(m, words[i])
                count[i] = len(ids)
                got.append((np.full(len(ids), i), np.arange(len(ids)), np.array(ids, np.int32)))
            continue
        step = max(1, 400_000 // (n * (1 if m.kind == BPE else n)))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            own = [words[i] for i in part]
            bound, symbols = (merged if m.kind == BPE else viterbi)(m, own, n)
            h, power = prefix_hashes(points_of(own, n)), powers(n)
            row = np.repeat(np.arange(len(own)), symbols)
            col = np.arange(len(row)) - np.repeat(np.cumsum(symbols) - symbols, symbols)
            s, e = bound[row, col], bound[row, np.minimum(col + 1, n)]
            ids = m.probe(h[row, e] - h[row, s] * power[e - s])
            index = np.array(part)
            odd = np.nonzero(ids < 0)[0]
            if not len(odd):
                count[index] = symbols
                got.append((index[row], col, ids.astype(np.int32)))
                continue
            spelt = [spell(m, own[row[o]][s[o] : e[o]]) for o in odd]
            if not m.byte_fallback:  # neighbouring unknowns are one
                drop = odd[1:][(np.diff(odd) == 1) & (row[odd[1:]] == row[odd[:-1]])]
                sizes = np.ones(len(ids), np.int64)
                sizes[drop] = 0
            else:
                sizes = np.ones(len(ids), np.int64)
                sizes[odd] = [len(x) for x in spelt]
            flat = np.repeat(ids, sizes)
            first = np.cumsum(sizes) - sizes
            for o, x in zip(odd, spelt):
                flat[first[o] : first[o] + sizes[o]] = x[: sizes[o]]
            row = np.repeat(row, sizes)
            per = np.bincount(row, minlength=len(own))
            col = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
            count[index] = per
            got.append((index[row], col, flat.astype(np.int32)))
    first = np.cumsum(count) - count
    flat = np.zeros(int(count.sum()), np.int32)
    for word, pos, ids in got:
        flat[first[word] + pos] = ids
    return flat, count


class Encoder:
    """Encodes texts, keeping the pieces of words it has met."""

    def __init__(self, model: Model):
        self.m = model
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if model.by_word else r"(?s).+")
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        if self.m.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
            if not text:
                return []
        text = text.replace(" ", SPACE)
        return self.cut.findall((SPACE if self.m.dummy_prefix else "") + text)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and their number for each; null and empty texts have none."""
        split = [self.words(t or "") for t in texts]
        flat = [w for x in split for w in x]
        if len(self.known) > STORE:
            self.clear()
        new = [w for w in dict.fromkeys(flat) if w not in self.known]
        if new:
            ids, count = encode_words(self.m, new)
            n = len(self.known)
            self.known.update(zip(new, range(n, n + len(new))))
            self.flat, self.count = np.concatenate([self.flat, ids]), np.concatenate([self.count, count])
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        begin = np.cumsum(self.count) - self.count
        size = self.count[at]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(begin[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.cumsum([len(x) for x in split])
        ends = np.concatenate(([0], ends))
        return ids, np.diff(ends[np.concatenate(([0], upto)).astype(np.int64)])


def decode_ids(m: Model, ids: np.ndarray) -> str:
    """The text of ids; the space of the dummy prefix goes, bytes that are no UTF-8 become U+FFFD."""
    raw = b"".join(m.raw[ids].tolist())
    if m.dummy_prefix and raw.startswith(b" "):
        raw = raw[1:]
    return raw.decode("utf-8", "replace")


def steps(texts: list[str | None]):
    """Slices of so many characters."""
    begin = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total > STEP_CHARS:
            yield slice(begin, i + 1)
            begin, total = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def model_of(spark, path: str | None):
    """The model, broadcast: some megabytes, and read by the driver alone."""
    return spark.sparkContext.broadcast(load(path or spark.conf.get(SETTING, MODEL)))


def encode(docs: DataFrame, path: str | None = None, check: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens`` (long), ``token_ids`` (array of int) and, if asked, ``round_trip``.

    ``round_trip``: decoding gives the text again (a literal U+2581 counts as a
    space, as the format has it).  Null texts: no tokens, null ids and null
    round_trip; empty ones: an empty array; very long ones are taken whole.  Each
    row stands alone; columns of these names are replaced.  Empty table: empty.
    ``path``: the model file, else what SETTING names.
    """
    spark = docs.sparkSession
    model = model_of(spark, path)
    added = ["n_tokens", "token_ids"] + ["round_trip"] * check
    plain = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    extra = {"n_tokens": T.LongType(), "token_ids": T.ArrayType(T.IntegerType()), "round_trip": T.BooleanType()}
    schema = T.StructType([*plain.schema.fields, *[T.StructField(c, extra[c]) for c in added]])

    def run(batches):
        m = model.value
        encoder = Encoder(m)
        for b in batches:
            texts = b.column("text").to_pylist()
            for part in steps(texts):
                own = texts[part]
                ids, count = encoder(own)
                null = np.array([t is None for t in own])
                offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(null, False)), pa.array(ids))
                cols = [*b.slice(part.start, len(own)).columns, pa.array(count), lists]
                if check:
                    same = [
                        None if t is None else decode_ids(m, ids[offsets[i] : offsets[i + 1]]) == t.replace(SPACE, " ")
                        for i, t in enumerate(own)
                    ]
                    cols.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return plain.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``tokens`` with ``text`` decoded from ``token_ids``; null ids give a null text."""
    model = model_of(tokens.sparkSession, path)
    plain = tokens.select(*[F.col(f"`{c}`") for c in tokens.columns if c != "text"])
    schema = T.StructType([*plain.schema.fields, T.StructField("text", T.StringType())])

    def run(batches):
        m = model.value
        for b in batches:
            text = [None if x is None else decode_ids(m, np.array(x, np.int64)) for x in b.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=schema.names)

    return plain.mapInArrow(run, schema)


def op10_query(spark, sf_dir: str) -> DataFrame:
    docs = balanced(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return encode(docs).select("doc_id", "n_tokens", "token_ids", "round_trip")
