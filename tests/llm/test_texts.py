"""Operators on documents against brute force, on the odd rows and on their edges."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from framelathe.llm import mixing, quality_rules, sentencepiece_codec, simhash_dedup, substring_dedup, toxicity
from framelathe.llm._common import components
from tests.oracle import rows_of, rows_of_sql

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def as_table(rows):
    cols = list(zip(*rows)) if rows else [()] * 5
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "text", "lang", "source", "n_chars"])


# --- quality rules


def test_quality_equals_sql(spark, odd, odd_rows):
    got = quality_rules.quality(odd).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")
    assert rows_of(got) == rows_of_sql(quality_rules.ORACLE, documents=as_table(odd_rows))


def test_quality_cases(spark, odd, clashing, no_docs):
    by = {r.doc_id: r for r in quality_rules.quality(odd).collect() if r.doc_id is not None}
    assert by[4].clean_text is None and by[4].base_failed and by[5].n_words == 0
    assert by[9].n_dup_lines == 1 and by[12].n_removed_words == 40 and not by[12].kept and not by[13].base_failed
    assert by[14].kept and by[14].clean_text.count("\n") == 0 and by[13].clean_text.startswith(by[13].text.split("\n")[1])
    assert by[1].kept and by[1].clean_text == by[1].text
    got = quality_rules.quality(clashing)
    assert got.count() == 19 and dict(got.dtypes)["kept"] == "boolean" and dict(got.dtypes)["copy"] == "string"
    assert quality_rules.quality(no_docs).count() == 0
    assert quality_rules.quality(odd).filter("kept").filter("doc_id = 1").count() == 1


def test_a_phrase_fails_short_lines_only(spark):
    plain = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [
        (1, f"{plain[:-1]} and click here for more.", True), (2, f"Click here!\n{plain}", False), (3, f"we design in blue and resign in red, blog in to it\n{plain}", True),
        (4, f"© 2020 some one\n{plain}", False), (5, "Sign in. Log in to it. Share this. " + " ".join(f"w{i}" for i in range(40)) + f"\n{plain}", False), (6, f"SIGN IN\n{plain}", False),
    ]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {r.doc_id: (r.clean_text, r.kept) for r in quality_rules.quality(df).collect()}
    for i, t, whole in rows:
        assert (got[i][0] == t) == whole and got[i][1] and plain[:-1] in got[i][0], i
    table = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    own = quality_rules.quality(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")
    assert rows_of(own) == rows_of_sql(quality_rules.ORACLE, documents=table)


def test_quality_is_native(odd):
    plan = quality_rules.quality(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hash" not in plan


# --- SimHash


def brute_fp(text, k):
    w = [x.encode() for x in WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))]
    if not w:
        return 0
    sh = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_groups(pairs, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_query_form(spark, odd, odd_rows, clashing, no_docs):
    how = dict(shingle=3, tau=2, distinct=False)
    got = [(r.doc_id, r.fp & 0xFFFFFFFFFFFFFFFF, r.component_id) for r in simhash_dedup.simhash_groups(odd, **how).collect()]
    fps = {}
    for r in odd_rows:
        if r[0] is not None:
            fps[r[0]] = brute_fp(r[1], 3)
    comp = brute_groups([(a, b) for a in fps for b in fps if bin(fps[a] ^ fps[b]).count("1") <= 2], fps)
    want = [(r[0], brute_fp(r[1], 3), comp.get(r[0])) for r in odd_rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert [x[2] for x in got if x[0] in (4, 5, 6)] == [4, 4, 4]  # no words: one fingerprint
    again = [(r.doc_id, r.fp & 0xFFFFFFFFFFFFFFFF, r.component_id) for r in simhash_dedup.simhash_groups(clashing, **how).collect()]
    assert sorted(again, key=str) == sorted(want, key=str)
    assert simhash_dedup.simhash_groups(no_docs, **how).count() == 0


@pytest.mark.parametrize("tau,plan", [(2, None), (2, (2, 12)), (2, (3, 8)), (4, (3, 10)), (6, (4, 8)), (12, None), (12, (5, 10))])
def test_pigeonhole_loses_no_link(spark, tau, plan):
    rng = np.random.default_rng(tau)
    base = rng.integers(0, 2**63, 300, dtype=np.int64)
    base &= ~np.int64(0xFFFF)  # correlated, skewed bits
    fps = [int(x) for x in base]
    for x in base[:150]:
        for k in rng.integers(0, tau + 3, 3):
            y = int(x)
            for b in rng.choice(63, int(k), replace=False):
                y ^= 1 << int(b)
            fps.append(y)
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(i, f, 0, b"") for i, f in enumerate(fps)], "node long, fp long, n_shingles long, ext binary")
    found = [(r.a, r.b) for r in simhash_dedup.links(nodes, tau, plan=plan).collect()]
    assert all(bin(fps[a] ^ fps[b]).count("1") <= tau for a, b in found)
    true = [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= tau]
    assert brute_groups(found, range(len(fps))) == brute_groups(true, range(len(fps))) and true


def test_hot_values_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "CELL_ROWS", 20)
    fps = sorted({(5 << 40) | x for x in range(400)})
    nodes = spark.createDataFrame([(i, f, 0, b"") for i, f in enumerate(fps)], "node long, fp long, n_shingles long, ext binary")
    edges = simhash_dedup.links(nodes, 2)
    assert edges.count() > 0
    assert set(brute_groups([(r.a, r.b) for r in edges.collect()], range(len(fps))).values()) == {0}


def test_thresholds_sum_and_minimise():
    width, tau, parts = 6, 4, 3
    rng = np.random.default_rng(0)
    v = rng.integers(0, 64, (50, parts))
    import itertools

    masks = [[np.array([sum(1 << b for b in c) for c in itertools.combinations(range(width), t)] or [0]) for t in range(tau + 1)] for _ in range(parts)]
    hist = np.zeros((parts, 2**16))
    for i in range(parts):
        np.add.at(hist[i], simhash_dedup.sketch_cell(np.arange(64)), rng.integers(1, 5000, 64))
    t = simhash_dedup.thresholds(v, masks, hist, tau, width)
    assert (t.sum(1) == tau - parts + 1).all() and t.min() >= -1

    def cost(row, ts):
        return sum(
            sum(hist[i][simhash_dedup.sketch_cell(np.array([row[i] ^ int(f)]))[0]] for r in range(ts[i] + 1) for f in masks[i][r]) + simhash_dedup.ROW_COST * simhash_dedup.ball(width, ts[i])
            for i in range(parts) if ts[i] >= 0
        )

    options = [o for o in itertools.product(range(-1, tau + 1), repeat=parts) if sum(o) == tau - parts + 1]
    for row, own in list(zip(v, t))[:12]:
        assert math.isclose(cost(row, own), min(cost(row, o) for o in options), rel_tol=1e-9)


def brute_lanes(text, lanes=8):
    h = np.unique(simhash_dedup.shingle_hashes(text.encode(), 5))
    return [simhash_dedup.majority(simhash_dedup.lane(h, k)) for k in range(lanes)], len(h)


def brute_similar(a, b):
    """A cosine of 0.8 as 512 bits estimate it: 0.2048 of them differ, and two standard deviations more; three of the first 64."""
    d = [bin(x ^ y).count("1") for x, y in zip(a[0], b[0])]
    return d[0] <= 22 and sum(d) <= 123 and min(a[1], b[1]) >= 0.64 * max(a[1], b[1])


def edited(words_, share, rng):
    return " ".join(f"{w}x" if rng.random() < share else w for w in words_)


def test_near_copies_meet_in_partitions(spark):
    """Every partition selects, and nearly all links that comparing every pair finds are found."""
    from tests.llm.conftest import words

    rng = random.Random(6)
    rows = []
    for i in range(150):
        base = words(rng.randint(60, 300), 1000 + i)
        rows += [" ".join(base)] + [edited(base, s, rng) for s in (0.01, 0.02, 0.03, 0.04)]
    rows = [(i, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash_dedup.simhash_groups(df).collect()}
    fp = [brute_lanes(t) for _, t in rows]
    true = [(a, b) for a in range(len(fp)) for b in range(a) if brute_similar(fp[a], fp[b])]
    assert sum(got[a] == got[b] for a, b in true) >= 0.99 * len(true) and len(true) > 600
    want = brute_groups(true, range(len(fp)))
    assert all(want[i] == want[c] for i, c in got.items())  # no link that isn't one
    for n in (10, 1000, 10**5, 10**7, 10**9):
        parts, width, wide = simhash_dedup.reach(n, 8, 0.2048, 0.99)
        assert width >= 8 and parts > 1 and wide <= parts and (n < 10**7 or width > 8)


def test_unlike_texts_of_one_doc_id_stay(spark):
    from tests.llm.conftest import words

    a, b, c = (" ".join(words(80, k)) for k in (501, 502, 503))
    rows = [(8, a), (8, b), (5, a), (8, b), (9, b), (9, c), (None, a)]
    got = sorted(((r.doc_id, r.text) for r in simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, a), (8, b), (9, c), (None, a)], key=str)
    near = a.rsplit(" ", 1)[0] + " other"
    rows = [(8, a), (8, near), (8, a)]
    assert simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == 1


@pytest.mark.parametrize("cell", [24_000, 300])
def test_long_runs(spark, monkeypatch, cell):
    """Runs beyond LONG_RUN: copies that one entry joins, others that it doesn't, and probes."""
    monkeypatch.setattr(simhash_dedup, "CELL_ROWS", cell)
    rng = np.random.default_rng(3)
    fps = {int(x) & ~0xFFFFFFFF for x in rng.integers(0, 2**62, 6)}
    fps = sorted({f | int(x) for f in fps for x in rng.integers(0, 2**9, 260)} | {int(x) for x in rng.integers(0, 2**62, 300)})
    nodes = spark.createDataFrame([(i, f, 0, b"") for i, f in enumerate(fps)], "node long, fp long, n_shingles long, ext binary")
    found = [(r.a, r.b) for r in simhash_dedup.links(nodes, 2, plan=(2, 12)).collect()]
    true = [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 2]
    assert all(bin(fps[a] ^ fps[b]).count("1") <= 2 for a, b in found)
    assert brute_groups(found, range(len(fps))) == brute_groups(true, range(len(fps)))


def test_keep_one(spark, odd):
    kept = simhash_dedup.keep_one(odd)
    ids = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == odd.columns and 2 not in ids and 3 not in ids and ids[1] == 1 and ids[8] == 1 and ids[None] == 1 and 16 not in ids and ids[-3] == 1
    assert ids[7] == 1 and ids[11] == 1


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute_groups([e for e in edges if e[0] != e[1]], {x for e in edges if e[0] != e[1] for x in e})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tables_are_counted_and_swept(spark, no_docs, monkeypatch):
    from framelathe.llm import _common

    before = _common.tables()
    df = _common.cut(spark.range(7), "seven")
    assert df.count() == 7 and _common.cut(no_docs, "none").count() == 0 and len(_common.tables() - before) == 2
    kept = {p for p in _common.tables() if "/seven-" in p} | before
    _common.sweep(spark, kept)
    assert df.count() == 7 and _common.tables() == kept
    _common.sweep(spark, before)
    assert _common.tables() == before
    monkeypatch.setattr(_common, "observed", lambda seen: 8)
    with pytest.raises(RuntimeError, match="is the folder shared"):
        _common.cut(spark.range(7), "lost")
    monkeypatch.setattr(_common, "observed", lambda seen: None)
    assert _common.cut(spark.range(7), "unknown").count() == 7


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace as N

    from framelathe.llm import _common

    def session(master):
        return N(sparkContext=N(master=master, getConf=lambda: N(get=lambda *_: None)), conf=N(get=lambda *_: None, set=lambda *_: None))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        _common.shared_dir(session("spark://host:7077"))
    assert _common.shared_dir(session("local[2]")).startswith("file:///")


def test_components_have_no_cap_on_rounds(spark, monkeypatch):
    from framelathe.llm import _common

    monkeypatch.setattr(_common, "range", lambda n: [0] * min(n, 1), raising=False)  # any loop over a number of rounds ends after one
    order = random.Random(4).sample(range(200), 200)
    got = components(spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")).collect()
    assert len(got) == 200 and {r.component for r in got} == {0}


# --- substring dedup


def brute_cut(rows, window=13):
    seen = {}
    split = [WORD.findall(r[1] or "") for r in rows]
    for r, w in zip(rows, split):
        if r[0] is not None:
            for i in range(len(w) - window + 1):
                s = tuple(w[i : i + window])
                seen[s] = min(seen.get(s, r[0]), r[0])
    out = []
    for r, w in zip(rows, split):
        gone = set()
        if r[0] is not None:
            for i in range(len(w) - window + 1):
                if seen[tuple(w[i : i + window])] < r[0]:
                    gone.update(range(i, i + window))
        out.append((r[0], len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def cut_rows(df, **how):
    got = substring_dedup.substring_dedup(df, **how)
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest()) for r in got.collect()), key=str)


def test_substring_equals_brute_force(spark, odd, odd_rows, no_docs, monkeypatch):
    assert cut_rows(odd) == brute_cut(odd_rows)
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(substring_dedup, "RANGE_BYTES", 900)
    assert cut_rows(odd) == brute_cut(odd_rows)
    assert cut_rows(odd, window=5, block=3) == brute_cut(odd_rows, 5)
    monkeypatch.setattr(substring_dedup, "FAN", 4)  # so many levels
    assert cut_rows(odd) == brute_cut(odd_rows)
    assert substring_dedup.substring_dedup(no_docs).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(odd, window=12)


def test_substring_random_texts(spark):
    r = random.Random(4)
    for n in (3, 12):
        rows = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 60))), "en", "a", 0) for i in range(60)]
        r.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(n)
        assert cut_rows(df) == brute_cut(rows)


def test_messages_grow_with_the_data(spark, monkeypatch):
    """Each level sends as many messages as there are senders times FAN at most, and levels merge as many senders."""
    from tests.llm.conftest import words

    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 500)
    monkeypatch.setattr(substring_dedup, "RANGE_BYTES", 100)
    monkeypatch.setattr(substring_dedup, "FAN", 8)
    sent = {}
    for n in (100, 400, 1600):
        rows = [(i, " ".join(words(40, i))) for i in range(n)]
        dealt, _, key, size = substring_dedup.dealt_out(spark.createDataFrame(rows, "doc_id long, text string"))
        x = substring_dedup.Exchange(substring_dedup.Blocks, size, substring_dedup.hash_bits(size))
        trace = []
        answers = x.answer(substring_dedup.ask_blocks(dealt, key, x, 7, 13), trace=trace)
        counts = [t.count() for t in trace]
        assert answers.count() == counts[0] and x.fan**x.levels * 100 >= size and x.levels == len(counts)
        sent[n] = sum(counts)
    assert sent[1600] < 8 * sent[400] and sent[1600] / 1600 < 2 * sent[100] / 100 * 2


def test_windows_are_told_apart_by_96_bits():
    u = np.array([7, 7, 7, 9], np.uint64)
    more, low = np.array([1, 2, 1, 1], np.uint64), np.array([5, -4, 3, 2**62], np.int64)
    order = np.lexsort((more, u))
    part = (u[order], more[order], low[order])
    row = substring_dedup.Windows.packed(part, 0, 8)
    back = substring_dedup.Windows.unpacked(*row, 0, 8)
    assert all((a == b).all() for a, b in zip(part, back))
    whole, inv = substring_dedup.Windows.union([part, (u[:1], more[:1], np.array([-9]))])
    assert whole[0].tolist() == [7, 7, 9] and whole[1].tolist() == [1, 2, 1] and whole[2].tolist() == [-9, -4, 2**62]
    told = substring_dedup.Windows.told(np.zeros(3, bool), whole, inv, [part, (u[:1], more[:1], np.array([-9]))])
    assert told.tolist() == [True, True, False, False, False]


def test_substring_keeps_columns_and_untouched_texts(spark, odd, clashing):
    rows = {r.doc_id: r for r in substring_dedup.substring_dedup(clashing).collect()}
    assert rows[1].copy == "clash" and rows[1].n_removed == 0 and rows[4].text is None and rows[6].text == " \t\n\x0b\x0c\r "
    assert rows[8].n_removed == 60 and [tuple(x) for x in rows[8].repeats] == [(20, 79)] and rows[2].text == ""


# --- mixing


def test_mixing_equals_sql(spark, odd, odd_rows, small):
    docs = [(i, t, l, s, n) for i, t, l, s, n in odd_rows]
    assert rows_of(mixing.mix(odd)) == rows_of_sql(mixing.ORACLE, documents=as_table(docs))
    assert rows_of(mixing.op9_query(spark, small)) == rows_of_sql(mixing.ORACLE, small)


def test_mixing_meets_its_weights(spark, clashing, no_docs):
    rows = [(i, "x" * (10 + i % 7), "en", f"s{min(i % 10, 3)}", 1) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix(df, {"s0": 3, "s1": 1, "s3": 0.5})
    size = {r.source: r.n for r in got.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    total = sum(len(r[1]) for r in rows)
    assert "s2" not in size and all(abs(size[s] / total - w / 4.5) < 0.03 for s, w in (("s0", 3), ("s1", 1), ("s3", 0.5)))
    n = Counter(Counter(r.doc_id for r in got.filter("source = 's0'").collect()).values())
    mean = total * 3 / 4.5 / sum(len(r[1]) for r in rows if r[3] == "s0")
    for k in range(3, 10):
        assert abs(n[k] / 600 - math.exp(-mean) * mean**k / math.factorial(k)) < 0.06
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.mix(df, {"s0": 3, "s1": 1, "s3": 0.5}).collect()))
    assert mixing.mix(no_docs).count() == 0
    assert dict(mixing.mix(clashing).dtypes)["copy"] == "bigint"


def test_large_means_are_split(spark):
    df = spark.createDataFrame([(i, "ab", "en", "rare", 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    n = mixing.mix(df, {"rare": 1.0}, budget=80 * 900.0).groupBy("doc_id").count()
    got = np.array([r["count"] for r in n.collect()])
    assert len(got) == 40 and abs(got.mean() - 900) < 5 * 30 / 6 and 15 < got.std() < 50


def test_rows_without_doc_id_draw_apart(spark):
    df = spark.createDataFrame([(None, f"text {i}", "en", "s", 1) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    n = Counter(r.text for r in mixing.mix(df).collect())
    assert 200 < len(n) < 300 and len(set(n.values())) > 1  # a mean of one copy leaves out e to the -1 of them
    assert mixing.mix(df).select("shuffle_key").distinct().count() == sum(n.values())


def test_mixing_without_broadcast(spark, odd, monkeypatch):
    want = rows_of(mixing.mix(odd))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert rows_of(mixing.mix(odd)) == want


# --- SentencePiece


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)


def test_encoding_equals_the_library(spark, odd, odd_rows, clashing, no_docs):
    sp = library()
    got = {(r.doc_id, r.text): r for r in sentencepiece_codec.encode(odd).collect()}
    for i, t, *_ in odd_rows:
        r = got[i, t]
        assert r.token_ids == (None if t is None else sp.encode(t)) and r.n_tokens == len(r.token_ids or []) and r.round_trip == (None if t is None else True)
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(odd).drop("text"))
    assert sorted(map(str, (r.text for r in back.collect()))) == sorted(map(str, (r[1] for r in odd_rows)))
    assert sentencepiece_codec.encode(no_docs).count() == 0
    assert dict(sentencepiece_codec.encode(clashing).dtypes)["token_ids"] == "array<int>"


def test_encoding_of_random_strings():
    sp, m = library(), sentencepiece_codec.load()
    r = random.Random(5)
    pool = "aeiounrst  ▁_-.,\n\t0123éüñß日本語🙂́"
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 300))) for _ in range(200)] + ["a" * 500, "the " * 100 + "end", "x" * 97 + "é" * 97]
    ids, count = sentencepiece_codec.Encoder(m)(texts)
    ends = np.cumsum(count)
    for t, e, n in zip(texts, ends, count):
        own = ids[e - n : e]
        assert own.tolist() == sp.encode(t)
        assert sentencepiece_codec.decode_ids(m, own) == sp.decode(own.tolist())


def unigram_model(fallback):
    def number(k, v):
        return bytes([k << 3]) + bytes([v]) if k < 16 else bytes([(k << 3) & 127 | 128, k >> 4, v])

    def piece(text, score, kind):
        import struct

        raw = text.encode()
        body = b"\x0a" + bytes([len(raw)]) + raw + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind])
        return b"\x0a" + bytes([len(body)]) + body

    r = random.Random(1)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else []
    names = sorted({"▁", "a", "b", "c", "d"} | {"".join(r.choice("abcd▁"[: 4 + (k == 0)]) for k in range(r.randint(1, 5))) for _ in range(120)})
    names = [x for x in names if "▁" not in x[1:]]
    pieces += [(x, -r.uniform(1, 9) * (1 + len(x) / 3), 1) for x in names]
    trainer = number(3, 1) + number(35, int(fallback))
    norm = b"\x0a\x08identity" + number(3, 1) + number(4, 0) + number(5, 1)
    return b"".join(piece(*p) for p in pieces) + b"\x12" + bytes([len(trainer)]) + trainer + b"\x1a" + bytes([len(norm)]) + norm


@pytest.mark.parametrize("fallback", [True, False])
def test_viterbi_of_unigram_models(fallback):
    import sentencepiece

    raw = unigram_model(fallback)
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    m = sentencepiece_codec.parse(raw)
    assert m.kind == sentencepiece_codec.UNIGRAM and m.byte_fallback == fallback
    r = random.Random(2)
    texts = ["".join(r.choice("abcd abcd abcdxé") for _ in range(r.randint(0, 60))) for _ in range(300)]
    ids, count = sentencepiece_codec.Encoder(m)(texts)
    ends = np.cumsum(count)
    for t, e, n in zip(texts, ends, count):
        assert ids[e - n : e].tolist() == sp.encode(t), t


def test_the_session_names_the_model(spark, tmp_path):
    raw = unigram_model(True)
    (tmp_path / "m").write_bytes(raw)
    df = spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")
    own = sentencepiece_codec.encode(df, str(tmp_path / "m")).first().token_ids
    spark.conf.set(sentencepiece_codec.SETTING, str(tmp_path / "m"))
    try:
        assert sentencepiece_codec.encode(df).first().token_ids == own
        assert sentencepiece_codec.decode(sentencepiece_codec.encode(df)).first().text == "ab cd"
    finally:
        spark.conf.unset(sentencepiece_codec.SETTING)
    assert sentencepiece_codec.encode(df).first().token_ids != own


def test_maps_are_refused():
    with pytest.raises(ValueError):
        sentencepiece_codec.parse(b"\x1a\x04\x12\x02ab")


# --- toxicity


def toxic_tables(spark, n=600):
    r = random.Random(3)
    plain = ["".join(r.choice("aeioubdfgklmn") for _ in range(r.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        y = int(r.random() < 0.15)
        own = [r.choice(plain) for _ in range(40)]
        if y:
            own[5:8] = [r.choice(["scum", "idiot", "grobba" + r.choice(plain)]) for _ in range(3)]
        docs.append((i, " ".join(own), "en", "a", 1))
        if i % 3:
            labels.append((i, 1, y))
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs


def test_toxicity_on_held_out_rows(spark):
    d, l, docs = toxic_tables(spark)
    got = {r.doc_id: r for r in toxicity.toxicity(d, l).collect()}
    y = {i: any(w in ("scum", "idiot") or w.startswith("grobba") for w in t.split()) for i, t, *_ in docs}
    held = [i for i in got if got[i].held_out]
    assert 60 < len(held) < 200 and sum((got[i].predicted == 1) == y[i] for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_labels_of_held_out_rows_are_not_learnt(spark):
    d, l, _ = toxic_tables(spark, 200)
    from zlib import crc32

    flipped = l.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ([(r.doc_id, r.held_out, r.score) for r in toxicity.toxicity(d, x).orderBy("doc_id").collect()] for x in (l, flipped))
    assert a == b and all(h == (crc32(str(i).encode()) % 5 == 0) for i, h, _ in a)


def test_toxicity_cases(spark, odd, clashing, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(clashing, none)
    assert got.count() == 19 and got.filter("score is null or predicted = 1").count() == 0
    assert toxicity.toxicity(no_docs, none).count() == 0
    some = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (99, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(odd, some).count() == 19
    bad = spark.createDataFrame([(1, "you are an idiot and scum")], "doc_id long, text string")
    assert toxicity.toxicity(bad, none).first().predicted == 1


def test_sample_is_bounded(spark):
    d, l, _ = toxic_tables(spark)
    every = toxicity.training_rows(d, l)
    size = sum(len(t) for t, _ in every)
    assert 200 < len(every) <= l.count() and 30 < len(toxicity.training_rows(d, l, rows=100)) < 180
    with pytest.raises(ValueError, match="none of"):
        toxicity.training_rows(d, l, size=1)
    few = toxicity.training_rows(d, l, size=size // 4)
    assert 0 < sum(len(t) for t, _ in few) < size // 2 and set(few) <= set(every)


def brute_label_model(votes, prior, rounds=25):
    """The label model in loops."""
    n, m = len(votes), len(votes[0])
    post = [0.9 if sum((v == 1) - (v == 0) for v in row) > 0 else 0.1 * prior for row in votes]
    for _ in range(rounds):
        table = [[[0.5] * 3 for _ in range(m)] for _ in range(2)]
        for row, p in zip(votes, post):
            for j, v in enumerate(row):
                table[0][j][v + 1] += 1 - p
                table[1][j][v + 1] += p
        table = [[[x / sum(t) for x in t] for t in c] for c in table]
        mean = [[t[2] - t[0] for t in c] for c in table]
        resid = [[(1 - p) * (v - mean[0][j]) + p * (v - mean[1][j]) for j, v in enumerate(row)] for row, p in zip(votes, post)]
        sd = [math.sqrt(sum(r[j] ** 2 for r in resid) / n) + 1e-9 for j in range(m)]
        worth = [1 / (1 + sum(max(0.0, sum(r[j] * r[k] for r in resid) / n / sd[j] / sd[k]) for k in range(m) if k != j) + max(0.0, sum(r[j] ** 2 for r in resid) / n / sd[j] ** 2 - 1)) for j in range(m)]
        post = []
        for row in votes:
            z = sum(worth[j] * math.log(table[1][j][v + 1] / table[0][j][v + 1]) for j, v in enumerate(row)) + math.log(prior / (1 - prior))
            post.append(1 / (1 + math.exp(-min(30.0, max(-30.0, z)))))
    return post


def brute_toxicity(docs, labels):
    """Scores of every row: mined voters, label model, logistic regression and cut in plain Python and dense matrices."""
    from zlib import crc32

    gold = {}
    for i, y in labels:
        if i is not None and y is not None and crc32(str(i).encode()) % 5:
            gold[i] = max(gold.get(i, 0), y)
    rows = sorted(((i, t) for i, t in docs if i in gold), key=lambda r: (r[0], r[1] or ""))
    y = np.array([gold[i] for i, _ in rows], bool)
    own = [toxicity.features_of(t) for _, t in rows]
    every, pos = Counter(f for x in own for f in x), Counter(f for x, z in zip(own, y) if z for f in x)
    mined = sorted(((f, pos[f] / (every[f] + 1) * math.log1p(pos[f])) for f in every if pos[f] >= 4 and pos[f] / every[f] >= 0.95), key=lambda x: (-x[1], x[0]))[:600]
    six = [{f for f, _ in mined[k::6]} for k in range(6)] if mined else []
    lexicons = [set(v.split()) for v in toxicity.LEXICONS.values()]
    known = set().union(*lexicons, *six)
    votes = []
    for (_, t), x in zip(rows, own):
        v = [1 if x & lex else -1 for lex in lexicons] + [1 if x & g else (0 if k % 2 else -1) for k, g in enumerate(six)]
        v += [1 if re.search(p, (t or "").lower(), re.I) else -1 for p in toxicity.PATTERNS]
        hits = len(x & known)
        votes.append(v + [0 if hits == 0 else -1, 1 if hits >= 3 else (0 if hits == 0 else -1)])
    soft = np.array(brute_label_model(votes, min(0.5, max(0.01, y.mean()))))
    base = min(0.99, max(0.01, soft.mean()))
    names = sorted(every)
    x = np.array([[f in o for f in names] for o in own], float)
    n, mass = x.sum(0), soft @ x
    use = (n >= 3) & ((mass - base * n) ** 2 / (n * base * (1 - base) + 1) >= 12)
    x, n = x[:, use], n[use]
    assert use.sum() <= toxicity.FEATURES
    w, b, vw, vb = np.zeros(len(n)), math.log(base / (1 - base)), np.zeros(len(n)), 0.0
    for _ in range(400):
        e = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - soft
        vw, vb = 0.8 * vw - 0.05 / np.sqrt(n) * (e @ x + 0.02 * w), 0.8 * vb - 0.2 * e.mean()
        w, b = w + vw, b + vb
    w = np.where(np.abs(w) > 1e-3, w, 0)
    z = x @ w + b
    cuts = sorted({(a + c) / 2 for a, c in zip(sorted(set(z)), sorted(set(z))[1:])} | {z.min() - 1, z.max() + 1})
    wrong = [((z > c) != y).sum() for c in cuts]
    b -= min((c for c, k in zip(cuts, wrong) if k == min(wrong)), key=abs)
    weight = dict(zip(np.array(names)[use], w))
    return [(i, 1 / (1 + math.exp(-min(30.0, max(-30.0, b + sum(weight.get(f, 0.0) for f in toxicity.features_of(t))))))) for i, t in docs]


def test_toxicity_equals_brute_force(spark, tmp_path):
    d, l, docs = toxic_tables(spark, 240)
    odd = [(9001, None, "en", "a", 1), (9002, "", "en", "a", 1), (None, "scum idiot", "en", "a", 1), (3, docs[3][1], "en", "a", 1)]
    d = d.union(spark.createDataFrame(odd, d.schema))
    l = l.union(spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, None, None), (None, 1, 1)], l.schema))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    l.write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted(((r.doc_id, r.score, r.predicted) for r in toxicity.op8_query(spark, str(tmp_path)).collect()), key=lambda r: (str(r[0]), r[1]))
    want = brute_toxicity([(r[0], r[1]) for r in [*docs, *odd]], [(r.doc_id, r.toxic) for r in l.collect()])
    want = sorted(want, key=lambda r: (str(r[0]), r[1]))
    assert len(got) == len(want) == 244 and any(s > 0.5 for _, s in want)
    for (i, s, p), (j, t) in zip(got, want):
        assert i == j and abs(s - t) < 1e-6 and (p == (t >= 0.5) or abs(t - 0.5) < 1e-6)


def test_label_model_equals_loops():
    rng = np.random.default_rng(7)
    votes = rng.integers(-1, 2, (60, 7))
    post, _, _ = toxicity.label_model(votes, 0.2)
    assert np.allclose(post, brute_label_model(votes.tolist(), 0.2), atol=1e-9)


def test_fitting_cut():
    z, y = np.array([-3.0, -2, -2, 1, 4]), np.array([0, 0, 1, 1, 1], bool)
    assert toxicity.fitting_cut(z, y) in (-2.5, -0.5) and ((z > toxicity.fitting_cut(z, y)) != y).sum() == 1
    assert toxicity.fitting_cut(z, np.zeros(5, bool)) == 0 and toxicity.fitting_cut(z, np.ones(5, bool)) == 0


def test_label_model_learns_accuracies_and_correlations():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    right = lambda p: np.where(rng.random(4000) < p, y, ~y).astype(int)
    a, b, c = right(0.9), right(0.8), right(0.75)
    votes = np.stack([a, b, c, c, c, right(0.9)], axis=1)
    post, table, corr = toxicity.label_model(votes, 0.2)
    assert abs(table[1, 0, 2] - 0.9) < 0.06 and abs(table[0, 0, 2] - 0.1) < 0.06
    assert corr[2, 3] > 0.95 and abs(corr[0, 1]) < 0.2
    assert ((post > 0.5) == y).mean() > 0.9


# --- the pipeline


def test_pipeline_equals_brute_force(spark, odd_rows, tmp_path, small):
    import corpus_pipeline as p

    r = random.Random(8)
    from tests.llm.conftest import DOCS, words

    rows = [x for x in odd_rows if x[0] is not None] + [(100 + i, " ".join(words(r.randint(12, 80), 50 + i)) + ".", "en", r.choice("abc"), 1) for i in range(60)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((x.doc_id, tuple(x.token_ids)) for x in p.run(spark, str(tmp_path)).collect())

    kept = {}
    from framelathe.llm.quality_rules import WHOLE_PHRASE

    def fails(line):
        w = WORD.findall(line)
        marks = sum(bool(re.search(r"[!?*#$%&~^=_+]{2,}[.,;:]?$", x)) for x in w)
        bars = sum(x in "|»·>•" for x in w)
        return marks * 100 > len(w) * 30 or bars >= 2 and bars * 100 > len(w) * 25 or 0 < len(w) <= 25 * len(re.findall(WHOLE_PHRASE, line))

    for i, t, lang, s, _ in rows:
        w = WORD.findall(t or "")
        win = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {j for k in range(len(w) - 4) if win[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        clean = "\n".join(x for x in (t or "").split("\n") if not fails(x))
        lost = len(w) - len(WORD.findall(clean))
        if len(w) >= 10 and len(rep) * 5 <= len(w) and lost * 2 <= len(w):
            kept[i] = (clean, s)
    fp = {i: brute_lanes(t) for i, (t, _) in kept.items()}

    def near(a, b):
        return brute_similar(fp[a], fp[b])

    comp = brute_groups([(a, b) for a in fp for b in fp if a < b and near(a, b)], fp)
    kept = {i: v for i, v in kept.items() if comp[i] == i}
    cut = {}
    texts = [(i, t) for i, (t, _) in kept.items()]
    seen = {}
    for i, t in texts:
        w = WORD.findall(t)
        for k in range(len(w) - 12):
            x = tuple(w[k : k + 13])
            seen[x] = min(seen.get(x, i), i)
    for i, t in texts:
        w = WORD.findall(t)
        gone = {j for k in range(len(w) - 12) if seen[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        if len(gone) < len(w):
            cut[i] = t if not gone else " ".join(x for j, x in enumerate(w) if j not in gone)
    size = defaultdict(int)
    for i, t in cut.items():
        size[kept[i][1]] += len(t)
    total, roots = sum(size.values()), sum(v**0.5 for v in size.values())
    sp, want = library(), []
    for i, t in cut.items():
        s = kept[i][1]
        rate = size[s] ** 0.5 / roots * total / size[s]
        u = (int(hashlib.md5(f"mix-1:{i}:1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n, p_, c = 0, math.exp(-rate), math.exp(-rate)
        while c < u:
            n += 1
            p_ *= rate / n
            c += p_
        want += [(i, tuple(sp.encode(t)))] * n
    assert got == sorted(want) and len(got) > 20
    assert [n for n, _ in p.STAGES] == ["quality_rules", "simhash_near_dedup", "substring_dedup", "source_mixing", "sentencepiece"]


def test_stages_take_odd_and_empty_tables(spark, odd, clashing, no_docs):
    import corpus_pipeline as p

    for name, stage in p.STAGES:
        plain = sorted(map(str, stage(spark, odd, "").collect()))
        assert plain and sorted(map(str, stage(spark, clashing, "").collect())) == plain, name  # other columns change nothing
        assert stage(spark, no_docs, "").count() == 0
        if name != "sentencepiece":
            assert tuple(stage(spark, odd, "").columns) == p.COLUMNS
        ids = Counter(r.doc_id for r in stage(spark, odd, "").collect())
        if name == "quality_rules":
            assert not {4, 5, 6} & set(ids) and ids[8] == 2 and ids[None] == 1  # nulls and empty texts go, repeated rows stay
        if name == "simhash_near_dedup":
            assert ids[8] == 1 and ids[None] == 1 and 2 not in ids and ids[4] == 1 and 5 not in ids
        if name == "substring_dedup":
            assert ids[4] == ids[None] == 1 and ids[8] == 2 and 2 not in ids
        if name == "sentencepiece":
            assert sum(ids.values()) == 19
