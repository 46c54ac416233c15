"""Parsers and codecs on arbitrary input."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from framelathe.llm import html_extraction, sentencepiece_codec, simhash_dedup, substring_dedup, warc

MODEL = sentencepiece_codec.load()
TREE = html_extraction.train()
TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=200)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_encoding_equals_the_library(texts):
    from tests.llm.test_texts import library

    sp = library()
    ids, count = sentencepiece_codec.Encoder(MODEL)(texts)
    ends = np.cumsum(count)
    for t, e, n in zip(texts, ends, count):
        own = ids[e - n : e]
        assert own.tolist() == sp.encode(t)
        assert sentencepiece_codec.decode_ids(MODEL, own) == t.replace("▁", " ")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.none() | TEXT, st.none() | st.integers(0, 2**62), st.binary(max_size=300)), max_size=6), st.sampled_from([1, 2]))
def test_archives_give_back_what_they_got(rows, version):
    raw = warc.arc_start("x", version) + b"\n" + b"".join(warc.arc_record(u, i, p, version) + b"\n" for u, i, p in rows)
    got = [(f.get("Filename", "-"), warc.payload_of(b)[1]) for _, f, b in warc.parse_arc(raw)]
    assert got == [("-" if i is None or version == 1 else f"{warc.PAGE}{i}", p) for _, i, p in rows]
    out = b"".join(warc.warc_record("resource", {"WARC-Record-ID": f"<{k}>"}, p) + b"\r\n\r\n" for k, (_, _, p) in enumerate(rows))
    assert [(f["warc-record-id"], b) for f, b in warc.parse_warc(out)] == [(f"<{k}>", p) for k, (_, _, p) in enumerate(rows)]


PIECES = st.sampled_from(["<p>", "</p>", "<article>", "</article>", "<div class='ad'>", "</div>", "<a href=x>", "</a>", "<", ">", "&amp;", "&#0;", "text ", "<!--", "-->", "<script>", "</script>", "<br/>", '"', "<h1>", "<nav>", "</nav>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=40))
def test_any_markup_has_some_text(parts):
    out = html_extraction.main_text("".join(parts), TREE)
    assert out == " ".join(out.split())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=60), st.integers(1, 8))
def test_packing(values, width):
    u = np.array(sorted({v % (1 << 8 * width) for v in values}), np.uint64)
    assert (substring_dedup.unpack(substring_dedup.pack(u, width), width) == u).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40))
def test_majority(values):
    h = np.array(values, np.uint64)
    want = sum(1 << b for b in range(64) if sum(v >> b & 1 for v in values) * 2 > len(values))
    assert simhash_dedup.majority(h) == want


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(1, 5))
def test_shingles(text, k):
    w = text.lower().split()
    assert len(simhash_dedup.shingle_hashes(text, k)) == (0 if not w else max(1, len(w) - k + 1))
