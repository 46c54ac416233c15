"""Operators on pages and embeddings against brute force, on odd rows and on their edges."""

import base64
import gzip
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelathe.llm import embedding_dedup, html_extraction, url_filters, warc
from tests.llm.test_texts import brute_groups
from tests.oracle import rows_of, rows_of_sql

PAGES = "page_id long, url string, html string"
ROWS = [
    (1, "http://A.Example.net/en/x?q=1", "<article><p>one</p></article>"), (2, "https://b.example.net/de/", "<p>same</p>"),
    (3, "https://b.example.com/de/y#z", "<p>same</p>"), (4, None, None), (5, "no scheme", ""), (6, "ftp://x.org/fr/", "<p>same</p>"),
    (6, "ftp://x.org/fr/", "<p>same</p>"), (None, "http://x.org/", "<p>same</p>"), (7, "http://x.org?fr/", "é\r\n\r\nWARC/1.1\r\nx \x00 日本\n\n"),
    (8, "://", "a" * 200_000), (9, "http://EXAMPLE.net/en/", ""), (10, "http://sub.notexample.net/en/#", "<p>&lt;"), (11, "http://c.com/ a b\n", "x"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, PAGES).repartition(3)


@pytest.fixture(scope="module")
def no_pages(spark):
    return spark.createDataFrame([], PAGES)


def page_table(rows):
    cols = list(zip(*rows))
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["page_id", "url", "html"])


# --- urls


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in url_filters.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_url_rules(spark, pages, no_pages):
    got = {r.page_id: r for r in url_filters.url_filter(pages.withColumns({"host": F.lit("clash"), "n": F.lit(1)})).collect()}
    for i, url, _ in ROWS:
        host, path, best = brute_url(url)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, best and best[1]), url
        assert r.verdict == (best[0] if best else r.verdict) and r.by == ("rule" if best else "host") and r.verdict in ("allow", "block")
    assert rows_of(url_filters.url_filter(pages).drop("by")) == rows_of_sql(url_filters.ORACLE, pages=page_table(ROWS))
    assert got[1].rule == "example.net/en/" and got[2].rule == "net/" and got[3].rule == "example.com/de/" and got[6].rule == "org/fr/"
    assert url_filters.url_filter(pages).count() == len(ROWS) and url_filters.url_filter(no_pages).count() == 0


def brute_rank(edges, seeds, rounds=12, d=0.85):
    score = dict(seeds)
    out = {}
    for a, b, n in edges:
        out.setdefault(a, []).append((b, n))
    for _ in range(rounds):
        new = {h: (1 - d) * s for h, s in seeds.items()}
        for a, s in score.items():
            total = sum(n for _, n in out.get(a, []))
            for b, n in out.get(a, []):
                new[b] = new.get(b, 0) + d * s * n / total
        score = new
    return score


def test_propagation_equals_brute_force(spark):
    r = random.Random(1)
    hosts = [f"h{i}.com" for i in range(12)] + ["bad.net", "good.org"]
    rows = []
    for i in range(150):
        h = r.choice(hosts)
        to = [r.choice(hosts) for _ in range(r.randint(0, 4))]
        if h == "h0.com":
            to = ["bad.net"] * 2
        path = "/fr/x" if h == "good.org" else "/x"
        rows.append((i, f"http://{h}{path}", "".join(f'<a class=x href="//{t.upper()}/p">y</a>' for t in to)))
    pages = spark.createDataFrame(rows, PAGES)
    edges = {}
    for _, u, h in rows:
        src = brute_url(u)[0]
        for t in set(re.findall(r'//([^/"]+)', h)):
            if t.lower() != src:
                edges[src, t.lower()] = edges.get((src, t.lower()), 0) + 1
    e = [(a, b, n) for (a, b), n in edges.items()]
    trust, distrust = brute_rank(e, {"good.org": 1.0}), brute_rank([(b, a, n) for a, b, n in e], {"bad.net": 1.0})
    blocked = {h for h in distrust if round(distrust[h], 12) > 1e-6 and round(distrust[h], 12) > round(trust.get(h, 0), 12)}
    got = url_filters.url_filter(pages).collect()
    assert "h0.com" in blocked and len({r.host for r in got} - blocked) > 2
    for r in got:
        assert r.verdict == (("block" if r.host in blocked else "allow") if r.rule is None else r.verdict)
    own = {(x.src, x.dst): x.n for x in url_filters.host_edges(pages).collect()}
    assert own == edges
    assert rows_of(url_filters.url_filter(pages).drop("by")) == rows_of_sql(url_filters.ORACLE, pages=page_table(rows))


@pytest.mark.parametrize("seeds,linkers,idle", [(1, 1, 0), (1000, 200, 0), (100_000, 1, 0), (1, 130_000, 0), (1, 130_000, 100_000)])
def test_link_pattern_is_blocked_at_any_size(spark, seeds, linkers, idle):
    """Who links to a blocked host only is blocked, however many seeds there are and however many link to one."""
    n = seeds * linkers
    made = lambda k, url, html: spark.range(k).select(F.col("id").alias("page_id"), F.expr(url).alias("url"), F.expr(html).alias("html"))
    pages = made(n, "concat('http://l', id, '.com/x')", f"concat('<a href=\"http://s', id div {linkers}, '.net/\">y</a>')")
    pages = pages.union(made(seeds, "concat('http://s', id, '.net/')", "''")).union(made(idle, "concat('http://i', id, '.net/')", "''"))
    pages = pages.union(made(3, "concat('http://free', id, '.com/')", "'<a href=\"http://free9.com/\">y</a>'"))
    by = url_filters.url_filter(pages).filter("rule is null").groupBy("verdict").agg(F.count("*").alias("n"), F.min("host").alias("low")).collect()
    assert sorted((r.verdict, r.n, r.low) for r in by) == [("allow", 3, "free0.com"), ("block", n, "l0.com")]


# --- main text


def test_main_text_cases():
    tree = html_extraction.train()
    say = lambda h: html_extraction.main_text(h, tree)
    assert say(None) == say("") == say("<p>") == ""
    shell = "<html><head><title>T</title><style>p:x</style><script>var a='</p>';</script></head><body><header><a href=/>Home</a> Site</header><nav><ul><li><a>x</a></ul></nav>{}<footer>&copy; me</footer></body></html>"
    art = "<article><h1>Head &amp; line</h1><p>Ti.<p>One <b>two</b>\n three<br>four</p><!-- no --><ul><li>item<li>last</ul></article>"
    assert say(shell.format(art)) == "Head & line Ti. One two three four item last"
    for extra in (
        "<aside>side words here</aside>", '<div class="cookie-notice">We use cookies</div>', '<div id="ad-1">Buy this now</div>', "<form>Name <input> <button>Go</button></form>",
        '<section class="comments"><article><p>reader says a lot of words here</p></article></section>', '<div role="navigation">a b c</div>', "<noscript>enable it</noscript>",
    ):
        assert say(shell.format(extra + art + extra)) == "Head & line Ti. One two three four item last", extra
    for extra in ("<div>We changed our terms, please read them before you go on with this site today</div>", "<div class=x7><p>" + "Buy one and get one more " * 9 + "</p></div>", "<p>By the way.</p>"):
        assert say(shell.format(extra + art + extra)) == "Head & line Ti. One two three four item last", extra
    inner = art.replace("<ul>", "<aside>no</aside><div class='share'>no</div><form>no</form><ul>")
    assert say(shell.format(inner)) == "Head & line Ti. One two three four item last"
    assert say("<div><p>" + "long body text " * 20 + "</p><p>short.</p><p>" + "more body text " * 20 + "</p></div>").count("short.") == 1
    assert say("<article>a &lt;b&gt; &#233; &eacute &nbsp; x < y</article>") == "a <b> é é x < y"
    assert say('<article title="a > b"><p>q</p></article>') == "q"
    assert len(say("<article><p>" + "w " * 100_000 + "</p></article>")) == 199_999
    assert say("</div></p></article><article>ok</div> on") == "ok on"


def test_named_elements_drop_no_text():
    """Without <article> and <main>, a class like an article's on a title or a byline costs no other block."""
    tree = html_extraction.train()
    say = lambda h: html_extraction.main_text(h, tree)
    body = "some words of a body that is long enough to be one " * 25
    for name in ("article", "content", "main", "post", "entry", "story"):
        for head in (f'<h1 class="{name}-title">Title</h1>', f'<div class="{name}-meta">By X</div>', f'<div id="{name}"><span>By X</span></div>'):
            for wrap in ('<div class="text"><p>{}</p></div>', "<div>{}</div>", "<p>{}</p><p>{}</p>"):
                assert say(f"<body><div><a href=/>Home</a></div>{head}{wrap.replace('{}', body)}</body>").count("enough") == 25 * wrap.count("{}"), (head, wrap)
    assert say(f'<body><div>outer words</div><div class="content"><p>{body}</p></div></body>').count("enough") == 25


def test_link_lists_in_the_article_go():
    """Words and link density of a block and its neighbours judge what lies in an article's element too."""
    tree = html_extraction.train()
    say = lambda h: html_extraction.main_text(h, tree)
    long = "plain words of a body " * 12
    menu = "<ul>" + "".join(f"<li><a href=/{k}>{k} more</a></li>" for k in ("home", "news", "sport", "about")) + "</ul>"
    for wrap in ("<article>{}</article>", "<main>{}</main>", '<div id="content">{}</div>'):
        for inner in (f"{menu}<p>{long}</p><p>{long}</p>", f"<p>{long}</p>{menu}<p>{long}</p>", f"<p>{long}</p><p>{long}</p>{menu}"):
            out = say(wrap.format(inner))
            assert out.count("plain") == 24 and "more" not in out, (wrap, inner[:40])
        assert "see this" in say(wrap.format(f"<p>{long}</p><p><a href=/x>see this</a></p><p>{long}</p>"))
        assert "Two." in say(wrap.format(f"{menu}<p>Two.</p>{menu}<p>{long}</p>"))


@pytest.mark.parametrize("unit", ["<script ", "<div ", '<p title="', "<!--", "<a x'>'", "</x ", "<a '", "<b>", "<div>", "</section>", "<li>", "<i><div><b><b></i>", "&#9", "<!", 'class="', "</", "<p><td>"])
def test_odd_markup_takes_linear_time(unit):
    import time

    tree = html_extraction.train()
    for tail in ("", ">", "'", '">', "</div>"):
        page = unit * (500_000 // len(unit)) + tail
        began = time.process_time()
        html_extraction.main_text(page, tree)
        assert time.process_time() - began < 8, (unit, tail)  # quadratic forms took minutes


def test_unclosed_quotes_and_numbers():
    tree = html_extraction.train()
    say = lambda h: html_extraction.main_text(h, tree)
    assert say("<article><p title=\"x>one</p><p>two</p></article>") == "one two"
    assert say("<article>" + "<p title='>x</p>" * 21 + "</article>").count("x") >= 10
    assert say("<article><p>&#99999999999; &#" + "9" * 6000 + "; &#65;</p></article>") == "\ufffd \ufffd A"
    assert say("<article>a < b <c") == "a < b <c" and say("<article>a<!-- b") == "a" and say("<article>a<script>b</SCRIPT >c") == "a c".replace(" ", "")


def test_extract_rows(spark, pages, no_pages):
    got = html_extraction.extract(pages.withColumn("text", F.lit("clash"))).collect()
    assert len(got) == len(ROWS) and all(r.n_chars == len(r.text) for r in got) and {r.page_id: r.text for r in got}[4] == ""
    assert html_extraction.extract(no_pages).count() == 0


def test_extract_of_generated_pages(spark, small):
    import html

    src = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in html_extraction.op5_query(spark, small).collect():
        art = re.search(r"<article>(.*)</article>", src[r.page_id], re.S)[1]
        art = re.sub(r"</?b>", "", art)
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", art)).split())


def test_tree_fits_its_table():
    tree = html_extraction.train()
    wrong = sum(html_extraction.says(tree, x[:-1]) != x[-1] for x in html_extraction.LABELLED + html_extraction.OUTSIDE)
    assert wrong <= 2
    bare = lambda *blocks: html_extraction.main_text("".join(f"<div>{b}</div>" for b in blocks), tree)
    long = "many words of an article in a page that says nothing of its structure " * 6
    assert bare("<a>Home</a>", "<a>News</a>", long, "Short line.", long, "<a>More</a>", "<a>Next</a>").split(" ")[:2] == ["many", "words"]
    assert bare(long, long).count("structure") == 12 and "Home" not in bare("<a>Home</a>", "<a>News</a>", long, long)


# --- archives


def test_round_trip_equals_sql(spark, small, pages, tmp_path):
    assert rows_of(warc.op7_query(spark, small)) == rows_of_sql(warc.ORACLE, small)
    rows = [r for r in ROWS if r[0] is not None]
    df = spark.createDataFrame(rows, PAGES)
    a, w = str(tmp_path / "arc"), str(tmp_path / "warc")
    warc.write_arc(df, a, archive_bytes=50_000)
    warc.convert(spark, a, w)
    cols = list(zip(*rows))
    table = pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["page_id", "url", "html"])
    assert rows_of(warc.read_warc(spark, w)) == rows_of_sql(warc.ORACLE, pages=table)


def test_archive_cases(spark, pages, no_pages, tmp_path, monkeypatch):
    for k, (version, bound) in enumerate(((1, 10**6), (2, 0))):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", bound)
        a, w = str(tmp_path / f"a{k}"), str(tmp_path / f"w{k}")
        warc.write_arc(pages, a, version=version)
        back = warc.arc_records(spark, a).collect()
        assert sorted(bytes(r.payload) for r in back) == sorted((r[2] or "").encode() for r in ROWS)
        assert {r.page_id for r in back} == ({None} if version == 1 else {r[0] for r in ROWS})
        warc.convert(spark, a, w, least_bytes=3)
        got = warc.read_warc(spark, w).collect()
        assert len(got) == len(ROWS)
        if version == 1:
            assert all(r.record_type == "response" and r.refers_to is None for r in got)
        else:
            by = {r.page_id: r for r in got}
            assert (by[2].record_type, by[2].refers_to) == ("revisit", 6) and by[3].refers_to == 6
            assert [r.record_type for r in got if r.page_id == 6] == ["response"] * 2 and by[None].record_type == "response"
            assert by[5].record_type == by[9].record_type == "response"  # too small to revisit
            assert by[7].payload_digest == base64.b32encode(hashlib.sha1(ROWS[8][2].encode()).digest()).decode()
    warc.write_arc(no_pages, str(tmp_path / "a9"))
    warc.convert(spark, str(tmp_path / "a9"), str(tmp_path / "w9"))
    assert warc.read_warc(spark, str(tmp_path / "w9")).count() == 0


def test_warc_fields(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/x y", "hi"), (2, "http://b/", "hi")], PAGES)
    warc.write_arc(df.coalesce(1), str(tmp_path / "a"))
    warc.convert(spark, str(tmp_path / "a"), str(tmp_path / "w"))
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("part-*")))
    records = [(f, b) for f, b in warc.parse_warc(raw) if f["warc-type"] != "warcinfo"]
    one = next(f for f, _ in records if f["warc-record-id"] == "<urn:page:1>")
    assert one["warc-type"] == "revisit" and one["warc-refers-to"] == "<urn:page:2>" and one["warc-target-uri"] == "http://a/x%20y" and one["warc-date"] == "2024-01-01T00:00:00Z"
    two, block = next((f, b) for f, b in records if f["warc-record-id"] == "<urn:page:2>")
    assert block.endswith(b"\r\n\r\nhi") and two["warc-block-digest"] == "sha1:" + warc.digest(block) and two["warc-payload-digest"] == "sha1:" + warc.digest(b"hi")


def test_arc_versions_and_damage():
    for v in (1, 2):
        raw = warc.arc_start("n", v) + b"\n" + warc.arc_record("http://x", 3, b"pay\nload", v) + b"\n" + warc.arc_record(None, None, b"", v) + b"\n"
        for data in (raw, gzip.compress(raw), b"".join(gzip.compress(raw[i : i + 50]) for i in range(0, len(raw), 50))):
            got = [(f["URL"], warc.payload_of(b)[1]) for _, f, b in warc.parse_arc(data)]
            assert got == [("http://x", b"pay\nload"), ("-", b"")]
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"filedesc://x 0 0 t 4\n9 0 \n"))
    with pytest.raises(ValueError):
        list(warc.parse_arc(warc.arc_start("n", 1) + b"\nhttp://x 1.1.1.1 20200101 text/html extra 3\nabc\n"))
    with pytest.raises(ValueError):
        list(warc.parse_warc(b"HTTP/1.1 200\r\na: b\r\n\r\n"))
    assert warc.stamp("20200203") == "2020-02-03T00:00:00Z" and warc.stamp("2019") == "2019-01-01T00:00:00Z"


# --- embeddings

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_vectors(rows, least=0.93):
    ok = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and len(r[1]) and None not in r[1] and np.isfinite(np.float32(r[1])).all() and np.any(np.float32(r[1]))]
    cos = lambda a, b: float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)))
    v = [np.float32(r[1]).astype(float) for r in ok]
    n, pairs = [0] * len(ok), []
    for i in range(len(ok)):
        for j in range(len(ok)):
            if i != j and ok[i][2] == ok[j][2] and len(v[i]) == len(v[j]) and cos(v[i], v[j]) >= least:
                n[i] += 1
                pairs.append((ok[i][0], ok[j][0]))
    comp = brute_groups(pairs, {r[0] for r in ok})
    out = [(r[0], k, comp[r[0]], comp[r[0]] == r[0]) for r, k in zip(ok, n)]
    taken = {id(r) for r in ok}
    return sorted(out + [(r[0], 0, r[0], True) for r in rows if id(r) not in taken], key=str)


def vector_rows():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(240):
        base = rng.normal(size=12)
        for _ in range(rng.integers(1, 4)):
            rows.append((len(rows), [float(x) for x in np.float32(base + rng.normal(size=12) * 0.12)], int(i % 2)))
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(5)] + [(2000, [2 * x for x in rows[0][1]], rows[0][2])]
    nan, inf = float("nan"), float("inf")
    rows += [
        (3000, None, 0), (3001, [], 0), (3002, [0.0] * 12, 0), (3003, [nan] * 12, 0), (3004, [inf] + [1.0] * 11, 0), (3005, rows[0][1], None), (None, rows[0][1], 0),
        (3006, [None] + [1.0] * 11, 0), (3007, [1.0, 2.0], 0), (3008, [1.0, 2.0], 0), (3009, [1.0], 5), (3010, [3e38] * 12, 1), (3011, [1e-42] * 12, 1), (3012, [-0.0] * 11 + [1.0], 1),
    ]
    return rows


@pytest.mark.parametrize("shard", [40, 8192])
def test_vectors_equal_brute_force(spark, shard):
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS).withColumns({"node": F.lit("clash"), "m": F.lit(0), "vec": F.lit("x")}).repartition(3)
    got = sorted(map(tuple, embedding_dedup.embedding_dedup(df, shard=shard, beam=8).collect()), key=str)
    assert got == brute_vectors(rows)
    named = [pa.array(c, k) for c, k in zip(zip(*[r for r in rows if r[0] is not None]), (pa.int64(), pa.list_(pa.float32()), pa.int32()))]
    _, sql = rows_of_sql(embedding_dedup.ORACLE, embeddings=pa.table(named, names=["vec_id", "embedding", "label"]))
    assert sorted((v, n, c, k) for c, k, n, v in sql) == sorted(x for x in got if x[0] is not None)


def test_vector_edges(spark):
    none = spark.createDataFrame([], VECTORS)
    assert embedding_dedup.embedding_dedup(none).count() == 0
    only = spark.createDataFrame([(5, None, 1)], VECTORS)
    assert [tuple(r) for r in embedding_dedup.embedding_dedup(only).collect()] == [(5, 0, 5, True)]
    twice = spark.createDataFrame([(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1)], VECTORS)
    assert [tuple(r) for r in embedding_dedup.embedding_dedup(twice).collect()] == [(5, 1, 5, True)] * 2


def test_graph_recall():
    rng = np.random.default_rng(0)
    x = embedding_dedup.unit(rng.normal(size=(3000, 16)))
    g = embedding_dedup.Graph(np.arange(3000), x)
    ids, _ = g.nearest(x[:200], 32)
    want = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, want)]) >= 0.9
    assert (g.links[0] < 3000).all() and (np.sort(g.links[0], axis=1)[:, -1] >= 0).all()


def test_audit_widens_beams():
    rng = np.random.default_rng(1)
    x = embedding_dedup.unit(rng.normal(size=(1500, 24)))
    g = embedding_dedup.Graph(np.arange(1500), x, degree=2, beam=2)
    q = embedding_dedup.unit(rng.normal(size=(64, 24)))  # link with nothing: planted vectors are audited all the same
    for asks in (x, q):
        beam, true, found = embedding_dedup.audited(g, asks, 0.5, beam=2, recall=1.0)
        assert true >= embedding_dedup.AUDITED and found == true and (beam == 0 or beam > 2)
        got = embedding_dedup.Links(np.arange(len(asks)) + 5000 * (asks is q), np.arange(1500), np.ones(1500))
        embedding_dedup.near(g, asks, 0.5, beam, got) if beam else embedding_dedup.scan(g, asks, 0.5, got)
        sample = np.unique(np.linspace(0, len(asks) - 1, embedding_dedup.AUDITED).astype(int))
        assert (got.count[sample] == (asks[sample] @ x.T >= 0.5).sum(1) - (asks is x)).all()


def test_planted_vectors_link():
    x = embedding_dedup.unit(np.random.default_rng(5).normal(size=(300, 8)))
    g = embedding_dedup.Graph(np.arange(300), x)
    y = embedding_dedup.planted(g, 0.93)
    assert np.allclose((y * y).sum(1), 1) and ((y @ x.T).max(1) >= 0.93).all() and ((y @ x.T).max(1) < 0.9999).all()


def test_damaged_archives_are_listed(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a.com/{i}", "x" * 100) for i in range(6)], PAGES).withColumns({"path": F.lit("clash"), "content": F.lit(1), "digest": F.lit("y")})
    warc.write_arc(pages.repartition(2), str(tmp_path / "arc"))
    assert warc.damaged(spark, str(tmp_path / "arc")).count() == 0 and warc.arc_records(spark, str(tmp_path / "arc")).count() == 6
    file = sorted((tmp_path / "arc").glob("part-*.gz"))[0]
    raw = gzip.decompress(file.read_bytes())
    n = raw.count(b"http://a.com/")
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    file.write_bytes(gzip.compress(raw.rstrip(b"\n") + b"\nhttp://a.com/9 no header of any version\n"))
    with pytest.raises(Exception, match="fields"):
        warc.arc_records(spark, str(tmp_path / "arc")).count()
    row = warc.damaged(spark, str(tmp_path / "arc")).collect()
    assert len(row) == 1 and row[0].records == n and row[0].error.startswith("ValueError")
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"), strict=False)
    assert sorted(r.page_id for r in warc.read_warc(spark, str(tmp_path / "warc")).collect()) == list(range(6))


def test_links_come_from_graph_searches(spark):
    """Beams stay below their shards, every block is audited, and shards of one label find links in each other."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(900, 32))
    rows = [(int(i), [float(v) for v in b + rng.normal(size=32) * 0.15], 1) for i, b in enumerate(np.concatenate([base, base[:500], base[:100]]))]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    for shard, block in ((300, 200), (8192, 8192)):
        nodes, found = embedding_dedup.search(embedding_dedup.usable_rows(df), shard=shard, block=block, beam=8)
        audits = found.filter("kind = 'audit'").collect()
        shards, blocks = -(-1500 // shard), -(-1500 // block)
        assert len(audits) == shards * blocks
        assert all(r.a >= embedding_dedup.AUDITED and r.b >= 0.99 * r.a and 0 < r.n <= 64 for r in audits)
        x = embedding_dedup.unit(np.array([np.float32(r[1]) for r in rows]))
        assert found.filter("kind = 'count'").agg(F.sum("n")).first()[0] >= 0.99 * ((x @ x.T >= 0.93).sum() - 1500)
