import os
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import html_extract as H

COLUMNS = "page_id long, url string, html string, text string, host string"


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var x='</p>';</script></head><body>{body}</body></html>"


def run(spark, rows):
    df = spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h in rows], COLUMNS)
    return {r.page_id: r.text for r in H.extract(df).collect()}


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abce"), max_size=12))
@settings(deadline=None, max_examples=300)
def test_common_is_a_longest_common_subsequence(a, b):
    kept = [a[k] for k in sorted(H.common(a, b))]
    rest = iter(b)
    assert all(x in rest for x in kept) and len(kept) == lcs(a, b)


@given(st.text(alphabet="<>/!-\"'= apdiv&;#x", max_size=60))
@settings(deadline=None, max_examples=300)
def test_malformed_markup_never_fails(s):
    for text, kind in H.lines(s):
        assert text == " ".join(text.split()) and kind in (0, 1, 2)


def test_differencing_removes_what_a_host_repeats(spark):
    def site(k):
        return page(f"<div>Our site</div><div>Menu &amp; more</div><p>Story {k} begins.</p><p>It   goes\n on <b>{k}</b>.</p><div>All rights</div>")

    rows = [(k, f"http://h.example/a/{k}", site(k)) for k in range(9)] + [(20, "http://lone.example/x", site(20))]
    got = run(spark, rows)
    assert all(got[k] == f"Story {k} begins.\n\nIt goes on {k}." for k in range(9))
    assert got[20].startswith("Our site\n\nMenu & more\n\nStory 20")


def test_article_lines_stay_and_furniture_goes(spark):
    body = '<nav><ul><li><a href="/x">X</a></li></ul></nav><div class="ad">Buy</div><article><h1>T</h1><p>Same line<p>Caf&eacute;&nbsp;&#x41;<aside>side</aside><form>f</form></article><div id="comments">c</div><footer>&copy; z</footer>'
    got = run(spark, [(1, "http://h/a", page(body)), (2, "http://h/b", page(body + "<p>outside</p>")), (3, "http://h/c", page(body).replace("</body></html>", ""))])
    # what only one page has outside its article is the page's own; differencing keeps it
    assert got == {1: "T\n\nSame line\n\nCafé A", 2: "T\n\nSame line\n\nCafé A\n\noutside", 3: "T\n\nSame line\n\nCafé A"}


def test_differencing_decides_what_stands_beside_an_article(spark, monkeypatch):
    """Unmarked blocks that all pages of a host repeat go; a page's own stay; without differencing they would all stay."""
    rows = [(k, f"http://h/{k}", page(f"<div>Our site since 1999</div><article><p>Story {k}.</p></article><div>Epilogue {k}.</div><div>Imprint</div>")) for k in range(6)]
    assert run(spark, rows) == {k: f"Story {k}.\n\nEpilogue {k}." for k in range(6)}
    assert H.main_text(H.lines(rows[0][2]), []) == "Our site since 1999\n\nStory 0.\n\nEpilogue 0.\n\nImprint"


def test_compound_names_inside_an_article():
    kept = '<section class="related-work">a</section><div id="share-price">b</div><p>c <math><mi>x</mi></math></p><object>d</object><svg><text>e</text></svg>'
    gone = '<div class="reader-comments">c</div><div class="ad-slot">c</div><div class="cookie-banner">c</div><div class="notice">c</div>'
    assert [t for t, k in H.lines(f"<article>{kept}{gone}</article>") if k == H.ARTICLE] == ["a", "b", "c x", "de"]
    assert [k for _, k in H.lines('<div class="related-work">a</div><div class="site-header">b</div><p>c</p>')] == [H.FURNISHED, H.FURNISHED, H.PLAIN]


def slow(rows):
    """Pairing and differencing by plain loops: of the pages of a host whose lines differ, the nearest in order on each side;
    of these the one whose path agrees longest; a line that some longest common subsequence shares goes."""
    out = {}
    order = sorted(rows, key=lambda r: (r[1].split("/")[2].lower(), "/" + r[1].split("/", 3)[3], r[1], f"{r[0]:020d}"))
    text = {r[0]: [t for t, _ in H.lines(r[2])] for r in rows}
    for at, (i, url, _) in enumerate(order):
        host, path = url.split("/")[2], "/" + url.split("/", 3)[3]
        near = []
        for side in (order[:at][::-1], order[at + 1 :]):
            near += [next((r for r in side if r[1].split("/")[2] == host and text[r[0]] != text[i]), None)]
        near = [r for r in near if r]
        near.sort(key=lambda r: -len(os.path.commonprefix([path, "/" + r[1].split("/", 3)[3]])))
        out[i] = (text[i], text[near[0][0]]) if near else (text[i], [])
    return out


def test_pairing_and_differencing_by_plain_loops(spark):
    """Random sites without markup that tells anything, copies included, over several ranges."""
    rng = random.Random(6)
    rows = []
    for k in range(240):
        body = ["Our site", f"host line {k % 3}", *[f"own {rng.randrange(60)}" for _ in range(rng.randrange(4))], rng.choice(("foot", "foot b")), "All rights"]
        rows.append((k, f"http://h{k % 3}.example/{rng.choice('abc')}/{rng.randrange(40)}", page("".join(f"<div>{x}</div>" for x in body))))
        if k % 7 == 0:
            rows.append((1000 + k, rows[-1][1] + "x", rows[-1][2]))
    got = run(spark, rows)
    for i, (own, other) in slow(rows).items():
        left = got[i].split("\n\n") if got[i] else []
        rest = iter(own)
        # what is left is the page's lines in order without a longest common subsequence
        assert all(x in rest for x in left) and len(own) - len(left) == lcs(own, other), (i, own, other, left)


def test_a_very_long_page(spark):
    body = "".join(f"<p>paragraph {k} &amp; more</p>" for k in range(60_000))
    got = run(spark, [(1, "http://h/a", page("<div>top</div>" + body)), (2, "http://h/b", page("<div>top</div><p>short</p>"))])
    assert got[2] == "short" and got[1].count("\n\n") == 59_999 and got[1].startswith("paragraph 0 & more")


def test_an_article_keeps_its_own_header():
    body = '<div class="site-header">site</div><article><header><h1>T</h1></header><div class="post-header">by</div><p>x</p><section class="reader-comments"><p>c</p></section></article>'
    assert [t for t, k in H.lines(page(body)) if k == H.ARTICLE] == ["T", "by", "x"]


def test_a_run_of_copies_looks_past_itself(spark):
    """Copies of a page under neighbouring URLs have one text, wherever they stand in the run and however ranges cut it."""
    body = "<div>Our site</div><p>Copied {}.</p><div>All rights</div>"
    rows = [(0, "http://h/a/0", page(body.format("a"))), *[(k, f"http://h/b/{k}", page(body.format("b"))) for k in range(1, 60)], (60, "http://h/c/60", page(body.format("c")))]
    got = run(spark, rows)
    assert [got[k] for k in range(61)] == ["Copied a.", *["Copied b."] * 59, "Copied c."]


def test_awkward_and_empty(spark):
    rows = [(1, None, None), (2, "http://h/a", ""), (3, "http://h/a", "plain < text"), (3, "http://h/a", "plain < text"), (None, "", "<p>x"), (5, "http://h/b", page("<article></article><p>only this</p>"))]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], COLUMNS)
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in H.extract(df).collect()))
    assert got == [(0, "x", 1), (1, "", 0), (2, "", 0), (3, "plain < text", 12), (3, "plain < text", 12), (5, "only this", 9)]
    assert H.extract(df.filter("false")).collect() == []


def test_order_does_not_depend_on_partitions(spark):
    rows = [(k, f"http://h{k % 3}.example/p/{k % 50}", page(f"<p>common</p><p>own {k}</p><p>{'pair' if k % 2 else 'odd'}</p>")) for k in range(300)]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], COLUMNS)
    a = sorted(map(tuple, H.extract(df).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert sorted(map(tuple, H.extract(df.repartition(5)).collect())) == a
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_matches_the_articles_of_the_table(spark):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|li|div)\b[^>]*>", inner)
        assert got[r.page_id] == "\n\n".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in blocks) if x)
