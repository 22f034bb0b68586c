import base64
import hashlib
import io
import random

import pytest

from townledger.llm import html, warc
from townledger.llm.common import prepare, scratch


@pytest.fixture(scope="module")
def pages(spark):
    prepare(spark)
    rows = [(1, "http://a.example/x", "<p>one</p>"), (2, "http://a.example/y%20z?q=ü", "<p>one</p>"), (3, None, None), (4, "", ""), (None, "http://b.example", "<p>one</p>"),
            (5, "http://a.example/z", "ä" * 300000), (5, "http://a.example/z", "ä" * 300000), (6, "line\r\nbreak", "x\r\n\r\ny"), (7, "http://c.example", "é")]
    return spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "page_id long, url string, html string, key string, digest string, n_bytes int")


def test_archive(spark, pages):
    data = [(r.page_id, r.url, (r.html or "").encode()) for r in pages.collect()]
    for least in (0, 3):
        top = {}
        for i, _, p in data:
            if len(p) >= least:
                top[p] = max(top.get(p, -1), -1 if i is None else i)
        want = []
        for i, _, p in data:
            again = len(p) >= least and top[p] not in (-1, i)
            want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", top[p] if again else None))
        got = [tuple(r) for r in warc.archive(pages, min_bytes=least).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.archive(pages.limit(0)).count() == 0


def test_files_are_whole(spark, pages):
    folder = scratch(spark, "warc-test")
    files = warc.write(warc.plan(pages), folder)
    back = warc.read(files, folder).collect()
    assert sum(r.n_records for r in files.collect()) == pages.count() == len(back)
    assert {r.url for r in back} == {r.url or "" for r in pages.collect()}
    stored = {bytes(r.payload) for r in back if r.kind == "response"}
    assert stored == {(r.html or "").encode() for r in pages.collect()}


def test_frames_round_trip():
    rng = random.Random(1)
    for n in (1, 3, 400):
        records = [b" ".join(rng.choice([b"alpha", b"beta", b"gamma"]) for _ in range(rng.randint(0, 200))) for _ in range(n)]
        out = io.BytesIO()
        assert warc.write_file(out, iter(records)) == n
        assert list(warc.read_frames(io.BytesIO(out.getvalue()))) == records
    with pytest.raises(ValueError):
        list(warc.read_frames(io.BytesIO(out.getvalue()[:-5])))


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_lines():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        got = html.common_lines(a, b)
        assert got == sorted(set(got)) and len(got) == lcs(a, b)
        rest = iter(b)
        assert all(x in rest for x in (a[i] for i in got))


CASES = [
    ("<nav>menu</nav><article><h1>A &amp; B</h1><p>x <b>y</b>z<br>w\n\t q<p>next</article><footer>f</footer>", "A & B x yz w q next"),
    ("<body><article><header><h1>T</h1></header><p>t</p><div class='ad box'>buy</div><aside>s</aside><form>f</form><section id=comments><p>c</p></section></article>", "T t"),
    ("<main><div class=\"cookie-notice\">ok?</div><p>a<script>var t='</p>';</script>b</p><style>p{}</style><!-- c --></main>", "ab"),
    ("<article><p>cut &am", "cut &am"), ("<article><p>cut <b cl", "cut"), ("<article>&lt;tag&gt; &#233;&nbsp;x</article>", "<tag> é x"),
    (None, ""), ("", ""), ("plain  text", "plain text"),
]


def test_markup(spark):
    prepare(spark)
    df = spark.createDataFrame([(i, None if i % 2 else f"http://h{i}.example/", h, 1) for i, (h, _) in enumerate(CASES)], "page_id long, url string, html string, key int")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(df).collect()}
    # pages without a url are one host; none of them shares lines here
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(CASES)}
    assert html.extract(df.limit(0)).count() == 0


def test_nearest_pages_without_article(spark):
    """Two sites whose template is known by comparison only; a third of all pages are on one host, over many ranges."""
    prepare(spark)
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(400):
        host = "big" if i % 3 == 0 else f"h{i % 7}"
        body = [f"text {i} {k} {rng.random()}" for k in range(rng.randint(1, 4))]
        rows.append((i, f"https://{host}.example/p/{rng.randrange(10 ** 6)}", f"<div>Top of {host}</div>" + "".join(f"<p>{x}</p>" for x in body) + f"<div>Bottom of {host}</div>"))
        want[i] = " ".join(body)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract(df).collect()} == want


def test_lines_outside_articles_are_compared_and_copies_are_not_neighbours(spark):
    """Lines outside an article go only where the nearest page has them; groups of copies over many ranges keep their text."""
    prepare(spark)
    rows, want = [], {}

    def add(host, path, parts, text):
        rows.append((len(rows), f"https://{host}.example/{path}", "".join(parts)))
        want[len(rows) - 1] = text

    for i in range(30):
        add("news", f"p/{i:03d}", ["<div>Top</div>", f"<div>Lead {i}</div><article><p>Body {i}</p><p>quoted</p></article>", "<p>quoted</p><div>End</div>"], f"Lead {i} Body {i} quoted")
    for i in range(60):
        page = i // 20  # three groups of copies
        add("copies", f"{page}/{i:03d}", ["<div>Top</div>", f"<p>Text {page}</p>", "<div>End</div>"], f"Text {page}")
    for i in range(3):
        add("only", f"{i}", ["<div>Top</div><article>A</article>"], "Top A")
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {r.page_id: r.text for r in html.extract(df).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("page, text", [
    ("<div class='content has-sidebar'><article>kept</article></div>", "kept"),
    ("<div id='layout-no-sidebar'><article>kept</article></div>", "kept"),
    ("<article class='post category-social tag-search'>kept</article>", "kept"),
    ("<article><section class='share-enabled'>kept</section></article>", "kept"),
    ("<div class='sidebar'>side<article class='promo'>kept<div class='ad'>buy</div></article>side</div>", "kept"),
    ("<div class='page-header'><main>kept</main>top</div>", "kept"),
    ("<article>kept<section id='comments'><article class='comment'>c</article></section><article class='comment'>c</article></article>", "kept"),
    ("<article>kept<div class='Social_Share'>x</div><ul class='share-buttons'><li>x</ul><div id='ad-728x90'>x</div><p id=comment-12>x</p></article>", "kept"),
    ("<div class='wp-block-ad'>x</div><div role=banner>x</div><div id='site-navigation'>x</div><p>kept", "kept"),
    ("<div hidden=''><article>x</article></div><nav><main>x</main></nav><p>kept", "kept"),
])
def test_class_names_count_as_a_whole(page, text):
    assert " ".join(x for x, _ in html.lines(page)) == text
