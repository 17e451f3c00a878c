import re
import time
from html.parser import HTMLParser

import pytest

from granary.llm import html_extract as H
from granary.llm import warc

PAGE = "<html><head><title>t</title><style>p{}</style></head><body><header>site</header><nav>menu</nav><article><h1>A &amp; B</h1><p><b>one\n two<br>three<p>four <i>fi</i>ve<script>var x='</p>'</script><aside>side</aside><div class='cookie-notice'>notice</div><form>x<input></form><ul><li>a<li>b</ul><section id=comments><p>hey</section></article><footer>f</footer></body>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (PAGE, "A & B\n\none two three\n\nfour five\n\na\n\nb"), ("", ""), (None, ""), ("plain &lt;text&gt; &eacute;&#65;", "plain <text> éA"), ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\n\nd"),
        ("<main><p>m</p></main><p>out</p>", "m"), ("<script>never closed", ""), ("a < b &amp;lt; c", "a < b &lt; c"), ("<p>x&nbsp;&nbsp;y z</p>", "x y z"), ("<!-- <p>no</p> --><p>yes", "yes"),
        ("<article><header><h1>T</h1><span>by me</span></header><p>x</p></article>", "T\n\nx"), ("<ARTICLE><P CLASS='lead'>Up</P></ARTICLE>", "Up"), ("<div role=navigation>n</div><div>text</div>", "text"),
        ('<article><div class="entry-header"><h1>Title</h1></div><p>Body</p></article>', "Title\n\nBody"), ("<form><input><main><p>m text</p></main></form>", "m text"),
        ('<article><h1>x</h1><p>text of the article</p><section id="related-work"><p>w</p></section></article>', "x\n\ntext of the article\n\nw"),
        ("<p>a <img src=x> b <button>no</button>c<script>z</script>d</p>", "a b cd"), ('<article><p>a main text</p><p>q <span class="ad">buy</span> r</p></article>', "a main text\n\nq r"),
        ("<a title='x>y'>z</a> <!---->w", "z w"), ("<p>a</p><div class=x'>b", "a\n\nb"), ("<article><p>the text</p><div id='site-comments'>c</div><form>f</form></article>", "the text"),
    ],
)
def test_main_text(html, want):
    assert H.main_text(html) == want


@pytest.mark.parametrize(
    "html",
    ["<div>x" * 100_000, "<a '" * 250_000, "<ul>" + "<div>" * 50_000 + "<li>x" * 50_000, "<div>" * 50_000 + "</p></b>" * 50_000, '<a "' * 200_000 + ">", "<p><b>" * 100_000, "<" * 500_000, "<!" * 500_000, "<script" * 100_000 + ">", "<x" * 300_000 + "y" * 9],
)
def test_broken_and_deep_pages_take_linear_time(html):
    begin = time.process_time()
    H.main_text(html)
    assert time.process_time() - begin < 10


class Twin(HTMLParser):
    """Text of the article by the standard library's parser: another reader of the same pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [[]]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag == "br":
            self.blocks[-1].append(" ")
        elif tag not in ("b", "a"):
            self.blocks.append([])

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        if tag not in ("b", "a"):
            self.blocks.append([])

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1].append(data)


def test_extraction_agrees_with_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    assert got.keys() == html.keys()
    for k, x in html.items():
        twin = Twin()
        twin.feed(x)
        assert got[k] == "\n\n".join(b for block in twin.blocks if (b := " ".join("".join(block).split())))


def test_templates_are_counted_alike_when_joined(spark):
    boxes = [f"<div>box {k} <ul><li>a<li>b</ul></div>" for k in range(4)]
    rows = [(i, f"https://h{i % 3}.example/{i}", f"<body>{boxes[i % 4]}<div><p>page {i} has its own long text here</p></div></body>") for i in range(120)]
    df = spark.createDataFrame([*rows, (None, None, rows[0][2]), (7, *rows[7][1:])], "page_id long, url string, html string").repartition(3)
    one, other = (sorted(map(str, H.extract(df, broadcast=n).collect())) for n in (500_000, 0))
    assert one == other
    text = {r.page_id: r.text for r in H.extract(df).collect()}
    assert all(text[i] == f"page {i} has its own long text here" for i in range(120)) and text[None].startswith("box 0")
    untouched = {r.page_id: r.text for r in H.extract(df, min_pages=1000).collect()}
    assert all(untouched[i] != text[i] for i in range(120))


def test_templates_go_and_copies_stay(spark):
    box = "<div><div>Follow our letters</div></div>"
    rows = [(i, f"http://u:p@Host.example:80/{i}", f"<body><article><p>text number {i}</p><p>shared paragraph</p>{box}</article></body>") for i in range(8)]
    rows += [(i, f"https://copies.example/{i}", f"<body><article><div><p>the same</p></div>{box}</article></body>") for i in range(100, 120)]
    rows += [(i, f"https://bare.example/{i}", f"<body><div>links of the site</div><div><p>own text {i}</p></div></body>") for i in range(200, 208)]
    rows += [(300, None, None), (None, "x", "<p>no id</p>"), (301, "https://other.example/", f"<article><p>t</p>{box}</article>"), (0, "http://host.example/0", rows[0][2])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in H.extract(df).collect()}
    assert len(got) == len(rows)
    assert all(n == len(t) for t, n in got.values())
    text = {k[0]: v[0] for k, v in got.items()}
    assert text[3] == "text number 3\n\nshared paragraph"
    assert text[105] == "the same\n\nFollow our letters" and text[301] == "t\n\nFollow our letters"
    assert text[203] == "own text 203" and text[300] == "" and text[None] == "no id"
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_templates_on_a_tenth_of_a_hot_host_go(spark):
    box = "<div><div>Nur auf deutschen Seiten</div></div>"
    rows = [(i, f"https://hot.example/{i}", f"<body><article><p>text number {i}</p>{box if i % 10 == 0 else ''}</article></body>") for i in range(300)]
    rows += [(1000 + i, f"https://rare.example/{i}", f"<body><article><p>text number {i}</p>{box if i < 4 else ''}</article></body>") for i in range(12)]
    text = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(text[i] == f"text number {i}" for i in range(300))
    assert text[1000] == "text number 0\n\nNur auf deutschen Seiten"


def test_extraction_of_the_pages(spark):
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in H.extract(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?p>|</?h1>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_warc_records():
    source = warc.response("7", "http://h/a b", "<html lang='en'><title>T &amp; t</title><p>one <a href='x?a&amp;b'>l</a><p>two é".encode())
    (at, size, back), = warc.members(warc.member(source))
    assert (at, back) == (0, source) and size == len(warc.member(source))
    meta, text = warc.derive(back)
    assert text.block.decode() == "T & t\none l\ntwo é"
    assert b"outlink: x?a&b a/href" in meta.block and b"http-header-content-type: text/html" in meta.block and b"language: en" in meta.block
    for r, other in ((meta, text), (text, meta)):
        assert r.get("WARC-Refers-To") == source.get("WARC-Record-ID") and r.get("WARC-Concurrent-To") == other.get("WARC-Record-ID")
        assert r.get("WARC-Source-Payload-Digest") == source.get("WARC-Payload-Digest") and r.get("WARC-Block-Digest") == warc.digest(r.block)
        assert r.get("WARC-Target-URI") == "http://h/a b" and int(r.get("Content-Length")) == len(r.block)
    file = b"".join(map(warc.member, (source, meta, text)))
    assert [r for _, _, r in warc.members(file)] == [source, meta, text]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(file[:-9]))
    broken = warc.Record(source.fields, source.block.replace(b"one", b"0ne"))
    with pytest.raises(ValueError, match="digest"):
        warc.derive(broken)
    folded = b"WARC/1.0\r\nWARC-Type: response\r\nX: a\r\n b\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert next(warc.parse(folded)).get("x") == "a b"


def test_digests_of_other_kinds():
    import base64
    import hashlib

    data = b"payload"
    for name in ("md5", "sha1", "sha256", "sha512"):
        own = hashlib.new(name, data).digest()
        for value in (own.hex(), own.hex().upper(), base64.b32encode(own).decode(), base64.b32encode(own).decode().lower()):
            assert warc.matches(f"{name.upper()}:{value}", data) and not warc.matches(f"{name}:{value}", data + b"x")
    assert warc.matches("blake9:abc", data)


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "<p>x"), (2, None, None), (None, "http://c/\nd", ""), (1, "http://a/", "<p>x")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, type string")
    got = warc.round_trip(df).collect()
    assert len(got) == 8 and sorted({r.type for r in got}) == ["conversion", "metadata"]
    assert len({r.record_id for r in got}) == 6 and {r.page_id for r in got} == {1, 2, None}
    assert {r.refers_to for r in got if r.page_id == 2} == {warc.response("2", "", b"").get("WARC-Record-ID")}
    for i, f in enumerate(warc.archive(df).collect()):
        (tmp_path / f"f{i}.warc.gz").write_bytes(f.file)
    assert warc.derivatives(warc.read(spark, str(tmp_path))).count() == 8
    plain = b"".join(r.dump() for f in warc.archive(df).collect() for _, _, r in warc.members(f.file))
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "all.warc").write_bytes(plain)
    assert [r for _, _, r in warc.members(plain)] == list(warc.parse(plain)) and sum(n for _, n, _ in warc.members(plain)) == len(plain)
    assert warc.derivatives(warc.read(spark, str(tmp_path / "plain"))).count() == 8 and warc.derivatives(warc.read(spark, str(tmp_path))).count() == 16
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
