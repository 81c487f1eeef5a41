"""Operators over pages."""

import gzip
import math
import random

import pytest

from lumicat.llm import html_extract, tags, url_filter, warc
from lumicat.llm.base import ready

HTML = """<html><head><title>t</title><style>x</style></head><body><header>Site</header><nav><a href=/>menu</a></nav><div id="c-{k}"><div class="entry post-{k}">
<h1>T &amp; {k}</h1><p>one  two<br>three <p>four <a href=x>five</a> <b>six<i>y</b></i> z</p><ul><li>a<li>b</ul><form><input>no</form><p>{words}</p>
<div class="comments"><p>{words} bad</div><script>if(a<b)"</p>"</script><!-- <p>no --></div></div><div class="sidebar">{words}</div><div class="with-sidebar"></div><footer>no</footer>"""


@pytest.fixture(scope="module", autouse=True)
def session(spark):
    ready(spark)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS text", "3 AS _path", "4 AS verdict")


def rows():
    words = "some words that make the text long enough " * 3
    out = [(k, f"http://H{k % 2}.example.com/p/{k}", HTML.format(k=k, words=words)) for k in range(6)]
    out += [(10, "http://h0.example.com/none", "<p>only this"), (11, "http://h0.example.com/", None), (12, None, ""), (13, "no host", "plain &lt;text&gt; &eacute;é"),
            (14, "http://h1.example.com", "<" * 2000), (15, "http://x", "<div>" * 3000 + "deep" + "</div>" * 3000), (0, "http://h0.example.com/p/0", out[0][2]), (None, "", "<p>x</p>y")]
    return out


def test_extraction(spark):
    got = html_extract.extract(pages(spark, rows()))
    assert got.columns == ["page_id", "url", "text"]
    by = {r.page_id: r.text for r in got.collect()}
    assert got.count() == len(rows())
    for k in range(6):
        assert by[k] == f"T & {k}\none two three\nfour five sixy z\na\nb\n" + " ".join(("some words that make the text long enough " * 3).split())
    assert (by[10], by[11], by[12], by[13], by[15], by[None]) == ("only this", "", "", "plain <text> éé", "deep", "x\ny")
    paths = {r._host: r._path for r in html_extract.host_paths(pages(spark, rows())).collect()}
    assert paths["h1.example.com"] == ">body>div.c-#>div.entry.post-#"
    assert html_extract.extract(pages(spark, []) ).count() == 0


def test_host_path_wins_over_a_single_page(spark):
    """A page whose longest container is a list of teasers still gives its article's part."""
    usual = "<div class=main><p>" + "text of the page " * 9 + "</div><div class=other><p>short</div>"
    odd = "<div class=main><p>its own text</div><div class=other><p>" + "teaser text " * 40 + "</div>"
    got = html_extract.extract(pages(spark, [(k, "http://a/", usual) for k in range(5)] + [(9, "http://a/x", odd)]))
    assert {r.page_id: r.text for r in got.collect()}[9] == "its own text"


def test_an_article_is_whole_whatever_it_is_built_of(spark):
    """Lists, tables, quotes, inner divs, leads and titles; boxes that repeat stay out; two templates on one host."""
    def words(k, n):
        return " ".join(f"w{k}x{j}" for j in range(n))

    box = "<div class=box><p>" + "the same on every page " * 3 + "</div>"
    shapes = {
        "list": lambda k: f"<div class=post><h1>title {k}</h1><p>{words(k, 15)}</p><ul><li>{words(k, 40)}</li><li>more {k}</li></ul></div>{box}",
        "table": lambda k: f"<div class=post><h2>title {k}</h2><p>lead {k}</p><table><tr><td>{words(k, 40)}</td><td>cell {k}</td></tr></table><blockquote>said {k}</blockquote></div>{box}",
        "nested": lambda k: f"<div class=wrap><div class=post><h1>title {k}</h1><div class=lead>lead {k}</div><div class=body><p>{words(k, 50)}</p></div></div>{box}</div>",
        "loose": lambda k: f"<h1>title {k}</h1><div class=body><p>{words(k, 50)}</p></div>",
    }
    given, want = [], {}
    for n, (name, shape) in enumerate(shapes.items()):
        for k in range(4):
            given.append((10 * n + k, f"http://{name}/", shape(k)))
    for k in range(4):
        given += [(100 + k, "http://two/", shapes["list"](k)), (110 + k, "http://two/", f"<div class=item><p>{words(k, 30)}</p><div class=more>more {k}</div></div>{box}")]
    given.append((200, "http://one/", shapes["nested"](7).replace(box, "")))
    for k in range(4):
        listed = f"title {k}\n{words(k, 15)}\n{words(k, 40)}\nmore {k}"
        want |= {k: listed, 10 + k: f"title {k}\nlead {k}\n{words(k, 40)}\ncell {k}\nsaid {k}", 20 + k: f"title {k}\nlead {k}\n{words(k, 50)}",
                 30 + k: f"title {k}\n{words(k, 50)}", 100 + k: listed, 110 + k: f"{words(k, 30)}\nmore {k}"}
    want[200] = f"title 7\nlead 7\n{words(7, 50)}"
    assert {r.page_id: r.text for r in html_extract.extract(pages(spark, given)).collect()} == want


def test_real_pages_next_to_a_plain_reading(spark):
    import html
    import re

    got = {r.page_id: r.text for r in html_extract.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        article = r.html[r.html.index("<article>") + 9: r.html.index("</article>")]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_a_word_of_a_class_does_not_decide_alone(spark):
    body = "what the article says at some length " * 6
    text = " ".join(body.split())
    shapes = [
        ('<div class="content-sidebar-wrap"><main><article><h1>T {k}</h1><p>{b} {k}</p></article></main><aside>no</aside></div>', "T {k}\n{t} {k}"),
        ('<div class="box">teaser text</div><article class="post category-cookies tag-share"><h1>T {k}</h1><p>{b} {k}</p></article>', "T {k}\n{t} {k}"),
        ('<article><header class="entry-header"><h1>T {k}</h1></header><p>{b} {k}</p></article>', "T {k}\n{t} {k}"),
        ('<article><header class="post-header"><h2 class="header">T {k}</h2></header><p>{b} {k}</p></article>', "T {k}\n{t} {k}"),
        ('<article><h1>T {k}</h1><div class="article-tags-and-text"><p>{b} {k}</p></div><div class="social share">no</div></article>', "T {k}\n{t} {k}"),
        ('<div class="wrapper has-sidebar"><div class="main-nav-body"><h1>T {k}</h1><p>{b} {k}</p></div><div class="sidebar"><p>no</p></div></div>', "T {k}\n{t} {k}"),
        ('<article><h1>T {k}</h1><p>{b} {k}</p></article><div class="comments"><p>{b} {b} {b} no</p></div>', "T {k}\n{t} {k}"),
        ('<article><h1>T {k}</h1><p>{b} {k}</p><div class="comments"><p>{b} {b} {b} no</p></div></article>', "T {k}\n{t} {k}"),
    ]
    given = [(10 * s + k, f"http://s{s}.example/{k}", f"<html><body>{shape.format(k=k, b=body)}<footer>no</footer>") for s, (shape, _) in enumerate(shapes) for k in range(6)]
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, given)).collect()}
    assert got == {10 * s + k: want.format(k=k, t=text) for s, (_, want) in enumerate(shapes) for k in range(6)}


def test_broken_pages_take_time_with_their_length():
    import time

    for part, after in (('<a "', ""), ("<a ", ""), ("<script ", ""), ("<script>", ""), ('<a ">" ', ""), ("<b>", "</i>" * 300_000), ("<div>", "x"), ("<a<a", ">"), ("<!--", ""), ("<a \"'>", ""), ('<p class="comments">', "x")):
        page = part * (1_000_000 // len(part)) + after
        began = time.process_time()
        html_extract.Page(page).own_text()
        tags.without_tags(page)
        assert time.process_time() - began < 10, part


def test_tags_of_a_page():
    page = "a<B x='>'>b<!-- <p> -->c</B ><script>if (a<b) '</p>'</script >d<1 e< f<!doctype x>g<i y=\"h>k"
    assert [(t.name, t.closing) for t in tags.tags(page)] == [("b", False), ("", False), ("b", True), ("script", False), ("", False), ("i", False)]
    assert tags.without_tags(page) == "a b c  d<1 e< f g k"
    assert tags.without_tags("") == "" and tags.without_tags("<script>never closed <p>") == " "


def test_urls(spark):
    given = [
        (1, "http://WWW.Example.NET/en/1?x#y", ""), (2, "https://a.example.net/fr/1", ""), (3, "http://badexample.net/en/", ""), (4, "http://x.example.com/de/1", ""),
        (5, "http://x.org/fr/", ""), (6, "http://x.org", ""), (7, None, None), (8, "mailto:a@b", ""), (9, "http://x.org?u=http://y.net/", ""), (10, "http://free-cheap-pills.example.com/en/1", ""),
        (11, "http://cheappills.example.com/x", "cheap pills"), (12, "http://gardenwork.example.com/x", "<p>garden work garden work</p>"), (1, "http://WWW.Example.NET/en/1?x#y", ""),
        (13, "http://" + "a" * 5000 + ".com/" + "b" * 50_000, ""), (14, "://net/", "")]
    df = pages(spark, given)
    got = url_filter.judge(df).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(given)
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("www.example.net", "/en/1", "example.net/en/", "allow")
    assert (by[2].rule, by[2].verdict) == ("net/", "block")
    assert (by[3].rule, by[4].rule, by[5].rule, by[6].rule, by[14].rule) == ("net/", "example.com/de/", "org/fr/", None, "net/")
    assert (by[7].host, by[7].path, by[8].host, by[9].host, by[9].path) == ("", "", "", "x.org", "")
    assert (by[10].verdict, by[11].verdict, by[12].verdict, by[7].verdict) == ("block", "block", "allow", "allow")
    assert by[11].words == "cheap pills example x" and by[12].words == "garden work example x"
    assert url_filter.judge(df.limit(0)).count() == 0


def test_no_word_of_the_pages_is_left_out(spark):
    """More words than a list would hold, all seen once: the last of them by the alphabet is known, and each counts for the verdict."""
    def letters(k):
        return "".join(chr(97 + k // 26**j % 26) for j in range(4))

    many = " ".join("a" + letters(k) for k in range(70_000))
    given = [(k, f"http://x.org/{' '.join('b' + letters(70 * j + k) for j in range(1_000))}", many if not k else "") for k in range(70)]
    given += [(100, "http://zebrazucchini.example.com/", "zebra zucchini"), (101, "http://casino.example.com/zz", ""), (102, "http://x.org/zz", "")]
    by = {r.page_id: r for r in url_filter.judge(pages(spark, given)).collect()}
    assert by[100].words == "zebra zucchini example"
    # by hand: 72 pages allowed, 1 blocked; words of the class to block: casino, example, zz and the strong seeds
    strong, seeds = len(url_filter.SEEDS) - len(url_filter.WEAK), len(url_filter.SEEDS)
    paths = {w for k in range(70) for w in given[k][1][13:].split()}
    kinds = len(paths) + 6 + 1 + seeds  # x, zebra, zucchini, example, casino, zz
    good, bad = 70 * 1_000 + 71 + 3 + 1, 3 + strong

    def odds(b, g):
        return math.log((b + 1) / (bad + kinds)) - math.log((g + 1) / (good + kinds))

    want = math.log(2 / 73) + odds(0, 71) + odds(1, 1)
    assert abs(by[102].score - 1 / (1 + math.exp(-want))) < 1e-9
    want = math.log(2 / 73) + odds(0, 71) + sum(odds(0, 1) for _ in range(1_000))
    assert abs(by[69].score - 1 / (1 + math.exp(-max(-35, min(35, want))))) < 1e-9


def test_segmentation_is_the_most_probable():
    rng = random.Random(1)
    model = url_filter.Unigrams({w: math.log(p) for w, p in {"a": 0.1, "ab": 0.2, "ba": 0.05, "bab": 0.3, "b": 0.01}.items()}, math.log(1e-4))

    def cost(words):
        return sum(model.logs.get(w, model.unknown - math.log(10) * (len(w) - 1)) for w in words)

    def all_cuts(s):
        yield [s]
        for k in range(1, len(s)):
            for rest in all_cuts(s[k:]):
                yield [s[:k], *rest]

    for _ in range(60):
        s = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        assert abs(cost(url_filter.segment(s, model)) - max(map(cost, all_cuts(s)))) < 1e-9
    assert url_filter.segment("", model) == []


def test_warc_derivatives(spark, tmp_path):
    given = rows()
    records = warc.responses(pages(spark, given))
    got = warc.derivatives(records)
    assert got.count() == 2 * len(given) == 2 * records.count()
    source = {r.record_id: r for r in records.collect()}
    for r in got.collect():
        of = source[r.refers_to]
        assert (r.target_uri, r.date, r.payload_digest, r.headers["WARC-Page-Id"]) == (of.target_uri, of.date, of.payload_digest, of.headers["WARC-Page-Id"])
        assert r.block_digest == warc.digest(bytes(r.block)) and r.record_id == warc.derived_id(r.refers_to, r.warc_type)
        assert r.headers["WARC-Source-Content-Type"] == "text/html; charset=utf-8"
        if r.warc_type == "conversion" and of.headers["WARC-Page-Id"] == "0":
            assert bytes(r.block).decode().startswith("Site\nmenu\nT & 0\none two\nthree\nfour five sixy z")
        if r.warc_type == "metadata" and of.headers["WARC-Page-Id"] == "0":
            assert b"fetchStatus: 200\r\n" in r.block and b"title: t\r\n" in r.block and b"outlink: /\r\n" in r.block
    # a file and back
    (tmp_path / "a.warc.gz").write_bytes(b"".join(bytes(r.member) for r in warc.serialized(records.unionByName(got)).collect()) + b"broken")
    plain = b"".join(gzip.decompress(bytes(r.member)) for r in warc.serialized(records).collect())
    (tmp_path / "b.warc").write_bytes(plain[:-40])
    back = warc.read_warc(spark, str(tmp_path))
    assert back.where("warc_type = 'conversion'").count() == len(given) and back.where("warc_type = 'response'").count() == 2 * len(given) - 1
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "b.warc").write_bytes(plain)
    assert sorted(map(str, warc.read_warc(spark, str(tmp_path / "c")).collect())) == sorted(map(str, records.collect()))


def test_warc_takes_odd_records(spark):
    head = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/plain; charset=latin-1\r\nContent-Encoding: gzip\r\n\r\n"
    given = [("response", "<a>", bytearray(head + gzip.compress("café".encode("latin-1")))), ("response", None, None), ("response", "<b>", bytearray(b"no head")),
             ("response", "<c>", bytearray(b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG")), ("request", "<d>", bytearray(b"x")), (None, None, None)]
    df = spark.createDataFrame(given, "warc_type string, record_id string, block binary").selectExpr(
        "*", "cast(null AS string) refers_to", "cast(null AS string) target_uri", "cast(null AS string) date", "cast(null AS string) content_type", "cast(null AS string) block_digest",
        "cast(null AS string) payload_digest", "cast(null AS map<string,string>) headers", "1 AS extra")
    got = {(r.refers_to, r.warc_type): r for r in warc.derivatives(df).collect()}
    assert len(got) == 8
    assert bytes(got["<a>", "conversion"].block).decode() == "café" and b"fetchStatus: 404" in got["<a>", "metadata"].block
    assert (bytes(got[None, "conversion"].block), bytes(got["<b>", "conversion"].block), bytes(got["<c>", "conversion"].block)) == (b"", b"no head", b"")
    assert warc.derivatives(df.limit(0)).count() == 0


def test_warc_keeps_what_real_responses_hold(spark):
    """Repeated fields, broken, stacked and chunked bodies."""
    import zlib

    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(300_000)).encode()
    packed = gzip.compress(text)
    broken = bytearray(packed)
    broken[len(packed) // 2: len(packed) // 2 + 400] = b"\xff" * 400
    chunked = b"5\r\nhello\r\n7;x=y\r\n, world\r\n0\r\n\r\n"
    zipped = gzip.compress(b"zipped")
    raw = zlib.compressobj(wbits=-15)
    bodies = {
        "cut": ("Content-Encoding: gzip", packed[: len(packed) // 2]), "broken": ("Content-Encoding: gzip", bytes(broken)), "tail": ("Content-Encoding: x-gzip", packed + b"\x1f\x8bxx"),
        "members": ("Content-Encoding: gzip", gzip.compress(b"one ") + gzip.compress(b"two")), "chunked": ("Transfer-Encoding: chunked", chunked), "no chunks": ("Transfer-Encoding: chunked", b"plain text"),
        "short": ("Transfer-Encoding: chunked", chunked[:20]), "both": ("Transfer-Encoding: chunked\r\nContent-Encoding: gzip", b"%x\r\n%s\r\n0\r\n\r\n" % (len(zipped), zipped)),
        "zlib": ("Content-Encoding: deflate", zlib.compress(b"deflated")), "raw": ("Content-Encoding: deflate", raw.compress(b"deflated") + raw.flush()), "br": ("Content-Encoding: br", b"\x0b\x02\x80"),
        "fields": ("Set-Cookie: a=1\r\nLink: <x>\r\nset-cookie: b=2\r\nLink: <y>", b"body")}
    given = [{"warc_type": "response", "record_id": k, "block": bytearray(b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n" + head.encode() + b"\r\n\r\n" + body)} for k, (head, body) in bodies.items()]
    got = {r.refers_to: r for r in warc.derivatives(spark.createDataFrame(given, warc.RECORD)).where("warc_type = 'conversion'").collect()}
    block = {k: bytes(r.block) for k, r in got.items()}
    assert text.startswith(block["cut"]) and len(block["cut"]) > 0.49 * len(text)
    assert block["broken"][:140_000] == text[:140_000] and block["tail"] == text
    assert [block[k] for k in ("members", "chunked", "no chunks", "short", "both", "zlib", "raw", "br")] == [
        b"one two", b"hello, world", b"plain text", b"hello, wo"[: len(block["short"])], b"zipped", b"deflated", b"deflated", b""] and len(block["short"]) >= 5
    assert (got["fields"].headers["WARC-Source-Set-Cookie"], got["fields"].headers["WARC-Source-Link"]) == ("a=1, b=2", "<x>, <y>")
    assert dict(warc._joined([("a", "1"), ("b", "2"), ("a", "3")])) == {"a": "1, 3", "b": "2"}
