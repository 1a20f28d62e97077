"""Main text, WARC round trips, URL verdicts."""

import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from paragrid.llm import html_extract, url_filter, warc


@pytest.fixture(scope="module")
def model():
    return html_extract.train()


def test_marginals_are_exact(model):
    """Against the sum over all labellings of small trees."""
    import itertools
    import math

    page = html_extract.parse("<div class=post><p>one two three</p><ul><li><a href=x>link</a></ul></div>")
    got = model.marginals(page)
    total, sums = 0.0, [[0.0] * 3 for _ in page.nodes]
    for states in itertools.product(range(3), repeat=len(page.nodes)):
        score = (0.0, -9.0, -9.0)[states[0]]
        for k, node in enumerate(page.nodes):
            score += sum(model.temper * model.feature[f][states[k]] for f in html_extract.features(node) if f in model.feature)
            if k:
                score += math.log(model.edge[states[node.parent]][states[k]])
        p = math.exp(score)
        total += p
        for k, y in enumerate(states):
            sums[k][y] += p
    assert all(abs(got[k][y] - sums[k][y] / total) < 1e-9 for k in range(len(page.nodes)) for y in range(3))


def test_held_out_blocks(model):
    right = n = 0
    for source in html_extract.labelled_pages(200, seed=99):
        page = html_extract.parse(source)
        states, beliefs = html_extract.Model._filled(page), model.marginals(page)
        for owner, piece, _ in page.texts:
            if piece.strip():
                n += 1
                right += (beliefs[owner][html_extract.CONTENT] >= 0.5) == (states[owner] == html_extract.CONTENT)
    assert right / n > 0.96


ARTICLE = "<article><h1>A &amp; B</h1><p><b>First\n  line<br>goes on &lt;here&gt;.<p>Second &#233; paragraph, with enough words to be read.</p></article>"
TEXT = "A & B\nFirst line goes on <here>.\nSecond é paragraph, with enough words to be read."


@pytest.mark.parametrize(
    "source, want",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>if (a<b) x='</p>'</script></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><!-- ad --><div class=\"ad\">Buy this now.</div>{ARTICLE}<footer>&copy; me</footer></body></html>", TEXT),
        (f"<body><header class='site-header'><h1><a href='/'>Site</a></h1></header><div id='wrapper'>{ARTICLE}<aside class=sidebar><p>Popular things</p></aside><section id='comments'><div class='comment'><p>I do not agree with any of this at all, and say so.</p></div></section></div><form class=search><label>Find</label><input></form>", TEXT),
        (f"<body><nav><a href=/>Home</a></nav>{ARTICLE}<p>cut off <a hre", None),
    ],
)
def test_extraction(model, source, want):
    got = model.extract(source)
    assert got == want if want is not None else got.startswith(TEXT)


def test_extraction_of_frames(spark, model):
    rows = [(1, "u", ARTICLE, "x"), (None, None, None, "y"), (1, "u", ARTICLE, "x"), (2, "v", "<p>" + "word " * 200_000, "z")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), model).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (1, len(TEXT)), (1, len(TEXT)), (2, 999_999)]
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


@pytest.mark.parametrize("head", ["<head><title>x</title>", "<head><meta charset=utf-8><noscript><style>p{}</style></noscript>", "<head><title>x</title></head>"])
@pytest.mark.parametrize("body", ["<body>", ""])
def test_head_without_end(model, head, body):
    said = "A long enough paragraph of plain words, which any reader would take for the text of the page. " * 3
    page = html_extract.parse(f"<html>{head}{body}<article><p>{said}</p></article></html>")
    assert "".join(x for _, x, _ in page.texts).split() == said.split()


def test_formulas_and_fallbacks_are_text():
    made = html_extract.parse("<article><p>Then <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds, <video><source src=a>see the film</video> and <object>a map</object>.</p><noscript>Shown <b>without</b> scripts</noscript></article>")
    assert "".join("|" * fresh + x for _, x, fresh in made.texts).strip("|") == "Then x=1 holds, see the film and a map.|Shown without scripts"


def test_deep_and_broken_markup(model):
    assert isinstance(model.extract("<div>" * 5000 + "deep" + "</div>" * 10), str)
    assert isinstance(model.extract('<a href="never closed>text <p class=\'x> more'), str)


def test_warc_round_trip(spark):
    r = random.Random(4)
    pages = [(k, f"http://h/{k}", "".join(r.choice("abé\r\n:0 ") for _ in range(r.choice((0, 1, 10, 40_000))))) for k in range(60)]
    pages += [(k + 100, None, html) for k, _, html in pages[:20]] + [(200, "a b\r\nc", None), (None, "u", ""), (None, "u", "only this"), (201, "u", "twice"), (201, "u", "twice"), (150, "u", "twice"), (305, "u", "A" * 10), (305, "u", "B" * 9000), (303, "u", "A" * 10), (302, "u", "B" * 9000)]
    df = spark.createDataFrame([(*p, 1, "x", "y") for p in pages], "page_id long, url string, html string, sha int, payload string, first string")
    got = warc.round_trip(df, segment_bytes=1000).collect()
    first = {}
    for k, _, html in pages:
        first[html or ""] = max(first.get(html or "", -1), -1 if k is None else k)
    want = []
    for k, _, html in pages:
        body = (html or "").encode()
        same = first[html or ""]
        response = (-1 if k is None else k) == same
        want.append((-1 if k is None else k, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit", None if response else same))
    key = lambda x: tuple(map(str, x))
    assert sorted(((-1 if x["page_id"] is None else x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in got), key=key) == sorted(want, key=key)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_references_are_records(spark, tmp_path):
    """A revisit names a response record with its page id and digest, and all record ids differ."""
    pages = [(5, "A" * 10), (5, "B" * 1000), (3, "A" * 10), (2, "B" * 1000), (1, "B" * 1000), (9, "twice"), (9, "twice"), (8, "twice")]
    warc.write_archives(spark.createDataFrame([(k, "u", x) for k, x in pages], "page_id long, url string, html string"), str(tmp_path / "w"), segment_bytes=300)
    found = [h for f in (tmp_path / "w").glob("*.gz") for h, _ in warc.parse(gzip.decompress(f.read_bytes()))]
    assert len({h["warc-record-id"] for h in found}) == len(found)
    responses = {h["warc-record-id"]: h for h in found if h["warc-type"] == "response"}
    revisits = [h for h in found if h["warc-type"] == "revisit"]
    assert sorted(h["warc-page-id"] for h in revisits) == ["1", "2", "3", "8"]
    for h in revisits:
        if h["warc-page-id"] == "8":  # its response stands in two rows
            assert "warc-refers-to" not in h and h["warc-refers-to-page-id"] == "9"
        else:
            of = responses[h["warc-refers-to"]]
            assert of["warc-page-id"] == h["warc-refers-to-page-id"] and of["warc-payload-digest"] == h["warc-payload-digest"]


def test_warc_faults():
    records = warc.records_of(5, "u", b"x" * 3000, None, 1000)
    assert len(records) > 2 and [h["warc-type"] for h, _ in warc.parse(warc.END.join(records) + warc.END)][:2] == ["response", "continuation"]
    with pytest.raises(ValueError):
        list(warc.parse((warc.END.join(records))[:-10]))
    framed = warc.chunked(b"abc" * 3000)
    assert warc.unchunked(framed) == b"abc" * 3000 and warc.unchunked(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(framed[:100] + framed[101:])


def test_missing_segment(spark, tmp_path):
    records = warc.records_of(5, "u", b"x" * 3000, None, 1000)
    (tmp_path / "a.warc").write_bytes(warc.END.join(records[:1] + records[2:]) + warc.END)
    with pytest.raises(Exception, match="segment"):
        warc.read_archives(spark, str(tmp_path)).collect()


URLS = [
    ("https://m.a.example.com/en/1?x#y", "m.a.example.com", "/en/1", "example.com/en/", "block"),
    ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://x.www.example.com/en/2", "x.www.example.com", "/en/2", "www.example.com/en/", "allow"),
    ("HTTP://EXAMPLE.COM/de/#/en/", "example.com", "/de/", "com/", "allow"),
    ("http://b.net/es/", "b.net", "/es/", "net/es/", "block"),
    ("http://b.net?u=/fr/", "b.net", "", None, "allow"),
    ("http://notexample.com", "notexample.com", "", None, "allow"),
    ("http://xnet/fr/", "xnet", "/fr/", None, "allow"),
    ("ftp://a.org://b/c", "a.org:", "//b/c", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(k, u[0], "h") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "key long, bad int")
    got = {r["page_id"]: r for r in url_filter.judge_urls(df, labels).collect()}
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) for k in range(len(URLS))] == [u[1:] for u in URLS]
    assert url_filter.judge_urls(df.limit(0), labels).count() == 0


def test_host_reputation(spark):
    """Bad hosts are blocked; few labels are shrunk towards the domain and don't block."""
    rows = [("http://bad.spam.org/", 1)] * 60 + [("http://good.fine.org/", 0)] * 200 + [("http://new.fine.org/", 1)] + [("http://other.spam.org/", None)]
    df = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(k, b) for k, (_, b) in enumerate(rows) if b is not None], "key long, bad int")
    got = {r["host"]: (r["verdict"], r["rate"]) for r in url_filter.judge_urls(df, labels).collect()}
    assert got["bad.spam.org"][0] == "block" and got["good.fine.org"][0] == "allow" and got["new.fine.org"][0] == "allow"
    assert got["other.spam.org"][1] > got["good.fine.org"][1]


def test_registered_domain(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("a.b.com",), ("x",), ("",), ("me.github.io",), ("www.me.github.io:8080",), ("co.uk",), ("a.asso.fr",)], "h string")
    got = hosts.select(url_filter.domain_of(F.col("h")), url_filter.suffix_of(F.col("h")), url_filter.domain_of(F.col("h"), ["b.com"])).collect()
    assert [r[0] for r in got] == ["b.co.uk", "b.com", "x", "", "me.github.io", "me.github.io", "co.uk", "a.asso.fr"]
    assert [r[1] for r in got] == ["co.uk", "com", "x", "", "github.io", "github.io", "uk", "asso.fr"] and got[1][2] == "a.b.com"


def verdicts(spark, rows):
    df = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(k, b) for k, (_, b) in enumerate(rows) if b is not None], "key long, bad int")
    return {r["host"]: r["verdict"] for r in url_filter.judge_urls(df, labels).collect()}


def test_few_labels_block_no_strangers(spark):
    others = [(f"http://h{k}.org{k}.{s}/", None) for k in range(20) for s in ("io", "uk")] + [(None, None)]
    one_bad = verdicts(spark, [("http://bad.spam.biz/", 1), *others])
    assert {h for h, v in one_bad.items() if v == "block"} <= {"bad.spam.biz"}
    one_good = verdicts(spark, [("http://fine.org/", 0), *others])
    assert "block" not in one_good.values() and "block" not in verdicts(spark, others).values()
    all_bad = verdicts(spark, [(f"http://x{k % 3}.spam.biz/{k}", 1) for k in range(60)] + others)
    assert {h for h, v in all_bad.items() if v == "block"} == {f"x{k}.spam.biz" for k in range(3)}
    all_good = verdicts(spark, [(f"http://x{k % 3}.fine.biz/{k}", 0) for k in range(60)] + others)
    assert "block" not in all_good.values()


def test_addresses_users_long_urls_and_repeats(spark):
    hosts = spark.createDataFrame([("1.2.3.4",), ("9.8.3.4:80",), ("user:pw@a.example.com",), ("user@example.com:8080",), ("1.2.3",)], "h string")
    got = hosts.select(url_filter.domain_of(F.col("h")), url_filter.suffix_of(F.col("h"))).collect()
    assert [tuple(r) for r in got] == [("1.2.3.4", "1.2.3.4"), ("9.8.3.4", "9.8.3.4"), ("example.com", "com"), ("example.com", "com"), ("2.3", "3")]
    rows = [("http://1.2.3.4/a", 1)] * 40 + [("http://9.8.3.4/a", 0)] * 40 + [("http://long.org/" + "x" * 200_000, 0)] * 2
    made = verdicts(spark, rows)
    assert (made["1.2.3.4"], made["9.8.3.4"], made["long.org"]) == ("block", "allow", "allow")
