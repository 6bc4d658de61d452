"""Broken pages in linear time, broken records without a digest, queries on small tables."""

import hashlib
import time

import pytest

from treegauge.llm import html_text as H, warc as W

HALF = 1 << 19


@pytest.mark.parametrize("html", [
    "a <b " * (HALF // 2), '<a t="' * (HALF // 2), "<b>" * (HALF // 4) + "x</i>" * (HALF // 4),
    "<b>" * (HALF // 4) + "<div></div>" * (HALF // 8), "<p>" + "<b>" * (HALF // 4) + "<li></li>" * (HALF // 8),
    "<table>" + "<tr><td><i>x" * (HALF // 8), "<b " * (HALF // 2) + "'>", "<!-- " * (HALF // 2), "<" * HALF * 2],
    ids=range(9))
def test_a_megabyte_of_broken_page_is_read_in_time(html):
    assert len(html) > 500_000
    started = time.time()
    page = H.Page(html)
    assert time.time() - started < 5
    assert len(page.ends) == len(page.tags) and all(e > i for i, e in enumerate(page.ends))


def test_open_and_closed_elements():
    page = H.Page("<div><p>one <b>two<p>three</b></div><ul><li>a<ul><li>b</ul><li>c</ul></x>tail <b unclosed")
    names = [(t, page.tags[p] if p >= 0 else None) for t, p in zip(page.tags, page.parents)]
    assert names == [("#page", None), ("div", "#page"), ("p", "div"), ("b", "p"), ("p", "div"), ("ul", "#page"),
                     ("li", "ul"), ("ul", "li"), ("li", "ul"), ("li", "ul")]
    assert "".join(t for _, _, t in page.texts) == "one twothreeabctail <b unclosed"


def test_a_quote_that_is_never_closed_ends_with_its_tag():
    page = H.Page('<p class="main>one</p><p>two</p>')
    assert "two" in "".join(t for _, _, t in page.texts)


def test_rows_out_of_and_ends_of_tables():
    page = H.Page("<table><tr><td>1<td>2<tr><td><table><tr><td>in</table>3</table>out")
    depth = {t: page.depths[n] for n, _, t in page.texts}
    assert depth["1"] == depth["2"] == depth["3"] and depth["in"] == depth["1"] + 3 and depth["out"] == 0


def test_a_record_that_is_not_whole_has_no_digest(spark):
    body = b"x" * 20
    named = "sha1:" + hashlib.sha1(body).hexdigest()
    found = spark.createDataFrame(
        [("response", "<urn:page:1>", "u", named, None, body, 20, True),
         ("response", "<urn:page:2>", "u", named, None, None, None, False),
         ("revisit", "<urn:page:3>", "u", named, "<urn:page:1>", None, 20, True),
         ("revisit", "<urn:page:4>", "u", named, "<urn:page:1>", None, 20, False)],
        "type string, id string, uri string, digest string, refers string, payload binary, payload_bytes bigint, "
        "complete boolean")
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in W.results(found).collect()}
    assert got == {1: (20, named[5:]), 2: (None, None), 3: (20, named[5:]), 4: (None, None)}


def test_op8_and_op7_on_a_small_table(spark, tmp_path):
    long = "<article><p>" + "words of a page. " * 80 + "</p></article>"
    pages = [(1, "u1", long), (2, "u2", long), (3, "u3", None), (4, "u4", ""), (5, "u5", "short"), (6, "u6", "short")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r for r in W.op8_warc(spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    for i, _, html in pages:
        data = (html or "").encode()
        assert got[i]["payload_bytes"] == len(data)
        assert got[i]["payload_digest"] == hashlib.sha1(data).hexdigest()
    assert [got[i]["record_type"] for i in range(1, 7)] == ["revisit"] + ["response"] * 5
    assert got[1]["refers_to"] == 2 and got[5]["refers_to"] is None
    text = {r["page_id"]: (r["text"], r["n_chars"]) for r in H.op7_html_text(spark, str(tmp_path)).collect()}
    assert text[3] == text[4] == ("", 0) and sorted(text) == [1, 2, 3, 4, 5, 6]
    assert text[1] == text[2] and text[1][1] == len(text[1][0])
