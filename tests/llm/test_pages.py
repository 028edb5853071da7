"""Archives and wrappers: exact round trips, merge order, and pages of many shapes."""

import base64
import hashlib
import random

import pytest

from garimpo.llm import warc, wrappers

KIND = "page_id long, url string, html string, text string, payload_bytes int, `range` int"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, 2) for r in rows], KIND).repartition(3)


@pytest.fixture(scope="module")
def odd_pages(spark):
    rows = [
        (1, "http://www.Example.org:80/B?x=1#f", "<p>one\r\n\r\nWARC/1.1\r\n</p>"), (2, "https://example.org/a", "<p>two é 漢</p>"),
        (3, "https://example.org/a", "<p>two é 漢</p>"), (9, "https://example.org/a", "<p>two é 漢</p>"), (4, None, None), (5, "not a url\n", ""),
        (6, "http://[bad", "\n\n\n"), (None, "http://example.org/n", "<p>nobody</p>"), (None, "http://example.org/n", "<p>two é 漢</p>"),
        (7, "http://example.org/long", "x\r\n" * 60000), (8, "http://example.org/end", "ends in return\r"), (10, "http://b.org/", "again"), (10, "http://b.org/", "again"),
    ]
    return rows


def test_archives_round_trip(spark, odd_pages):
    found = warc.archived(_pages(spark, odd_pages)).collect()
    first = {}
    for page, _, text in odd_pages:
        if page is not None:
            first[text or ""] = max(page, first.get(text or "", page))
    count = {t: sum((x[2] or "") == t for x in odd_pages) for t in first}

    def wanted(page, text):
        raw = (text or "").encode()
        again = count.get(text or "", 1) > 1 and page != first[text or ""]
        return page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[text or ""] if again else None

    key = str
    assert sorted(map(tuple, found), key=key) == sorted((wanted(p, t) for p, _, t in odd_pages), key=key)
    assert warc.archived(spark.createDataFrame([], KIND)).count() == 0


def test_smaller_payloads_are_all_responses(spark):
    found = warc.archived(_pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]), least_bytes=5).collect()
    assert sorted((r.page_id, r.record_type) for r in found) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]


def test_index_is_in_order_whatever_the_blocks(spark, odd_pages):
    rows = odd_pages + [(100 + i, f"http://{'hot' if i % 3 else 'h%d' % (i % 7)}.org/{i % 5}", f"<p>{i}</p>") for i in range(300)]
    path = warc.runtime.new_folder(spark, "warc")
    warc.write(_pages(spark, rows), path)
    captures = warc.captures(spark, path)
    for block_rows, range_rows in ((2048, 1 << 18), (3, 40)):
        found = warc.merged_index(captures, block_rows, range_rows).collect()
        order = sorted(found, key=lambda r: (r.range, r.place))
        keys = [(r.url_key, r.captured, -1 if r.page_id is None else r.page_id) for r in order]
        assert len(found) == len(rows) and keys == sorted(keys)


def test_loser_tree_merges_blocks_as_they_open():
    rng = random.Random(2)
    for _ in range(50):
        runs = [sorted((rng.randrange(60), r, i) for i in range(rng.randrange(0, 30))) for r in range(rng.randrange(1, 9))]
        assert list(warc.merged(_blocks(runs, 4))) == sorted(x for run in runs for x in run)
    ties = [[(0, 0, 0)] * 9, [(0, 0, 0)] * 7, [(0, 0, 0)] * 2 + [(1, 0, 0)] * 9]
    assert list(warc.merged(_blocks(ties, 2))) == sorted(x for run in ties for x in run)
    assert list(warc.merged(iter([]))) == []


def _blocks(runs, size):
    cut = [(run[i : i + size], str(r), run[i + size][:3] if i + size < len(run) else None) for r, run in enumerate(runs) for i in range(0, len(run), size)]
    return ((run, entries, following) for entries, run, following in sorted(cut, key=lambda b: b[0][0]))


def test_many_runs_merge_in_time_of_their_entries():
    """Comparisons grow with entries times the tree's height, not with the square of the runs."""
    def comparisons(n):
        rng, seen = random.Random(n), [0]

        class Counted(warc.LoserTree):
            def _beats(self, a, b):
                seen[0] += 1
                return super()._beats(a, b)

        runs = [sorted((rng.randrange(10**6), r, i) for i in range(20)) for r in range(n)]
        with pytest.MonkeyPatch.context() as m:
            m.setattr(warc, "LoserTree", Counted)
            assert list(warc.merged(_blocks(runs, 5))) == sorted(x for run in runs for x in run)
        return seen[0]

    assert comparisons(2000) < 2000 * 20 * 13


def test_url_keys():
    assert warc.url_key("http://www.Example.org:80/B?x=1#f") == "org,example)/b?x=1"
    assert warc.url_key("https://a.b.org:8443") == "org,b,a:8443)/"
    assert warc.url_key(None) == "" and warc.url_key("http://[bad")


ARTICLE = "<h1>Title {0}</h1><p>First   text {0} with <a href=x>a link</a> &amp; more.</p>\n<p>Second &eacute; text {0}, long enough to matter here.</p>"
WANTED = "Title {0}\nFirst text {0} with a link & more.\nSecond é text {0}, long enough to matter here."


def _texts(spark, pages):
    found = wrappers.main_texts(_pages(spark, pages)).collect()
    for r in found:
        assert r.n_chars == len(r.text)
    return {r.page_id: r.text for r in found}


SHAPES = {
    "article": "<html><head><title>T {0}</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>More</a></li></ul></nav>"
    "<div class=ad>Buy {0} now</div><article>" + ARTICLE + "<script>if (a < b) document.write('<p>no</p>')</script></article>"
    "<aside><p>Side {0}</p></aside><form><label>Mail</label><input><button>Go</button></form><footer>&copy; us {0}</footer></body></html>",
    "main": "<body><header><h1>Site</h1></header><main class=content>" + ARTICLE + "<section class=comments><p>I say {0}</p></section></main>"
    "<div id=cookie-notice><p>We use cookies</p></div>",
    "divs": "<body><div class='top menu'><a href=1>One</a> <a href=2>Two</a></div><div id=wrap><div class=post>" + ARTICLE + "</div>"
    "<div class=related-links><a href=3>Other article {0}</a></div></div><div class=copyright>All rights {0}</div>",
    "broken": "<body><ul class=nav><li>a<li>b</ul><article><h1>Title {0}<p>First   text {0} with <a href=x>a link</a> &amp; more.<p>Second &eacute; text {0}, long enough to matter here.",
    "optional": "<body><article><header>" + ARTICLE.split("</h1>", 1)[0] + "</h1></header>" + ARTICLE.split("</h1>", 1)[1] + "</article><!-- <p>off</p> --><div class='Share-Buttons'>Share</div>",
}


@pytest.mark.parametrize("shape", SHAPES)
def test_main_text_of_a_host(spark, shape):
    pages = [(i, f"http://{shape}.org/{i}", SHAPES[shape].format(i)) for i in range(6)]
    assert _texts(spark, pages) == {i: WANTED.format(i) for i in range(6)}


def test_main_text_of_mixed_hosts_and_odd_pages(spark):
    pages = [(i, f"http://mixed.org/{i}", SHAPES[s].format(i)) for i, s in enumerate(SHAPES)]
    odd = [(90, "http://mixed.org/x", None), (91, None, ""), (92, "::", "   "), (93, "http://one.org", "just words\n here"), (94, "http://mixed.org/l", "<article>" + "<p>long text</p>" * 5000)]
    found = _texts(spark, pages + odd)
    assert {i: found[i] for i in range(len(SHAPES))} == {i: WANTED.format(i) for i in range(len(SHAPES))}
    assert (found[90], found[91], found[92], found[93]) == ("", "", "", "just words here")
    assert found[94] == "\n".join(["long text"] * 5000)
    assert wrappers.main_texts(spark.createDataFrame([], KIND)).count() == 0


@pytest.mark.parametrize("copies", [1, 3, 5])
def test_copies_of_a_page_do_not_make_its_blocks_constant(spark, copies):
    quoted = SHAPES["divs"].replace("</p></div>", "</p><blockquote>Said once, of page {0}.</blockquote></div>", 1)
    assert quoted != SHAPES["divs"]
    pages = [(i, f"http://d.org/{i}", SHAPES["divs"].format(i)) for i in range(6)]
    # the copies' links differ, what they say does not
    pages += [(50 + i, f"http://d.org/q{i}", quoted.format(50).replace("Other article 50", f"Other article {i}")) for i in range(copies)]
    body = "<body><h1>Early title {0}</h1><article><p>Text {0} of some length.</p></article>"
    pages += [(80 + i, f"http://e.org/{i}", body.format(80)) for i in range(copies)]
    found = _texts(spark, pages)
    assert {i: found[i] for i in range(6)} == {i: WANTED.format(i) for i in range(6)}
    for i in range(copies):
        assert found[50 + i] == WANTED.format(50) + "\nSaid once, of page 50."
        assert found[80 + i] == "Early title 80\nText 80 of some length."


def test_text_that_different_pages_share_stays_constant(spark):
    page = "<body><div><div class=post><p>Story {0} with enough words to be the text.</p></div><h3>Our firm since 1900</h3></div>"
    found = _texts(spark, [(i, f"http://c.org/{i}", page.format(i)) for i in range(4)])
    assert found == {i: f"Story {i} with enough words to be the text." for i in range(4)}


def test_wrappers_stay_union_free_and_cover_their_pages(spark):
    pages = [(i, "http://w.org/", "<body><div>" + "<p>t</p><h2>u</h2>" * (i + 1) + ("<ul><li>x</ul>" if i % 2 else "") + "</div>") for i in range(4)]
    from pyspark.sql import functions as F

    found = wrappers.wrappers(_pages(spark, pages).select(F.lit("w.org").alias("host"), "html")).collect()
    assert [r.expression for r in found] == ["(body(div((p(#) h2(#))+ ul(li(#))?)))"] or "?" in found[0].expression and "+" in found[0].expression


@pytest.mark.parametrize("levels", [1500, 100_000])
def test_deep_pages_keep_their_text(spark, levels):
    deep = "<div>" * levels
    pages = [
        (1, "http://d/1", f"<article><p>first</p>{deep}<p>deepest</p><nav><p>menu</p></nav></article>"),
        (2, "http://d/2", f"{deep}<article><p>one</p><div class=sidebar><div><p>no</p></div></div><section><p>two</p></section></article><p>after</p>"),
        (3, "http://e/3", "<article><p>plain</p></article>" + "</section>" * levels), (4, "http://e/4", "<ul>" + "<li>" * 2000 + "item"),
    ]
    found = {r.page_id: r.text for r in wrappers.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found == {1: "first\ndeepest", 2: "one\ntwo", 3: "plain", 4: "item"}


def test_icons_formulas_and_controls_split_nothing(spark):
    body = "<article><p>A <svg/> icon <svg><title>x</title></svg>after <math><mi>x</mi>+1</math>, a <button>Press</button> button <select><option>1</select>end</p><p>next <button>open</p><p>last <button>shut</button> one</p></article>"
    df = spark.createDataFrame([(1, "http://s/1", body)], "page_id long, url string, html string")
    assert wrappers.main_texts(df).first().text == "A icon after x+1, a button end\nnext open\nlast one"
