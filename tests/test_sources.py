"""Pages, history documents, search plan."""

import json
import random

from garimpo import rules
from garimpo.sources import history_json, markup, pages, search_plan
from garimpo.sources.markup import parse

CARD = """<li><div class="base-card base-search-card" data-entity-urn="urn:li:jobPosting:42">
<a class="base-card__full-link" href="https://x.example/view/title-7?ref=1">x</a>
<h3 class="base-search-card__title"> Cientista &amp; Dados <!-- c --></h3>
<h4 class="base-search-card__subtitle"><a>ACME</a></h4><span class="job-search-card__location">São Paulo</span></div></li>"""


def test_cards(spark):
    rows = [(1, f"<ul>{CARD}<li><div class='base-card'><p>no fields<br></div></li></ul>"), (2, "<p>none</p>"), (3, None)]
    cards = pages.scan_cards(spark.createDataFrame(rows, "page_id long, html string"))
    found = pages.card_postings(cards, "Brasil", "https://j/").orderBy("page_id", "position").collect()
    assert [tuple(r) for r in found] == [
        (1, 0, "Cientista & Dados", "ACME", "São Paulo", None, "42", "https://j/42"),
        (1, 1, rules.UNTITLED, rules.UNKNOWN_COMPANY, "Brasil", None, None, None),
    ]


def test_one_bad_card_hides_no_other(spark):
    def read(card):
        if "bad" in card.attrs["class"]:
            raise ValueError
        return pages.read_card(card)

    rows = [(1, CARD + "<p class='base-card bad'></p>" + CARD), (2, "<![x[" + CARD), (3, CARD)]
    cards = pages.scan_cards(spark.createDataFrame(rows, "page_id long, html string"), read)
    found = pages.card_postings(cards, "Brasil", "https://j/")
    told = [(r.page_id, r.position, r.job_title, r.location, r.error) for r in found.orderBy("page_id", "position").collect()]
    card = ("Cientista & Dados", "São Paulo", None)
    assert told[:3] == [(1, 0, *card), (1, 1, None, None, "ValueError"), (1, 2, *card)] and told[4] == (3, 0, *card)
    assert told[3][:4] == (2, -1, None, None) and told[3][4]
    assert pages.readable_cards(found).count() == 3 and "error" not in pages.readable_cards(found).columns


def test_detail_text():
    body = '<div class="x show-more-less-html__markup"><p>One<br>two</p><ul><li>a<li>b</li></ul>\n \n<script>no</script>end</div>'
    assert pages.detail_of(f"<html>{body}<p>after</p></html>") == ("One\ntwo\n- a- b\n\nend", False)
    assert pages.detail_of('<section class="description__text">ok</section>') == ("ok", False)
    assert pages.detail_of("<p>short</p>") == (rules.DETAIL_EMPTY, False)
    assert pages.detail_of("<p>" + "long " * 40 + "</p>")[0] == ("long " * 40).strip()
    assert pages.detail_of("<p>Esta vaga não aceita mais candidaturas.</p>")[1] is True
    assert pages.detail_of('<figure class="closed-job"></figure>')[1] is True


def test_tree_closes_like_browsers_do_not():
    page = parse("<p>a<p>b</div></p>c<br/>d<b/>e")
    assert "".join(page.strings()) == "abcde"
    assert [e.tag for e in page.walk()] == ["p", "p", "br", "b"]


def test_detail_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "<p>x</p>")], "page_id long, html string")
    found = {r.page_id: r for r in pages.scan_detail_text(df).collect()}
    assert found[1].description == rules.DETAIL_MISSING and found[2].description == rules.DETAIL_EMPTY


def test_history_documents(spark, tmp_path):
    entries = {
        "https://job/a": {"job_title": "A", "match_score": 70, "score_clt": 0.9, "first_seen_at": "2026-01-01T00:00:00"},
        "https://job/b": {"job_title": "B", "score_clt": "N/A", "status": "applied"}, "https://job/c": 7, "d": "{}",
    }
    (tmp_path / "good.json").write_text(json.dumps(entries, indent=2), encoding="utf-8")
    (tmp_path / "bad.json").write_text('{"x": {"job', encoding="utf-8")
    (tmp_path / "list.json").write_text("[1]", encoding="utf-8")
    found = {r.job_link: r for r in history_json.scan_history(spark, str(tmp_path)).collect()}
    assert set(found) == {"https://job/a", "https://job/b"}
    assert (found["https://job/a"].match_score, found["https://job/a"].score_clt) == (70, 0.9)
    assert str(found["https://job/a"].first_seen_at) == "2026-01-01 00:00:00"
    assert (found["https://job/b"].score_clt, found["https://job/b"].status) == (None, "applied")


def test_search_plan(spark):
    terms = spark.createDataFrame([(0, "a"), (1, "b")], "term_no long, term string")
    wanted = [search_plan.SearchFilter("remoto", "Brasil", "1"), search_plan.SearchFilter("hibrido")]
    found = search_plan.search_plan(terms, wanted, "SP", "24h", 100).orderBy("search_group").collect()
    assert [tuple(r) for r in found] == [
        (0, "a", "Brasil", "1", "2", 86400, 100), (1, "a", "SP", None, "3", 86400, 100),
        (2, "b", "Brasil", "1", "2", 86400, 100), (3, "b", "SP", None, "3", 86400, 100),
    ]
    default = search_plan.search_plan(terms, []).orderBy("search_group").collect()
    assert tuple(default[1]) == (1, "b", "Brasil", None, None, None, 3)


# --- plain markup ---------------------------------------------------------------------------------
MARKUP_BITS = (
    '<div>', '</div>', '<b class="a b">', '</B>', '<p>', '</p>', 'text', ' ', '\n ', '\x0b', '&amp;', '&atilde', '&#10;', '&#1;', '&', '>',
    '<br>', '<br/>', '<img src="a&amp;b" x>', '<a href="?a=1&b=2">', '<a x="&lt;">', '<!-- c -->', '<!---->', '<!--a--b-->', '<!-->',
    '<script>', '</script>', '<script>a<b "</script>', '<style> </style>', '<SCRIPT>x</SCRIPT>', '<pre>', '</pre>', '<title>', '</title>',
    '<', '< b', '<a href=x>', "<a href='x'>", '<a x="1"y="2">', '<a x = "1">', '<a  x="1"  y >', '<a x="1" X="2"/>', '</div >', '<?pi?>',
    '<my-el>', '<a\tb="1">', '<a x="a>b">', '</', '<script/>', '<p a/>', '<textarea>', '</textarea>', '<!DOCTYPE html>',
)


def _tree(element):
    return element.tag, element.attrs, [i if isinstance(i, str) else _tree(i) for i in element.items]


def test_plain_markup_has_the_tree_of_the_parser():
    dice, plain = random.Random(5), 0
    for _ in range(20_000):
        html = "".join(dice.choices(MARKUP_BITS, k=dice.randint(0, 8)))
        found = markup._plain(html)
        if found is not None:
            plain += 1
            builder = markup._Builder()
            builder.feed(html)
            builder.close()
            builder.flush()
            assert _tree(found) == _tree(builder.root), html
    assert plain > 2_000


def test_plain_pages_do_not_reach_the_slow_parser(monkeypatch):
    """A page of plain cards took ten times as long when every page went through the HTML parser."""
    monkeypatch.setattr(markup, "_Builder", None)
    html = (
        '<!-- results --><ul><li><div class="base-card x" data-entity-urn="urn:li:jobPosting:7"><a class="base-card__full-link" href="/v?a=1&amp;b=2">'
        '<br/>go</a><h3 class="base-search-card__title">\n S&atilde;o <b></b></h3><script>if (a<b) f()</script></div></li></ul>'
    )
    cards = list(pages._cards_of_page(1, html, pages.read_card))
    assert cards == [(1, 0, "São", "Unidentified company", None, "/v?a=1&b=2", "urn:li:jobPosting:7", None)]
