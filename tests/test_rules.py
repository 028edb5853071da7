"""Folding, labels, places, ids, scores: per-row expressions against known rows."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from garimpo import rules
from garimpo.functions import contract, html, labels, links, numbers, places, render, text


def fold_python(value):
    flat = unicodedata.normalize("NFKD", value or "")
    return "".join(c for c in flat if not unicodedata.combining(c)).lower()


def test_fold_known(values):
    rows = ["São Paulo", "", None, "ﬁ … ½ ™ é́", "한국어 가각 힣", "ＦＵＬＬ ㎏", "'\\ ＇＼"]
    assert values(text.fold_text, rows, "s string") == [fold_python(r) for r in rows]


def test_fold_every_latin_and_symbol_character(values):
    rows = [chr(c) for c in range(0x80, 0x3400)] + [chr(c) for c in range(0xAC00, 0xD7A4, 7)]
    found = values(text.fold_text, rows, "s string")
    wrong = [(r, f) for r, f in zip(rows, found) if f != fold_python(r)]
    # Only letters whose case pair is newer than the Java version may differ.
    assert all(ord(r) in range(0x1C80, 0x1C8B) for r, _ in wrong)


def test_fold_random_mixtures(values):
    pool = "aZ é ç Ã … ﬁ ½ 한 ̃ ß Ω İ $45".replace(" ", "") + "  \n"
    dice = random.Random(5)
    rows = ["".join(dice.choice(pool) for _ in range(dice.randrange(60))) for _ in range(300)]
    assert values(text.fold_text, rows, "s string") == [fold_python(r) for r in rows]


LABEL_ROWS = [
    "Somente PJ: traga o CNPJ e a nota fiscal do mês.",
    "Registro em carteira e vale transporte.",
    "Translator | $38/hr from home",
    "USD 27,50 per hour; self employed, self-employed; W-2, C2C, corp to corp",
    "Contract: voice work; a contract  assignment", "contractors plan the budget", "valor / hora", "estágio",
    "freelancing", "epj pjota", "empresa aberta", "emitir nota",
]


def test_labels_equal_python_regex(values):
    table = rules.STRONG_RULES + rules.HINT_RULES
    found = values(lambda t: labels.hint_labels(t, t), LABEL_ROWS, "t string")
    assert found == [[n for n, p in table if re.search(p, fold_python(t))] for t in LABEL_ROWS]
    assert {"PJ/legal entity", "CNPJ/registered company", "Invoice"} <= set(found[0])
    assert found[1] == []


def test_needed_words_never_change_a_result(values):
    """Random strings over the vocabulary of all patterns: words first, then the regex, equals the regex."""
    dice = random.Random(8)
    pieces = (
        "pj pessoa juridica prestador prestadora de servicos prestacao nf nota fiscal emitir cnpj empresa aberta freelancer "
        "freela freelancing autonomo cooperado self employed - / valor hora $ usd 45 4,5 hr hour h per contractor 1099 c2c "
        "corp to w2 w-2 contract : role hire estagio temporario budget faturamento hibrido hybrid presencial presenciais on "
        "site in office work location of this is dias no escritorio remoto remote remotamente home homeoffice teletrabalho "
        "anywhere qualquer lugar x"
    ).split()
    rows = [
        dice.choice(["", " "]).join(dice.choice(pieces) + dice.choice(["", " ", "-"]) for _ in range(dice.randrange(1, 6)))
        for _ in range(3000)
    ]
    table = rules.STRONG_RULES + rules.HINT_RULES
    found = values(lambda t: labels.hint_labels(t, text.blank_to_null(t)), rows, "t string")
    plain = [[n for n, p in table if re.search(p, r)] for r in rows]
    assert [[n for n in f if not n.startswith(rules.PLATFORM_LABEL)] for f in found] == plain
    for patterns in (rules.ONSITE_PATTERNS, rules.REMOTE_PATTERNS):
        hits = values(lambda t: text.matches_any(t, patterns), rows, "t string")
        assert hits == [any(re.search(p, r) for p in patterns) for r in rows]
        assert True in hits and False in hits


def test_platform_order_and_word_boundary(values):
    rows = ["Turing", "Hire Feed", "X-Team", "x team", "Restructuring", "Vento Norte", "", None, "Upwork Turing"]
    assert values(labels.platform_contains, rows, "c string") == [
        "turing", "hire feed", "x-team", "x team", "turing", None, None, None, "turing",
    ]
    strict = values(lambda c: labels.platform_contains(c, word_boundary=True), rows, "c string")
    assert strict[4] is None and strict[0] == "turing"


FLAGGED = [
    ("Contract: Speech Annotation", "Bravia Labs"), ("Prompt Reviewer", "Toptal"),
    ("Vision Scientist", "Upwork"), ("Geologist", "Braintrust Network"),
    ("Forecast Modeller | $38/hr", "Vento Norte"), ("Translator | USD 55 per hour", "Crossing Hurdles"),
]


def test_flagged_titles_have_a_strong_label(values):
    found = values(lambda t, c: labels.strong_labels(text.scan_text(t, c, c), c), FLAGGED, "t string, c string")
    assert all(found)


def test_workplace_matches(values):
    rows = [
        ("Curitiba, PR", "remoto", True), ("Canadá", "remoto", False),
        ("Floripa, SC", "hibrido", True), ("Recife, PE", "hibrido", False),
        ("São José, Santa Catarina", "híbrido", True), ("Centro, São José - SC", "hybrid", True),
        ("São José dos Campos, SP", "hibrido", False),
        ("São José do Rio Preto", "hibrido", False), ("Vila São José", "hibrido", False),
        ("Blumenau, SC", "hibrido", False), ("Santa Catarina", "hibrido", False),
        ("em qualquer parte", None, True), ("Porto, Portugal", "presencial", True), ("Patrocínio Paulista e Franca", "remoto", False),
    ]
    found = values(places.workplace_matches, [r[:2] for r in rows], "l string, m string")
    assert found == [r[2] for r in rows]
    relaxed = places.PlaceRules(word_boundary=True)
    assert values(lambda l, m: places.workplace_matches(l, m, relaxed), [("Indiana", "remoto")], "l string, m string") == [True]


def test_remote_conflict(values):
    rows = {
        "Note: work location of this role is hybrid.": True,
        "Encontros presenciais todas as manhãs.": True, "Time hybrid: dois dias no escritório.": True,
        "Home office ou presencial, conforme o projeto.": False, "Teletrabalho integral.": False,
        "Nada sobre o local.": False, "": False,
    }
    assert values(places.conflicts_with_remote, list(rows), "d string") == list(rows.values())


def test_periods_and_codes(values):
    rows = {"24h": 86400, "Diário": 86400, "semana": 604800, "mês": 2592000, "": None, None: None, "x": None}
    assert values(places.period_seconds, list(rows), "p string") == list(rows.values())
    rows = {"remoto": "2", "Híbrido": "3", "on-site": "1", "presencial": "1", "qualquer": None}
    assert values(places.workplace_code, list(rows), "p string") == list(rows.values())


def test_ids(values):
    rows = [
        ("https://x.example/jobs/view/1234567890", None, "1234567890"),
        ("https://x.example/jobs/search?currentJobId=987654", None, "987654"),
        ("https://x.example/jobs/view/some-title-555111", None, "555111"),
        ("https://x.example/a-12/b", None, "12"), ("https://x.example/a-12b?x=-9", None, None),
        ("https://x.example/view/1", "urn:li:jobPosting:77", "77"), ("", None, None),
    ]
    found = values(links.extract_id, [r[:2] for r in rows], "u string, urn string")
    assert found == [r[2] for r in rows]


def test_closed_flag(values):
    rows = {
        "<div>No longer accepting applications</div>": True,
        "<div>Esta vaga n&#227;o aceita mais candidaturas.</div>": True,
        '<figure class="a closed-job"></figure>': True, "<i class=jobs-closed></i>": True,
        "<div>Estamos contratando! Candidate-se já.</div>": False,
        "<p>closed-job</p>": False, "<script>vaga encerrada</script>": False,
        "<b>Vaga</b><br><br>encerrada": True, "&amp;lt;&#xE9;": False,
    }
    assert values(html.closed_flag, list(rows), "h string") == list(rows.values())


def test_unescape(values):
    rows = ["a &amp;lt; &lt; &eacute;&#233;&#xE9; &nope; &hearts;", "plain"]
    assert values(html.unescape, rows, "h string") == ["a &lt; < ééé &nope; ♥", "plain"]


def test_title_scope(values):
    out = [
        "Qlik Sense Builder", "Power  BI Report Builder", "Market Research Lead", "Especialista em Inteligência de Mercado",
        "Analista de Sistema Fiscal", "BI tools developer", "Programa Trainee Nodejs", "Graduate: Statistician",
    ]
    kept = [
        "Estatístico de Risco", "Computer Vision Researcher", "Especialista de Dados e BI", "Qlikado de Dados",
        "Analista de Sistemática", "Undergraduated Helper", "BI. Developer tools", "", None,
    ]
    found = values(labels.title_scope_reason, out + kept, "t string")
    assert all(found[: len(out)]) and not any(found[len(out):])


def test_relevance(values):
    rows = [
        ("0.7", 70, True), ("0.9", 80, True), ("0.69", 90, False), ("0.8", 69, False), ("N/A", 90, False),
        (None, 90, False), ("0.8", None, False), ("NaN", 90, False),
    ]
    found = values(numbers.is_relevant, [r[:2] for r in rows], "c string, m int")
    assert found == [r[2] for r in rows]
    ungated = values(lambda c, m: numbers.is_relevant(c, m, clt_gate=False), [(None, 90)], "c string, m int")
    assert ungated == [True]


def test_round2_rounds_the_binary_value(values):
    rows = [i / 1000 for i in range(1001)] + [0.125, 0.375, 0.1 + 0.2, 5e-324]
    assert values(numbers.round2, rows, "x double") == [round(x, 2) for x in rows]
    assert values(numbers.round2, [None, 7.125], "x double") == [None, 7.12]


def test_evidence_prints_what_is_rounded(values):
    rows = [i / 1000 for i in range(1001)]

    def evidence(x):
        return contract.evidence_text(F.struct(F.lit("CLT").alias("regime"), x.alias("confidence"), F.lit("e").alias("evidence")))

    assert values(evidence, rows, "x double") == [f"[LLM] regime=CLT confidence={x:.2f}. e" for x in rows]


def test_render_helpers(values):
    assert values(render.bullet_list, [([],), (["a", "b"],), (None,)], "x array<string>") == ["- N/A", "- a\n- b", "- N/A"]
    assert values(render.table_text, ["a|b\nc", None], "x string") == ["a\\|b c", "N/A"]
    rows = {"2024-03-05T10:00:00": "05/03/2024", "": "—", None: "—", "soon": "soon", "2024-03-05": "05/03/2024"}
    assert values(render.fmt_date, list(rows), "x string") == list(rows.values())
    assert values(render.fmt_datetime, ["2024-03-05T10:01:02"], "x string") == ["05/03/2024, 10:01:02"]


@pytest.mark.parametrize("query,hit", [(" ACME ", True), ("são", True), ("sao", False), ("", True), ("%", False)])
def test_text_search(values, query, hit):
    found = values(lambda a, b: text.text_contains([a, b], query), [("Acme", "São Paulo")], "a string, b string")
    assert found == [hit]
