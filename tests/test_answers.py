"""Answer parsing and contract decision."""

import pytest

from garimpo import rules
from garimpo.functions import answers, contract


def match(values, *raw):
    return values(answers.parse_match, list(raw), "raw string")


def test_match_scores(values):
    cases = {
        "150": 100, "-3": 0, "85.9": 85, '"85"': 85, '" 85 "': 85, '"8_5"': 85, '"85.9"': 0, '"x"': 0, "true": 1,
        "null": 0, "[1]": 0, "{}": 0, "NaN": 0, "1e2": 100, "123456789012345678901234567890": 100,
    }
    found = match(values, *['{"match_score": %s}' % c for c in cases])
    assert [f.match_score for f in found] == list(cases.values())
    assert match(values, '{"match_score": 1e999}', "{}")[0] is None  # infinite: the attempt failed
    assert match(values, "{}")[0].match_score == 0


def test_match_shapes(values):
    good = '{"match_score": 42, "strengths": ["x"], "gaps": [], "verdict": "v } {"}'
    rows = [
        good, f"```json\n{good}\n```", f"```\n{good}\n```", f"  {good}\n\t", f"noise {good} trailing }}",
        f"{good} trailing", f"[1, 2] and {good}",
    ]
    for found in match(values, *rows):
        assert (found.match_score, found.strengths, found.gaps, found.verdict) == (42, ["x"], [], "v } {")
    bad = [None, "", "  ", "not json at all", "[" + good + "]", '"text with {\\"match_score\\": 1}"', good[:-3],
           "{'match_score': 1}", "{bad} " + good, "7"]
    assert match(values, *bad) == [None] * len(bad)


def test_last_of_repeated_keys(values):
    assert match(values, '{"match_score": 1, "match_score": 2}')[0].match_score == 2


def test_lists_and_verdict(values):
    found = match(
        values, '{"strengths": ["a", 1, null, true], "gaps": "no list", "verdict": null}', '{"verdict": 5}', "{}"
    )
    assert found[0].strengths == ["a", "1", "None", "True"] and found[0].gaps == []
    assert [f.verdict for f in found] == ["None", "5", rules.NO_VERDICT]


def test_core_role(values):
    cases = {
        "false": False, '"false"': False, '" NÃO "': False, '"no"': False, '""': False, "0": False, "[]": False,
        "{}": False, "true": True, '"yes"': True, "null": True, "2": True, "[0]": True,
    }
    found = match(values, *['{"core_role_compatible": %s}' % c for c in cases])
    assert [f.core_role_compatible for f in found] == list(cases.values())


def test_contract_answers(values):
    rows = [
        '{"regime": "PJ", "confidence": 1.5, "evidence": " CNPJ "}', '{"regime": " clt ", "confidence": "0.8"}',
        '{"regime": "WHATEVER", "confidence": 0.9}', '{"confidence": 0.9}', '{"regime": "CLT", "confidence": null}',
        '{"regime": "CLT", "confidence": [1]}', '{"regime": "CLT", "confidence": true, "evidence": null}',
    ]
    found = values(answers.parse_contract, rows, "raw string")
    read = [f and (f.regime, f.confidence, f.evidence) for f in found]
    assert read == [
        ("PJ", 1.0, "CNPJ"), ("CLT", 0.8, ""), None, None, ("CLT", 0.0, ""), ("CLT", 0.0, ""), ("CLT", 1.0, "None"),
    ]


ANSWER = "struct<regime:string,confidence:double,evidence:string>"


@pytest.mark.parametrize(
    "labels,answer,expected",
    [
        (["PJ/legal entity"], ("CLT", 0.95, "x"), ("PJ", False, None, 1.0)),
        ([], None, ("INDEFINIDO", True, None, None)),
        ([], ("ESTAGIO", 0.6, "x"), ("ESTAGIO", False, None, 0.6)),
        ([], ("PJ", 0.59, "x"), ("CLT", True, None, 0.59)),
        ([], ("CLT", 0.875, "x"), ("CLT", True, 0.88, None)),
        ([], ("INDEFINIDO", 0.3, ""), ("CLT", True, 0.3, None)),
    ],
)
def test_contract_decision(values, labels, answer, expected):
    found = values(contract.contract_decision, [(labels, answer)], f"l array<string>, a {ANSWER}")[0]
    assert (found.inferred_contract_type, found.accepted, found.score_clt, found.score_non_clt) == expected
    assert found.contract_margin is None


def test_evidence(values):
    rows = [(("PJ", 0.5, "maybe"),), (("CLT", 0.9, ""),)]
    assert values(contract.evidence_text, rows, f"a {ANSWER}") == [
        "[LLM] regime=PJ confidence=0.50. maybe (confidence below 0.60; kept conservatively as assumed CLT).",
        "[LLM] regime=CLT confidence=0.90.",
    ]


def test_transient(values):
    rows = [(429, None), (404, "not found"), (None, "Rate-Limit hit"), (None, None), (400, "HTTP 503 upstream")]
    assert values(answers.transient_error, rows, "c int, m string") == [True, False, True, False, True]


def test_list_items_keep_their_fraction(values):
    rows = ['{"match_score": 5, "strengths": [1.0, 1, 2.5, -3.0, true, null, "1"]}']
    found = values(lambda c: answers.parse_match(c)["strengths"], rows, "t string")
    assert found == [["1.0", "1", "2.5", "-3.0", "True", "None", "1"]]


def test_first_json_object_ends_at_its_partner(values):
    from garimpo.functions.answers import first_json_object

    cases = {
        '{"a": 1}': '{"a": 1}', '{"a": {"b": 2}} and {"c": 3}': '{"a": {"b": 2}}', 'So: {"a": "}"} done': '{"a": "}"}',
        r'x {"a": "\"}"} y }': r'{"a": "\"}"}', r'{"a": "\\"} }': r'{"a": "\\"}', '{"a": "é{漢"}.': '{"a": "é{漢"}',
        '{"a": 1': None, '{"a": "}': None, "{": None, "}{": None, "} {}": "{}", "none": None, "": None, None: None,
        '[{"a": 1}]': None, '"{}"': None, '[{"a": 1}] or': '{"a": 1}', '{} {': "{}", '{"a": "\n}"}x': '{"a": "\n}"}',
        "{" * 5000 + "}" * 5000 + "}": "{" * 5000 + "}" * 5000, 'quote " before {"a": 1} ': '{"a": 1}',
        '{"long": "' + r"\"{" * 30_000 + '"} rest': '{"long": "' + r"\"{" * 30_000 + '"}',
    }
    found = values(first_json_object, list(cases), "text string")
    assert dict(zip(cases, found, strict=True)) == cases
