"""Golden report."""

import datetime as dt
import glob

from garimpo.plans import report

COLUMNS = (
    "collect_seq long, job_link string, job_title string, company string, location string, workplace_type string, "
    "contract_type string, inferred_contract_type string, score_clt double, score_non_clt double, "
    "contract_margin double, contract_evidence string, match_score int, strengths array<string>, gaps array<string>, "
    "verdict string, relevant boolean"
)
ROWS = [
    (1, "http://j/1", "A|I", "ACME", "SP", "remoto", "CLT", "CLT", 0.85, None, None, "e1", 71, ["x", "y"], [], "v1", True),
    (2, None, "B\nb", "Globex", "RJ", None, "CLT", None, 1.0, None, None, None, 90, [], ["g"], None, True),
    (3, "http://j/3", "C", "EY", "SC", "remoto", "CLT", "CLT", None, 0.5, None, "e3", 95, [], [], "v3", False),
]
GOLDEN = """# Filtered jobs

Generated at: 2026-01-02 03:04:05
Jobs shown: 2 of 3 analyzed (filter: CLT score >= 0.7, match score >= 70)

| Score | Score CLT | Score Non-CLT | Margin | Job | Company | Contract | Model | Location |
| ---: | ---: | ---: | ---: | --- | --- | --- | --- | --- |
| 90 | 1.0 | N/A | N/A | B b | Globex | CLT | N/A | RJ |
| 71 | 0.85 | N/A | N/A | [A\\|I](http://j/1) | ACME | CLT | remoto | SP |

---

## 1. B
b - Globex

- Match score: 90/100
- Link: N/A
- Inferred contract type: CLT
- Score CLT: 1.0
- Score Non-CLT: N/A
- Contract margin: N/A
- Contract evidence: N/A
- Workplace type: N/A
- Location: RJ

### Strengths
- N/A

### Gaps
- g

### Verdict
N/A

---

## 2. A|I - ACME

- Match score: 71/100
- Link: http://j/1
- Inferred contract type: CLT
- Score CLT: 0.85
- Score Non-CLT: N/A
- Contract margin: N/A
- Contract evidence: e1
- Workplace type: remoto
- Location: SP

### Strengths
- x
- y

### Gaps
- N/A

### Verdict
v1

---
"""


def written(path):
    return "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{path}/part-*")))


def test_report(spark, tmp_path):
    lines = report.report_lines(spark.createDataFrame(ROWS, COLUMNS), dt.datetime(2026, 1, 2, 3, 4, 5))
    report.write_report(lines, str(tmp_path / "r"))
    assert written(tmp_path / "r") == GOLDEN


def test_empty_report(spark, tmp_path):
    lines = report.report_lines(spark.createDataFrame(ROWS[2:], COLUMNS), dt.datetime(2026, 1, 2, 3, 4, 5))
    report.write_report(lines, str(tmp_path / "r"))
    assert "Jobs shown: 0 of 1 analyzed" in written(tmp_path / "r") and written(tmp_path / "r").endswith("\n---\n")
