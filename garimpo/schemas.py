"""Column layouts shared by the operators."""

from __future__ import annotations



POSTING = (
    "collect_seq bigint, job_link string, job_title string, company string, location string, "
    "workplace_type string, description string, posted_at timestamp_ntz, search_group int"
)
CARD = (
    "page_id bigint, position int, job_title string, company string, location string, "
    "card_link string, urn string"
)
CARD_WITH_ERROR = CARD + ", error string"
DETAIL = "page_id bigint, description string, is_closed boolean, error string"
HISTORY = (
    "job_link string, job_title string, company string, location string, contract_type string, "
    "inferred_contract_type string, score_clt double, score_non_clt double, contract_margin double, "
    "contract_evidence string, workplace_type string, match_score int, first_seen_at timestamp_ntz, "
    "last_processed_at timestamp_ntz, status string, notes string, status_updated_at timestamp_ntz, "
    "error_class string"
)
STATUS_EVENT = "seq bigint, ts timestamp_ntz, link string, status string, notes string, error_class string"


def names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(",")]


HISTORY_COLUMNS = names(HISTORY)
# Taken from the latest run of a posting, with the default of a missing value.
REFRESHED = {
    "job_title": "N/A", "company": "N/A", "location": "N/A", "contract_type": "N/A",
    "inferred_contract_type": "N/A", "score_clt": None, "score_non_clt": None,
    "contract_margin": None, "contract_evidence": "N/A", "workplace_type": "N/A", "match_score": 0,
}
# Owned by the user: a run never overwrites them.
USER_OWNED = ("status", "notes", "status_updated_at", "error_class")
