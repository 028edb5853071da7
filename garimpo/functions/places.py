"""Location, work model and posting-age expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from garimpo import rules
from garimpo.functions.text import contains_any, fold_text, let, matches_any


@dataclass(frozen=True)
class PlaceRules:
    foreign: Sequence[str] = rules.FOREIGN_PLACES
    hubs: Sequence[str] = rules.HUB_CITIES
    homonym: str = rules.HOMONYM_CITY
    homonym_elsewhere: Sequence[str] = rules.HOMONYM_ELSEWHERE
    homonym_state: Sequence[str] = rules.HOMONYM_STATE
    homonym_state_code: str = rules.HOMONYM_STATE_CODE
    word_boundary: bool = False  # whole words: the city "Franca" is not the country


def workplace_matches(location: Column, model: Column, places: PlaceRules = PlaceRules()) -> Column:
    """Does the location suit the searched work model? No model: always."""
    def judge(place: Column, kind: Column) -> Column:
        if places.word_boundary:
            abroad = place.rlike(r"(?U)\b(?:" + "|".join(places.foreign) + r")\b")
        else:
            abroad = contains_any(place, tuple(places.foreign))
        in_state = contains_any(place, tuple(places.homonym_state)) | place.rlike(
            "(?U)" + places.homonym_state_code
        )
        near_hub = contains_any(place, tuple(places.hubs)) | (
            F.contains(place, F.lit(places.homonym))
            & ~contains_any(place, tuple(places.homonym_elsewhere))
            & in_state
        )
        return (
            F.when(kind == "remoto", ~abroad)
            .when(kind.isin("hibrido", "hybrid"), near_hub)
            .otherwise(F.lit(True))
        )

    return let(fold_text(location), lambda p: let(fold_text(model), lambda k: judge(p, k)))


def conflicts_with_remote(
    description: Column,
    onsite: Sequence[str] = rules.ONSITE_PATTERNS,
    remote: Sequence[str] = rules.REMOTE_PATTERNS,
) -> Column:
    """On-site or hybrid is declared and nothing hints at remote work."""
    return let(
        fold_text(description),
        lambda t: matches_any(t, tuple(onsite)) & ~matches_any(t, tuple(remote)),
    )


def _lookup(key: Column, table: Mapping[str, object]) -> Column:
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)


def period_seconds(period: Column, table: Mapping[str, int] = rules.PERIOD_SECONDS) -> Column:
    """Length of a named posting period; NULL means no age filter."""
    return _lookup(fold_text(period), table)


def workplace_code(model: Column, table: Mapping[str, str] = rules.WORKPLACE_CODES) -> Column:
    """Code of a work model; NULL means no model filter."""
    return _lookup(fold_text(model), table)
