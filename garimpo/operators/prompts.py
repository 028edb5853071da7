"""Texts sent to models: profile, match prompt, contract prompt."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from garimpo import rules
from garimpo.functions.text import blank_to_null, strip


@dataclass(frozen=True)
class Profile:
    """Configured candidate profile; ``text`` alone is a ready-made profile.

    Skills may be one text, soft skills too; the skills of a category may be a single value.
    """

    name: str = "default"
    text: str | None = None
    summary: str | None = None
    skills: dict[str, Sequence[str] | str] | str = field(default_factory=dict)
    soft_skills: Sequence[str] | str = ()
    level: str | None = None

    def columns(self) -> list[Column]:
        listed = {} if isinstance(self.skills, str) else self.skills
        skills = [
            x for k, v in listed.items()
            for x in (F.lit(k), F.array(*map(F.lit, v if isinstance(v, (list, tuple)) else [str(v)])))
        ]
        skill_map = F.create_map(*skills) if skills else F.lit(None)
        many = not isinstance(self.soft_skills, str) and self.soft_skills
        soft = F.array(*map(F.lit, self.soft_skills)) if many else F.lit(None)
        return [
            F.lit(self.name).alias("profile"),
            F.lit(self.text).cast("string").alias("text"),
            F.lit(self.summary).cast("string").alias("summary"),
            skill_map.cast("map<string,array<string>>").alias("skills"),
            soft.cast("array<string>").alias("soft_skills"),
            F.lit(self.level).cast("string").alias("level"),
            F.lit(self.skills if isinstance(self.skills, str) else None).cast("string").alias("skills_text"),
            F.lit(self.soft_skills if isinstance(self.soft_skills, str) else None).cast("string").alias("soft_text"),
        ]


def pretty_label(key: Column) -> Column:
    """``ia_e_llms`` -> ``IA e LLMs``: known acronyms, small connectors, capitals."""
    def word(w: Column) -> Column:
        low = F.lower(w)
        shown = F.concat(F.upper(F.left(low, F.lit(1))), F.substring(low, 2, 1 << 30))
        shown = F.when(low.isin(*rules.LABEL_CONNECTORS), low).otherwise(shown)
        for name, acronym in rules.LABEL_ACRONYMS.items():
            shown = F.when(low == name, F.lit(acronym)).otherwise(shown)
        return shown

    words = F.filter(F.split(key, r"[_\s]+"), lambda w: w != "")
    return F.array_join(F.transform(words, word), " ")


def profile_text(text: Column, summary: Column, skills: Column, soft_skills: Column, level: Column,
                 skills_text: Column | None = None, soft_text: Column | None = None) -> Column:
    """Profile as sections; a plain text profile is only trimmed, and so are plain text skills."""
    skill_lines = F.transform(
        F.map_entries(skills),
        lambda e: F.concat(F.lit("- "), pretty_label(e["key"]), F.lit(": "), F.array_join(e["value"], ", ")),
    )
    soft_lines = F.transform(soft_skills, lambda s: F.concat(F.lit("- "), s))

    def titled(title: str, lines: Column) -> Column:
        return F.array_join(F.concat(F.array(F.lit(title)), lines), "\n")

    def plain(title: str, value: Column | None) -> Column:
        return F.concat(F.lit(title + "\n"), strip(blank_to_null(F.lit(None).cast("string") if value is None else value)))

    sections = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Professional Summary:\n"), strip(blank_to_null(summary))),
        F.coalesce(titled("Technical Skills (Hard Skills):", skill_lines), plain("Technical Skills (Hard Skills):", skills_text)),
        F.coalesce(titled("Soft Skills:", soft_lines), plain("Soft Skills:", soft_text)),
        F.concat(F.lit("Experience Level: "), blank_to_null(level)),
    )
    return F.coalesce(strip(text), strip(sections))


def profile_cross(postings: DataFrame, profiles: Sequence[Profile]) -> DataFrame:
    """Each posting once per configured profile: a map over a short literal list, no join."""
    listed = F.array(
        *[
            F.struct(p.columns()[0], profile_text(*p.columns()[1:]).alias("profile_text"))
            for p in profiles
        ]
    )
    return postings.select("*", F.inline(listed))


def _or(value: Column, default: str) -> Column:
    return F.coalesce(blank_to_null(value), F.lit(default))


# Own wording; the inputs and the answer keys are the fixed part.
MATCH_TEMPLATE = """Judge how well a candidate fits a job opening. Both texts may be in Portuguese.

# Opening
Title: <<title>>
Company: <<company>>
Location: <<location>>
Description:
<<description>>

# Candidate
<<profile>>

# Answer
One JSON object and nothing else, texts in Portuguese:
{"match_score": whole number 0-100, be strict,
 "core_role_compatible": false only if the title names another career track,
 "strengths": up to 4 points of the candidate the opening asks for,
 "gaps": requirements the candidate does not show,
 "verdict": advice in at most 3 sentences}
"""
CONTRACT_TEMPLATE = """State the employment type of a job opening in Brazil.

Title: <<title>>
Company: <<company>>
Description:
<<description>><<hints>>

CLT (regular employment) is the default: name another type only on explicit evidence,
and prefer CLT to INDEFINIDO when in doubt.
One JSON object and nothing else:
{"regime": one of CLT, PJ, FREELANCER, ESTAGIO, TEMPORARIO, INDEFINIDO,
 "confidence": number 0.0-1.0,
 "evidence": short quote or one sentence}
"""
HINT_LINE = "\nKeyword hints (support only): "


def fill(template: str, **values: Column) -> Column:
    """Template text with each ``<<name>>`` replaced by a column."""
    pieces = re.split(r"<<(\w+)>>", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def _posting_values() -> dict[str, Column]:
    return {
        "title": _or(F.col("job_title"), rules.NOT_AVAILABLE),
        "company": _or(F.col("company"), rules.NOT_AVAILABLE),
        "location": _or(F.col("location"), rules.NOT_AVAILABLE),
        "description": _or(F.col("description"), "No description."),
    }


def match_prompt(profile: Column) -> Column:
    """Request for a match analysis of one posting."""
    return fill(MATCH_TEMPLATE, profile=profile, **_posting_values())


def contract_prompt(hints: Column) -> Column:
    """Request for the contract type; found labels are passed on as a hint line."""
    line = F.when(F.size(hints) > 0, F.concat(F.lit(HINT_LINE), F.array_join(hints, ", ")))
    return fill(CONTRACT_TEMPLATE, hints=F.coalesce(line, F.lit("")), **_posting_values())
