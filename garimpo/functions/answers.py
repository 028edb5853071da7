"""Reading the JSON answers of text models, as Column expressions.

``from_json`` with VARIANT fields does the scanning: it starts at the first
brace, stops at its partner, keeps the type of every value and the last of
repeated keys. Only the rule "text that is valid JSON but no object is no
answer" needs a separate test.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from garimpo import rules
from garimpo.functions.numbers import clamp
from garimpo.functions.text import blank_to_null, let, strip

_OPTIONS = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE"}


def strip_fence(raw: Column) -> Column:
    """Trim, and take a Markdown code fence off."""
    def bare(text: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\n", ""), r"\n```$", "")
        return F.when(F.startswith(text, F.lit("```")), strip(inner)).otherwise(text)

    return let(strip(raw), bare)


def _is_whole_json(text: Column) -> Column:
    # Valid both as an object member and as an array element: one complete value.
    member = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    element = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return member.isNotNull() & element.isNotNull()


# a string to its end (or that of the text), a brace, or what lies between them
_JSON_PARTS = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"?|[{}]|[^"{}]++'


def _from_first_brace(text: Column) -> Column:
    """Text from the first brace on, or NULL when no object can be meant; JSON readers that
    stop at the brace's partner need no more."""
    start = F.instr(text, F.lit("{"))
    return (
        F.when(F.startswith(text, F.lit("{")), text)
        .when((start > 0) & ~_is_whole_json(text), F.substring(text, start, F.length(text)))
    )


def first_json_object(text: Column) -> Column:
    """The first object from its brace to the partner, braces inside strings not counted.

    NULL if there is no brace, none that closes it, or if the text is a JSON value of another kind.
    """
    def cut(rest: Column) -> Column:
        begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("closed"))

        def step(state: Column, part: Column) -> Column:
            depth = state["depth"] + F.when(part == "{", 1).when(part == "}", -1).otherwise(0)
            further = F.struct(depth.alias("depth"), (state["size"] + F.length(part)).alias("size"), ((part == "}") & (depth == 0)).alias("closed"))
            return F.when(state["closed"], state).otherwise(further)

        folded = F.aggregate(F.regexp_extract_all(rest, F.lit(_JSON_PARTS), F.lit(0)), begin, step)
        return let(folded, lambda end: F.when(end["closed"], F.substring(rest, F.lit(1), end["size"])))

    return let(_from_first_brace(text), cut)


def json_fields(raw: Column, names: tuple[str, ...]) -> Column:
    """Struct of VARIANT fields of the answered object; NULL if there is none."""
    schema = ", ".join(f"{n} variant" for n in names) + ", broken string"

    def read(text: Column) -> Column:
        return F.from_json(_from_first_brace(text), schema, _OPTIONS)

    return let(let(strip_fence(raw), read), lambda found: F.when(found["broken"].isNull(), found))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _as_string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def text_of(value: Column, missing: str) -> Column:
    """Text form of any JSON value; lists and objects keep their JSON form."""
    kind, shown = _kind(value), _as_string(value)
    fraction = kind.rlike("^(DECIMAL|DOUBLE|FLOAT)") & ~shown.rlike("[^0-9-]")  # 1.0 is not 1
    return (
        F.when(value.isNull(), F.lit(missing))
        .when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(shown))
        .when(fraction, F.concat(shown, F.lit(".0")))
        .otherwise(shown)
    )


def text_list_of(value: Column) -> Column:
    """Text form of each list item; anything but a list is the empty list."""
    items = F.try_variant_get(value, "$", "array<variant>")
    texts = F.transform(items, lambda item: text_of(item, "None"))
    is_list = F.startswith(_kind(value), F.lit("ARRAY"))
    return F.when(is_list, texts).otherwise(F.array().cast("array<string>"))


def coerce_bool(value: Column) -> Column:
    """Only an explicit negative is false; a missing value is true."""
    kind = _kind(value)
    word = F.lower(strip(_as_string(value)))
    number = F.try_variant_get(value, "$", "double")
    return (
        F.when(value.isNull() | (kind == "VOID"), F.lit(True))
        .when(kind == "STRING", ~word.isin(*rules.FALSE_WORDS))
        .when(kind.rlike("^(ARRAY|OBJECT)"), ~F.to_json(value).isin("[]", "{}"))
        .otherwise(number != 0)
    )


def _score_number(value: Column) -> Column:
    """DOUBLE that still has to be clamped; NaN marks an unusable number.

    Text counts only as a whole number; lists, objects and nulls count as 0.
    """
    kind = _kind(value)
    digits = F.replace(strip(_as_string(value)), F.lit("_"), F.lit(""))
    whole = F.when(digits.rlike(r"^[+-]?\d+$"), digits.try_cast("double"))
    return (
        F.when(value.isNull() | (kind == "VOID") | kind.rlike("^(ARRAY|OBJECT)"), F.lit(0.0))
        .when(kind == "STRING", F.coalesce(whole, F.lit(0.0)))
        .otherwise(F.try_variant_get(value, "$", "double"))
    )


MATCH_FIELDS = ("match_score", "core_role_compatible", "strengths", "gaps", "verdict")


def match_from_fields(found: Column) -> Column:
    return let(_score_number(found["match_score"]), lambda number: _match_struct(found, number))


def _match_struct(found: Column, number: Column) -> Column:
    usable = found.isNotNull() & ~number.isin(float("inf"), float("-inf"))
    whole = F.when(F.isnan(number), F.lit(0.0)).otherwise(number)
    return F.when(
        usable,
        F.struct(
            clamp(whole, 0.0, 100.0).cast("int").alias("match_score"),
            coerce_bool(found["core_role_compatible"]).alias("core_role_compatible"),
            text_list_of(found["strengths"]).alias("strengths"),
            text_list_of(found["gaps"]).alias("gaps"),
            text_of(found["verdict"], rules.NO_VERDICT).alias("verdict"),
        ),
    )


def parse_match(raw: Column) -> Column:
    """Match answer as a struct, NULL when invalid (an infinite score included)."""
    return let(json_fields(raw, MATCH_FIELDS), match_from_fields)


CONTRACT_FIELDS = ("regime", "confidence", "evidence")


def contract_from_fields(found: Column) -> Column:
    regime = F.upper(strip(text_of(found["regime"], "")))
    return let(regime, lambda name: _contract_struct(found, name))


def _contract_struct(found: Column, regime: Column) -> Column:
    value, kind = found["confidence"], _kind(found["confidence"])
    number = F.when(kind == "STRING", strip(_as_string(value)).try_cast("double")).when(
        kind.rlike("^(ARRAY|OBJECT|VOID)"), F.lit(None).cast("double")
    ).otherwise(F.try_variant_get(value, "$", "double"))
    return F.when(
        found.isNotNull() & regime.isin(*rules.REGIMES),
        F.struct(
            regime.alias("regime"),
            clamp(F.coalesce(number, F.lit(0.0)), 0.0, 1.0).alias("confidence"),
            strip(text_of(found["evidence"], "")).alias("evidence"),
        ),
    )


def parse_contract(raw: Column) -> Column:
    """Contract answer as a struct, NULL when invalid (regime outside the domain)."""
    return let(json_fields(raw, CONTRACT_FIELDS), contract_from_fields)


def response_content(body: Column) -> Column:
    """Message text of a chat-completion body; NULL is a failed attempt."""
    return blank_to_null(F.get_json_object(body, "$.choices[0].message.content"))


def transient_error(code: Column, message: Column) -> Column:
    """Is the failure of an attempt worth another one (quota, limit, overload)?"""
    text = F.lower(F.coalesce(message, F.lit("")))
    hit = F.coalesce(code.isin(*rules.TRANSIENT_CODES), F.lit(False))
    for word in rules.TRANSIENT_KEYWORDS:
        hit = hit | F.contains(text, F.lit(word))
    return hit
