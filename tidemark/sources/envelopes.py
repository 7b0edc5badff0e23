"""Classification of raw responses: failure, refusal and emptiness stay apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed_values as fv


def response_outcome(status: Column) -> Column:
    """ok, retryable, rejected, or transport_error when nothing came back."""
    return (
        F.when(status.isNull(), F.lit("transport_error"))
        .when(status.between(200, 299), F.lit("ok"))
        .when(status.isin(*fv.RETRYABLE_STATUSES), F.lit("retryable"))
        .otherwise(F.lit("rejected"))
    )


def envelope_outcome(payload: Column) -> Column:
    """What an ``{"error": [...], "result": ...}`` body says, inside a 200.

    A listed error is transient or a refusal; a body with neither an error nor a
    result is malformed.  None of them is an empty result.
    """
    body = F.from_json(payload, "struct<error: array<string>, result: string>")
    errors = body["error"]
    transient = F.exists(
        errors,
        lambda item: _any([item.startswith(prefix) for prefix in fv.TRANSIENT_ERROR_PREFIXES]),
    )
    return (
        F.when(errors.isNull(), F.lit("malformed"))
        .when(F.size(errors) > 0, F.when(transient, F.lit("unavailable")).otherwise("rejected"))
        .when(F.get_json_object(payload, "$.result").isNull(), F.lit("malformed"))
        .otherwise(F.lit("ok"))
    )


def venue_health(status: Column) -> Column:
    """Published status text to operational, degraded or unavailable."""
    return (
        F.when(status.isin(*fv.OPERATIONAL_TEXTS), F.lit("operational"))
        .when(status.isin(*fv.DEGRADED_TEXTS), F.lit("degraded"))
        .otherwise(F.lit("unavailable"))
    )


def payload_fault(payload: Column, expected: Sequence[tuple[str, str]]) -> Column:
    """The first (field, kind) an object violates, or NULL when it has the shape.

    Kinds are ``string``, ``integer``, ``array`` and ``object``.  The check reads
    the JSON type as written, so the text "1" is not an integer.
    """
    document = F.try_parse_json(payload)
    kind_of = lambda path: F.schema_of_variant(
        F.try_variant_get(document, path, "variant")
    )
    tests = {
        "string": lambda kind: kind == "STRING",
        "integer": lambda kind: kind == "BIGINT",
        "array": lambda kind: kind.startswith("ARRAY"),
        "object": lambda kind: kind.startswith("OBJECT"),
    }
    fault = F.when(document.isNull(), F.lit("payload: not JSON")).when(
        ~F.schema_of_variant(document).startswith("OBJECT"), F.lit("payload: expected an object")
    )
    for name, kind in expected:
        actual = kind_of(f"$.{name}")
        fault = fault.when(actual.isNull(), F.lit(f"{name}: missing required key")).when(
            ~tests[kind](actual), F.lit(f"{name}: expected {kind}")
        )
    return fault


def regime_response_fault(payload: Column) -> Column:
    """Why a recorded regime assessment is unusable, or NULL when it is valid."""
    return _response_fault(
        payload,
        labels={"regime": fv.REGIME_LABELS},
        required=("regime", "confidence"),
        allowed=("regime", "confidence", "rationale"),
    )


def recommendation_fault(payload: Column) -> Column:
    """Why a recorded strategy recommendation is unusable, or NULL."""
    return _response_fault(
        payload,
        labels={"action": fv.MARKET_ACTIONS, "regime": fv.REGIME_LABELS},
        required=("action", "strategy", "confidence"),
        allowed=("action", "strategy", "regime", "confidence", "rationale"),
    )


def _response_fault(payload, labels, required, allowed) -> Column:
    fields = F.from_json(payload, "map<string,string>")
    confidence = F.try_element_at(fields, F.lit("confidence")).try_cast("double")
    surplus = F.array_except(F.map_keys(fields), F.array(*[F.lit(name) for name in allowed]))
    fault = F.when(fields.isNull(), F.lit("not an object")).when(
        F.size(surplus) > 0, F.lit("unexpected field")
    )
    for name in required:
        fault = fault.when(
            ~F.map_contains_key(fields, F.lit(name)), F.lit(f"{name}: missing required key")
        )
    for name, values in labels.items():
        value = F.try_element_at(fields, F.lit(name))
        fault = fault.when(
            F.map_contains_key(fields, F.lit(name)) & ~F.coalesce(value.isin(*values), F.lit(False)),
            F.lit(f"{name}: unknown label"),
        )
    # Texts must be JSON strings: a number or a null is not one.
    document = F.try_parse_json(payload)
    for name in (name for name in allowed if name != "confidence"):
        written = F.schema_of_variant(F.try_variant_get(document, f"$.{name}", "variant"))
        fault = fault.when(
            F.map_contains_key(fields, F.lit(name)) & (F.coalesce(written, F.lit("VOID")) != "STRING"),
            F.lit(f"{name}: expected string"),
        )
    in_range = F.coalesce(confidence.between(0.0, 1.0), F.lit(False))
    return fault.when(~in_range, F.lit("confidence: outside 0..1"))


def _any(tests: list[Column]) -> Column:
    combined = tests[0]
    for test in tests[1:]:
        combined = combined | test
    return combined
