"""Redaction of registered secrets in text columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import fixed_values as fv


def redact(text: Column, secrets: Iterable[str]) -> Column:
    """Literal replacement, longest secret first; short secrets are ignored."""
    kept = {secret for secret in secrets if secret and len(secret) >= fv.MIN_SECRET_LENGTH}
    for secret in sorted(kept, key=lambda item: (-len(item), item)):
        text = F.replace(text, F.lit(secret), F.lit(fv.REDACTION_PLACEHOLDER))
    return text


def redact_many(frame: DataFrame, secrets: Iterable[str], columns: Sequence[str]) -> DataFrame:
    """``redact`` for registers of any length: one pass with a multi-pattern automaton.

    Every occurrence of every secret is found at once; of those that overlap the longest
    stands, ties by text and then the earlier, which is what replacing one secret after
    the other leaves.  Secrets are looked for in the text as it was, so one that only
    the placeholder would complete is not found.  Needs pyahocorasick on the executors.
    """
    kept = {secret for secret in secrets if secret and len(secret) >= fv.MIN_SECRET_LENGTH}
    ordered = sorted(kept, key=lambda item: (-len(item), item))
    if not ordered:
        return frame

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for rank, secret in enumerate(ordered):
            automaton.add_word(secret, (rank, len(secret)))
        automaton.make_automaton()
        for batch in batches:
            for name in columns:
                at = batch.schema.get_field_index(name)
                texts = [None if t is None else _masked(t, automaton) for t in batch.column(at).to_pylist()]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch

    return frame.mapInArrow(masked, frame.schema)


def _masked(text: str, automaton) -> str:
    found = sorted((rank, end - length + 1, end + 1) for end, (rank, length) in automaton.iter(text))
    if not found:
        return text
    taken, spans = bytearray(len(text)), []
    for _, start, end in found:
        if taken.find(1, start, end) < 0:
            taken[start:end] = b"\1" * (end - start)
            spans.append((start, end))
    out, at = [], 0
    for start, end in sorted(spans):
        out += [text[at:start], fv.REDACTION_PLACEHOLDER]
        at = end
    return "".join([*out, text[at:]])


def is_sensitive_name(name: str) -> bool:
    return any(token in name.lower() for token in fv.SENSITIVE_NAME_TOKENS)


def redact_frame(frame: DataFrame, secrets: Iterable[str]) -> DataFrame:
    """Mask columns with sensitive names whole, and secrets inside other text."""
    secrets = list(secrets)
    columns = []
    for field in frame.schema.fields:
        column = F.col(f"`{field.name}`")
        if is_sensitive_name(field.name):
            column = F.lit(fv.REDACTION_PLACEHOLDER)
        elif isinstance(field.dataType, T.StringType):
            column = redact(column, secrets)
        columns.append(column.alias(field.name))
    return frame.select(*columns)
