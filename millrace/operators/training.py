"""Training examples from messages, answer schemas, and clocks of bounded runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Label of tokens that are not trained on.
IGNORED = -100
ROLES = ["system", "user", "assistant"]


class ChatTokenizer(Protocol):
    """What a tokenizer has to offer: ids of messages, with an opened answer if ``generation``, and text of ids."""

    def ids(self, messages: list[dict[str, str]], generation: bool) -> list[int]: ...

    def text(self, ids: list[int]) -> str: ...


def supervised(messages: list[dict[str, str]], tokenizer: ChatTokenizer, most: int) -> tuple[list[int], list[int], str | None]:
    """Token ids, labels that leave the prompt out, and why an example may not be used; nothing is ever cut."""
    if [m["role"] for m in messages] != ROLES:
        return [], [], "roles"
    prompt, full = tokenizer.ids(messages[:-1], True), tokenizer.ids(messages, False)
    answer = full[len(prompt) :]
    if not answer or full[: len(prompt)] != prompt:
        return [], [], "prompt_is_no_prefix"
    if len(full) > most:
        return [], [], "over_length"
    if tokenizer.text(answer).strip() != messages[-1]["content"].strip():
        return [], [], "target_is_not_decoded"
    return full, [IGNORED] * len(prompt) + answer, None


def encode_examples(rows: DataFrame, tokenizer: Callable[[], ChatTokenizer], most: int, key: str = "id") -> DataFrame:
    """``(id, input_ids, labels, problem)`` of ``rows(id, messages)``; the tokenizer is made once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tokenizer()
        for batch in batches:
            out = [supervised(m or [], made, most) for m in batch.column(1).to_pylist()]
            ids, labels = (pa.array([x[k] for x in out], pa.list_(pa.int32())) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, labels, pa.array([x[2] for x in out], pa.string())], names=["id", "input_ids", "labels", "problem"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "messages").mapInArrow(run, f"id {kind}, input_ids array<int>, labels array<int>, problem string")


def json_schema(kind: T.DataType, choices: dict[str, list[str]] | None = None) -> dict:
    """The JSON Schema of a type: all fields required, no others allowed; ``choices`` lists the values of named fields."""
    names = {T.StringType: "string", T.BooleanType: "boolean", T.IntegerType: "integer", T.LongType: "integer", T.DoubleType: "number", T.FloatType: "number"}
    if isinstance(kind, T.StructType):
        fields = {}
        for f in kind.fields:
            fields[f.name] = json_schema(f.dataType, choices)
            at = fields[f.name].get("items", fields[f.name])
            if f.name in (choices or {}):
                at["enum"] = list(choices[f.name])
            if f.nullable and "type" in fields[f.name] and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                fields[f.name]["type"] = [fields[f.name]["type"], "null"]
        return {"type": "object", "properties": fields, "required": kind.names, "additionalProperties": False}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType, choices)}
    return {"type": names[type(kind)]}


def deadline(prior: tuple[float, float] | None, now: float, length: float = 72_000.0, margin: float = 900.0) -> tuple[float, float]:
    """Launch and end of a run: fixed when it is first launched, and the same after it resumes.

    A resumed run whose end was moved, or with less than ``margin`` seconds left, is an error.
    """
    if prior is None:
        return now, now + length
    launch, end = prior
    if abs(end - launch - length) > 0.001:
        raise ValueError("the deadline was moved")
    if now >= end - margin:
        raise ValueError("too little time is left before the deadline")
    return launch, end


def barrier_due(results: int, seconds: float, every: int = 5, most_seconds: float = 300.0) -> bool:
    """Whether dispatch pauses for a checkpoint: after so many results, or so long after the last one if there is any."""
    return results >= every or (results > 0 and seconds >= most_seconds)
