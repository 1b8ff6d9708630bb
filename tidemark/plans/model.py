"""Specs, jobs and artifacts as plain data."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any


def _of(cls, d: Any):
    return d if isinstance(d, cls) else cls.from_dict(d)


@dataclass
class InputSource:
    source_type: str
    query: str = ""
    filter: str | None = None
    time_range: tuple[Any, Any] | None = None
    column_aliases: dict[str, str] = field(default_factory=dict)
    merge: str = "append"

    @classmethod
    def from_dict(cls, d: Mapping) -> InputSource:
        tr = d.get("timeRange")
        return cls(d["sourceType"], d.get("query", ""), d.get("filter"), (tr["start"], tr["end"]) if tr else None, dict(d.get("columnAliases") or {}), d.get("merge", "append"))


@dataclass
class TransformStep:
    name: str
    parameters: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, d: Mapping) -> TransformStep:
        return cls(d.get("name", ""), dict(d.get("parameters") or {}))


@dataclass
class StepInput:
    from_: str
    field: str
    index_field: str | None = None
    column: str = "value"
    index_column: str = "index"

    @classmethod
    def from_dict(cls, d: Mapping) -> StepInput:
        return cls(d.get("from", ""), d.get("field", ""), d.get("indexField"), d.get("column", "value"), d.get("indexColumn", "index"))


@dataclass
class AnalysisStep:
    function: str
    parameters: dict = field(default_factory=dict)
    id: str | None = None
    input: StepInput | None = None
    transforms: list[TransformStep] = field(default_factory=list)

    @property
    def result_key(self) -> str:
        return self.id or self.function

    @classmethod
    def from_dict(cls, d: Mapping) -> AnalysisStep:
        return cls(d.get("function", ""), dict(d.get("parameters") or {}), d.get("id"), _of(StepInput, d["input"]) if d.get("input") else None, [_of(TransformStep, t) for t in d.get("transforms") or []])


@dataclass
class OutputDef:
    name: str
    type: str = "metric"
    from_: str | None = None
    field: str | None = None
    index_field: str | None = None
    parameters: dict | None = None

    def __post_init__(self):
        self.parameters = self.parameters or {}

    @property
    def source_key(self) -> str:
        return self.from_ or self.name

    @classmethod
    def from_dict(cls, d: Mapping) -> OutputDef:
        return cls(d["name"], d.get("type", "metric"), d.get("from"), d.get("field"), d.get("indexField"), dict(d.get("parameters") or {}))


@dataclass
class Spec:
    spec_id: str
    version: str
    input_sources: list[InputSource] = field(default_factory=list)
    transforms: list[TransformStep] = field(default_factory=list)
    analysis_steps: list[AnalysisStep] = field(default_factory=list)
    outputs: list[OutputDef] = field(default_factory=list)
    parameters: dict = field(default_factory=dict)
    order_by: list[str] = field(default_factory=lambda: ["_timestamp"])
    metadata: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, d: Mapping) -> Spec:
        return cls(
            d.get("specId", ""), d.get("version", ""), [_of(InputSource, x) for x in d.get("inputSources") or []], [_of(TransformStep, x) for x in d.get("transforms") or []],
            [_of(AnalysisStep, x) for x in d.get("analysisSteps") or []], [_of(OutputDef, x) for x in d.get("outputs") or []], dict(d.get("parameters") or {}), list(d.get("orderBy") or ["_timestamp"]), dict(d.get("metadata") or {}),
        )


@dataclass
class Issue:
    field: str
    message: str
    code: str


#: Results that a stream supplies itself.
STREAM_KEYS = ("windowState", "pointCount", "lateDropped", "overflowDropped")
_ID, _SEMVER = re.compile(r"[a-zA-Z0-9\-_]{1,128}"), re.compile(r"\d+\.\d+\.\d+(-[a-zA-Z0-9.]+)?(\+[a-zA-Z0-9.]+)?")


def validate(spec: Spec, functions: Mapping[str, Any] | None = None) -> list[Issue]:
    """All that is wrong with a spec; empty if nothing is. ``functions``: name -> info with ``results``."""
    out: list[Issue] = []

    def bad(field_: str, message: str, code: str) -> None:
        out.append(Issue(field_, message, f"spec.invalid.{code}"))

    if not _ID.fullmatch(spec.spec_id):
        bad("specId", "letters, digits, hyphens and underscores, 1 to 128", "bad_spec_id")
    if not _SEMVER.fullmatch(spec.version):
        bad("version", "not a semantic version", "bad_version")
    for name, items in (("inputSources", spec.input_sources), ("analysisSteps", spec.analysis_steps), ("outputs", spec.outputs)):
        if not items:
            bad(name, "at least one is needed", "missing_field")
    keys: dict[str, int] = {}
    for i, s in enumerate(spec.analysis_steps):
        if not s.function:
            bad(f"analysisSteps[{i}].function", "the function has no name", "empty_function")
        if s.result_key in keys:
            bad(f"analysisSteps[{i}]", f'key "{s.result_key}" is used by step {keys[s.result_key]}', "duplicate_step_key")
        keys.setdefault(s.result_key, i)
        if functions is not None and s.function and s.function not in functions:
            bad(f"analysisSteps[{i}].function", f'no function "{s.function}"', "unknown_function")
        for k, t in enumerate(s.transforms):
            if not t.name:
                bad(f"analysisSteps[{i}].transforms[{k}].name", "the transform has no name", "empty_transform")
    made_by = {s.result_key: s.function for s in spec.analysis_steps}

    def check_fields(where: str, source: str, fields: dict[str, str | None]) -> None:
        declared = getattr((functions or {}).get(made_by.get(source)), "results", ()) or ()
        for label, value in fields.items():
            if value is not None and declared and value not in declared:
                bad(f"{where}.{label}", f'"{made_by[source]}" has no result "{value}"', "unknown_result_field")

    for i, s in enumerate(spec.analysis_steps):
        if s.input is None:
            continue
        at = keys.get(s.input.from_)
        if at is None:
            bad(f"analysisSteps[{i}].input.from", f'no step makes "{s.input.from_}"', "unresolved_step_input")
        elif at >= i:
            bad(f"analysisSteps[{i}].input.from", f'"{s.input.from_}" runs at or after this step', "step_input_order")
        if not s.input.field:
            bad(f"analysisSteps[{i}].input.field", "a result field is needed", "missing_field")
        else:
            check_fields(f"analysisSteps[{i}].input", s.input.from_, {"field": s.input.field, "indexField": s.input.index_field})
    for i, o in enumerate(spec.outputs):
        if keys and o.source_key not in keys and o.source_key not in STREAM_KEYS:
            bad(f"outputs[{i}]", f'no step makes "{o.source_key}"', "unresolved_output_source")
        check_fields(f"outputs[{i}]", o.source_key, {"field": o.field, "indexField": o.index_field})
    for i, t in enumerate(spec.transforms):
        if not t.name:
            bad(f"transforms[{i}].name", "the transform has no name", "empty_transform")
    return out


@dataclass
class Job:
    job_id: str
    spec_id: str
    spec_version: str
    mode: str
    status: str = "queued"
    progress: float = 0.0
    created_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    errors: list[dict] = field(default_factory=list)
    logs: list[str] = field(default_factory=list)
    artifact_ids: list[str] = field(default_factory=list)
    parameters: dict = field(default_factory=dict)
    handle: Any = None
    watch: Any = None
    listener: Any = None


MOVES = {"queued": {"running", "canceled", "failed"}, "running": {"completed", "failed", "canceled"}}


@dataclass
class Artifact:
    artifact_id: str
    kind: str
    name: str
    value: Any
    job_id: str
    spec_id: str
    spec_version: str
    tags: list[str] = field(default_factory=list)
    created_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    extra: dict = field(default_factory=dict)
