"""Specs by version and artifacts with their provenance; both can be written as tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..errors import EngineError
from ..series import shared_dir
from .model import Artifact, Spec


class SpecStore:
    def __init__(self):
        self.versions: dict[str, dict[str, Spec]] = {}

    def put(self, spec: Spec) -> None:
        own = self.versions.setdefault(spec.spec_id, {})
        if spec.version in own:
            raise EngineError("spec.duplicate", f"{spec.spec_id}@{spec.version} is there already")
        own[spec.version] = spec

    def get(self, spec_id: str, version: str | None = None) -> Spec:
        own = self.versions.get(spec_id)
        if not own or (version and version not in own):
            raise EngineError("spec.not_found", f"no spec {spec_id}{'@' + version if version else ''}")
        return own[version] if version else list(own.values())[-1]

    def delete(self, spec_id: str) -> None:
        self.get(spec_id)
        del self.versions[spec_id]

    def search(self, text: str = "", limit: int | None = None, offset: int = 0) -> list[Spec]:
        found = [list(v.values())[-1] for k, v in sorted(self.versions.items()) if text.lower() in k.lower() or text.lower() in json.dumps(list(v.values())[-1].metadata).lower()]
        found = found[offset:] if offset < len(found) else found  # an offset past the end counts as none
        return found[:limit] if limit else found


class KeyValueStore:
    """<namespace>:<id> -> JSON in a store that the host gives as two functions."""

    def __init__(self, namespace: str, read: Callable[[str], str | None], write: Callable[[str, str], None]):
        self.namespace, self._read, self._write = namespace, read, write

    def get(self, key: str):
        raw = self._read(f"{self.namespace}:{key}")
        return None if raw is None else json.loads(raw)

    def save(self, key: str, value) -> None:
        self._write(f"{self.namespace}:{key}", json.dumps(value, default=str))


def stored(value):
    """A value as JSON can hold it: a frame becomes the path of a table in the shared folder."""
    if isinstance(value, DataFrame):
        frame, path = _written(value)
        return {"table": path, "columns": frame.columns}
    if isinstance(value, dict):
        return {k: stored(v) for k, v in value.items()}
    return value


def restored(spark: SparkSession, value):
    """The value that ``stored`` was given, frames read back."""
    if isinstance(value, dict) and set(value) == {"table", "columns"}:
        return spark.read.parquet(value["table"])
    if isinstance(value, dict):
        return {k: restored(spark, v) for k, v in value.items()}
    return value


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    path = f"{shared_dir(df.sparkSession)}/artifact-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


class ArtifactStore:
    """Artifacts by id. ``kept``: a store outside to which every artifact goes as well, and from which others come back."""

    def __init__(self, kept: KeyValueStore | None = None):
        self.by_id: dict[str, Artifact] = {}
        self.kept = kept

    def save(self, a: Artifact) -> None:
        if self.kept is not None:
            try:
                self.kept.save(a.artifact_id, {"kind": a.kind, "name": a.name, "value": stored(a.value), "extra": stored(a.extra), "jobId": a.job_id, "specId": a.spec_id, "specVersion": a.spec_version, "tags": a.tags, "createdAt": a.created_at.isoformat()})
            except Exception as e:
                raise EngineError("artifact.store_failed", f'"{a.name}": {e}') from e
        self.by_id[a.artifact_id] = a

    def get(self, artifact_id: str, spark: SparkSession | None = None) -> Artifact:
        """With ``spark``, an artifact that another session has saved to ``kept`` is read back."""
        if artifact_id not in self.by_id:
            held = self.kept.get(artifact_id) if self.kept is not None and spark is not None else None
            if held is None:
                raise EngineError("artifact.not_found", f'no artifact "{artifact_id}"')
            self.by_id[artifact_id] = Artifact(
                artifact_id, held["kind"], held["name"], restored(spark, held["value"]), held["jobId"], held["specId"], held["specVersion"], held["tags"], extra=restored(spark, held["extra"]), created_at=datetime.fromisoformat(held["createdAt"])
            )
        return self.by_id[artifact_id]

    def query(self, job_id: str | None = None, spec_id: str | None = None, kind: str | None = None, tags: list[str] | None = None, created: tuple[datetime, datetime] | None = None, limit: int | None = None) -> list[Artifact]:
        found = [
            a for a in self.by_id.values()
            if (job_id is None or a.job_id == job_id) and (spec_id is None or a.spec_id == spec_id) and (kind is None or a.kind == kind) and (not tags or set(tags) <= set(a.tags)) and (created is None or created[0] <= a.created_at <= created[1])
        ]
        return found[:limit] if limit else found

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """The artifacts as rows with a JSON payload, ready for ``df.write``; frames are written as tables, see ``restored``."""
        rows = [(a.artifact_id, a.kind, a.name, json.dumps(stored(a.value), default=str), a.job_id, a.spec_id, a.spec_version, a.tags, a.created_at) for a in self.by_id.values()]
        return spark.createDataFrame(rows, "artifact_id string, kind string, name string, payload string, job_id string, spec_id string, spec_version string, tags array<string>, created_at timestamp")
